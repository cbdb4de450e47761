"""Problem 4: lines repeated across one source's records.

Lines are nodes of a graph per (field, source), weighted by the records they stand in; lines that
follow each other are edges, weighted likewise. Nodes with enough support and edges with at least
half the support of their rarer end are kept; connected components are the boilerplate blocks, and
every occurrence of a block's lines is removed.

A source keeps at most (mean lines of a record) / ``share`` nodes, however many records it has, so
the graph of one source fits one task; occurrences are counted with partial sums and joined with
salt beyond a checked size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.session import checked_join, stage

NODE = ["field", "source", "k1", "k2"]


def line_key(line: Column) -> Column:
    """What is compared of a line: lower case, digit runs as 0, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[^\p{L}\p{N}]+", "")


def host(link: Column) -> Column:
    """The host in a link, or null."""
    got = F.regexp_extract(F.lower(link), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1)
    return F.when(got != "", got)


def sourced(articles: DataFrame, papers: DataFrame) -> DataFrame:
    """field, id, source, content of all records that count."""
    own = F.concat(F.lit("a"), F.col("admin_id").cast("string"))
    a = articles.select(F.lit("articles.content").alias("field"), "id", F.coalesce(own, host(F.col("link"))).alias("source"), "content")
    p = papers.select(F.lit("papers.content").alias("field"), "id", own.alias("source"), "content")
    return a.unionByName(p).filter("id is not null and source is not null and content is not null")


def hashed_lines(records: DataFrame) -> DataFrame:
    """field, source, id, line_no, k1, k2 of the lines that count; the keys are 128 bits of hash."""
    lines = records.select("field", "source", "id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("field", "source", "id", (F.col("pos") + 1).cast("bigint").alias("line_no"), line_key(F.col("line")).alias("key")).filter(F.length("key") >= 4)
    return keyed.select("field", "source", "id", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("2"), "key").alias("k2"))


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over one source's kept nodes; rows are edges, a node alone is an edge to itself."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x: tuple[int, int]) -> tuple[int, int]:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a1, a2, b1, b2 in pdf[["k1", "k2", "b1", "b2"]].itertuples(index=False):
        a, b = top((a1, a2)), top((b1, b2))
        if a != b:
            up[max(a, b)] = min(a, b)
    f, s = pdf["field"].iloc[0], pdf["source"].iloc[0]
    return pd.DataFrame([(f, s, *n, top(n)[0]) for n in list(up)], columns=[*NODE, "block"])


def boilerplate(records: DataFrame, min_records: int = 3, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(blocks, found). blocks: field, source, k1, k2, block, records. found: field, source, id,
    line_no, block; one row per line to remove.

    ``records`` has field, id, source, content. A record that is delivered repeatedly counts once;
    null id, source or content doesn't count, empty content counts as a record without lines. The
    first line is 1. Empty tables give empty results."""
    lines = stage(hashed_lines(records), "lines")
    size = records.groupBy("field", "source").agg(F.countDistinct("id").alias("all"))
    support = lines.select(*NODE, "id").distinct().groupBy(*NODE).agg(F.count("*").alias("records")).filter(F.col("records") >= min_records)
    nodes = stage(checked_join(support, stage(size, "sizes"), ["field", "source"]).filter(F.col("records") >= F.col("all") * share).drop("all"), "nodes")
    kept = stage(checked_join(lines, nodes, NODE).distinct(), "kept")
    w = Window.partitionBy("field", "id").orderBy("line_no")
    nxt = kept.withColumns({"b1": F.lead("k1").over(w), "b2": F.lead("k2").over(w), "n2": F.lead("records").over(w), "next": F.lead("line_no").over(w)})
    follow = nxt.filter(F.col("next") == F.col("line_no") + 1)
    edges = follow.groupBy(*NODE, "b1", "b2").agg(F.count("*").alias("w"), F.max(F.least("records", "n2")).alias("least"))
    edges = edges.filter((F.col("w") >= min_records) & (F.col("w") * 2 >= F.col("least"))).select(*NODE, "b1", "b2")
    graph = nodes.select(*NODE, F.col("k1").alias("b1"), F.col("k2").alias("b2")).unionByName(edges)
    schema = "field string, source string, k1 bigint, k2 bigint, block bigint"
    blocks = stage(graph.groupBy("field", "source").applyInPandas(_components, schema), "blocks")
    found = checked_join(kept.drop("records"), blocks, NODE).select("field", "source", "id", "line_no", "block")
    return blocks.join(nodes, NODE), found


def cleaned(records: DataFrame, found: DataFrame) -> DataFrame:
    """field, id, content: every record, without the lines found."""
    gone = found.groupBy("field", "id").agg(F.collect_set("line_no").alias("gone"))
    keep = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("bigint")), F.lit(False)))
    return records.join(gone, ["field", "id"], "left").select("field", "id", F.array_join(keep, "\n").alias("content"))
