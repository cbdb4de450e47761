"""Exact nearest vectors for a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions.vector import l2, score

#: Queries that are held against the vectors in one pass; what is broadcast has this bound.
QUERY_BLOCK = 2048


#: Vectors that are held against the queries at once, and pairs whose exact distance is taken at once.
CHUNK, EXACT = 1024, 1 << 16


def _limit(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``d`` the k-th least value of different ids (inf where there are fewer)."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    if len(first) < len(ids):
        d = np.minimum.reduceat(d[:, order], first, axis=1)
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _least(row: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, distance, id, rank of the k least (distance, id) of each row, an id once."""
    order = np.lexsort((d, i, row))
    row, d, i = row[order], d[order], i[order]
    once = np.r_[True, (np.diff(row) != 0) | (np.diff(i) != 0)]
    row, d, i = row[once], d[once], i[once]
    order = np.lexsort((i, d, row))
    row, d, i = row[order], d[order], i[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    return row[top], d[top], i[top], rank[top]


def _block_search(ids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool):
    """Top k per query within a partition, an id once; distances by differences, in double.

    The expanded distance only leaves out what is surely beyond the k-th: all within its rounding
    error of the k-th, however many tie there, are ordered by (exact distance, id)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        square = (q * q).sum(1)
        for b in batches:
            col = b.column(1)
            fits = col.value_lengths().to_numpy(zero_copy_only=False) == q.shape[1]
            fits &= ~np.isnan(b.column(0).to_numpy(zero_copy_only=False).astype(float))
            if not fits.any():
                continue
            kept = col.filter(pa.array(fits))
            v = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            vid = b.column(0).filter(pa.array(fits)).to_numpy(zero_copy_only=False).astype(np.int64)
            finite = np.isfinite(v).all(1)
            v, vid = v[finite], vid[finite]
            for s in range(0, len(vid), CHUNK):
                part, pid = v[s : s + CHUNK], vid[s : s + CHUNK]
                own = (part * part).sum(1)
                d = np.maximum(square[:, None] - 2.0 * (q @ part.T) + own, 0.0)
                if exclude_self:
                    d[ids[:, None] == pid[None, :]] = np.inf
                margin = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (square + own.max())
                limit = np.minimum(_limit(d, pid, k), best_d[:, -1] ** 2) + margin
                row, at = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                if not len(row):
                    continue
                exact = np.concatenate([np.sqrt(((part[at[e : e + EXACT]] - q[row[e : e + EXACT]]) ** 2).sum(1)) for e in range(0, len(row), EXACT)])
                old = np.repeat(np.unique(row), k)
                rank = np.tile(np.arange(k), len(old) // k)
                there = np.isfinite(best_d[old, rank])
                old, rank = old[there], rank[there]
                row, exact, near, rank = _least(np.r_[row, old], np.r_[exact, best_d[old, rank]], np.r_[pid[at], best_i[old, rank]], k)
                best_d[row, rank], best_i[row, rank] = exact, near
        hit = np.isfinite(best_d)
        rows = np.broadcast_to(ids[:, None], hit.shape)[hit]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(best_i[hit], pa.int64()), pa.array(best_d[hit], pa.float64())], ["query_id", "id", "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, exclude_self: bool = True) -> DataFrame:
    """query_id, id, distance, rank of the k nearest vectors of each query, exact; ties by id.

    An id that has several rows is one neighbour, at its least distance. Both have id and vector. Null vectors, and vectors of another length than a query's, are near
    to nothing. Queries go out in blocks of at most QUERY_BLOCK; the vectors are never shuffled,
    only k rows per query and partition are."""
    queries = queries.select("id", "vector").filter("id is not null and vector is not null and size(vector) > 0")
    vectors = vectors.select("id", "vector").filter("vector is not null")
    counts = queries.groupBy(F.size("vector").alias("dim")).count().collect()
    parts: list[DataFrame] = []
    for dim, n in ((r["dim"], r["count"]) for r in counts):
        blocks = -(-n // (QUERY_BLOCK // 2)) if n > QUERY_BLOCK else 1
        for b in range(blocks):
            rows = queries.filter((F.size("vector") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).collect()
            ids = np.asarray([r["id"] for r in rows], np.int64)
            q = np.asarray([r["vector"] for r in rows], np.float64).reshape(-1, dim)
            parts.append(vectors.mapInArrow(_block_search(ids, q, k, exclude_self), "query_id bigint, id bigint, distance double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, distance double, rank bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    found = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def nearest_to(vectors: DataFrame, target: list[float], k: int = 3) -> DataFrame:
    """id, distance of the k vectors nearest to one; ties by id."""
    v = F.array(*(F.lit(float(x)) for x in target))
    return vectors.select("id", l2(F.col("vector"), v).alias("distance")).filter("distance is not null").orderBy("distance", "id").limit(k)


def related(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """article_id, related_id, score of hits whose target row exists."""
    there = targets.select("id").distinct()
    return hits.join(there, "id", "left_semi").select(F.col("query_id").alias("article_id"), F.col("id").alias("related_id"), score(F.col("distance")).alias("score"))


def replace_related(old: DataFrame, new: DataFrame) -> DataFrame:
    """Related rows after those of the articles in ``new`` were replaced."""
    return old.join(new.select("article_id").distinct(), "article_id", "left_anti").select(*new.columns).unionByName(new)
