"""The llm queries, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import boilerplate, neardup, packing, pairs, pii, scanned, subjects, tokens
from presswork.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_texts(table(spark, d, "articles"), table(spark, d, "policy"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(_records(spark, d)).select("record_kind", "id_a", "id_b")


def p1_similar(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_classes(_records(spark, d))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return neardup.copies(_records(spark, d))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_counts(pairs.named_baskets(table(spark, d, "article_keywords"), table(spark, d, "keywords")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pairs(spark, d).select("name_a", "name_b")


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.sourced(table(spark, d, "articles"), table(spark, d, "papers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_spans(pii.fields(table(spark, d, "reports"), table(spark, d, "articles")))


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(pii.fields(table(spark, d, "reports"), table(spark, d, "articles")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate(_sourced(spark, d))[1].select("field", "id", "line_no")


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate(_sourced(spark, d))[0]


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    records = _sourced(spark, d)
    return boilerplate.cleaned(records, boilerplate.boilerplate(records)[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.noise_lines(scanned.fields(table(spark, d, "articles"), table(spark, d, "papers")), scanned.paper_names(table(spark, d, "admins")))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(scanned.fields(table(spark, d, "articles"), table(spark, d, "papers")), scanned.paper_names(table(spark, d, "admins")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_round_trip(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, d, "documents")))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p7_packed(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_shares(p8_shares(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_similar, p1_copies, p2_found, p2_pairs, p3_found, p3_masked, p4_found, p4_blocks, p4_cleaned, p5_found, p5_repaired, p6_ids, p6_round_trip, p7_packed, p7_summary, p8_found, p8_shares, p8_composition)
}

_P4_LINES = r"""
with rec as (
  select 'articles.content' field, id, coalesce('a' || cast(admin_id as varchar),
         nullif(regexp_extract(lower(link), '^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\s]*@)?([^/:?#\s]+)', 1), '')) source, content from articles
  union all select 'papers.content', id, 'a' || cast(admin_id as varchar), content from papers),
src as (select * from rec where id is not null and source is not null and content is not null),
ln as (select field, id, source, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from src),
ky as (select field, id, source, line_no, regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', '', 'g') k from ln),
cnt as (select field, source, count(distinct id) n from src group by 1, 2),
sup as (select field, source, k, count(distinct id) n from ky where length(k) >= 4 group by 1, 2, 3),
keep as (select s.field, s.source, s.k from sup s join cnt c on s.field = c.field and s.source = c.source where s.n >= 3 and s.n >= c.n * 0.1)
"""

SQL: dict[str, str] = {
    "p4_cleaned": _P4_LINES + """, rw as (select *, row_number() over () rid from src),
lr as (select rid, field, id, source, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) line_no from rw),
gone as (select distinct y.field, y.id, y.line_no from ky y join keep p on y.field = p.field and y.source = p.source and y.k = p.k)
select lr.field, lr.id, coalesce(string_agg(lr.line, chr(10) order by lr.line_no) filter (g.id is null), '') content
from lr left join gone g on g.field = lr.field and g.id = lr.id and g.line_no = lr.line_no group by lr.rid, lr.field, lr.id""",
    "p4_found": _P4_LINES + "select distinct y.field, y.id, cast(y.line_no as bigint) line_no from ky y join keep p on y.field = p.field and y.source = p.source and y.k = p.k",
}
