"""Publication of an issue: chunks in, rows out; model stages are given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as tx

CHUNK = "paper_id bigint, title string, content string, reporter string, summary string, keywords array<string>, category string"
#: Step, percent, message.
STEPS = [
    ("PDF_UPLOADING", 5, "PDF 업로드 준비 중..."),
    ("PDF_READING", 15, "PDF 내용 확인 중..."),
    ("CHUNKING_AND_ANALYZING", 45, "기사 분리 및 분석 중..."),
    ("ANALYSIS_FINALIZING", 75, "기사 분석 결과 정리 중..."),
    ("KEYWORD_MAPPING", 85, "키워드 저장 및 매핑 중..."),
    ("FINDING_RELATED", 90, "연관 기사/정책 생성 중..."),
    ("SAVING", 95, "최종 저장 중..."),
    ("DONE", 100, "처리 완료."),
]
PERCENT = {step: percent for step, percent, _ in STEPS}


def banner_blocks(papers: DataFrame) -> DataFrame:
    """paper_id, n, page, article, title, text of the articles under banners in ``content``. Papers
    without a banner give nothing; text before the first one is left out."""
    head = r"={60}\n\[기사 (\d+)\] 페이지 (\d+) \| (\S+)\n={60}\n제목: ([^\n]*)\n\n?"
    blocks = F.split("content", r"(?=={60}\n\[기사 \d+\] 페이지 \d+ \| )", -1)
    d = papers.select(F.col("id").alias("paper_id"), F.explode(blocks).alias("b")).filter(F.col("b").rlike(head))
    part = lambda n: F.regexp_extract("b", head, n)
    return d.select("paper_id", part(1).cast("bigint").alias("n"), part(2).cast("bigint").alias("page"), part(3).alias("article"), part(4).alias("title"), tx.strip_control(F.regexp_replace("b", head, "")).alias("text"))


def stub_analyse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stand-in for a model: splits nothing, takes the first sentence as summary and no keywords."""
    for f in frames:
        text = f["text"].fillna("")
        yield pd.DataFrame({"paper_id": f["paper_id"], "title": f["title"], "content": text, "reporter": None, "summary": text.str.split(r"(?<=[.다]) ", n=1, regex=True).str[0], "keywords": [[] for _ in range(len(f))], "category": None})


def analysed(blocks: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = stub_analyse) -> DataFrame:
    """Chunks of a model that is run over batches of blocks."""
    return blocks.mapInPandas(model, CHUNK)


def accepted(chunks: DataFrame) -> DataFrame:
    """Chunks that are articles: no notices, no advertising."""
    return chunks.filter(~tx.is_non_article(F.col("title"), F.col("summary")) & ~tx.is_ad_category(F.col("category")))


def article_rows(chunks: DataFrame, admin_id: int | None = None) -> DataFrame:
    """Rows for the article table, without ids."""
    return accepted(chunks).select("title", "content", "summary", F.lit("").alias("link"), F.lit("ACTIVE").alias("status"), "reporter", tx.category_image(F.col("category")).alias("image_path"), "paper_id", F.lit(admin_id).cast("bigint").alias("admin_id"))


def embedded(df: DataFrame, text_col: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``df`` with ``vector`` from an embedding model over batches of texts."""
    return df.withColumn("vector", F.pandas_udf(model, "array<float>")(text_col))


def publish(df: DataFrame, path: str, **options: str) -> None:
    """Written aside and renamed: readers see all of it or nothing. An existing target is kept."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    tmp, final = jvm.org.apache.hadoop.fs.Path(path + "._writing"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    df.write.mode("overwrite").options(**options).parquet(path + "._writing")
    if not fs.rename(tmp, final):
        raise OSError(f"can't rename to {path}")


def latest_progress(log: DataFrame) -> DataFrame:
    """job_id, status, progress, ts: the last snapshot of each job; partial maxima, no sort."""
    top = log.groupBy("job_id").agg(F.max(F.struct("ts", "seq", "status", "progress")).alias("m"))
    return top.select("job_id", "m.status", "m.progress", "m.ts")


def article_ids(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, page, y0, x0) with the id of each article on its page."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "line_id")
    n = F.row_number().over(w)
    return df.withColumn("article_id", F.format_string("p%02d_a%03d", F.col("page"), n))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in several rows: what a unique constraint would refuse."""
    return df.groupBy(*keys).count().filter("count > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose key isn't null and has no parent: what a foreign key would refuse."""
    ids = parent.select(F.col("id").alias(key))
    return child.filter(F.col(key).isNotNull()).join(ids, key, "left_anti")


def cascade(child: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Child rows that stay when the parents ``gone`` (id) are deleted."""
    return child.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*child.columns)


def set_null(child: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Child rows with the key of deleted parents nulled."""
    g = gone.select(F.col("id").alias(key), F.lit(1).alias("__gone")).distinct()
    kept = child.join(g, key, "left")
    return kept.select(*(F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in child.columns))
