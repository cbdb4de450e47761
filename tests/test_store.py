"""Writes, lookups, files, pages' titles and the search's fixed status on small rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswork.operators import detail, search, store
from presswork.operators import emotions as em
from presswork.operators import html as hp
from presswork.operators import publish as pb
from presswork.sources import files
from presswork.sources.tables import jdbc_table


def test_inserts(spark):
    old = spark.createDataFrame([(7, "a", "ACTIVE"), (3, None, None)], "id bigint, login_id string, status string")
    new = spark.createDataFrame([("b",), ("b",), (None,), ("a",)], "login_id string")
    got = sorted((tuple(r) for r in store.inserted(old, new, status=F.lit("PENDING")).collect()), key=repr)
    assert sorted(r[0] for r in got) == [3, 7, 8, 9, 10, 11] and sorted(str(r[1]) for r in got if r[0] > 7) == ["None", "a", "b", "b"]
    assert {r[2] for r in got if r[0] > 7} == {"PENDING"}
    once = sorted(tuple(r) for r in store.inserted_unless(old, new, "login_id").collect())
    assert [r[:2] for r in once] == [(3, None), (7, "a"), (8, "b")]
    assert store.inserted(old.limit(0), new.limit(0)).count() == 0


def test_updates_and_lookup(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, "x", t), (2, "y", t), (2, "y", t), (None, "z", t)], "id bigint, file_path string, updated_at timestamp")
    got = store.updated(old, spark.createDataFrame([(2, None), (9, "q")], "id bigint, file_path string"), F.lit("2025-05-05 00:00:00").cast("timestamp"))
    assert sorted(((r.id, r.file_path, r.updated_at.year) for r in got.collect()), key=repr) == sorted([(1, "x", 2024), (2, None, 2025), (2, None, 2025), (None, "z", 2024)], key=repr)
    assert store.row_or_error(old, 1).count() == 1
    with pytest.raises(LookupError):
        store.row_or_error(old, 5)
    keys = spark.createDataFrame([(" ",), (None,), ("k",)], "k string").select(store.key_or_null(F.col("k"), F.concat(F.lit("u/"), "k")).alias("u")).collect()
    assert [r.u for r in keys] == [None, None, "u/k"]
    rel = store.related_rows(spark.createDataFrame([(1, 2, 0.5)], "article_id bigint, policy_id bigint, score double"), F.lit("2026-03-29").cast("date"), "active").first()
    assert (rel.batch_date, rel.status) == (dt.date(2026, 3, 29), "active")


def test_publish_is_whole_or_nothing(spark, tmp_path):
    d = spark.range(5)
    pb.publish(d, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5
    with pytest.raises(FileExistsError):
        pb.publish(d, f"{tmp_path}/t")


def test_vectors_of_a_model(spark):
    d = pb.embedded(spark.createDataFrame([("ab",), ("",)], "t string"), "t", lambda s: s.map(lambda x: [float(len(x))]))
    assert [r.vector for r in d.collect()] == [[2.0], [0.0]]


def test_jdbc_options(spark):
    with pytest.raises(Exception, match="(?i)driver"):
        jdbc_table(spark, "jdbc:none://x", "t", column="id", upper=10, parts=2).count()


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"124")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "d.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"1")
    def pages(path, content):
        if content == b"bad":
            raise ValueError(path)
        return pd.DataFrame({"path": [path], "n": [len(content)]})

    f = files.binary_files(spark, str(tmp_path))
    assert sorted(r.length for r in f.select("length").collect()) == [3, 3]
    assert [r.n for r in files.parsed(f, pages, "path string, n int").collect()] == [3]


def test_titles(spark):
    rows = ['<meta property="og:title" content="A &amp; B &#44032;">', '<meta content="A" property="og:title"><title>B</title>', "<title> A\n &lt;B&gt; </title>", '<meta property="og:title" content=""><title>B</title>', '<meta name="x" content="og:title"><title>B</title>', "", None, "<META CONTENT='it&quot;s' PROPERTY='og:title'>"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, html string").select("i", hp.page_title(F.col("html")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["A & B 가", "A", "A <B>", "", "B", "", None, 'it"s']
    rows = spark.createDataFrame([("", None), ("a", None), (None, "b"), ("", "")], "title string, content string")
    assert hp.without_empty(rows).count() == 2


def test_only_active_papers_and_articles(spark):
    day = dt.date(2024, 2, 3)
    papers = spark.createDataFrame([(1, day, "제목", "a\nb\nc", "ACTIVE", 5), (2, day, "제목", None, "EXPIRED", 5), (3, None, "제목", "", "ACTIVE", 5), (4, day, "제목", None, None, 5), (5, day, "x", None, "ACTIVE", 6)], "id bigint, published_date date, title string, content string, status string, admin_id bigint")
    articles = spark.createDataFrame([(10, 1, "t", "s", "i", "ACTIVE"), (11, 1, "t", "s", "i", "EXPIRED"), (12, 2, "t", None, None, "ACTIVE")], "id bigint, paper_id bigint, title string, summary string, image_path string, status string")
    admins = spark.createDataFrame([(5, "일보", "l")], "id bigint, press_company string, login_id string")
    assert {r.id for r in search.publications(papers, articles, q="제목").collect()} == {1, 3}
    got = search.publication_list(papers, articles, admins, 5, q="제목", size=1)
    assert [(r.id, r.total, r.admin_name) for r in got.collect()] == [(3, 2, "일보")]
    links, names = spark.createDataFrame([(10, 1)], "article_id bigint, keyword_id bigint"), spark.createDataFrame([(1, "말")], "id bigint, name string")
    assert sorted((r.article_id, r.keywords) for r in detail.publication_articles(papers, articles, links, names).collect()) == [(10, "말"), (12, "")]


def test_only_standing_reactions_count(spark):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, 1, u, e, at + dt.timedelta(seconds=i)) for i, (u, e) in enumerate([(1, "view"), (1, "view"), (2, "view"), (2, "click"), (3, "click")])], "seq bigint, article_id bigint, user_identifier bigint, emotion_type string, ts timestamp")
    got = em.emotion_stats(spark.createDataFrame([(1,), (2,)], "id bigint"), em.final_states(log)).orderBy("article_id").collect()
    assert [(r.n_view, r.n_click, r.n_total) for r in got] == [(0, 2, 2), (0, 0, 0)]
