"""Geometry rules on literal pages."""

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.operators import layout as lo


def test_column_splits():
    xs = [50, 50, 55, 60, 400, 400, 405, 410, 750, 750, 755, 760]
    assert lo.column_splits(xs, 1000) == [230, 580]
    assert lo.column_splits(xs[:7], 1000) == []
    assert [lo.column_of(x, [230, 580]) for x in (229.9, 230, 600)] == [0, 1, 2]


def line(text, x0, y0, x1, y1, size=20.0):
    return {"text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "max_size": size}


def test_titles_of_two_lines_are_merged():
    got = lo.merge_titles([line("첫째 줄", 100, 100, 300, 120), line("둘째 줄", 110, 130, 290, 150), line("먼 줄", 100, 400, 300, 420)], 10, 1000)
    assert [t["text"] for t in got] == ["첫째 줄 둘째 줄", "먼 줄"]
    assert got[0]["y1"] == 150


def test_page_articles():
    titles = [line("주민자치회 출범식", 100, 100, 300, 120), line("마을 축제 열려", 100, 500, 300, 520)]
    body = [line("본문 글줄이 서른 자를 넘도록 충분히 길게 이어지는 경우 " + str(i), 100, 140 + 20 * i, 300, 152 + 20 * i, 10.0) for i in range(5)]
    got = lo.page_articles(titles + body, [10.0] * 9, titles, 1000, 1000)
    assert [a["title"] for a in got] == ["주민자치회 출범식"]
    assert got[0]["text"].count("\n") == 4
    assert lo.page_articles([], [], [], 1000, 1000) == []


def test_articles_frame_matches_the_function(spark):
    rows = [(1, 1, "주민자치회 출범식", 100.0, 100.0, 300.0, 120.0, 20.0)]
    rows += [(1, 1, f"본문 글줄이 서른 자를 넘도록 충분히 길게 이어지는 경우 {i}", 100.0, 140.0 + 20 * i, 300.0, 152.0 + 20 * i, 10.0) for i in range(5)]
    lines = spark.createDataFrame(rows, "doc_id bigint, page int, text string, x0 double, y0 double, x1 double, y1 double, max_size double")
    sizes = lines.select("doc_id", "page", F.col("max_size").alias("font_size"))
    pages = spark.createDataFrame([(1, 1, 1000.0, 1000.0)], "doc_id bigint, page int, width double, height double")
    got = lo.articles(lines, sizes, pages).collect()
    assert [(r.id, r.title) for r in got] == [("p01_a001", "주민자치회 출범식")]


def test_upper_median(spark):
    d = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)] + [(2, None)], "k int, x double")
    assert [(r.k, r.median) for r in lo.upper_median(d, ["k"], "x").collect()] == [(1, 3.0)]


@pytest.mark.parametrize(("gap", "parts"), [(19, 1), (20, 1), (21, 2)])
def test_line_split(spark, gap, parts):
    g = spark.createDataFrame([(1, 1, 1, 0, "가", 0.0, 10.0, 5.0, 8.0, 9.0), (1, 1, 1, 1, "나", 5.0 + gap, 10.0, 5.0, 8.0, 9.0)], "doc_id bigint, page int, line_no int, seq int, ch string, x double, y double, w double, h double, font_size double")
    p = spark.createDataFrame([(1, 1, 1000.0, 1000.0)], "doc_id bigint, page int, width double, height double")
    assert lo.split_lines(g, p).count() == parts


def test_title_rule(spark):
    cases = [("주민자치회 출범식 개최", 20.0, True), ("2 행정", 20.0, False), ("종합 5", 20.0, False), ("읍면 주민 한마당", 20.0, False), ("▶ 알림마당 소식", 20.0, False), ("1234 5678 안내", 20.0, False), ("주민자치회 출범식", 13.7, False), ("주민자치회 출범식", 13.9, True)]
    d = spark.createDataFrame([(t, s) for t, s, _ in cases], "t string, s double")
    got = [r[0] for r in d.select(tx.is_probable_title(F.col("t"), F.col("s"), F.lit(10.0))).collect()]
    assert got == [x for _, _, x in cases]
