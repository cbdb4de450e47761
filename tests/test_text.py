"""Text functions on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.functions.vector import parse_vector, score
from presswork.operators import html, search, tracking


def one(spark, col, **values):
    names = list(values)
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return d.select(col).first()[0]


@pytest.mark.parametrize(("c", "out"), [("a\nb\nc", "a\nb"), ("a\n", "a"), ("\n\n", ""), (None, "")])
def test_preview(spark, c, out):
    assert one(spark, tx.preview(F.col("c")), c=c) == out


@pytest.mark.parametrize(("p", "login", "out"), [("일보", "x", "일보"), (" ", "x", "x"), (None, None, "")])
def test_display_name(spark, p, login, out):
    assert one(spark, tx.display_name(F.col("p"), F.col("l")), p=p, l=login) == out


@pytest.mark.parametrize(("t", "s", "out"), [("직원 모집", None, True), ("소식", "주택 화재 발생", True), ("사 고 (社告)", None, True), (None, None, False)])
def test_non_article(spark, t, s, out):
    assert one(spark, tx.is_non_article(F.col("t"), F.col("s")), t=t, s=s) is out


def test_small_rules(spark):
    assert one(spark, tx.strip_page_number(F.col("c")), c="12 동네방네") == "동네방네"
    assert one(spark, tx.continued_on(F.col("c")), c="기사 7 면 이어짐") == 7
    assert one(spark, tx.continued_on(F.col("c")), c="본문") is None
    assert one(spark, tx.category_image(F.col("c")), c="사건-사고") == "ai-images/incidents-accidents.png"
    assert one(spark, tx.category_image(F.col("c")), c=None) == "ai-images/placeholder.png"
    assert one(spark, tx.is_ad_category(F.col("c")), c=None) is False
    assert one(spark, tx.absolute_url(F.col("c"), "http://b"), c="articleView.html?idxno=1") == "http://b/news/articleView.html?idxno=1"
    assert one(spark, tx.progress(45, 75, F.lit(3), F.lit(10)), c="") == 53
    assert one(spark, tx.progress(15, 45, F.lit(10), F.lit(10)), c="") == 44
    assert one(spark, tx.progress(90, 95, F.lit(1), F.lit(2)), c="") == 92
    assert one(spark, tx.policy_time(F.col("c")), c="03/29/2026 10:11:12") == dt.datetime(2026, 3, 29, 1, 11, 12)
    assert one(spark, parse_vector(F.col("c")), c="[1,2.5]") == [1.0, 2.5]
    assert [one(spark, score(F.lit(float(d))), c="") for d in (0, 1, 3)] == [1.0, 0.5, 0.25]


def test_month_bounds():
    assert search.month_bounds("2024-12") == (dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    with pytest.raises(ValueError):
        search.month_bounds("2026-13")


def test_page_text():
    assert html.text_of('<p>밖</p><div id="article-view-content-div"><p>안 <b>글</b></p><script>x</script></div>') == "안 글"
    assert html.text_of('<div class="article-body"><p>가</p><p>나</p></div><p>다</p>') == "가 나"
    assert html.text_of("<body>그냥<br>글</body>") == "그냥 글"
    assert html.text_of(None) is None


def test_crawl_stops_at_a_known_or_repeated_link(spark):
    def run(links, known, strict=True):
        d = spark.createDataFrame([("s", 1, i, x) for i, x in enumerate(links)], "site string, page int, pos int, link string")
        k = spark.createDataFrame([(x,) for x in known], "link string")
        return [r.link for r in html.crawl_cutoff(d, k, strict=strict).orderBy("pos").collect()]

    assert run(["a", "b", "c", "d"], ["c"]) == ["a", "b"]
    assert run(["a", "a", "b"], []) == ["a"]
    assert run(["a", "a", "b"], [], strict=False) == ["a", "b"]


def test_identity(spark):
    good = "123e4567-e89b-42d3-a456-426614174000"
    d = spark.createDataFrame([(1, None), (2, [("user_uuid", "broken")]), (3, [("user_uuid", "broken"), ("user_uuid", good)])], "request_id int, list array<struct<name:string,value:string>>")
    got = {r.request_id: (r.uuid == good, r.is_new_user, len(r.uuid)) for r in tracking.identity(d).collect()}
    assert got == {1: (False, True, 36), 2: (False, False, 36), 3: (True, False, 36)}
