"""Text functions as Columns; all stay in the JVM.

Null inputs give null unless a function says otherwise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns whose texts must be these for the same rows to be told apart.
NON_ARTICLE_WORDS = ["모집", "채용", "구인", "공고", "알립니다", "주민게시판", "우리동네", "상가", "사무실", "세 놓습니다", "팁니다", "사람구합니다", "주택", "토지", "창고"]
NON_ARTICLE_PATTERNS = [r"(?i)사\s*고\s*\(\s*社\s*告\s*\)", r"(?i)^\s*알립니다\s*$", r"(?i)^\s*주민\s*게시판\s*$"]
AD_CATEGORY_WORDS = ["광고", "홍보", "공고", "채용", "모집", "입찰"]
TITLE_BAD_WORDS = ["발행", "면", "제 ", "호", "www", "http", "기자", "전화", "팩스"]
PAGE_NUMBER = r"^\d{1,3}\s+|\s+\d{1,3}$"
PAGE_HEADER = r"^(?:\d+\s+\S{1,3}|\S{1,3}\s+\d+)$"
CONTINUED = r"기사\s*(\d+)\s*면\s*이어짐"
CATEGORY_IMAGES = {
    "지방 행정": "local-government",
    "지역 정치": "local-politics",
    "공공 기관": "public-institution",
    "지역 산업": "regional-industry",
    "소상공인 및 시장": "small-business-market",
    "부동산 및 개발": "real-estate-development",
    "사건-사고": "incidents-accidents",
    "시민 사회": "civil-society",
    "교육 및 보건": "education-health",
    "문화-예술": "culture-arts",
    "여행-명소": "travel-attractions",
    "생활 스포츠": "sports-recreation",
    "지역 인물": "local-figures",
    "독자 목소리": "placeholder",
}
BANNER_LINE = "=" * 60


def strip_control(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def has_text(c: Column) -> Column:
    """Whether anything but white space is there; false for null."""
    return F.coalesce(F.length(strip_control(c)) > 0, F.lit(False))


def preview(c: Column, lines: int = 2) -> Column:
    """The first lines; trailing line breaks don't count; '' for null."""
    return F.coalesce(F.substring_index(F.regexp_replace(c, "\n+$", ""), "\n", lines), F.lit(""))


def excerpt(c: Column, n: int = 30) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def display_name(press: Column, login: Column) -> Column:
    """The press company if it has text, else the login, else ''."""
    return F.coalesce(F.when(has_text(press), press), login, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip_control(F.regexp_replace(c, r"\s+", " "))


def is_non_article(title: Column, summary: Column) -> Column:
    """Whether title and summary mark a notice; nulls count as ''."""
    merged = strip_control(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    packed = F.regexp_replace(F.lower(merged), r"\s+", "")
    words = [packed.contains("".join(w.lower().split())) for w in NON_ARTICLE_WORDS]
    return reduce(or_, words + [merged.rlike(p) for p in NON_ARTICLE_PATTERNS])


def is_ad_category(category: Column) -> Column:
    """Whether the category names advertising; null does not."""
    return F.coalesce(category.rlike("|".join(AD_CATEGORY_WORDS)), F.lit(False))


def digit_share(c: Column) -> Column:
    """Share of decimal digits of any script."""
    return F.length(F.regexp_replace(c, r"[^\p{Nd}]", "")) / F.greatest(F.length(c), F.lit(1))


def is_probable_title(t: Column, size: Column, median: Column) -> Column:
    """Whether a line reads and is set like a headline."""
    n = F.length(t)
    bad = reduce(or_, [t.contains(w) for w in TITLE_BAD_WORDS])
    return (n >= 3) & (n <= 80) & (size >= F.greatest(median * 1.38, F.lit(12.5))) & ~((n < 20) & bad) & (digit_share(t) <= 0.35) & ~t.rlike(PAGE_HEADER) & ~t.rlike("^[▶▷]")


def strip_page_number(c: Column) -> Column:
    """Without a page number at either end."""
    return strip_control(F.regexp_replace(c, PAGE_NUMBER, ""))


def continued_on(c: Column) -> Column:
    """The page an article goes on, or null."""
    got = F.regexp_extract(c, CONTINUED, 1)
    return F.when(got != "", got).try_cast("int")


def category_image(category: Column) -> Column:
    """Image path of a category; unknown and null have the placeholder."""
    pairs = [F.lit(x) for kv in CATEGORY_IMAGES.items() for x in kv]
    name = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(category, F.lit(""))), F.lit("placeholder"))
    return F.concat(F.lit("ai-images/"), name, F.lit(".png"))


def article_banner(number: Column, page: Column, article: Column, title: Column, text: Column) -> Column:
    """An article under its banner, as issues hold it."""
    line = F.lit(BANNER_LINE + "\n")
    head = F.format_string("[기사 %d] 페이지 %d | %s\n", number, page, article)
    return F.concat(line, head, line, F.lit("제목: "), strip_control(title), F.lit("\n\n"), strip_control(text), F.lit("\n\n\n"))


def absolute_url(href: Column, base: str) -> Column:
    """/path and http links as they are meant, anything else below /news/."""
    return F.when(href.startswith("/"), F.concat(F.lit(base), href)).when(href.startswith("http"), href).otherwise(F.concat(F.lit(base + "/news/"), href))


def progress(start: int, end: int, done: Column, total: Column) -> Column:
    """Percent between two steps; null where total isn't positive."""
    bounded = F.greatest(F.lit(0), F.least(done, total))
    return F.when(total > 0, F.lit(start) + F.floor(bounded * F.lit(max(1, end - start) - 1) / total)).cast("bigint")


def policy_time(s: Column, otherwise: Column | None = None) -> Column:
    """MM/dd/yyyy HH:mm:ss of Seoul as an instant; what can't be read is ``otherwise`` (now)."""
    local = F.try_to_timestamp(s, F.lit("MM/dd/yyyy HH:mm:ss"))
    return F.coalesce(F.to_utc_timestamp(local, "Asia/Seoul"), F.current_timestamp() if otherwise is None else otherwise)


def final_key(paper_id: Column, now: Column) -> Column:
    """Storage key of an issue: the Seoul date and the id."""
    return F.concat(F.lit("paper/"), F.date_format(F.from_utc_timestamp(now, "Asia/Seoul"), "yyyyMMdd"), F.lit("("), paper_id.cast("string"), F.lit(").pdf"))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))
