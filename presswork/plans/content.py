"""Keyword, text-rule, publication and progress queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.operators import keywords as kw
from presswork.operators import publish as pb
from presswork.plans.base import Registry, Tables

R = Registry()
QUERIES, SQL = R.queries, R.sql

TRIM = r"regexp_replace(regexp_replace({c}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"
#: Words of titles, as an article's candidate keywords.
WORDS = r"(\p{L}{2,})"


def _title_words(t: Tables) -> DataFrame:
    return t.articles.select(F.col("id").alias("article_id"), F.explode(F.regexp_extract_all(F.lower("title"), F.lit(WORDS), F.lit(1))).alias("name"))


@R.add(r"""with w as (select distinct unnest(regexp_extract_all(lower(title), '(\p{L}{2,})', 1)) name from articles)
select name from w where name not in (select name from keywords where name is not null)""")
def q_keyword_new_names(t: Tables) -> DataFrame:
    return kw.new_names(_title_words(t).select("name"), t.keywords)


@R.add(r"""with w as (select distinct unnest(regexp_extract_all(lower(title), '(\p{L}{2,})', 1)) name from articles),
n as (select name from w where name not in (select name from keywords where name is not null)),
a as (select count(*) rows_after, max(id) m from keywords)
select a.rows_after + (select count(*) from n) rows_after, a.m + (select count(*) from n) max_id, a.rows_after + (select count(*) from n) distinct_ids from a""")
def q_keyword_dictionary(t: Tables) -> DataFrame:
    d = kw.upserted(_title_words(t).select("name"), t.keywords)
    return d.agg(F.count("*").alias("rows_after"), F.max("id").alias("max_id"), F.countDistinct("id").alias("distinct_ids"))


@R.add("""select distinct ak.article_id, ak.keyword_id, k.name from article_keywords ak join keywords k on k.id = ak.keyword_id where ak.article_id is not null""")
def q_keyword_mapping(t: Tables) -> DataFrame:
    return kw.mapping(t.article_keywords).join(t.keywords.select(F.col("id").alias("keyword_id"), "name"), "keyword_id").select("article_id", "keyword_id", "name")


def _updates(t: Tables) -> DataFrame:
    """Expired articles lose their keywords, those of lower-case status get new ones, others stay."""
    new = F.when(F.col("status") == "EXPIRED", F.array().cast("array<string>")).when(F.col("status") == "expired", F.array(F.lit(" 농기계 "), F.lit("과수원"), F.lit("")))
    return t.articles.select(F.col("id").alias("article_id"), new.alias("names"), F.when(F.col("status") == "EXPIRED", F.lit("내린 글")).alias("summary"))


@R.add("""select distinct ak.article_id, ak.keyword_id from article_keywords ak left join articles a on a.id = ak.article_id
where ak.article_id is not null and ak.keyword_id is not null and (a.status is null or a.status not in ('EXPIRED', 'expired'))
union all select a.id, k.id from articles a, (select name, min(id) id from keywords where name in ('농기계', '과수원') group by 1) k where a.status = 'expired'""")
def q_keyword_replace(t: Tables) -> DataFrame:
    return kw.replaced(t.article_keywords, _updates(t), t.keywords)


@R.add("""select distinct ak.article_id, ak.keyword_id, k.name from article_keywords ak join keywords k on k.id = ak.keyword_id left join articles a on a.id = ak.article_id
where ak.article_id is not null and (a.status is null or a.status <> 'EXPIRED') union all
select a.id, case n when '매출액' then (select min(id) from keywords where name = '매출액') else (select max(id) + 1 from keywords) end, n from articles a, unnest(['매출액', '전에 없던 말']) u(n) where a.status = 'EXPIRED'""")
def q_keyword_update(t: Tables) -> DataFrame:
    """Names that the dictionary lacks are created: here one, which gets the next id."""
    new = F.when(F.col("status") == "EXPIRED", F.array(F.lit(" 매출액 "), F.lit("전에 없던 말"), F.lit(" ")))
    dictionary, links = kw.created_and_replaced(t.article_keywords, t.articles.select(F.col("id").alias("article_id"), new.alias("names")), t.keywords)
    return links.join(dictionary.select(F.col("id").alias("keyword_id"), "name"), "keyword_id").select("article_id", "keyword_id", "name")


@R.add("select id, case when status = 'EXPIRED' then '내린 글' else summary end summary from articles")
def q_summary_update(t: Tables) -> DataFrame:
    return kw.updated_summaries(t.articles, _updates(t))


_WORDS_SQL = ", ".join(f"'{''.join(w.lower().split())}'" for w in tx.NON_ARTICLE_WORDS)


@R.add(rf"""with m as (select id, {TRIM.format(c="concat(coalesce(title, ''), ' ', coalesce(summary, ''))")} s from articles)
select id, coalesce((select bool_or(contains(regexp_replace(lower(s), '\s+', '', 'g'), w)) from unnest([{_WORDS_SQL}]) as u(w)), false)
or regexp_matches(s, '(?i)사\s*고\s*\(\s*社\s*告\s*\)') or regexp_matches(s, '^\s*알립니다\s*$') or regexp_matches(s, '^\s*주민\s*게시판\s*$') non_article from m""")
def q_non_article_filter(t: Tables) -> DataFrame:
    return t.articles.select("id", tx.is_non_article(F.col("title"), F.col("summary")).alias("non_article"))


@R.add("select id, coalesce(regexp_matches(sub_title, '광고|홍보|공고|채용|모집|입찰'), false) ad from policy")
def q_ad_category_filter(t: Tables) -> DataFrame:
    return t.policy.select("id", tx.is_ad_category(F.col("sub_title")).alias("ad"))


_IMG_SQL = " ".join(f"when '{k}' then 'ai-images/{v}.png'" for k, v in tx.CATEGORY_IMAGES.items())


@R.add(f"select subject, case title_ko {_IMG_SQL} else 'ai-images/placeholder.png' end image_path from subjects")
def q_category_image(t: Tables) -> DataFrame:
    return t.subjects.select("subject", tx.category_image(F.col("title_ko")).alias("image_path"))


_LINE = "repeat('=', 60) || chr(10)"


@R.add(f"""select id, {_LINE} || '[기사 ' || row_number() over (partition by paper_id order by id) || '] 페이지 1 | a' || id || chr(10) || {_LINE} || '제목: ' ||
{TRIM.format(c='title')} || chr(10) || chr(10) || {TRIM.format(c="coalesce(content, '')")} || chr(10) || chr(10) || chr(10) banner from articles where paper_id is not null""")
def q_banner_text(t: Tables) -> DataFrame:
    from presswork.operators.layout import numbered

    d = numbered(t.articles.filter("paper_id is not null"), ["paper_id"], ["id"])
    b = tx.article_banner(F.col("n"), F.lit(1), F.concat(F.lit("a"), F.col("id").cast("string")), F.col("title"), F.coalesce("content", F.lit("")))
    return d.select("id", b.alias("banner"))


_SEP = "repeat('=', 60)"


@R.add(rf"""with b as (select id paper_id, unnest(regexp_extract_all(content, '={{60}}\n\[기사 \d+\] 페이지 \d+ \| \S+\n={{60}}\n제목: [^\n]*')) h from papers)
select paper_id, cast(regexp_extract(h, '\[기사 (\d+)\]', 1) as bigint) n, cast(regexp_extract(h, '페이지 (\d+)', 1) as bigint) page, regexp_extract(h, '\| (\S+)', 1) article,
regexp_extract(h, '제목: ([^\n]*)', 1) title from b""")
def q_banner_split(t: Tables) -> DataFrame:
    return pb.banner_blocks(t.papers).select("paper_id", "n", "page", "article", "title")


@R.add("""with e as (select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events)
select event_id, cast(45 + (greatest(0, least(k, 99)) * 29) // 99 as bigint) chunking, cast(15 + (greatest(0, least(k, 99)) * 29) // 99 as bigint) reading,
cast(90 + (greatest(0, least(k, 99)) * 4) // 99 as bigint) related from e""")
def q_progress_percent(t: Tables) -> DataFrame:
    k, total = F.get_json_object("props", "$.k").cast("bigint"), F.lit(99)
    p = pb.PERCENT
    return t.events.select(
        "event_id",
        tx.progress(p["CHUNKING_AND_ANALYZING"], p["ANALYSIS_FINALIZING"], k, total).alias("chunking"),
        tx.progress(p["PDF_READING"], p["CHUNKING_AND_ANALYZING"], k, total).alias("reading"),
        tx.progress(p["FINDING_RELATED"], p["SAVING"], k, total).alias("related"),
    )


@R.add(" union all ".join(f"select '{s}' step, cast({p} as bigint) percent, '{m}' message" for s, p, m in pb.STEPS))
def q_progress_steps(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(pb.STEPS, "step string, percent bigint, message string")


def progress_log(t: Tables) -> DataFrame:
    """Events as progress snapshots: a job per user."""
    status = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "FAILED").otherwise("PROCESSING")
    return t.events.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"), F.get_json_object("props", "$.k").cast("bigint").alias("progress"))


@R.add("""with r as (select user_id job_id, event_type, cast(json_extract_string(props, '$.k') as bigint) progress, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
select job_id, case event_type when 'purchase' then 'DONE' when 'error' then 'FAILED' else 'PROCESSING' end status, progress from r where rn = 1""")
def q_progress_latest(t: Tables) -> DataFrame:
    return pb.latest_progress(progress_log(t)).select("job_id", "status", "progress")


@R.add("""select id, title, sub_title, minister_name, original_url link, strftime(registration_date at time zone 'UTC', '%m/%d/%Y %H:%M:%S') approve_date,
cast(floor(epoch(date_trunc('second', registration_date))) as bigint) - 32400 "seconds" from policy""")
def q_policy_mapping(t: Tables) -> DataFrame:
    d = t.policy.withColumn("approve_date", F.date_format("registration_date", "MM/dd/yyyy HH:mm:ss"))
    at = tx.policy_time(F.col("approve_date"), F.lit(None).cast("timestamp"))
    return d.select("id", "title", "sub_title", "minister_name", F.col("original_url").alias("link"), "approve_date", F.unix_seconds(at).alias("seconds"))


_STRIPPED = r"regexp_replace(title, '^\d{1,3}\s+|\s+\d{1,3}$', '', 'g')"


@R.add(f"select id, {TRIM.format(c=_STRIPPED)} title from articles")
def q_page_number_strip(t: Tables) -> DataFrame:
    return t.articles.select("id", tx.strip_page_number(F.col("title")).alias("title"))


@R.add(r"select id, try_cast(nullif(regexp_extract(content, '기사\s*(\d+)\s*면\s*이어짐', 1), '') as int) page, try_cast(nullif(regexp_extract(content || ' 기사 ' || id % 90 || ' 면 이어짐', '기사\s*(\d+)\s*면\s*이어짐', 1), '') as int) appended from articles")
def q_continuation_page(t: Tables) -> DataFrame:
    added = F.concat("content", F.lit(" 기사 "), (F.col("id") % 90).cast("string"), F.lit(" 면 이어짐"))
    return t.articles.select("id", tx.continued_on(F.col("content")).alias("page"), tx.continued_on(added).alias("appended"))


@R.add("select id, 'paper/20260329(' || id || ').pdf' key, '2026-03-29' batch_date from papers")
def q_final_key(t: Tables) -> DataFrame:
    now = F.lit("2026-03-28 16:00:00").cast("timestamp")
    return t.papers.select("id", tx.final_key(F.col("id"), now).alias("key"), F.date_format(F.from_utc_timestamp(now, "Asia/Seoul"), "yyyy-MM-dd").alias("batch_date"))


@R.add(rf"""with b as (select id paper_id, unnest(regexp_extract_all(content, '={{60}}\n\[기사 \d+\] 페이지 \d+ \| \S+\n={{60}}\n제목: [^\n]*')) h from papers)
select paper_id, count(*) articles from b group by 1""")
def q_publication_pipeline(t: Tables) -> DataFrame:
    """Issue text to chunks by the stand-in model; notices stay in so that SQL can count them."""
    return pb.analysed(pb.banner_blocks(t.papers)).groupBy("paper_id").agg(F.count("*").alias("articles"))


@R.add()
def q_publication_rows(t: Tables) -> DataFrame:
    return pb.article_rows(pb.analysed(pb.banner_blocks(t.papers)), 1).select("paper_id", "title", "summary", "link", "status", "image_path", "admin_id")
