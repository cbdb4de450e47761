"""Search, detail and finder queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.functions import text as tx
from presswork.operators import detail, search
from presswork.operators import vectors as ve
from presswork.operators.emotions import emotion_log, final_states
from presswork.plans.base import TOGGLED, Registry, Tables
from presswork.session import stage

R = Registry()
QUERIES, SQL = R.queries, R.sql

MATCH = """(strftime(p.published_date, '%Y-%m') like '%{q}%' or lower(p.title) like '%{q}%'
  or exists (select 1 from articles a where a.paper_id = p.id and a.status = 'ACTIVE' and lower(a.title) like '%{q}%'))"""
PREVIEW = r"array_to_string((string_split(regexp_replace(coalesce({c}, ''), '\n+$', ''), chr(10)))[1:2], chr(10))"
NAME = r"coalesce(case when length(regexp_replace(regexp_replace({p}, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')) > 0 then {p} end, {l}, '')"
DATE = "strftime({d}, '%Y-%m-%d')"


def _date(c: str = "published_date") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


@R.add(f"""select p.id, {DATE.format(d='p.published_date')} published_date, p.title, {PREVIEW.format(c='p.content')} preview, {NAME.format(p='m.press_company', l='m.login_id')} admin_name
from papers p left join admins m on p.admin_id = m.id where p.status = 'ACTIVE' and coalesce({MATCH.format(q='신문')}, false)""")
def q_publication_search(t: Tables) -> DataFrame:
    hits = search.publications(t.papers, t.articles, q="신문")
    return search.summaries(hits, t.admins).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


@R.add(f"select count(*) total from papers p where p.status = 'ACTIVE' and coalesce({MATCH.format(q='2023')}, false)")
def q_publication_search_total(t: Tables) -> DataFrame:
    return search.publications(t.papers, t.articles, q="2023").agg(F.count("*").alias("total"))


@R.add(f"""select p.id, p.title from papers p where p.status = 'ACTIVE' and coalesce({MATCH.format(q='2023-05')} or (p.published_date >= date '2023-05-01' and p.published_date < date '2023-06-01'), false)""")
def q_publication_search_by_month_text(t: Tables) -> DataFrame:
    return search.publications(t.papers, t.articles, q="2023-05").select("id", "title")


@R.add(f"""select p.id, {DATE.format(d='p.published_date')} published_date from papers p where p.admin_id = 4 and p.status = 'ACTIVE' and published_date >= date '2024-01-01' and published_date < date '2024-02-01'""")
def q_publication_month_filter(t: Tables) -> DataFrame:
    return search.publications(t.papers, t.articles, admin_id=4, month="2024-01").select("id", _date())


@R.add(f"select id, {DATE.format(d='published_date')} published_date, title from papers order by published_date desc nulls first, id limit 10 offset 10")
def q_publication_page(t: Tables) -> DataFrame:
    return search.page(t.papers.select("id", "published_date", "title"), search.newest_first(), 2).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


@R.add("""with kw as (select distinct ak.article_id, k.name from article_keywords ak join keywords k on k.id = ak.keyword_id where k.name is not null),
l as (select article_id, string_agg(name, '|' order by encode(name)) keywords from kw group by 1)
select a.paper_id, a.id article_id, a.title, a.summary, a.image_path, coalesce(l.keywords, '') keywords from articles a left join l on l.article_id = a.id
where a.status = 'ACTIVE' and a.paper_id in (select id from papers)""")
def q_publication_detail(t: Tables) -> DataFrame:
    return detail.publication_articles(t.papers, t.articles, t.article_keywords, t.keywords)


@R.add(f"""with a as (select paper_id, count(*) n, string_agg(coalesce(title, ''), '|' order by id) titles from articles where paper_id is not null group by 1)
select p.id paper_id, {DATE.format(d='p.published_date')} published_date, coalesce(a.n, 0) article_count, coalesce(a.titles, '') titles from papers p left join a on a.paper_id = p.id""")
def q_issue_articles(t: Tables) -> DataFrame:
    return detail.issue_articles(t.papers, t.articles).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


@R.add(f"""select a.id, a.title, a.summary, a.reporter, a.image_path, a.paper_id, a.admin_id, p.title paper_title, {DATE.format(d='p.published_date')} published_date, m.press_company
from articles a join papers p on a.paper_id = p.id join admins m on a.admin_id = m.id""")
def q_article_detail(t: Tables) -> DataFrame:
    return detail.article_base(t.articles, t.papers, t.admins).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


_KINDS = ["click", "error", "purchase", "signup", "view"]
USER = 42


@R.add(f"""{TOGGLED}, st as (select article_id, user_identifier, emotion_type from t where back = 1 and is_on),
s as (select article_id, {', '.join(f"count(*) filter (emotion_type = '{k}') n_{k}" for k in _KINDS)}, count(*) n_total from st group by 1),
kw as (select distinct ak.article_id, k.name from article_keywords ak join keywords k on k.id = ak.keyword_id where k.name is not null),
l as (select article_id, string_agg(name, '|' order by encode(name)) keywords, count(*) n from kw group by 1),
v as (select vec_id + 1 id, embedding::double[] e from embeddings), q as (select * from v where id % 50 = 0),
nd as (select q.id query_id, v.id, list_distance(q.e, v.e) distance, q.id = v.id self from q, v),
na as (select query_id, id, row_number() over (partition by query_id order by distance, id) rank from nd where not self),
np as (select query_id, id, row_number() over (partition by query_id order by distance, id) rank from nd),
ra as (select query_id, string_agg(cast(id as varchar), '|' order by rank) ids from na where rank <= 3 and id in (select id from articles) group by 1),
rp as (select query_id, string_agg(cast(id as varchar), '|' order by rank) ids from np where rank <= 3 and id in (select id from policy) group by 1)
select a.id, a.title, a.summary, a.reporter, a.image_path, a.paper_id, a.admin_id, p.title paper_title, {DATE.format(d='p.published_date')} published_date, m.press_company,
{', '.join(f'coalesce(s.n_{k}, 0) n_{k}' for k in _KINDS)}, coalesce(s.n_total, 0) n_total, coalesce(l.keywords, '') keywords, coalesce(l.n, 0) n_keywords,
coalesce(ra.ids, '') related, coalesce(rp.ids, '') policies, own.emotion_type my_emotion
from articles a join papers p on a.paper_id = p.id join admins m on a.admin_id = m.id left join s on s.article_id = a.id left join l on l.article_id = a.id
left join ra on ra.query_id = a.id left join rp on rp.query_id = a.id left join st own on own.article_id = a.id and own.user_identifier = {USER}""")
def q_article_detail_full(t: Tables) -> DataFrame:
    vectors = t.embeddings.select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter(F.col("id") % 50 == 0)
    near = ve.related(ve.nearest(asked, vectors, 3), t.articles)
    policies = ve.related(ve.nearest(asked, vectors, 3, exclude_self=False), t.policy)
    states = stage(final_states(emotion_log(t.events)), "states")
    d = detail.article_detail(t.articles, t.papers, t.admins, states, t.article_keywords, t.keywords, near, policies, USER)
    return d.withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


@R.add(f"""with h as (select p.* from papers p where p.admin_id = 4 and p.status = 'ACTIVE' and coalesce({MATCH.format(q='20')}, false))
select h.id, {DATE.format(d='h.published_date')} published_date, h.title, {PREVIEW.format(c='h.content')} preview, {NAME.format(p='m.press_company', l='m.login_id')} admin_name, (select count(*) from h) total
from h left join admins m on h.admin_id = m.id order by h.published_date desc nulls first, h.id limit 3""")
def q_publication_list(t: Tables) -> DataFrame:
    return search.publication_list(t.papers, t.articles, t.admins, 4, q="20", size=3).withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd"))


@R.add("select a.id, a.title from articles a where not exists (select 1 from papers p, admins m where p.id = a.paper_id and m.id = a.admin_id)")
def q_articles_unlinked(t: Tables) -> DataFrame:
    return detail.unlinked(t.articles, t.papers, t.admins)


@R.add(f"select p.id, {NAME.format(p='m.press_company', l='m.login_id')} admin_name from papers p left join admins m on p.admin_id = m.id")
def q_admin_display_name(t: Tables) -> DataFrame:
    return search.summaries(t.papers, t.admins).select("id", "admin_name")


@R.add(f"select id, {PREVIEW.format(c='content')} preview, substring(content, 1, 30) excerpt from articles")
def q_body_preview(t: Tables) -> DataFrame:
    return t.articles.select("id", tx.preview(F.col("content")).alias("preview"), tx.excerpt(F.col("content")).alias("excerpt"))


@R.add("select id, title, status, epoch_us(created_at) created_us from reports where status = 'PENDING' order by created_at desc, id limit 10 offset 20")
def q_reports_page(t: Tables) -> DataFrame:
    d = search.page(search.reports(t.reports.select("id", "title", "status", "created_at"), "PENDING"), [F.col("created_at").desc(), F.col("id")], 3)
    return d.select("id", "title", "status", F.unix_micros("created_at").alias("created_us"))


@R.add("select status, count(*) n from (select * from reports where length(trim(coalesce(title, ''))) > 0) group by 1")
def q_reports_total(t: Tables) -> DataFrame:
    return search.reports(t.reports, " ").filter(tx.has_text(F.col("title"))).groupBy("status").agg(F.count("*").alias("n"))


@R.add("""select 'admin_status' finder, cast(id as varchar) k from admins where status = 'ACTIVE'
union all select 'article_status', cast(id as varchar) from articles where status = 'EXPIRED'
union all select 'paper_status', cast(id as varchar) from papers where status = 'ACTIVE'
union all select 'policy_status', cast(id as varchar) from policy where status = 'ACTIVE'
union all select 'login', cast(id as varchar) from admins where login_id = 'nuri_desk'
union all select 'paper_articles', cast(id as varchar) from articles where paper_id = 7
union all select 'admin_articles', cast(id as varchar) from articles where admin_id = 3
union all select 'reporter', cast(id as varchar) from articles where reporter = '송겨울'
union all select 'published', cast(id as varchar) from papers where published_date = date '2022-11-29'
union all select 'minister', cast(id as varchar) from policy where minister_name = '생활행정부'
union all select 'keyword', cast(id as varchar) from keywords where name = '매출액'
union all select 'paper_and_status', cast(id as varchar) from articles where paper_id = 7 and status = 'ACTIVE'
union all select 'ids', cast(id as varchar) from articles where id in (3, 5, 8, 13)
union all select 'not_self', cast(id as varchar) from admins where id <> 4
union all select 'link_exists', cast(count(*) > 0 as varchar) from articles where link like 'http%'
union all select 'policy_link_exists', cast(count(*) > 0 as varchar) from policy where original_url = 'https://nowhere.example/'""")
def q_finder_suite(t: Tables) -> DataFrame:
    c = F.col
    by_id = [
        ("admin_status", t.admins.filter(c("status") == "ACTIVE")),
        ("article_status", t.articles.filter(c("status") == "EXPIRED")),
        ("paper_status", t.papers.filter(c("status") == "ACTIVE")),
        ("policy_status", t.policy.filter(c("status") == "ACTIVE")),
        ("login", t.admins.filter(c("login_id") == "nuri_desk")),
        ("paper_articles", t.articles.filter(c("paper_id") == 7)),
        ("admin_articles", t.articles.filter(c("admin_id") == 3)),
        ("reporter", t.articles.filter(c("reporter") == "송겨울")),
        ("published", t.papers.filter(c("published_date") == F.lit("2022-11-29").cast("date"))),
        ("minister", t.policy.filter(c("minister_name") == "생활행정부")),
        ("keyword", t.keywords.filter(c("name") == "매출액")),
        ("paper_and_status", t.articles.filter((c("paper_id") == 7) & (c("status") == "ACTIVE"))),
        ("ids", t.articles.filter(c("id").isin(3, 5, 8, 13))),
        ("not_self", t.admins.filter(c("id") != 4)),
    ]
    parts = [d.select(F.lit(n).alias("finder"), c("id").cast("string").alias("k")) for n, d in by_id]
    there = [("link_exists", t.articles.filter(c("link").startswith("http"))), ("policy_link_exists", t.policy.filter(c("original_url") == "https://nowhere.example/"))]
    parts += [d.limit(1).agg((F.count("*") > 0).cast("string").alias("k")).select(F.lit(n).alias("finder"), "k") for n, d in there]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add("""select 'article_keywords' what, count(*) n from (select article_id, keyword_id from article_keywords group by 1, 2 having count(*) > 1)
union all select 'keywords', count(*) from (select name from keywords group by 1 having count(*) > 1)
union all select 'articles.paper_id', count(*) from articles where paper_id is not null and paper_id not in (select id from papers)
union all select 'article_keywords.keyword_id', count(*) from article_keywords where keyword_id is not null and keyword_id not in (select id from keywords)""")
def q_constraint_report(t: Tables) -> DataFrame:
    from presswork.operators import publish as pb

    parts = [
        ("article_keywords", pb.duplicates(t.article_keywords, ["article_id", "keyword_id"])),
        ("keywords", pb.duplicates(t.keywords, ["name"])),
        ("articles.paper_id", pb.orphans(t.articles.select("id", "paper_id"), "paper_id", t.papers)),
        ("article_keywords.keyword_id", pb.orphans(t.article_keywords, "keyword_id", t.keywords)),
    ]
    got = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, d in parts]
    return got[0].unionByName(got[1]).unionByName(got[2]).unionByName(got[3])


@R.add("""select 'kept_links' what, count(*) n from article_keywords ak where ak.article_id not in (select id from articles where status = 'EXPIRED')
union all select 'nulled_papers', count(*) from articles a where paper_id is null or paper_id in (select id from papers where status = 'EXPIRED')""")
def q_foreign_key_actions(t: Tables) -> DataFrame:
    from presswork.operators import publish as pb

    links = pb.cascade(t.article_keywords, "article_id", t.articles.filter("status = 'EXPIRED'"))
    nulled = pb.set_null(t.articles.select("id", "paper_id"), "paper_id", t.papers.filter("status = 'EXPIRED'")).filter("paper_id is null")
    return links.agg(F.count("*").alias("n")).select(F.lit("kept_links").alias("what"), "n").unionByName(nulled.agg(F.count("*").alias("n")).select(F.lit("nulled_papers").alias("what"), "n"))
