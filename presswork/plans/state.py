"""Reaction, access-log, vector and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators import emotions as em
from presswork.operators import tracking as tr
from presswork.operators import vectors as ve
from presswork.plans.base import TOGGLED, Registry, Tables
from presswork.plans.content import progress_log
from presswork.streaming import live

R = Registry()
QUERIES, SQL = R.queries, R.sql

KINDS = em.EMOTIONS

@R.add(f"""{TOGGLED}, l as (select article_id, emotion_type from t where back = 1 and is_on)
select a.id article_id, {', '.join(f"count(*) filter (l.emotion_type = '{k}') n_{k}" for k in KINDS)}, count(l.emotion_type) n_total
from articles a left join l on l.article_id = a.id group by 1""")
def q_emotion_stats(t: Tables) -> DataFrame:
    return em.emotion_stats(t.articles, em.final_states(em.emotion_log(t.events)))


@R.add(f"{TOGGLED} select article_id, user_identifier, emotion_type from t where back = 1 and is_on")
def q_emotion_final_state(t: Tables) -> DataFrame:
    return em.final_states(em.emotion_log(t.events))


@R.add(f"""{TOGGLED}, d as (select seq, ts, article_id, emotion_type, case when is_on then 1 else -1 end delta, 1 own, is_on from t
union all select seq, ts, article_id, prev, -1, 0, is_on from t where prev <> emotion_type and prev_on),
s as (select *, sum(delta) over (partition by article_id, emotion_type order by ts, seq rows unbounded preceding) c from d)
select seq, article_id, is_on as "on", cast(c as bigint) count from s where own = 1""")
def q_emotion_responses(t: Tables) -> DataFrame:
    return em.responses(em.emotion_log(t.events))


@R.add(f"{TOGGLED} select article_id, emotion_type from t where back = 1 and is_on and user_identifier = 42")
def q_my_emotion(t: Tables) -> DataFrame:
    return em.own_emotion(em.final_states(em.emotion_log(t.events)), 42)


REQ = """with r as (select event_id seq, cast(user_id as varchar) uuid, ts,
case when event_type in ('view', 'click') then '/api/qr/' || json_extract_string(props, '$.k') when event_type = 'error' then '/actuator/health' else '/api/articles/' || json_extract_string(props, '$.k') end path,
row_number() over (partition by user_id order by ts, event_id) = 1 is_new_user from events)"""


@R.add(f"{REQ} select path, count(*) requests from r where not (path like '/actuator%' or path like '/favicon%' or path like '/static%') group by 1")
def q_path_counter(t: Tables) -> DataFrame:
    return tr.path_counts(tr.requests(t.events))


@R.add(f"{REQ} select count(*) filter (is_new_user) new_users from r where path like '/api/qr/%'")
def q_new_user_counter(t: Tables) -> DataFrame:
    return tr.new_users(tr.requests(t.events))


@R.add(f"{REQ} select seq, uuid, path, epoch_us(ts) access_us, is_new_user from r where path like '/api/qr/%'")
def q_access_log(t: Tables) -> DataFrame:
    d = tr.access_log(tr.requests(t.events))
    return d.select("seq", "uuid", "path", F.unix_micros(F.col("access_time").cast("timestamp")).alias("access_us"), "is_new_user")


ID = "00000000-0000-4000-8000-"


@R.add(f"""select event_id request_id, case when event_type in ('view', 'click') then '{ID}' || lpad(cast(user_id as varchar), 12, '0') end uuid, event_type = 'signup' is_new_user from events""")
def q_cookie_identity(t: Tables) -> DataFrame:
    own = F.concat(F.lit(ID), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    cookie = lambda v: F.struct(F.lit(tr.COOKIE).alias("name"), v.alias("value"))
    jar = F.when(F.col("event_type") == "signup", F.array().cast("array<struct<name:string,value:string>>")).when(F.col("event_type").isin("view", "click"), F.array(cookie(F.lit("x")), cookie(own))).otherwise(F.array(cookie(F.lit("broken"))))
    got = tr.identity(t.events.select(F.col("event_id").alias("request_id"), jar.alias("list"), "event_type"))
    # ids made anew differ each time: shown as null
    return got.select("request_id", F.when(F.col("uuid").startswith(ID), F.col("uuid")).alias("uuid"), "is_new_user")


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vector"))


def _queries(t: Tables) -> DataFrame:
    return _vectors(t).filter(F.col("id") % 50 == 0)


NEAR = """with v as (select vec_id + 1 id, embedding::double[] e from embeddings), q as (select * from v where id % 50 = 0),
d as (select q.id query_id, v.id, list_distance(q.e, v.e) distance from q, v {where}),
h as (select * from (select *, row_number() over (partition by query_id order by distance, id) rank from d) where rank <= 3)"""


@R.add(f"{NEAR.format(where='where q.id <> v.id')} select query_id article_id, h.id related_id, round(1.0 / (1.0 + distance), 6) score from h where h.id in (select id from articles)")
def q_related_articles_topk(t: Tables) -> DataFrame:
    hits = ve.nearest(_queries(t), _vectors(t), 3)
    return ve.related(hits, t.articles).withColumn("score", F.round("score", 6))


@R.add(f"{NEAR.format(where='')} select query_id article_id, h.id related_id, round(1.0 / (1.0 + distance), 6) score from h where h.id in (select id from policy)")
def q_related_policies_topk(t: Tables) -> DataFrame:
    hits = ve.nearest(_queries(t), _vectors(t), 3, exclude_self=False)
    return ve.related(hits, t.policy).withColumn("score", F.round("score", 6))


@R.add(f"""{NEAR.format(where='where q.id <> v.id')} select query_id article_id, h.id related_id, a.title, substring(a.content, 1, 30) excerpt, round(1.0 / (1.0 + distance), 6) score from h join articles a on a.id = h.id""")
def q_related_preview(t: Tables) -> DataFrame:
    from presswork.operators.detail import related_preview

    return related_preview(QUERIES["q_related_articles_topk"](t.spark, t.dir), t.articles)


@R.add(f"""{NEAR.format(where='')} select query_id article_id, h.id related_id, a.title, substring(a.content, 1, 30) excerpt, round(1.0 / (1.0 + distance), 6) score from h join policy a on a.id = h.id""")
def q_policy_preview(t: Tables) -> DataFrame:
    from presswork.operators.detail import related_preview

    return related_preview(QUERIES["q_related_policies_topk"](t.spark, t.dir), t.policy)


@R.add("""with v as (select vec_id + 1 id, embedding::double[] e from embeddings)
select v.id, round(list_distance(v.e, q.e), 6) distance from v, (select e from v where id = 1) q order by list_distance(v.e, q.e), v.id limit 3""")
def q_global_nearest3(t: Tables) -> DataFrame:
    target = _vectors(t).filter("id = 1").first()["vector"]
    return ve.nearest_to(_vectors(t), target, 3).withColumn("distance", F.round("distance", 6))


@R.add(f"""{NEAR.format(where='where q.id <> v.id')}, n as (select query_id article_id, h.id related_id, round(1.0 / (1.0 + distance), 6) score from h where h.id in (select id from articles))
select * from n union all select id, id, cast(0 as double) from articles where id not in (select article_id from n)""")
def q_related_replace(t: Tables) -> DataFrame:
    old = t.articles.select(F.col("id").alias("article_id"), F.col("id").alias("related_id"), F.lit(0.0).alias("score"))
    return ve.replace_related(old, QUERIES["q_related_articles_topk"](t.spark, t.dir))


@R.add(f"{TOGGLED} select article_id, user_identifier, emotion_type from t where back = 1 and is_on")
def stream_emotion_state(t: Tables) -> DataFrame:
    log = em.emotion_log(live.read_stream(t.spark, t.dir, "events"))
    return live.folded_now(log, live.fold_reactions)


@R.add(f"{REQ} select path, count(*) requests from r where path not like '/actuator%' group by 1")
def stream_path_counter(t: Tables) -> DataFrame:
    s = live.read_stream(t.spark, t.dir, "events")
    k = F.get_json_object("props", "$.k")
    path = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("/api/qr/"), k)).when(F.col("event_type") == "error", F.lit("/actuator/health")).otherwise(F.concat(F.lit("/api/articles/"), k))
    return live.available_now(tr.path_counts(s.select(path.alias("path"))), "complete")


@R.add("""with r as (select user_id job_id, event_type, cast(json_extract_string(props, '$.k') as bigint) progress, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events)
select job_id, case event_type when 'purchase' then 'DONE' when 'error' then 'FAILED' else 'PROCESSING' end status, progress from r where rn = 1""")
def stream_progress(t: Tables) -> DataFrame:
    class Streamed(Tables):
        events = live.read_stream(t.spark, t.dir, "events")

    return live.folded_now(progress_log(Streamed(t.spark, t.dir)), live.fold_progress).select("job_id", "status", "progress")


@R.add("select epoch_us(date_trunc('day', ts)) start_us, event_type emotion_type, count(*) n from events group by 1, 2")
def stream_daily_counts(t: Tables) -> DataFrame:
    got = live.folded_now(live.read_stream(t.spark, t.dir, "events"), live.fold_daily)
    return got.select(F.unix_micros("start").alias("start_us"), "emotion_type", "n")
