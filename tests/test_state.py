"""Reactions, keywords and vectors against plain Python."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from presswork.operators import emotions as em
from presswork.operators import keywords as kw
from presswork.operators import vectors as ve
from presswork.session import checked_join, stage
from presswork.streaming import live

LOG = "seq bigint, article_id bigint, user_identifier bigint, emotion_type string, ts timestamp_ntz"


def log_rows(n=400, seed=5):
    r = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    return [(i, r.randrange(3), r.randrange(4), r.choice(["view", "click", "error"]), base + dt.timedelta(seconds=r.randrange(200))) for i in range(n)]


def plain(rows):
    state, counts, answers = {}, {}, []
    for seq, a, u, e, _ in sorted(rows, key=lambda x: (x[4], x[0])):
        was = state.get((a, u))
        if was:
            counts[a, was] -= 1
        state[a, u] = None if was == e else e
        if state[a, u]:
            counts[a, e] = counts.get((a, e), 0) + 1
        answers.append((seq, bool(state[a, u]), counts.get((a, e), 0)))
    return {k: v for k, v in state.items() if v}, sorted(answers)


def test_toggle_is_the_fold(spark):
    rows = log_rows()
    d = spark.createDataFrame(rows, LOG)
    state, answers = plain(rows)
    assert {(r.article_id, r.user_identifier): r.emotion_type for r in em.final_states(d).collect()} == state
    assert sorted((r["seq"], r["on"], r["count"]) for r in em.responses(d).collect()) == answers


def test_state_folded_by_batches_is_the_whole(spark):
    rows = sorted(log_rows(), key=lambda x: (x[4], x[0]))
    prev = None
    for part in (rows[:150], rows[150:300], rows[300:]):
        prev = live.fold_reactions(prev, spark.createDataFrame(part, LOG))
    assert {(r.article_id, r.user_identifier): r.emotion_type for r in prev.collect()} == plain(rows)[0]


def test_daily_counts_are_whole_over_late_files(spark, tmp_path):
    """40 files of a day each, the last days first: three micro-batches."""
    from presswork.plans.state import QUERIES

    os.mkdir(tmp_path / "events.parquet")
    want = {}
    for n in range(40):
        day = dt.datetime(2024, 3, 1) - dt.timedelta(days=n // 2)
        kinds = ["view", "click", "view"] if n % 2 else ["view"]
        at = f"{tmp_path}/events.parquet/{n:02}.parquet"
        pq.write_table(pa.table({"event_id": [3 * n + i for i in range(len(kinds))], "user_id": [1] * len(kinds), "event_type": kinds, "props": pa.array(['{"k": 5}', "{}", None][: len(kinds)], pa.string()), "ts": pa.array([day + dt.timedelta(hours=i) for i in range(len(kinds))], pa.timestamp("us"))}), at)
        os.utime(at, (1_700_000_000 + n, 1_700_000_000 + n))
        for e in kinds:
            key = int((day - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000, e
            want[key] = want.get(key, 0) + 1
    got = QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()
    assert {(r.start_us, r.emotion_type): r.n for r in got} == want and len(got) == len(want)
    log = lambda d: d.withColumnRenamed("event_type", "emotion_type")
    late = live.available_now(live.windowed_counts(log(live.read_stream(spark, str(tmp_path), "events"))), "update", ["start", "emotion_type"])
    whole = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert live.left_out(whole, late) == sum(want.values()) - sum(r.n for r in late.collect()) > 0


def test_keywords(spark):
    names = spark.createDataFrame([(" 새말 ",), ("새말",), ("",), (None,), ("헌말",)], "name string")
    old = spark.createDataFrame([(7, "헌말")], "id bigint, name string")
    assert sorted((r.id, r.name) for r in kw.upserted(names, old).collect()) == [(7, "헌말"), (8, "새말")]
    links = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 7), (None, 7)], "article_id bigint, keyword_id bigint")
    upd = spark.createDataFrame([(1, []), (2, None), (3, ["헌말", "모름"])], "article_id bigint, names array<string>")
    assert sorted(tuple(r) for r in kw.replaced(links, upd, old).collect()) == [(2, 7), (3, 7)]


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8))
    v[10] = v[20]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0])]
    d = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {}
    for r in ve.nearest(d.filter("id % 50 = 0 and id < 300"), d.repartition(5), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q in range(0, 300, 50):
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        dist[q] = np.inf
        want = sorted(range(300), key=lambda i: (dist[i], i))[:3]
        assert [i for _, i in sorted(got[q])] == want
    assert ve.nearest(d.limit(0), d, 3).count() == 0


def test_nearest_settles_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 3, (2500, 4)).astype(float)
    v[rng.permutation(2500)[:900]] = v[50]  # a third of all are one vector
    rows = [(i, [float(x) for x in v[i]]) for i in rng.permutation(2500).tolist()]
    rows += [rows[0]] * 20 + [(i, x) for i, x in rows if i < 200] * 3 + [(7, [9.0, 9.0, 9.0, 9.0]), (8, [float("nan")] * 4)]
    d = spark.createDataFrame(rows, "id bigint, vector array<double>")
    q = spark.createDataFrame([(i, x) for i, x in rows[:2500] if i % 50 == 0], "id bigint, vector array<double>")
    for k, parts in ((3, 1), (12, 3)):
        got = {}
        for r in ve.nearest(q, d.repartition(parts), k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id))
        for i in range(0, 2500, 50):
            dist = np.sqrt(((v - v[i]) ** 2).sum(1))
            dist[i] = np.inf
            assert [x for _, x in sorted(got[i])] == sorted(range(2500), key=lambda j: (dist[j], j))[:k]


def test_checked_join_is_a_join_on_either_way(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        for limit in (0, 100):
            assert sorted(map(str, checked_join(left, right, ["k"], how, limit).collect())) == want


def test_the_driver_is_tidied_after_a_table_is_staged(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    before = sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    stage(spark.range(3), "three")
    assert sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()) > before
