"""Session versions against a replay of all batches."""

import random
from collections import Counter

import duckdb
import pytest

from millrace.llm import sessions as S

COLUMNS = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]


def replay(events, gap):
    versions = []
    for user in {e[0] for e in events}:
        own, standing = [e[1:] for e in events if e[0] == user], []
        for batch in sorted({b for _, b, _ in own}):
            groups = []
            for e in sorted(x for x in own if x[1] <= batch):
                if groups and e[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                fresh = sum(b == batch for _, b, _ in g)
                if fresh:
                    v = [user, batch, g[0][0], g[-1][0], len(g), fresh, 0, sum(h for *_, h in g), None, None]
                    for w in [w for w in standing if v[2] <= w[2] <= v[3]]:
                        v[6] += 1
                        w[8:] = batch, v[2]
                        standing.remove(w)
                    standing.append(v)
                    versions.append(v)
    return Counter(map(tuple, versions))


def some_events():
    rng = random.Random(4)
    events = [(u, rng.randint(-2000, 6000) if u % 2 else rng.randint(0, 30_000), rng.randint(0, 40), rng.randint(0, 9)) for u in range(5) for _ in range(rng.choice([5, 60, 200]))]
    # A user of one session that is longer than many shards, which later batches put together from pieces.
    for k in range(1500):
        second = rng.randint(0, 40_000)
        events.append((9, second, second // 1800 + rng.choice([0, 0, 0, 1, 2, 3]), k))
    return events + events[:20]


@pytest.mark.parametrize("gap, shard, fan, chunk", [(60, 60, 8, 4096), (60, 100, 8, 7), (240, 3600, 16, 4096), (240, 600, 4, 3)])
def test_versions_equal_replay(spark, gap, shard, fan, chunk):
    events = some_events()
    df = spark.createDataFrame(events, "user long, second long, batch long, h long")
    assert Counter(map(tuple, S.session_versions(df, gap, shard, fan, chunk).select(COLUMNS).collect())) == replay(events, gap)


def test_edges(spark):
    schema = "user long, second long, batch long, h long, n string"
    rows = [(1, 5, 0, None, "x"), (1, 5, 0, 7, "y"), (None, 5, 0, 1, "z"), (1, None, 0, 1, "z"), (1, 5, None, 1, "z")]
    got = S.session_versions(spark.createDataFrame(rows, schema)).select(COLUMNS).collect()
    assert list(map(tuple, got)) == [(1, 0, 5, 5, 2, 2, 0, 7, None, None)]
    assert S.session_versions(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        S.session_versions(spark.createDataFrame([], schema), gap=10, shard_seconds=5)


def test_one_hot_user_leaves_one_shard_after_another(spark):
    """One user's events on one second collapse; shards and rounds never see more rows than seconds and batches."""
    df = spark.range(200_000).selectExpr("7L user", "id % 50 second", "id % 3 batch", "1L h")
    got = sorted(map(tuple, S.session_versions(df).select(COLUMNS).collect()))
    assert [g[:8] for g in got] == [(7, 0, 0, 49, 66_667, 66_667, 0, 66_667), (7, 1, 0, 49, 133_334, 66_667, 1, 133_334), (7, 2, 0, 49, 200_000, 66_666, 1, 200_000)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({S.OP11_SQL})").fetchall()
    assert Counter(map(tuple, S.op11_late_sessions(spark, sf).select(COLUMNS).collect())) == Counter(want)
