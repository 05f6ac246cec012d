"""Streams over several micro-batches: chunks out of order, timers, and scans that end themselves."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import repos
from millrace.streaming import tokens

CHUNKS = "request_id long, start_ts double, seq long, ts double, text string"


def brute(chunks):
    start, done, seen = min(c[1] for c in chunks), None, {}
    for _, _, seq, ts, text in chunks:
        if text == tokens.DONE:
            done = seq if done is None else min(done, seq)
        else:
            seen.setdefault(seq, ts)
    times = [seen[s] for s in sorted(seen) if done is None or s < done]
    gap = times[-1] - (times[-2] if len(times) > 1 else start) if times else None
    return len(times), times[0] - start if times else None, gap, max(times) - start if times else None, done is not None


def run(out, tmp_path, feed):
    """What the query gives while each step, which returns the number of rows it adds, is fed to it as a micro-batch."""
    rows, seen, wanted = [], {}, 0

    def each(df, n):
        rows.extend(map(tuple, df.collect()))

    query = out.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for step in feed:
            wanted += step()
            end = time.time() + 60
            while sum(seen.values()) < wanted and time.time() < end and query.isActive:
                time.sleep(0.1)
                seen.update((p["batchId"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"])
            assert sum(seen.values()) == wanted, query.exception()
    finally:
        query.stop()
    return rows


@pytest.fixture
def chunks(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "in").mkdir()

    def put(rows):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return len(rows)

    rows = [(r, -1.0, s, s + r / 8, f"t{s}") for r in range(4) for s in range(12)] + [(r, -1.0, 9, 9.5, tokens.DONE) for r in (1, 2)]
    rng.shuffle(rows)
    rows += rows[:10]
    return rows, put


def test_late_repeated_and_unordered_chunks(spark, tmp_path, chunks):
    """After each micro-batch every request is as if its chunks so far had come in order and once."""
    rows, put = chunks
    out = tokens.running_latencies(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")))
    parts = [rows[:15], rows[15:40], rows[40:]]
    got = run(out, tmp_path, [lambda p=p: put(p) for p in parts])
    want, so_far = [], []
    for p in parts:
        so_far += p
        want += [(r, *brute([c for c in so_far if c[0] == r])) for r in sorted({c[0] for c in p})]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_timers_forget_requests(spark, tmp_path, chunks):
    """An ended request takes late chunks while its grace lasts, and begins anew afterwards."""
    _, put = chunks
    out = tokens.running_latencies(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")), grace_ms=2000)
    first = [(7, 0.0, 0, 1.0, "a"), (7, 0.0, 2, 3.0, tokens.DONE), (8, 0.0, 0, 1.0, "a")]
    got = run(out, tmp_path, [lambda: put(first), lambda: time.sleep(5) or put([(7, 5.0, 1, 6.0, "b"), (8, 0.0, 1, 2.0, "b")])])
    assert (7, 1, 1.0, 1.0, 1.0, True) in got and (7, 1, 1.0, 1.0, 1.0, False) in got and (8, 2, 1.0, 1.0, 2.0, False) in got


@pytest.mark.parametrize("quota", [3, 10])
def test_scan_ends_itself_where_the_batch_form_stops(spark, tmp_path, quota):
    rng = random.Random(quota)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "ordinal long, bucket int")
    for k in range(0, 200, 20):
        df.where(F.col("ordinal").between(k, k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    args = [spark, str(tmp_path / "in"), "ordinal long, bucket int", F.col("bucket"), "ordinal", quota, 3, str(tmp_path / "s"), str(tmp_path / "c")]
    query = tokens.scan_until_full(*args)
    assert query.awaitTermination(120)
    stop = repos.scan_stop(df, quota, 3).first()[0]
    assert tokens.stop_ordinal(spark, str(tmp_path / "s")) == stop
    batches = len(list((tmp_path / "s").glob("batch=*")))
    assert stop / 20 <= batches < 10
