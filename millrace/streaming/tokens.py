"""Streams: repository scans that end themselves, and token chunks of running requests with timers."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATENCIES = "request_id long, chunks long, ttft double, last_gap double, latency double, done boolean"
#: Milliseconds for which a request waits for its next chunk, and for late ones once it has ended.
IDLE_MS, GRACE_MS = 3_600_000, 60_000
DONE = "[DONE]"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scan_stream(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``each`` on every micro-batch of new Parquet files of ``folder``; the started query."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_until_full(spark: SparkSession, folder: str, schema: str, bucket: Column, order_col: str, quota: int, n_buckets: int, state: str, checkpoint: str, files_at_once: int = 1):
    """Scan new Parquet files of ``folder``, a few in each micro-batch, until every one of ``n_buckets`` buckets has ``quota`` rows; the started query, which then ends itself.

    Files have to come in order of the column ``order_col``, which is unique and not null. The state is a table for each micro-batch below ``state``:
    for each bucket its first rows, ``quota`` at most, and how many rows came so far. A micro-batch that is run again writes its table again, so a
    query that was lost goes on from its checkpoint. :func:`stop_ordinal` has the result, that of ``repos.scan_stop`` over all rows.
    """
    started = threading.Event()
    order = Window.partitionBy("bucket").orderBy("at")

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.select(bucket.alias("bucket"), F.col(order_col).alias("at"))
        before = spark.read.parquet(f"{state}/batch={number - 1}") if number else None
        came = before.agg(F.max("came")).first()[0] if number else 0
        kept = rows.where("bucket is not null")
        kept = kept.unionByName(before.where("bucket is not null").select("bucket", "at")) if number else kept
        first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).drop("rank")
        count = rows.agg((F.count("*") + came).alias("came")).select(F.lit(None).cast(kept.schema["bucket"].dataType).alias("bucket"), F.lit(None).cast(kept.schema["at"].dataType).alias("at"), "came")
        first.withColumn("came", F.lit(None).cast("long")).unionByName(count).write.mode("overwrite").parquet(f"{state}/batch={number}")
        now = spark.read.parquet(f"{state}/batch={number}").where("bucket is not null")
        full = now.groupBy("bucket").agg(F.count("*").alias("n"), F.max("at").alias("last")).where(F.col("n") >= quota)
        buckets, stop = full.agg(F.count("*"), F.max("last")).first()
        if buckets >= n_buckets:
            rows.agg((F.count_if(F.col("at") <= stop) + came).alias("stop_ordinal")).write.mode("overwrite").parquet(f"{state}/stop")
            # Not from here: the query waits for this micro-batch.
            threading.Thread(target=lambda: started.wait() and query.stop(), daemon=True).start()

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    started.set()
    return query


def stop_ordinal(spark: SparkSession, state: str) -> int:
    """Rows that :func:`scan_until_full` took, up to where all buckets were full."""
    return spark.read.parquet(f"{state}/stop").first()[0]


class Latencies(StatefulProcessor):
    """Keeps a request's chunks by place, and what its latencies need: a row of numbers."""

    def __init__(self, idle_ms: int = IDLE_MS, grace_ms: int = GRACE_MS) -> None:
        self.idle_ms, self.grace_ms = idle_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq long", "ts double", self.idle_ms + self.grace_ms)
        self.request = handle.getValueState("request", "start double, done long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, done, timer = self.request.get() if self.request.exists() else (None, None, None)
        for batch in rows:
            for row in batch.itertuples():
                start = row.start_ts if start is None else min(start, row.start_ts)
                if row.text == DONE:
                    done = row.seq if done is None else min(done, row.seq)
                elif not self.chunks.containsKey((row.seq,)):
                    self.chunks.updateValue((row.seq,), (row.ts,))
        placed = sorted((seq, ts) for (seq,), (ts,) in self.chunks.iterator() if done is None or seq < done)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + (self.idle_ms if done is None else self.grace_ms)
        self.handle.registerTimer(timer)
        self.request.update((start, done, timer))
        times = [ts for _, ts in placed]
        gap = times[-1] - (times[-2] if len(times) > 1 else start) if times else None
        row = {"request_id": key[0], "chunks": len(times), "ttft": times[0] - start if times else None, "last_gap": gap, "latency": max(times) - start if times else None, "done": done is not None}
        yield pd.DataFrame([row])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chunks.clear()
        self.request.clear()
        yield pd.DataFrame({c: pd.Series([], dtype=object) for c in ("request_id", "chunks", "ttft", "last_gap", "latency", "done")})

    def close(self) -> None:
        pass


def running_latencies(chunks: DataFrame, idle_ms: int = IDLE_MS, grace_ms: int = GRACE_MS) -> DataFrame:
    """Per micro-batch and request of ``(request_id, start_ts, seq, ts, text)``: chunks so far, time to the first, last gap, latency.

    Chunks are taken in order of ``seq``, whatever micro-batch brings them: late ones find their place, repeated ones count once (the
    first to come holds), and none from the least ``[DONE]`` on counts. A timer forgets a request ``grace_ms`` after it ended, or ``idle_ms``
    after its last chunk; chunks that come later still begin it anew. State keeps a number for each chunk of the running requests,
    with a time to live besides, in RocksDB, which the session is set to. The query looks after its timers until it is stopped.
    """
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return chunks.groupBy("request_id").transformWithStateInPandas(Latencies(idle_ms, grace_ms), LATENCIES, "update", "processingTime")
