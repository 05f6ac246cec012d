"""The engine's inputs as deterministic views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import config as C
from millrace.functions import text as T

#: Settings that suit repositories as small as those of the test tables.
SMALL = C.RepoConfig(min_core_files=2, max_single_mb=2.0)
BUCKETS = [(1000, 10_000, 20_000), (10_000, 50_000, 100_000), (50_000, 2_000_000, 4_000_000)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


#: Labels up to which every task gets them whole (some 100 MB); beyond that they meet the documents by hash.
BROADCAST_LABELS = 2_000_000


def repo_files(spark: SparkSession, sf_dir: str, with_content: bool = True) -> DataFrame:
    """A file per document; repositories are language and source, folders and suffixes go by the id.

    Labels are held and texts pass by: a join by sorting would hold the texts of a partition.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels.hint("shuffle_hash")
    files = documents(spark, sf_dir).join(labels, "doc_id", "left")
    step = F.floor(F.col("doc_id") / 20)
    folder = F.when(step % 4 == 0, "src").when(step % 4 == 1, "tests").when(step % 4 == 2, "docs").otherwise("pkg")
    lines = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    own = [
        F.col("doc_id"),
        F.concat("lang", F.lit("/"), "source").alias("repo_name"),
        F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), F.when(step % 5 == 0, ".md").otherwise(".py")).alias("path"),
        F.col("n_chars").alias("length_bytes"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_generated"),
        F.lit(False).alias("is_vendor"),
        F.lit(None).cast("string").alias("language"),
    ]
    content = [
        F.col("text").alias("content"),
        F.array_max(lines).cast("long").alias("max_line_length"),
        (F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("alphanum_fraction"),
    ]
    return files.select(*own, *(content if with_content else []))


def eligible() -> Column:
    return ~F.col("is_generated") & F.col("length_bytes").between(1, 2048 * 1024)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per event: its value is the latency in seconds, a fifth of it the time to the first token."""
    events = table(spark, sf_dir, "events")
    value = F.coalesce("value", F.lit(0.0))
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("mode"),
        "user_id",
        (F.col("event_type") != "error").alias("success"),
        value.alias("latency"),
        (value / 5).alias("ttft"),
        F.array(value / 10, value / 20, value / 40).alias("itl"),
        (F.col("event_id") % 100).alias("prompt_len"),
        (F.col("event_id") % 7).alias("output_len"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("completion_id"), "role", F.col("text").alias("completion"), (F.length("text") % 2 == 0).alias("passed"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, prefix, middle, suffix``: the texts in thirds."""
    text, third = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "lang", F.substring(text, F.lit(1), third).alias("prefix"), F.substring(text, third + 1, third).alias("middle"), F.substring(text, 2 * third + 1, F.length(text)).alias("suffix"))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the shape of source: every line after a sentence end becomes the body of a function."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.regexp_replace("text", r"\.\n", ".\ndef f():\n    ").alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per user, a chunk per event in order of id, at whole seconds of its timestamp."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("double").alias("ts"),
        F.lit(-1.0).alias("start_ts"),
        F.concat(F.lit("t"), (F.col("event_id") % 10).cast("string")).alias("text"),
    )


def tokens_hashed(text: Column) -> Column:
    """Stand-in ids of the default tokenizer's tokens: their lengths plus a thousand."""
    return F.transform(T.encode(text), lambda t: F.length(t) + 1000)
