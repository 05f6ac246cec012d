"""Sources: problem and sample files, source trees, blobs, metric pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from millrace.functions import text as T

COMPLETION_PROBLEMS = "prompt string, groundtruth string, right_context string"
INFILLING_PROBLEMS = "task_id string, prompt string, suffix string, canonical_solution string, test string, entry_point string"
SAMPLES = "repo_name string, path string, content string, content_length int, total_length int, cfc_contexts array<struct<path: string, text: string, length: int>>"
REPOS = "repo_name string, gha_language string, star_events_count bigint, fork_events_count bigint, files array<struct<path: string, length_bytes: bigint, language: string, is_vendor: boolean, is_generated: boolean, max_line_length: bigint, alphanum_fraction: double, blob_id: string, src_encoding: string>>"

# The evaluation sets' names and files.
BENCHMARKS = {
    "cceval-python": ("cceval_python_line_completion.jsonl", COMPLETION_PROBLEMS),
    "humaneval-single-line": ("HumanEval-SingleLineInfilling.jsonl.gz", INFILLING_PROBLEMS),
    "humaneval-multi-line": ("HumanEval-MultiLineInfilling.jsonl.gz", INFILLING_PROBLEMS),
    "humaneval-span": ("HumanEval-RandomSpanInfilling.jsonl.gz", INFILLING_PROBLEMS),
    "humaneval-span-light": ("HumanEval-RandomSpanInfillingLight.jsonl.gz", INFILLING_PROBLEMS),
}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | st.StructType, strict: bool = False) -> DataFrame:
    """JSON lines, gzip or plain; blank lines are skipped, malformed ones dropped, or, if ``strict``, an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_benchmark(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in BENCHMARKS:
        raise ValueError(f"unknown benchmark {name}; one of {sorted(BENCHMARKS)}")
    file, schema = BENCHMARKS[name]
    return read_jsonl(spark, f"{folder.rstrip('/')}/{file}", schema, strict=True)


def read_source_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """``repo_name, path, content, length_bytes`` of every matching file of the repositories below ``root``; bytes that are not UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    parts = F.split(below, "/", 2)
    text = valid_text(F.col("content"))
    return files.select(parts[0].alias("repo_name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("path"), text.alias("content"), F.col("length").alias("length_bytes"))


def valid_text(content: Column) -> Column:
    """Bytes as text without those that are not UTF-8; replacement characters that are there already stay."""
    out = content.cast("string")
    # What marks broken bytes below is spelled otherwise meanwhile, by a code of two non-characters.
    for plain, code in (("\ufdd0", "\ufdd0\ufdd1"), ("\ufffd", "\ufdd0\ufdd2")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    out = F.replace(F.make_valid_utf8(out), F.lit("\ufffd"), F.lit(""))
    for plain, code in (("\ufffd", "\ufdd0\ufdd2"), ("\ufdd0", "\ufdd0\ufdd1")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def _quoted(path: str) -> str:
    import re

    return re.escape(re.sub(r"^[a-z]+:/*", "/", path))


def repo_files(repos: DataFrame) -> DataFrame:
    """One row per file of repository records; records without a name or files are left out."""
    ok = repos.where((F.coalesce("repo_name", F.lit("")) != "") & (F.size("files") > 0))
    return ok.select("repo_name", "gha_language", F.col("star_events_count").alias("stars"), F.col("fork_events_count").alias("forks"), F.inline("files"))


def scan_repos(repos: DataFrame, scan_max: int = 300_000, seed: int | None = None, ordinal_col: str | None = None) -> DataFrame:
    """The first ``scan_max`` records by ``ordinal_col``, or by a hash of name and ``seed``."""
    order = F.col(ordinal_col) if ordinal_col else F.xxhash64("repo_name", F.lit(seed or 0))
    return repos.orderBy(order).limit(scan_max)


def gunzip_blobs(blobs: DataFrame, max_kb: int = 4096) -> DataFrame:
    """``blobs`` with ``content`` unpacked; what is no gzip or is larger than ``max_kb`` unpacked becomes null."""
    import zlib

    place, names, most = blobs.columns.index("content"), blobs.columns, max_kb * 1024

    def unpack(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        try:
            one = zlib.decompressobj(31)
            out = one.decompress(raw, most + 1)
        except zlib.error:
            return None
        return out if len(out) <= most and one.eof else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([unpack(x) for x in batch.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return blobs.mapInArrow(run, blobs.schema)


def valid_blobs(blobs: DataFrame, max_kb: int = 4096) -> DataFrame:
    """Blobs that are not empty, not too large, without a NUL byte and readable as ``src_encoding`` (UTF-8 if missing), with their ``text``.

    Other encodings that the JVM knows are decoded by it; there, bytes without a meaning become U+FFFD, and such blobs are left out.
    """
    size = F.octet_length("content")
    ok = blobs.where(size.between(1, max_kb * 1024) & (F.locate("\0", F.col("content").cast("string")) == 0))
    name = F.lower(F.coalesce("src_encoding", F.lit("utf-8")))
    known = {"utf-8": "UTF-8", "utf8": "UTF-8", "ascii": "US-ASCII", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
    text = F.lit(None).cast("string")
    for alias, charset in known.items():
        plain = F.col("content").cast("string")
        value = F.when(F.is_valid_utf8(plain), plain) if charset == "UTF-8" else F.when(F.is_valid_utf8(plain) & ~plain.rlike("[^\\x00-\\x7F]"), plain) if charset == "US-ASCII" else F.decode("content", charset)
        text = F.when(name == alias, value).otherwise(text)
    return ok.withColumn("text", text).where(F.col("text").isNotNull())


def read_metric_page(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a text exposition, a page of bounded size read whole."""
    page = spark.read.text(path, wholetext=True)
    return page.select(F.posexplode(T.split_lines(F.col("value"))).alias("line_no", "line"))
