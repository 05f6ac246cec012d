"""Text expressions: lines, words, n-grams, paths, and the default tokenizer. All are native."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import materialise

#: What ends a line, as in str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: The default tokenizer's tokens: runs of ASCII letters, runs of digits, other characters one by one.
TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end begins no line, an empty text has none."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def word_ngrams(text: Column, n: int) -> Column:
    """Arrays of ``n`` words in a row; none if the text has fewer."""
    w = words(text)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))).otherwise(F.array().cast("array<array<string>>"))


def encode(text: Column) -> Column:
    """Token strings of the default tokenizer."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def truncate_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th token; unchanged if it has no more, empty for none."""
    whole = count_tokens(text) <= n
    # One pass: every token and what precedes it; the first n of them are the cut text.
    spans = F.regexp_extract_all(text, F.lit(rf"\s*(?:{TOKEN})"), F.lit(0))
    return F.when(whole, text).otherwise(F.array_join(F.slice(spans, 1, F.greatest(n, F.lit(0))), ""))


def head_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines, each ended by a newline (an empty text gives one newline)."""
    return F.concat(F.array_join(F.slice(split_lines(text), 1, n), "\n"), F.lit("\n"))


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def truncate_2dp(value: Column) -> Column:
    """Two decimals, cut toward zero."""
    return (value * 100).cast("long") / F.lit(100.0)


def sanitize_dirname(name: Column) -> Column:
    runs = F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")
    bare = F.regexp_replace(F.regexp_replace(runs, r"^[._-]+", ""), r"[._-]+$", "")
    return F.left(F.coalesce(F.nullif(bare, F.lit("")), F.lit("repo")), F.lit(180))


def safe_relpath(path: Column) -> Column:
    """Forward slashes, no leading slash, and ``__UP__`` for every ``..`` component."""
    bare = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^/+", "")
    return F.array_join(F.transform(F.split(bare, "/", -1), lambda p: F.when(p == "..", "__UP__").otherwise(p)), "/")


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``; unchanged if it is not below it."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def remove_prefix(text: Column, prefix: str) -> Column:
    return F.regexp_replace(text, "^" + re.escape(prefix), "")


def draw(key: Column, salt: int) -> Column:
    """A pseudo-random long below 2**31 from a non-negative id; the same in any order, and in SQL."""
    return (F.pmod(key, F.lit(2147483648)) * 1103515245 + 12345 + salt) % 2147483648


def uniform(key: Column, salt: int) -> Column:
    return draw(key, salt) / F.lit(2147483648.0)


def draw_between(key: Column, salt: int, low: Column, high: Column) -> Column:
    """A whole number from ``low`` to ``high``, both included; the low bits of a draw take no part."""
    return low + F.floor(draw(key, salt) / 65536) % (high - low + 1)


#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def _by_ranges(df: DataFrame, keys: list[str], parts: int | None) -> tuple[DataFrame, Column, Column]:
    """``df`` sorted by ranges, written and read back with ``__id``; and the range and the place in it that an id holds."""
    if parts is None:
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, df.count() // RANGE_ROWS))
    # The upper bits of the id are the range, the lower ones the place in it.
    placed = materialise(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    return placed, F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)


def _before(spark: SparkSession, counts: list[tuple[int, int]]) -> DataFrame:
    """``__part, __before``: what the ranges before each hold together, of pairs of a range and its count in order."""
    upto = accumulate(n for _, n in counts)
    return spark.createDataFrame([(k, at - n) for (k, n), at in zip(counts, upto)], "__part long, __before long")


def counted(df: DataFrame, order_col: str, holds: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` and ``name``: of how many rows up to and with this one, in order of a column, ``holds`` is true.

    By ranges as in :func:`numbered`; a running sum goes over one range.
    """
    placed, part, _ = _by_ranges(df, [order_col], parts)
    one = F.when(holds, 1).otherwise(0).cast("long")
    before = _before(df.sparkSession, sorted(map(tuple, placed.groupBy(part).agg(F.sum(one)).collect())))
    upto = F.sum(one).over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.withColumn("__part", part).withColumn("__upto", upto).join(F.broadcast(before), "__part")
    return rows.select(*df.columns, (F.col("__before") + F.col("__upto")).alias(name))


def numbered(df: DataFrame, by: list[str], order_col: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` and ``name``: the row's number from 0 within ``by`` in order of a column that is unique there.

    Rows are put in order by ranges of groups and column, which Spark samples, so a group of any size is spread over tasks;
    in each range a row has its place. The sorted table is written to shared storage, for all that follows to see the same ranges. The
    rows of the ranges before it, a sum of at most ``parts`` counts, give a row's number over all; less that of its group's first row it is
    the number wanted. Nothing is windowed by group.
    """
    placed, part, place = _by_ranges(df, [*by, order_col], parts)
    counts = sorted(map(tuple, placed.groupBy(part).count().collect()))
    before = _before(df.sparkSession, counts)
    overall = lambda rows, place: rows.join(F.broadcast(before), part == F.col("__part")).withColumn("__at", F.col("__before") + place).drop("__part", "__before")
    rows = overall(placed, place)
    if not by:
        return rows.select(*df.columns, F.col("__at").alias(name))
    # A table of its own, so that the join is of two plain shuffles and a large group can be split.
    firsts = materialise(overall(placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__id").alias("__id")), place).withColumnRenamed("__at", "__first").drop("__id"), "first_rows")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rows.join(firsts, same).select(*df.columns, (F.col("__at") - F.col("__first")).alias(name))
