"""Completion evaluation: matches, pass@k, latency statistics, reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

from millrace.functions import similarity as S
from millrace.functions import text as T
from millrace.sources.scratch import small_batches


def match_rates(pairs: DataFrame, by: list[str], truth: str = "groundtruth", prediction: str = "prediction", with_edit: bool = True) -> DataFrame:
    """Per group ``count``, ``em`` and ``es`` in percent."""
    if with_edit:
        small_batches(pairs.sparkSession)
    es = [F.avg(S.edit_similarity(F.col(truth), F.col(prediction))).alias("es")] if with_edit else []
    return pairs.groupBy(*by).agg(F.count("*").alias("count"), (100 * F.avg(S.exact_match(F.col(truth), F.col(prediction)))).alias("em"), *es)


def with_completion_ordinal(samples: DataFrame, order_col: str) -> DataFrame:
    """``completion_id`` from 0 within each task."""
    return samples.withColumn("completion_id", F.row_number().over(Window.partitionBy("task_id").orderBy(order_col)) - 1)


def pass_rate(n: Column, c: Column, k: int) -> Column:
    """Probability that ``k`` draws among ``n`` samples, ``c`` of them right, hold a right one."""
    wrong = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i))
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - wrong)


def task_pass(results: DataFrame, ks: list[int]) -> DataFrame:
    """Per task ``n``, ``c`` and ``pass_at_k`` for each ``k``."""
    sums = results.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("c"))
    return sums.select("*", *[pass_rate(F.col("n"), F.col("c"), k).alias(f"pass_at_{k}") for k in ks])


def pass_at_k(results: DataFrame, ks: list[int]) -> DataFrame:
    """One row of mean pass@k; null for a ``k`` that some task has too few samples for."""
    return task_pass(results, ks).agg(*[F.when(F.min("n") >= k, F.avg(f"pass_at_{k}")).alias(f"pass_at_{k}") for k in ks])


def problem_dictionary(problems: DataFrame, ordinal_col: str) -> DataFrame:
    """One row per ``task_id``: its last."""
    return problems.groupBy("task_id").agg(F.max_by(F.struct(*problems.columns), ordinal_col).alias("__row")).select("__row.*")


def join_problems(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """Samples with their problem's columns; a sample without a problem raises."""
    found = samples.join(problems.withColumn("__found", F.lit(True)), "task_id", "left")
    checked = F.when(F.col("__found"), True).otherwise(F.raise_error(F.concat(F.lit("no problem "), F.col("task_id").cast("string"))).cast("boolean"))
    return found.where(checked).drop("__found")


def unattempted(problems: DataFrame, samples: DataFrame) -> DataFrame:
    """Problems without a sample; full coverage leaves none."""
    return problems.join(samples.select("task_id").distinct(), "task_id", "left_anti")


def attach_results(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Samples with ``passed`` and ``result`` of their own completion."""
    return samples.join(results.select("task_id", "completion_id", "passed", "result"), ["task_id", "completion_id"], "left")


def check_program(prompt: Column, completion: Column, suffix: Column, test: Column, entry_point: Column) -> Column:
    return F.concat(prompt, completion, suffix, F.lit("\n"), test, F.lit("\n"), F.lit("check("), entry_point, F.lit(")"))


#: Buckets of the first histogram between a number and its double; cells of a range in the later ones.
OCTAVE, CELLS = 32, 1 << 14


def _bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises, and rises by ``OCTAVE`` where the value doubles."""
    # Exponents of a double lie between -1074 and 1024.
    size = F.floor((F.log2(F.least(F.abs(value), F.lit(1.7e308))) + 1075) * OCTAVE)
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value > 0, size + 1).when(value < 0, -size - 1).otherwise(F.lit(0))


def value_statistics(values: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """``by, n, mean, std, p0, p1, ...``: moments and interpolated percentiles of the column ``value`` (double, not null) by group, of which there are few.

    Selection by refining histograms, which are sums and extremes that merge wherever the values lie. The first has values by :func:`_bucket`,
    gives the moments, and says in which bucket each wanted rank lies. The next pass counts the values of those buckets only, in ``CELLS`` cells between the
    bucket's extremes, and so on within a cell, until a rank is that of an extreme: two passes over a million values a group, one more for each
    16,384 times as many. Nothing is put in order. The driver sees the histograms: at most 134,272 buckets a group, and ``CELLS`` cells for each wanted rank.
    """
    spark = values.sparkSession
    extremes = [F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")]
    first = values.groupBy(*by, _bucket(F.col("value")).alias("bucket")).agg(*extremes, F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    groups: dict[tuple, list[dict]] = {}
    for row in sorted(first.toArrow().to_pylist(), key=lambda r: r["bucket"]):
        groups.setdefault(tuple(row[c] for c in by), []).append(row)
    found: dict[tuple[tuple, int], float] = {}
    open_: dict[tuple[tuple, int], tuple[float, float, int]] = {}

    def settle(key: tuple, rank: int, histogram: list[dict], inside: int) -> None:
        """Take the part of the histogram that holds the value of number ``inside``: the value itself if it is an extreme."""
        for part in histogram:
            if inside < part["n"]:
                break
            inside -= part["n"]
        low, high = part["low"], part["high"]
        if low == high or inside in (0, part["n"] - 1) or math.isnan(high):
            found[key, rank] = low if inside == 0 else high
        else:
            open_[key, rank] = low, high, inside

    for key, histogram in groups.items():
        n = sum(p["n"] for p in histogram)
        for rank in {f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)}:
            settle(key, rank, histogram, rank)
    while open_:
        ranges = {x: i for i, x in enumerate(dict.fromkeys((key, low, high) for (key, _), (low, high, _) in open_.items()))}
        fields = [st.StructField(f"__{c}", values.schema[c].dataType) for c in by]
        kind = st.StructType([*fields, *(st.StructField(c, t) for c, t in (("__id", st.LongType()), ("__low", st.DoubleType()), ("__high", st.DoubleType())))])
        # A row for each range, of which there are two a group and share at most.
        asked = F.broadcast(spark.createDataFrame([(*key, i, low, high) for (key, low, high), i in ranges.items()], kind))
        inside = values.join(asked, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("value").between(F.col("__low"), F.col("__high"))])
        # Halves, as the difference of two doubles may be too large for one.
        share = (F.col("value") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
        cell = F.when(F.isnan(share), CELLS - 1).otherwise(F.floor(share * (CELLS - 1)))
        parts: dict[int, list[dict]] = {}
        for row in sorted(inside.groupBy("__id", cell.alias("cell")).agg(*extremes).toArrow().to_pylist(), key=lambda r: r["cell"]):
            parts.setdefault(row["__id"], []).append(row)
        before, open_ = open_, {}
        for (key, rank), (low, high, place) in before.items():
            settle(key, rank, parts[ranges[key, low, high]], place)

    rows = []
    for key, histogram in groups.items():
        n = sum(p["n"] for p in histogram)
        mean = sum(p["n"] * p["mean"] for p in histogram) / n
        spread = math.sqrt(sum(p["n"] * (p["var"] + (p["mean"] - mean) ** 2) for p in histogram) / n)
        ranks = []
        for q in shares:
            spot = q * (n - 1)
            low, high = math.floor(spot), math.ceil(spot)
            ranks.append(found[key, low] if low == high else (high - spot) * found[key, low] + (spot - low) * found[key, high])
        rows.append((*key, n, mean, spread, *ranks))
    numbers = [st.StructField("n", st.LongType()), *(st.StructField(c, st.DoubleType()) for c in ("mean", "std", *(f"p{k}" for k in range(len(shares)))))]
    return spark.createDataFrame(rows, st.StructType([*[values.schema[c] for c in by], *numbers]))


def request_totals(responses: DataFrame, duration_s: float, by: list[str] | None = None) -> DataFrame:
    """Counts, token totals, throughputs and the mean latency of ``success, latency, prompt_len, output_len``; only successful requests count in latency and output."""
    ok = F.coalesce("success", F.lit(False))
    out_len = F.when(ok, F.col("output_len")).otherwise(0)
    return responses.groupBy(*(by or [])).agg(
        F.count("*").alias("requests"),
        F.count_if(ok).alias("completed"),
        F.sum("prompt_len").alias("total_input"),
        F.sum(out_len).alias("total_output"),
        (F.count_if(ok) / duration_s).alias("request_throughput"),
        (F.sum("prompt_len") / duration_s).alias("input_throughput"),
        (F.sum(out_len) / duration_s).alias("output_throughput"),
        (F.avg(F.when(ok, F.col("latency"))) * 1000).alias("avg_latency_ms"),
    )


def latency_metrics(responses: DataFrame, duration_s: float, by: list[str] | None = None) -> DataFrame:
    """Totals, throughputs and latency statistics of ``success, latency, ttft, itl, prompt_len, output_len``; statistics of nothing are 0.

    Totals are those of :func:`request_totals`; time per output token needs more than one token. Every
    measured time is a row, its statistics come of :func:`value_statistics`, and all is joined
    to the totals' handful of groups.
    """
    by = by or []
    ok = F.coalesce("success", F.lit(False))
    totals = request_totals(responses, duration_s, by)
    times = ["ttft", "tpot", "itl"]
    tpot = F.when(F.col("output_len") > 1, (F.col("latency") - F.col("ttft")) / (F.col("output_len") - 1))
    one = lambda name, value: F.struct(F.lit(name).alias("time"), value.cast("double").alias("value"))
    measured = F.concat(F.array(one("ttft", F.col("ttft")), one("tpot", tpot)), F.transform(F.coalesce("itl", F.array().cast("array<double>")), lambda x: one("itl", x)))
    values = responses.where(ok).select(*by, F.inline(measured)).where("value is not null")
    keys = [*by, "time"]
    stats = value_statistics(values, keys, [0.5, 0.99])
    kinds = {"mean": "mean", "median": "p0", "std": "std", "p99": "p1"}
    # A row for each group and time.
    wide = stats.groupBy(*by).agg(*[F.max(F.when(F.col("time") == t, F.col(c))).alias(f"{k}_{t}_ms") for t in times for k, c in kinds.items()])
    if by:
        out = totals.alias("t").join(wide.alias("w"), [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by], "left")
    else:
        out = totals.alias("t").crossJoin(F.broadcast(wide).alias("w"))  # one row each
    return out.select("t.*", *[F.coalesce(F.col(f"w.{k}_{t}_ms") * 1000, F.lit(0.0)).alias(f"{k}_{t}_ms") for t in times for k in kinds])


def assemble(one: DataFrame, two: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows of the modes that both result tables have, with the metrics of both, two decimals cut toward zero."""
    both = one.join(two, "mode")
    return both.select("mode", *[T.truncate_2dp(F.col(m)).alias(m) for m in metrics])


def gaps_from_chunks(chunks: DataFrame) -> DataFrame:
    """Per ``request_id`` of ``(request_id, start_ts, seq, ts, text)``: ``ttft``, the gaps after it, the text and the latency."""
    order = Window.partitionBy("request_id").orderBy("seq")
    gap = F.col("ts") - F.coalesce(F.lag("ts").over(order), F.col("start_ts"))
    item = F.struct("seq", gap.alias("gap"), "text", "ts")
    lists = chunks.select("request_id", "start_ts", item.alias("item")).groupBy("request_id").agg(F.min("start_ts").alias("start_ts"), F.sort_array(F.collect_list("item")).alias("items"))
    gaps = F.transform("items", lambda x: x["gap"])
    return lists.select(
        "request_id",
        F.get(gaps, F.lit(0)).alias("ttft"),
        F.slice(gaps, 2, F.size(gaps)).alias("itl"),
        F.array_join(F.transform("items", lambda x: x["text"]), "").alias("generated_text"),
        (F.array_max(F.transform("items", lambda x: x["ts"])) - F.col("start_ts")).alias("latency"),
    )


def sse_chunks(lines: DataFrame) -> DataFrame:
    """``(request_id, seq, ts, start_ts, text)`` of raw event lines: ``data: `` taken off, blank lines left out, nothing from ``[DONE]`` on."""
    body = T.remove_prefix(T.strip(F.col("line")), "data: ")
    done = F.min(F.when(body == "[DONE]", F.col("seq"))).over(Window.partitionBy("request_id"))
    rows = lines.select("*", body.alias("body"), done.alias("done")).where((F.col("body") != "") & (F.col("done").isNull() | (F.col("seq") < F.col("done"))))
    return rows.select("request_id", "seq", "ts", "start_ts", F.coalesce(F.get_json_object("body", "$.choices[0].text"), F.lit("")).alias("text"))


def cache_reuse(hits: Column, queries: Column) -> Column:
    return F.when(queries > 0, 100.0 * hits / queries).otherwise(0.0)


def scrape_counters(lines: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Value of the last line of each named series in a text exposition ``(line_no, line)``; one column a name."""
    value = F.expr("try_cast(trim(element_at(split(line, '[}]'), -1)) as double)")
    aggs = [F.max_by(F.when(F.startswith("line", F.lit(n)), value), F.when(F.startswith("line", F.lit(n)), F.col("line_no"))).alias(re_name(n)) for n in names]
    return lines.groupBy(*(by or [])).agg(*aggs)


def re_name(series: str) -> str:
    return series.replace(":", "_")


def report_with_overall(rates: DataFrame, key: str, count: str, values: list[str]) -> DataFrame:
    """``rates`` and a row ``overall`` of count-weighted means."""
    sums = [F.sum(F.col(v) * F.col(count)) / F.sum(count) for v in values]
    name = F.when(F.grouping(key) == 1, F.lit("overall")).otherwise(F.col(key))
    return rates.rollup(key).agg(name.alias("group"), F.sum(count).alias("count"), *[s.alias(v) for s, v in zip(sums, values)]).select("group", "count", *values)


def mode_pivot(results: DataFrame, metrics: list[str]) -> DataFrame:
    """One row a ``mode``, one column a metric, two decimals cut toward zero."""
    wide = results.groupBy("mode").pivot("metric", metrics).agg(F.max("value"))
    return wide.select("mode", *[T.truncate_2dp(F.col(m)).alias(m) for m in metrics])
