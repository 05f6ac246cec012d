"""Quality rules: a decision list learned by sequential covering, all in DataFrame functions.

Text statistics are computed once per document; labelled rows of that small table feed a
sequential-covering learner whose every step is one grouped count; the learned list is
emitted as an ordered ``CASE`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, utf8

WORD_SPLIT = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Most labelled rows that the learner reads; beyond it, rows are drawn by a hash of the id.
MAX_TRAIN_ROWS = 200_000
QUANTILES = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]
FEATURES = ["symbols_per_char", "dup_line_share", "repeat_share", "chars_per_word", "upper_share", "digit_share", "mark_share", "distinct_share", "bare_share"]
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule is kept if, on the pruning fold, so large a share of what it rejects is labelled bad.
MIN_PRECISION = 0.95
MIN_COVER = 5


def text_stats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``carry`` and the statistics of the whole text, one row per row of ``docs``.

    Words are runs of characters other than space and 0x09-0x0D; a null text has none. A
    word is repeated if it lies in a three-word window that occurs twice or more in the
    text; windows are compared by their 64-bit hash within one text.
    """
    text = docs.select(F.struct(*carry).alias("carried"), utf8(text_col).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", WORD_SPLIT), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    triples = F.when(n >= 3, F.transform(F.arrays_zip(F.slice("words", 1, n - 2), F.slice("words", 2, n - 2), F.slice("words", 3, n - 2)), lambda t: F.xxhash64(t)))
    one = words.select(
        "carried",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-ZÀ-ÖØ-Þ]")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[0-9]")).alias("n_digits"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_marks"),
        F.regexp_count("text", F.lit(r"[.,;:!?]")).alias("n_stops"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        lines.alias("lines"),
        triples.alias("triples"),
    )
    # No window twice, by far the usual case: nothing is sorted.
    twice = F.size("triples") > F.size(F.array_distinct("triples"))
    two = one.withColumn("sorted", F.when(twice, F.sort_array(F.transform("triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("sorted")
    pairs = F.arrays_zip(F.slice("sorted", 1, m - 1).alias("a"), F.slice("sorted", 2, m - 1).alias("b"))
    same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    spots = F.flatten(F.transform(same, lambda p: F.array(*[p[s]["i"] + k for s in "ab" for k in range(3)])))
    return two.select(
        "carried.*",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.when(F.col("sorted").isNull(), 0).otherwise(F.size(F.array_distinct(spots))).cast("long").alias("n_repeat_words"),
        "n_upper",
        "n_digits",
        "n_marks",
        "n_stops",
        "n_distinct",
    )


def features(stats: DataFrame) -> DataFrame:
    """The learner's scale-free features beside the statistics; a share of nothing is 0."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.select(
        "*",
        (F.col("n_symbols") / chars).alias("symbols_per_char"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("word_chars") / words).alias("chars_per_word"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_marks") / words).alias("mark_share"),
        (F.col("n_distinct") / words).alias("distinct_share"),
        (F.lit(1.0) - F.least(F.col("n_stops") / words, F.lit(1.0))).alias("bare_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of threshold conditions; a text that meets it is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def _splits(fold: DataFrame) -> dict[tuple[int, int, int], int]:
    """Rows by feature, bin (thresholds that the value exceeds) and class (0 bad, 1 good)."""
    counts: dict[tuple[int, int, int], int] = {}
    for r in fold.groupBy("feature", "bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect():
        counts[r["feature"], r["bin"], 0], counts[r["feature"], r["bin"], 1] = r["bad"], r["good"]
    return counts


def _exceeded(feature: str, cuts: list[float]) -> Column:
    """How many of the thresholds the feature exceeds."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(feature) > c))


def learn_rules(labelled: DataFrame, id_col: str = "doc_id", max_train_rows: int = MAX_TRAIN_ROWS) -> list[Rule]:
    """Sequential covering over ``labelled`` (:func:`features` and a boolean ``bad``; nulls are left out).

    Two thirds of the rows, by a hash of the id, grow each conjunction by the information gain
    of the best threshold condition; the rest prune it, dropping last conditions while that
    raises the margin of bad over good rows, and reject it below ``MIN_PRECISION``. Rows that a
    rule covers are removed before the next is grown. Each step is one grouped count over at
    most ``max_train_rows`` rows; the driver sees counts by threshold only. No label or one class only gives no rule.
    """
    labelled = labelled.where(F.col("bad").isNotNull())
    n = labelled.count()
    if n > max_train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * max_train_rows / n))
    data = materialise(labelled.select("bad", (F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(3)) == 0).alias("prune"), *FEATURES), "rule_rows")
    seen = data.groupBy("bad").agg(*[F.percentile_approx(f, QUANTILES, 1000).alias(f) for f in FEATURES]).collect()
    if {r["bad"] for r in seen} != {True, False}:
        return []
    # Thresholds lie half-way between neighbouring quantiles of either class, so a rule keeps a margin.
    values = {f: sorted({float(x) for r in seen for x in r[f]}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    bins = [F.struct(F.lit(i).alias("feature"), _exceeded(f, cuts[f]).alias("bin")) for i, f in enumerate(FEATURES)]
    data = materialise(data.withColumn("bins", F.array(*bins)), "rule_bins")

    def grow(left: DataFrame) -> list[Condition]:
        picked: list[Condition] = []
        for _ in range(MAX_CONDITIONS):
            rows = left
            for c in picked:
                rows = rows.where(c.column())
            counts = _splits(rows.select("bad", F.inline("bins")))
            bad = sum(v for (i, _, k), v in counts.items() if i == 0 and k == 0)
            good = sum(v for (i, _, k), v in counts.items() if i == 0 and k == 1)
            if bad < MIN_COVER or good == 0:
                break
            best = (0.0, None)
            for i, f in enumerate(FEATURES):
                for at, cut in enumerate(cuts[f]):
                    over = [sum(v for (x, b, k), v in counts.items() if x == i and k == kind and b > at) for kind in (0, 1)]
                    for above, p, q in ((True, *over), (False, bad - over[0], good - over[1])):
                        if p >= MIN_COVER and p + q < bad + good:
                            gain = p * (math.log2(p / (p + q)) - math.log2(bad / (bad + good)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Condition(f, above, cut))
            if best[1] is None:
                break
            picked.append(best[1])
        return picked

    def prune(picked: list[Condition], left: DataFrame) -> Rule | None:
        tests, sums = [], []
        for k in range(1, len(picked) + 1):
            rule = Rule(tuple(picked[:k]))
            tests.append(rule)
            sums += [F.count_if(rule.column() & F.col("bad")), F.count_if(rule.column() & ~F.col("bad"))]
        got = left.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
        worth = [((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k) for k in range(len(tests))]
        k = -max(worth)[1]
        good_enough = got[2 * k] >= max(1, MIN_COVER // 2) and got[2 * k] >= MIN_PRECISION * (got[2 * k] + got[2 * k + 1])
        return tests[k] if good_enough else None

    rules: list[Rule] = []
    left = data
    for _ in range(MAX_RULES):
        picked = grow(left.where(~F.col("prune")))
        if not picked:
            break
        rule = prune(picked, left.where("prune"))
        if rule is None:
            break
        rules.append(rule)
        left = left.where(~rule.column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true keeps the text."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row per id with one label: 0 is bad, 1 good; other, null and conflicting labels are left out."""
    by_id = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__lo"), F.max(label_col).alias("__hi"))
    return by_id.where("__id is not null and __lo = __hi").select("__id", (F.col("__lo") == 0).alias("bad"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics and the columns ``base_failed``, ``kept`` and ``rule`` (the first rule met, else null).

    One row per row of ``docs``, with ``id_col`` of its columns. Null and empty texts fail the
    base rules; with no labels the base rules alone decide; repeated rows are judged alike; an
    empty table gives an empty result. Statistics are written once and both learnt from and judged.
    """
    stats = materialise(features(text_stats(docs, (id_col,), text_col)), "text_stats")
    known = _known(labels, id_col, label_col)
    # The base rules decide first, so the list is learned on what passes them.
    rules = learn_rules(stats.where(~base_failed()).join(known, stats[id_col] == known["__id"]), id_col)
    named = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        named = named.when(rule.column(), F.lit(str(rule)))
    return stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"), named.otherwise(F.lit(None)).alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, columns unchanged.

    The list is learned on at most about ``max_train_rows`` labelled rows, then applied to every
    row in one scan without a shuffle. Edge cases are those of :func:`judge`.
    """
    known = _known(labels, id_col, label_col)
    n = known.count()
    if n > max_train_rows:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * max_train_rows / n))
    # At most max_train_rows ids of one number or string each: a bounded broadcast, so the texts stay where they are.
    labelled = docs.select(id_col, text_col).join(F.broadcast(known), docs[id_col] == known["__id"])
    rules = learn_rules(materialise(features(text_stats(labelled, (id_col, "bad"), text_col)), "rule_stats").where(~base_failed()), id_col)
    judged = features(text_stats(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text")), ("__row",), "__text"))
    # A generator ends the projection: a filter pushed below it would compute each statistic once per mention.
    once = judged.select("__row", F.explode(F.array(F.struct(*[c for c in judged.columns if c != "__row"]))).alias("__stats"))
    return once.select("__row", "__stats.*").where(verdict(rules)).select("__row.*")


def op10_quality_rules(spark, sf_dir):
    """doc_id, the base statistics, base_failed and kept for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
