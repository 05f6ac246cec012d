"""Repository selection: file and repository filters, statistics, scores, buckets, picks."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import config as C
from millrace.functions import text as T

from .best import best


def parse_buckets(specs: list[str] | tuple[str, ...]) -> list[tuple[int, int, int]]:
    """``"lo-hi:quota"`` in MB to whole bytes."""
    out = []
    for spec in specs:
        lo, hi, quota = (int(float(x) * C.MB) for x in re.fullmatch(r"\s*([\d.]+)-([\d.]+):([\d.]+)\s*", spec).groups())
        out.append((lo, hi, quota))
    return out


def bucket_index(size: Column, buckets: list[tuple[int, int, int]]) -> Column:
    """The first bucket with ``lo <= size < hi``, else null."""
    out = F.lit(None).cast("int")
    for i, (lo, hi, _) in reversed(list(enumerate(buckets))):
        out = F.when((size >= lo) & (size < hi), i).otherwise(out)
    return out


def bucket_join(df: DataFrame, buckets: DataFrame, size_col: str) -> DataFrame:
    """The same as a range join with a bucket table ``(bucket, lo, hi, quota)``, a handful of rows by nature."""
    return df.join(F.broadcast(buckets), (F.col(size_col) >= F.col("lo")) & (F.col(size_col) < F.col("hi")), "left")


def _canonical(path: Column) -> Column:
    """Lower case, forward slashes, no leading slash."""
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^/+", "")


def _any_suffix(path: Column, ends: list[str]) -> Column:
    return path.rlike("(?:" + "|".join(map(re.escape, ends)) + ")$")


def is_text_candidate(cfg: C.RepoConfig = C.RepoConfig()) -> Column:
    """Over ``path, is_vendor, is_generated, length_bytes, max_line_length, alphanum_fraction``; missing values reject or keep as defaults do.

    A missing line length or fraction and a missing or zero size reject; a missing flag keeps. Paths
    with and without a leading slash are treated alike.
    """
    path = _canonical(F.coalesce("path", F.lit("")))
    rooted = F.concat(F.lit("/"), path)
    return (
        (path != "")
        & ~F.coalesce("is_vendor", F.lit(False))
        & ~F.coalesce("is_generated", F.lit(False))
        & F.coalesce("length_bytes", F.lit(0)).between(1, cfg.max_file_kb * 1024)
        & (F.coalesce("max_line_length", F.lit(cfg.max_line_length + 1)) <= cfg.max_line_length)
        & (F.coalesce("alphanum_fraction", F.lit(cfg.min_alphanum - 1)) >= cfg.min_alphanum)
        & ~F.array_contains(F.split(path, "/"), ".git")
        & ~_any_suffix(path, C.BINARY_EXTS)
        & ~rooted.rlike("|".join(map(re.escape, C.GENERATED_SUBSTR)))
        & ~_any_suffix(path, C.GENERATED_SUFFIX)
    )


def owner_of(repo: Column) -> Column:
    return F.when(F.contains(repo, F.lit("/")), F.lower(F.split(repo, "/")[0])).otherwise("unknown")


def name_tokens(repo: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(T.basename(repo)), "[^a-z0-9]+"), ""))


def is_junk_name(repo: Column) -> Column:
    return F.arrays_overlap(name_tokens(repo), F.array(*map(F.lit, C.JUNK_TOKENS)))


def repo_stats(files: DataFrame, eligible: Column | None = None) -> DataFrame:
    """One row per ``repo_name`` of a file table; sizes count eligible files, flags all files.

    Core means not below a non-core top folder, decided file by file. Repositories without
    a name or an eligible file are left out.
    """
    path = _canonical(F.col("path"))
    parts = F.split(path, "/")
    ok = is_text_candidate() if eligible is None else eligible
    core = ~((F.size(parts) > 1) & parts[0].isin(C.NONCORE_DIRS))
    python = (F.coalesce("language", F.lit("")) == "Python") | F.endswith(path, F.lit(".py"))
    marked = files.where(F.coalesce("repo_name", F.lit("")) != "").select(
        "repo_name",
        F.coalesce("length_bytes", F.lit(0)).alias("size"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        core.alias("core"),
        (core & python).alias("core_py"),
        T.basename(path).isin(C.CONFIG_MARKERS).alias("config"),
        (T.basename(path) == "__init__.py").alias("init"),
        ((F.size(parts) > 1) & parts[0].isin("src", "lib")).alias("src"),
        *[(F.col(c) if c in files.columns else F.lit(None)).alias(c) for c in ("gha_language", "stars", "forks")],
    )

    def total(flag: str) -> Column:
        return F.sum(F.when(F.col("ok") & F.col(flag), F.col("size")).otherwise(0))

    grouped = marked.groupBy("repo_name").agg(
        F.bool_or("config").alias("has_config"),
        F.bool_or("init").alias("has_init"),
        F.bool_or("src").alias("has_src"),
        F.sum(F.when(F.col("ok"), F.col("size")).otherwise(0)).alias("total_bytes"),
        total("core").alias("core_bytes"),
        total("core_py").alias("core_py_bytes"),
        F.count_if(F.col("ok") & F.col("core_py")).alias("core_py_files"),
        F.count_if("ok").alias("eligible_files"),
        F.max("gha_language").cast("string").alias("gha_language"),
        F.coalesce(F.max("stars"), F.lit(0)).cast("long").alias("stars"),
        F.coalesce(F.max("forks"), F.lit(0)).cast("long").alias("forks"),
    )
    ratio = F.when(F.col("core_bytes") > 0, F.col("core_py_bytes") / F.col("core_bytes")).otherwise(0.0)
    return grouped.where("eligible_files > 0").select("*", ratio.alias("core_py_ratio"), owner_of(F.col("repo_name")).alias("owner"), is_junk_name(F.col("repo_name")).alias("name_is_junk"))


def _score_parts() -> list[tuple[Column, Column, Column]]:
    """Condition, points and reason of each part of the score, in order."""
    files, language = F.col("core_py_files"), F.lower("gha_language")
    return [
        (F.lit(True), 110 * F.col("core_py_ratio"), F.format_string("core_ratio=%.2f", F.col("core_py_ratio"))),
        (files >= 40, F.lit(12), F.lit("core_py>=40")),
        ((files >= 25) & (files < 40), F.lit(7), F.lit("core_py>=25")),
        (F.col("has_config"), F.lit(18), F.lit("config")),
        (F.col("has_src"), F.lit(8), F.lit("src/lib")),
        (F.col("has_init"), F.lit(3), F.lit("init")),
        (language == "python", F.lit(8), F.lit("gha=py")),
        (language != "python", F.lit(-8), F.concat(F.lit("gha="), language)),
    ]


def score() -> Column:
    out = 3 * F.log1p(F.greatest("stars", F.lit(0))) + 2 * F.log1p(F.greatest("forks", F.lit(0)))
    for condition, points, _ in _score_parts():
        out = out + F.when(condition, points).otherwise(0)
    return out


def score_reason() -> Column:
    return F.concat_ws(" ;", *[F.when(condition, reason) for condition, _, reason in _score_parts()])


def scored(stats: DataFrame, buckets: list[tuple[int, int, int]]) -> DataFrame:
    return stats.select("*", score().alias("score"), score_reason().alias("reason"), bucket_index(F.col("total_bytes"), buckets).alias("bucket"))


def is_admitted(cfg: C.RepoConfig) -> Column:
    return (
        ~F.col("name_is_junk")
        & (F.col("core_py_ratio") >= cfg.min_core_ratio)
        & (F.col("core_py_files") >= cfg.min_core_files)
        & F.col("total_bytes").between(1, int(cfg.max_single_mb * C.MB))
        & F.col("bucket").isNotNull()
        & (F.col("score") >= cfg.score_threshold)
    )


def reject_reason(cfg: C.RepoConfig) -> Column:
    """The first test that a repository fails; null for none."""
    return (
        F.when(F.col("name_is_junk"), "junk name")
        .when(F.col("core_py_files") < cfg.min_core_files, "few files")
        .when(F.col("core_py_ratio") < cfg.min_core_ratio, "low ratio")
        .when(F.col("bucket").isNull(), "size mismatch")
        .when(F.col("score") < cfg.score_threshold, "low score")
    )


def bucket_topk(repos: DataFrame, k: int, tie: Column) -> DataFrame:
    """The ``k`` best of each bucket by score, then tie, then name; ``rank`` from 1."""
    return best(repos, "bucket", [("score", False), (tie, False), ("repo_name", True)], k)


def scan_stop(repos: DataFrame, k: int, n_buckets: int, order_col: str = "ordinal") -> DataFrame:
    """One row: ``stop_ordinal``, the number of repositories in order of a unique column up to where every one of ``n_buckets`` buckets holds ``k``; null if that never comes.

    Only the first ``k`` of each bucket are ranked; the rest are counted up to the last of them.
    """
    order = Window.partitionBy("bucket").orderBy(order_col)
    kth = repos.where(F.col("bucket").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(F.col("rank") == k)
    stop = kth.agg(F.when(F.count("*") == n_buckets, F.max(order_col)).alias("__stop"))
    # One row.
    return repos.crossJoin(F.broadcast(stop)).agg(F.when(F.max("__stop").isNotNull(), F.count_if(F.col(order_col) <= F.col("__stop"))).alias("stop_ordinal"))


def postcheck(files: DataFrame, cfg: C.RepoConfig = C.RepoConfig()) -> DataFrame:
    """Per repository the bytes in all and in Python files, and whether they suffice."""
    python = F.col("path").rlike(r"\.pyi?$")
    sums = files.groupBy("repo_name").agg(F.sum("length_bytes").alias("total_bytes"), F.sum(F.when(python, F.col("length_bytes")).otherwise(0)).alias("py_bytes"))
    ratio = F.when(F.col("total_bytes") > 0, F.col("py_bytes") / F.col("total_bytes")).otherwise(0.0)
    return sums.select("*", ((F.col("py_bytes") >= int(cfg.post_min_py_mb * C.MB)) & (ratio >= cfg.post_min_py_ratio)).alias("passed"))


def budgeted_pick(shortlist: DataFrame, buckets: list[tuple[int, int, int]], cfg: C.RepoConfig = C.RepoConfig(), seed: int = 42) -> DataFrame:
    """A random pick among each bucket's best, one bucket after another, under budgets.

    Picks among the ``random_top_k`` best left, at most ``max_repos_per_owner`` an owner, while the bucket's
    quota and the total are not reached; a candidate whose size would overshoot the total by more than
    ``overshoot_bytes`` is passed over. Candidates are used up either way. ``actual_bytes``, if there, is
    what is charged, and a candidate whose ``passed`` is false is passed over after the draw. The fold is sequential, so
    the shortlist, at most buckets times candidates per bucket rows of metadata, is read by the driver.
    """
    most = cfg.candidates_per_bucket * len(buckets)
    has = shortlist.columns
    fields = ["bucket", "rank", "repo_name", "owner", "score", "total_bytes"]
    rows = shortlist.select(*fields, (F.col("actual_bytes") if "actual_bytes" in has else F.col("total_bytes")).alias("actual"), (F.col("passed") if "passed" in has else F.lit(True)).alias("passed")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a shortlist has at most {most} rows")
    rng, owners, total, picked = random.Random(seed), {}, 0, []
    target = cfg.target_total_mb * C.MB
    for b, (_, _, quota) in enumerate(buckets):
        left = sorted((r for r in rows if r["bucket"] == b), key=lambda r: r["rank"])
        spent = 0
        while left and spent < quota and total < target:
            r = left.pop(rng.randrange(min(cfg.random_top_k, len(left))))
            room = total + r["total_bytes"] <= target + cfg.overshoot_bytes
            if owners.get(r["owner"], 0) >= cfg.max_repos_per_owner or not room or not r["passed"]:
                continue
            spent, total = spent + r["actual"], total + r["actual"]
            owners[r["owner"]] = owners.get(r["owner"], 0) + 1
            picked.append((len(picked) + 1, b, r["repo_name"], r["owner"], float(r["score"]), int(r["actual"])))
    return shortlist.sparkSession.createDataFrame(picked, "pick int, bucket int, repo_name string, owner string, score double, bytes long")


def owner_counts(repos: DataFrame) -> DataFrame:
    return repos.groupBy("owner").agg(F.count("*").alias("repos"))
