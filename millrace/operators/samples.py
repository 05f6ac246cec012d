"""Training samples: budgets, truncation, cross-file context, corpus metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import config as C
from millrace.functions import text as T
from millrace.sources.scratch import discard, materialise


def in_length_band(text: Column, cfg: C.SampleConfig = C.SampleConfig()) -> Column:
    return F.length(text).between(cfg.min_chars, cfg.max_chars)


def header_cost(text: Column) -> Column:
    """Tokens of a header line: its text, its mark and its line end."""
    return T.count_tokens(text) + 2


def truncate_samples(files: DataFrame, cfg: C.SampleConfig = C.SampleConfig()) -> DataFrame:
    """``repo_name, path, content`` in the character band, cut to the token budget and with the lengths of both.

    Samples whose content is then below ``min_content_tokens`` are dropped.
    """
    budget = cfg.max_seq_len - cfg.reserve
    heads = header_cost(F.col("repo_name")) + header_cost(F.col("path"))
    sized = files.where(in_length_band(F.col("content"), cfg)).withColumns({"__heads": heads, "__tokens": T.count_tokens(F.col("content"))})
    room = F.least("__tokens", F.greatest(F.lit(budget) - F.col("__heads"), F.lit(0)))
    cut = sized.withColumn("__kept", room).where(F.col("__kept") >= cfg.min_content_tokens)
    return cut.select(
        *[c for c in files.columns if c != "content"],
        T.truncate_tokens(F.col("content"), F.col("__kept")).alias("content"),
        F.col("__kept").cast("int").alias("content_length"),
        (F.col("__kept") + F.col("__heads")).cast("int").alias("total_length"),
    )


#: Bytes of the neighbours' heads of all folders up to which every task gets them whole; beyond that they are shuffled.
BROADCAST_BYTES = 64 << 20
#: Names of heads that may be shown up to which every task gets them whole; beyond that contents meet them by hash.
BROADCAST_NAMES = 500_000


def _literally_below(sized: DataFrame, size: int) -> DataFrame:
    """Per folder the first ``size`` files whose path begins with its name.

    They follow each other in order of path, from the first that is not before the name. Files and folders are put in one order by
    ranges, and each gets the number of files up to it; a folder asks for the next numbers. No task takes a repository whole.
    """
    file = sized.select(F.struct("repo_name", "path", F.lit(1).alias("kind")).alias("at"), "length", "cost")
    folder = sized.select(F.struct("repo_name", F.col("folder").alias("path"), F.lit(0).alias("kind")).alias("at")).distinct()
    counted = T.counted(file.unionByName(folder, allowMissingColumns=True), "at", F.col("at.kind") == 1, "number")
    nth = counted.where("at.kind = 1").select("at.repo_name", "at.path", "length", "cost", "number")
    asked = counted.where("at.kind = 0").select("at.repo_name", F.col("at.path").alias("folder"), F.explode(F.sequence(F.col("number") + 1, F.col("number") + size)).alias("number"))
    return asked.join(nth, ["repo_name", "number"]).where(F.startswith("path", F.col("folder"))).drop("number")


def _below(sized: DataFrame, size: int) -> DataFrame:
    """Per folder the first ``size`` files below it; each task keeps no more of a folder before the shuffle."""
    steps = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
        F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")))
    )
    first = Window.partitionBy("repo_name", "folder").orderBy("path")
    below = sized.select("repo_name", F.explode(above).alias("folder"), "path", "length", "cost")
    return below.withColumn("at", F.row_number().over(first)).where(F.col("at") <= size).drop("at")


def _neighbours(files: DataFrame, cfg: C.SampleConfig, literal_prefix: bool) -> DataFrame:
    """``repo_name, folder, near``: the first files below each folder in order of path, one more than wanted, as a file leaves itself out.

    Lengths and costs come from one scan; all that orders and compares goes without texts. A second scan fetches the heads that may be shown:
    one that alone exceeds the budget ends a list, so its text is null.
    """
    text = T.head_lines(F.col("content"), cfg.cross_lines)
    there = files.where(F.col("repo_name").isNotNull() & F.col("path").isNotNull())
    sized = there.select("repo_name", "path", T.dirname(F.col("path")).alias("folder"), T.count_tokens(text).alias("length"))
    sized = materialise(sized.withColumn("cost", header_cost(F.col("path")) + F.col("length")), "sized_heads")
    first = (_literally_below if literal_prefix else _below)(sized, cfg.cross_top_files + 1)
    first = materialise(first, "first_below")
    shown = first.where(F.col("cost") <= cfg.cross_budget).select("repo_name", "path").distinct()
    # Names are held and contents pass by; a join by sorting would hold the contents of a partition.
    shown = F.broadcast(shown) if first.count() <= BROADCAST_NAMES else shown.hint("shuffle_hash")
    texts = there.join(shown, ["repo_name", "path"]).select("repo_name", "path", text.alias("text"), T.count_tokens(text).alias("length")).dropDuplicates(["repo_name", "path", "length"])
    item = F.struct("path", "length", "cost", "text")
    lists = first.join(texts, ["repo_name", "path", "length"], "left").groupBy("repo_name", "folder").agg(F.sort_array(F.collect_list(item)).alias("near"))
    lists = materialise(lists, "neighbours")
    # Read back by now, and needed no more.
    discard(sized)
    discard(first)
    return lists


def _attach(files: DataFrame, cfg: C.SampleConfig, literal_prefix: bool) -> DataFrame:
    """``files`` and ``__fits``: the neighbours of each that the budget holds, with rank and running cost; null for none."""
    lists = _neighbours(files, cfg, literal_prefix).withColumnRenamed("folder", "__folder")
    size = lists.agg(F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["path"]) + F.coalesce(F.octet_length(x["text"]), F.lit(0))))).first()[0]
    lists = F.broadcast(lists) if (size or 0) <= BROADCAST_BYTES else lists.hint("shuffle_hash")
    joined = files.withColumn("__folder", T.dirname(F.col("path"))).join(lists, ["repo_name", "__folder"], "left")
    others = joined.withColumn("__others", F.slice(F.filter("near", lambda x: x["path"] != F.col("path")), 1, cfg.cross_top_files))
    running = lambda i: F.aggregate(F.slice("__others", 1, i + 1), F.lit(0).cast("long"), lambda n, y: n + y["cost"])
    ranked = F.transform("__others", lambda x, i: F.struct((i + 1).alias("rank"), x["path"].alias("path"), x["text"].alias("text"), x["length"].alias("length"), running(i).alias("running")))
    return others.select(*[F.col(c) for c in files.columns], F.filter(ranked, lambda x: x["running"] <= cfg.cross_budget).alias("__fits"))


def cross_file_context(files: DataFrame, cfg: C.SampleConfig = C.SampleConfig(), literal_prefix: bool = False) -> DataFrame:
    """Per file, the heads of up to ``cross_top_files`` neighbours below its folder, in order of path, while they fit ``cross_budget`` tokens.

    A neighbour is another file of the repository whose path begins with the file's folder
    (``literal_prefix``: with the folder's name, so ``foo_bar/x`` too is below ``foo``); a path stands once in a repository. Costs are at least two,
    so the running sum grows and the first overflow ends the list. A folder's list is short, and the same for all its files.
    """
    fits = _attach(files.select("repo_name", "path", "content"), cfg, literal_prefix).select("repo_name", F.col("path").alias("own"), F.inline("__fits"))
    return fits.select("repo_name", F.col("own").alias("path"), "rank", F.col("path").alias("context_path"), F.col("text").alias("context_text"), F.col("length").alias("context_length"), "running")


def files_with_contexts(files: DataFrame, cfg: C.SampleConfig = C.SampleConfig(), literal_prefix: bool = False) -> DataFrame:
    """:func:`with_contexts` of a table's own :func:`cross_file_context`: contents meet their folder's list and are not shuffled where the lists are small."""
    plain = F.transform("__fits", lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"), x["length"].alias("length")))
    return _attach(files, cfg, literal_prefix).withColumn("cfc_contexts", F.coalesce(plain, F.array())).drop("__fits")


def with_contexts(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """``files`` and ``cfc_contexts``, their context files in order (an empty array for none)."""
    item = F.struct("rank", F.col("context_path").alias("path"), F.col("context_text").alias("text"), F.col("context_length").alias("length"))
    lists = contexts.groupBy("repo_name", "path").agg(F.sort_array(F.collect_list(item)).alias("found"))
    plain = F.transform(F.coalesce("found", F.array().cast(lists.schema["found"].dataType)), lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"), x["length"].alias("length")))
    return files.join(lists, ["repo_name", "path"], "left").withColumn("cfc_contexts", plain).drop("found")


def cross_file_prompt(cfg: C.FimConfig = C.FimConfig()) -> tuple[Column, Column]:
    """The header with the contexts, and the content after it, of ``repo_name, path, content, cfc_contexts``."""
    parts = F.transform("cfc_contexts", lambda x: F.concat(F.lit(cfg.file_mark), x["path"], F.lit("\n"), x["text"]))
    head = F.concat(F.lit(cfg.repo_mark), "repo_name", F.lit("\n"), F.array_join(parts, ""), F.lit(cfg.file_mark), "path", F.lit("\n"))
    return head, F.concat("content", F.lit(cfg.eot_mark))


def corpus_metrics(samples: DataFrame) -> DataFrame:
    """One row of sums, counts, extremes and means of ``content_length`` and ``total_length``; null, not zero, where there is no sample."""
    aggs = [F.count("*").alias("total_count")]
    for c in ("content_length", "total_length"):
        aggs += [F.sum(c).alias(c), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"average_{c}")]
    return samples.agg(*aggs)


def repo_totals(samples: DataFrame) -> DataFrame:
    """Samples by repository, and one row ``overall`` of all of them."""
    name = F.when(F.grouping("repo_name") == 1, F.lit("overall")).otherwise(F.col("repo_name"))
    return samples.rollup("repo_name").agg(name.alias("repo"), F.count("*").alias("samples")).select("repo", "samples")


def intra_cross_ratio(samples: DataFrame) -> DataFrame:
    """Tokens of contents and of what cross-file prompts put before them, and the former's percentage."""
    head, _ = cross_file_prompt()
    sums = samples.agg(F.sum(T.count_tokens(F.col("content"))).alias("intra_tokens"), F.sum(T.count_tokens(head)).alias("cross_tokens"))
    both = F.col("intra_tokens") + F.col("cross_tokens")
    return sums.select("*", F.when(both > 0, 100.0 * F.col("intra_tokens") / both).alias("intra_percent"))


def in_token_band(tokens: Column, low: int | None, high: int) -> Column:
    """Strictly below ``high`` and, if given, strictly above ``low``."""
    return (tokens < high) if low is None else (tokens > low) & (tokens < high)


def sample_without_replacement(df: DataFrame, n: int, key: Column, salt: int, by: list[str] | None = None) -> DataFrame:
    """``n`` rows, or ``n`` of each group ``by``, in order of a draw; the key breaks ties."""
    if by is None:
        return df.orderBy(T.draw(key, salt), key).limit(n)
    order = Window.partitionBy(*by).orderBy(T.draw(key, salt), key)
    return df.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= n).drop("__at")


def sample_with_replacement(df: DataFrame, n: int, by: str, key: str, salt: int, seed: Column) -> DataFrame:
    """Where a group ``by`` has more than ``n`` rows, ``n`` draws with replacement (column ``draw`` from 0); else every row once.

    ``seed`` is a whole number that a group's rows share. Rows are numbered by ``key``, a large group in many tasks; only
    the small group sizes are multiplied by ``n``.
    """
    numbered = T.numbered(df, [by], key, "__at")
    sizes = df.groupBy(by).agg(F.count("*").alias("__size"), F.min(seed).alias("__seed"))
    large = sizes.where(F.col("__size") > n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = large.select(by, "draw", (F.floor(T.draw(F.col("__seed") + 7919 * F.col("draw"), salt) / 65536) % F.col("__size")).alias("__at"))
    small = sizes.where(F.col("__size") <= n).select(by)
    many = numbered.join(drawn, [by, "__at"])
    few = numbered.join(small, by).withColumn("draw", F.col("__at").cast("int"))
    return many.select(*df.columns, "draw").unionByName(few.select(*df.columns, "draw"))


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered by ``completion_id``."""
    return df.withColumn("completion_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
