"""Fill-in-the-middle prompts, label masks and padded batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import config as C
from millrace.functions import text as T
from millrace.functions.tokenizer import DefaultTokenizer
from millrace.sources.scratch import discard, materialise

QWEN = C.SENTINELS["qwen"]


def _upto(text: Column, end: Column) -> Column:
    return F.substring(text, F.lit(1), end)


def _from(text: Column, begin: Column) -> Column:
    """From a 0-based place on."""
    return F.substring(text, begin + 1, F.greatest(F.length(text), F.lit(1)))


def _between(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


def cut_places(size: Column, key: Column, cfg: C.FimConfig = C.FimConfig()) -> tuple[Column, Column]:
    """Two places that cut ``size`` characters or tokens in three, the middle never empty; a draw by ``key`` decides."""
    first = T.draw_between(key, 1, F.lit(1), size - cfg.min_length)
    return first, T.draw_between(key, 2, first + 1, size - 1)


def split_characters(df: DataFrame, text: Column, key: Column, cfg: C.FimConfig = C.FimConfig()) -> DataFrame:
    """``df`` and ``prefix, middle, suffix``, null where the text is under ``skip_length`` characters."""
    size = F.length(text).cast("long")
    first, second = cut_places(size, key, cfg)
    cut = df.withColumns({"__text": text, "__a": F.when(size >= cfg.skip_length, first)})
    cut = cut.withColumn("__b", F.when(F.col("__a").isNotNull(), T.draw_between(key, 2, F.col("__a") + 1, F.length("__text").cast("long") - 1)))
    t, a, b = F.col("__text"), F.col("__a").cast("int"), F.col("__b").cast("int")
    return cut.withColumns({"prefix": _upto(t, a), "middle": _between(t, a, b), "suffix": F.when(b.isNotNull(), _from(t, b))}).drop("__text", "__a", "__b")


def split_tokens(df: DataFrame, tokens: Column, key: Column, cfg: C.FimConfig = C.FimConfig()) -> DataFrame:
    """``df`` and the token arrays ``prefix, middle, suffix``, null where there are under ``skip_length`` tokens."""
    cut = df.withColumn("__tokens", tokens)
    size = F.size("__tokens").cast("long")
    cut = cut.withColumn("__a", F.when(size >= cfg.skip_length, T.draw_between(key, 1, F.lit(1), size - cfg.min_length)).cast("int"))
    cut = cut.withColumn("__b", F.when(F.col("__a").isNotNull(), T.draw_between(key, 2, F.col("__a") + 1, size - 1)).cast("int"))
    t, a, b = F.col("__tokens"), F.col("__a"), F.col("__b")
    return cut.withColumns({"prefix": F.slice(t, 1, a), "middle": F.slice(t, a + 1, b - a), "suffix": F.slice(t, b + 1, F.size(t) - b)}).drop("__tokens", "__a", "__b")


def split_token_text(df: DataFrame, text: Column, key: Column, tokenizer=None, cfg: C.FimConfig = C.FimConfig()) -> DataFrame:
    """``df`` and the texts ``prefix, middle, suffix`` that the three runs of tokens decode to; null under ``skip_length`` tokens."""
    tokenizer = tokenizer or DefaultTokenizer()
    cut = split_tokens(df, tokenizer.encode(text), key, cfg)
    return cut.withColumns({c: tokenizer.decode(F.col(c)) for c in ("prefix", "middle", "suffix")})


def prompt_fim(prefix: Column, middle: Column, suffix: Column, s: C.Sentinels = QWEN) -> Column:
    """All that is known before the gap, then the suffix; the model goes on after the last mark."""
    return F.concat(F.lit(s.pre), prefix, middle, F.lit(s.suf), suffix, F.lit(s.mid))


def prompt_efim(prefix: Column, middle: Column, suffix: Column, s: C.Sentinels = QWEN) -> Column:
    """The typed middle last, so that prefix and suffix stay the same while it grows."""
    return F.concat(F.lit(s.pre), prefix, F.lit(s.suf), suffix, F.lit(s.mid), middle)


#: Where a line begins, and the blanks before its first word.
_BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_LINE_START = rf"(?:\A|(?<=[{_BREAKS}]))[\s&&[^{_BREAKS}]]*"


def _marks(marks: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, marks)) + ")"


def function_parts(prefix: Column, suffix: Column) -> tuple[Column, Column, Column, Column]:
    """``previous, fn_prefix, fn_suffix, after``: prefix and suffix each cut where the function at the gap begins and ends.

    The function begins at the last line of the prefix that starts with a function mark (else at the first line), and
    ends before the first line of the suffix that starts with an end mark (else at its end). Places are those of the
    texts themselves, so the four parts put prefix and suffix together again and the middle is in none of them.
    """
    p, s = F.replace(prefix, F.lit("\r\n"), F.lit("\n")), F.replace(suffix, F.lit("\r\n"), F.lit("\n"))

    # The longest text before a start mark, and the shortest before an end mark.
    begin = F.length(F.regexp_extract(p, rf"(?sU)\A(.*){_LINE_START}{_marks(C.START_MARKS)}", 1))
    stop = rf"(?sU)\A(.*?){_LINE_START}{_marks(C.END_MARKS)}"
    end = F.when(s.rlike(stop), F.length(F.regexp_extract(s, stop, 1))).otherwise(F.length(s))
    return _upto(p, begin), _from(p, begin), _upto(s, end), _from(s, end)


def prompt_function(prefix: Column, middle: Column, suffix: Column, s: C.Sentinels = QWEN) -> Column:
    """The file around the function first, then the function around the gap, then the middle."""
    previous, fn_prefix, fn_suffix, after = function_parts(prefix, suffix)
    m = F.replace(middle, F.lit("\r\n"), F.lit("\n"))
    return F.concat(F.lit(s.pre), previous, F.lit(s.suf), after, F.lit(s.pre), fn_prefix, F.lit(s.suf), fn_suffix, F.lit(s.mid), m)


def prompt_sfim(prefix: Column, middle: Column, suffix: Column, s: C.Sentinels = QWEN) -> Column:
    """Evaluation form: what is typed belongs to the prefix, the middle is empty."""
    return prompt_function(F.concat(prefix, middle), F.lit(""), suffix, s)


def register_prompts(spark: SparkSession, s: C.Sentinels = QWEN) -> None:
    """``prompt_fim``, ``prompt_efim`` and ``prompt_sfim`` of prefix, middle and suffix as SQL functions of the session."""
    mark = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pre, mid, suf = map(mark, (s.pre, s.mid, s.suf))
    start, end = (rf"{_LINE_START}{_marks(m)}" for m in (C.START_MARKS, C.END_MARKS))
    flat = "replace({}, '\\r\\n', '\\n')".format
    begin = rf"length(regexp_extract(p, r\"(?sU)\A(.*){start}\", 1))".replace('\\"', '"')
    stop = rf'r"(?sU)\A(.*?){end}"'
    bodies = {
        "prompt_fim": f"concat({pre}, prefix, middle, {suf}, suffix, {mid})",
        "prompt_efim": f"concat({pre}, prefix, {suf}, suffix, {mid}, middle)",
        "prompt_sfim": f"""(select concat({pre}, left(p, b), {suf}, substring(s, e + 1), {pre}, substring(p, b + 1), {suf}, left(s, e), {mid})
            from (select p, s, {begin} as b, if(s rlike {stop}, length(regexp_extract(s, {stop}, 1)), length(s)) as e
            from (select {flat('concat(prefix, middle)')} as p, {flat('suffix')} as s)))""",
    }
    for name, body in bodies.items():
        spark.sql(f"create or replace temporary function {name}(prefix string, middle string, suffix string) returns string return {body}")


def has_sentinel(text: Column, s: C.Sentinels = QWEN) -> Column:
    """Texts that hold a mark themselves cannot be taken apart again and are to be left out."""
    return F.contains(text, F.lit(s.pre)) | F.contains(text, F.lit(s.mid)) | F.contains(text, F.lit(s.suf))


def split_prompt(prompt: Column, s: C.Sentinels = QWEN) -> Column:
    """``struct(prefix, middle, suffix)`` of a fim prompt; null unless each mark occurs once and in order."""
    head = F.split(prompt, _quoted(s.pre), -1)
    rest = F.split(head[1], _quoted(s.suf), -1)
    tail = F.split(rest[1], _quoted(s.mid), -1)
    ok = (F.size(head) == 2) & (F.size(rest) == 2) & (F.size(tail) == 2)
    return F.when(ok, F.struct(rest[0].alias("prefix"), tail[1].alias("middle"), tail[0].alias("suffix")))


def _quoted(mark: str) -> str:
    return r"\Q" + mark + r"\E"


def sentinels_of(model: str) -> C.Sentinels:
    for family, marks in C.SENTINELS.items():
        if family in model.lower():
            return marks
    raise ValueError(f"no sentinels for {model}")


def sentinel_column(model: Column, part: str) -> Column:
    """The mark ``pre``, ``mid`` or ``suf`` of each row's model; an unknown model raises."""
    out = F.raise_error(F.concat(F.lit("no sentinels for "), model)).cast("string")
    for family, marks in reversed(list(C.SENTINELS.items())):
        out = F.when(F.contains(F.lower(model), F.lit(family)), F.lit(getattr(marks, part))).otherwise(out)
    return out


def training_mode(key: Column, cfg: C.FimConfig = C.FimConfig()) -> Column:
    u = T.uniform(key, 3)
    return F.when(u < cfg.sfim_rate, "sfim").when(u < cfg.sfim_rate + cfg.fim_rate, "fim").otherwise("l2r")


def template(path: Column, text: Column, cfg: C.FimConfig = C.FimConfig()) -> Column:
    return F.concat(F.lit(cfg.file_mark), path, F.lit("\n"), text)


def training_prompts(files: DataFrame, key: Column, cfg: C.FimConfig = C.FimConfig(), s: C.Sentinels = QWEN) -> DataFrame:
    """``files`` and ``mode`` and ``prompt``: the templated file, rewritten as its mode says, and the end mark.

    A text too short to cut stays as it is in every mode. In sfim the middle comes last and nowhere else.
    """
    cut = split_characters(files.withColumn("mode", training_mode(key, cfg)), template(F.col("path"), F.col("content"), cfg), key, cfg)
    p, m, x = F.col("prefix"), F.col("middle"), F.col("suffix")
    whole = template(F.col("path"), F.col("content"), cfg)
    body = F.when(p.isNull() | (F.col("mode") == "l2r"), whole).when(F.col("mode") == "fim", prompt_efim(p, m, x, s)).otherwise(prompt_function(p, m, x, s))
    return cut.withColumn("prompt", F.concat(body, F.lit(cfg.eot_mark))).drop("prefix", "middle", "suffix")


def label_mask(ids: Column, middle_id: Column, ignore: int = -100) -> Column:
    """Ids after the first ``middle_id``; ``ignore`` up to and at it; all ids if there is none."""
    # Found once a text and not once a token: within a lambda it would be searched again for every id.
    at = F.coalesce(F.array_position(ids, middle_id), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(ignore), at), F.slice(ids, at + 1, F.size(ids)))


def pad_batches(samples: DataFrame, order_col: str, cfg: C.FimConfig = C.FimConfig(), row_number: Column | None = None) -> DataFrame:
    """``input_ids`` and ``labels`` in batches of ``batch_size`` in order of ``order_col``, padded to the longest of the batch.

    Rows are numbered over the whole table range by range, not in one task; ``row_number`` (from 0)
    may be given where the caller has one. Only keys and sizes are sorted; each row then gets its batch by its key. Where a key stands twice,
    and with ``row_number``, whole rows are sorted.
    """
    to_batch = F.floor(F.col("row_number") / cfg.batch_size).cast("long")
    by_batch = Window.partitionBy("batch_id")
    plan = None if row_number is not None else _batch_plan(samples, order_col, to_batch)
    if plan is not None:
        batched = samples.join(plan, F.col(order_col).eqNullSafe(F.col("__key"))).drop("__key")
    else:
        numbered = with_row_number(samples, order_col) if row_number is None else samples.withColumn("row_number", row_number)
        batched = numbered.withColumn("batch_id", to_batch).withColumn("__longest", F.max(F.size("input_ids")).over(by_batch)).drop("row_number")
    short = batched.withColumn("__short", F.col("__longest") - F.size("input_ids"))
    pad = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("__short")))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("__short")))
    return short.withColumns({"attention_mask": mask, "input_ids": pad("input_ids", cfg.pad_id), "labels": pad("labels", cfg.label_ignore)}).drop("__short", "__longest")


#: Rows of a plan of batches (a key and two numbers each) up to which every task gets it whole; beyond that both sides are shuffled, and the plan is hashed.
BROADCAST_ROWS = 500_000


def _batch_plan(samples: DataFrame, order_col: str, to_batch: Column) -> DataFrame | None:
    """``__key, batch_id, __longest`` of each row, or None if a key stands twice."""
    sizes = materialise(samples.select(F.col(order_col).alias("__key"), F.size("input_ids").alias("__size")), "sizes")
    if not sizes.groupBy("__key").count().where("count > 1").isEmpty():
        discard(sizes)
        return None
    longest = F.max("__size").over(Window.partitionBy("batch_id"))
    batches = with_row_number(sizes, "__key").withColumn("batch_id", to_batch)
    plan = materialise(batches.select("__key", "batch_id", longest.alias("__longest")), "batches")
    discard(sizes)
    return F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan.hint("shuffle_hash")


def with_row_number(df: DataFrame, order_col: str, parts: int | None = None) -> DataFrame:
    """``row_number`` from 0 in order of a unique column, by ranges that are sorted side by side (:func:`T.numbered`)."""
    return T.numbered(df, [], order_col, "row_number", parts)
