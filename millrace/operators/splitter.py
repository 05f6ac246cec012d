"""Structure-aware splits of source text, and the rounds of a growing middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def check_language(language: str) -> None:
    if language.strip().lower() != "python":
        raise ValueError("only Python is supported")


#: A line with what ends it.
_BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_LINE = rf"[^{_BREAKS}]*(?:\r\n|[{_BREAKS}])|[^{_BREAKS}]+"
_SPAN = "struct<away: int, no: int, first: int, end: int>"
_FOLD = f"struct<size: int, at: int, no: int, open: array<struct<indent: int, no: int, first: int>>, above: struct<indent: int, first: int>, inner: {_SPAN}, any: {_SPAN}, spans: array<{_SPAN}>>"


def _blocks(text: Column, every: bool) -> Column:
    """The state after all lines: with ``every`` its ``spans`` are all function blocks, else ``inner`` and ``any`` the nearest to the middle.

    One fold down the lines with a stack of open functions: a line that is not blank closes every function
    whose header is indented as far or further. A block takes in the decorators right above its header and
    the blank lines before the line that closes it. The stack is as deep as functions are nested, so a line costs little whatever the text.
    """

    def state(**fields: Column) -> Column:
        return F.struct(*[fields[c].alias(c) for c in ("size", "at", "no", "open", "above", "inner", "any", "spans")])

    def close(acc: Column, here: Column, when: Column, closed: Column) -> dict[str, Column]:
        """What is known of blocks once those of ``closed`` end ``here``; most lines close none and leave all as it was."""
        spans = F.transform(closed, lambda f: F.struct(F.abs(f["first"] + here - acc["size"]).alias("away"), f["no"].alias("no"), f["first"].alias("first"), here.alias("end")))
        # Nearest first, then by header.
        inner = F.array_min(F.array_append(F.filter(spans, lambda x: (x["first"] > 0) & (x["end"] < acc["size"])), acc["inner"]))
        new = {"inner": inner, "any": F.array_min(F.array_append(spans, acc["any"])), "spans": F.concat(acc["spans"], spans) if every else acc["spans"]}
        return {c: F.when(when, new[c]).otherwise(acc[c]) for c in new}

    # What the fold asks of a line is found once for each, so that its steps are about numbers.
    bare = F.transform(F.regexp_extract_all(text, F.lit(_LINE), F.lit(0)), lambda line: F.struct(F.length(line).alias("size"), F.ltrim(line, F.lit(" \t")).alias("bare")))
    blank = lambda x: x.rlike(r"(?U)\A[\s\x1C-\x1F]*\z")
    head = lambda x: F.startswith(x, F.lit("def ")) | F.startswith(x, F.lit("async def "))
    kind = lambda x: F.when(head(x), "def").when(F.startswith(x, F.lit("@")), "@").when(blank(x), "").otherwise("other")
    lines = F.transform(bare, lambda x: F.struct(x["size"].alias("size"), (x["size"] - F.length(x["bare"])).alias("indent"), kind(x["bare"]).alias("kind")))

    def step(acc: Column, line: Column) -> Column:
        indent, header = line["indent"], line["kind"] == "def"
        first = F.when(acc["above"]["indent"] == indent, acc["above"]["first"]).otherwise(acc["at"])
        # The innermost open function is indented furthest.
        closes = (F.size(acc["open"]) > 0) & (F.element_at(acc["open"], -1)["indent"] >= indent) & (line["kind"] != "")
        kept = F.when(closes, F.filter(acc["open"], lambda f: f["indent"] < indent)).otherwise(acc["open"])
        opened = F.when(header, F.array_append(kept, F.struct(indent.alias("indent"), acc["no"].alias("no"), first.alias("first")))).otherwise(kept)
        above = F.when(line["kind"] == "@", F.struct(indent.alias("indent"), first.alias("first"))).otherwise(F.struct(F.lit(-1).alias("indent"), F.lit(0).alias("first")))
        known = close(acc, acc["at"], closes, F.filter(acc["open"], lambda f: f["indent"] >= indent))
        return state(size=acc["size"], at=acc["at"] + line["size"], no=acc["no"] + header.cast("int"), open=opened, above=above, **known)

    none = F.lit(None).cast(_SPAN)
    zero = F.struct(F.length(text).alias("size"), F.lit(0).alias("at"), F.lit(0).alias("no"), F.array().alias("open"), F.struct(F.lit(-1).alias("indent"), F.lit(0).alias("first")).alias("above"), none.alias("inner"), none.alias("any"), F.array().alias("spans"))
    end = lambda acc: state(size=acc["size"], at=acc["at"], no=acc["no"], open=acc["open"], above=acc["above"], **close(acc, acc["size"], F.size(acc["open"]) > 0, acc["open"]))
    return F.aggregate(lines, zero.cast(_FOLD), step, end)


def function_blocks(text: Column) -> Column:
    """Places ``first`` and ``end`` of all function blocks, nested ones too, in order of their headers."""
    spans = F.array_sort(F.transform(_blocks(text, True)["spans"], lambda x: F.struct(x["no"].alias("no"), x["first"].alias("first"), x["end"].alias("end"))))
    return F.transform(spans, lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end")))


def split_functions(df: DataFrame, text_col: str = "text", language: str = "python") -> DataFrame:
    """``df`` and ``prefix, middle, suffix``: the middle is the function block nearest the middle of the text, inner blocks first.

    Of blocks equally near, the first header's is taken. A text without a block is halved and has no suffix; null texts give nulls.
    """
    check_language(language)
    text = F.col(text_col)
    found = _blocks(text, False)
    near = df.withColumn("__found", found).withColumn("__near", F.coalesce("__found.inner", "__found.any"))
    first, end = F.coalesce("__near.first", F.floor(F.length(text) / 2).cast("int")), F.coalesce("__near.end", F.length(text))
    parts = {"prefix": F.substring(text, F.lit(1), first), "middle": F.substring(text, first + 1, end - first), "suffix": F.substring(text, end + 1, F.length(text))}
    return near.withColumns(parts).drop("__found", "__near")


def parts_of(text: Column, k: int) -> Column:
    """``k`` consecutive parts; the first ``length % k`` are one character longer."""
    n = F.length(text)
    base, extra = F.floor(n / k).cast("int"), n % k

    def part(i: Column) -> Column:
        return F.substring(text, i * base + F.least(i, extra) + 1, base + F.when(i < extra, 1).otherwise(0))

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), part)


def growing(middle: Column, rounds: int) -> Column:
    """Of the middle in ``rounds + 1`` parts, the first two, the first three, ... all."""
    n, k = F.length(middle), rounds + 1
    base, extra = F.floor(n / k).cast("int"), n % k
    return F.transform(F.sequence(F.lit(2), F.lit(k)), lambda i: F.substring(middle, F.lit(1), i * base + F.least(i, extra)))


def efim_rounds(df: DataFrame, text_col: str, rounds: int = 5) -> DataFrame:
    """One row per round: the second half is the suffix, the prefix a ``rounds + 2``-th of the first half, and the middle grows by as much."""
    half = F.floor(F.length(text_col) / 2).cast("int")
    at = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    begin = F.floor(half / (rounds + 2)).cast("int")
    end = F.floor(half / F.lit(rounds + 2) * (F.col("round") + 2)).cast("int")
    text = F.col(text_col)
    return at.withColumns({"prefix": F.substring(text, F.lit(1), begin), "middle": F.substring(text, begin + 1, end - begin), "suffix": F.substring(text, half + 1, F.length(text))})


def middle_rounds(df: DataFrame, rounds: int = 5) -> DataFrame:
    """One row per round of ``prefix, middle, suffix``, the middle growing to the whole."""
    return df.select("*", F.posexplode(growing(F.col("middle"), rounds)).alias("round", "__middle")).withColumn("middle", F.col("__middle")).drop("__middle")


def function_rounds(df: DataFrame, text_col: str = "text", rounds: int = 5) -> DataFrame:
    """One row per round of a split at a function, the middle growing to the whole."""
    return middle_rounds(split_functions(df, text_col), rounds)


def line_split(text: Column, at: Column) -> Column:
    """``struct(before, current, after)`` of the line ``at``, from 0; the parts around it end in a newline."""
    lines = T.split_lines(text)
    before = F.concat(F.array_join(F.slice(lines, 1, at), "\n"), F.lit("\n"))
    after = F.concat(F.array_join(F.slice(lines, at + 2, F.greatest(F.size(lines) - at - 1, F.lit(0))), "\n"), F.lit("\n"))
    return F.struct(before.alias("before"), F.get(lines, at).alias("current"), after.alias("after"))


def ground_truth_span(df: DataFrame, text_col: str, key: Column, span: tuple[int, int] = (16, 128), margin: tuple[int, int] = (32, 160)) -> DataFrame:
    """``prefix, typed, groundtruth, suffix`` of a span drawn by ``key``; texts under the two margins together are left out."""
    text = F.col(text_col)
    long = df.where(F.length(text) >= margin[0] + margin[1])
    drawn = long.withColumn("__size", T.draw_between(key, 1, F.lit(span[0]), F.lit(span[1])).cast("int")).withColumn(
        "__begin", T.draw_between(key, 2, F.lit(margin[0]), F.length(text).cast("long") - margin[1]).cast("int")
    )
    drawn = drawn.withColumn("__cut", T.draw_between(key, 3, F.lit(1), F.col("__begin").cast("long") - 1).cast("int"))
    b, n, c = F.col("__begin"), F.col("__size"), F.col("__cut")
    return drawn.withColumns(
        {
            "prefix": F.substring(text, F.lit(1), c),
            "typed": F.substring(text, c + 1, b - c),
            "groundtruth": F.substring(text, b + 1, n),
            "suffix": F.substring(text, b + n + 1, F.length(text)),
        }
    ).drop("__size", "__begin", "__cut")


def prompt_cut(df: DataFrame, text_col: str, key: Column) -> DataFrame:
    """``prefix, typed``: the prompt cut at a drawn place, neither part empty; prompts under two characters are left out."""
    text = F.col(text_col)
    cut = df.where(F.length(text) >= 2).withColumn("__cut", T.draw_between(key, 1, F.lit(1), F.length(text).cast("long") - 1).cast("int"))
    return cut.withColumns({"prefix": F.substring(text, F.lit(1), F.col("__cut")), "typed": F.substring(text, F.col("__cut") + 1, F.length(text))}).drop("__cut")
