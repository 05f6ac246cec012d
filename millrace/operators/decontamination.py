"""N-gram decontamination of documents against evaluation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import membership as M
from millrace.functions import text as T

def sample_text(completion: DataFrame | None = None, infilling: DataFrame | None = None) -> DataFrame:
    """Distinct texts ``text`` of the two problem dialects, each its parts put together."""
    parts = []
    if completion is not None:
        parts.append(completion.select(F.concat("prompt", "groundtruth", "right_context").alias("text")))
    if infilling is not None:
        parts.append(infilling.select(F.concat("prompt", "canonical_solution", "suffix").alias("text")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _grams(w: Column, n: int, of) -> Column:
    """``of`` each run of ``n`` words of an array of at least as many."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: of(F.slice(w, i, n)))


def ngram_index(texts: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """Distinct n-grams ``ngram`` (words joined by one space) of all texts."""
    w = texts.select(T.words(F.col(text_col)).alias("w")).where(F.size("w") >= n)
    return w.select(F.explode(_grams(F.col("w"), n, lambda x: F.array_join(x, " "))).alias("ngram")).distinct()


def contaminated(docs: DataFrame, texts: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", eval_text_col: str = "text", filter_bytes: int = M.FILTER_BYTES) -> DataFrame:
    """Distinct ``id_col`` of documents that share a word n-gram with the evaluation texts.

    N-grams are of the whole content. A filter of the evaluation side's n-grams, of at most ``filter_bytes`` whatever their number, is
    probed in one scan of the documents; no n-gram is shuffled but those that it lets pass, which are then held against the n-grams
    themselves. Null texts have none; a null id is given once if a row with it shares one.
    """
    found = M.build_filter(texts, n, eval_text_col, filter_bytes)
    if found is None:
        return docs.select(id_col).limit(0)
    return M.probe(docs, found, n, id_col, text_col).join(ngram_index(texts, n, eval_text_col), "ngram", "left_semi").select(id_col).distinct()


def decontaminate(docs: DataFrame, texts: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", eval_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no word n-gram with the evaluation texts; their texts are read once, other columns as they are asked for."""
    bad = contaminated(docs, texts, n, id_col, text_col, eval_text_col).withColumnRenamed(id_col, "__id")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
