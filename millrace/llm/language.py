"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams by language where the texts lie; the driver gets one sum per language
and hash. The log-probability matrix, of bounded size, is broadcast. Texts are scored a batch at a time: the hashes of
all their n-grams are the rows of a sparse count matrix, which is multiplied with one column of the matrix after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_fold, small_batches, utf8
from .ngrams import code_points, ngram_ids

#: Hash bits; with many languages fewer, so that the matrix keeps within ``MATRIX_BYTES``.
BITS = 15
MATRIX_BYTES = 64 << 20
SIZES = (1, 2, 3, 4)
#: Most labelled rows that training reads, about; beyond it, rows are drawn by a hash of the text.
MAX_TRAIN_ROWS = 40_000
#: Contract: a language column holds at most so many values (there are about 7,000 languages).
MAX_LANGUAGES = 1 << 16
SMOOTHING = 0.5
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: n-grams scored at once.
SCORED_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Model:
    """``log_prob[l, h]`` is the log-probability of hash h in language l, ``prior`` that of the language."""

    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray

    @property
    def bits(self) -> int:
        return self.log_prob.shape[1].bit_length() - 1

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text and language."""
        out = np.tile(self.prior, (len(texts), 1))
        owner: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def product() -> None:
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            index, starts = np.concatenate(ids), np.cumsum(size) - size
            for k, row in enumerate(self.log_prob):
                np.add.at(out[:, k], owner, np.add.reduceat(row[index], starts))

        for i, text in enumerate(texts):
            for part in ngram_ids(code_points(text), SIZES, self.bits):
                if len(part):
                    owner.append(i)
                    ids.append(part)
                    held += len(part)
                if held >= SCORED_AT_ONCE:
                    product()
                    owner, ids, held = [], [], 0
        if held:
            product()
        return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def bits_for(languages: int) -> int:
    return max(1, min(BITS, (MATRIX_BYTES // 8 // max(1, languages)).bit_length() - 1))


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}

    def rows():
        for lang, count in seen.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(count[used])], names=["lang", "feature", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in seen and len(seen) << bits >= MATRIX_BYTES // 8:
                yield from rows()
                seen.clear()
            count = seen.setdefault(lang, np.zeros(1 << bits, np.int64))
            for ids in ngram_ids(code_points(text.as_py()), SIZES, bits):
                count += np.bincount(ids, minlength=1 << bits)
    yield from rows()


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Fit on the rows with a language; null texts are empty, repeated rows count each. None if there is no such row.

    About ``max_train_rows`` rows are read, as many of each language, drawn by a hash of the text; other columns are ignored.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    # Each language is drawn at a rate of its own, so a rare one is not lost.
    share, bits = max_train_rows / len(sizes), bits_for(len(sizes))
    rates = docs.sparkSession.createDataFrame([(x, int((1 << 30) * min(1.0, share / n))) for x, n in sizes.items()], "__lang string, __rate long")
    rows = known.select(F.col(lang_col).alias("lang"), utf8(text_col).alias("text")).join(F.broadcast(rates), F.col("lang") == F.col("__lang"))
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) < F.col("__rate")).select("lang", "text")
    got = rows.mapInArrow(lambda b: _counts(b, bits), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    number = {lang: i for i, lang in enumerate(languages)}
    count = np.zeros((len(languages), 1 << bits))
    row = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    count[row, got["feature"].to_numpy()] = got["n"].to_numpy()
    log_prob = np.log(count + SMOOTHING) - np.log((count + SMOOTHING).sum(axis=1, keepdims=True))
    prior = np.log(np.array([sizes[x] for x in languages]) / sum(sizes.values()))
    return Model(languages, prior, log_prob)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)``, one row per row of ``docs``; ``score`` is the posterior of the language.

    A null text, one without a letter, or any text under no model is ``und`` with score 0. Of languages equally likely the
    first by name is taken; long texts are hashed by chunks; repeated rows score alike; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            told = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if told:
                z = model.totals([texts[i] for i in told])
                best = z.argmax(axis=1)
                lang[told] = [model.languages[k] for k in best]
                score[told] = 1 / np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -700)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double")


def op9_language(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of all documents; rows of the held-out fold are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out_fold("doc_id", FOLDS)
    model = train(docs.where(fold != HELD_OUT).select("text", "lang"))
    return predict(docs, model).select("doc_id", (fold == HELD_OUT).alias("held_out"), "lang_pred", "score")
