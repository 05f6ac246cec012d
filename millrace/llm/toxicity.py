"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence counts by class over the training rows give each hashed n-gram the log ratio of its shares of the
classes' smoothed counts. The n-grams whose ratio is best supported are the features, each
scaled by its ratio; a logistic model is fitted on them. Scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_fold, utf8
from .ngrams import code_points, logistic, ngram_ids, sigmoid

BITS = 20
SIZES = (4, 5, 6, 7)
#: Most labelled rows of each class that training reads; beyond it, rows are drawn by a hash of the id and weigh more.
MAX_TRAIN_ROWS = 10_000
#: Most features, by support of their ratio.
MAX_FEATURES = 4096
SMOOTHING = 1.0
L2 = 1e-4
FOLDS = 5


def _present(text: str, sizes: tuple[int, ...], bits: int, among: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed n-grams of a text's characters (of those that ``among`` marks), in lower case, a space at either end."""
    found = [np.unique(x if among is None else x[among[x]]) for x in ngram_ids(code_points(f" {text} "), sizes, bits)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    used: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def score(self, text: str) -> float:
        return float(sigmoid(self.bias + self.weight[_present(text, self.sizes, self.bits, self.used)].sum()))


def _counts(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], bits: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << bits), np.int32)
    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[y][_present(text.as_py(), sizes, bits)] += 1
    used = np.flatnonzero(seen.any(axis=0))
    for k in range(0, len(used), 1 << 16):
        part = used[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part], pa.int64()), pa.array(seen[1][part], pa.int64())], names=["feature", "n0", "n1"])


def log_count_ratio(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the ratio of an n-gram's shares of all smoothed counts of class 1 and of class 0."""
    p, q = n1 + SMOOTHING, n0 + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train_rows: int = MAX_TRAIN_ROWS, sizes: tuple[int, ...] = SIZES, bits: int = BITS, max_features: int = MAX_FEATURES, l2: float = L2) -> Model:
    """Fit on the texts of labelled rows (0 or 1; other, null and conflicting labels of an id are left out).

    At most about ``max_train_rows`` ids a class are read, weighted back to the classes' shares. One class or none gives a
    constant model, and so does an empty table. A null text is an empty one; a repeated id's rows all count; long texts
    are hashed by chunks; features of equal support go by their hash; other columns of either table are ignored, whatever their names.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("__hi"))
    known = known.where("y = __hi").select("__id", F.col("y").cast("int").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(shares) < 2:
        return Model(np.zeros(1 << bits), np.zeros(1 << bits, bool), 4.0 if shares.get(1) else -4.0, sizes, bits)
    rates = {y: min(1.0, max_train_rows / n) for y, n in shares.items()}
    draw = F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 30))
    known = known.where(draw < F.when(F.col("y") == 1, int(rates[1] * (1 << 30))).otherwise(int(rates[0] * (1 << 30))))
    # The drawn ids are bounded by max_train_rows, so they may be broadcast and the texts stay where they are.
    rows = docs.select(F.col(id_col).alias("__key"), utf8(text_col).alias("text")).join(F.broadcast(known), F.col("__key") == F.col("__id")).select("y", "text")
    got = rows.mapInArrow(lambda b: _counts(b, sizes, bits), "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    at, n0, n1 = (got[c].to_numpy() for c in ("feature", "n0", "n1"))
    ratio = log_count_ratio(n0, n1)
    support = np.abs(ratio) / np.sqrt(1 / (n1 + SMOOTHING) + 1 / (n0 + SMOOTHING))
    order = np.lexsort([at, -support])[:max_features]
    order = order[support[order] > 2]
    at, ratio = at[order], ratio[order]
    place = np.full(1 << bits, -1, np.int32)
    place[at] = np.arange(len(at))
    kept = place >= 0

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place[_present(text.as_py(), sizes, bits, kept)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "features"])

    sample = rows.mapInArrow(active, "y int, features array<int>").toArrow()
    target = sample["y"].to_numpy().astype(float)
    lists = [np.asarray(x.values.to_numpy(zero_copy_only=False) if x.values is not None else [], np.int64) for x in sample["features"]]
    weight = np.where(target == 1, 1 / rates[1], 1 / rates[0])
    w, b = logistic(lists, [ratio[x] for x in lists], target, weight, len(at), l2)
    full = np.zeros(1 << bits)
    full[at] = w * ratio
    return Model(full, full != 0, b, sizes, bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)``, one row per row of ``docs``; repeated rows score alike, null and empty texts get a score too.

    An empty table gives an empty result; other columns are ignored, whatever their names. The model's size is fixed by its bits.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [held.value.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def op7_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of all documents; rows of fold 0 are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(held_out_fold("doc_id", FOLDS) != 0))
    out = score(docs, model)
    return out.select("doc_id", (held_out_fold("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
