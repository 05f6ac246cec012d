"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Votes are counted by
pattern, of which there are at most three to the power of the labellers, and expectation-maximisation
estimates each labeller's accuracies and the share of good documents from the counts. The
patterns' posteriors are soft labels of a bounded sample, on which a hashed linear scorer is
trained; it scores every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, materialise, utf8
from .ngrams import logistic, ngram_counts, sigmoid
from .quality_rules import features, text_stats

GOOD, BAD, NONE = 1, 0, 2
BITS = 14
#: Texts that train the scorer, about; drawn by a hash of the text.
TRAIN_ROWS = 6_000
L2 = 1e-5
ROUNDS, TOLERANCE = 200, 1e-9
#: Share of documents without its fault that a labeller is believed to call bad, and the share of all documents that this belief weighs.
FALSE_BAD, BELIEF = 0.005, 0.05
#: What each labeller looks for: 0 repetition, 1 noise and fragments, 2 shouting.
FAMILIES = {"length": 1, "repeats": 0, "variety": 0, "symbols": 1, "shouting": 2, "marks": 2, "lines": 0, "stops": 1, "word_size": 1}


def labellers() -> dict[str, Column]:
    """The heuristics, on the columns of :func:`quality_rules.features`. They overlap; each may abstain."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)

    n = F.col("n_words")
    return {
        "length": vote(n < 5, n >= 30),
        "repeats": vote(F.col("repeat_share") > 0.3, F.col("repeat_share") < 0.1),
        "variety": vote((F.col("distinct_share") < 0.25) & (n < 2000), F.col("distinct_share") > 0.5),
        "symbols": vote(F.col("symbols_per_char") > 0.03, F.col("symbols_per_char") < 0.005),
        "shouting": vote(F.col("upper_share") > 0.3, F.col("upper_share") < 0.1),
        "marks": vote(F.col("mark_share") > 0.2, F.col("mark_share") < 0.05),
        "lines": vote(F.col("dup_line_share") > 0.3, F.col("dup_line_share") < 0.05),
        "stops": vote((F.col("bare_share") > 0.995) & (n >= 50), F.col("bare_share") < 0.97),
        "word_size": vote((F.col("chars_per_word") > 12) | (F.col("chars_per_word") < 2.5), F.col("chars_per_word").between(3.5, 8)),
    }


@dataclass(frozen=True)
class LabelModel:
    """Class 0 is good; class 1 + f is the fault of family f, which labeller k looks for if ``family[k]`` is f.

    ``seen[k, v]`` is the probability that labeller k casts vote v on a document that has its fault, ``unseen[k, v]`` on any
    other. Labellers of one family overlap: where they disagree, their estimated accuracies decide. One
    class for all bad documents would not do, as a fault that one family sees the others rightly call good.
    """

    prior: np.ndarray
    seen: np.ndarray
    unseen: np.ndarray
    family: np.ndarray

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each class for rows of votes."""
        z = np.tile(np.log(self.prior), (len(votes), 1))
        for k, f in enumerate(self.family):
            other = np.log(self.unseen[k])[votes[:, k]]
            z += other[:, None]
            z[:, 1 + f] += np.log(self.seen[k])[votes[:, k]] - other
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        return self.classes(votes)[:, 0]

    def accuracies(self) -> np.ndarray:
        """Of each labeller's votes that are not abstentions, the expected share that is right about its fault."""
        there = self.prior[1:][self.family]
        right = there * self.seen[:, BAD] + (1 - there) * self.unseen[:, GOOD]
        cast = there * (1 - self.seen[:, NONE]) + (1 - there) * (1 - self.unseen[:, NONE])
        return right / np.maximum(cast, 1e-12)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, family: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns, how often each occurs, and each labeller's family.

    It starts with a document's classes in proportion to the bad votes of their families. Every probability is
    smoothed by one pseudo-count, so none is 0. Thresholds are set where good documents rarely are, so
    before any vote is seen ``FALSE_BAD`` of them are taken to exceed one; this belief weighs as
    much as ``BELIEF`` of the documents, and votes that say otherwise outweigh it.
    """
    counts, family = counts.astype(float), np.asarray(family)
    m, kinds, total = votes.shape[1], int(family.max(initial=-1)) + 1, counts.sum()
    bad = votes == BAD
    post = np.hstack([np.full((len(votes), 1), 0.5), *(bad[:, family == f].sum(axis=1, keepdims=True) for f in range(kinds))]).astype(float)
    post /= post.sum(axis=1, keepdims=True)
    model = LabelModel(np.full(kinds + 1, 1 / (kinds + 1)), np.full((m, 3), 1 / 3), np.full((m, 3), 1 / 3), family)
    for _ in range(rounds):
        weight = counts[:, None] * post
        seen, unseen = np.ones((m, 3)), np.ones((m, 3))
        unseen[:, BAD] += BELIEF * total * FALSE_BAD
        unseen[:, GOOD] += BELIEF * total * (1 - FALSE_BAD)
        for k in range(m):
            has = weight[:, 1 + family[k]]
            seen[k] += np.bincount(votes[:, k], has, 3)
            unseen[k] += np.bincount(votes[:, k], weight.sum(axis=1) - has, 3)
        prior = (weight.sum(axis=0) + 1) / (total + kinds + 1)
        model = LabelModel(prior, seen / seen.sum(axis=1, keepdims=True), unseen / unseen.sum(axis=1, keepdims=True), family)
        new = model.classes(votes)
        moved = np.abs(new - post).max(initial=0)
        post = new
        if moved < TOLERANCE:
            break
    return model


def _vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: frequencies of raw byte pairs and of byte classes in fours, and bucketed size and compressibility."""
    half = 1 << (BITS - 1)
    raw, shape = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(_CLASSES), np.uint8)
    index, value = [], []
    for shift, points, n, bits in ((0, raw, 2, BITS - 1), (half, shape, 4, BITS - 2)):
        at, many = ngram_counts(points, (n,), bits)
        if len(at):
            index.append(shift + at)
            value.append(np.sqrt(many / many.sum()))
    squeezed = sum(len(zlib.compress(text[a : a + (1 << 20)], 1)) for a in range(0, len(text), 1 << 20)) / max(1, len(text))
    buckets = [min(int(squeezed * 32), 63), 64 + len(text).bit_length(), 128 + min(127, len(text) // 32)]
    index.append(half + (half >> 1) + np.array(buckets))
    value.append(np.ones(len(buckets)))
    return np.concatenate(index), np.concatenate(value)


def _class_table() -> bytes:
    out = bytearray(range(256))
    for kind, members in (("a", range(97, 123)), ("A", range(65, 91)), ("0", range(48, 58)), ("e", range(128, 256))):
        for b in members:
            out[b] = ord(kind)
    return bytes(out)


_CLASSES = _class_table()


@dataclass(frozen=True)
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        index, value = _vector(text)
        return float(sigmoid(self.bias + (self.weight[index] * value).sum()))


def vote_pattern() -> Column:
    """All votes as one number, base 3."""
    out = F.lit(0)
    for column in labellers().values():
        out = out * 3 + column
    return out


def _unpack(patterns: np.ndarray) -> np.ndarray:
    n = len(labellers())
    return np.stack([patterns // 3 ** (n - 1 - k) % 3 for k in range(n)], axis=1)


def train(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[Scorer, LabelModel, DataFrame]:
    """The scorer, the label model, and ``(text_key, pattern, posterior)`` of every row's text.

    Votes cover all rows; about ``train_rows`` rows, drawn evenly among good and bad, train the scorer. Null texts are
    empty; repeated texts are drawn together and weigh as often as they occur; long texts are hashed by chunks; an empty table
    gives a scorer that calls everything even; other columns are ignored, whatever their names.
    """
    keyed = docs.select(F.xxhash64(utf8(text_col)).alias("text_key"), text_col)
    votes = materialise(features(text_stats(keyed, ("text_key",), text_col)).select("text_key", vote_pattern().alias("pattern")), "votes")
    got = votes.groupBy("pattern").count().toPandas().sort_values("pattern")
    patterns, counts = got["pattern"].to_numpy(np.int64), got["count"].to_numpy(np.int64)
    unpacked = _unpack(patterns)
    model = fit_label_model(unpacked, counts, np.array([FAMILIES[k] for k in labellers()]))
    post = model.posterior(unpacked) if len(patterns) else np.zeros(0)
    known = docs.sparkSession.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, post)], "pattern int, posterior double")
    judged = votes.join(F.broadcast(known), "pattern")
    # Good and bad texts are drawn at rates of their own and weighed back.
    sizes = {True: int(counts[post >= 0.5].sum()), False: int(counts[post < 0.5].sum())}
    rates = {k: min(1.0, train_rows / 2 / max(1, n)) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64("text_key", F.lit(13)), F.lit(1 << 30))
    share = F.when(F.col("posterior") >= 0.5, int(rates[True] * (1 << 30))).otherwise(int(rates[False] * (1 << 30)))
    # Equal texts have one key and are drawn together: one of each is taken, weighed by how many there are.
    drawn = judged.where(draw < share).groupBy("text_key").agg(F.first("posterior").alias("posterior"), F.count("*").alias("n"))
    rows = docs.select(F.xxhash64(utf8(text_col)).alias("text_key"), utf8(text_col).alias("text")).join(F.broadcast(drawn), "text_key").dropDuplicates(["text_key"])
    sample = rows.select("text_key", "text", "posterior", "n").mapInArrow(_vectors, "text_key long, posterior double, n long, index array<int>, value array<double>").toArrow()
    target, copies = sample["posterior"].to_numpy(), sample["n"].to_numpy().astype(float)
    lists = [np.asarray(x, np.int64) for x in sample["index"].to_pylist()]
    values = [np.asarray(x, float) for x in sample["value"].to_pylist()]
    weight = copies / np.where(target >= 0.5, rates[True], rates[False])
    w, b = logistic(lists, values, target, weight, 1 << BITS, L2) if len(lists) else (np.zeros(1 << BITS), 0.0)
    return Scorer(w, b), model, judged


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["text_key", "posterior", "n", "index", "value"]
    for batch in batches:
        data, at = byte_spans(batch.column(1))
        made = [_vector(bytes(data[a:b])) for a, b in zip(at, at[1:])]
        columns = [batch.column(0), batch.column(2), batch.column(3), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)``, one row per row of ``docs``; null and empty texts are scored as empty, repeated rows alike.

    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_spans(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held.value.score(bytes(data[a:b])) for a, b in zip(at, at[1:])], pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def op1_weak_labels(spark, sf_dir):
    """doc_id, score (probability of good quality) and kept (score >= 0.5) of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer, _, _ = train(docs)
    return score(docs, scorer).select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))
