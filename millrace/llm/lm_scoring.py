"""N-gram language model scoring with Elias-Fano tries.

Counts of words, pairs and triples over all training texts give a trigram model with Dirichlet smoothing: each order
adds so many occurrences shared out as the order below has them, down to add-one counts of words. An n-gram is named
by a hash and counted in the shard that its name falls into, so no word, however frequent, makes a large group.

The texts are dealt into parts of about ``PART_TOKENS`` tokens. A part sends the names of its distinct n-grams, with their
counts from training texts, to the shards and gets back their counts over the corpus: the slice of the model that its texts
ask for, which is all that a task holds. The slice becomes a trie in a memory-mapped file: of each level the word numbers and
the pointers to the next level are Elias-Fano sequences, and probabilities lie on a fixed grid of 16 bits. A word is looked
up by a successor search among the children of its context; the third level numbers a word by its place among
the followers of the word before it, which keeps numbers small.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, held_out_fold, letters_mix, materialise, small_batches, utf8
from .elias_fano import EliasFano

#: Tokens of a part, and about so many n-gram names in a shard.
PART_TOKENS, SHARD_NAMES = 3 << 18, 1 << 21
#: Bits of a name within its shard, of which the last tells words from others.
NAME_BITS = 44
#: Most shards, as a power of two.
MOST_SHARDS = 18
#: Occurrences that the order below adds to a context of one and of two words.
PAIR_WEIGHT, TRIPLE_WEIGHT = 5000.0, 30.0
#: Probabilities are kept as whole numbers of 1/GRID of minus their decimal logarithm.
GRID = 2048
#: Bytes of a row group of the parts, of a few megabytes a row, and of their sums.
GROUP_BYTES = 8 << 20
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
FOLDS, HELD_OUT = 7, 2
#: The end of a text, which also stands before its first word.
END = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAIR, _TRIPLE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.arange(1, 257, dtype=np.uint64)
_LETTER[65:91] += np.uint64(32)


def _powers(n: int, known: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:
    while len(known[0]) < n:
        known[0] = np.concatenate([known[0], known[0] * (known[0][-1:] * _BASE)])
    return known[0]


def word_hashes(block: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, texts)`` of the words in bytes that hold the texts between ``edges``; words are runs without 0x20 and 0x09-0x0D, A-Z lower-cased."""
    letters = np.flatnonzero(~_SPACE[block])
    if not len(letters):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    opens = np.diff(letters, prepend=-2) > 1
    here = np.zeros(len(block) + 1, bool)
    here[edges] = True
    opens |= here[letters]
    first = np.flatnonzero(opens)
    place = np.arange(len(letters)) - np.repeat(first, np.diff(np.append(first, len(letters))))
    terms = _LETTER[block[letters]] * _powers(int(place.max()) + 1)[place]
    return letters_mix(np.add.reduceat(terms, first)), np.searchsorted(edges, letters[first], "right") - 1


def _blocks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(first text, edges)`` of runs of whole texts of about ``CHUNK`` bytes; a longer text is cut at spaces into several."""
    k = 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, "right")) - 1)
        if at[end] - at[k] <= CHUNK:
            yield k, at[k : end + 1]
        else:
            a = int(at[k])
            while a < at[k + 1]:
                b = min(int(at[k + 1]), a + CHUNK)
                while b < at[k + 1]:
                    gap = np.flatnonzero(_SPACE[data[b : b + CHUNK]])
                    b = min(int(at[k + 1]), b + (int(gap[0]) if len(gap) else CHUNK))
                    if len(gap):
                        break
                yield k, np.array([a, b])
                a = b
        k = end


def _parts(batches: Iterator[pa.RecordBatch], part_tokens: int) -> Iterator[pa.RecordBatch]:
    """From rows ``(uid, id, held, text)`` parts of about ``part_tokens`` tokens; a text may go on in the next part, which repeats its last two words as context."""
    number = TaskContext.get().partitionId() << 33
    segments: list[list] = []  # uid, id, held, words of context, pieces
    held_tokens = 0

    def part():
        nonlocal number, held_tokens
        hashes = np.concatenate([x for s in segments for x in s[4]])
        words, tokens = np.unique(hashes, return_inverse=True)
        size = np.array([sum(map(len, s[4])) for s in segments])
        one = lambda x, kind: pa.array([x], kind)
        ids = pa.ListArray.from_arrays(pa.array([0, len(segments)], pa.int32()), pa.array([s[1] for s in segments], batch.column(1).type))
        columns = [one(number, pa.int64()), one([s[0] for s in segments], pa.list_(pa.int64())), ids, one([s[2] for s in segments], pa.list_(pa.bool_())), one([s[3] for s in segments], pa.list_(pa.int64())), one(size.tolist(), pa.list_(pa.int64())), one(words.tobytes(), pa.binary()), one(tokens.astype(np.uint32).tobytes(), pa.binary())]
        number, held_tokens = number + 1, 0
        segments.clear()
        return pa.RecordBatch.from_arrays(columns, names=["part", "uids", "ids", "held", "lead", "size", "words", "tokens"])

    def add(hashes: np.ndarray):
        nonlocal held_tokens
        while len(hashes):
            room = part_tokens - held_tokens
            segments[-1][4].append(hashes[:room])
            held_tokens += len(hashes[:room])
            hashes = hashes[room:]
            if held_tokens >= part_tokens and len(hashes):
                uid, id_, held, _, pieces = segments[-1]
                last = np.concatenate(pieces)[-2:]
                yield part()
                segments.append([uid, id_, held, len(last), [last]])

    for batch in batches:
        raw, at = byte_spans(batch.column(3))
        data = np.frombuffer(raw, np.uint8)
        uids, ids, held = (batch.column(i).to_pylist() for i in range(3))
        now = -1
        for k, edges in _blocks(data, at):
            hashes, text = word_hashes(data[edges[0] : edges[-1]], edges - edges[0])
            cuts = np.searchsorted(text, np.arange(len(edges)))
            for j in range(len(edges) - 1):
                if k + j != now:
                    if now >= 0:
                        yield from add(np.array([END]))
                    if held_tokens >= part_tokens:
                        yield part()
                    now = k + j
                    segments.append([uids[now], ids[now], held[now], 1, [np.array([END])]])
                yield from add(hashes[cuts[j] : cuts[j + 1]])
        if now >= 0:
            yield from add(np.array([END]))
    if segments:
        yield part()


@dataclass
class Grams:
    """The n-grams of a part: words, pairs and triples in the order of the trie, and where the tokens have them."""

    words: np.ndarray
    tokens: np.ndarray
    begin: np.ndarray
    #: Tokens that are scored; of each token its pair, of each scored one with two words before it its triple.
    scored: np.ndarray
    pair_of: np.ndarray
    third: np.ndarray
    triple_of: np.ndarray
    pairs: np.ndarray
    triples: np.ndarray
    #: The pair of a triple's last two words.
    tail: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, tokens: np.ndarray, size: np.ndarray, lead: np.ndarray) -> Grams:
        begin = np.cumsum(size) - size
        since = np.arange(len(tokens)) - np.repeat(begin, size)
        tokens, many = tokens.astype(np.int64), len(words)
        second = np.flatnonzero(since >= 1)
        pairs, inverse = np.unique(tokens[second - 1] * many + tokens[second], return_inverse=True)
        pair_of = np.full(len(tokens), -1, np.int64)
        pair_of[second] = inverse
        scored = np.flatnonzero(since >= np.repeat(lead, size))
        third = scored[since[scored] >= 2]
        triples, first, triple_of = np.unique(pair_of[third - 1] * many + tokens[third], return_index=True, return_inverse=True)
        return cls(words, tokens, begin, scored, pair_of, third, triple_of, pairs, triples, pair_of[third[first]])

    def names(self, shards: int) -> np.ndarray:
        """Names of all words, pairs and triples: the shard, of ``2**shards``, and ``NAME_BITS`` within it; those of words are odd, others even."""
        many, odd = len(self.words), np.uint64(1)
        before, last = self.words[self.pairs // many], self.words[self.pairs % many]
        pair = letters_mix(before * _PAIR + last)
        triple = letters_mix(pair[self.triples // many] * _TRIPLE + self.words[self.triples % many])
        cut = np.uint64(65 - NAME_BITS - shards)
        return np.concatenate([self.words >> cut << odd | odd, pair >> cut << odd, triple >> cut << odd])

    def counts(self, known: np.ndarray) -> np.ndarray:
        """How often each occurs among the scored tokens that ``known`` marks."""
        use, use3 = self.scored[known[self.scored]], known[self.third]
        return np.concatenate([np.bincount(self.tokens[use], minlength=len(self.words)), np.bincount(self.pair_of[use], minlength=len(self.pairs)), np.bincount(self.triple_of[use3], minlength=len(self.triples))])


def _grid(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-GRID * np.log10(p)), 65535).astype(np.uint16)


def _monotone(ids: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Numbers that rise within each parent's children, made to rise throughout: each range starts after the last number of the one before."""
    if not len(ids):
        return ids
    ends = np.flatnonzero(np.append(parent[1:] != parent[:-1], True))
    base = np.concatenate([[0], np.cumsum(ids[ends] + 1)])
    return ids + np.repeat(base[:-1], np.diff(np.concatenate([[-1], ends])))


class Trie:
    """Words, pairs and triples that occur in training texts, in memory-mapped levels."""

    def __init__(self, grams: Grams, counts: np.ndarray, total: int, distinct: int) -> None:
        many, n2 = len(grams.words), len(grams.pairs)
        one, two, three = np.split(counts.astype(np.float64), [many, many + n2])
        v, w = grams.pairs // many, grams.pairs % many
        lead = grams.triples // many
        # No n-gram occurs more often than its parts. A sum breaks this only where two n-grams have one name; a triple without its pairs has no place below.
        two = np.minimum(two, np.minimum(one[v], one[w]))
        three = np.minimum(three, np.minimum(two[lead], two[grams.tail]))
        p1 = (one + 1) / (total + distinct + 1)
        p2 = (two + PAIR_WEIGHT * p1[w]) / (one[v] + PAIR_WEIGHT)
        p3 = (three + TRIPLE_WEIGHT * p2[grams.tail]) / (two[lead] + TRIPLE_WEIGHT)
        has2, has3 = np.flatnonzero(two), np.flatnonzero(three)
        place = np.full(n2, -1, np.int64)
        place[has2] = np.arange(len(has2))
        to_pairs = np.searchsorted(v[has2], np.arange(many + 1))
        to_triples = np.searchsorted(place[lead[has3]], np.arange(len(has2) + 1))
        rank = place[grams.tail[has3]] - to_pairs[v[grams.tail[has3]]]
        levels = [EliasFano.of(to_pairs), EliasFano.of(_monotone(w[has2], v[has2])), EliasFano.of(to_triples), EliasFano.of(_monotone(rank, lead[has3]))]
        plain = [_grid(p1), _grid(PAIR_WEIGHT / (one + PAIR_WEIGHT)), _grid(p2[has2]), _grid(TRIPLE_WEIGHT / (two[has2] + TRIPLE_WEIGHT)), _grid(p3[has3])]
        mapped = iter(_mapped([*(a for e in levels for a in e.arrays), *plain]))
        self.to_pairs, self.pair_words, self.to_triples, self.triple_ranks = (EliasFano(e.n, e.low_bits, [next(mapped) for _ in e.arrays]) for e in levels)
        self.word, self.word_back, self.pair, self.pair_back, self.triple = mapped

    @staticmethod
    def _child(level: EliasFano, number: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place among the children ``first`` to ``end`` of the one with this number relative to them; -1 if there is none."""
        # Children asked for one after another have the same context: its base is looked up once.
        runs = np.flatnonzero(np.diff(first, prepend=-1))
        base = np.zeros(len(runs), np.int64)
        inner = first[runs] > 0
        base[inner] = level[first[runs][inner] - 1] + 1
        return level.find(number + np.repeat(base, np.diff(np.append(runs, len(first)))), first, end)

    def find_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._child(self.pair_words, w, self.to_pairs[v], self.to_pairs[v + 1])

    def find_triples(self, lead: np.ndarray, v: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Triples by the places of their first two and of their last two words; -1 where either is."""
        out = np.full(len(lead), -1, np.int64)
        known = np.flatnonzero((lead >= 0) & (pair >= 0))
        lead, rank = lead[known], pair[known] - self.to_pairs[v[known]]
        out[known] = self._child(self.triple_ranks, rank, self.to_triples[lead], self.to_triples[lead + 1])
        return out

    def score(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Decimal logarithms of the probabilities of all pairs and triples."""
        many = len(grams.words)
        v, w = grams.pairs // many, grams.pairs % many
        at2 = self.find_pairs(v, w)
        q2 = self.word_back[v].astype(np.int64) + self.word[w]
        q2[at2 >= 0] = self.pair[at2[at2 >= 0]]
        lead = at2[grams.triples // many]
        at3 = self.find_triples(lead, v[grams.tail], at2[grams.tail])
        q3 = q2[grams.tail]
        q3[lead >= 0] += self.pair_back[lead[lead >= 0]]
        q3[at3 >= 0] = self.triple[at3[at3 >= 0]]
        return q2 / -GRID, q3 / -GRID


def _mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The same arrays in a memory-mapped file of the task, which is gone when nothing uses it."""
    with tempfile.TemporaryFile() as f:
        places = []
        for a in arrays:
            f.write(b"\0" * (-f.tell() % 8))
            places.append(f.tell())
            f.write(a.tobytes())
        f.write(b"\0" * 8)
        f.flush()
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, a.dtype, len(a), p) for a, p in zip(arrays, places)]


def _of_row(row: dict) -> tuple[Grams, np.ndarray]:
    """The n-grams of a part, and which of its tokens belong to training texts."""
    size = np.array(row["size"], np.int64)
    grams = Grams.of(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], np.uint32), size, np.array(row["lead"], np.int64))
    return grams, np.repeat(~np.array(row["held"], bool), size)


def _planes(counts: np.ndarray) -> bytes:
    """Numbers by their first bytes, their second bytes, ..., as small ones then compress to little."""
    return counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _counts_of(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _sent(shards: int):
    """Rows ``(shard, part, names, counts)`` of each part; the names of a shard are in order and in Elias-Fano form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams, known = _of_row(row)
                names = grams.names(shards)
                order = np.argsort(names)
                names, counts = names[order].astype(np.int64), grams.counts(known)[order]
                cuts = np.searchsorted(names >> NAME_BITS, np.arange((1 << shards) + 1))
                inner = names & ((1 << NAME_BITS) - 1)
                for s in range(0, 1 << shards, 256):
                    own = range(s, min(1 << shards, s + 256))
                    sent = [EliasFano.of(inner[cuts[k] : cuts[k + 1]]).to_bytes() for k in own], [_planes(counts[cuts[k] : cuts[k + 1]]) for k in own]
                    columns = [pa.array(own, pa.int32()), pa.array([row["part"]] * len(own), pa.int64()), *(pa.array(x, pa.binary()) for x in sent)]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "names", "counts"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Sums of a shard, given back to each part in the order of its names; a row with part -1 has the training tokens and distinct words of the shard."""
    names = [EliasFano.from_bytes(x.as_py()).values() for x in table["names"]]
    ends = np.cumsum([len(x) for x in names])
    distinct, inverse = np.unique(np.concatenate(names), return_inverse=True)
    sums = np.bincount(inverse, np.concatenate([_counts_of(x) for x in table["counts"]]), len(distinct)).astype(np.int64)
    words = sums[(distinct & 1) == 1]
    sent = [_planes(x) for x in np.split(sums[inverse], ends)]
    n = len(sent)
    columns = [[*table["part"].to_pylist(), -1], [table["shard"][0].as_py()] * n, sent, [0] * (n - 1) + [int(words.sum())], [0] * (n - 1) + [int((words > 0).sum())]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["part", "shard", "sums", "tokens", "distinct"])


def _scored(total: int, distinct: int, shards: int, kind: pa.DataType):
    def run(part: pa.Table, sums: pa.Table) -> pa.Table:
        out = []
        for row in part.to_pylist():
            grams, _ = _of_row(row)
            order = np.argsort(sums["shard"].to_numpy())
            got = np.concatenate([_counts_of(sums["sums"][k]) for k in order.tolist()])
            counts = np.empty(len(got), np.int64)
            counts[np.argsort(grams.names(shards))] = got
            two, three = Trie(grams, counts, total, distinct).score(grams)
            score = two[grams.pair_of]
            score[grams.third] = three[grams.triple_of]
            words = counts[: len(grams.words)]
            base = np.log10((words + 1) / (total + distinct + 1))
            mark = np.zeros(len(grams.tokens), np.int64)
            mark[grams.scored] = 1
            own = lambda x: np.add.reduceat(np.where(mark, x, 0), grams.begin)
            columns = [pa.array(row["uids"], pa.int64()), pa.array(row["ids"], kind), pa.array(row["held"], pa.bool_()), pa.array(own(mark)), pa.array(own((words > 0)[grams.tokens].astype(np.int64))), pa.array(own(base[grams.tokens])), pa.array(own(score))]
            out.append(pa.Table.from_arrays(columns, names=["uid", "id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else None

    return run


def model_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS, shard_names: int = SHARD_NAMES) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    The model learns from all rows for which the column ``held_out`` is false and scores all rows. Tokens are words, A-Z lower-cased, and one
    end, which counts as a token and stands before the first word too. ``score`` is the text's decimal log-probability under the
    trigram model, of which each token's is rounded to 1/2048; ``base_score`` that under add-one word counts; ``n_known`` counts tokens that
    training texts have. Null and empty texts are their end alone; repeated rows count and are scored each; null ids stay; texts of any length
    are cut into parts; without training texts every token has probability 1; an empty table gives an empty result; other columns are
    ignored. Of the 2^21 or so names of a shard, a quarter of a pair is to be expected to be one by chance.
    """
    spark = small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), utf8(text_col).alias("text"))
    schema = f"part long, uids array<long>, ids array<{kind}>, held array<boolean>, lead array<long>, size array<long>, words binary, tokens binary"
    parts = materialise(rows.mapInArrow(lambda b: _parts(b, part_tokens), schema), "parts", GROUP_BYTES)
    # About two names a token, of four bytes.
    names = (parts.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 2
    shards = min(MOST_SHARDS, max(0, names // shard_names).bit_length())
    sums = parts.mapInArrow(_sent(shards), "shard int, part long, names binary, counts binary").groupBy("shard").applyInArrow(_summed, "part long, shard int, sums binary, tokens long, distinct long")
    sums = materialise(sums, "sums", GROUP_BYTES)
    total, distinct = (x or 0 for x in sums.where("part = -1").agg(F.sum("tokens"), F.sum("distinct")).first())
    arrow = parts.select("ids").limit(0).toArrow().schema.field("ids").type.value_type
    found = parts.groupBy("part").cogroup(sums.where("part >= 0").select("part", "shard", "sums").groupBy("part")).applyInArrow(_scored(total, distinct, shards, arrow), f"uid long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # A text that went over several parts gets the sum of their scores.
    whole = found.groupBy("uid").agg(F.first("id").alias(id_col), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select(id_col, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op13_lm_scores(spark, sf_dir):
    """Model scores of all documents; rows of the held-out fold are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return model_scores(docs, held_out_fold("doc_id", FOLDS) == HELD_OUT)
