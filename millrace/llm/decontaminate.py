"""Benchmark decontamination by greedy string tiling.

Documents and items are sequences of lower-cased words. A Karp-Rabin rolling hash runs over
every whole document and joins its ``min_match``-word seeds to those of the items; seeds that
follow each other on a diagonal grow into matches. The longest match is marked again and again,
non-overlapping on both sides, and the tiles' share of the item's words decides. Order does not
matter, so reordered passages are caught.

The benchmark side is taken in blocks of bounded size; each block's seeds are broadcast and joined in one scan of
the documents, without a shuffle, and a document never leaves its task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, utf8

#: Words of the shortest tile, and the share of an item's words that makes a document contaminated.
MIN_MATCH = 5
COVERAGE = 0.5
#: Words of benchmark items that one scan of the documents is held against.
BLOCK_WORDS = 500_000

#: Equal seeds of a document and items that are listed at once; of more, each item's are listed diagonal by diagonal.
HITS_AT_ONCE = 1 << 20
#: Characters from which on a text's words are not listed.
LONG_TEXT = 1 << 20

_word = re.compile(r"\w+")
_BASE = np.uint64(0x100000001B3)


def words_of(text: str) -> Iterator[str]:
    """The text's words in lower case, one at a time for long texts."""
    text = text.lower()
    return iter(_word.findall(text)) if len(text) < LONG_TEXT else (m.group() for m in _word.finditer(text))


def _roll(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every window of ``k`` ids; numbers wrap modulo 2^64."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        out = out * _BASE + ids[j : j + len(out)].astype(np.uint64) + np.uint64(1)
    return out


@dataclass(frozen=True)
class Index:
    """Items of one block: word numbers, and their seeds in order of hash."""

    ids: list
    words: dict[str, int]
    items: list[np.ndarray]
    seed: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    min_match: int

    @classmethod
    def of(cls, rows: list[tuple[object, list[str]]], min_match: int) -> Index:
        words: dict[str, int] = {}
        items = [np.array([words.setdefault(w, len(words)) for w in ws], np.int64) for _, ws in rows]
        seeds = [_roll(x, min_match) for x in items]
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds])
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        return cls([i for i, _ in rows], words, items, seed[order], owner[order], place[order], min_match)

    def shared(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(place, hash, first, count)`` of a document's seeds that items have too, and where in the index."""
        known = np.convolve(ids < 0, np.ones(self.min_match), "valid") == 0 if len(ids) >= self.min_match else np.zeros(0, bool)
        at = np.flatnonzero(known)
        hashes = _roll(ids, self.min_match)[at]
        lo, hi = np.searchsorted(self.seed, hashes, "left"), np.searchsorted(self.seed, hashes, "right")
        own = hi > lo
        return at[own], hashes[own], lo[own], (hi - lo)[own]

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, Callable]]:
        """``(item, places of it under shared seeds, function that gives the maximal matches)`` of every item that shares a seed."""
        at, hashes, lo, count = self.shared(ids)
        if not len(at):
            return
        if count.sum() <= HITS_AT_ONCE:
            spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            owner, place, at = self.owner[spot], self.place[spot], np.repeat(at, count)
            order = np.argsort(owner, kind="stable")
            bounds = np.append(np.flatnonzero(np.diff(owner[order], prepend=-1)), len(order))
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = order[a:b]
                k = int(owner[own[0]])
                yield k, place[own], lambda k=k, own=own: runs_of(self.items[k], ids, place[own], at[own], self.min_match)
            return
        by = np.lexsort([at, hashes])
        hashes, at = hashes[by], at[by]
        firsts, many = np.unique(lo, return_index=True)
        spans = [self.owner[a : a + n] for a, n in zip(firsts.tolist(), count[many].tolist())]
        for k in np.unique(np.concatenate(spans)).tolist():
            seeds = _roll(self.items[k], self.min_match)
            a, b = np.searchsorted(hashes, seeds, "left"), np.searchsorted(hashes, seeds, "right")
            yield k, np.flatnonzero(b > a), lambda k=k, a=a, b=b: self._by_diagonals(k, ids, at, a, b)

    def _by_diagonals(self, k: int, ids: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The maximal matches of one item, a band of diagonals at a time; ``at[first[p] : end[p]]`` are the places of seed p."""
        item = self.items[k]
        step = max(1, HITS_AT_ONCE // len(item))
        found = []
        spots = [at[a:b] for a, b in zip(first.tolist(), end.tolist())]
        for low in range(-len(item), len(ids), step):
            inside = [x[slice(*np.searchsorted(x, [p + low, p + low + step]))] for p, x in enumerate(spots)]
            place = np.repeat(np.arange(len(spots)), [len(x) for x in inside])
            if len(place):
                found.append(runs_of(item, ids, place, np.concatenate(inside), self.min_match))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(item: np.ndarray, doc: np.ndarray, place: np.ndarray, at: np.ndarray, min_match: int) -> np.ndarray:
    """Maximal matches ``(length, place, at)`` from seeds that item and document share; seeds are verified word by word."""
    same = np.ones(len(place), bool)
    for j in range(min_match):
        same &= item[place + j] == doc[at + j]
    place, at = place[same], at[same]
    order = np.lexsort([place, at - place])
    place, at = place[order], at[order]
    if not len(place):
        return np.zeros((0, 3), np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(at) != 1)]))
    size = np.diff(np.append(fresh, len(place))) + min_match - 1
    return np.stack([size, place[fresh], at[fresh]], axis=1)


def tile(item_words: int, doc_words: int, matches: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(place, at, length)``: the longest match first, of equally long ones the first in the item, then in the document."""
    heap = [(-n, p, a) for n, p, a in matches.tolist()]
    heapq.heapify(heap)
    free_item, free_doc = np.ones(item_words, bool), np.ones(doc_words, bool)
    tiles = []
    while heap:
        n, p, a = heapq.heappop(heap)
        n = -n
        free = free_item[p : p + n] & free_doc[a : a + n]
        if free.all():
            free_item[p : p + n] = free_doc[a : a + n] = False
            tiles.append((p, a, n))
            continue
        # Partly taken by a longer tile: what is left of it may still be tiles.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= min_match:
                heapq.heappush(heap, (s - e, p + s, a + s))
    return tiles


def found_in(text: str, index: Index, coverage: float) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Items of the block that the text holds to ``coverage`` or more, with their tiles."""
    get = index.words.get
    ids = np.fromiter((get(w, -1) for w in words_of(text)), np.int64)
    out = []
    for k, place, matches in index.matches(ids):
        # Tiles lie within seeds: too few words under seeds means too few under tiles.
        size = len(index.items[k])
        under = np.zeros(size + 1, np.int64)
        np.add.at(under, place, 1)
        np.add.at(under, np.minimum(place + index.min_match, size), -1)
        if (np.cumsum(under)[:-1] > 0).sum() < coverage * size:
            continue
        tiles = tile(size, len(ids), matches(), index.min_match)
        if sum(n for _, _, n in tiles) >= coverage * size:
            out.append((k, tiles))
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """The items, read partition by partition, as blocks of about ``block_words`` words.

    An item of fewer than ``min_match`` words is one seed, so it must occur whole; such items have blocks
    of their own by number of words. Null items and those without words are left out.
    """
    rows: dict[int, list[tuple[object, list[str]]]] = {}
    held: dict[int, int] = {}
    for item in benchmark.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).toLocalIterator():
        words = list(words_of(item["text"]))
        if not words:
            continue
        seed = min(len(words), min_match)
        if rows.get(seed) and held[seed] + len(words) > block_words:
            yield Index.of(rows.pop(seed), seed)
            held[seed] = 0
        rows.setdefault(seed, []).append((item["id"], words))
        held[seed] = held.get(seed, 0) + len(words)
    for seed, left in rows.items():
        yield Index.of(left, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id_col, item_col, item_words, matched_words, n_tiles, coverage, tiles)`` for each document and item that it holds.

    One row per pair of rows; repeated documents and items repeat their pairs; null and empty texts hold
    nothing; an empty table on either side gives an empty result; other columns are ignored, whatever their names; if both ids
    have one name, that of the item is ``benchmark_`` and the name. ``tiles`` are word places; of equally long matches the
    first in the item, then in the document, is marked first. Of several blocks, each is scanned and let go before the next.
    """
    spark = small_batches(docs.sparkSession)
    item_name = item_col if item_col != id_col else f"benchmark_{item_col}"
    names = [id_col, item_name, "item_words", "matched_words", "n_tiles", "coverage", "tiles"]
    item_kind = dict(benchmark.dtypes)[item_col]
    spot = pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, `{item_name}` {item_kind}, item_words long, matched_words long, n_tiles long, coverage double, tiles array<struct<item_word: bigint, doc_word: bigint, words: bigint>>"

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                row, item, size, matched, tiles = [], [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    for k, found in found_in(text.as_py(), index, coverage):
                        row.append(i)
                        item.append(index.ids[k])
                        size.append(len(index.items[k]))
                        matched.append(sum(n for _, _, n in found))
                        tiles.append([{"item_word": p, "doc_word": a, "words": n} for p, a, n in found])
                if row:
                    share = [m / s for m, s in zip(matched, size)]
                    columns = [batch.column(0).take(pa.array(row)), pa.array(item), pa.array(size, pa.int64()), pa.array(matched, pa.int64()), pa.array(map(len, tiles), pa.int64()), pa.array(share), pa.array(tiles, pa.list_(spot))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    texts = docs.select(F.col(id_col), utf8(text_col).alias("text"))

    def step(out: DataFrame, index: Index, more: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(index)
        found = texts.mapInArrow(scan(held), schema)
        if more:
            found = materialise(found, "contaminated")
            held.destroy()
        return out.unionByName(found)

    return _over(blocks(benchmark, item_col, item_text_col, min_match, block_words), spark.createDataFrame([], schema), step)


def _over(indexes: Iterator[Index], out: DataFrame, step: Callable[[DataFrame, Index, bool], DataFrame]) -> DataFrame:
    """``step`` over all blocks, told whether there is more than one; a single block stays a lazy scan."""
    first, second = next(indexes, None), next(indexes, None)
    if first is None:
        return out
    out = step(out, first, second is not None)
    del first
    while second is not None:
        out, second = step(out, second, True), next(indexes, None)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, columns unchanged; a scan per block, without a shuffle.

    Null and empty texts stay; of several blocks, what each leaves is written before the next. Other cases are those of :func:`contaminated`.
    """
    spark = small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [t.as_py() is None or not found_in(t.as_py(), held.value, coverage) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    def step(out: DataFrame, index: Index, more: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(index)
        out = out.mapInArrow(scan(held), docs.schema)
        if more:
            out = materialise(out, "clean")
            held.destroy()
        return out

    return _over(blocks(benchmark, item_col, item_text_col, min_match, block_words), docs, step)


def op8_decontaminate(spark, sf_dir):
    """doc_id, item_id, item_words, matched_words, n_tiles, coverage of every contaminated document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tiles")
