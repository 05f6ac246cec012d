"""Word n-grams of whole texts as 64-bit keys, in numpy, and a blocked Bloom filter over such keys."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space beyond ASCII.
WIDE_SPACES = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_wide = re.compile("|".join(WIDE_SPACES).encode())
_words = re.compile(f"[^\t-\r {''.join(WIDE_SPACES)}]+")
_gap = re.compile(rb"[\t-\r ]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.arange(1, 257, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xA24BAED4963EE407)
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
#: Bits of the filter for each key, bits set for a key, and the largest filter. A larger index makes it fuller, not larger.
KEY_BITS, HASHES = 16, 5
FILTER_BYTES = 64 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, known: list[np.ndarray] = [np.ones(1, np.uint64)]) -> np.ndarray:
    while len(known[0]) < n:
        known[0] = np.concatenate([known[0], known[0] * (known[0][-1:] * _BASE)])
    return known[0]


def _hashed(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, end)`` of the words of a text."""
    data = np.frombuffer(block, np.uint8)
    space = _SPACE[data]
    for m in _wide.finditer(block):
        space[m.start() : m.end()] = True
    letters = np.flatnonzero(~space)
    if not len(letters):
        return np.zeros(0, np.uint64), letters, letters
    first = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
    size = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, size)
    terms = _LETTER[data[letters]] * _powers(int(size.max()))[place]
    return _mix(np.add.reduceat(terms, first)), letters[first], letters[first] + size


def _runs(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, start, end, starts of all words)`` of every run of ``n`` words."""
    h, start, end = _hashed(block)
    keys = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        keys = keys * _STEP + h[k : k + len(keys)]
    return _mix(keys), start[: len(keys)], end[n - 1 :], start


def ngram_keys(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """``(text, keys, bytes, start, end)`` of every run of ``n`` words of the texts; ``bytes[start:end]`` is a run as it stands there. Short texts are taken together, long ones in pieces."""
    k = 0
    while k < len(texts):
        held, first = 0, k
        while k < len(texts) and (k == first or held + len(texts[k]) < CHUNK):
            held += len(texts[k])
            k += 1
        if held <= CHUNK:
            block = b"\n".join(texts[first:k])
            edges = np.cumsum([0] + [len(t) + 1 for t in texts[first:k]])
            keys, start, end, _ = _runs(block, n)
            text = np.searchsorted(edges, start, "right") - 1
            own = np.flatnonzero(end <= edges[text + 1])
            yield first + text[own], keys[own], block, start[own], end[own]
            continue
        text, at, size = texts[first], 0, CHUNK
        while at < len(text):
            edge = _gap.search(text, at + size)
            stop = edge.start() if edge else len(text)
            keys, start, end, words = _runs(block := text[at:stop], n)
            if len(words) < n and stop < len(text):
                size *= 2
                continue
            size = CHUNK
            yield np.full(len(keys), first), keys, block, start, end
            # The next piece begins with the last words of this one.
            at = stop if stop == len(text) or n == 1 else at + int(words[len(words) - n + 1])


@dataclass(frozen=True)
class BlockedFilter:
    """A Bloom filter of 64-bit blocks: a key sets and asks bits of one block only."""

    blocks: np.ndarray

    @staticmethod
    def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each key and its bits there; ``blocks`` is a power of two."""
        mask = np.zeros(len(keys), np.uint64)
        for k in range(HASHES):
            mask |= np.uint64(1) << (keys >> np.uint64(6 * k) & np.uint64(63))
        return (_mix(keys) >> np.uint64(20) & np.uint64(blocks - 1)).astype(np.int64), mask

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        block, mask = self.places(keys, len(self.blocks))
        return self.blocks[block] & mask == mask


def _bytes(column: pa.Array) -> list[bytes]:
    """The texts of a column, null ones empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def words_of(text: str) -> list[str]:
    return _words.findall(text)


def build_filter(texts: DataFrame, n: int, text_col: str = "text", most_bytes: int = FILTER_BYTES) -> BlockedFilter | None:
    """The filter of all word n-grams of the texts; None if there is none.

    Its size follows the number of n-grams up to ``most_bytes``; what reaches the driver are its blocks, merged where the texts are.
    """
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sum(len(keys) for _, keys, *_ in ngram_keys(_bytes(batch.column(0)), n))
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["n"])

    own = texts.select(text_col)
    many = own.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    if not many:
        return None
    # Powers of two.
    blocks = 1 << min((most_bytes // 8).bit_length() - 1, (many * KEY_BITS // 64).bit_length())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(blocks, np.uint64)
        for batch in batches:
            for _, keys, *_ in ngram_keys(_bytes(batch.column(0)), n):
                block, mask = BlockedFilter.places(keys, blocks)
                np.bitwise_or.at(held, block, mask)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], names=["block", "bits"])

    got = own.mapInArrow(fill, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(blocks, np.uint64)
    held[got["block"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return BlockedFilter(held)


def probe(docs: DataFrame, filter_: BlockedFilter, n: int, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, ngram)``: the n-grams, words joined by one space, of each row that the filter may have; all that it has are among them."""
    held = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value
        for batch in batches:
            found: set[tuple[int, str]] = set()
            for text, keys, block, start, end in ngram_keys(_bytes(batch.column(1)), n):
                hits = np.flatnonzero(filter_.may_have(keys))
                found.update((i, " ".join(words_of(block[a:b].decode()))) for i, a, b in zip(text[hits].tolist(), start[hits].tolist(), end[hits].tolist()))
            if found:
                rows, grams = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(grams, pa.string())], names=[id_col, "ngram"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ngram string")
