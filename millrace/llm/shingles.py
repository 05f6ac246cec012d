"""Word shingles of whole texts as 64-bit hashes, in bounded memory, and their bit majorities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

SEED = 42
#: Bytes of text whose words are held at once.
CHUNK = 1 << 20
ROWS_AT_ONCE = 4080
_space = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every ``width`` words in a row, joined by one space, chunk by chunk.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A text of fewer words is one
    shingle, one without words none.
    """
    digest = xxhash.xxh64_intdigest
    tail: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            edge = _space.search(text, end)
            end = edge.start() if edge else len(text)
        words = tail + text[at:end].lower().split()
        at = end
        if len(words) < width:
            tail = words
            continue
        some = True
        tail = words[len(words) - width + 1 :]
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first = (ends - sizes)[: len(words) - width + 1].tolist()
        last = ends[width - 1 :].tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    if tail and not some:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of the ``(n, k)`` array of 64-bit words have each of the 64 k bits."""
    out = np.zeros(64 * words.shape[1], np.int64)
    for k in range(0, len(words), ROWS_AT_ONCE):
        bits = np.unpackbits(np.ascontiguousarray(words[k : k + ROWS_AT_ONCE]).view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255
        # Sums of 255 bits fit a byte, and bytes are added many at a time.
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out += bits[whole:].sum(axis=0, dtype=np.uint8)
    return out
