"""Edit similarity: the insert-delete ratio of two texts, 0 to 100."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as st

from .text import strip

#: Words of 64 places that run side by side, and cells of a band's table (8 bytes each).
WORDS_AT_ONCE = 4096
TABLE_CELLS = 1 << 22
#: Words of a text from which on it is one whole number, which is faster by then.
LONG_WORDS = 64
#: Characters that are held as numbers at once, of both texts of all pairs of a round; a longer pair is a round of its own.
CHARS_AT_ONCE = 1 << 19


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _common_start(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def _run(pairs: list[tuple[np.ndarray, np.ndarray]], given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of each ``a`` that are matched in its ``b``, longest ``b`` first; and the carries that the characters of the last pair's ``b`` leave.

    All words of all pairs run side by side. Word w takes character t - w in step t, so what it takes and the carry that it needs are those
    of the word before it in the step before. Words whose characters are not there yet, or are done, meet nothing and stay as they are.
    ``given`` are the carries that the band before left, of one pair alone.
    """
    count = len(pairs)
    size_a, size_b = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    words = -(-size_a // 64)
    first, total = np.cumsum(words) - words, int(words.sum())
    inside = np.arange(total) - np.repeat(first, words)

    # A table row for each character of each pair's a, and one without a match for each pair.
    of_a, of_b = np.repeat(np.arange(count), size_a), np.repeat(np.arange(count), size_b)
    key_a = of_a << 32 | np.concatenate([a for a, _ in pairs])
    key_b = of_b << 32 | np.concatenate([b for _, b in pairs])
    kinds, kind = np.unique(key_a, return_inverse=True)
    pair_of = kinds >> 32
    width = np.append(words[pair_of], words)
    start = np.cumsum(width) - width
    none = start[len(kinds) :]
    table = np.zeros(int(width.sum()), np.uint64)
    place = np.arange(len(key_a)) - np.repeat(np.cumsum(size_a) - size_a, size_a)
    np.add.at(table, start[kind] + place // 64, np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
    at = np.minimum(np.searchsorted(kinds, key_b), len(kinds) - 1)
    rows = np.where(kinds[at] == key_b, start[at], none[of_b])

    steps = int((size_b + words).max()) - 1
    begin = np.cumsum(size_b) - size_b
    # Pairs come longest first, so those that still have characters, or words that are not done, are a prefix but for few.
    ends = np.maximum.accumulate((size_b + words - 1)[::-1])[::-1]
    live = np.searchsorted(-ends, -np.arange(steps), "left").tolist()
    row, spot = np.repeat(none, words), np.empty(total, np.int64)
    state = np.full(total, np.uint64(0xFFFFFFFFFFFFFFFF))
    carry = np.zeros(total + 1, np.uint64)
    leaves = np.zeros(int(size_b[-1]), np.uint64)
    until = np.append(first, total).tolist()
    for t in range(steps):
        k = live[t]
        n = until[k]
        row[1:n] = row[: n - 1]
        if t % 64 == 0:
            ahead = np.arange(t, t + 64)[:, None]
            fresh = np.where(ahead < size_b, rows[np.minimum(begin + ahead, len(rows) - 1)], none)
        row[first[:k]] = fresh[t % 64, :k]
        v, c = state[:n], carry[:n]
        c[first[:k]] = 0
        if given is not None and t < len(given):
            c[0] = given[t]
        met = table.take(np.add(row[:n], inside[:n], out=spot[:n]))
        met &= v
        total_of = v + met
        over = total_of < met
        total_of += c
        over |= total_of < c
        v ^= met
        v |= total_of
        carry[1 : n + 1] = over
        if given is not None and t >= n - 1:
            leaves[t - n + 1] = over[-1]
    return 64 * words - np.add.reduceat(np.bitwise_count(state).astype(np.int64), first), leaves


def _by_rows(a: np.ndarray, b: np.ndarray) -> int:
    """Places of a long ``a`` that are matched in ``b``, as bits of one whole number."""
    kinds, of_a = np.unique(a, return_inverse=True)
    where = {int(c): int.from_bytes(np.packbits(of_a == k, bitorder="little").tobytes(), "little") for k, c in enumerate(kinds)}
    full = (1 << len(a)) - 1
    state = full
    for c in b.tolist():
        met = state & where.get(c, 0)
        state = (state + met | state - met) & full
    return len(a) - state.bit_count()


def common_lengths(pairs: list[tuple[str, str]]) -> list[int]:
    """Lengths of the longest common subsequences, in characters.

    What both texts start and end with is counted at once. The rest of the shorter text becomes bits, 64 a word, against one character of the
    longer after another, the words of many pairs side by side; a long text is one whole number. A text that has too many words and different
    characters for a table is taken in bands, one after another, each with the carries that the one before left. Time grows with the product of
    the lengths of the rest (measured on one core: 1 s for each 10^9 cells of short texts, each 6 x 10^9 of long ones), memory with their sum.
    """
    out, rest = [0] * len(pairs), []
    for k, (x, y) in enumerate(pairs):
        a, b = sorted((_codes(x), _codes(y)), key=len)
        head = _common_start(a, b)
        a, b = a[head:], b[head:]
        tail = _common_start(a[::-1], b[::-1])
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        out[k] = head + tail
        if len(a):
            rest.append((k, a, b))
    group, words, cells = [], 0, 0

    def finish() -> None:
        if group:
            for (k, _, _), n in zip(group, _run([(a, b) for _, a, b in group])[0].tolist()):
                out[k] += n
            group.clear()

    for k, a, b in sorted(rest, key=lambda r: -len(r[2])):
        size = -(-len(a) // 64)
        # At most so many different characters, and a row without a match.
        kinds = len(np.unique(a)) + 1 if size > LONG_WORDS or len(a) > 256 and a.max() >= 256 else min(len(a), 256) + 1
        most = max(1, min(WORDS_AT_ONCE, TABLE_CELLS // kinds))
        if size > LONG_WORDS and kinds * size <= TABLE_CELLS:
            out[k] += _by_rows(a, b)
            continue
        if size > most:
            carries = np.zeros(len(b), np.uint64)
            for low in range(0, len(a), 64 * most):
                n, carries = _run([(a[low : low + 64 * most], b)], carries)
                out[k] += int(n[0])
            continue
        if group and (words + size > WORDS_AT_ONCE or cells + kinds * size > TABLE_CELLS):
            finish()
            words = cells = 0
        group.append((k, a, b))
        words, cells = words + size, cells + kinds * size
    finish()
    return out


def rounds(pairs: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """``pairs`` in order, in lists of at most ``CHARS_AT_ONCE`` characters or of one pair."""
    held, chars = [], 0
    for pair in pairs:
        size = len(pair[0]) + len(pair[1])
        if held and chars + size > CHARS_AT_ONCE:
            yield held
            held, chars = [], 0
        held.append(pair)
        chars += size
    if held:
        yield held


def indel_ratios(pairs: list[tuple[str, str]]) -> list[int]:
    """``round(100 * 2 * LCS / (len(a) + len(b)))`` of each pair, half to even; 100 for two empty texts. Memory is that of one of the :func:`rounds`."""
    lengths = chain.from_iterable(map(common_lengths, rounds(pairs)))
    return [round(100 * 2 * n / (len(a) + len(b))) if a or b else 100 for n, (a, b) in zip(lengths, pairs)]


def indel_ratio(a: str, b: str) -> int:
    return indel_ratios([(a, b)])[0]


@F.pandas_udf(st.DoubleType())
def _edit_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[there] = indel_ratios(list(zip(a[there], b[there])))
    return pd.Series(out)


def edit_similarity(a: Column, b: Column) -> Column:
    """Of the texts stripped of white space; null if either is null. Texts are compared whole, see :func:`common_lengths`."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, _edit_similarity(strip(a), strip(b)))


def exact_match(a: Column, b: Column) -> Column:
    """Unstripped equality as 0 or 1; null if either is null."""
    return (a == b).cast("int")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)
