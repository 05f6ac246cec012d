"""Removal of repeated byte strings, by hash-compared suffix sorting.

Every string of ``length`` bytes holds an anchor: the 64-byte gram of least hash among its
own. Equal strings hold equal grams at equal places, so only suffixes at anchors, about one in
170 positions, are looked at, and only those whose gram occurs twice or more. They meet by gram
with the bytes around them. Equal surroundings collapse first, compared byte by byte. What is left of a group is
suffix-sorted by a mergesort whose comparisons take prefix polynomial hashes and a binary search
for the common extension, once from the anchors on and once backwards from the anchors; the extensions of
neighbours in the two orders decide which strings repeat. Orders and extensions are verified on the bytes.

A gram with very many different surroundings is not sorted in one task: the places it can take in
a string are halved, which lengthens the part that the strings of one half share, and its members
are dealt anew by that longer part until groups are small. Nothing is capped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs
from .common import byte_spans, discard, letters_mix, materialise, small_batches, utf8

LENGTH = 400
GRAM = 64
#: Bytes hashed at once; longer texts are taken in overlapping chunks.
CHUNK = 1 << 18
#: Different surroundings of one gram that one task sorts.
GROUP_ROWS = 4096
#: Surroundings that are sorted in one go, in whole groups.
SORT_ROWS = 2048
#: Bytes of texts that are cut and handed on at once.
OUTPUT_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = letters_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


class PrefixHash:
    """Prefix polynomial hashes of a byte array: the hash of any substring of up to ``CHUNK`` bytes in O(1), arithmetic modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, down = _power_tables(max(CHUNK, 4096) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        for a in range(0, len(data), CHUNK):
            letters = _TABLE[data[a : a + CHUNK]]
            n = len(letters)
            self.prefix[a + 1 : a + 1 + n] = np.cumsum(letters * down[:n]) * self.up[:n] + self.prefix[a] * self.up[1 : n + 1]

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return self.prefix[start + size] - self.prefix[start] * self.up[size]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length, at most ``most``, of the common extension of the suffixes at ``a`` and ``b``, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over every window of ``width`` entries."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return x if done == width else best(x[: len(x) - (width - done)], x[width - done :])


def anchor_places(data: np.ndarray, owner: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all ``length``-byte strings within one owner; ``owner`` never falls."""
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(data) - gram + 1)
    hashes = letters_mix(PrefixHash(data).of(starts, gram))
    rank = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(rank, width, np.minimum)
    least = np.where(owner[: len(least)] == owner[length - 1 : length - 1 + len(least)], least, np.uint32(0))
    edge = np.zeros(width - 1, np.uint32)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == rank)
    return chosen, hashes[chosen]


def periodic(data: np.ndarray, at: np.ndarray, gram_hash: np.ndarray, owner: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int]]:
    """Stretches ``(first, last)`` of anchors, as indices, all of whose surroundings are equal: the inside of a text that repeats itself every ``gram`` bytes or less."""
    if len(at) < 3:
        return []
    step = np.diff(at)
    linked = (np.diff(owner) == 0) & (gram_hash[1:] == gram_hash[:-1]) & (step <= gram)
    out = []
    starts = runs(np.where(linked, step, 0), owner[1:])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(step)]):
        if linked[a] and at[b] - at[a] >= length:
            low, high, p = int(at[a]), int(at[b]) + gram, int(step[a])
            first, last = np.searchsorted(at[a : b + 1], [low + length - gram, high - length + 1]) + a
            if last - first >= 3 and (data[low : high - p] == data[low + p : high]).all():
                out.append((int(first), int(last) - 1))
    return out


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Anchors ``at`` to ``last``, ``many`` of them: one, or a stretch of a text that repeats itself."""
    names = ["gram", "k1", "k2", "at", "last", "many"]
    for batch in batches:
        raw, offsets = byte_spans(batch.column(2))
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data = np.frombuffer(raw, np.uint8)
        size = np.diff(offsets)
        row = 0
        while row < len(size):
            # As many whole texts as fit a chunk, or one longer text in overlapping chunks.
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[end])
            at_all, gram_all, own_all, last_all, many_all = [], [], [], [], []
            for a in range(lo, max(lo + 1, hi - length + 1), CHUNK - length + 1):
                b = min(hi, a + CHUNK)
                owner = np.repeat(np.arange(row, end), size[row:end])[a - lo : b - lo] if end > row + 1 else np.zeros(b - a, np.int8)
                at, h = anchor_places(data[a:b], owner, length, gram)
                own = owner[at] if end > row + 1 else np.full(len(at), row)
                last, many, kept = at.copy(), np.ones(len(at), np.int64), np.ones(len(at), bool)
                for x, y in periodic(data[a:b], at, h, own, length, gram):
                    last[x], many[x] = at[y], y - x + 1
                    kept[x + 1 : y + 1] = False
                shift = (a - offsets[own])[kept]
                at_all.append(at[kept] + shift)
                last_all.append(last[kept] + shift)
                many_all.append(many[kept])
                gram_all.append(h[kept])
                own_all.append(own[kept])
            at, last, many, h, own = (np.concatenate(x) for x in (at_all, last_all, many_all, gram_all, own_all))
            if len(at_all) > 1:
                # Chunks overlap: of what begins at one place, the longest stretch. An anchor inside a stretch of another chunk
                # may stay; its surroundings do repeat.
                by = np.lexsort([-last, at])
                once = by[np.concatenate([[True], np.diff(at[by]) > 0])] if len(by) else by
                at, last, many, h, own = (x[once] for x in (at, last, many, h, own))
            if len(at):
                columns = [h.view(np.int64), k1[own], k2[own], at, last, many]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            row = end


MEMBER = "gram long, around long, k1 long, k2 long, at long, last long, many long, before int, bytes binary"


def _around(part: bytes, before: int) -> int:
    """A signed 64-bit name of surroundings."""
    name = xxhash.xxh3_64_intdigest(part, before)
    return name - (1 << 64) if name >> 63 else name


def _surroundings(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["gram", "around", "k1", "k2", "at", "last", "many", "before", "bytes"]
    for batch in batches:
        raw, offsets = byte_spans(batch.column(2))
        k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places = batch.column(3)
        out: list[list] = [[] for _ in names]
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            for spot in places[i].as_py():
                at = spot["at"]
                before = min(at, length - gram)
                part = bytes(text[at - before : at + length])
                for column, value in zip(out, (spot["gram"], _around(part, before), k1[i], k2[i], at, spot["last"], spot["many"], before, part)):
                    column.append(value)
            if len(out[0]) >= 8192:
                yield _members(out, names)
                out = [[] for _ in names]
        yield _members(out, names)


def _members(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)


def suffix_order(text: PrefixHash, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``start`` (of ``size`` bytes) within each run of equal ``group``.

    Bottom-up mergesort, each level merging all its pairs of runs at once: an element's place is its
    own rank and its rank in the other run, found by binary search; one comparison finds the common
    extension by hashes and looks at one byte. Runs of different groups are in order already.
    """
    n = len(start)
    order = np.arange(n)
    data = text.data

    def before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x sorts before, with or after suffix y."""
        most = np.minimum(size[x], size[y])
        ext = text.common(start[x], start[y], most)
        whole = ext == most
        last = len(data) - 1
        bytes_ = data[np.minimum(start[x] + ext, last)].astype(np.int64) - data[np.minimum(start[y] + ext, last)]
        out = np.sign(np.where(whole, size[x] - size[y], bytes_))
        return np.where(group[x] != group[y], np.sign(group[x] - group[y]), out)

    run = 1
    while run < n:
        left = np.arange(0, n - run, 2 * run)
        left = left[group[order[left + run - 1]] == group[order[left + run]]]
        if len(left):
            right_end = np.minimum(left + 2 * run, n)
            slots = np.concatenate([np.arange(a, b) for a, b in zip(left, right_end)])
            pair = np.repeat(np.arange(len(left)), right_end - left)
            mid = left[pair] + run
            in_left = slots < mid
            lo = np.where(in_left, mid, left[pair])
            base = lo.copy()
            hi = np.where(in_left, right_end[pair], mid)
            item = order[slots]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                m = (lo[open_] + hi[open_]) >> 1
                sign = before(item[open_], order[m])
                # Equal suffixes keep their order: those of the left run come first.
                later = (sign > 0) | ((sign == 0) & ~in_left[open_])
                lo[open_] = np.where(later, m + 1, lo[open_])
                hi[open_] = np.where(later, hi[open_], m)
            own = np.where(in_left, slots - left[pair], slots - mid)
            merged = order.copy()
            merged[left[pair] + own + (lo - base)] = item
            order = merged
        run *= 2
    return order


def _exact(parts: list[bytes], before: list[int], at: list[int], alone: list[bool], lo: int, hi: int, length: int) -> list[tuple[int, int, int]]:
    """What :func:`solve` finds for one group, from the bytes alone."""
    out = []
    for o in range(lo, hi + 1):
        seen = defaultdict(list)
        for i, part in enumerate(parts):
            s = before[i] - o
            if s >= 0 and s + length <= len(part):
                seen[part[s : s + length]].append(i)
        for same in seen.values():
            out += [(i, at[i] - o, at[i] - o + length) for i in same if len(same) > 1 and alone[i]]
    return out


def sorted_extensions(data: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """Suffix order, the common extension of each suffix with the one before it (-1 for a group's first), and groups in which hashes misled.

    Extensions and order of neighbours are verified on the bytes; with them, those of any two suffixes hold.
    """
    text = PrefixHash(data)
    order = suffix_order(text, group, start, size)
    x, y = order[:-1], order[1:]
    near = group[x] == group[y]
    most = np.where(near, np.minimum(size[x], size[y]), 0)
    ext = text.common(start[x], start[y], most)
    wrong: set[int] = set()
    last = max(0, len(data) - 1)
    for k in range(0, len(ext), 1024):
        a, b, e, m = x[k : k + 1024], y[k : k + 1024], ext[k : k + 1024], most[k : k + 1024]
        step = np.arange(int(e.max(initial=0)) + 1)
        p, q = data[np.minimum(start[a][:, None] + step, last)], data[np.minimum(start[b][:, None] + step, last)]
        bad = ((p != q) & (step[None, :] < e[:, None])).any(axis=1)
        rows = np.arange(len(e))
        bad |= np.where(e < m, p[rows, e] >= q[rows, e], size[a] > size[b]) & near[k : k + 1024]
        wrong |= set(group[a][bad].tolist())
    return order, np.concatenate([[-1], np.where(near, ext, -1)]), wrong


def _reach(order: np.ndarray, ext: np.ndarray) -> np.ndarray:
    """Each suffix's longest common extension with another of its group: that with a neighbour."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(ext, np.append(ext[1:], -1))
    return out


def solve(group: np.ndarray, parts: list[bytes], before: np.ndarray, at: np.ndarray, alone: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``(member, from, to)``: bytes of members covered by a string that another member of its group has too.

    A member is its bytes ``parts`` with the anchor ``before`` bytes in and at ``at`` in its text; strings
    begin ``lo`` to ``hi`` bytes before the anchor. Only members that stand ``alone`` are answered.

    Two suffix orders decide, that of the bytes from the anchor on and that of the bytes before it, read backwards. The
    string that begins o bytes before the anchor is in both of two members if nowhere between them the extensions
    fall below length - o in the one order and below o in the other: members of such a run in both orders share it.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8)
    anchor, right = np.cumsum(sizes) - sizes + before, np.minimum(sizes - before, length)
    order, ext, wrong = sorted_extensions(data, group, anchor, right)
    begin = np.maximum(np.maximum(length - _reach(order, ext), lo), length - right)
    # Who shares too little to the right takes no part in anything.
    live = np.flatnonzero(begin <= np.minimum(before, hi))
    out: list[tuple[int, int, int]] = []
    if len(live):
        ahead, ahead_ext, misled = sorted_extensions(data[::-1], group[live], len(data) - anchor[live], np.minimum(before, hi)[live])
        wrong |= misled
        end = _reach(ahead, ahead_ext)
        first = begin[live]
        open_ = first <= end
        marks = np.bincount(first[open_], minlength=length + 2) - np.bincount(end[open_] + 1, minlength=length + 2)
        hit = np.zeros((len(live), length + 2), bool)
        run_r, run_l = np.empty(len(order), np.int64), np.empty(len(live), np.int64)
        for o in np.flatnonzero(np.cumsum(marks) > 1).tolist():
            run_r[order] = np.cumsum(ext < length - o)
            run_l[ahead] = np.cumsum(ahead_ext < o)
            own = np.flatnonzero((first <= o) & (o <= end))
            key = run_r[live[own]] * (len(live) + 1) + run_l[own]
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            hit[own[by[1:][same]], o + 1] = True
            hit[own[by[:-1][same]], o + 1] = True
        hit &= alone[live][:, None]
        member, edge = np.nonzero(hit[:, 1:] != hit[:, :-1])
        m = live[member[::2]]
        out = list(zip(m.tolist(), (at[m] - edge[1::2] + 1).tolist(), (at[m] - edge[::2] + length).tolist()))
    out = [r for r in out if group[r[0]] not in wrong]
    for g in wrong:
        own = np.flatnonzero(group == g).tolist()
        found = _exact([parts[i] for i in own], before[own].tolist(), at[own].tolist(), alone[own].tolist(), int(lo[own[0]]), int(hi[own[0]]), length)
        out += [(own[i], a, b) for i, a, b in found]
    return out


def _solve_stream(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Members in order of ``node``; a node may span batches."""
    names = ["k1", "k2", "from", "to"]
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(last: bool):
        nonlocal held, rows
        table = pa.Table.from_batches(held).combine_chunks()
        node = table["node"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        stop = len(node) if last else int(starts[-1])
        held = [] if stop == len(node) else table.slice(stop).to_batches()
        rows = len(node) - stop
        k = 0
        bounds = np.append(starts[starts < stop], stop)
        while k < len(bounds) - 1:
            end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + SORT_ROWS, side="right")) - 1)
            part = table.slice(int(bounds[k]), int(bounds[end] - bounds[k]))
            group = np.repeat(np.arange(end - k), np.diff(bounds[k : end + 1]))
            many = np.flatnonzero(np.bincount(group)[group] > 1)
            if len(many):
                part = part.take(pa.array(many))
                c = {n: part[n].to_numpy() for n in ("before", "at", "n", "lo", "hi", "k1", "k2")}
                found = solve(group[many], part["bytes"].to_pylist(), c["before"].astype(np.int64), c["at"], c["n"] == 1, c["lo"].astype(np.int64), c["hi"].astype(np.int64), length)
                if found:
                    i, a, b = (np.array(z, np.int64) for z in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (c["k1"][i], c["k2"][i], a, b)], names=names)
            k = end

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * SORT_ROWS:
                yield from flush(False)
    if rows:
        yield from flush(True)


def _halves(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Deal members of a large node to its two halves by the longer part that strings of a half share."""
    digest = xxhash.xxh3_64_intdigest
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for batch in batches:
        out: list[list] = [[] for _ in range(11)]
        for r in batch.to_pylist():
            mid = (r["lo"] + r["hi"]) // 2
            for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                a, b = r["before"] - lo, r["before"] + length - hi
                if a < 0 or b > len(r["bytes"]) or lo > hi:
                    continue
                node = digest(r["bytes"][a:b], digest(b"%d %d %d" % (r["node"], lo, hi)))
                left = max(0, r["before"] - hi)
                part = r["bytes"][left : r["before"] + length - lo]
                values = (signed(node), _around(part, r["before"] - left), r["k1"], r["k2"], r["at"], r["at"], 1, r["before"] - left, part, lo, hi)
                for column, value in zip(out, values):
                    column.append(value)
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["node", "around", "k1", "k2", "at", "last", "many", "before", "bytes", "lo", "hi"])


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(k1, k2, from, to)``: byte ranges of texts ``(k1, k2, text)`` covered by strings that also start elsewhere.

    Ranges may overlap or repeat; together they cover exactly those bytes.
    """
    spark = small_batches(keyed.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = keyed.where(F.octet_length("text") >= length)
    anchors = materialise(long.mapInArrow(lambda b: _anchors(b, length, gram), "gram long, k1 long, k2 long, at long, last long, many long"), "anchors")
    # A table of its own, so that the join below is of two plain shuffles and a hot gram's rows can be split.
    twice = materialise(anchors.groupBy("gram").agg(F.sum("many").alias("n")).where("n > 1").select("gram"), "grams")
    places = anchors.join(twice, "gram").groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "at", "last", "many")).alias("places"))
    met = long.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places")
    members = materialise(met.mapInArrow(lambda b: _surroundings(b, length, gram), MEMBER), "members")
    # Written out, the members stand on their own.
    for done in (anchors, twice):
        discard(done)
    rows = members.withColumnRenamed("gram", "node").withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    spans = []
    while True:
        fields = ["before", "bytes", "k1", "k2", "at", "lo", "hi"]
        ends = [F.min(F.struct(*fields)).alias("one"), F.max(F.struct("before", "bytes")).alias("last")]
        sure = ((F.col("one.before") == F.col("last.before")) & (F.col("one.bytes") == F.col("last.bytes"))).alias("sure")
        classes = materialise(rows.groupBy("node", "around").agg(F.sum("many").alias("n"), *ends).select("node", "around", "n", "one.*", sure), "classes")
        # Equal surroundings, by hash and then by bytes: every string in them repeats.
        named = rows.select("node", "around", "k1", "k2", "at", "last", "before", "lo", "hi", F.octet_length("bytes").alias("size"))
        equal = named.join(classes.where("n > 1 and sure").select("node", "around"), ["node", "around"])
        odd = classes.where("not sure")
        if not odd.isEmpty():
            mixed = materialise(rows.join(odd.select("node", "around"), ["node", "around"]), "mixed")
            keys = ["node", "around", "before", "bytes"]
            split = materialise(mixed.groupBy(*keys).agg(F.sum("many").alias("n"), F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("one")).select(*keys, "n", "one.*", F.lit(True).alias("sure")), "split")
            classes = classes.where("sure").unionByName(split)
            equal = equal.unionByName(mixed.join(split.where("n > 1").select(*keys), keys).select(*named.columns[:-1], F.octet_length("bytes").alias("size")))
        left, right = F.least("before", "hi"), F.least(F.col("size") - F.col("before"), F.lit(length) - F.col("lo"))
        spans.append(equal.where(left + right >= length).select("k1", "k2", (F.col("at") - left).alias("from"), (F.col("last") + right).alias("to")))
        nodes = classes.groupBy("node").agg(F.count("*").alias("classes"))
        large = materialise(nodes.where(F.col("classes") > group_rows).select("node"), "large")
        none = large.isEmpty()
        small = classes if none else classes.join(large, "node", "left_anti")
        dealt = small.select("node", "k1", "k2", "at", "before", "bytes", "n", "lo", "hi").repartition(parts, "node").sortWithinPartitions("node")
        spans.append(dealt.mapInArrow(lambda b: _solve_stream(b, length), "k1 long, k2 long, from long, to long"))
        if none:
            break
        again = classes.join(large, "node").where("lo < hi")
        rows = materialise(
            again.select("node", "k1", "k2", "at", "before", "bytes", "lo", "hi").mapInArrow(lambda b: _halves(b, length), MEMBER.replace("gram", "node") + ", lo int, hi int"), "halves"
        )
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _whole(text: memoryview, a: int, b: int) -> tuple[int, int]:
    """The range widened to whole UTF-8 characters."""
    while a > 0 and a < len(text) and text[a] & 0xC0 == 0x80:
        a -= 1
    while b < len(text) and text[b] & 0xC0 == 0x80:
        b += 1
    return a, b


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
    for batch in batches:
        raw, offsets = byte_spans(batch.column(1))
        places = batch.column(2)
        row = 0
        while row < batch.num_rows:
            begin, kept, removed, runs, held = row, [], [], [], 0
            while row < batch.num_rows and held < OUTPUT_BYTES:
                text = raw[offsets[row] : offsets[row + 1]]
                merged: list[list[int]] = []
                for s in sorted((s["from"], s["to"]) for s in places[row].as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                runs.append([{"from": a, "to": b} for a, b in merged])
                removed.append(sum(b - a for a, b in merged))
                edges, at = [0], 0
                for a, b in merged:
                    a, b = _whole(text, a, b) if whole else (a, b)
                    edges += [max(a, at), b]
                    at = b
                edges.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                held += len(kept[-1])
                row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, row - begin), *(pa.array(c, t) for c, t in zip((kept, removed, runs), kinds))], names=names)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS, whole_characters: bool = False) -> DataFrame:
    """``row`` (a struct of the columns of ``docs`` but ``text_col``), ``kept`` (bytes left), ``n_removed``, ``spans`` (maximal removed runs).

    Each byte covered by a string of ``length`` bytes that also starts elsewhere, in any text, is
    removed (with ``whole_characters``, from ``kept`` also the rest of a character cut in two); null texts are empty. One row
    per row of ``docs``: repeated rows are texts of their own and so repeat each other; texts under ``length`` bytes keep
    everything; an empty table gives an empty result; columns may have any name and type.
    """
    others = [c for c in docs.columns if c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    # Maps and variants have no hash of their own: their text stands for them.
    named = [F.col(f"`{c}`").cast("string") if re.search(r"\bmap<|\bvariant\b", kinds[c]) else F.col(f"`{c}`") for c in others]
    text = utf8(F.col(f"`{text_col}`"))
    # Two hashes of row and text name a text; rows equal in all columns share a name and are cut alike.
    base = docs.select(row.alias("row"), F.xxhash64(F.lit(1), *named, text).alias("k1"), F.xxhash64(F.lit(2), *named, text).alias("k2"), text.alias("text"))
    spans = repeated_spans(base.select("k1", "k2", "text"), length, gram, group_rows)
    by_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = base.join(by_text, ["k1", "k2"], "left").select("row", "text", "spans")
    schema = base.select("row").schema.add("kept", "binary").add("n_removed", "long").add("spans", by_text.schema["spans"].dataType)
    return joined.mapInArrow(lambda b: _cut(b, schema.names, whole_characters), schema)


def drop_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut from the texts and ``length_col``, if there, set anew.

    A character cut in two goes whole; a document of which no word is left goes, unless nothing was cut from it. A
    null text stays as an empty one; other cases are those of :func:`remove_repeats`.
    """
    columns = docs.columns
    out = remove_repeats(docs, text_col, length, whole_characters=True)
    cut = out.withColumn("__text", F.col("kept").cast("string")).where((F.col("n_removed") == 0) | F.col("__text").rlike(r"[^\x20\x09-\x0D]"))
    picked = [F.col("__text").alias(c) if c == text_col else F.length("__text").cast("long").alias(c) if c == length_col else F.col(f"row.`{c}`") for c in columns]
    return cut.select(*picked)


def op2_suffix_dedup(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(
        "row.doc_id",
        (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP2_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, '')) as n, row_number() over () as r from documents),
w as (select r, i, md5(b[i:i + 399]) as h from (select r, b, unnest(range(1, n - 398)) as i from d where n >= 400)),
hit as (select r, i from w where h in (select h from w group by h having count(*) > 1)),
cut as (select *, case when i > lag(i) over (partition by r order by i) + 400 then 1 else 0 end as fresh from hit),
run as (select *, sum(fresh) over (partition by r order by i) as k from cut),
span as (select r, min(i) as a, max(i) + 400 as e from run group by r, k),
edge as (select r, a, e, coalesce(lag(e) over (partition by r order by a), 1) as prior from span),
piece as (select d.r, a as spot, hex(b[prior:a - 1]) as x, e - a as gone from edge join d using (r)
    union all select d.r, n + 1, hex(b[coalesce(m.e, 1):n]), 0 from d left join (select r, max(e) as e from span group by r) m using (r)),
remaining as (select r, string_agg(x, '' order by spot) as x, sum(gone)::bigint as n_removed, count(*) - 1 as n_spans from piece group by r)
select doc_id, n as n_bytes, n_removed, n_spans, sha256(unhex(x)) as kept_sha256 from d join remaining using (r)
"""
