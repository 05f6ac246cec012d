"""Near-duplicates by Jaccard similarity of word shingles, found by SimHash anchors and checked on the sets.

Texts with the same set of shingles collapse into one node with a SimHash of 512 bits. Sets of Jaccard similarity s
differ in each bit with probability arccos(2s / (1 + s)) / pi, 0.15 at 0.8. A block of the fingerprint is
15 code bits and some free bits; its anchors are the words of the (15, 11) Hamming code times all values of the free
bits, of covering radius 1, and a block's own threshold is 0, so a node goes to the one anchor within 1 + 0 bits. Of
overlapping blocks there are as many as make two sets of similarity 0.8 meet with a probability of 1 - ``MISS``. Nodes of
one anchor are candidates if their bits are near; every candidate is decided on the whole sets.

Candidates are taken in two steps. First every node gets the nearest node, by 512 bits, of each of its anchors, which
makes a number of pairs in proportion to the nodes and joins groups of copies. After that all candidates are taken of
nodes that are not in one component yet, compared by 2,048 bits, so that few have less than the similarity wanted: a large
group of copies never gives all its pairs. A large anchor is dealt over a grid in that step, so no task holds all its rows.

Few shingles give few independent bits, so small sets are linked exactly instead: two sets of the similarity wanted
share their intersection, which each is without a few of its elements; sets that share such a key are linked by the key's size
and the numbers of elements left out alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import runs, spread
from .common import byte_spans, discard, letters_mix, materialise, small_batches, utf8
from .components import components
from .shingles import SEED, bit_counts, shingle_hashes

SIMILARITY = 0.8
#: 64-bit words of a fingerprint, and of the wider one by which the rest are compared.
WORDS, WIDE = 8, 32
CODE_BITS = 15
#: A cell holds its block above so many bits.
BLOCK_SHIFT = 40
#: Probability that a pair of just the similarity wanted meets at no anchor.
MISS = 2e-4
#: Free bits grow with the nodes, so that an anchor of a block has about so many nodes at most.
ANCHOR_NODES = 256
#: Nodes of one anchor that one task compares all with all; larger anchors are dealt out.
CELL_ROWS = 4096
PAIRS_AT_ONCE = 1 << 17
ROWS_AT_ONCE = 1 << 16
#: Pairs of which one set has so many shingles at most are found by exact keys.
SMALL_SET = 9
#: Texts that are found again by broadcasting their names; more are joined by shuffling.
BROADCAST_NAMES = 2_000_000
_ODD = letters_mix(np.arange(1, WIDE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct hashes of the text's word shingles in rising order."""
    found = [np.unique(h) for h in shingle_hashes(text, width)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))


def name_of(shingles: np.ndarray) -> int:
    """The set's 64-bit name, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def wide_fingerprint(shingles: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64-bit words; a bit is 1 if more than half of the shingles' hashes have it. Fewer words are the first of more."""
    counts = np.zeros(64 * words, np.int64)
    step = max(255, 32640 // words)
    for k in range(0, len(shingles), step):
        h = (shingles[k : k + step, None] * _ODD[None, :words]).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        counts += bit_counts(h)
    return np.packbits(2 * counts > len(shingles)).view(np.uint64)


def bit_rate(similarity: float) -> float:
    """Share of bits in which two sets of this Jaccard similarity and of like size differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def bit_limit(similarity: float, words: int) -> int:
    """Most bits in which sets of the similarity wanted differ: four deviations above what is expected."""
    rate, bits = bit_rate(similarity), 64 * words
    return int(bits * rate + 4 * math.sqrt(bits * rate * (1 - rate)))


def blocks_for(nodes: int, similarity: float = SIMILARITY, miss: float = MISS) -> np.ndarray:
    """Places in the fingerprint of each block's bits, the code bits first: as many blocks as the miss rate asks for."""
    free = max(1, math.ceil(math.log2(max(1, nodes) / ANCHOR_NODES)) - 11)
    p = bit_rate(similarity)
    one, two = CODE_BITS * p * (1 - p) ** (CODE_BITS - 1), math.comb(CODE_BITS, 2) * p**2 * (1 - p) ** (CODE_BITS - 2)
    # Words one or two bits apart lie within one bit of the same code word in one case of eight; further apart, in none.
    meet = ((1 - p) ** CODE_BITS + (one + two) / 8) * (1 - p) ** free
    many = math.ceil(math.log(miss) / math.log(1 - meet)) if meet < 1 else 1
    width = CODE_BITS + free
    rng = np.random.default_rng(SEED)
    each = 64 * WORDS // width
    return np.concatenate([rng.permutation(64 * WORDS)[: each * width].reshape(each, width) for _ in range(-(-many // each))])[:many]


def cells_of(fingerprints: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """``(n, blocks)``: the nearest anchor of each fingerprint (rows of bytes) in each block."""
    bits = np.unpackbits(fingerprints, axis=1)[:, blocks]
    place = np.concatenate([np.arange(1, CODE_BITS + 1), np.zeros(blocks.shape[1] - CODE_BITS)]).astype(np.uint8)
    lead = np.bitwise_xor.reduce(bits * place, axis=2)
    weight = np.int64(1) << np.arange(blocks.shape[1], dtype=np.int64)
    word = (bits * weight).sum(axis=2)
    word ^= np.where(lead > 0, np.int64(1) << np.maximum(lead.astype(np.int64) - 1, 0), 0)
    return word | (np.arange(len(blocks), dtype=np.int64) << BLOCK_SHIFT)


def _sketches(docs: DataFrame, id_kind: str, width: int, similarity: float) -> DataFrame:
    """``(id, mark, node, sketch, small)`` of each row of ``(id, mark, text)``; ``small`` is the set itself if it may be in a pair with a small one."""
    most = int(SMALL_SET / similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_spans(batch.column(2))
            nodes, made, small = [], [], []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                found = shingle_set(bytes(data[a:b]), width)
                nodes.append(name_of(found))
                made.append(wide_fingerprint(found).tobytes())
                small.append(found.tobytes() if 0 < len(found) <= most else None)
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(made, pa.binary()), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "node", "sketch", "small"])

    return docs.mapInArrow(run, f"id {id_kind}, mark long, node long, sketch binary, small binary")


def _subsets(small: DataFrame, similarity: float) -> DataFrame:
    """``(key, size, less, node)`` of each row of ``(node, small)``: the sets that are left without ``less`` elements, as many as a similar set may lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                for less in range(len(found)):
                    left = len(found) - less
                    if left < similarity * len(found):
                        break
                    rows += [(xxhash.xxh3_64_intdigest(np.delete(found, out).tobytes(), left) - (1 << 63), left, less, node) for out in itertools.combinations(range(len(found)), less)]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "size", "less", "node"])

    return small.mapInArrow(run, "key long, size long, less long, node long")


def small_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(u, v)`` with the components of "similarity wanted or more" over small sets of ``(node, small)``, without their pairs.

    Two sets that are a key and ``a`` and ``b`` elements more have at least size / (size + a + b) in common, and just that if the
    key is all they share. So it is enough to link each set of a key with the first of those that are ``b`` more, for every b that suffices.
    """
    keys = materialise(_subsets(nodes.where("small is not null").select("node", "small"), similarity), "small_keys")
    first = materialise(keys.groupBy("key", "size", F.col("less").alias("more")).agg(F.min("node").alias("v")), "small_first")
    return keys.join(first, ["key", "size"]).where((F.col("size") >= similarity * (F.col("size") + F.col("less") + F.col("more"))) & (F.col("node") != F.col("v"))).select(F.col("node").alias("u"), "v")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, shingles, sketch)`` of each row of ``(text,)``; the sketch has ``WIDE`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_spans(batch.column(0))
            for k in range(0, batch.num_rows, 256):
                found = [shingle_set(bytes(data[a:b]), width) for a, b in zip(at[k : k + 256].tolist(), at[k + 1 : k + 257].tolist())]
                columns = [pa.array(map(name_of, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([wide_fingerprint(x, WIDE).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "sketch"])

    return docs.mapInArrow(run, "node long, shingles binary, sketch binary")


def _bytes2d(column: pa.Array) -> np.ndarray:
    """Rows of a binary column of one length as rows of bytes."""
    raw, at = byte_spans(column)
    return np.frombuffer(raw, np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _deal(nodes: DataFrame, blocks: np.ndarray, words: int) -> DataFrame:
    """``(cell, root, node, bits)``: every node of ``(node, root, sketch)`` at its anchor in each block, with ``words`` words of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _bytes2d(batch.column(2)) if batch.num_rows else np.zeros((0, 8 * words), np.uint8)
            for k in range(0, len(sketch), 256):
                part = sketch[k : k + 256]
                cells = cells_of(part[:, : 8 * WORDS], blocks)
                row = pa.array(np.repeat(np.arange(len(part)), len(blocks)))
                bits = pa.array([x.tobytes() for x in part[:, : 8 * words]], pa.binary())
                columns = [pa.array(cells.ravel()), *(x.take(row) for x in (batch.column(1).slice(k, 256), batch.column(0).slice(k, 256), bits))]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "root", "node", "bits"])

    return nodes.select("node", "root", "sketch").mapInArrow(run, "cell long, root long, node long, bits binary")


def _pairs(cell, sub, home, root, node, bits, blocks: np.ndarray, similarity: float, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of rows of whole groups in order, each in the first block in which it meets; with ``nearest`` only where one is the other's nearest.

    In a group with ``sub`` below 0 all rows are at home and meet each other; in a cell of a grid homes meet guests.
    """
    starts = runs(cell, sub)
    size = np.diff(np.append(starts, len(cell)))
    group = np.repeat(np.arange(len(starts)), size)
    own = runs(cell, sub, home, root)
    run_end = np.repeat(np.append(own[1:], len(cell)), np.diff(np.append(own, len(cell))))
    guests = np.bincount(group[~home], minlength=len(starts))[group]
    i = np.flatnonzero(home)
    words = np.ascontiguousarray(bits).view(np.uint64)
    first = np.ascontiguousarray(words[:, :WORDS])
    best = np.full(len(node), np.iinfo(np.int64).max)

    def nearby(a, b, words):
        apart = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero((apart <= bit_limit(similarity, words.shape[1])) & (root[a] != root[b]))
        return a[near], b[near], apart[near]

    known, cells = np.zeros(len(node), bool), np.zeros((len(node), len(blocks)), np.int64)

    def once(a, b):
        """The pairs that meet in no block before this one."""
        rows = np.unique(np.concatenate([a, b]))
        rows = rows[~known[rows]]
        for k in range(0, len(rows), 256):
            cells[rows[k : k + 256]] = cells_of(bits[rows[k : k + 256], : 8 * WORDS], blocks)
        known[rows] = True
        for k in range(0, len(a), 4096):
            x, y = a[k : k + 4096], b[k : k + 4096]
            own = (cells[x] == cells[y]).argmax(axis=1) == cell[x] >> BLOCK_SHIFT
            yield node[x[own]], node[y[own]]

    # Guests come first; where there is no grid, a row meets those beyond its own root.
    beyond = np.where(sub[i] < 0, (starts + size)[group][i] - run_end[i], 0)
    for start, count in ((starts[group][i], guests[i]), (run_end[i], beyond)):
        for owner, b in spread(start, count, PAIRS_AT_ONCE):
            a, b, apart = nearby(i[owner], b, first)
            if words.shape[1] > WORDS and len(a):
                a, b, apart = nearby(a, b, words)
            if nearest:
                np.minimum.at(best, a, apart << 32 | b)
                np.minimum.at(best, b, apart << 32 | a)
            elif len(a):
                yield from once(a, b)
    found = np.flatnonzero(best < np.iinfo(np.int64).max)
    if len(found):
        # In the first block in which a node has a candidate, its nearest is one that it meets there first.
        yield from once(found, best[found] & 0xFFFFFFFF)


def _candidates(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, similarity: float, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows ``(cell, sub, home, root, node, bits)`` in that order; a group of cell and sub may span batches."""
    kept: list[list[np.ndarray]] = []
    rows = 0

    def flush(last: bool):
        nonlocal kept, rows
        columns = [np.concatenate([x[i] for x in kept]) for i in range(6)]
        starts = runs(columns[0], columns[1])
        stop = len(columns[0]) if last else int(starts[-1])
        kept, rows = ([[c[stop:] for c in columns]], len(columns[0]) - stop) if stop < len(columns[0]) else ([], 0)
        if stop:
            for a, b in _pairs(*(c[:stop] for c in columns), blocks, similarity, nearest):
                u, v = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            kept.append([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), _bytes2d(batch.column(5))])
            rows += batch.num_rows
            if rows >= ROWS_AT_ONCE:
                yield from flush(False)
    if rows:
        yield from flush(True)


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def hot_anchors(nodes: DataFrame, blocks: np.ndarray, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(cell, n)`` of anchors of more than ``cell_rows`` nodes."""
    return materialise(_deal(nodes, blocks, 0).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows), "hot_anchors")


def placed(nodes: DataFrame, blocks: np.ndarray, hot: DataFrame, nearest: bool, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(cell, sub, home, root, node, bits)``: the rows of ``(node, root, sketch)`` at their anchors.

    A ``hot`` anchor is dealt out. With ``nearest`` each row is in one part of about ``cell_rows`` nodes. Else its rows are at
    home in a row of a grid and, unless they have the root that most of the anchor's rows have, guests in a column; homes
    meet guests, so any two of different roots meet, and a cell has about ``cell_rows`` of either.
    """
    dealt = _deal(nodes, blocks, WORDS if nearest else WIDE)
    if hot.isEmpty():
        out = dealt.withColumns({"sub": F.lit(-1), "home": F.lit(True)})
    elif nearest:
        own = F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("n") / cell_rows), F.lit(1)))
        out = dealt.join(hot, "cell", "left").withColumns({"sub": (-1 - own).cast("int"), "home": F.lit(True)})
    else:
        by_root = _deal(nodes, blocks, 0).join(hot.select("cell"), "cell").groupBy("cell", "root").agg(F.count("*").alias("m"))
        most = by_root.groupBy("cell").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("n"))
        high, wide = F.ceil(F.col("n") / cell_rows).cast("int"), F.ceil((F.col("n") - F.col("most.m")) / cell_rows).cast("int")
        grid = materialise(most.select("cell", F.col("most.root").alias("most"), high.alias("high"), wide.alias("wide")), "grids")
        i, j = (F.pmod(F.xxhash64("node", F.lit(k)), F.greatest(c, F.lit(1))).cast("int") for k, c in enumerate(("high", "wide")))
        spot = lambda sub, home: F.struct(sub.cast("int").alias("sub"), F.lit(home).alias("home"))
        along = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda c: spot(i * F.col("wide") + c, True))
        down = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda r: spot(r * F.col("wide") + j, False))
        there = F.when(F.col("high").isNull(), F.array(spot(F.lit(-1), True))).when(F.col("wide") == 0, F.array().cast("array<struct<sub: int, home: boolean>>"))
        there = there.when(F.col("root") == F.col("most"), along).otherwise(F.concat(along, down))
        out = dealt.join(grid, "cell", "left").select("cell", "root", "node", "bits", F.inline(there))
    return out.select("cell", "sub", "home", "root", "node", "bits")


def candidates(nodes: DataFrame, blocks: np.ndarray, hot: DataFrame, nearest: bool, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct pairs ``(u, v)`` of ``(node, root, sketch)`` that share an anchor, have different roots and are near."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed(nodes, blocks, hot, nearest, cell_rows).repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub", "home", "root")
    return ordered.mapInArrow(lambda b: _candidates(b, blocks, similarity, nearest), "u long, v long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(id, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of a Jaccard similarity of ``similarity`` or
    more. Texts without words, null included, are alike. Rows with a null id take part in links but give
    no component id (null if all ids of a component are null); repeated rows stay; other columns are ignored.
    Sets are named by 64 bits, so among 10^9 of them 0.03 pairs of different ones are to be expected to share a name.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).select("id", F.xxhash64("text").alias("mark"), "text")
    own = materialise(_sketches(texts, docs.schema[id_col].dataType.simpleString(), width, similarity), "sketches")
    nodes = materialise(own.groupBy("node").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("sketch").alias("sketch"), F.first("small").alias("small")), "nodes")
    blocks = blocks_for(nodes.count(), similarity)

    alone = nodes.withColumn("root", F.col("node"))
    hot = hot_anchors(alone, blocks, cell_rows)
    pairs = materialise(candidates(alone, blocks, hot, True, similarity, cell_rows), "pairs_nearest")

    # Who has a candidate has a nearest one, but for the parts of hot anchors: all others are done with.
    some = pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    if not hot.isEmpty():
        some = some.union(_deal(alone, blocks, 0).join(hot, "cell").select("node"))
    marks = materialise(nodes.join(some.distinct(), "node").select("mark").distinct(), "marks")
    if marks.count() <= BROADCAST_NAMES:
        marks = F.broadcast(marks)
    sets = materialise(_sets(texts.join(marks, "mark", "left_semi").dropDuplicates(["mark"]).select("text"), width), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(a), F.col("shingles").alias(b)) for a, b in ("ux", "vy"))
        both = pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y")
        return materialise(both.mapInArrow(_alike(similarity), "u long, v long"), f"links_{name}")

    roots = materialise(components(verified(pairs, "nearest").unionByName(small_links(nodes, similarity))), "roots")
    rooted = materialise(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    open_ = sets.select("node", "sketch").join(rooted, "node")
    more = verified(materialise(candidates(open_, blocks, hot, False, similarity, cell_rows), "pairs_rest"), "rest")
    discard(sets)
    # Nodes stand for their components from here on: links of links, in the root's names.
    rename = rooted.select("node", "root")
    lifted = more.join(rename.toDF("u", "a"), "u").join(rename.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(lifted).toDF("root", "top")
    named = materialise(rooted.join(found, "root", "left").select("node", "least", F.coalesce("top", "root").alias("root")), "named")
    # A table of its own, so that the join is of two plain shuffles and a large component can be split.
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return own.select("id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("id", "component_id")
