"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three blocks. Two fingerprints that differ in at most
four bits differ in at most one bit in some block. In each block the anchors are a
covering code of radius 1: the perfect (15, 11) Hamming code on the block's low 15 bits,
times all values of its other bits. Every fingerprint is at home at its nearest anchor and
is replicated to every anchor within 1 + 1 = 2 bits; a linked pair therefore meets at the
home of either one. Fingerprints are compared in full, per anchor. Beyond 2^26 fingerprints
there are two blocks, a (31, 26) code and a reach of 1 + 2 bits, so that anchors stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors_of, home_of, runs, spread, thin
from .common import byte_spans, materialise, utf8
from .components import components
from .near_copies import near_copies
from .shingles import bit_counts, shingle_hashes

MAX_BITS = 4
RADIUS = 1
#: Most fingerprints that are cut into three blocks; of more, each is cut into two.
THREE_BLOCKS_ROWS = 1 << 26
#: Fingerprints of one anchor that one task compares at once; larger anchors are dealt over a grid.
CELL_ROWS = 4096
PAIRS_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 200_000


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles (see :func:`fingerprints`)."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        counts += bit_counts(h[:, None])
        n += len(h)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id_col, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint's bits as a signed long.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; shingles are
    ``width`` words joined by one space, repeats counted; a shorter text is one shingle; a
    text without words, null included, has fingerprint 0. A bit is set if more than half
    of the shingles' XXH64 (seed 42) have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_spans(batch.column(1))
            at = at.tolist()
            fps = np.array([fingerprint(bytes(data[a:b]), width) for a, b in zip(at, at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(F.col(id_col), utf8(text_col).alias("text"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


@dataclass(frozen=True)
class Cover:
    """Blocks of a fingerprint and their code: ``MAX_BITS`` differing bits leave a block with ``tolerance`` at most."""

    blocks: tuple[tuple[int, int], ...]
    code_bits: int

    @property
    def tolerance(self) -> int:
        return MAX_BITS // len(self.blocks)


THREE = Cover(((0, 21), (21, 21), (42, 22)), 15)
TWO = Cover(((0, 32), (32, 32)), 31)


def cover_for(fingerprints: int, most: int = THREE_BLOCKS_ROWS) -> Cover:
    """Longer blocks for more fingerprints: more replicas each, but a hundredth of the pairs. Either finds every link."""
    return THREE if fingerprints <= most else TWO


def _deal(batches: Iterator[pa.RecordBatch], cover: Cover) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in range(0, len(fps), 2048):
            part = fps[k : k + 2048]
            words = part.view(np.uint64)
            for home, (cell, row) in ((True, home_of(words, cover.blocks, cover.code_bits)), (False, anchors_of(words, cover.blocks, cover.code_bits, RADIUS + cover.tolerance))):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part[row]), pa.array(np.full(len(cell), home))], names=["cell", "fp", "home"])


def _links(homes: np.ndarray, reps: np.ndarray, nh: np.ndarray, nr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all homes with all replicas of each group; groups lie one after another."""
    group = np.repeat(np.arange(len(nh)), nh)
    for own, other in spread((np.cumsum(nr) - nr)[group], nr[group], PAIRS_AT_ONCE):
        a, b = homes[own], reps[other]
        near = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
        if near.any():
            yield thin(a[near].view(np.int64), b[near].view(np.int64))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(cell, sub, fp, home)`` in order of cell and sub; a group may span batches."""
    kept: list[np.ndarray] = []
    rows = 0

    def flush(last: bool):
        nonlocal kept, rows
        key, fp, home = (np.concatenate([x[i] for x in kept]) for i in range(3))
        starts = runs(key[:, 0], key[:, 1])
        if not last:
            tail = starts[-1]
            kept, rows = [(key[tail:], fp[tail:], home[tail:])], len(key) - tail
            key, fp, home, starts = key[:tail], fp[:tail], home[:tail], starts[:-1]
        else:
            kept, rows = [], 0
        if len(starts):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            nh = np.bincount(group[home], minlength=len(starts))
            nr = np.bincount(group[~home], minlength=len(starts))
            for a, b in _links(fp[home], fp[~home], nh, nr):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            cell, sub, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            kept.append((np.stack([cell, sub], axis=1), fp.astype(np.int64).view(np.uint64), home.astype(bool)))
            rows += len(cell)
            if rows >= ROWS_AT_ONCE:
                yield from flush(False)
    if rows:
        yield from flush(True)


def links(distinct_fps: DataFrame, cell_rows: int = CELL_ROWS, cover: Cover | None = None) -> DataFrame:
    """Links ``(u, v)`` whose components are those of "at most four bits differ" over ``fp``.

    An anchor with more than ``cell_rows`` homes or replicas is dealt over a grid of sub-cells, each home
    meeting each replica in exactly one, so no task compares an unbounded group and no pair is lost.
    """
    spark = distinct_fps.sparkSession
    cover = cover or cover_for(distinct_fps.count())
    dealt = distinct_fps.select("fp").mapInArrow(lambda b: _deal(b, cover), "cell long, fp long, home boolean")
    sizes = dealt.groupBy("cell").agg(F.count_if("home").alias("nh"), F.count_if(~F.col("home")).alias("nr"))
    hot = materialise(sizes.where((F.col("nh") > cell_rows) | (F.col("nr") > cell_rows)), "anchors")
    if hot.isEmpty():
        placed = dealt.withColumn("sub", F.lit(0))
    else:
        rows = F.greatest(F.lit(1), F.ceil(F.coalesce("nh", F.lit(0)) / cell_rows)).cast("int")
        cols = F.greatest(F.lit(1), F.ceil(F.coalesce("nr", F.lit(0)) / cell_rows)).cast("int")
        i = F.pmod(F.xxhash64("fp"), rows).cast("int")
        j = F.pmod(F.xxhash64("fp", F.lit(1)), cols).cast("int")
        along = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), cols - 1), lambda c: i * cols + c)).otherwise(
            F.transform(F.sequence(F.lit(0), rows - 1), lambda r: r * cols + j)
        )
        placed = dealt.join(hot, "cell", "left").select("cell", "fp", "home", F.explode(along).alias("sub"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.select("cell", "sub", "fp", "home").repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub")
    return ordered.mapInArrow(_compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id_col, fp, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most four differing bits. Equal
    fingerprints collapse before anything is compared. Rows with a null id take part in links but
    give no component id (null if all ids of a component are null); repeated rows stay; empty and
    null texts share fingerprint 0; an empty table gives an empty result; other columns are ignored.
    """
    own = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = components(links(nodes))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "roots")
    # A table of its own, so that the join is of two plain shuffles and a large component can be split.
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the smallest id stays.

    Links are pairs whose shingle sets have a Jaccard similarity of 0.8 or more (:mod:`near_copies`): wider
    fingerprints of ``width`` words meet at anchors and pairs are checked on the sets; four differing bits, the figure
    of op5, would miss most of them. Rows that repeat an id stay or go together; rows with a null id are
    never dropped; texts without words are alike; an empty table gives an empty result; columns are unchanged, whatever their names.
    """
    found = near_copies(docs, id_col, text_col, width)
    drop = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__id")).distinct()
    rows = docs.select(F.col(id_col).alias("__key"), F.struct("*").alias("__row"))
    return rows.join(drop, F.col("__key") == F.col("__id"), "left_anti").select("__row.*")


def op5_simhash(spark, sf_dir):
    """doc_id, fingerprint (hex), component_id over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
