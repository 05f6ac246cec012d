"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read and cut into full sequences and a remainder, and a remainder of
more than ``PIECE`` tokens into even pieces. Pieces are dealt into groups of bounded size. In each group the
differencing method keeps a heap of partial partitions into k windows, and again and again merges the two of
largest spread with opposing imbalances (the fullest window of one joins the emptiest of the
other). The windows come out nearly equal; whenever one exceeds the capacity, k rises and the group is
partitioned again. Small pieces keep the windows so nearly equal that k seldom rises far. Token ids never
travel: a piece carries its checksum.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, utf8

CAPACITY = 2048
END_ID = 1
#: Pieces that one group packs, about; a larger input makes more groups, never larger ones.
GROUP_PIECES = 1024
#: Most tokens of a piece that is not a full sequence.
PIECE = 512
#: Low bits of a sequence id that number the windows of a group.
WINDOW_BITS = 24
VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = VOCABULARY, kind: str = "tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.{kind}")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function text -> token ids of the byte-level BPE vocabulary at ``path``.

    The ranks file holds the vocabulary of the JSON tokenizer of the same name, and tests hold the
    ids against that. Texts without two white-space characters in a row, nearly all, take a pattern
    without look-ahead, which gives the same pieces in half the time.
    """
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = tiktoken.Encoding("plain", pat_str=PATTERN.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})
    wide = re.compile(r"\s\s|\s\Z").search
    return lambda text: (whole if wide(text) else plain).encode_ordinary(text)


@functools.lru_cache(maxsize=2)
def added_encoder(path: str):
    """:func:`encoder`, with the ids of the JSON tokenizer's added tokens where a text holds them literally."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    plain = encoder(path)
    if not added:
        return plain
    cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return plain(text)
        return [i for k, part in enumerate(parts) if part for i in ([added[part]] if k % 2 else plain(part))]

    return encode


def cuts(tokens: int, capacity: int, piece: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: full ones, then the remainder, cut evenly if it is longer than ``piece``."""
    rest = tokens - tokens % capacity
    yield from ((a, capacity) for a in range(0, rest, capacity))
    many = -(-(tokens - rest) // piece)
    edges = [rest + (tokens - rest) * i // many for i in range(many + 1)] if many else []
    yield from ((a, b - a) for a, b in zip(edges, edges[1:]))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, piece: int = PIECE) -> DataFrame:
    """``(id_col, start, length, ids_crc32, doc_tokens[, ids])``: each document cut by :func:`cuts`.

    A document is its text's ids and the end id; a null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = added_encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(k, 1000)):
                    ids = np.array(encode(text.as_py()) + [END_ID], "<u4")
                    for a, n in cuts(len(ids), capacity, piece):
                        part = ids[a : a + n]
                        row.append(k + i)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=names)

    small_batches(docs.sparkSession)
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, schema)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k-1, of each item by multiway differencing; windows without items are empty."""
    n = len(sizes)
    follows = np.full(n, -1, np.int64)
    # A partial partition: its non-empty windows by falling sum, each a chain of items from head to tail.
    heap = [(-int(s), i, np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    if k == 1:
        return np.zeros(n, np.int64)
    heapq.heapify(heap)
    ticket = n
    while len(heap) > 1:
        _, _, a_sum, a_head, a_tail = heapq.heappop(heap)
        if len(a_sum) < k and len(heap[0][2]) == 1:
            # While a has an empty window its spread stays the largest: single items join it one after another.
            run = [heapq.heappop(heap)]
            while len(a_sum) + len(run) < k and heap and len(heap[0][2]) == 1:
                run.append(heapq.heappop(heap))
            total = np.concatenate([a_sum, [x[2][0] for x in run]])
            items = np.concatenate([a_head, [x[3][0] for x in run]]), np.concatenate([a_tail, [x[4][0] for x in run]])
            order = np.argsort(-total, kind="stable")
            total = total[order]
            spread = int(total[0] - (total[-1] if len(total) == k else 0))
            heapq.heappush(heap, (-spread, ticket, total, items[0][order], items[1][order]))
            ticket += 1
            continue
        _, _, b_sum, b_head, b_tail = heapq.heappop(heap)
        both = max(0, len(a_sum) + len(b_sum) - k)
        # With empty windows at the end of a and, turned round, at the start of b, so many windows have both.
        cut, split = len(a_sum) - both, len(b_sum) - both
        follows[a_tail[cut:]] = b_head[split:][::-1]
        total = np.concatenate([a_sum[:cut], a_sum[cut:] + b_sum[split:][::-1], b_sum[:split]])
        head = np.concatenate([a_head, b_head[:split]])
        tail = np.concatenate([a_tail[:cut], b_tail[split:][::-1], b_tail[:split]])
        order = np.argsort(-total, kind="stable")
        total, head, tail = total[order], head[order], tail[order]
        spread = int(total[0] - (total[-1] if len(total) == k else 0))
        heapq.heappush(heap, (-spread, ticket, total, head, tail))
        ticket += 1
    window = np.zeros(n, np.int64)
    at = heap[0][3]
    number = np.arange(len(at))
    while len(at):
        window[at] = number
        at = follows[at]
        number, at = number[at >= 0], at[at >= 0]
    return window


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none fuller than ``capacity``; items are at most that large, so k ends at one window an item."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while np.bincount(window := difference(sizes, k), sizes, k).max(initial=0) > capacity:
        k += 1
    return window


def _pack_group(capacity: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()
        order = np.lexsort([table["ids_crc32"].to_numpy(), table["start"].to_numpy(), -length])
        window = pack(length[order], capacity)
        by = np.argsort(window, kind="stable")
        table, window = table.take(pa.array(order[by])), window[by]
        length = table["length"].to_numpy()
        offset = np.cumsum(length) - length
        first = np.concatenate([[True], np.diff(window) > 0])
        offset -= np.maximum.accumulate(np.where(first, offset, 0))
        columns = {n: table[n] for n in table.column_names if n != "group"}
        columns |= {"sequence_id": pa.array((key[0].as_py() << WINDOW_BITS) | window, pa.int64()), "offset": pa.array(offset, pa.int64())}
        return pa.table(columns)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece: :func:`pieces` and its ``sequence_id`` and ``offset`` there.

    Full pieces are sequences of their own; the rest are packed in groups of about ``group_pieces`` (a few thousand at
    most), dealt evenly whatever their ids. Rows without an id and repeated rows are packed like others, a null or empty text is
    its end id; ties between pieces of equal length go by place and checksum; an empty table gives an empty
    result; other columns are ignored, whatever their names. A group's number has 38 bits, so there is room for more than 10^14 pieces.
    """
    cut = materialise(pieces(docs, path or vocabulary_path(), id_col, text_col, capacity, with_ids), "pieces")
    rows = cut.withColumn("row", F.monotonically_increasing_id())
    full, rest = rows.where(F.col("length") == capacity), rows.where(F.col("length") < capacity)
    groups = max(1, math.ceil(cut.where(F.col("length") < capacity).count() / group_pieces))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    fields = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in cut.columns) + ", sequence_id long, offset long"
    packed = dealt.groupBy("group").applyInArrow(_pack_group(capacity), fields)
    # Row numbers of full pieces and group numbers cannot meet: the former have bit 62 set.
    alone = full.select(*cut.columns, F.col("row").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def op4_packing(spark, sf_dir):
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
