"""Ranked lexical search by hierarchical max trees.

One scan counts, for each document, its terms and those that the queries use. A task then takes the documents of its
split in ranges: for each term there is a tree whose leaves are the term's shares in the documents' scores and whose inner nodes
are the largest share in a range of ``FAN``, ``FAN``^2, ... documents. A query starts at the top with the sum of its terms'
largest shares, the bound of any score below, and always opens the node with the highest bound. It ends when that bound
is below the score of the last of its best documents; nodes whose bound equals it are opened, as equal scores go by id.

Term counts never move; what is shuffled are the best documents of each query and task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_spans, discard, materialise, small_batches, utf8

TOP = 20
#: Children of a node.
FAN = 64
#: Documents and term counts that one tree holds at most, but for a single document; a task builds one tree after another.
TREE_DOCS, TREE_COUNTS = 1 << 15, 1 << 22
#: Words of queries that one scan of the documents is held against.
BLOCK_WORDS = 500_000
#: Bytes of a text whose terms are listed at once.
CHUNK = 1 << 20
#: A-Z lower-cased; all other ASCII characters but digits and letters end a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 0x7F or chr(c).isalnum() else 32 for c in range(256))
_ENDS = frozenset(c for c in range(128) if not chr(c).isalnum())


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, those of a long one in several lists."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and text[end] not in _ENDS:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


@dataclass(frozen=True)
class Queries:
    """A block of queries: the numbers of their terms, and of each query its terms and how often it has each."""

    ids: list
    terms: dict[bytes, int]
    own: list[tuple[np.ndarray, np.ndarray]]


def query_blocks(queries: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[Queries]:
    """The queries that have a term, read partition by partition, in blocks of about ``block_words`` words."""
    ids, terms, own, held = [], {}, [], 0
    for row in queries.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).toLocalIterator():
        found: Counter = Counter()
        for part in terms_of(row["text"].encode()):
            found.update(part)
        if not found:
            continue
        if held and held + sum(found.values()) > block_words:
            yield Queries(ids, terms, own)
            ids, terms, own, held = [], {}, [], 0
        ids.append(row["id"])
        own.append((np.array([terms.setdefault(t, len(terms)) for t in found], np.int64), np.array(list(found.values()), np.int64)))
        held += sum(found.values())
    if ids:
        yield Queries(ids, terms, own)


def term_counts(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)`` of each row: how many terms it has with repeats, and the numbers and counts of those among ``terms``."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            data, at = byte_spans(batch.column(1))
            sizes, own, tfs = [], [], []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                found: Counter = Counter()
                n = 0
                for part in terms_of(bytes(data[a:b])):
                    n += len(part)
                    found.update(part)
                known = found.keys() & number.keys()
                sizes.append(n)
                own.append([number[t] for t in known])
                tfs.append([found[t] for t in known])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tfs"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


def shares(w: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What a term that occurs ``tf`` times in a document of ``n`` terms adds to its score."""
    m = 75 + (25 * n * documents) // words
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class MaxTree:
    """Trees of maxima over document ranges, one for each term. Level 0 are the documents, in order of id."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, share: np.ndarray, fan: int = FAN) -> None:
        self.ids, self.fan = ids, fan
        order = np.lexsort([doc, term])
        term, place, top = term[order], doc[order], share[order]
        # By level: the range of each entry, its largest share, and the first of its entries one level below.
        self.levels = [(place, top, None)]
        while len(place) and place.max() > 0:
            place = place // fan
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (place[1:] != place[:-1])]))
            top = np.maximum.reduceat(top, first)
            self.levels.append((place[first], top, np.append(first, len(place))))
            term, place = term[first], place[first]
        self.roots = dict(zip(term.tolist(), range(len(term))))

    def search(self, terms: np.ndarray, times: np.ndarray, best: list[tuple[int, int, int]], most: int) -> int:
        """Puts documents into the heap ``best`` of ``(score, -id, number)``; how many nodes it opened."""
        have = [(self.roots[t], q) for t, q in zip(terms.tolist(), times.tolist()) if t in self.roots]
        if not have:
            return 0
        at, times = (np.array(x, np.int64) for x in zip(*have))
        level = len(self.levels) - 1
        heap = [(-int((self.levels[level][1][at] * times).sum()), 0, level, 0, at, times)]
        tie = opened = 0
        while heap:
            bound, _, level, place, at, times = heapq.heappop(heap)
            if len(best) >= most and -bound < best[0][0]:
                break
            if level == 0:
                self._take(-bound, place, best, most)
                continue
            opened += 1
            first = self.levels[level][2]
            size = first[at + 1] - first[at]
            below = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ranges, top, _ = self.levels[level - 1]
            child = ranges[below] - place * self.fan
            times = np.repeat(times, size)
            bounds = np.zeros(self.fan, np.int64)
            np.add.at(bounds, child, top[below] * times)
            least = best[0][0] if len(best) >= most else 1
            good = np.flatnonzero(bounds >= max(1, least))
            if level == 1:
                # Single documents: their bounds are their scores.
                for k in good[np.argsort(-bounds[good], kind="stable")].tolist():
                    self._take(int(bounds[k]), place * self.fan + k, best, most)
                continue
            order = np.argsort(child, kind="stable")
            edges = np.searchsorted(child[order], np.arange(self.fan + 1))
            for k in good.tolist():
                own = order[edges[k] : edges[k + 1]]
                tie += 1
                heapq.heappush(heap, (-int(bounds[k]), tie, level - 1, place * self.fan + k, below[own], times[own]))
        return opened

    def _take(self, score: int, place: int, best: list[tuple[int, int, int]], most: int) -> None:
        row = (score, -int(self.ids[place]), place)
        if score > 0 and len(best) < most:
            heapq.heappush(best, row)
        elif score > 0 and row[:2] > best[0][:2]:
            heapq.heapreplace(best, row)


#: Stands for a null id, which comes last.
NO_ID = np.iinfo(np.int64).max


def _searched(queries: Queries, w: np.ndarray, documents: int, words: int, top: int, fan: int, tree_docs: int, tree_counts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.own]
        kept: list[tuple] = []
        held = [0, 0]

        def search() -> None:
            ids, n, size, term, tf = (np.concatenate([k[i] for k in kept]) for i in range(5))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = np.repeat(np.arange(len(ids)), size)
            tree = MaxTree(ids[order], term, place[doc], shares(w[term], tf, n[doc], documents, words), fan)
            for own, heap in zip(queries.own, best):
                tree.search(*own, heap, top)
            kept.clear()
            held[:] = 0, 0

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                ids, n = part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy()
                terms, tfs = part.column(2), part.column(3)
                size = np.diff(terms.offsets.to_numpy())
                if held[0] and (held[0] + len(ids) > tree_docs or held[1] + size.sum() > tree_counts):
                    search()
                kept.append((ids, n, size, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
                held[0] += len(ids)
                held[1] += int(size.sum())
        if kept:
            search()
        for k, heap in enumerate(best):
            if heap:
                score, ids, _ = zip(*heap)
                found = pa.array([None if -i == NO_ID else -i for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(heap), pa.int64()), pa.array([queries.ids[k]] * len(heap), pa.int64()), found, pa.array(score, pa.int64())], names=["query", "item_id", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block_words: int = BLOCK_WORDS, fan: int = FAN, tree_docs: int = TREE_DOCS, tree_counts: int = TREE_COUNTS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of highest score above 0 of each row of ``queries``.

    A term is a run of characters other than ASCII ones that are no digit or letter; A-Z are lower-cased. Its weight and its share in a
    score are those of :func:`weight` and :func:`shares`; a query's repeated terms count again. Equal scores go by id. Null and empty
    texts have no terms and no results. Ids are whole numbers; a null id comes last among equal scores. Repeated rows of documents are
    documents of their own, of queries too, so an item's ranks then occur again. An empty table on either side gives an empty result; other
    columns are ignored. Queries are taken in blocks of about ``block_words`` words, a scan of the documents for each; a block's
    words are what the driver and the tasks hold of the queries. Every document is searched.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "query long, item_id long, doc_id long, score long")
    blocks = query_blocks(queries, item_col, item_text_col, block_words)
    block, number = next(blocks, None), 0
    while block is not None:
        after = next(blocks, None)
        counts = materialise(term_counts(docs, block.terms, id_col, text_col), "term_counts")
        documents, words = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        with_term = counts.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        w = np.zeros(len(block.terms), np.int64)
        for t, n in zip(with_term["t"].to_pylist(), with_term["count"].to_pylist()):
            w[t] = weight(documents, n)
        best = counts.mapInArrow(_searched(block, w, documents, words, top, fan, tree_docs, tree_counts), found.schema)
        if after is not None:
            best = materialise(best, "ranked")
            discard(counts)
        found = found.unionByName(best.withColumn("query", F.col("query") + (number << 32)))
        block, number = after, number + 1
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_search(spark, sf_dir):
    """The 20 best documents of all for each benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))".format(_UPPER, _LOWER)
OP12_SQL = f"""
with words as (select doc_id, {_TERMS} as t from documents),
sized as (select doc_id, count(*) as n from words group by doc_id),
total as (select count(*) as docs, sum(n)::bigint as ws from sized),
asked as (select item_id, t, count(*) as q from (select item_id, {_TERMS} as t from benchmark) group by item_id, t),
counts as (select doc_id, t, count(*) as tf from words where t in (select t from asked) group by doc_id, t),
weights as (select t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from counts, total group by t, docs),
shares as (
  select doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // ws))) as share from counts join weights using (t) join sized using (doc_id), total
),
scored as (select item_id, doc_id, sum(q * share)::bigint as score from asked join shares using (t) group by item_id, doc_id having sum(q * share) > 0)
select item_id, rank, doc_id, score from (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from scored) where rank <= 20
"""
