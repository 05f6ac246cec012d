"""Elias-Fano sequences and language model scores against plain counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm_scoring as L
from millrace.llm.common import held_out_fold
from millrace.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, most", [(0, 1), (1, 1), (1, 10**12), (5, 5), (1000, 1000), (1000, 10**6), (5000, 3000), (100, 2**40), (64, 192)])
def test_elias_fano(n, most):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, most, n))
    seq = EliasFano.of(values)
    assert (seq[np.arange(n)] == values).all()
    x = np.concatenate([values[:500], rng.integers(0, most + 5, 500)])
    a = rng.integers(0, n + 1, len(x))
    b = np.minimum(n, a + rng.integers(0, n + 1, len(x)))
    want = np.array([p + np.searchsorted(values[p:q], y) for y, p, q in zip(x, a, b)], np.int64)
    assert (seq.successor(x, a, b)[0] == want).all()
    distinct = np.unique(values)
    at = EliasFano.of(distinct).find(x, np.zeros(len(x), int), np.full(len(x), len(distinct)))
    assert ((at >= 0) == np.isin(x, distinct)).all() and (distinct[at[at >= 0]] == x[at >= 0]).all()


def brute(rows):
    """By row: held_out, n_tokens, n_known, train_tokens, base_score, score, from counts of whole words."""
    one, two, three = Counter(), Counter(), Counter()
    texts = [[None, *(t or "").encode().lower().split(), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    for s, h in zip(texts, held):
        if not h:
            one.update(s[1:])
            two.update(zip(s, s[1:]))
            three.update(zip(s, s[1:], s[2:]))
    total, distinct = sum(one.values()), len(one)
    out = []
    for (i, _), s, h in zip(rows, texts, held):
        base = score = 0.0
        for k in range(1, len(s)):
            p = (one[s[k]] + 1) / (total + distinct + 1)
            base += math.log10(p)
            p = (two[s[k - 1], s[k]] + L.PAIR_WEIGHT * p) / (one[s[k - 1]] + L.PAIR_WEIGHT)
            if k > 1:
                p = (three[s[k - 2], s[k - 1], s[k]] + L.TRIPLE_WEIGHT * p) / (two[s[k - 2], s[k - 1]] + L.TRIPLE_WEIGHT)
            score += math.log10(p)
        out.append((i, h, len(s) - 1, sum(one[w] > 0 for w in s[1:]), total, base, score))
    return out


def check(found, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    found = sorted(map(tuple, found), key=order)
    assert len(found) == len(want)
    for got, want in zip(found, sorted(want, key=order)):
        assert got[:5] == want[:5] and abs(got[5] - want[5]) < 1e-6 and abs(got[6] - want[6]) < 1e-3 * got[2]


def hostile():
    rng = random.Random(2)
    words = ["a", "A", "b", "Ä", "ä", "x\x0by", "longer", "\x85", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, " \n\t "), (None, "a b"), (3, rows[3][1]), (73, "w" * 5000), (74, "a b " * 3000), (75, "  a  b")]


@pytest.mark.parametrize("settings", [{}, {"part_tokens": 50, "shard_names": 40}, {"part_tokens": 1, "shard_names": 10**9}])
def test_scores_equal_brute_force(spark, settings):
    rows = hostile() if settings.get("part_tokens") != 1 else hostile()[:20]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    check(L.model_scores(df, held_out_fold("doc_id", 7) == 2, **settings).collect(), brute(rows))


def test_edges(spark):
    df = spark.createDataFrame(hostile(), "doc_id long, text string")
    assert L.model_scores(df.limit(0), F.lit(False)).count() == 0
    untrained = L.model_scores(df, F.lit(True)).collect()
    assert len(untrained) == df.count() and all(r["n_known"] == r["train_tokens"] == 0 and r["base_score"] == r["score"] == 0 for r in untrained)


@pytest.mark.parametrize("size", [16, 64])
def test_words_in_chunks(monkeypatch, size):
    """Long texts are cut at spaces; one word longer than a chunk stays whole."""
    texts = [(t or "").encode() for _, t in hostile()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def words():
        out = [[] for _ in texts]
        for k, edges in L._blocks(data, at):
            hashes, text = L.word_hashes(data[edges[0] : edges[-1]], edges - edges[0])
            for h, t in zip(hashes.tolist(), text.tolist()):
                out[k + t].append(h)
        return out

    whole = words()
    assert [len(w) for w in whole] == [len(t.split()) for t in texts]
    names = {}
    assert all(names.setdefault(w, h) == h for t, hs in zip(texts, whole) for w, h in zip(t.lower().split(), hs)) and len(set(names.values())) == len(names)
    monkeypatch.setattr(L, "CHUNK", size)
    assert words() == whole


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = L.op13_lm_scores(spark, SF)
    check(found.collect(), brute(rows))
    held = found.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


@pytest.mark.parametrize("seed", range(4))
def test_ngrams_of_one_name(monkeypatch, seed):
    """Names too short for their n-grams: no error, no probability above 1, and n-grams that share no name keep their scores."""
    monkeypatch.setattr(L, "NAME_BITS", 20)
    rng = np.random.default_rng(seed)
    texts = [np.minimum(rng.zipf(1.3, 60), 3000) for _ in range(70)]
    numbers = np.unique(np.concatenate(texts))
    tokens = np.concatenate([np.searchsorted(numbers, t) for t in texts]).astype(np.uint32)
    grams = L.Grams.of(np.sort(L.letters_mix(numbers.astype(np.uint64))), tokens, np.full(70, 60), np.ones(70, int))
    counts = grams.counts(np.repeat(np.arange(70) % 7 != 2, 60))
    names, place = np.unique(grams.names(0), return_inverse=True)
    sums = np.bincount(place, counts, len(names)).astype(np.int64)[place]
    many, n2 = len(grams.words), len(grams.pairs)
    words = counts[:many].sum(), (counts[:many] > 0).sum()
    want, found = (L.Trie(grams, x, *words).score(grams) for x in (counts, sums))
    one, two, three = np.split(counts == sums, [many, many + n2])
    two &= one[grams.pairs // many] & one[grams.pairs % many]
    three &= two[grams.triples // many] & two[grams.tail]
    assert not two.all() and not three.all()
    assert (found[0] <= 0).all() and (found[1] <= 0).all() and (found[0] == want[0])[two].all() and (found[1] == want[1])[three].all()
    # What no training text has stays unknown, whatever another n-gram adds to its name.
    one, two, three = np.split(counts.copy(), [many, many + n2])
    three[(two[grams.triples // many] == 0) | (two[grams.tail] == 0)] = 9
    two[(one[grams.pairs // many] == 0) | (one[grams.pairs % many] == 0)] = 9
    assert all(map(np.array_equal, L.Trie(grams, np.concatenate([one, two, three]), *words).score(grams), want))


def test_row_groups_of_parts(spark, monkeypatch):
    """However many parts a task writes, a reader unpacks a few at once."""
    tables = {}
    write = L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, name, *more: tables.setdefault(name, write(df, name, *more)))
    monkeypatch.setattr(L, "GROUP_BYTES", 1 << 17, raising=False)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(10000)), lambda i: F.xxhash64("doc_id", i)))
    df = spark.range(40).coalesce(1).withColumnRenamed("id", "doc_id").withColumn("text", text)
    assert L.model_scores(df, held_out_fold("doc_id", 7) == 2, part_tokens=10000).where("n_tokens = 10001").count() == 40
    groups = []
    for f in tables["parts"].inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file:")).metadata
        groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) >= 40 and max(groups) <= 4
