"""The n-gram filter against sets of n-grams."""

import random
import re

import numpy as np
import pytest

from millrace.functions import membership as M
from millrace.operators import decontamination as D

SPACES = [" ", "\n", "\t", "\x0b", "\x85", "\xa0", " ", " ", "　"]


def plain_grams(text, n):
    words = [w for w in re.split("[\t-\r \x85\xa0  -     　]+", text or "") if w]
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def texts(seed, many, words):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "bé", "日本", "c.", "\x1c"]) + rng.choice(SPACES) * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, words))) for _ in range(many)]


@pytest.mark.parametrize("n", [1, 2, 5])
@pytest.mark.parametrize("chunk", [16, 1 << 18])
def test_keys_stand_for_ngrams(monkeypatch, n, chunk):
    """Equal runs of words have equal keys, whatever white space and pieces; others differ."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    rows = texts(n, 40, 60) + ["", "a", "x" * 100, "a " * 50]
    found, names = [[] for _ in rows], {}
    for text, keys, block, start, end in M.ngram_keys([r.encode() for r in rows], n):
        for t, k, a, b in zip(text.tolist(), keys.tolist(), start.tolist(), end.tolist()):
            gram = " ".join(M.words_of(block[a:b].decode()))
            found[t].append(gram)
            assert names.setdefault(gram, k) == k
    assert found == [plain_grams(r, n) for r in rows] and len(set(names.values())) == len(names)


@pytest.mark.parametrize("most", [8, 64, 1 << 20])
def test_a_filter_of_any_size_loses_nothing(spark, most):
    rows, bench = texts(1, 200, 40), texts(2, 30, 30) + [None]
    rows += [b for b in bench[:5]] + [None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    bench_df = spark.createDataFrame([(b,) for b in bench], "text string")
    index = {g for b in bench for g in plain_grams(b, 5)}
    want = {i for i, r in enumerate(rows) if index & set(plain_grams(r, 5))}
    assert 5 <= len(want) < len(rows)
    assert {r[0] for r in D.contaminated(docs, bench_df, n=5, filter_bytes=most).collect()} == want
    built = M.build_filter(bench_df, 5, most_bytes=most)
    assert len(built.blocks) * 8 <= most and len(built.blocks) & (len(built.blocks) - 1) == 0
    passed = {(r[0], r[1]) for r in M.probe(docs, built, 5, "doc_id", "text").collect()}
    assert {(i, g) for i, r in enumerate(rows) for g in plain_grams(r, 5) if g in index} <= passed


def test_false_alarms_are_few():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    blocks = 1 << (100_000 * M.KEY_BITS // 64).bit_length()
    held = np.zeros(blocks, np.uint64)
    np.bitwise_or.at(held, *M.BlockedFilter.places(keys[:100_000], blocks))
    found = M.BlockedFilter(held).may_have(keys)
    assert found[:100_000].all() and found[100_000:].mean() < 0.01
