"""Ranked search against scores of all documents."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from millrace.llm import search as S

COLUMNS = ["item_id", "rank", "doc_id", "score"]


def plain_terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def brute(docs, items, top):
    terms = [Counter(plain_terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    documents, words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, n in zip(docs, terms, sizes):
            if n:
                m = 75 + 25 * n * documents // words
                score = sum(q * S.weight(documents, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(plain_terms(text)).items() if c[t])
                if score > 0:
                    scored.append((-score, doc))
        out += [(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def corpus():
    rng = np.random.default_rng(1)
    words = ["Ab", "ab", "ÄÖ", "äö", "x1", "q", "the", "the", "the", "no-no", "z_z", "1", "日本"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "the"), (205, "the"), (204, "the"), (206, "ab " * 5000)]
    items = [(1, "the Ab x1"), (2, "the"), (3, "q q q ÄÖ"), (4, None), (5, ""), (6, "unheard of"), (7, "日本,1;no the")]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"fan": 2, "tree_docs": 7}, {"fan": 3, "block_words": 3}, {"tree_counts": 5}])
def test_ranking_equals_all_scores(spark, settings):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, S.ranked(d, q, top=20, **settings).select(COLUMNS).collect())) == brute(docs, items, 20)


def test_edges(spark):
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert S.ranked(d.limit(0), q).count() == S.ranked(d, q.limit(0)).count() == 0
    twice = S.ranked(spark.createDataFrame([(None, "ab"), (3, "ab"), (3, "ab"), (1, "c c")], "doc_id long, text string"), q.where("item_id = 1").union(q.where("item_id = 1")))
    assert Counter((r["rank"], r["doc_id"]) for r in twice.collect()) == Counter({(1, 3): 2, (2, 3): 2, (3, None): 2})


def test_bounds_leave_most_nodes_closed():
    """The tree ends early where one document stands out, and opens every node where all are equal."""
    n = 4096
    share = np.ones(n, np.int64)
    tree = S.MaxTree(np.arange(n), np.zeros(n, int), np.arange(n), share)
    best = []
    assert tree.search(np.array([0]), np.array([1]), best, 3) == 65 and sorted(best) == [(1, -2, 2), (1, -1, 1), (1, 0, 0)]
    share[[100, 1000, 4000]] = 9
    best = []
    assert S.MaxTree(np.arange(n), np.zeros(n, int), np.arange(n), share).search(np.array([0]), np.array([1]), best, 3) == 4
    assert sorted(-i for _, i, _ in best) == [100, 1000, 4000]


def test_long_text_in_chunks(monkeypatch):
    text = ("Wörter, 12 and MORE; " * 300).encode()
    want = plain_terms(text.decode())
    monkeypatch.setattr(S, "CHUNK", 64)
    assert [t.decode() for part in S.terms_of(text) for t in part] == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({S.OP12_SQL})").fetchall()
    assert Counter(map(tuple, S.op12_search(spark, sf).select(COLUMNS).collect())) == Counter(want)
