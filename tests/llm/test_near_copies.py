"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_copies as N
from millrace.llm import simhash as H


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == x) for x in label}


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for edits in [0, 1, 2, 3, 4, 5, 6] * 12:
        words = [word() for _ in range(rng.randrange(120, 300))]
        rows.append((len(rows), " ".join(words)))
        for at in rng.sample(range(len(words)), edits):
            words[at] = word()
        rows.append((len(rows), " ".join(words)))
    chain = [word() for _ in range(150)]
    for k in range(20):  # neighbours alike, ends not
        chain[7 * k] = word()
        rows.append((len(rows), " ".join(chain)))
    base = [word() for _ in range(100)]
    for k in range(40):  # one bucket of many, alike and not
        rows.append((len(rows), " ".join(base[: 70 + k % 31] + [word() for _ in range(k % 7 * 5)])))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "Two  words"), (len(rows) + 3, "two WORDS"), (len(rows) + 4, "other words")]
    return rows


@pytest.mark.parametrize("cell_rows", [8192, 8])
def test_keep_one_equals_brute_jaccard(spark, cell_rows, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "__id": F.lit(2)})
    monkeypatch.setattr(N, "ROWS_AT_ONCE", 500)
    monkeypatch.setattr(H, "near_copies", lambda *a: N.near_copies(*a, cell_rows=cell_rows))
    out = H.keep_one(df)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == df.columns
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)


def test_sets_that_are_alike_meet_at_an_anchor():
    """The share of pairs of similarity 0.8 that meet, whatever the number of nodes."""
    rng = np.random.default_rng(5)
    for nodes in (1000, 1 << 26):
        blocks = N.blocks_for(nodes)
        made = []
        for _ in range(400):
            shared, own = rng.integers(0, 1 << 63, 160).astype(np.uint64), rng.integers(0, 1 << 63, 40).astype(np.uint64)
            made += [N.wide_fingerprint(np.concatenate([shared, own[:20]])), N.wide_fingerprint(np.concatenate([shared, own[20:]]))]
        cells = N.cells_of(np.stack(made).view(np.uint8), blocks)
        assert (cells[::2] == cells[1::2]).any(axis=1).mean() > 0.985
        assert (cells[:-2:2] == cells[3::2]).mean() < 0.01


def test_near_copies_of_nothing(spark):
    assert N.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_copies_does_not_give_all_its_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(300), 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    seen = []
    made = N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, name: seen.append((name, made(df, name))) or seen[-1][1])
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    pairs = {name: df.count() for name, df in seen if name.startswith("pairs")}
    assert pairs["pairs_nearest"] < 40 * len(rows) and pairs["pairs_rest"] < 10 * len(rows)


def test_small_sets_are_linked_exactly(spark):
    """Texts of a few words, of which fingerprints would miss many."""
    rng = random.Random(11)
    rows = []
    for _ in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 16))]
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words[: rng.randrange(len(words) - 1, len(words) + 1)] + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3))])))
    got = {r["id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == brute_kept(rows) and len(set(got.values())) < len(rows) - 20


@pytest.mark.parametrize("size", range(2, 12))
def test_recall_of_small_sets_is_one(spark, size):
    """All pairs of sets of this size, and of one more, of similarity 0.8 or more are in one component; others are not."""
    rng = np.random.default_rng(size)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, size + 2).astype(np.uint64))
        sets += [base[:size], np.delete(base[: size + 1], rng.integers(0, size)), base[: size + 1], base]
    rows = [(k, s.tobytes()) for k, s in enumerate(sets)]
    links = N.small_links(spark.createDataFrame(rows, "node long, small binary")).collect()
    label = list(range(len(sets)))

    def join(label, pairs):
        for a, b in pairs:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label

    least = int(N.SMALL_SET / 0.8)
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if i - j < 4 and max(len(sets[i]), len(sets[j])) <= least and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    known = [(r["u"], r["v"]) for r in links if max(len(sets[r["u"]]), len(sets[r["v"]])) <= least]
    assert join(label, known) == join(label, alike)


def test_a_hot_anchor_is_dealt_over_a_grid(spark):
    """All nodes at one anchor, 20 cells' worth: no cell holds more than its share, and all pairs of different roots still meet."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, cell_rows = [], 20
    for i in range(20 * cell_rows):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 12])):
            words[at] = f"x{rng.randrange(10**6)}"
        sketch = N.wide_fingerprint(N.shingle_set(" ".join(words).encode()), N.WIDE).tobytes()
        rows.append((i, i % 3 if i % 2 else -1, sketch))
    nodes = spark.createDataFrame(rows, "node long, root long, sketch binary")
    blocks = N.blocks_for(len(rows))[:2]
    hot = N.hot_anchors(nodes, blocks, cell_rows)
    assert hot.agg(F.max("n")).first()[0] > 4 * cell_rows
    cells = N.placed(nodes, blocks, hot, False, cell_rows).groupBy("cell", "sub").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    assert cells.where("sub >= 0").count() > 20
    top = cells.agg(F.max("homes"), F.max("guests")).first()
    assert max(top) < 2.5 * cell_rows
    plain = N.candidates(nodes, blocks, hot.limit(0), False, cell_rows=cell_rows)
    assert set(map(tuple, N.candidates(nodes, blocks, hot, False, cell_rows=cell_rows).collect())) == set(map(tuple, plain.collect()))


@pytest.mark.parametrize("copies", [3000])
def test_one_component_of_all_rows(spark, copies):
    rows = [(i, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " + ("" if i % 2 else f"x{i}")) for i in range(copies)]
    got = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=100).collect()
    assert {r["component_id"] for r in got} == {0}
