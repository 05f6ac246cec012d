"""Repeated strings and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import anchors as A
from millrace.llm import shingles as X
from millrace.llm import simhash as H
from millrace.llm import suffix_dedup as D
from millrace.llm.components import components


def brute_repeats(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    para = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [para(k) for k in (40, 80, 90, 100, 150, 300)]
    texts = []
    for _ in range(60):
        t = para(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(shared), rng.randint(0, 40)
            t += (p[a:] if rng.random() < 0.5 else p[: len(p) - a]) + para(rng.randint(0, 40))
        texts.append(t)
    texts += ["a" * 3000, "ab" * 900, "a" * 405, "", None, "Orre " * 500, texts[3], texts[3]]
    base = shared[5] * 2
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts


@pytest.mark.parametrize("group_rows", [8192, 5])
def test_repeats_equal_brute_force(spark, group_rows):
    texts = corpus()
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit(1)).repartition(3)
    want = Counter((i, *r) for (i, _), r in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], D.LENGTH)))
    out = D.remove_repeats(df, group_rows=group_rows).select("row.doc_id", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, out)) == want
    assert D.remove_repeats(df.limit(0)).count() == 0


def one_group():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab") for _ in range(736))
    parts = set()
    while len(parts) < 40:
        copy = bytearray(base)
        copy[rng.randrange(736)] = rng.choice(b"xyz")
        cut = rng.choice([0, 0, rng.randrange(300)])
        parts.add((bytes(copy[cut : 736 - rng.choice([0, rng.randrange(300)])]), 336 - cut))
    parts, n = sorted(parts), 40
    before = np.array([b for _, b in parts])
    return np.zeros(n, int), [p for p, _ in parts], before, np.arange(n) * 1000 + before, np.arange(n) % 5 > 0, np.zeros(n, int), np.full(n, 336)


def cover(spans):
    return {(i, x) for i, a, b in spans for x in range(a, b)}


def test_suffix_orders_decide(monkeypatch):
    """Both orders give what the bytes give; without a right order there is no answer but the fallback's."""
    args = one_group()
    want = cover(D._exact(args[1], args[2].tolist(), args[3].tolist(), args[4].tolist(), 0, 336, 400))
    assert want and cover(D.solve(*args)) == want
    two = [np.concatenate([args[0], args[0] + 1]), args[1] * 2, *(np.concatenate([x, x]) for x in args[2:])]
    n = len(args[1])
    assert cover(D.solve(*two)) == want | {(i + n, x) for i, x in want}
    monkeypatch.setattr(D, "_exact", lambda *a: [])
    assert cover(D.solve(*args)) == want
    monkeypatch.setattr(D, "suffix_order", lambda text, group, start, size: np.random.default_rng(0).permutation(len(start)))
    assert cover(D.solve(*args)) != want


def test_hash_collisions_are_caught(monkeypatch):
    """With hashes that lie, the bytes still decide."""
    args = one_group()
    want = cover(D.solve(*args))
    monkeypatch.setattr(D.PrefixHash, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
    assert cover(D.solve(*args)) == want


def test_long_text_in_chunks(monkeypatch):
    import pyarrow as pa

    data = np.random.default_rng(0).integers(97, 123, 20_000).astype(np.uint8)
    at, gram = D.anchor_places(data, np.zeros(len(data), int))
    monkeypatch.setattr(D, "CHUNK", 2048)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data.tobytes().decode()])], names=["k1", "k2", "text"])
    out = pa.Table.from_batches(list(D._anchors(iter([batch]), D.LENGTH, D.GRAM)))
    assert set(out["many"].to_pylist()) == {1} and sorted(out["at"].to_pylist()) == at.tolist() and Counter(out["gram"].to_pylist()) == Counter(gram.view(np.int64).tolist())
    assert all(((at >= i) & (at <= i + D.LENGTH - D.GRAM)).any() for i in range(0, len(data) - D.LENGTH, 97))


def test_texts_that_repeat_themselves_have_few_anchors(spark, monkeypatch):
    """Any period and any chunking give what brute force gives; a long run of one character gives few rows."""
    import pyarrow as pa

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefg") for _ in range(n))
    texts = []
    for p in (1, 2, 3, 17, 63, 64, 65, 130):
        unit = word(p)
        texts += [word(50) + unit * (rng.randint(900, 2500) // p) + word(rng.randint(0, 400)), word(90) + unit * (rng.randint(300, 900) // p) + word(40)]
    texts += ["z" * 1500 + "y" * 1500, "z" * 401, "ab" * 1000 + "ac" * 1000]
    want = Counter((i, *r) for i, r in enumerate(brute_repeats([t.encode() for t in texts], D.LENGTH)))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for chunk in (1 << 18, 1200):
        monkeypatch.setattr(D, "CHUNK", chunk)
        got = D.remove_repeats(df).select("row.doc_id", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
        assert Counter(map(tuple, got)) == want, chunk
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["x" * 1_000_000])], names=["k1", "k2", "text"])
    out = pa.Table.from_batches(list(D._anchors(iter([batch]), D.LENGTH, D.GRAM)))
    assert out.num_rows < 10_000 and sum(out["many"].to_pylist()) >= 990_000


def test_equal_surroundings_are_compared_by_bytes(spark, monkeypatch):
    """With one hash for all surroundings, classes are told apart by their bytes."""
    texts = corpus()
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(D, "_around", lambda part, before: before % 2)
    want = Counter((i, *r) for i, r in enumerate(brute_repeats([(t or "").encode() for t in texts], D.LENGTH)))
    assert Counter(map(tuple, D.remove_repeats(df).select("row.doc_id", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect())) == want


def test_drop_repeats_keeps_columns_and_valid_text(spark):
    shared = "é" * 300
    rows = [(1, "x" + shared, "l", 301), (2, shared + " own \ufffd words", "l", 316), (3, shared[:250], None, 250), (4, None, None, None), (5, "short", "l", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({"k1": F.lit(1), "m": F.create_map(F.lit("a"), F.lit(2)), "row": F.lit("r"), "a.b": F.lit(0)})
    out = {r["doc_id"]: r for r in D.drop_repeats(df).collect()}
    assert D.drop_repeats(df).columns == df.columns
    assert out[5]["text"] == "short" and out[2]["text"] == " own \ufffd words" and 3 not in out and out[1]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) and r["m"] == {"a": 2} for r in out.values()) and 4 in out


def brute_fingerprint(text, width=4):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("cover", [H.THREE, H.TWO])
@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_links_equal_brute_force(spark, cell_rows, cover):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for b in list(fps)[:25]:
        for _ in range(30):
            y = b
            for _ in range(rng.randint(1, 7)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    signed = fps.view(np.int64).tolist()
    near = [(signed[i], signed[j]) for i, x in enumerate(fps) for j in np.flatnonzero(np.bitwise_count(fps ^ x) <= 4) if i < j]
    got = H.links(spark.createDataFrame([(x,) for x in signed], "fp long"), cell_rows, cover).collect()
    assert classes(signed, [(r["u"], r["v"]) for r in got]) == classes(signed, near)
    assert len(got) < 20 * len(signed)


@pytest.mark.parametrize("cover", [H.THREE, H.TWO])
def test_every_point_is_covered(cover):
    points = np.random.default_rng(1).integers(0, 1 << 63, 200).astype(np.uint64)
    reached = set(zip(*(x.tolist() for x in A.anchors_of(points, cover.blocks, cover.code_bits, 1))))
    cells, rows = A.home_of(points, cover.blocks, cover.code_bits)
    assert set(zip(cells.tolist(), rows.tolist())) <= reached
    for number, (shift, bits) in enumerate(cover.blocks):
        own = cells >> 32 == number
        part = (points[rows[own]] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        assert set(rows[own].tolist()) == set(range(len(points)))
        assert (np.bitwise_count(part ^ (cells[own] & 0xFFFFFFFF).astype(np.uint64)) <= 1).all()


def test_shingles_in_chunks(monkeypatch):
    rng = random.Random(2)
    for text in (b"", b" \t", b"One  two", b"a b c d", b" ".join(rng.choice([b"x", b"Yy", b"zzz"]) for _ in range(700)), b"w" * 5000 + b" v u t s"):
        want = [np.concatenate([*X.shingle_hashes(text, w), np.zeros(0, np.uint64)]).tolist() for w in (1, 4)]
        monkeypatch.setattr(X, "CHUNK", 50)
        assert [np.concatenate([*X.shingle_hashes(text, w), np.zeros(0, np.uint64)]).tolist() for w in (1, 4)] == want
        monkeypatch.undo()


def test_near_duplicates_cases(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text.replace("word9 ", "other ")), (None, text), (7, ""), (8, None), (7, ""), (9, "One  two"), (10, "one TWO")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = [tuple(r) for r in H.near_duplicates(df).collect()]
    want = {i: brute_fingerprint(t) for i, t in rows}
    assert all(fp & (2**64 - 1) == want[i] for i, fp, _ in got) and len(got) == len(rows)
    comp = {i: c for i, _, c in got}
    assert comp[7] == comp[8] == 7 and comp[9] == comp[10] == 9 and comp[None] == comp[5]
    kept = sorted((r["doc_id"] or 0) for r in H.keep_one(df).collect())
    assert kept.count(7) == 2 and 8 not in kept and 10 not in kept and 0 in kept
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == classes(nodes, edges)


def test_simhash_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(fps)
    want = classes(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    got = H.op5_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids} and len(got) == len(ids)
