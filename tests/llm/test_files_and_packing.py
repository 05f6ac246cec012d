"""Archives and token files by round trip, packing by brute force."""

import gzip
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing as P
from millrace.llm import token_files as K
from millrace.llm import warc as W
from millrace.llm.common import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def json_ids():
    """The ids that packing promises: the JSON tokenizer as it is, added tokens included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_json_tokenizer(spark, reference):
    encode = P.encoder(P.vocabulary_path())
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  ", "a  b", " a ", "a\n", "a \n b", "\n\n x\t\ty ", "<|endoftext|> it's 12½", " x  ", "\x1ca b\x1f", "日本語 😀", "x\x85y"]
    for text in texts:
        assert encode(text) == reference(text), repr(text[:80])


def check_packing(rows, want_ids, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, ids in want_ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_every_id_once(spark, json_ids):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: json_ids(r["text"] or "") + [1] for r in docs.collect()}
    n = check_packing(P.op4_packing(spark, SF).collect(), want, 2048)
    assert sum(map(len, want.values())) > 0.97 * 2048 * n


def test_packing_cases(spark, json_ids):
    rows = [(1, None), (2, ""), (3, "x " * 5000), (4, "a  b"), (5, "x <|endoftext|> y"), (6, "long " * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("clash"), "group": F.lit(1), "row": F.lit(2), "ids": F.lit(3)})
    check_packing(P.pack_documents(df, capacity=64, group_pieces=2).collect(), {i: json_ids(t or "") + [1] for i, t in rows}, 64)
    check_packing(P.pack_documents(df).collect(), {i: json_ids(t or "") + [1] for i, t in rows}, 2048)
    twice = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    rows = P.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    assert P.pack_documents(twice, with_ids=True).count() == 2 and P.pack_documents(df.limit(0)).count() == 0


def test_differencing():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (5, 3), (40, 7), (200, 40), (3, 5)):
        sizes = rng.integers(1, 2048, n)
        window = P.difference(sizes, k)
        assert len(window) == n and window.min() >= 0 and window.max() < k
    # The textbook case: differencing 8, 7, 6, 5, 4 in two gives 16 and 14.
    assert sorted(np.bincount(P.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    sums = np.bincount(P.difference(np.full(60, 7), 6), np.full(60, 7))
    assert set(sums) == {70}


def plain_difference(sizes, k):
    """The method as it is described: lists of k windows, merged by opposing order."""
    heap = [(-s, i, [(0, [])] * (k - 1) + [(s, [i])]) for i, s in enumerate(sizes)]
    ticket = len(heap)
    while len(heap) > 1:
        heap.sort()
        (_, _, a), (_, _, b) = heap.pop(0), heap.pop(0)
        both = sorted((x + y, i + j) for (x, i), (y, j) in zip(sorted(a), sorted(b, reverse=True)))
        heap.append((both[0][0] - both[-1][0], ticket, both))
        ticket += 1
    return sorted(s for s, _ in heap[0][2])


def test_differencing_decides_the_windows():
    rng = np.random.default_rng(3)
    for n, k in ((6, 2), (9, 3), (30, 4), (24, 7)):
        sizes = np.sort(rng.choice(100_000, n, replace=False))[::-1]
        assert sorted(np.bincount(P.difference(sizes, k), sizes, k).astype(int)) == plain_difference(sizes.tolist(), k)


def test_windows_rise_until_none_is_too_full():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 2048, 300), rng.integers(1, 513, 1000), np.full(10, 2047), np.full(10, 1025), np.array([1])):
        sizes = np.sort(sizes)[::-1]
        window = P.pack(sizes, 2048)
        k = window.max() + 1
        assert np.bincount(window, sizes).max() <= 2048
        least = -(-int(sizes.sum()) // 2048)
        assert all(np.bincount(P.difference(sizes, j), sizes, j).max() > 2048 for j in range(least, k))
    assert k == 1


def test_cuts():
    for tokens in (1, 512, 513, 2047, 2048, 2049, 5000):
        got = list(P.cuts(tokens, 2048, 512))
        assert [a for a, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))] and sum(n for _, n in got) == tokens
        assert all(n == 2048 or 1 <= n <= 512 for _, n in got)


def test_archives_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = Counter(tuple(r) for r in con.execute(W.OP3_SQL).fetchall())
    got = W.op3_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == want


def test_archives_round_trip(spark):
    nasty = "é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60
    rows = [(1, "u", "x" * 1000), (2, "u", "x" * 1000), (3, None, None), (None, "a b\r\n", "x" * 1000), (5, "q", nasty), (6, "q", nasty), (6, "q", nasty), (7, "z", "y" * 999), (8, "z", "y" * 999), (9, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch_path(spark, "test")
    W.write_archives(df, path)
    got = W.resolve(W.read_archives(spark, path, with_payload=True)).collect()
    kinds = Counter((r["page"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter([("1", "revisit", "2"), ("2", "response", None), ("3", "response", None), ("null", "revisit", "2"), ("5", "revisit", "6"), ("6", "response", None), ("6", "response", None), ("7", "response", None), ("8", "response", None), ("9", "response", None)])
    payloads = {r["page"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert payloads["6"] == nasty and payloads["3"] == ""
    assert all(r["bytes"] == len((dict((str(i), h) for i, _, h in rows).get(r["page"]) or "").encode()) for r in got if r["page"] != "null")
    empty = scratch_path(spark, "test")
    W.write_archives(df.limit(0), empty)
    assert W.read_archives(spark, empty).count() == 0


def test_damaged_archives_are_refused(spark):
    with pytest.raises(ValueError):
        list(W.parse_records(gzip.compress(b"no record\r\n\r\n")))
    path = scratch_path(spark, "test")
    W.write_archives(spark.createDataFrame([(i, "u", "payload " * 500 + str(i)) for i in range(20)], "page_id long, url string, html string").coalesce(1), path)
    whole = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()][0]
    for part in (whole[:-20], gzip.compress(gzip.decompress(whole)[:5000])):
        with pytest.raises(ValueError):
            list(W.parse_records(part))


def test_pages_of_uneven_size_share_no_huge_file(spark, monkeypatch):
    """One partition of many small and some large pages: every file keeps to the bound, or holds one record."""
    monkeypatch.setattr(W, "SHORT_BYTES", 64)
    monkeypatch.setattr(W, "FILE_RECORDS", 32)
    rows = [(i, "u", "z" * (20 + i if i % 10 else 100 * (i + 1))) for i in range(200)]
    path = scratch_path(spark, "test")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = [list(W.parse_records(bytes(r["content"]))) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    sizes = [[len(block.partition(b"\r\n\r\n")[2]) for _, block in f] for f in files]
    assert sorted(x for f in sizes for x in f) == sorted(len(r[2]) for r in rows)
    assert all(len(f) == 1 or sum(f) <= 32 * 64 for f in sizes)


def test_archives_are_read_in_parts(spark, monkeypatch):
    rows = [(i, "u", ("é" * i) + "\r\n\r\n" + "z" * (i * 300)) for i in range(40)]
    path = scratch_path(spark, "test")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    whole = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).where("length > 0").collect()]
    monkeypatch.setattr(W, "READ_BYTES", 16)
    for data in whole:
        plain = gzip.decompress(data)
        half = len(plain) // 2
        for form in (data, plain, gzip.compress(plain[:half]) + gzip.compress(plain[half:])):
            got = {h["x-page-id"]: block.partition(b"\r\n\r\n")[2].decode() for h, block in W.parse_records(form)}
            assert got == {str(i): t for i, _, t in rows}


def test_a_common_payload_and_a_long_one(spark, monkeypatch):
    """A third of all pages share a payload; one payload is of some megabytes; keys are joined either way."""
    rows = [(i, "u", "same " * 300 if i % 3 == 0 else f"own {i} " * 200) for i in range(600)] + [(1000, "u", "x" * (5 << 20)), (1001, "u", "x" * (5 << 20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for most in (0, 200_000):
        monkeypatch.setattr(W, "BROADCAST_REVISITS", most)
        path = scratch_path(spark, "test")
        W.write_archives(df, path)
        got = {r["page"]: (r["record_type"], r["refers_to"]) for r in W.resolve(W.read_archives(spark, path)).collect()}
        assert len(got) == len(rows) and got["1000"] == ("revisit", "1001") and got["1001"] == ("response", None)
        assert all(got[str(i)] == (("revisit", "597") if i % 3 == 0 and i != 597 else ("response", None)) for i in range(600))


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 18])
def test_token_files(spark, reference, block, tmp_path):
    np.array([5, K.END_ID, K.END_ID, 1, 2, 3, 4, 5, 6, 7, 8, 9, K.END_ID, 7, 7, 7], K.ID_TYPE).tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    got = [tuple(r) for r in K.count_tokens(spark, str(tmp_path), block_tokens=block).orderBy("document").collect()]
    assert got == [("a.bin", 0, 1, True), ("a.bin", 1, 0, True), ("a.bin", 2, 9, True), ("a.bin", 3, 3, False)]


def test_token_files_of_documents(spark, reference, monkeypatch):
    # Size classes of their own, so that several folders are written.
    monkeypatch.setattr(K, "SHORT_BYTES", 1000)
    want = Counter(len(reference(r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = K.op6_token_counts(spark, SF).collect()
    assert Counter(r["n_tokens"] for r in rows) == want and len({(r["size"], r["part"], r["file"], r["document"]) for r in rows}) == len(rows) and len({r["size"] for r in rows}) > 2
    docs = spark.createDataFrame([(None,), ("",), ("a",)], "text string").coalesce(1).withColumn("size", F.lit("clash"))
    path = scratch_path(spark, "test")
    K.write_token_files(docs, path)
    assert [r["n_tokens"] for r in K.count_tokens(spark, path, block_tokens=1).orderBy("document").collect()] == [0, 0, 1]
    for end in (5, 50256, 1 << 15, 0xC4A1 - 0x21 - 300):
        with pytest.raises(Exception):
            K.write_token_files(spark.createDataFrame([("a b c d",)], "text string"), scratch_path(spark, "test"), end_id=end)


def test_token_files_are_flat_ids(spark, reference, monkeypatch):
    """The files read as plain 16-bit ids, long texts in files of their own, repeated rows and an empty table included."""
    texts = ["", None, "one two", "one two", "Ā Ā <|endoftext|>", "word " * 3000, "é" * 200]
    monkeypatch.setattr(K, "SHORT_BYTES", 64)
    path = scratch_path(spark, "test")
    K.write_token_files(spark.createDataFrame([(t,) for t in texts], "text string"), path, file_documents=4)
    found, sizes = [], []
    for r in spark.read.format("binaryFile").load(path).where("length > 0").collect():
        ids = np.frombuffer(r["content"], ">u2")
        ends = np.flatnonzero(ids == K.END_ID)
        assert ends[-1] == len(ids) - 1
        parts = np.split(ids, ends + 1)[:-1]
        sizes.append(len(parts))
        found += [tuple(x[:-1].tolist()) for x in parts]
    assert Counter(found) == Counter(tuple(reference(t or "")) for t in texts) and max(sizes) <= 4
    got = K.count_tokens(spark, path, block_tokens=100).collect()
    assert Counter(r["n_tokens"] for r in got) == Counter(len(x) for x in found)
    empty = scratch_path(spark, "test")
    K.write_token_files(spark.createDataFrame([], "text string"), empty)
    assert K.count_tokens(spark, empty).count() == 0
