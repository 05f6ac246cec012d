"""Gzip files of many members against a serial read."""

import gzip
import json
import random
import zlib

import pyarrow as pa
import pytest
from millrace.sources import gzip_lines as G
from millrace.sources import readers


def serial(path):
    return gzip.decompress(path.read_bytes()).decode().split("\n")


def by_parts(path, part_bytes):
    """Lines of every part, in order."""
    reader = G.GzipReader({"paths": json.dumps([str(path)]), "part_bytes": str(part_bytes)})
    return [[x for batch in reader.read(p) for x in batch.column(0).to_pylist()] for p in reader.partitions()]


@pytest.mark.parametrize("seed", range(6))
def test_any_cut_equals_the_serial_read(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(G, "READ", rng.choice([7, 64, 1000, 1 << 20]))
    text = "".join(rng.choice(["", "é", "x" * rng.randrange(300), str(rng.random())]) + "\n" * rng.randrange(3) for _ in range(400)).encode()
    cuts = sorted(rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 5, 60])))
    pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    path = tmp_path / "x.gz"
    path.write_bytes(b"".join(gzip.compress(p, rng.randrange(10)) + b"\0" * rng.choice([0, 0, 3]) for p in pieces))
    for part_bytes in (23, 100, 999, 1 << 20):
        assert [x for p in by_parts(path, part_bytes) for x in p] == serial(path), part_bytes


def test_headers_by_chance(tmp_path):
    # Stored without compression, a text holds what looks like headers.
    inner = b"a\n\x1f\x8b\x08\x00" + b"b" * 50 + b"\n\x1f\x8b\x08"
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(inner, 0) + gzip.compress(b"c\n", 0))
    for part_bytes in range(5, 60, 7):
        with pa.fs.LocalFileSystem().open_input_file(str(path)) as file:
            starts = [G.first_member(file, a, a + part_bytes) for a in range(0, path.stat().st_size, part_bytes)]
        assert [s for s in starts if s is not None] == [0, len(gzip.compress(inner, 0))]


def test_a_broken_file_is_an_error(tmp_path):
    parts = [gzip.compress(f"line {k}\n".encode() * 50) for k in range(20)]
    path = tmp_path / "x.gz"
    path.write_bytes(b"".join(parts)[:-5])
    for part_bytes in (7, 30, 64, 1 << 20):
        with pytest.raises(EOFError):
            by_parts(path, part_bytes)
    for k in range(20):
        # A changed checksum, which only the whole member shows.
        broken = parts[k][:-8] + bytes([parts[k][-8] ^ 1]) + parts[k][-7:]
        path.write_bytes(b"".join([*parts[:k], broken, *parts[k + 1 :]]))
        for part_bytes in (7, 30, 64, 1 << 20):
            with pytest.raises(zlib.error):
                by_parts(path, part_bytes)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [{"content": f"text é {k} " + "y" * (k % 90), "n": k} for k in range(5000)]
    lines = [json.dumps(r, ensure_ascii=False) for r in rows]
    lines[10:10] = ["", "  \t", "not json", '{"content": "half', '{"content": "n is no number", "n": "x"}']
    text = ("\n".join(lines) + "\n").encode()
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "x.jsonl.gz").write_bytes(b"".join(gzip.compress(text[a : a + 3000]) for a in range(0, len(text), 3000)))
    (folder / "_SUCCESS").write_bytes(b"")
    schema = "content string, n int"
    got = G.read_gzip_jsonl(spark, str(folder), schema, part_bytes=4000)
    assert got.schema == readers.read_jsonl(spark, str(folder), schema).schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, readers.read_jsonl(spark, str(folder), schema).collect()), key=str)
    assert got.count() == 5000
    lines = G.read_gzip_lines(spark, f"{folder}/*.gz", 4000)
    assert lines.rdd.getNumPartitions() > 4 and sum(n > 0 for n in lines.rdd.glom().map(len).collect()) > 4
    with pytest.raises(Exception, match="(?i)malformed"):
        G.read_gzip_jsonl(spark, str(folder), schema, strict=True).collect()
    # No data: an empty file, and a folder without files.
    (tmp_path / "none").mkdir()
    assert G.read_gzip_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "none/e.gz").write_bytes(b"")
    assert G.read_gzip_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
