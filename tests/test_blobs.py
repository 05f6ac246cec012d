"""The blob source on local files, and on a local server that fails now and then."""

import gzip
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from millrace.sources import blobs, readers


@pytest.fixture
def store(tmp_path):
    for k in range(30):
        (tmp_path / f"b {k}").write_bytes(gzip.compress(f"text {k}".encode()))
    (tmp_path / "large").write_bytes(b"x" * 5000)
    (tmp_path / "index").write_text("\n".join([f"b {k}" for k in range(30)] + ["lost", "large", "b 3", ""]))
    return f"file://{tmp_path}"


def test_blobs_of_an_index(spark, store):
    df = blobs.read_blobs(spark, store, f"{store}/index", requests=4, wait=0.0, max_kb=4)
    got = {r["blob_id"]: r for r in df.collect()}
    assert len(got) == 32 == df.count() and got["large"]["error"] == "too large" and got["lost"]["content"] is None and got["lost"]["error"]
    texts = readers.valid_blobs(readers.gunzip_blobs(df.where("error is null").withColumn("src_encoding", F.lit("utf-8"))))
    assert {r["blob_id"]: r["text"] for r in texts.collect()} == {f"b {k}": f"text {k}" for k in range(30)}
    assert df.rdd.getNumPartitions() == 4


def test_names_are_pushed_down(spark, store):
    df = blobs.read_blobs(spark, store, f"{store}/index")
    some = df.where(F.col("blob_id").isin("b 1", "b 2", "not listed"))
    assert some.rdd.getNumPartitions() == 2 and {r["blob_id"] for r in some.collect()} == {"b 1", "b 2"}
    named = blobs.read_blobs(spark, store).where("blob_id = 'b 7' and content is not null")
    assert [r["blob_id"] for r in named.collect()] == ["b 7"]
    with pytest.raises(Exception, match="index"):
        blobs.read_blobs(spark, store).collect()


def test_failed_reads_are_tried_again(spark):
    asked, now, most, lock = Counter(), [0], [0], threading.Lock()

    class Store(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.strip("/")
            with lock:
                asked[name] += 1
                now[0] += 1
                most[0] = max(most[0], now[0])
            code = 404 if name == "gone" else 503 if name == "down" or name == "shaky" and asked[name] < 3 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"content" if code == 200 else b"")
            with lock:
                now[0] -= 1

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = blobs.read_blobs(spark, f"http://127.0.0.1:{server.server_port}", requests=2, attempts=3, wait=0.01)
        names = ["gone", "down", "shaky", *[f"n{k}" for k in range(20)]]
        got = {r["blob_id"]: (r["content"], r["error"]) for r in df.where(F.col("blob_id").isin(names)).collect()}
    finally:
        server.shutdown()
    assert got.pop("gone") == (None, "HTTP 404") and got.pop("down") == (None, "HTTP 503")
    assert len(got) == 21 and all(bytes(c) == b"content" and e is None for c, e in got.values())
    assert asked["gone"] == 1 and asked["down"] == asked["shaky"] == 3 and most[0] <= 2
