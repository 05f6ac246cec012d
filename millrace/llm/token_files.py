"""Token counts of flat, unindexed token files, by separator scan.

A token file is nothing but 16-bit big-endian ids, one document after another, each ended by the
end-of-document id; nothing says where documents begin. Files are looked at in blocks of fixed size, each
searched for the id in one vectorised comparison, on its own; a prefix scan over the blocks of a
file then says which document each block begins in and stitches the lengths of those that cross blocks.

Spark's text writer commits the files, on any file system that Spark reaches: a "line" is a document's ids and the
line separator the end id. That is why the end id, 50,304, is one beyond the vocabulary whose two bytes spell a character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, utf8
from .packing import encoder, vocabulary_path

END_ID = 0xC480
ID_TYPE = ">u2"
BLOCK_TOKENS = 1 << 18
#: Documents per file, at most, of texts below ``SHORT_BYTES``; texts of up to four times that go a quarter to a file, and so on.
FILE_DOCUMENTS = 4_000
SHORT_BYTES = 1 << 16


def write_token_files(docs: DataFrame, out: str, text_col: str = "text", path: str | None = None, end_id: int = END_ID, file_documents: int = FILE_DOCUMENTS) -> None:
    """Tokenise the texts where they lie and write them as flat token files below ``out``.

    A null or empty text is the end id alone; repeated rows are documents each; an empty table gives no ids; other columns are
    ignored, whatever their names. Longer texts share a file with fewer others, in a folder of their size class, so a file
    stays below 512 MB unless one text is larger. Each task numbers its files of a class as it reads, so one scan writes all. The end id is beyond the vocabulary, and its two bytes are one UTF-8 character.
    """
    separator = int(end_id).to_bytes(2, "big")
    try:
        line_end = separator.decode()
    except UnicodeDecodeError:
        line_end = ""
    if len(line_end) != 1:
        raise ValueError("the bytes of the end id must be one UTF-8 character")
    vocabulary = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        written = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                lines, sizes, files = [], batch.column(1).slice(k, 1000), []
                for text, size in zip(batch.column(0).slice(k, 1000), sizes.to_pylist()):
                    ids = np.array(encode(text.as_py()), np.int64)
                    if len(ids) and ids.max() >= end_id:
                        raise ValueError("the end id is in the vocabulary, or ids exceed 16 bits")
                    lines.append(ids.astype(ID_TYPE).tobytes())
                    files.append(written[size] // max(1, file_documents >> (2 * size)))
                    written[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), sizes, pa.array(files, pa.int32())], names=["line", "size", "file"])

    # Times four above SHORT_BYTES, as a whole number from 0.
    size = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.octet_length("text"), F.lit(1)) / F.lit(float(SHORT_BYTES))))).cast("int")
    lines = docs.select(utf8(text_col).alias("text")).select("text", size.alias("size")).mapInArrow(run, "line binary, size int, file int")
    lines.select(F.col("line").cast("string").alias("value"), "size", "file").write.partitionBy("size", "file").option("lineSep", line_end).text(out)


def _scan(batches: Iterator[pa.RecordBatch], end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Per block: tokens before its first end id (or all), tokens after its last, and the lengths in between."""
    names = ["file", "block", "tokens", "ends", "head", "tail", "inner"]
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            if len(content.as_buffer()) % 2:
                raise ValueError(f"{file} ends within an id")
            whole = np.frombuffer(content.as_buffer(), ID_TYPE)
            for block, a in enumerate(range(0, len(whole), size)):
                ids = whole[a : a + size]
                at = np.flatnonzero(ids == end_id)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - 1 - int(at[-1]) if len(at) else len(ids)
                values = [[block], [len(ids)], [len(at)], [head], [tail]]
                columns = [pa.array([file]), *(pa.array(v, pa.int64()) for v in values), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, document, n_tokens, ended)``: of each document of each file below ``path``, in order, its ids without the end id.

    Ids after a file's last end id are a last document without an end (``ended`` false); an empty file has none; a file
    that ends within an id raises.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    name = F.regexp_extract("path", r"((?:size=\d+/file=\d+/)?[^/]+)$", 1)
    contents = files.select(name.alias("file"), "content")
    scanned = contents.mapInArrow(lambda b: _scan(b, end_id, block_tokens), "file string, block long, tokens long, ends long, head long, tail long, inner array<long>")
    # Prefix scan: the block's first document, and what ran on into it since the last end id.
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    anew = F.sum((F.col("ends") > 0).cast("int")).over(before)
    placed = scanned.withColumns({"document": F.coalesce(F.sum("ends").over(before), F.lit(0)), "run": F.coalesce(anew, F.lit(0)), "last": F.lead("block").over(order).isNull()})
    # Blocks of one run follow the same end id: its tail and the whole blocks since.
    carried = F.sum(F.when(F.col("ends") > 0, 0).otherwise(F.col("tokens"))).over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    tails = F.max(F.when(F.col("ends") > 0, F.struct("block", "tail"))).over(before)
    stitched = placed.withColumn("carry", F.coalesce(carried, F.lit(0)) + F.coalesce(tails["tail"], F.lit(0)))
    first = F.when(F.col("ends") > 0, F.array(F.struct(F.col("document").alias("document"), (F.col("carry") + F.col("head")).alias("n_tokens"), F.lit(True).alias("ended"))))
    inner = F.transform("inner", lambda n, i: F.struct((F.col("document") + 1 + i).alias("document"), n.alias("n_tokens"), F.lit(True).alias("ended")))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tokens"))
    open_end = F.when(F.col("last") & (left > 0), F.array(F.struct((F.col("document") + F.col("ends")).alias("document"), left.alias("n_tokens"), F.lit(False).alias("ended"))))
    kind = "array<struct<document: bigint, n_tokens: bigint, ended: boolean>>"
    empty = F.array().cast(kind)
    rows = F.concat(F.coalesce(first, empty), F.coalesce(inner.cast(kind), empty), F.coalesce(open_end, empty))
    return stitched.select("file", F.explode(rows).alias("d")).select("file", "d.document", "d.n_tokens", "d.ended")


def op6_token_counts(spark, sf_dir):
    """size, part, file, document, n_tokens of every document in token files written of all documents."""
    out = scratch_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    counted = count_tokens(spark, out)
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    return counted.select(number(r"size=(\d+)").alias("size"), number(r"part-(\d+)").alias("part"), number(r"file=(\d+)").alias("file"), "document", "n_tokens")
