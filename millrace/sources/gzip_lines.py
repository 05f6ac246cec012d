"""Lines of gzip files, as a Spark data source that reads one file by several tasks where it has several members.

A gzip file is a row of members, each a stream of its own (what ``cat a.gz b.gz`` or a log that is appended to
gives). A task takes the members that start in its range of bytes and finds the first of them by its header. Lines
may run over members: as in plain text, a task leaves out what comes before its first line feed and reads one line
further than its members.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at once, and that are unpacked at once.
READ = 1 << 20

# A member's first two bytes, its method, and flags of which three are reserved.
_HEADER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


class Range(InputPartition):
    """Bytes ``start`` to before ``end`` of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def members(file, place: int) -> Iterator[tuple[int, bytes]]:
    """``(start, text)`` for pieces of the members from ``place`` on, where one starts; an empty piece begins each member."""
    file.seek(place)
    held = b""
    while True:
        # Zeros may lie between members and after the last.
        bare = held.lstrip(b"\0")
        place += len(held) - len(bare)
        held = bare or file.read(READ)
        if not held:
            return
        if not bare:
            continue
        one, start = zlib.decompressobj(31), place
        yield start, b""
        while not one.eof:
            held = held or file.read(READ)
            if not held:
                raise EOFError(f"the gzip member at byte {start} ends early")
            text = one.decompress(held, READ)
            left = one.unused_data if one.eof else one.unconsumed_tail
            place, held = place + len(held) - len(left), left
            if text:
                yield start, text


def first_member(file, start: int, end: int) -> int | None:
    """The first place of the range where a member starts: what looks like a header and leads to a whole member, its checksum included."""
    for low in range(start, end, READ):
        file.seek(low)
        for found in _HEADER.finditer(file.read(READ + 3)):
            place = low + found.start()
            if place < min(low + READ, end) and _is_whole(file, place):
                return place
    return None


def _is_whole(file, place: int) -> bool:
    try:
        for at, _ in members(file, place):
            if at != place:
                break
        return True
    except (zlib.error, EOFError):
        return False


def own_lines(pieces: Iterator[tuple[int, bytes]], end: int, skip: bool) -> Iterator[bytes]:
    """Blocks of whole lines from members that start before ``end``, and the line that begins there or is not done by then; without what comes before the first line feed if ``skip``.

    The first member from ``end`` on is unpacked whole. Its own task would take a broken one for no member, so the error has to come from here.
    """
    held: list[bytes] = []
    next_member, done = None, False
    for start, text in pieces:
        beyond = start >= end
        if beyond and next_member is None:
            next_member = start
        if done:
            if start != next_member:
                break
            continue
        if skip:
            _, feed, text = text.partition(b"\n")
            skip = not feed
            done = beyond and not skip
            if skip or done:
                continue
        if beyond:
            head, feed, _ = text.partition(b"\n")
            held.append(head)
            if feed:
                yield b"".join(held)
                done = True
        else:
            head, feed, rest = text.rpartition(b"\n")
            if feed:
                yield b"".join([*held, head])
                held = []
            held.append(rest)
    if not skip and not done:
        yield b"".join(held)


class GzipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"])
        self.part_bytes = int(options["part_bytes"])

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            for name, size in _files(path):
                out += [Range(name, at, min(at + self.part_bytes, size)) for at in range(0, size, self.part_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as file:
            first = 0 if partition.start == 0 else first_member(file, partition.start, partition.end)
            if first is None:
                return
            for block in own_lines(members(file, first), partition.end, first > 0):
                lines = block.decode("utf-8", "replace").split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])


def _files(path: str) -> list[tuple[str, int]]:
    """``(URI or path, bytes)`` of a file, of a folder's files or of those that match a pattern of names; as elsewhere, names that begin with ``_`` or ``.`` are no data."""
    folder, _, last = path.rstrip("/").rpartition("/")
    pattern = last if re.search(r"[*?\[]", last) else None
    root = folder if pattern else path.rstrip("/")
    store, place = fs.FileSystem.from_uri(root)
    here = store.get_file_info(place)
    if here.type == fs.FileType.File:
        return [(root, here.size)]
    found = sorted(store.get_file_info(fs.FileSelector(place)), key=lambda f: f.base_name)
    named = [f for f in found if f.is_file and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern or "*")]
    if pattern and not named:
        raise FileNotFoundError(path)
    return [(f"{root}/{f.base_name}", f.size) for f in named]


class GzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> DataSourceReader:
        return GzipReader(self.options)


def read_gzip_lines(spark: SparkSession, path: str | list[str], part_bytes: int = 64 << 20) -> DataFrame:
    """``line`` of gzip files, folders of them or patterns of names (local paths or URIs), a task for every ``part_bytes`` of a file.

    Lines end at line feeds; what follows a file's last one is a line too, empty or not. Bytes that are not UTF-8 become U+FFFD. A
    member is unpacked by one task, so a file of a single member gains nothing. A broken file is an error.
    """
    spark.dataSource.register(GzipLines)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("gzip_lines").option("paths", json.dumps(paths)).option("part_bytes", str(part_bytes)).load()


def read_gzip_jsonl(spark: SparkSession, path: str | list[str], schema: str | st.StructType, strict: bool = False, part_bytes: int = 64 << 20) -> DataFrame:
    """What ``readers.read_jsonl`` gives for gzip files of one record a line, read by members: blank lines are skipped, malformed ones dropped, or, if ``strict``, an error."""
    kind = schema if isinstance(schema, st.StructType) else st.StructType.fromDDL(schema)
    lines = read_gzip_lines(spark, path, part_bytes).where(F.trim(F.translate("line", "\t\r", "  ")) != "")
    if strict:
        return lines.select(F.from_json("line", kind, {"mode": "FAILFAST"}).alias("__row")).select("__row.*")
    broken = "__broken"
    wide = st.StructType([*kind.fields, st.StructField(broken, st.StringType())])
    rows = lines.select(F.from_json("line", wide, {"columnNameOfCorruptRecord": broken}).alias("__row"))
    return rows.where(F.col("__row").isNotNull() & F.col(f"__row.{broken}").isNull()).select("__row.*").drop(broken)
