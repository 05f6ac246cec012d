"""Blobs by name from a store, as a Spark data source: partitioned, retried, and with names pushed down."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "blob_id string, content binary, error string"


class Names(InputPartition):
    """Blobs that one task reads, one after another."""

    def __init__(self, names: list[str]) -> None:
        self.names = names


def fetch(url: str, attempts: int, wait_s: float, timeout_s: float, most_bytes: int | None) -> tuple[bytes | None, str | None]:
    """``(content, error)`` of a URL. What is not there is not asked for again; other failures are, after waits that double."""
    error = None
    for k in range(attempts):
        if k:
            time.sleep(wait_s * 2 ** (k - 1))
        try:
            with urllib.request.urlopen(url, timeout=timeout_s) as got:
                content = got.read() if most_bytes is None else got.read(most_bytes + 1)
            return (content, None) if most_bytes is None or len(content) <= most_bytes else (None, "too large")
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code in (400, 401, 403, 404, 410):
                break
        except (OSError, ValueError) as e:
            error = type(e).__name__
            if isinstance(getattr(e, "reason", e), FileNotFoundError):
                break
    return None, error


class BlobReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"].rstrip("/")
        self.index = options.get("index")
        self.requests = int(options.get("requests", 16))
        self.limits = int(options.get("attempts", 4)), float(options.get("wait", 0.5)), float(options.get("timeout", 30)), int(options.get("max_kb", 4096)) * 1024
        self.only: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Names that are asked for by ``=`` or ``in`` are read alone; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("blob_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One for each request that may run at once: no more tasks than that ever ask the store."""
        names = self.only
        if self.index:
            content, error = fetch(self.index, *self.limits[:3], None)
            if content is None:
                raise OSError(f"{self.index}: {error}")
            listed = dict.fromkeys(content.decode().split("\n"))
            names = [n for n in listed if n and (names is None or n in names)]
        if names is None:
            raise ValueError("name blobs by a filter on blob_id, or give an index")
        names = sorted(n for n in names if n is not None)
        return [Names(names[k :: self.requests]) for k in range(min(self.requests, len(names)))] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        for name in partition.names:
            yield name, *fetch(f"{self.root}/{urllib.parse.quote(name)}", *self.limits)


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BlobReader(self.options)


def read_blobs(spark: SparkSession, root: str, index: str | None = None, requests: int = 16, attempts: int = 4, wait: float = 0.5, timeout: float = 30, max_kb: int = 4096) -> DataFrame:
    """``blob_id, content, error`` of the blobs of a store at ``root``, a URL: those of ``index`` (a text of a name a line), or those that a filter names.

    At most ``requests`` blobs are asked for at once; a read is tried ``attempts`` times, waiting ``wait`` seconds and twice as long each time. What
    cannot be read has an error and no content. ``readers.gunzip_blobs`` and ``valid_blobs`` take it from there. A filter by names is pushed down.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlobSource)
    options = {"root": root, "requests": requests, "attempts": attempts, "wait": wait, "timeout": timeout, "max_kb": max_kb} | ({"index": index} if index else {})
    return spark.read.format("blobs").options(**{k: str(v) for k, v in options.items()}).load()
