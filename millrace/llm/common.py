"""Helpers shared by the training-data operators: shared scratch space and Arrow access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.sources.scratch import discard, materialise, scratch_path, small_batches

__all__ = ["byte_spans", "discard", "held_out_fold", "letters_mix", "materialise", "scratch_path", "small_batches", "utf8"]


def utf8(col):
    """Whole text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def byte_spans(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string or binary column without copying, and its offsets (one more than rows)."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    return memoryview(data if data is not None else b""), at.astype(np.int64)


def letters_mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def held_out_fold(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
