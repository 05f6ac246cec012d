"""The best rows of each group by bounded lists that merge, as a heap of the k largest does: no sort of the table, and no group that one task takes whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

#: Lists of one group that are merged at once in the second round are those of about every ``WAYS``-th task.
WAYS = 64


def _order_class(column: pa.ChunkedArray, up: bool) -> pa.ChunkedArray:
    """Where nulls and what is no number stand in Spark's order: below and above all values."""
    low, high = (0, 2) if up else (2, 0)
    odd = pc.fill_null(pc.is_nan(column), False) if pa.types.is_floating(column.type) else pa.scalar(False)
    return pc.if_else(pc.is_null(column), low, pc.if_else(odd, high, 1))


def best(df: DataFrame, by: str, keys: list[tuple[str | Column, bool]], k: int, rank: str = "rank", ways: int = WAYS) -> DataFrame:
    """The ``k`` first rows of each group of ``by`` in order of ``keys``, pairs of a column or its name and whether it ascends, with their ``rank`` from 1.

    What ``row_number`` over a window gives up to ``k``: nulls are below all values and NaN above; rows alike in all keys come in any order. Rows of a
    null group are left out. Each task keeps its ``k`` best of each group as it reads, and drops at once what is worse than the last of them; lists are then merged
    by ``ways`` tasks a group, and those of them by one, which sees ``ways`` times ``k`` rows of a group. Groups are few: a task holds ``k`` rows of each.
    """
    names, ups = df.columns, [up for _, up in keys]
    fields = [c if isinstance(c, str) else f"__key_{i}" for i, (c, _) in enumerate(keys)]
    classes = [f"__class_{i}" for i in range(len(keys))]
    marked = df.where(F.col(by).isNotNull()).select("*", *[c.alias(n) for (c, _), n in zip(keys, fields) if not isinstance(c, str)])
    order = [(by, "ascending")] + [x for a, b, up in zip(classes, fields, ups) for x in ((a, "ascending"), (b, "ascending" if up else "descending"))]
    worse = pc.greater if ups[0] else pc.less

    def merge(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        classed = rows
        for name, field, up in zip(classes, fields, ups):
            classed = classed.append_column(name, _order_class(rows[field], up))
        rows = rows.take(pc.sort_indices(classed, sort_keys=order))
        group = rows[by].combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        kept = place < k
        return rows.filter(pa.array(kept)), place[kept] + 1

    def hopeful(rows: pa.Table, held: pa.Table, place: np.ndarray) -> pa.Table:
        """Without rows that are worse in the first key than the last of ``k`` that their group has already."""
        last = held.filter(pa.array(place == k))
        at = pc.index_in(rows[by], last[by].combine_chunks()).combine_chunks()
        mine, bar = rows[fields[0]].combine_chunks(), last[fields[0]].combine_chunks()
        here, there = _order_class(mine, ups[0]), _order_class(bar, ups[0]).take(at)
        out = pc.or_kleene(pc.greater(here, there), pc.and_kleene(pc.equal(here, there), worse(mine, bar.take(at))))
        return rows.filter(pc.invert(pc.fill_null(out, False)))

    def kept(final: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, place = None, None
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                if held is not None:
                    rows = hopeful(rows, held, place)
                if len(rows):
                    held, place = merge(rows if held is None else pa.concat_tables([held, rows]))
            if held is not None:
                yield from (held.select(names).append_column(rank, pa.array(place, pa.int32())) if final else held).combine_chunks().to_batches()

        return run

    schema = marked.schema
    mine = marked.mapInArrow(kept(False), schema).withColumn("__way", F.spark_partition_id() % ways)
    some = mine.repartition(by, "__way").drop("__way").mapInArrow(kept(False), schema)
    return some.repartition(by).mapInArrow(kept(True), st.StructType([*df.schema.fields, st.StructField(rank, st.IntegerType())]))
