"""Late session merging: every version of every session as batches of late events arrive.

The time axis of each user is cut into shards. A shard turns its events into a history: which islands (runs of events at
most ``gap`` seconds apart) it has after which batch. An island that no event outside the shard can ever reach is a
version and done. The others, at most one at either border at a time, are the shard's boundary history. Stitching joins,
batch by batch, the boundary islands of ``FAN`` neighbouring shards and gives the versions that closes and the boundary
history of the joined shard, in the same form; so it is associative, and each round leaves a ``FAN``-th of the shards, until
nothing is open. A history is cut by batches too, each cut being told the state that it begins with, so neither a user's events
nor their batches meet in one task.

A version's place among those that it retracts is known where it is made; the start of one that is still open is not. Each
retraction therefore names the boundary island, and each round tells the start that the island got; joins put them together.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

GAP = 240
#: Seconds of a shard; at least the gap, so that islands of shards that are not neighbours never join.
SHARD_SECONDS = 3600
#: Neighbours that one round stitches.
FAN = 16
#: Batches of a history that one task takes at once.
CHUNK_BATCHES = 4096
LEFT, RIGHT, BOTH = 1, 2, 3
#: What a row is: a version, the state of a boundary island, a retraction, the start that a boundary island got.
VERSION, PIECE, RETRACTED, MOVED = range(4)
_FIELDS = ["kind", "user", "block", "batch", "side", "start_s", "end_s", "n", "h", "n_new", "n_retracted", "by_batch", "by_start"]
_SCHEMA = ", ".join(f"{c} {'int' if c in ('kind', 'side') else 'long'}" for c in _FIELDS)
_ARROW = pa.schema([(c, pa.int32() if c in ("kind", "side") else pa.int64()) for c in _FIELDS])


class Block:
    """Writes the rows of one block of the axis: a version where an island is closed, a piece where it may still grow outwards."""

    def __init__(self, user: int, block: int, width: int, origin: int, gap: int, last: bool, write) -> None:
        self.user, self.block, self.gap, self.write = user, block, gap, write
        # The last block of all is the whole axis.
        self.low, self.high = (-math.inf, math.inf) if last else (origin + block * width, origin + (block + 1) * width)

    def side(self, start: int, end: int) -> int:
        return LEFT * (start - self.low < self.gap) | RIGHT * (self.high - end <= self.gap)

    def session(self, batch: int, start: int, end: int, n: int, h: int, new: int, before: list[tuple[int, int, int]], standing: int) -> None:
        """A session with events of ``batch``; ``before``: (batch, start, end) of those islands of this block that stood before and are in it."""
        side = self.side(start, end)
        self.write(PIECE if side else VERSION, self.user, self.block, batch, side, start, end, n, h, new, standing, None, None)
        for old_batch, old_start, old_end in before:
            if not self.side(old_start, old_end):
                self.write(RETRACTED, self.user, self.block, old_batch, 0, old_start, None, None, None, None, None, batch, start)

    def moved(self, batch: int, piece: int, start: int) -> None:
        if piece != start:
            self.write(MOVED, self.user, self.block, batch, 0, piece, None, None, None, None, None, None, start)


def shard_history(events: list[tuple], block: Block) -> None:
    """Rows of one shard from its ``(batch, second, n, h)`` in order of batch."""
    starts: list[int] = []
    islands: dict[int, list[int]] = {}  # by start: end, n, h, last batch
    for batch, rows in itertools.groupby(events, key=lambda r: r[0]):
        fresh: dict[int, tuple[int, list]] = {}  # by start: events of this batch, islands that stood before
        for _, second, n, h in rows:
            start, end, total, hashes, new, before = second, second, n, h, n, []
            k = bisect_left(starts, second + block.gap + 1) - 1
            while k >= 0 and islands[starts[k]][0] + block.gap >= second:
                old = starts.pop(k)
                old_end, old_n, old_h, old_batch = islands.pop(old)
                start, end, total, hashes = min(start, old), max(end, old_end), total + old_n, hashes + old_h
                if old in fresh:
                    more, kept = fresh.pop(old)
                    new += more
                    before += kept
                else:
                    before.append((old_batch, old, old_end))
                k -= 1
            insort(starts, start)
            islands[start] = [end, total, hashes, batch]
            fresh[start] = (new, before)
        for start, (new, before) in sorted(fresh.items()):
            end, total, hashes, _ = islands[start]
            block.session(batch, start, end, total, hashes, new, before, len(before))


class Stitch:
    """Boundary islands of neighbouring blocks, stitched batch by batch."""

    def __init__(self, block: Block) -> None:
        self.block = block
        # By child: the islands (start, end, n, h, batch) open to the left and to the right; one island may be both.
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}

    def put(self, child: int, side: int, piece: tuple) -> None:
        if side & LEFT:
            self.left[child] = piece
        if side & RIGHT:
            self.right[child] = piece

    def joined(self, child: int) -> bool:
        """Whether the seam after ``child`` is closed now."""
        a, b = self.right.get(child), self.left.get(child + 1)
        return a is not None and b is not None and b[0] - a[1] <= self.block.gap

    def group(self, child: int, side: int) -> list[tuple[int, tuple]]:
        """``(child, island)`` of the session that holds this island, in order of time."""
        first = (child, side)
        while first[1] & LEFT and self.joined(first[0] - 1):
            left = first[0] - 1
            first = (left, BOTH if self.left.get(left) is self.right[left] else RIGHT)
        out = []
        child, side = first
        while True:
            out.append((child, (self.left if side & LEFT else self.right)[child]))
            if not side & RIGHT or not self.joined(child):
                return out
            child += 1
            side = BOTH if self.right.get(child) is self.left[child] else LEFT

    def batch(self, batch: int, rows: list[tuple]) -> None:
        """Rows ``(child, side, start, end, n, h, new, standing)`` of one batch."""
        # What stood before, seen from every island that changes or is next to one that does.
        near = {c + d for c, *_ in rows for d in (-1, 0, 1)}
        # Seams next to no change stay as they are.
        open_ = {c for c in {x + d for x in near for d in (-1, 0)} if not self.joined(c)}
        old: dict[tuple[int, int], tuple] = {}
        for c in near:
            for side, of in ((LEFT, self.left), (RIGHT, self.right)):
                if c in of:
                    both = self.left.get(c) is self.right.get(c)
                    parts = self.group(c, BOTH if both else side)
                    old[c, side] = (max(p[4] for _, p in parts), parts[0][1][0], parts[-1][1][1])
        fresh = {}
        for c, side, start, end, n, h, new, standing in rows:
            piece = (start, end, n, h, batch)
            self.put(c, side, piece)
            fresh[c, start] = (side, new, standing)
        done = set()
        for (c, start), (side, _, _) in fresh.items():
            if (c, start) in done:
                continue
            parts = self.group(c, side)
            new = standing = 0
            before = {}
            for k, (child, piece) in enumerate(parts):
                own = fresh.get((child, piece[0]))
                is_new = own is not None and piece[4] == batch
                if is_new:
                    done.add((child, piece[0]))
                    new, standing = new + own[1], standing + own[2]
                else:
                    standing += 1
                if k and parts[k - 1][0] not in open_:
                    standing -= 1
                for s in (LEFT, RIGHT):
                    was = old.get((child, s))
                    if was and piece[0] <= was[2] and was[1] <= piece[1]:
                        before[was] = None
            first, last = parts[0][1][0], parts[-1][1][1]
            self.block.session(batch, first, last, sum(p[2] for _, p in parts), sum(p[3] for _, p in parts), new, list(before), standing)
            for child, piece in parts:
                if piece[4] == batch:
                    self.block.moved(batch, piece[0], first)


def _tables(rows_of) -> Iterator[pa.RecordBatch]:
    """Record batches of what ``rows_of(write)``, a generator that pauses now and then, writes."""
    out: list[tuple] = []

    def table():
        columns = list(zip(*out)) or [()] * len(_FIELDS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    for _ in rows_of(lambda *row: out.append(row)):
        if len(out) >= 8192:
            yield table()
    if out:
        yield table()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _shards(shard_seconds: int, origin: int, gap: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(write):
            for (user, shard), rows in itertools.groupby(_rows(batches), key=lambda r: r[:2]):
                shard_history([r[2:] for r in rows], Block(user, shard, shard_seconds, origin, gap, last, write))
                yield

        return _tables(rows_of)

    return run


def _stitch(width: int, origin: int, gap: int, last: bool):
    """Rows ``(user, block, chunk, batch, child, side, start, end, n, h, new, standing, told)`` in order; ``told`` rows are states to begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(write):
            for (user, parent, _), rows in itertools.groupby(_rows(batches), key=lambda r: r[:3]):
                stitch = Stitch(Block(user, parent, width, origin, gap, last, write))
                for batch, own in itertools.groupby(rows, key=lambda r: r[3]):
                    own = list(own)
                    if own[0][12]:
                        for _, _, _, _, child, side, start, end, n, h, *_ in own:
                            stitch.put(child, side, (start, end, n, h, batch))
                    else:
                        stitch.batch(batch, [r[4:12] for r in own])
                yield

        return _tables(rows_of)

    return run


def _told(pieces: DataFrame) -> DataFrame:
    """For each chunk of a parent's history but its first, the last state before it of each child, as rows of that chunk."""
    state = F.struct("batch", "side", "start_s", "end_s", "n", "h", "n_new", "n_retracted")
    ends = pieces.groupBy("user", "parent", "block", "chunk").agg(F.max(F.when(F.col("side").bitwiseAND(LEFT) > 0, state)).alias("l"), F.max(F.when(F.col("side").bitwiseAND(RIGHT) > 0, state)).alias("r"))
    chunks = pieces.select("user", "parent", "chunk").distinct()
    children = pieces.select("user", "parent", "block").distinct()
    grid = chunks.join(children, ["user", "parent"]).join(ends, ["user", "parent", "block", "chunk"], "left")
    before = Window.partitionBy("user", "parent", "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = grid.select("user", "parent", "block", "chunk", F.last("l", True).over(before).alias("l"), F.last("r", True).over(before).alias("r"))
    # An island open on both sides stands in both; a right one that ends before it has been swallowed by it.
    spans = F.col("l.side") == BOTH
    sides = F.array(F.col("l"), F.when(spans, None).otherwise(F.col("r")))
    return known.select("user", "parent", "block", "chunk", F.explode(sides).alias("s")).where("s is not null").select("user", "parent", "block", "chunk", "s.*")


def _round(pieces: DataFrame, width: int, origin: int, gap: int, last: bool, fan: int, chunk_batches: int) -> DataFrame:
    pieces = pieces.select(*_FIELDS[1:11]).withColumns({"parent": F.floor(F.col("block") / fan), "chunk": F.floor(F.col("batch") / chunk_batches), "told": F.lit(False)})
    if pieces.agg(F.min("chunk") == F.max("chunk")).first()[0] is False:
        pieces = pieces.unionByName(_told(pieces).withColumn("told", F.lit(True)))
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["user", "parent", "chunk"]
    # A state to begin with comes first; else rows are in order of batch.
    ordered = pieces.repartition(parts, *keys).sortWithinPartitions(*keys, F.desc("told"), "batch", "block", "side")
    columns = [*keys, "batch", "block", "side", "start_s", "end_s", "n", "h", "n_new", "n_retracted", "told"]
    return ordered.select(*columns).mapInArrow(_stitch(width, origin, gap, last), _SCHEMA)


def session_versions(events: DataFrame, gap: int = GAP, shard_seconds: int = SHARD_SECONDS, fan: int = FAN, chunk_batches: int = CHUNK_BATCHES) -> DataFrame:
    """Every version of every session of ``events``: ``user, second, batch, h``, all long, a row per event.

    After each batch, ascending, a user's events so far form sessions: neighbours in time at most ``gap`` seconds apart share one.
    A session with an event of that batch is a version and retracts the sessions of earlier batches that it contains.
    Columns: user, batch, start_s, end_s (first and last event), n_events, n_new (of that batch), n_retracted, h_sum, and
    retracted_batch, retracted_start_s of the version that retracts it (null if none does).

    Events of one user, second and batch are summed up first, so repeated rows and hot users count, but do not meet in one
    task one by one. Rows with a null in user, second or batch are left out; a null ``h`` counts as 0; an empty table
    gives an empty result; other columns are ignored. Seconds and batches may be negative. Only the first and the last second reach the driver.
    """
    if shard_seconds < gap:
        raise ValueError("a shard has to be as long as the gap at least")
    spark = events.sparkSession
    known = events.where("user is not null and second is not null and batch is not null")
    summed = known.groupBy(*(F.col(c).cast("long") for c in ("user", "second", "batch"))).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("h"))
    summed = materialise(summed.toDF("user", "second", "batch", "n", "h"), "seconds")
    origin, end = summed.agg(F.min("second"), F.max("second")).first()
    origin, end = origin or 0, end or 0
    levels = 0
    while (end - origin) // shard_seconds >= fan**levels:
        levels += 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sharded = summed.select("user", F.floor((F.col("second") - origin) / shard_seconds).alias("shard"), "batch", "second", "n", "h")
    ordered = sharded.repartition(parts, "user", "shard").sortWithinPartitions("user", "shard", "batch", "second")
    made = [materialise(ordered.mapInArrow(_shards(shard_seconds, origin, gap, levels == 0), _SCHEMA), "sessions_0")]
    for level in range(1, levels + 1):
        pieces = made[-1].where(F.col("kind") == PIECE)
        made.append(materialise(_round(pieces, shard_seconds * fan**level, origin, gap, level == levels, fan, chunk_batches), f"sessions_{level}"))

    # The start that each boundary island got in the end, from the last round down.
    keys = ["user", "batch", "piece"]
    final = None
    for rows in made[:0:-1]:
        own = rows.where(F.col("kind") == MOVED).select("user", "batch", F.col("start_s").alias("piece"), F.col("by_start").alias("start"))
        if final is not None:
            on = final.select("user", "batch", F.col("piece").alias("start"), F.col("start").alias("further"))
            own = own.join(on, ["user", "batch", "start"], "left").select(*keys, F.coalesce("further", "start").alias("start"))
            own = materialise(own.unionByName(final), "moved")
        final = own
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    retracted = rows.where(F.col("kind") == RETRACTED).select("user", "batch", "start_s", F.col("by_batch").alias("retracted_batch"), F.col("by_start").alias("piece"))
    if final is not None:
        moved = final.select("user", F.col("batch").alias("retracted_batch"), "piece", "start")
        retracted = retracted.join(moved, ["user", "retracted_batch", "piece"], "left")
    else:
        retracted = retracted.withColumn("start", F.lit(None).cast("long"))
    retracted = retracted.select("user", "batch", "start_s", "retracted_batch", F.coalesce("start", "piece").alias("retracted_start_s"))
    versions = rows.where(F.col("kind") == VERSION).join(retracted, ["user", "batch", "start_s"], "left")
    return versions.select("user", "batch", "start_s", "end_s", F.col("n").alias("n_events"), "n_new", "n_retracted", F.col("h").alias("h_sum"), "retracted_batch", "retracted_start_s")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """``user, second, batch, h`` of each turn; rows without a turn or conversation are no events."""
    named = conversations.where("turn is not null and conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"))
    c = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    h = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    own = named.select("conv_id", "turn", c.alias("c"), h.alias("h"))
    g = F.floor(F.col("h") / 600)
    second = F.floor(F.col("c") / 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600
    late = F.when(g % 3 == 0, g % 4).otherwise(0)
    return own.select((2 * F.shiftright("conv_id", 3) + F.col("c") % 2).alias("user"), second.alias("second"), (F.floor(second / 1800) + late).alias("batch"), "h")


def op11_late_sessions(spark, sf_dir):
    """Every session version over all turns of ``conversations``."""
    return session_versions(conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: DuckDB has no crc32: a step of eight bits for each byte.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
OP11_SQL = f"""
with turns as (
  select conv_id, turn, {_CRC.format("conv_id::varchar")} as c, {_CRC.format("conv_id::varchar || ':' || turn::varchar")} as h
  from conversations where turn is not null and conv_id is not null
), timed as (
  select 2 * floor(conv_id / 8)::bigint + c % 2 as u, (c // 2) % 7200 + 300 * turn + h % 600 as s, h, h // 600 as g from turns
), events as (
  select u, s, h, floor(s / 1800)::bigint + case when g % 3 = 0 then g % 4 else 0 end as b from timed
), so_far as (
  select t.u, t.b as now, e.s, e.h, e.b from (select distinct u, b from events) t join events e on e.u = t.u and e.b <= t.b
), cut as (
  select *, case when s - lag(s) over (partition by u, now order by s) <= 240 then 0 else 1 end as opens from so_far
), numbered as (
  select *, sum(opens) over (partition by u, now order by s rows unbounded preceding) as k from cut
), standing as (
  select u, now, min(s) as first_s, max(s) as last_s, count(*) as n, count(*) filter (b = now) as n_new, max(b) as made, sum(h) as h_sum from numbered group by u, now, k
), versions as (
  select * from standing where n_new > 0
), followed as (
  select v.u, v.now, v.first_s, min(w.now) as next_b, arg_min(w.first_s, w.now) as next_s
  from versions v join versions w on w.u = v.u and w.now > v.now and v.first_s between w.first_s and w.last_s group by all
), counted as (
  select u, next_b, next_s, count(*) as n_retracted from followed group by all
)
select v.u as user, v.now as batch, v.first_s as start_s, v.last_s as end_s, v.n::bigint as n_events, v.n_new::bigint as n_new, coalesce(c.n_retracted, 0)::bigint as n_retracted, v.h_sum::bigint as h_sum,
  f.next_b as retracted_batch, f.next_s as retracted_start_s
from versions v left join followed f using (u, now, first_s) left join counted c on c.u = v.u and c.next_b = v.now and c.next_s = v.first_s
"""
