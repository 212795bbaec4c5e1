"""Sweeps over pairs of accesses, a slice of steps at a time.

All accesses and sync events of a slice are in one group, so what a pair is tested by is looked up in
sorted arrays there and no pair is shuffled. What lies beyond a slice is carried into it: of the
later reads those that come first at some byte, and of each lock and thread the first later event.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import end_of, ordered
from ..workers import reachable
from . import kernels

#: Steps in a group, a power of two, and what a worker expands at once.
SPAN = 1 << 16
CHUNK = 1 << 21
GRAIN = 16
NEVER = (1 << 63) - 1
WRITE, READ, SYNC, LATER = range(4)


def span() -> int:
    return min(SPAN, kernels.SLICE)


def _slice(width: int) -> Column:
    return F.shiftright(F.col("step").cast("long"), width.bit_length() - 1)


def _rows(accesses: DataFrame, tag: int | Column, width: int, *more: str) -> DataFrame:
    """Accesses as rows of a group. start and end are in order as signed numbers; one without a size reaches to the end of its grain."""
    start = ordered(F.col("address"))
    end = F.when(F.col("size").isNull(), end_of(start.bitwiseOR(F.lit(GRAIN - 1)), F.lit(1))).otherwise(end_of(start, F.col("size")))
    rows = accesses.where("step is not null and thread_id is not null and address is not null")
    return rows.select(_slice(width).alias("slice"), (F.lit(tag) if isinstance(tag, int) else tag).alias("tag"), "step", "ord", "thread_id", "address", "size", start.alias("start"), end.alias("end"), *more)


def _grain(address: Column) -> Column:
    return F.shiftright(address, GRAIN.bit_length() - 1)


def _grained(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grain", F.explode(F.sequence(_grain(F.col("start")), _grain(F.greatest("start", F.col("end") - 1)))))


def _before(keys: list[str]):
    """A window over the later slices of the same keys."""
    return Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)


def _later_reads(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads, given to each slice of writes before them, that are the first of their thread at a byte of a written grain, or between two bytes."""
    fields = [c for c in reads.columns if c != "slice"]
    parts = _grained(reads).withColumn("empty", F.col("start") >= F.col("end"))
    found = F.struct("step", "ord", "address", *(c for c in fields if c not in ("step", "ord", "address")))
    at = lambda k: F.shiftleft(F.col("grain"), GRAIN.bit_length() - 1) + k
    on = {f"b{k}": (F.col("start") <= at(k)) & ((F.col("end") > at(k)) | F.col("empty")) & (at(k) <= F.greatest("start", F.col("end") - 1)) for k in range(GRAIN)}
    on |= {f"g{k}": (F.col("start") < at(k)) & (F.col("end") > at(k)) for k in range(GRAIN)}
    firsts = parts.select("grain", "thread_id", "empty", "slice", F.lit(False).alias("asked"), *(F.when(c, found).alias(n) for n, c in on.items()))
    readers = parts.select("grain", "thread_id", "empty").distinct()
    places = _grained(writes).select("grain", "slice").distinct().join(readers, "grain")
    places = places.select("grain", "thread_id", "empty", "slice", F.lit(True).alias("asked"), *(F.lit(None).cast(firsts.schema[n].dataType).alias(n) for n in on))
    keys = ["grain", "thread_id", "empty"]
    each = firsts.unionByName(places).groupBy(*keys, "slice").agg(F.bool_or("asked").alias("asked"), *(F.min(n).alias(n) for n in on))
    carried = each.select("slice", "asked", *(F.min(n).over(_before(keys)).alias(n) for n in on)).where("asked")
    return carried.select("slice", F.explode(F.array_distinct(F.array(*on))).alias("r")).where("r is not null").select("slice", *(F.col(f"r.{c}").alias(c) for c in fields))


def _later_places(rows: DataFrame, width: int) -> DataFrame:
    """For each slice, grain in it and thread that touches the grain behind the slice: the first step of that (step), the first of a write (ord) and the last (size)."""
    parts = _grained(rows)
    wrote = F.when(F.col("tag") == WRITE, F.col("step"))
    sums = [F.min("first").alias("first"), F.min("first_write").alias("first_write"), F.max("last").alias("last")]
    found = parts.groupBy("grain", "thread_id", "slice").agg(F.min("step").alias("first"), F.min(wrote).alias("first_write"), F.max("step").alias("last")).withColumn("asked", F.lit(False))
    places = found.select("grain", "slice").distinct().join(found.select("grain", "thread_id").distinct(), "grain")
    places = places.select("grain", "thread_id", "slice", *(F.lit(None).cast("long").alias(c) for c in ("first", "first_write", "last")), F.lit(True).alias("asked"))
    each = found.select(*places.columns).unionByName(places).groupBy("grain", "thread_id", "slice").agg(*sums)
    over = _before(["grain", "thread_id"])
    carried = each.select("slice", "grain", "thread_id", F.min("first").over(over).alias("step"), F.min("first_write").over(over).alias("ord"), F.max("last").over(over).alias("size")).where("step is not null")
    blank = F.lit(None).cast("long")
    return carried.select("slice", F.lit(LATER).alias("tag"), "step", "ord", "thread_id", F.col("grain").alias("address"), "size", blank.alias("start"), blank.alias("end"))


def _sync_rows(sync: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Sync events as rows of a group, and each lock's and thread's first event behind each slice of rows."""
    events = sync.where("sync_object_addr is not null and thread_id is not null and step is not null").select(_slice(width).alias("slice"), F.col("sync_object_addr").alias("address"), "thread_id", F.col("step").cast("long").alias("step")).distinct()
    firsts = events.groupBy("address", "thread_id", "slice").agg(F.min("step").alias("step")).withColumn("asked", F.lit(False))
    asked = firsts.select("address", "thread_id").distinct().crossJoin(F.broadcast(rows.select("slice").distinct()))
    asked = asked.select("address", "thread_id", "slice", F.lit(None).cast("long").alias("step"), F.lit(True).alias("asked"))
    each = firsts.unionByName(asked).groupBy("address", "thread_id", "slice").agg(F.min("step").alias("step"), F.bool_or("asked").alias("asked"))
    carried = each.withColumn("step", F.min("step").over(_before(["address", "thread_id"]))).where("asked and step is not null").select(*events.columns)
    blank = F.lit(None).cast("long")
    return events.unionByName(carried).select("slice", F.lit(SYNC).alias("tag"), "step", blank.alias("ord"), "thread_id", "address", *(blank.alias(c) for c in ("size", "start", "end")))


def _ints(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    return (column.fill_null(0) if column.null_count else column).to_numpy().astype(np.int64, copy=False)


def _places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values are in known, sorted; -1 if they are not there."""
    if not known.size:
        return np.full(values.size, -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), known.size - 1)
    return np.where(known[at] == values, at, -1)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts as many numbers: whose it is, and which from 0 on."""
    whose = np.repeat(np.arange(counts.size), counts)
    return whose, np.arange(whose.size) - np.repeat(np.cumsum(counts) - counts, counts)


def _chunks(counts: np.ndarray) -> Iterator[slice]:
    """Cuts of rows that expand to some CHUNK at once."""
    cuts = np.flatnonzero(np.diff(np.cumsum(counts) // CHUNK, prepend=0))
    edges = [0, *cuts.tolist(), counts.size]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


class Bounds:
    """By which step two threads have both touched one lock, counted from a step of a slice."""

    def __init__(self, lock: np.ndarray, thread: np.ndarray, step: np.ndarray, base: int, width: int) -> None:
        self.threads, who = np.unique(thread, return_inverse=True)
        self.base, self.wide, n = base, width + 1, self.threads.size
        group = np.unique(lock, return_inverse=True)[1] * n + who
        off = np.clip(step - base, 0, width)
        order = np.argsort(group * self.wide + off, kind="stable")
        group, off, step, who = group[order], off[order], step[order], who[order]
        keys = group * self.wide + off
        pairs, ends = [], []
        for other in range(n):  # from each event the other thread's next on the lock
            theirs = group - who + other
            at = np.searchsorted(keys, theirs * self.wide + off)
            near = np.minimum(at, keys.size - 1)
            ok = (at < keys.size) & (group[near] == theirs) & (who != other)
            pairs.append((np.minimum(who, other) * n + np.maximum(who, other))[ok] * self.wide + off[ok])
            ends.append(np.maximum(step[near], step)[ok])
        keys = np.concatenate(pairs) if pairs else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ends = keys[order], (np.concatenate(ends) if ends else keys)[order]
        cuts = [0, *(np.flatnonzero(np.diff(self.keys // self.wide)) + 1).tolist(), self.keys.size]
        for a, b in zip(cuts, cuts[1:]):
            self.ends[a:b] = np.minimum.accumulate(self.ends[a:b][::-1])[::-1]

    def after(self, one: np.ndarray, other: np.ndarray, step: np.ndarray) -> np.ndarray:
        a, b = _places(self.threads, one), _places(self.threads, other)
        pair = np.minimum(a, b) * self.threads.size + np.maximum(a, b)
        if not self.keys.size:
            return np.full(step.size, NEVER)
        at = np.searchsorted(self.keys, pair * self.wide + (step - self.base))
        near = np.minimum(at, self.keys.size - 1)
        ok = (a >= 0) & (b >= 0) & (at < self.keys.size) & (self.keys[near] // self.wide == pair)
        return np.where(ok, self.ends[near], NEVER)


class _Group:
    def __init__(self, batches: Iterator[pa.RecordBatch], width: int) -> None:
        self.table = pa.Table.from_batches(batches).combine_chunks()
        for name in ("tag", "step", "ord", "thread_id", "address", "size", "start", "end"):
            setattr(self, name, _ints(self.table, name))
        self.base = self.table.column("slice")[0].as_py() * width
        sync = self.tag == SYNC
        self.bounds = Bounds(self.address[sync], self.thread_id[sync], self.step[sync], self.base, width)

    def batches(self, columns: dict) -> Iterator[pa.RecordBatch]:
        """Columns as they are, or of the rows at given places."""
        made = {n: pa.array(c) if isinstance(c, np.ndarray) else self.table.column(c[0]).take(pa.array(c[1])) for n, c in columns.items()}
        yield from pa.table(made).to_batches(max_chunksize=1 << 16)


def _first_reads(g: _Group) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of writes and reads: for each write and each other thread the first later read that overlaps it.

    Bytes between neighbouring ends of accesses are one place. Where an access is empty, places are
    three for each: what spans it, empty reads there, the bytes from it on.
    """
    writes, reads = np.flatnonzero(g.tag == WRITE), np.flatnonzero(g.tag == READ)
    if not writes.size or not reads.size:
        return
    writes = writes[np.argsort(g.start[writes], kind="stable")]
    reads = reads[np.lexsort((g.size[reads], g.address[reads], g.ord[reads], g.step[reads]))]
    points = np.unique(np.concatenate([x[i] for x in (g.start, g.end) for i in (writes, reads)]))
    empty = g.start >= g.end
    unit = 3 if empty[writes].any() or empty[reads].any() else 1

    def cover(rows: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, none = np.searchsorted(points, g.start[rows]), np.searchsorted(points, g.end[rows]), empty[rows]
        return np.where(none, unit * low + place, unit * low + unit - 1), np.where(none, 1, unit * (high - low - 1) + 1)

    threads, who = np.unique(g.thread_id[reads], return_inverse=True)
    n, most = threads.size, reads.size + 1
    low, count = cover(reads, 1)
    whose, nth = _spread(count)
    keys = np.sort(((low[whose] + nth) * n + who[whose]) * most + whose)
    del whose, nth
    low, count = cover(writes, 0)
    since = np.searchsorted(g.step[reads], g.step[writes], side="right")
    for cut in _chunks(count):
        whose, nth = _spread(count[cut])
        begins = np.cumsum(count[cut]) - count[cut]
        place = (low[cut][whose] + nth) * n
        for t in range(n):
            first = (place + t) * most
            at = np.minimum(np.searchsorted(keys, first + since[cut][whose]), keys.size - 1)
            rank = keys[at] - first
            rank = np.where((rank >= since[cut][whose]) & (rank < most), rank, most)
            best = np.minimum.reduceat(rank, begins)
            hit = np.flatnonzero((best < most) & (g.thread_id[writes[cut]] != threads[t]))
            yield writes[cut][hit], reads[best[hit]]


def first_reads(writes: DataFrame, reads: DataFrame, sync: DataFrame) -> DataFrame:
    """(from_thread, to_thread, address, write_step, write_size, read_step, read_address, read_size, is_synchronized).

    For each write, and each other thread, the thread's first later read that overlaps it, and
    whether both threads touched one lock between the two.
    """
    reachable(writes.sparkSession)
    width = span()
    written, read = _rows(writes, WRITE, width), _rows(reads, READ, width)
    rows = written.unionByName(read).unionByName(_later_reads(written, read)).unionByName(_sync_rows(sync, written, width))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, width)
        for w, r in _first_reads(g):
            synced = g.bounds.after(g.thread_id[w], g.thread_id[r], g.step[w]) <= g.step[r]
            yield from g.batches({
                "from_thread": ("thread_id", w), "to_thread": ("thread_id", r), "address": ("address", w), "write_step": ("step", w), "write_size": ("size", w),
                "read_step": ("step", r), "read_address": ("address", r), "read_size": ("size", r), "is_synchronized": synced,
            })

    kind = {f.name: f.dataType.simpleString() for f in written.schema}
    thread, step, address, size = (kind[c] for c in ("thread_id", "step", "address", "size"))
    schema = f"from_thread {thread}, to_thread {thread}, address {address}, write_step {step}, write_size {size}, read_step {step}, read_address {address}, read_size {size}, is_synchronized boolean"
    return rows.groupBy("slice").applyInArrow(found, schema)


_SHIFT = GRAIN.bit_length() - 1


def _conflicts(g: _Group) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of first and second accesses of a slice by different threads that overlap, one a write, the second before any synchronisation from the first on."""
    rows = np.flatnonzero(g.tag <= READ)
    if not rows.size:
        return
    low, high = g.start[rows] >> _SHIFT, np.maximum(g.start[rows], g.end[rows] - 1) >> _SHIFT
    whose, nth = _spread(high - low + 1)
    grain, at = low[whose] + nth, rows[whose]
    place = np.unique(grain, return_inverse=True)[1]
    threads, who = np.unique(g.thread_id[at], return_inverse=True)
    n, wide, write = threads.size, g.bounds.wide, g.tag == WRITE
    keys = (place * n + who) * wide + g.step[at] - g.base
    order = np.argsort(keys, kind="stable")
    # Seconds of any kind for first writes, and writes for first reads.
    for firsts, seconds in ((np.flatnonzero(write[at]), order), (np.flatnonzero(~write[at]), order[write[at[order]]])):
        known, one = keys[seconds], at[firsts]
        for t in range(n):
            bound = (np.minimum(g.bounds.after(g.thread_id[rows], np.full(rows.size, threads[t]), g.step[rows]), g.base + wide - 1) - g.base)[whose[firsts]]
            group = (place[firsts] * n + t) * wide
            since = np.searchsorted(known, group + g.step[one] - g.base)
            count = np.where(who[firsts] == t, 0, np.maximum(np.searchsorted(known, group + bound) - since, 0))
            some = np.flatnonzero(count)
            for cut in _chunks(count[some]):
                chosen = some[cut]
                mine, nth = _spread(count[chosen])
                mine = chosen[mine]
                nth += since[mine]
                f, s = one[mine], at[seconds[nth]]
                once = grain[firsts[mine]] == np.maximum(g.start[f], g.start[s]) >> _SHIFT
                at_once = write[f] & (~write[s] | (g.thread_id[f] < g.thread_id[s]))
                ok = once & (g.start[f] < g.end[s]) & (g.start[s] < g.end[f]) & ((g.step[s] > g.step[f]) | at_once)
                yield f[ok], s[ok]


def _open(g: _Group) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of accesses and of later touches of a grain of theirs by another thread that come before any synchronisation, and the bound."""
    rows, later = np.flatnonzero(g.tag <= READ), np.flatnonzero(g.tag == LATER)
    if not rows.size or not later.size:
        return
    threads, who = np.unique(g.thread_id[later], return_inverse=True)
    wrote = ~np.asarray(g.table.column("ord").is_null())
    grains, place = np.unique(g.address[later], return_inverse=True)
    order = np.argsort(place * threads.size + who)
    later, keys = later[order], (place * threads.size + who)[order]
    for t in range(threads.size):
        bound = g.bounds.after(g.thread_id[rows], np.full(rows.size, threads[t]), g.step[rows])
        some = np.flatnonzero((bound >= g.base + g.bounds.wide) & (g.thread_id[rows] != threads[t]))
        low, high = g.start[rows[some]] >> _SHIFT, np.maximum(g.start[rows[some]], g.end[rows[some]] - 1) >> _SHIFT
        for cut in _chunks(high - low + 1):
            whose, nth = _spread((high - low + 1)[cut])
            there = _places(grains, low[cut][whose] + nth)
            found = np.where(there >= 0, _places(keys, there * threads.size + t), -1)
            f, met = rows[some[cut][whose]], later[found]
            first = np.where(g.tag[f] == WRITE, g.step[met], np.where(wrote[met], g.ord[met], NEVER))
            ok = np.flatnonzero((found >= 0) & (first < bound[some[cut][whose]]))
            yield f[ok], met[ok], bound[some[cut][whose]][ok]


def conflicts(accesses: DataFrame, sync: DataFrame) -> DataFrame:
    """Overlapping pairs (f_, s_) of accesses (with write and function) by different threads, one a write, the second before any synchronisation from the first on.

    A read at a write's step is second, of two writes at one step the higher thread's. Pairs within a
    slice are found there; a first access that no synchronisation follows in its slice meets the
    later slices in which the other thread touches its grain.
    """
    reachable(accesses.sparkSession)
    width = span()
    own = _rows(accesses, F.when(F.col("write"), WRITE).otherwise(READ), width, "function")
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    others = _sync_rows(sync, own, width).unionByName(_later_places(own, width)).withColumn("function", F.lit(None).cast(kind["function"]))
    rows = own.unionByName(others)
    columns = ("step", "ord", "thread_id", "address", "size", "function")

    def side(g: _Group, prefix: str, at: np.ndarray) -> dict:
        return {f"{prefix}_{c}": (c, at) for c in columns} | {f"{prefix}_write": g.tag[at] == WRITE}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, width)
        for f, s in _conflicts(g):
            yield from g.batches(side(g, "f", f) | side(g, "s", s))

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, width)
        for f, met, bound in _open(g):
            last = np.minimum(bound - 1, g.size[met])
            first, last = g.step[met] // width, last // width
            yield from g.batches(side(g, "f", f) | {"f_start": ("start", f), "f_end": ("end", f), "grain": ("address", met), "other": ("thread_id", met), "bound": bound, "first": first, "last": last})

    fields = lambda p: f"{', '.join(f'{p}_{c} {kind[c]}' for c in columns)}, {p}_write boolean"
    found = rows.groupBy("slice").applyInArrow(within, f"{fields('f')}, {fields('s')}")
    left = rows.groupBy("slice").applyInArrow(beyond, f"{fields('f')}, f_start long, f_end long, grain long, other {kind['thread_id']}, bound long, first long, last long")
    left = left.withColumn("slice", F.explode(F.sequence("first", "last"))).drop("first", "last")
    seconds = _grained(own).select(
        *(F.col(c).alias(f"s_{c}") for c in columns), (F.col("tag") == WRITE).alias("s_write"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("slice").alias("s_slice"), F.col("grain").alias("s_grain")
    )
    late = left.join(seconds, (F.col("grain") == F.col("s_grain")) & (F.col("other") == F.col("s_thread_id")) & (F.col("slice") == F.col("s_slice")))
    once = F.col("grain") == _grain(F.greatest("f_start", "s_start"))
    late = late.where(once & (F.col("f_start") < F.col("s_end")) & (F.col("s_start") < F.col("f_end")) & (F.col("f_write") | F.col("s_write")) & (F.col("s_step") < F.col("bound")))
    return found.unionByName(late.select(*found.columns))


def _met(g: _Group) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of accesses and of rows that say which other thread touches a grain of theirs, and the bound."""
    rows, asked = np.flatnonzero(g.tag <= READ), np.flatnonzero(g.tag == LATER)
    if not rows.size or not asked.size:
        return
    threads, who = np.unique(g.thread_id[asked], return_inverse=True)
    grains, place = np.unique(g.address[asked], return_inverse=True)
    order = np.argsort(place * threads.size + who)
    asked, keys = asked[order], (place * threads.size + who)[order]
    low, high = g.start[rows] >> _SHIFT, np.maximum(g.start[rows], g.end[rows] - 1) >> _SHIFT
    for t in range(threads.size):
        bound = g.bounds.after(g.thread_id[rows], np.full(rows.size, threads[t]), g.step[rows])
        for cut in _chunks(high - low + 1):
            whose, nth = _spread((high - low + 1)[cut])
            there = _places(grains, low[cut][whose] + nth)
            found = np.where(there >= 0, _places(keys, there * threads.size + t), -1)
            ok = np.flatnonzero((found >= 0) & (g.thread_id[rows[cut]] != threads[t])[whose])
            yield rows[cut][whose[ok]], asked[found[ok]], bound[cut][whose[ok]]


def synced_overlaps(writes: DataFrame, reads: DataFrame, sync: DataFrame) -> DataFrame:
    """(step, thread_id, other, until, has_sync): each write and each read of another thread at its step or later that overlaps it, and whether both threads touch one lock between.

    By when they do is known for each write, grain and reading thread before the pairs are made, so
    these are the rows of one join and are not shuffled.
    """
    reachable(writes.sparkSession)
    width = span()
    written = _rows(writes, WRITE, width)
    read = _grained(_rows(reads, READ, width)).select("grain", "thread_id", F.col("step").alias("until"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    readers = read.groupBy("grain", "thread_id").agg(F.max("until").alias("last"))
    asked = _grained(written).select("grain", "slice").distinct().join(readers, "grain").where(F.col("last") >= F.col("slice") * width)
    blank = F.lit(None).cast("long")
    asked = asked.select("slice", F.lit(LATER).alias("tag"), blank.alias("step"), blank.alias("ord"), "thread_id", F.col("grain").alias("address"), *(blank.alias(c) for c in ("size", "start", "end")))
    rows = written.unionByName(asked).unionByName(_sync_rows(sync, written, width))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _Group(batches, width)
        for w, met, bound in _met(g):
            yield from g.batches({"step": ("step", w), "thread_id": ("thread_id", w), "other": ("thread_id", met), "w_start": ("start", w), "w_end": ("end", w), "w_grain": ("address", met), "bound": bound})

    kind = {f.name: f.dataType.simpleString() for f in written.schema}
    left = rows.groupBy("slice").applyInArrow(found, f"step {kind['step']}, thread_id {kind['thread_id']}, other {kind['thread_id']}, w_start long, w_end long, w_grain long, bound long")
    right = read.withColumnRenamed("thread_id", "reader")
    once = F.col("w_grain") == _grain(F.greatest("w_start", "r_start"))
    met = left.join(right, (F.col("w_grain") == F.col("grain")) & (F.col("other") == F.col("reader")) & (F.col("until") >= F.col("step")) & (F.col("w_start") < F.col("r_end")) & (F.col("r_start") < F.col("w_end")) & once)
    return met.select("step", "thread_id", "other", "until", (F.col("bound") <= F.col("until")).alias("has_sync"))
