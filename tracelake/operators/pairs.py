"""Pairs of accesses: overlaps, races, data flows and producer/consumer patterns.

Accesses are cut into grains of GRAIN bytes, so overlap is an equality join on the grain with the
exact test behind it; a pair that shares several grains is kept on the later of both first
grains alone, so nothing has to be made distinct afterwards. Finer grains than a page keep
accesses to different words of one busy page apart.

Synchronisation between two threads is a number: the first step by which both have touched one
lock, counted from a step. It is found for accesses and not for pairs (module sweeps); first_sync()
finds it for any probes, from intervals that are minimal for the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import end_of, ordered
from . import sweeps
from .asof import active_function
from .kernels import least_later, neighbours

GRAIN = 16


def accesses(rows: DataFrame) -> DataFrame:
    """(step, ord, thread_id, address, size): accesses, of those alike in step, thread and address the first."""
    size = F.col("size") if "size" in rows.columns else F.octet_length("data")
    return rows.groupBy("step", "thread_id", "address").agg(F.min(F.struct("ord", size.cast("long").alias("size"))).alias("first")).select(
        "step", F.col("first.ord").alias("ord"), "thread_id", "address", F.col("first.size").alias("size")
    )


def _start(x: str) -> Column:
    return ordered(F.col(f"{x}_address"))


def _end(x: str) -> Column:
    """Behind an access's last byte, cut at the largest address."""
    return end_of(_start(x), F.col(f"{x}_size"))


def _grained(rows: DataFrame, prefix: str) -> DataFrame:
    """rows with columns prefixed, one for each grain that an access touches; one of size 0 has its own address's."""
    start = ordered(F.col("address"))
    last = F.greatest(start, end_of(start, F.greatest("size", F.lit(1))) - 1)
    grain = lambda at: F.shiftright(at, GRAIN.bit_length() - 1)
    return rows.select(*(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns), grain(start).alias(f"{prefix}_first"), F.explode(F.sequence(grain(start), grain(last))).alias("grain"))


def _overlap(a: str, b: str) -> Column:
    once = F.col("grain") == F.greatest(f"{a}_first", f"{b}_first")
    return once & (_start(a) < _end(b)) & (_start(b) < _end(a))


def overlapping(left: DataFrame, right: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of accesses by different threads whose byte ranges overlap, columns prefixed a_ and b_."""
    pairs = _grained(left, a).join(_grained(right, b), "grain").where(_overlap(a, b) & (F.col(f"{a}_thread_id") != F.col(f"{b}_thread_id")))
    return pairs.drop("grain", f"{a}_first", f"{b}_first")


def sync_intervals(sync: DataFrame) -> DataFrame:
    """(low_thread, high_thread, start, end): steps between which both threads touch one lock, none within another of the same lock.

    In the merged events of the pair on the lock these are the neighbours by different threads.
    """
    events = sync.select(F.col("sync_object_addr").alias("lock"), "thread_id", "step").distinct()
    others = events.select("lock", F.col("thread_id").alias("other")).distinct()
    merged = events.join(others, "lock").where("thread_id <> other").select(
        "lock", F.least("thread_id", "other").alias("low_thread"), F.greatest("thread_id", "other").alias("high_thread"), "thread_id", "step"
    )
    rows = neighbours(merged, ["low_thread", "high_thread", "lock"], ["step", "thread_id"], False, before="thread_id", start="step")
    return rows.where("before <> thread_id").groupBy("low_thread", "high_thread", "start").agg(F.min("step").alias("end"))


def first_sync(probes: DataFrame, sync: DataFrame) -> DataFrame:
    """probes (step, thread_id, other) with first_sync, the earliest end of an interval of the pair that starts at step or later; null if none does."""
    names = probes.columns
    low, high = F.least("thread_id", "other"), F.greatest("thread_id", "other")
    asked = probes.select(low.alias("low"), high.alias("high"), F.col("step").alias("at"), F.lit(None).cast("long").alias("end"), F.struct(*names).alias("probe"))
    known = sync_intervals(sync).select(
        F.col("low_thread").alias("low"), F.col("high_thread").alias("high"), F.col("start").alias("at"), F.col("end").cast("long").alias("end"), F.lit(None).cast(asked.schema["probe"].dataType).alias("probe")
    )
    found = least_later(asked.unionByName(known), ["low", "high"], ["at"], "end", "first_sync", at_once=True)
    return found.where("probe is not null").select("probe.*", "first_sync")


def has_sync(probes: DataFrame, sync: DataFrame) -> DataFrame:
    """probes (step, thread_id, other, until) with has_sync: whether both threads touch one lock from step to until."""
    return first_sync(probes, sync).withColumn("has_sync", F.coalesce(F.col("first_sync") <= F.col("until"), F.lit(False))).drop("first_sync")


def synced_overlaps(writes: DataFrame, reads: DataFrame, sync: DataFrame) -> DataFrame:
    """(step, thread_id, other, until, has_sync): writes and reads of another thread at their step or later that overlap them, and whether both threads touch one lock between."""
    return sweeps.synced_overlaps(accesses(writes), accesses(reads), sync)


def races(writes: DataFrame, reads: DataFrame, sync: DataFrame, calls: DataFrame) -> DataFrame:
    """Unsynchronised conflicting accesses of different threads.

    A row has address (the write's; of two writes the first's), steps, threads, kinds and sizes
    of both accesses, the range in conflict, confidence and description. A read at a write's step
    comes second; of two writes at one step the lower thread's comes first. Of rows alike in
    address, steps and threads the most confident stays. confidence is 0.5, plus 0.3 for a gap
    below 100 steps or 0.15 below 1000, plus 0.2 if both threads were in the same function then; at
    most 1, and times 0.8 between writes.
    """
    both = accesses(writes).withColumn("write", F.lit(True)).unionByName(accesses(reads).withColumn("write", F.lit(False)))
    both = active_function(both, calls).withColumnRenamed("active_function", "function")
    pairs = sweeps.conflicts(both, sync).withColumnsRenamed({"f_write": "first_is_write", "s_write": "second_is_write"})
    pairs = pairs.withColumn("kind", F.when(~F.col("second_is_write"), 0).when(F.col("first_is_write"), 1).otherwise(2))
    gap = F.col("s_step") - F.col("f_step")
    base = F.lit(0.5) + F.when(gap < 100, 0.3).when(gap < 1000, 0.15).otherwise(0.0)
    base = base + F.when(F.col("f_function") == F.col("s_function"), 0.2).otherwise(0.0)
    sure = F.least(base, F.lit(1.0)) * F.when(F.col("kind") == 1, 0.8).otherwise(1.0)
    low, high = F.greatest(_start("f"), _start("s")), F.least(_end("f"), _end("s"))
    rows = pairs.select(
        F.when(F.col("kind") == 2, F.col("s_address")).otherwise(F.col("f_address")).alias("address"), F.col("f_step").alias("first_step"), F.col("f_thread_id").alias("first_thread"), "first_is_write",
        F.col("f_size").alias("first_size"), F.col("s_step").alias("second_step"), F.col("s_thread_id").alias("second_thread"), "second_is_write", F.col("s_size").alias("second_size"),
        ordered(low).alias("overlap_address"), (high - low).alias("overlap_size"), sure.alias("confidence"), F.col("f_address").alias("first_address"), F.col("s_address").alias("second_address"), "kind",
    )
    key = ["address", "first_step", "first_thread", "second_step", "second_thread"]
    rest = [c for c in rows.columns if c not in (*key, "confidence")]
    # The most confident, then the kinds in their order, then the first that arrived.
    best = F.struct("confidence", (-F.col("kind")).alias("k"), F.bitwise_not(ordered(F.col("first_address"))).alias("fa"), F.bitwise_not(ordered(F.col("second_address"))).alias("sa"))
    one = rows.groupBy(*key).agg(F.max_by(F.struct("confidence", *rest), best).alias("b")).select(*key, "b.*")
    verb = lambda c: F.when(F.col(c), "wrote").otherwise("read")
    hexed = lambda c: F.concat(F.lit("0x"), F.hex(c))
    # Fixed value: the wording of a finding.
    text = F.format_string(
        "Thread %d %s %d bytes at %s (step %d), then thread %d %s %d bytes at %s (step %d) without synchronization; conflict range %s-%s (%d bytes)",
        "first_thread", verb("first_is_write"), "first_size", hexed(F.col("first_address")), "first_step", "second_thread", verb("second_is_write"), "second_size", hexed(F.col("second_address")), "second_step",
        hexed(F.col("overlap_address")), hexed(ordered(ordered(F.col("overlap_address")) + F.col("overlap_size"))), "overlap_size",
    )
    return one.withColumn("description", text).drop("kind", "first_address", "second_address")


def data_flows(writes: DataFrame, reads: DataFrame, sync: DataFrame) -> DataFrame:
    """(from_thread, to_thread, address, write_step, read_step, write_size, read_size, overlap_address, overlap_size, is_synchronized).

    For each write, and each other thread, the thread's first later read that overlaps it.
    is_synchronized says whether both threads touched one lock between the two steps.
    """
    rows = sweeps.first_reads(accesses(writes), accesses(reads), sync)
    start, begin = ordered(F.col("address")), ordered(F.col("read_address"))
    low, high = F.greatest(start, begin), F.least(end_of(start, F.col("write_size")), end_of(begin, F.col("read_size")))
    return rows.withColumns({"overlap_address": ordered(low), "overlap_size": high - low}).select(
        "from_thread", "to_thread", "address", "write_step", "read_step", "write_size", "read_size", "overlap_address", "overlap_size", "is_synchronized"
    )


def producer_consumer(flows: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """Pairs of threads with two flows or more: shared addresses, cycles, latencies and the lock they use most.

    shared_addresses has (address, access_size, overlap_size) of each address's first flow;
    mechanisms comes from stats.sync_mechanisms, for all pairs or those of the flows.
    """
    gap = F.col("read_step") - F.col("write_step")
    each = flows.groupBy("from_thread", "to_thread", "address").agg(
        F.min(F.struct("write_step", "read_step", "write_size", "overlap_size")).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(gap).alias("total"), F.max(gap).alias("most")
    )
    rows = each.groupBy("from_thread", "to_thread").agg(
        F.sort_array(F.collect_list(F.struct("address", F.col("first.write_size").alias("access_size"), F.col("first.overlap_size").alias("overlap_size")))).alias("shared_addresses"),
        F.sum("n").alias("cycle_count"), F.sum("total").alias("total"), F.max("most").alias("max_latency_steps"),
    ).where("cycle_count >= 2")
    joined = rows.join(mechanisms, (F.col("from_thread") == F.col("thread_a")) & (F.col("to_thread") == F.col("thread_b")), "left")
    return joined.select(
        F.col("from_thread").alias("producer_thread"), F.col("to_thread").alias("consumer_thread"), "shared_addresses", "cycle_count", F.expr("total div cycle_count").alias("avg_latency_steps"), "max_latency_steps",
        F.col("sync_object_addr").alias("sync_address"), F.col("kind").alias("sync_kind"),
    )
