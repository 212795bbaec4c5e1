"""Range and key lookups: filters that reach the scan, inclusive at both ends.

An unset bound adds no predicate. Results with an order say so; ties go by arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ordered, signed


def between(rows: DataFrame, column: str, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col(column) >= start)
    return rows if end is None else rows.where(F.col(column) <= end)


def addresses_between(rows: DataFrame, column: str, low: int | None, high: int | None) -> DataFrame:
    """Rows whose unsigned address is in a range; a range over 2^63 is two of signed numbers, and both reach the scan."""
    if low is None and high is None:
        return rows
    low, high, half = max(low or 0, 0), (1 << 64) - 1 if high is None else high, 1 << 63
    at = F.col(column)
    below = (at >= low) & (at <= min(high, half - 1)) if low < half else F.lit(False)
    above = (at >= signed(max(low, half))) & (at <= signed(high)) if high >= half else F.lit(False)
    return rows.where(below if high < half else above if low >= half else below | above)


def _ordered(rows: DataFrame, step: str, limit: int | None) -> DataFrame:
    rows = rows.orderBy(step, *(ordered(F.col(c)) if c == "address" else c for c in ("ord", "thread_id", "address") if c in rows.columns))
    return rows if limit is None else rows.limit(limit)


def instruction_at(instructions: DataFrame, step: int) -> DataFrame:
    """The last instruction that arrived for a step: one row or none."""
    return instructions.where(F.col("seq") == step).orderBy(F.desc("ord"), ordered(F.col("address")).desc(), F.desc("thread_id")).limit(1)


def instructions_range(instructions: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(instructions, "seq", start, end)


def steps_by_address(instructions: DataFrame, address: int) -> DataFrame:
    """(seq): the distinct steps at an address."""
    return instructions.where(F.col("address") == signed(address)).select("seq").distinct()


def steps_by_thread(instructions: DataFrame, thread_id: int) -> DataFrame:
    return instructions.where(F.col("thread_id") == thread_id).select("seq").distinct()


def thread_instructions(instructions: DataFrame, thread_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(instructions.where(F.col("thread_id") == thread_id), "seq", start, end)


def threads_at_address(instructions: DataFrame, address: int) -> DataFrame:
    """(thread_id, seq): a row for each execution."""
    return instructions.where(F.col("address") == signed(address)).select("thread_id", "seq")


def find_instructions(
    instructions: DataFrame, start: int | None = None, end: int | None = None, low: int | None = None, high: int | None = None, thread_id: int | None = None, address: int | None = None, limit: int | None = None
) -> DataFrame:
    """Instructions that meet every given condition, in step order; limit cuts after it."""
    rows = addresses_between(between(instructions, "seq", start, end), "address", low, high)
    if thread_id is not None:
        rows = rows.where(F.col("thread_id") == thread_id)
    if address is not None:
        rows = rows.where(F.col("address") == signed(address))
    return _ordered(rows, "seq", limit)


def jni_by_address(jni: DataFrame, address: int, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(jni.where(F.col("native_address") == signed(address)), "seq", start, end)


def jni_range(jni: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(jni, "seq", start, end)


def call_events(calls: DataFrame, func_id: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Call events of any type in a range; with func_id those with that callee, returns too."""
    rows = between(calls, "seq", start, end)
    return rows if func_id is None else rows.where(F.col("callee_func_id") == func_id & 0xFFFFFFFF)


def lock_events(sync: DataFrame, lock: int, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(sync.where(F.col("sync_object_addr") == signed(lock)), "step", start, end)


def thread_sync_events(sync: DataFrame, thread_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
    return between(sync.where(F.col("thread_id") == thread_id), "step", start, end)


def find_sync(sync: DataFrame, threads: DataFrame, thread_id: int | None = None, lock: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Sync events by lock and thread; with neither, those of registered threads only."""
    rows = between(sync, "step", start, end)
    if thread_id is None and lock is None:
        return rows.join(threads.select("thread_id").distinct(), "thread_id", "left_semi")
    if lock is not None:
        rows = rows.where(F.col("sync_object_addr") == signed(lock))
    return rows if thread_id is None else rows.where(F.col("thread_id") == thread_id)


def last_sync_access(sync: DataFrame, lock: int, step: int) -> DataFrame:
    """(step): the latest step of an event on a lock up to step; null without one."""
    return sync.where((F.col("sync_object_addr") == signed(lock)) & (F.col("step") <= step)).agg(F.max("step").alias("step"))


def context_switches(switches: DataFrame, start: int | None = None, end: int | None = None, thread_id: int | None = None) -> DataFrame:
    """Switches in a range, and from or to a thread if one is given."""
    rows = between(switches, "step", start, end)
    return rows if thread_id is None else rows.where((F.col("from_thread") == thread_id) | (F.col("to_thread") == thread_id))


def registered(threads: DataFrame) -> DataFrame:
    """Each thread once, as last registered."""
    rest = [c for c in threads.columns if c != "thread_id"]
    last = threads.groupBy("thread_id").agg(F.max_by(F.struct(*rest), F.struct("create_step", "ord")).alias("last"))
    return last.select("thread_id", *(F.col(f"last.{c}").alias(c) for c in rest))


def thread_info(threads: DataFrame, thread_id: int) -> DataFrame:
    return registered(threads.where(F.col("thread_id") == thread_id))


def writes_at(writes: DataFrame, step: int) -> DataFrame:
    return writes.where(F.col("step") == step)
