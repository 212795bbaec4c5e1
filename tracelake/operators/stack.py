"""Stack replay as window arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import least_later, lock_holds, reflected_depth


def call_stacks(calls: DataFrame, step: int, thread_id: int | None = None) -> DataFrame:
    """(thread_id, depth, func_id, entry_address, call_site, call_seq): frames at a step, depth 0 outermost.

    A call pushes, a return pops (nothing if the stack is empty), a tail call does both. A pushed
    frame is still there if the stack never fell below it afterwards.
    """
    rows = calls.where(F.col("seq") <= step)
    if thread_id is not None:
        rows = rows.where(F.col("thread_id") == thread_id)
    push, pop = F.struct(F.lit(1).alias("op"), F.lit(1).alias("change")), F.struct(F.lit(0).alias("op"), F.lit(-1).alias("change"))
    ops = F.when(F.col("event_type") == "Call", F.array(push)).when(F.col("event_type") == "Return", F.array(pop)).otherwise(F.array(pop, push))
    moves = rows.select("thread_id", "seq", "ord", "callee_func_id", "callee_address", "caller_address", F.explode(ops).alias("m")).select("*", "m.op", "m.change").drop("m")
    order = ["seq", "ord", "op"]
    depths = reflected_depth(moves, ["thread_id"], order, "change")
    live = least_later(depths, ["thread_id"], order, "depth", "lowest").where("change = 1 and (lowest is null or lowest >= depth)")
    return live.select(
        "thread_id", (F.col("depth") - 1).alias("depth"), F.col("callee_func_id").alias("func_id"), F.col("callee_address").alias("entry_address"),
        F.col("caller_address").alias("call_site"), F.col("seq").alias("call_seq"),
    )


def locks_held(sync: DataFrame, step: int) -> DataFrame:
    """(sync_object_addr, thread_id, held): whether each thread that ever took or freed a lock by a step holds it then."""
    depths = lock_holds(sync.where(F.col("step") <= step))
    return depths.groupBy("sync_object_addr", "thread_id").agg((F.max_by("depth", F.struct("step", "ord")) > 0).alias("held"))


def is_lock_held(sync: DataFrame, thread_id: int, lock: int, step: int) -> DataFrame:
    """(held): one row."""
    own = sync.where((F.col("thread_id") == thread_id) & (F.col("sync_object_addr") == lock))
    return locks_held(own, step).agg(F.coalesce(F.bool_or("held"), F.lit(False)).alias("held"))
