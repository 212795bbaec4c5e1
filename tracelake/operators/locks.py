"""The lock-order graph and its cycles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ordered
from ..schemas import ACQUIRES, SHARED_ACQUIRES
from .kernels import hold_intervals, least_later

#: Cycles of more locks than this raise an error instead of being missed.
LONGEST_CYCLE = 1000
#: Edges of a graph that is walked on the driver, at most.
SMALL = 10_000


def lock_order(sync: DataFrame) -> DataFrame:
    """(held, taken, thread_id): a thread took one lock while it held another.

    taken counts only if it is ever acquired exclusively, successfully or not. A lock is held from
    its outermost successful acquire until the step of the release. Whether a lock is taken within
    a hold is an as-of question, to the lock's next acquire after the hold's start; a hold is not
    paired with all acquires within it.
    """
    exclusive = sync.where(F.col("sync_type").isin(*ACQUIRES) & ~F.col("sync_type").isin(*SHARED_ACQUIRES)).select(F.col("sync_object_addr").alias("taken")).distinct()
    acquires = sync.where(F.col("sync_type").isin(*ACQUIRES) & (F.col("result") == "Success"))
    acquires = acquires.select("thread_id", F.col("sync_object_addr").alias("taken"), "step", "ord").join(exclusive, "taken", "left_semi")
    # The depth at a step counts every event of that step, so a hold that ends there is over.
    until = F.coalesce(F.col("end_step") - 1, F.lit(1 << 62))
    spans = hold_intervals(sync).select("thread_id", F.col("sync_object_addr").alias("held"), "start_step", "start_ord", until.alias("until")).where("until >= start_step")
    locks = acquires.select("thread_id", "taken").distinct()
    asked = spans.join(locks, "thread_id").where("held <> taken").select(
        "thread_id", "taken", F.col("start_step").alias("at"), F.col("start_ord").alias("ord"), F.struct("held", "until").alias("span"), F.lit(None).cast("long").alias("hit")
    )
    known = acquires.select("thread_id", "taken", F.col("step").alias("at"), "ord", F.lit(None).cast(asked.schema["span"].dataType).alias("span"), F.col("step").cast("long").alias("hit"))
    found = least_later(asked.unionByName(known), ["thread_id", "taken"], ["at", "ord"], "hit", "next").where("span is not null and next <= span.until")
    return found.select(F.col("span.held").alias("held"), "taken", "thread_id").distinct()


def _walk(pairs: list[tuple[int, int]], most: int) -> list[list[int]] | None:
    """All simple cycles of a small graph, each from its smallest lock on; None if there are more than most."""
    after: dict[int, list[int]] = {}
    for held, taken in sorted(pairs):
        after.setdefault(held, []).append(taken)
    out, steps = [], 0
    for start in sorted(after):
        path, choices = [start], [iter(after[start])]
        while path:
            lock = next(choices[-1], None)
            steps += 1
            if len(out) > most or steps > 50 * most:
                return None
            if lock is None:
                path.pop()
                choices.pop()
            elif lock == start:
                out.append(list(path))
            elif lock > start and lock not in path:
                path.append(lock)
                choices.append(iter(after.get(lock, ())))
    return out


def lock_cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(cycle): each simple cycle of the graph once, as its locks from the smallest on.

    A graph of at most small edges and not many more cycles is walked at once, as it fits anywhere;
    any other is left to a recursive query, with the same result.
    """
    spark = edges.sparkSession
    # Locks in order as unsigned numbers, and back at the end.
    pairs = edges.select(ordered(F.col("held")).alias("held"), ordered(F.col("taken")).alias("taken")).distinct()
    few = pairs.limit(small + 1).collect()
    found = _walk([(r.held, r.taken) for r in few], 10 * small) if len(few) <= small else None
    back = lambda cycles: cycles.select(F.transform("cycle", ordered).alias("cycle"))
    if found is not None:
        return back(spark.createDataFrame([(c,) for c in found], "cycle array<long>"))
    name = f"tracelake_lock_order_{uuid.uuid4().hex}"
    pairs.createOrReplaceTempView(name)
    return back(spark.sql(
        f"""
        WITH RECURSIVE paths(start, last, path) MAX RECURSION LEVEL {LONGEST_CYCLE} AS (
          SELECT held, taken, array(held, taken) FROM {name} WHERE taken > held
          UNION ALL
          SELECT p.start, e.taken, array_append(p.path, e.taken) FROM paths p JOIN {name} e ON e.held = p.last
          WHERE e.taken > p.start AND NOT array_contains(p.path, e.taken)
        )
        SELECT p.path AS cycle FROM paths p JOIN {name} e ON e.held = p.last AND e.taken = p.start"""
    ))


def deadlocks(sync: DataFrame) -> DataFrame:
    """(cycle, threads, violation_steps): potential deadlocks.

    threads are those of the cycle's edges, violation_steps their successful acquires of its locks; both sorted and distinct.
    """
    edges = lock_order(sync)
    cycles = lock_cycles(edges)
    size = F.size("cycle")
    steps = cycles.select("cycle", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    hops = steps.select("cycle", F.get("cycle", F.col("i")).alias("a"), F.get("cycle", (F.col("i") + 1) % F.size("cycle")).alias("b"))
    of = hops.join(edges, (F.col("a") == F.col("held")) & (F.col("b") == F.col("taken"))).select("cycle", "thread_id").distinct()
    acquires = sync.where(F.col("sync_type").isin(*ACQUIRES) & (F.col("result") == "Success")).select(F.col("thread_id").alias("by"), "sync_object_addr", "step")
    locks = of.select("cycle", "thread_id", F.explode("cycle").alias("lock"))
    at = locks.join(acquires, (F.col("thread_id") == F.col("by")) & (F.col("lock") == F.col("sync_object_addr"))).groupBy("cycle").agg(F.sort_array(F.collect_set("step")).alias("violation_steps"))
    threads = of.groupBy("cycle").agg(F.sort_array(F.collect_set("thread_id")).alias("threads"))
    return threads.join(at, "cycle").select("cycle", "threads", "violation_steps")
