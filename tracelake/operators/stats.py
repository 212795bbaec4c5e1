"""Grouped statistics over event tables. Lists in results are sorted and distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ordered
from ..schemas import ACQUIRES, INVOLUNTARY, RELEASES, VOLUNTARY, WAITING_STATES, is_contended, primitive_kind
from .asof import active_function, function_names
from .kernels import hold_intervals, neighbours
from .lookups import registered


def _listed(column: str | Column) -> Column:
    return F.sort_array(F.collect_set(column))


def hot_paths(instructions: DataFrame, top: int | None = None) -> DataFrame:
    """(address, hit_count, thread_ids, is_branch): addresses by hits, then address; at most top.

    An address that takes a third of all instructions is counted in partial sums first.
    """
    each = instructions.groupBy("address", "thread_id").agg(F.count(F.lit(1)).alias("hits"), F.bool_or("is_branch").alias("branch"))
    rows = each.groupBy("address").agg(F.sum("hits").alias("hit_count"), F.sort_array(F.collect_list("thread_id")).alias("thread_ids"), F.bool_or("branch").alias("is_branch"))
    rows = rows.orderBy(F.desc("hit_count"), ordered(F.col("address")))
    return rows if top is None else rows.limit(top)


def hot_path_totals(instructions: DataFrame) -> DataFrame:
    """(total_instructions, unique_addresses)."""
    each = instructions.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_instructions"), F.count(F.lit(1)).alias("unique_addresses"))


def branch_stats(instructions: DataFrame) -> DataFrame:
    """(address, total, taken, not_taken, taken_ratio): for each branch address."""
    rows = instructions.where("is_branch").groupBy("address").agg(F.count(F.lit(1)).alias("total"), F.count_if("branch_taken").alias("taken"))
    return rows.select("address", "total", "taken", (F.col("total") - F.col("taken")).alias("not_taken"), (F.col("taken") / F.col("total")).alias("taken_ratio"))


def branch_totals(instructions: DataFrame) -> DataFrame:
    """(unique_branch_addresses, always_taken, always_not_taken, variable)."""
    rows = branch_stats(instructions)
    return rows.agg(
        F.count(F.lit(1)).alias("unique_branch_addresses"), F.count_if(F.col("taken") == F.col("total")).alias("always_taken"),
        F.count_if(F.col("taken") == 0).alias("always_not_taken"), F.count_if((F.col("taken") > 0) & (F.col("taken") < F.col("total"))).alias("variable"),
    )


def thread_stats(threads: DataFrame, states: DataFrame, switches: DataFrame, sync: DataFrame) -> DataFrame:
    """Counters of each registered thread, over events from its registration on.

    steps_executed counts changes to Running. A switch counts for both its threads, and twice for
    one that switches to itself. Waits are averaged over contended acquires; the average is null
    without one, the maximum without a wait.
    """
    known = threads.groupBy("thread_id").agg(F.min("create_step").alias("since"))
    sides = F.explode(F.array("from_thread", "to_thread")).alias("thread_id")
    wait, contended = F.coalesce("wait_duration_ns", F.lit(0)), is_contended(F.col("result"), F.col("wait_duration_ns"))
    acquire = F.col("sync_type").isin(*ACQUIRES)
    none = F.lit(0)
    parts = (
        states.where("new_state = 'Running'").select("thread_id", "step", F.lit(1).alias("ran"), none.alias("switched"), none.alias("synced"), none.alias("acquired"), none.alias("released"), none.alias("met"), F.lit(0).cast("long").alias("waited")),
        switches.select(sides, "step", none.alias("ran"), F.lit(1).alias("switched"), none.alias("synced"), none.alias("acquired"), none.alias("released"), none.alias("met"), F.lit(0).cast("long").alias("waited")),
        sync.select(
            "thread_id", "step", none.alias("ran"), none.alias("switched"), F.lit(1).alias("synced"), acquire.cast("int").alias("acquired"), (F.col("sync_type").isin(*RELEASES) & ~acquire).cast("int").alias("released"),
            (acquire & contended).cast("int").alias("met"), F.when(acquire, wait).otherwise(0).cast("long").alias("waited"),
        ),
    )
    events = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counted = events.join(known, "thread_id").where("step >= since").groupBy("thread_id").agg(
        *(F.sum(c).alias(c) for c in ("ran", "switched", "synced", "acquired", "released", "met", "waited")), F.max("waited").alias("longest")
    )
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return known.join(counted, "thread_id", "left").select(
        "thread_id", zero("ran", "steps_executed"), zero("switched", "context_switch_count"), zero("synced", "sync_event_count"), zero("acquired", "lock_acquire_count"),
        zero("released", "lock_release_count"), zero("met", "lock_contention_count"), F.expr("case when met > 0 then waited div met end").alias("avg_lock_wait_ns"),
        F.when(F.col("longest") > 0, F.col("longest")).alias("max_lock_wait_ns"),
    )


def lock_contention(sync: DataFrame) -> DataFrame:
    """Attempts, contention and waits of each lock that has any event.

    Failed attempts count. Of events alike in step, thread, lock and type all take the first one's
    wait and result. kind is the primitive of the lock's first event.
    """
    alike = sync.groupBy("sync_object_addr", "step", "thread_id", "sync_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "result", "wait_duration_ns")).alias("first")
    )
    met = F.col("sync_type").isin(*ACQUIRES)
    contended = met & is_contended(F.col("first.result"), F.col("first.wait_duration_ns"))
    wait = F.when(met, F.coalesce("first.wait_duration_ns", F.lit(0))).otherwise(0)
    rows = alike.select("sync_object_addr", "step", "thread_id", "n", F.col("first.ord").alias("ord"), primitive_kind(F.col("sync_type")).alias("kind"), met.alias("met"), contended.alias("contended"), wait.alias("wait"))
    out = rows.groupBy("sync_object_addr").agg(
        F.min_by("kind", F.struct("step", "ord")).alias("kind"), F.sum(F.when(F.col("met"), F.col("n")).otherwise(0)).alias("acquire_count"),
        F.sum(F.when(F.col("contended"), F.col("n")).otherwise(0)).alias("contention_count"), F.sum(F.col("wait") * F.col("n")).alias("total_wait_ns"), F.max("wait").alias("max_wait_ns"),
        _listed(F.when(F.col("contended"), F.col("thread_id"))).alias("contending_threads"),
    )
    return out.select(
        "sync_object_addr", "kind", "acquire_count", "contention_count", F.when(F.col("acquire_count") > 0, F.col("contention_count") / F.col("acquire_count")).otherwise(0.0).alias("contention_ratio"),
        "total_wait_ns", F.expr("case when contention_count > 0 then total_wait_ns div contention_count else 0L end").alias("avg_wait_ns"), "max_wait_ns", "contending_threads",
    )


def critical_sections(sync: DataFrame) -> DataFrame:
    """Holds of each lock that was released at least once: number, steps, the longest one and the holders.

    Only an outermost hold from a successful acquire to its release counts. Of equally long ones
    the first released is the longest; if none took a step, longest_* are 0.
    """
    holds = hold_intervals(sync).where("end_step is not null").withColumn("steps", F.col("end_step") - F.col("start_step"))
    best = F.struct("steps", (-F.col("end_step")).alias("end"), (-F.col("end_ord")).alias("ord"), "thread_id", "start_step", "end_step")
    rows = holds.groupBy("sync_object_addr").agg(
        F.count(F.lit(1)).alias("hold_count"), F.sum("steps").alias("total_hold_steps"), F.max("steps").alias("max_hold_steps"), F.max(best).alias("best"), _listed("thread_id").alias("holder_threads")
    )
    longest = lambda name: F.when(F.col("max_hold_steps") > 0, F.col(f"best.{name}")).otherwise(0)
    return rows.select(
        "sync_object_addr", "hold_count", "total_hold_steps", F.expr("total_hold_steps div hold_count").alias("avg_hold_steps"), "max_hold_steps",
        longest("thread_id").alias("longest_thread"), longest("start_step").alias("longest_start"), longest("end_step").alias("longest_end"), "holder_threads",
    )


def thread_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(thread_id, callee_address, call_count, first_step, last_step, func_name): call events of any type by thread and callee."""
    rows = calls.groupBy("thread_id", "callee_address").agg(F.count(F.lit(1)).alias("call_count"), F.min("seq").alias("first_step"), F.max("seq").alias("last_step"))
    return function_names(rows, functions, "callee_address")


def scheduling(switches: DataFrame) -> DataFrame:
    """Scheduling of each thread that a switch names.

    core_residency has (core, steps): a stay lasts from a switch in on a known core to a switch out
    that follows at once among the thread's switches.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("role"), F.col("from_thread").alias("thread_id"), F.lit(None).cast("long").alias("core")),
        F.struct(F.lit(1).alias("role"), F.col("to_thread").alias("thread_id"), F.col("cpu_core").cast("long").alias("core")),
    )
    parts = switches.select("step", "ord", "switch_reason", F.explode(sides).alias("s")).select("step", "ord", "switch_reason", "s.*")
    before = neighbours(parts, ["thread_id"], ["step", "ord", "role"], False, was="role", on="core", since="step")
    stayed = F.when((F.col("role") == 0) & (F.col("was") == 1), F.col("on"))
    rows = before.withColumns({"stayed": stayed, "steps": F.when(stayed.isNotNull(), F.col("step") - F.col("since"))})
    cores = rows.where("stayed is not null").groupBy("thread_id", "stayed").agg(F.sum("steps").alias("steps")).groupBy("thread_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("stayed").alias("core"), "steps"))).alias("core_residency")
    )
    out, into = F.col("role") == 0, F.col("role") == 1
    counts = rows.groupBy("thread_id").agg(
        F.count_if(into).alias("switch_in_count"), F.count_if(out).alias("switch_out_count"), F.count_if(out & F.col("switch_reason").isin(*VOLUNTARY)).alias("voluntary_count"),
        F.count_if(out & F.col("switch_reason").isin(*INVOLUNTARY)).alias("involuntary_count"), F.count_if(into & (F.col("switch_reason") == "Migration")).alias("migration_count"), _listed("core").alias("cpu_cores"),
    )
    empty = F.array().cast("array<struct<core:bigint,steps:bigint>>")
    return counts.join(cores, "thread_id", "left").withColumn("core_residency", F.coalesce("core_residency", empty))


def thread_lifecycle(threads: DataFrame) -> DataFrame:
    """Parent, children, life span and depth in the spawn tree of each registered thread.

    A parent that is 0, the thread itself or unknown makes a root. In a cycle the depth is the number
    of moves until a thread repeats. Depth is worked out level by level: a round per level, each a
    join on thread ids.
    """
    own = registered(threads).select("thread_id", "parent_thread_id", "create_step", "exit_step", F.coalesce("name", F.lit("")).alias("name"))
    ids = own.select(F.col("thread_id").alias("known"))
    parents = own.join(ids, F.col("parent_thread_id") == F.col("known"), "left").select(
        F.col("thread_id").cast("long").alias("child"), F.when((F.col("parent_thread_id") != 0) & (F.col("parent_thread_id") != F.col("thread_id")), F.col("known")).cast("long").alias("parent")
    )
    spark = threads.sparkSession
    parents.createOrReplaceTempView("tracelake_parents")
    depths = spark.sql(
        """
        WITH RECURSIVE walk(thread, at, moves, seen) MAX RECURSION LEVEL 10000 AS (
          SELECT child, child, 0, array(child) FROM tracelake_parents
          UNION ALL
          SELECT w.thread, p.parent, w.moves + 1, array_append(w.seen, p.parent) FROM walk w JOIN tracelake_parents p ON p.child = w.at
          WHERE p.parent IS NOT NULL AND NOT array_contains(w.seen, p.parent)
        )
        SELECT thread AS depth_of, max(moves) AS tree_depth FROM walk GROUP BY thread"""
    )
    children = parents.where("parent is not null").groupBy(F.col("parent").alias("child_of")).agg(_listed("child").alias("children"))
    named = own.join(depths, F.col("thread_id") == F.col("depth_of")).join(children, F.col("thread_id") == F.col("child_of"), "left")
    return named.select(
        "thread_id", "parent_thread_id", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), "create_step", "exit_step",
        F.expr("case when exit_step >= create_step then exit_step - create_step end").alias("lifespan_steps"), F.col("exit_step").isNull().alias("is_alive"), "tree_depth", "name",
    )


def state_residency(threads: DataFrame, states: DataFrame) -> DataFrame:
    """Time that each thread with a state change spent in its states.

    A state lasts to the next change, the last one to the thread's exit, or no time without one.
    time_in_state has (state, steps) by name, without those of no time.
    """
    exits = registered(threads).select(F.col("thread_id").alias("of"), "exit_step")
    rows = neighbours(states, ["thread_id"], ["step", "ord"], True, next="step").join(exits, F.col("thread_id") == F.col("of"), "left")
    steps = F.greatest(F.lit(0), F.coalesce("next", "exit_step", "step") - F.col("step"))
    each = rows.withColumn("steps", steps).groupBy("thread_id", "new_state").agg(F.count(F.lit(1)).alias("n"), F.sum("steps").alias("steps"), F.max(F.struct("step", "ord")).alias("last"))
    waiting = F.col("new_state").isin(*WAITING_STATES)
    out = each.groupBy("thread_id").agg(
        F.sum("n").alias("transition_count"),
        F.sort_array(F.collect_list(F.when(F.col("steps") > 0, F.struct(F.col("new_state").alias("state"), "steps")))).alias("time_in_state"),
        F.sum(F.when(F.col("new_state") == "Running", F.col("steps")).otherwise(0)).alias("running_steps"), F.sum(F.when(waiting, F.col("steps")).otherwise(0)).alias("waiting_steps"),
        F.sum("steps").alias("total_steps"), F.max_by("new_state", "last").alias("final_state"),
    )
    return out.withColumn("blocked_ratio", F.when(F.col("total_steps") > 0, F.col("waiting_steps") / F.col("total_steps")).otherwise(0.0))


def jni_boundary(threads: DataFrame, jni: DataFrame, functions: DataFrame) -> DataFrame:
    """Crossings of each thread that crosses or is attached: counts, native addresses and their names, methods, first and last step."""
    attached = registered(threads).select(F.col("thread_id").alias("of"), "is_jni_attached")
    named = function_names(jni.groupBy("thread_id", "native_address").agg(F.count(F.lit(1)).alias("n")), functions, "native_address")
    addresses = named.groupBy(F.col("thread_id").alias("named")).agg(F.sort_array(F.collect_list(F.struct(F.col("native_address").alias("address"), F.col("func_name").alias("name")))).alias("a"))
    rows = jni.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("direction") == "JavaToNative").alias("j2n"), F.count_if(F.col("direction") == "NativeToJava").alias("n2j"),
        _listed(F.concat_ws(".", "java_class", "java_method")).alias("java_methods"), F.min("seq").alias("first_step"), F.max("seq").alias("last_step"),
    )
    both = rows.join(addresses, F.col("thread_id") == F.col("named"), "left").join(attached, F.col("thread_id") == F.col("of"), "full")
    both = both.where("thread_id is not null or is_jni_attached")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(
        F.coalesce("thread_id", "of").alias("thread_id"), F.coalesce("is_jni_attached", F.lit(False)).alias("is_jni_attached"), zero("total"), zero("j2n"), zero("n2j"),
        F.coalesce(F.transform("a", lambda x: x["address"]), F.array().cast("array<bigint>")).alias("native_addresses"),
        F.coalesce(F.transform("a", lambda x: x["name"]), F.array().cast("array<string>")).alias("native_names"),
        F.coalesce("java_methods", F.array().cast("array<string>")).alias("java_methods"), "first_step", "last_step",
    )


def function_safety(calls: DataFrame, sync: DataFrame, races: DataFrame) -> DataFrame:
    """(callee_address, calling_threads, sync_event_count, race_count, safety): a verdict on each callee.

    Sync events and both sides of each race count for the function active then on their thread.
    Unknown with one calling thread, else Unsafe with a race, ThreadSafe with sync, PotentiallyUnsafe otherwise.
    """
    callers = calls.groupBy("callee_address").agg(_listed("thread_id").alias("calling_threads"))
    synced = active_function(sync.select("thread_id", "step"), calls).where("active_function is not null").groupBy("active_function").agg(F.count(F.lit(1)).alias("n"))
    sides = races.select(F.explode(F.array(F.struct(F.col("first_thread").alias("thread_id"), F.col("first_step").alias("step")), F.struct(F.col("second_thread").alias("thread_id"), F.col("second_step").alias("step")))).alias("s")).select("s.*")
    raced = active_function(sides, calls).where("active_function is not null").groupBy(F.col("active_function").alias("raced_at")).agg(F.count(F.lit(1)).alias("r"))
    rows = callers.join(synced, F.col("callee_address") == F.col("active_function"), "left").join(raced, F.col("callee_address") == F.col("raced_at"), "left")
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    verdict = F.when(F.size("calling_threads") <= 1, "Unknown").when(r > 0, "Unsafe").when(n > 0, "ThreadSafe").otherwise("PotentiallyUnsafe")
    return rows.select("callee_address", "calling_threads", n.alias("sync_event_count"), r.alias("race_count"), verdict.alias("safety"))


def event_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, n): how many events of each kind."""
    out = None
    for name, rows in tables.items():
        own = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def sync_mechanisms(sync: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(thread_a, thread_b, sync_object_addr, kind): the object that two threads use most, counting both; ties go to the lowest address.

    It need not be used by both. A pair's best object is found from each thread's counts, so the
    work grows with pairs of threads and objects, not with events. pairs (thread_a, thread_b) are those
    asked for; without it all are.
    """
    counts = sync.groupBy("thread_id", "sync_object_addr").agg(F.count(F.lit(1)).alias("n"))
    if pairs is None:
        ids = counts.select("thread_id").distinct()
        pairs = ids.select(F.col("thread_id").alias("thread_a")).join(ids.select(F.col("thread_id").alias("thread_b")), F.col("thread_a") != F.col("thread_b"))
    used = pairs.select("thread_a", "thread_b", F.explode(F.array("thread_a", "thread_b")).alias("thread_id")).join(counts, "thread_id")
    total = used.groupBy("thread_a", "thread_b", "sync_object_addr").agg(F.sum("n").alias("n"))
    best = total.groupBy("thread_a", "thread_b").agg(F.max_by("sync_object_addr", F.struct("n", F.bitwise_not(ordered(F.col("sync_object_addr"))).alias("low"))).alias("sync_object_addr"))
    kinds = sync.groupBy(F.col("sync_object_addr").alias("kind_of")).agg(F.min_by(primitive_kind(F.col("sync_type")), F.struct("step", "ord")).alias("kind"))
    return best.join(kinds, F.col("sync_object_addr") == F.col("kind_of")).drop("kind_of")
