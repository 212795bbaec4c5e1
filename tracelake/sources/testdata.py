"""Trace tables derived from the driver's relational tables.

Each view is one projection of one table, so that filters and column choice reach the Parquet
scan. The same expressions make the views in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TID = "CAST(user_id % 6 + 1 AS INT)"

#: View: (table, filter, columns).
PROJECTIONS: dict[str, tuple[str, str, dict[str, str]]] = {
    "instructions": ("lineitem", "", {
        "seq": "l_orderkey", "ord": "CAST(l_linenumber AS BIGINT)", "thread_id": "CAST(l_suppkey % 6 + 1 AS INT)", "address": "4096 + (l_partkey % 256) * 4",
        "is_branch": "l_partkey % 8 = 0", "branch_taken": "(l_partkey % 8 = 0 AND l_returnflag = 'R')",
    }),
    "calls": ("orders", "", {
        "seq": "o_orderkey", "ord": "o_orderkey", "thread_id": "CAST(o_custkey % 6 + 1 AS INT)",
        "event_type": "CASE o_orderkey % 5 WHEN 0 THEN 'Call' WHEN 1 THEN 'Call' WHEN 2 THEN 'Return' WHEN 3 THEN 'Return' ELSE 'TailCall' END",
        "callee_address": "4096 + (o_custkey % 64) * 16", "caller_address": "8192 + (o_orderkey % 64) * 16", "callee_func_id": "CAST(o_custkey % 64 AS INT)",
    }),
    "reg_writes": ("orders", "", {"seq": "o_orderkey", "ord": "o_orderkey", "register_id": "CAST(o_custkey % 34 AS INT)", "value": "o_orderkey * 7 + o_custkey"}),
    "mem_writes": ("events", "event_type = 'purchase'", {
        "step": "event_id", "ord": "event_id", "thread_id": _TID, "address": "20480 + ((event_id * 7919) % 512) * 4", "size": "1 + event_id % 8",
    }),
    "mem_reads": ("events", "event_type = 'view'", {
        "step": "event_id", "ord": "event_id", "thread_id": _TID, "address": "20480 + ((event_id * 7919) % 512) * 4", "size": "1 + event_id % 8",
    }),
    "sync": ("events", "event_type IN ('click', 'signup', 'error')", {
        "step": "event_id", "ord": "event_id", "thread_id": _TID,
        "sync_type": "CASE event_type WHEN 'click' THEN 'MutexLock' WHEN 'signup' THEN 'MutexUnlock' ELSE 'MutexTryLock' END",
        "sync_object_addr": "40960 + (CAST(FLOOR(user_id / 6) AS BIGINT) % 5) * 64",
        "result": "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'WouldBlock' WHEN event_type = 'click' AND event_id % 11 = 0 THEN 'Timeout' ELSE 'Success' END",
        "wait_duration_ns": "CASE WHEN event_id % 4 = 0 THEN CAST(FLOOR(value * 1000) AS BIGINT) END",
    }),
    "states": ("events", "", {
        "step": "event_id", "ord": "event_id", "thread_id": _TID,
        "new_state": "CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'Runnable' WHEN 'purchase' THEN 'WaitingForLock' WHEN 'signup' THEN 'WaitingForIO' ELSE 'Sleeping' END",
    }),
    "jni": ("events", "event_type IN ('click', 'view')", {
        "seq": "event_id", "ord": "event_id", "thread_id": _TID, "direction": "CASE WHEN event_id % 2 = 0 THEN 'JavaToNative' ELSE 'NativeToJava' END",
        "java_class": "CONCAT('com.example.C', CAST(user_id % 7 AS STRING))", "java_method": "event_type", "native_address": "4096 + (user_id % 64) * 16",
    }),
    "functions": ("nation", "", {
        "offset": "4096 + CAST(n_nationkey AS BIGINT) * 40", "size": "CAST(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 32 END AS BIGINT)", "name": "n_name", "ord": "CAST(n_nationkey AS BIGINT)",
    }),
}

_REASON = "CASE event_type WHEN 'click' THEN 'Yield' WHEN 'view' THEN 'Preemption' WHEN 'purchase' THEN 'Blocking' WHEN 'signup' THEN 'TimeSliceExpired' ELSE 'Migration' END"
_CORE = "CASE WHEN event_id % 10 <> 0 THEN CAST(user_id % 4 AS INT) END"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A trace table by its short name."""
    if name == "threads":
        return (
            view(spark, sf_dir, "states")
            .groupBy("thread_id")
            .agg(F.min("step").alias("create_step"), F.max("step").alias("last"))
            .select(
                "thread_id", F.col("create_step").alias("ord"), F.expr("CAST(FLOOR(thread_id / 2) AS INT)").alias("parent_thread_id"), "create_step",
                F.expr("CASE WHEN thread_id % 2 = 0 THEN last END").alias("exit_step"), F.expr("CONCAT('worker-', CAST(thread_id AS STRING))").alias("name"),
                F.expr("thread_id % 3 = 0").alias("is_jni_attached"),
            )
        )
    if name == "switches":
        # The stream's order is global: rows are cut into ranges of steps, and a range's first
        # row takes the thread of the row before from the range before.
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_TID).alias("to_thread"), F.expr(_REASON).alias("switch_reason"), F.expr(_CORE).alias("cpu_core"))
        span = 65_536
        events = events.withColumn("cut", F.expr(f"event_id div {span}"))
        lasts = events.groupBy("cut").agg(F.max_by("to_thread", "event_id").alias("last"))
        lasts = lasts.select((F.col("cut")).alias("cut"), F.lag("last").over(Window.orderBy("cut")).alias("carried"))
        within = F.lag("to_thread").over(Window.partitionBy("cut").orderBy("event_id"))
        rows = events.withColumn("within", within).join(lasts, "cut").withColumn("from_thread", F.coalesce("within", "carried"))
        return rows.where("from_thread <> to_thread").select(F.col("event_id").alias("step"), F.col("event_id").alias("ord"), "from_thread", "to_thread", "switch_reason", "cpu_core")
    source, where, columns = PROJECTIONS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return (rows.where(where) if where else rows).selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def view_sql(*names: str) -> str:
    """WITH clause, without its keyword, that defines tr_ views for DuckDB."""
    out = []
    for name in names:
        if name == "threads":
            body = (
                "SELECT thread_id, MIN(event_id) AS ord, CAST(FLOOR(thread_id / 2) AS INT) AS parent_thread_id, MIN(event_id) AS create_step, CASE WHEN thread_id % 2 = 0 THEN MAX(event_id) END AS exit_step, "
                f"CONCAT('worker-', CAST(thread_id AS VARCHAR)) AS name, thread_id % 3 = 0 AS is_jni_attached FROM (SELECT event_id, {_TID} AS thread_id FROM events) e GROUP BY thread_id"
            )
        elif name == "switches":
            body = (
                f"SELECT step, step AS ord, from_thread, to_thread, switch_reason, cpu_core FROM (SELECT event_id AS step, LAG({_TID}) OVER (ORDER BY event_id) AS from_thread, {_TID} AS to_thread, "
                f"{_REASON} AS switch_reason, {_CORE} AS cpu_core FROM events) x WHERE from_thread IS NOT NULL AND from_thread <> to_thread"
            )
        else:
            source, where, columns = PROJECTIONS[name]
            body = "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {source}" + (f" WHERE {where}" if where else "")
        out.append(f"tr_{name} AS ({body})")
    return ", ".join(out)
