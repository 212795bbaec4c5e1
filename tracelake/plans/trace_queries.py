"""A query for each operator over trace tables derived from the driver's, and its SQL for DuckDB.

The SQL states the meaning directly (joins over all earlier rows, quantified subqueries), not the
plan that the operators use, so that it can serve as an oracle. Lists are written as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, extras, kernels, locks, lookups, pairs, stack, stats
from ..schemas import ACQUIRES, HOLD_RELEASES, WAITING_STATES
from ..sources.testdata import view, view_sql

#: The point in time of as-of queries, by clock: events' and orders'.
EVENT_STEP, ORDER_STEP, LINE_STEP = 9_000, 14_000, 7_000
LOCK, THREAD, ADDRESS, REGISTER = 40_960, 3, 4_096 + 64 * 4, 5
MEMORY = (20_480 + 100, 64)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(key: str, views: tuple[str, ...], sql: str | None):
    """Registers a function of the named views, and its SQL over tr_ views of those names."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            text = sql.strip()
            recursive = text.startswith("RECURSIVE")
            text = text.removeprefix("RECURSIVE").strip()
            joined = f"{view_sql(*dict.fromkeys(views))}, {text.removeprefix('WITH ')}" if text.startswith("WITH ") else f"{view_sql(*dict.fromkeys(views))} {text}"
            ORACLE[key] = f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
        return f

    return add


def _text(column: str | Column, sep: str = ",") -> Column:
    return F.array_join(F.col(column).cast("array<string>") if isinstance(column, str) else column.cast("array<string>"), sep, "")


def _sql_set(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ACQ, _REL, _WAIT = _sql_set(ACQUIRES), _sql_set(HOLD_RELEASES), _sql_set(WAITING_STATES)

# -- range and key lookups ------------------------------------------------------------------

_INS = ("instructions",)
_query("ins_01", _INS, f"SELECT * FROM tr_instructions WHERE seq = {LINE_STEP} ORDER BY ord DESC, address DESC, thread_id DESC LIMIT 1")(lambda i: lookups.instruction_at(i, LINE_STEP))
_query("ins_02", _INS, f"SELECT * FROM tr_instructions WHERE seq >= 100")(lambda i: lookups.instructions_range(i, 100))
_query("ins_03", _INS, f"SELECT DISTINCT seq FROM tr_instructions WHERE address = {ADDRESS}")(lambda i: lookups.steps_by_address(i, ADDRESS))
_query("ins_04", _INS, f"SELECT DISTINCT seq FROM tr_instructions WHERE thread_id = {THREAD}")(lambda i: lookups.steps_by_thread(i, THREAD))
_query("ins_05", _INS, f"SELECT * FROM tr_instructions WHERE thread_id = {THREAD} AND seq >= 100")(lambda i: lookups.thread_instructions(i, THREAD, 100))
_query("ins_06", _INS, f"SELECT thread_id, seq FROM tr_instructions WHERE address = {ADDRESS}")(lambda i: lookups.threads_at_address(i, ADDRESS))
_query("ins_07", _INS, f"SELECT * FROM tr_instructions WHERE thread_id = {THREAD} AND address BETWEEN 4200 AND 4700 AND seq >= 100")(
    lambda i: lookups.find_instructions(i, 100, None, 4200, 4700, THREAD)
)
_query("ins_08", _INS, "SELECT * FROM tr_instructions WHERE seq >= 100 AND address BETWEEN 4200 AND 4700 ORDER BY seq, ord, thread_id, address LIMIT 500")(
    lambda i: lookups.find_instructions(i, start=100, low=4200, high=4700, limit=500)
)
_query("ins_09", _INS, f"SELECT * FROM tr_instructions WHERE thread_id = {THREAD} AND seq >= 100 ORDER BY seq, ord, thread_id, address LIMIT 500")(
    lambda i: lookups.find_instructions(i, start=100, thread_id=THREAD, limit=500)
)
_query("ins_10", _INS, f"SELECT * FROM tr_instructions WHERE address = {ADDRESS} AND seq >= 100 ORDER BY seq, ord, thread_id, address LIMIT 100")(
    lambda i: lookups.find_instructions(i, start=100, address=ADDRESS, limit=100)
)
_query("ins_11", _INS, "SELECT * FROM tr_instructions WHERE address BETWEEN 4200 AND 4700 ORDER BY seq, ord, thread_id, address LIMIT 10000")(
    lambda i: lookups.find_instructions(i, low=4200, high=4700, limit=10_000)
)
_query("ins_12", _INS, "SELECT DISTINCT thread_id, address FROM tr_instructions")(lambda i: i.select("thread_id", "address").distinct())
_query("jni_01", ("jni",), f"SELECT * FROM tr_jni WHERE native_address = 4256 AND seq >= 100")(lambda j: lookups.jni_by_address(j, 4256, start=100))
_query("jni_02", ("jni",), f"SELECT * FROM tr_jni WHERE seq >= 100")(lambda j: lookups.jni_range(j, 100))
_query("cal_01", ("calls",), f"SELECT * FROM tr_calls WHERE callee_func_id = 7 AND seq >= 100")(lambda c: lookups.call_events(c, 7, start=100))
_query("syn_01", ("sync",), f"SELECT * FROM tr_sync WHERE sync_object_addr = {LOCK} AND step >= 100")(lambda s: lookups.lock_events(s, LOCK, 100))
_query("syn_02", ("sync",), f"SELECT * FROM tr_sync WHERE thread_id = {THREAD}")(lambda s: lookups.thread_sync_events(s, THREAD))
_query("syn_03", ("sync", "threads"), "SELECT * FROM tr_sync WHERE thread_id IN (SELECT thread_id FROM tr_threads)")(lambda s, t: lookups.find_sync(s, t))
_query("syn_04", ("sync",), f"SELECT max(step) AS step FROM tr_sync WHERE sync_object_addr = {LOCK} AND step <= {EVENT_STEP}")(lambda s: lookups.last_sync_access(s, LOCK, EVENT_STEP))
_query("csw_01", ("switches",), f"SELECT * FROM tr_switches WHERE step >= 100 AND (from_thread = {THREAD} OR to_thread = {THREAD})")(
    lambda s: lookups.context_switches(s, start=100, thread_id=THREAD)
)
_query("thr_01", ("threads",), "SELECT * FROM tr_threads")(lambda t: lookups.registered(t).select("thread_id", "ord", "parent_thread_id", "create_step", "exit_step", "name", "is_jni_attached"))
_query(
    "thr_02", ("threads", "states"),
    f"SELECT t.thread_id, t.name, s.new_state FROM tr_threads t LEFT JOIN (SELECT thread_id, arg_max(new_state, step) AS new_state FROM tr_states WHERE step <= {EVENT_STEP} GROUP BY thread_id) s ON t.thread_id = s.thread_id",
)(lambda t, s: lookups.registered(t).select("thread_id", "name").join(s.where(F.col("step") <= EVENT_STEP).groupBy("thread_id").agg(F.max_by("new_state", F.struct("step", "ord")).alias("new_state")), "thread_id", "left"))
_query("mem_00", ("mem_writes",), "SELECT * FROM tr_mem_writes WHERE step = (SELECT max(step) FROM tr_mem_writes WHERE step <= 500)")(
    lambda w: w.join(F.broadcast(w.where("step <= 500").agg(F.max("step").alias("step"))), "step", "left_semi").select(*w.columns)
)

# -- as of a step ---------------------------------------------------------------------------

_query("reg_01", ("reg_writes",), f"SELECT register_id, value FROM tr_reg_writes WHERE register_id = {REGISTER} AND seq <= {ORDER_STEP} ORDER BY seq DESC, ord DESC LIMIT 1")(
    lambda r: asof.register_at(r, REGISTER, ORDER_STEP)
)
_query("reg_02", ("reg_writes",), f"SELECT DISTINCT seq FROM tr_reg_writes WHERE register_id = {REGISTER}")(lambda r: asof.register_history(r, REGISTER))
_query(
    "reg_03", ("reg_writes",),
    f"SELECT CAST(i AS INTEGER) AS register_id, coalesce((SELECT CASE WHEN i = 33 THEN value % 4294967296 ELSE value END FROM tr_reg_writes WHERE register_id = i AND seq <= {ORDER_STEP} ORDER BY seq DESC, ord DESC LIMIT 1), 0) AS value FROM range(34) t(i)",
)(lambda r: asof.register_state(r, ORDER_STEP))


def _with_data(writes: DataFrame) -> DataFrame:
    """Writes whose bytes are (step + i) % 256."""
    digits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: F.lpad(F.hex((F.col("step") + i) % 256), 2, "0"))
    return writes.withColumn("data", F.unhex(F.array_join(digits, "")))


_query("mem_01", ("mem_writes",), f"""
WITH bytes AS (SELECT step, address + i AS pos, (step + i) % 256 AS byte FROM tr_mem_writes, range(8) r(i) WHERE i < size AND step <= {EVENT_STEP}),
cell AS (SELECT a, coalesce((SELECT byte FROM bytes WHERE pos = a ORDER BY step DESC LIMIT 1), 0) AS byte FROM range({MEMORY[0]}, {sum(MEMORY)}) t(a))
SELECT CAST({MEMORY[0]} AS BIGINT) AS address, CAST(20480 AS BIGINT) AS page_address, string_agg(lower(printf('%02x', byte)), '' ORDER BY a) AS value,
  (SELECT count(*) FROM tr_mem_writes WHERE step <= {EVENT_STEP} AND address < 24576 AND address + size > 20480) AS deltas_applied FROM cell""")(
    lambda w: asof.memory_at(_with_data(w), *MEMORY, EVENT_STEP)
)
_query("mem_02", ("mem_writes",), f"""
WITH bytes AS (SELECT step, address + i AS pos, (step + i) % 256 AS byte FROM tr_mem_writes, range(8) r(i) WHERE i < size AND step <= {EVENT_STEP}),
final AS (SELECT pos, arg_max(byte, step) AS byte FROM bytes GROUP BY pos)
SELECT CAST(20480 AS BIGINT) AS page_address, string_agg(lower(printf('%02x', coalesce(byte, 0))), '' ORDER BY a) AS value FROM range(20480, 24576) t(a) LEFT JOIN final ON pos = a""")(
    lambda w: asof.page_at(_with_data(w), 20_480, EVENT_STEP)
)
_query("snp_01", ("instructions", "reg_writes", "mem_writes"), f"""
WITH w AS (SELECT max(step) AS step FROM tr_mem_writes WHERE step <= 500), x AS (SELECT * FROM tr_instructions WHERE seq = 500 ORDER BY ord DESC, address DESC, thread_id DESC LIMIT 1)
SELECT CAST(500 AS BIGINT) AS step, (SELECT address FROM x) AS address, (SELECT count(DISTINCT register_id) FROM tr_reg_writes WHERE seq <= 500) AS n_registers,
  (SELECT CAST(sum(v) AS BIGINT) FROM (SELECT arg_max(CASE WHEN register_id = 33 THEN value % 4294967296 ELSE value END, seq) AS v FROM tr_reg_writes WHERE seq <= 500 GROUP BY register_id) z) AS register_sum,
  (SELECT count(*) FROM tr_mem_writes WHERE step = 500) AS n_writes""")(
    lambda i, r, w: asof.step_snapshot(i, r, w, 500).select(
        "step", "instruction.address", F.size(F.filter(F.map_values("registers"), lambda v: v != 0)).cast("long").alias("n_registers"),
        F.aggregate(F.map_values("registers"), F.lit(0).cast("long"), lambda a, v: a + v).alias("register_sum"), F.size("writes").cast("long").alias("n_writes"),
    )
)
_query("sta_01", ("states",), f"SELECT thread_id, step, new_state FROM tr_states WHERE thread_id = {THREAD} AND step <= {EVENT_STEP} ORDER BY step DESC LIMIT 1")(lambda s: asof.thread_state(s, THREAD, EVENT_STEP))
_query("sta_02", ("threads", "states"), """
SELECT t.thread_id, CASE WHEN exit_step IS NOT NULL THEN 'Terminated' ELSE coalesce((SELECT new_state FROM tr_states s WHERE s.thread_id = t.thread_id ORDER BY step DESC LIMIT 1), 'Runnable') END AS state FROM tr_threads t""")(
    asof.thread_states
)
_TLN = ("instructions", "calls", "mem_writes", "sync", "switches", "states", "jni")


def _timeline(i, c, w, s, x, t, j) -> DataFrame:
    return asof.timeline({"instructions": i, "calls": c, "memory_writes": w, "sync_events": s, "context_switches": x, "state_changes": t, "jni_calls": j})


_TIMELINE_SQL = """
WITH e AS (
  SELECT seq AS step, 0 AS place, ord, thread_id, address, 0 AS bit FROM tr_instructions UNION ALL SELECT seq, 2, ord, thread_id, 0, 1 FROM tr_calls
  UNION ALL SELECT step, 3, ord, thread_id, 0, 2 FROM tr_mem_writes UNION ALL SELECT step, 4, ord, thread_id, 0, 4 FROM tr_sync UNION ALL SELECT step, 5, ord, 0, 0, 8 FROM tr_switches
  UNION ALL SELECT step, 6, ord, thread_id, 0, 16 FROM tr_states UNION ALL SELECT seq, 7, ord, thread_id, 0, 32 FROM tr_jni),
steps AS (SELECT step, CAST(first(thread_id ORDER BY place, ord, thread_id, address) AS BIGINT) AS thread_id, CAST(first(address ORDER BY place, ord, thread_id, address) AS BIGINT) AS instruction_address,
  false AS has_register_delta, bool_or(bit = 1) AS has_call_event, bool_or(bit = 2) AS has_memory_delta, bool_or(bit = 4) AS has_sync_event, bool_or(bit = 8) AS has_context_switch,
  bool_or(bit = 16) AS has_thread_event, bool_or(bit = 32) AS has_jni_call FROM e GROUP BY step)"""
_query("tln_01", _TLN, f"{_TIMELINE_SQL} SELECT * FROM steps")(_timeline)
_query("tln_02", _TLN, f"""{_TIMELINE_SQL}, f AS (SELECT step FROM steps WHERE step >= 10 AND thread_id = {THREAD} AND instruction_address BETWEEN 4200 AND 4900
  AND step IN (SELECT seq FROM tr_calls WHERE callee_func_id < 64))
SELECT step, (SELECT count(*) FROM f) AS total_count, (SELECT count(*) FROM f) > 200 AS has_more FROM f ORDER BY step LIMIT 200""")(
    lambda i, c, w, s, x, t, j: asof.find_timeline(_timeline(i, c, w, s, x, t, j), c, 10, None, THREAD, 4200, 4900, limit=200)
)
_query("tln_03", _TLN, f"{_TIMELINE_SQL} SELECT step FROM steps WHERE thread_id = {THREAD}")(lambda *v: _timeline(*v).where(F.col("thread_id") == THREAD).select("step"))
_query("tln_04", ("states", "sync", "switches"), f"""
SELECT * FROM (SELECT 'state_change' AS kind, step, ord, new_state AS detail FROM tr_states WHERE thread_id = {THREAD} UNION ALL SELECT 'sync', step, ord, sync_type FROM tr_sync WHERE thread_id = {THREAD}
  UNION ALL SELECT 'switch', step, ord, switch_reason FROM tr_switches WHERE {THREAD} IN (from_thread, to_thread)) z WHERE step >= 100""")(
    lambda t, s, x: asof.thread_timeline(t, s, x, THREAD, start=100)
)
_query("act_01", ("sync", "calls"), """
SELECT s.step, s.thread_id, c.callee_address AS active_function FROM tr_sync s ASOF LEFT JOIN tr_calls c ON s.thread_id = c.thread_id AND s.step >= c.seq""")(
    lambda s, c: asof.active_function(s.select("step", "thread_id"), c)
)
_query("fn_07", ("calls", "functions"), """
WITH a AS (SELECT DISTINCT callee_address AS address FROM tr_calls UNION SELECT DISTINCT caller_address FROM tr_calls),
n AS (SELECT a.address, (SELECT max("offset") FROM tr_functions f WHERE f."offset" <= a.address) AS below FROM a)
SELECT n.address, CASE WHEN n.address = below OR n.address < below + size THEN name END AS func_name FROM n LEFT JOIN tr_functions f ON f."offset" = below""")(
    lambda c, f: asof.function_names(c.select(F.explode(F.array("callee_address", "caller_address")).alias("address")).distinct(), f)
)

# -- stack replay ---------------------------------------------------------------------------

# An independent account of the stack: a push survives if no later running height falls below it.
_query("stk_01", ("calls",), f"""
WITH ops AS (SELECT thread_id, seq * 2 + 1 AS pos, seq, 1 AS d, callee_func_id, callee_address, caller_address FROM tr_calls WHERE event_type <> 'Return' AND seq <= {ORDER_STEP}
  UNION ALL SELECT thread_id, seq * 2, seq, -1, NULL, NULL, NULL FROM tr_calls WHERE event_type <> 'Call' AND seq <= {ORDER_STEP}),
r AS (SELECT *, sum(d) OVER (PARTITION BY thread_id ORDER BY pos) AS raw FROM ops),
h AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY thread_id ORDER BY pos)) AS height FROM r),
l AS (SELECT *, min(height) OVER (PARTITION BY thread_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest FROM h)
SELECT thread_id, CAST(height - 1 AS BIGINT) AS depth, callee_func_id AS func_id, callee_address AS entry_address, caller_address AS call_site, seq AS call_seq FROM l WHERE d = 1 AND (lowest IS NULL OR lowest >= height)""")(
    lambda c: stack.call_stacks(c, ORDER_STEP)
)
_HOLD_SQL = f"""
ev AS (SELECT sync_object_addr AS lock, thread_id, step, CASE WHEN sync_type IN ({_REL}) THEN -1 ELSE 1 END AS d FROM tr_sync
  WHERE sync_type IN ({_REL}) OR (sync_type IN ({_ACQ}) AND result = 'Success')),
raw AS (SELECT *, sum(d) OVER (PARTITION BY lock, thread_id ORDER BY step) AS raw FROM ev),
dep AS (SELECT *, raw - least(0, min(raw) OVER (PARTITION BY lock, thread_id ORDER BY step)) AS depth FROM raw),
pre AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY lock, thread_id ORDER BY step), 0) AS pd FROM dep),
opn AS (SELECT lock, thread_id, step AS s, (SELECT min(step) FROM pre q WHERE q.lock = p.lock AND q.thread_id = p.thread_id AND q.step > p.step AND q.depth = 0 AND q.d = -1 AND q.pd = 1) AS e FROM pre p WHERE d = 1 AND pd = 0)"""
_query("stk_03", ("sync",), f"WITH {_HOLD_SQL} SELECT lock AS sync_object_addr, thread_id, arg_max(depth, step) > 0 AS held FROM dep WHERE step <= {EVENT_STEP} GROUP BY lock, thread_id")(
    lambda s: stack.locks_held(s, EVENT_STEP)
)

# -- grouped statistics ---------------------------------------------------------------------

_query("agg_01", _INS, """
SELECT address, count(*) AS hit_count, array_to_string(list_sort(list(DISTINCT thread_id)), ',') AS thread_ids, bool_or(is_branch) AS is_branch FROM tr_instructions GROUP BY address ORDER BY hit_count DESC, address LIMIT 100""")(
    lambda i: stats.hot_paths(i, 100).withColumn("thread_ids", _text("thread_ids"))
)
_query("agg_01_totals", _INS, "SELECT count(*) AS total_instructions, count(DISTINCT address) AS unique_addresses FROM tr_instructions")(stats.hot_path_totals)
_query("agg_02", _INS, """
SELECT address, count(*) AS total, count(*) FILTER (branch_taken) AS taken, count(*) FILTER (NOT branch_taken) AS not_taken, round(count(*) FILTER (branch_taken) / count(*), 3) AS taken_ratio
FROM tr_instructions WHERE is_branch GROUP BY address""")(lambda i: stats.branch_stats(i).withColumn("taken_ratio", F.round("taken_ratio", 3)))
_query("agg_02_totals", _INS, """
WITH b AS (SELECT address, avg(CASE WHEN branch_taken THEN 1.0 ELSE 0.0 END) AS r FROM tr_instructions WHERE is_branch GROUP BY address)
SELECT count(*) AS unique_branch_addresses, count(*) FILTER (r = 1) AS always_taken, count(*) FILTER (r = 0) AS always_not_taken, count(*) FILTER (r > 0 AND r < 1) AS variable FROM b""")(stats.branch_totals)
_query("agg_03", ("threads", "states", "switches", "sync"), f"""
WITH y AS (SELECT s.*, s.sync_type IN ({_ACQ}) AS acq, coalesce(wait_duration_ns, 0) AS wait, coalesce(wait_duration_ns, 0) > 0 OR result IN ('WouldBlock', 'Timeout') AS met FROM tr_sync s JOIN tr_threads t USING (thread_id) WHERE s.step >= t.create_step)
SELECT t.thread_id, (SELECT count(*) FROM tr_states s WHERE s.thread_id = t.thread_id AND new_state = 'Running' AND step >= create_step) AS steps_executed,
  (SELECT count(*) FROM tr_switches x WHERE from_thread = t.thread_id AND step >= create_step) + (SELECT count(*) FROM tr_switches x WHERE to_thread = t.thread_id AND step >= create_step) AS context_switch_count,
  (SELECT count(*) FROM y WHERE y.thread_id = t.thread_id) AS sync_event_count, (SELECT count(*) FROM y WHERE y.thread_id = t.thread_id AND acq) AS lock_acquire_count,
  (SELECT count(*) FROM y WHERE y.thread_id = t.thread_id AND sync_type = 'MutexUnlock') AS lock_release_count, (SELECT count(*) FROM y WHERE y.thread_id = t.thread_id AND acq AND met) AS lock_contention_count,
  (SELECT CASE WHEN count(*) FILTER (met) > 0 THEN CAST(sum(wait) // count(*) FILTER (met) AS BIGINT) END FROM y WHERE y.thread_id = t.thread_id AND acq) AS avg_lock_wait_ns,
  (SELECT CASE WHEN max(wait) > 0 THEN max(wait) END FROM y WHERE y.thread_id = t.thread_id AND acq) AS max_lock_wait_ns FROM tr_threads t""")(stats.thread_stats)
_query("agg_04", ("sync",), f"""
WITH y AS (SELECT *, sync_type IN ({_ACQ}) AS acq, coalesce(wait_duration_ns, 0) AS wait, coalesce(wait_duration_ns, 0) > 0 OR result IN ('WouldBlock', 'Timeout') AS met FROM tr_sync)
SELECT sync_object_addr, 'Mutex' AS kind, count(*) FILTER (acq) AS acquire_count, count(*) FILTER (acq AND met) AS contention_count,
  CASE WHEN count(*) FILTER (acq) > 0 THEN count(*) FILTER (acq AND met) / count(*) FILTER (acq) ELSE 0.0 END AS contention_ratio, CAST(coalesce(sum(wait) FILTER (acq), 0) AS BIGINT) AS total_wait_ns,
  CAST(CASE WHEN count(*) FILTER (acq AND met) > 0 THEN sum(wait) FILTER (acq) // count(*) FILTER (acq AND met) ELSE 0 END AS BIGINT) AS avg_wait_ns, coalesce(max(wait) FILTER (acq), 0) AS max_wait_ns,
  array_to_string(list_sort(list(DISTINCT thread_id) FILTER (acq AND met)), ',') AS contending_threads FROM y GROUP BY sync_object_addr""")(
    lambda s: stats.lock_contention(s).withColumn("contending_threads", _text("contending_threads"))
)
_query("agg_05", ("sync",), f"""
WITH {_HOLD_SQL}, iv AS (SELECT *, e - s AS n FROM opn WHERE e IS NOT NULL), best AS (SELECT *, row_number() OVER (PARTITION BY lock ORDER BY n DESC, e) AS rn FROM iv)
SELECT lock AS sync_object_addr, count(*) AS hold_count, CAST(sum(n) AS BIGINT) AS total_hold_steps, CAST(sum(n) // count(*) AS BIGINT) AS avg_hold_steps, max(n) AS max_hold_steps,
  max(thread_id) FILTER (rn = 1) AS longest_thread, max(s) FILTER (rn = 1) AS longest_start, max(e) FILTER (rn = 1) AS longest_end, array_to_string(list_sort(list(DISTINCT thread_id)), ',') AS holder_threads
FROM best GROUP BY lock""")(lambda s: stats.critical_sections(s).withColumn("holder_threads", _text("holder_threads")))
_NAME_SQL = '(SELECT CASE WHEN {a} = f."offset" OR {a} < f."offset" + f.size THEN f.name END FROM tr_functions f WHERE f."offset" = (SELECT max(g."offset") FROM tr_functions g WHERE g."offset" <= {a}))'
_query("agg_06", ("calls", "functions"), f"""
WITH c AS (SELECT thread_id, callee_address, count(*) AS call_count, min(seq) AS first_step, max(seq) AS last_step FROM tr_calls GROUP BY thread_id, callee_address)
SELECT c.*, {_NAME_SQL.format(a="c.callee_address")} AS func_name FROM c""")(stats.thread_functions)
_query("agg_07", ("switches",), """
WITH p AS (SELECT step * 2 AS pos, step, 0 AS role, from_thread AS thread_id, NULL AS core, switch_reason FROM tr_switches UNION ALL SELECT step * 2 + 1, step, 1, to_thread, cpu_core, switch_reason FROM tr_switches),
q AS (SELECT *, lag(role) OVER w AS was, lag(core) OVER w AS on_core, lag(step) OVER w AS since FROM p WINDOW w AS (PARTITION BY thread_id ORDER BY pos)),
c AS (SELECT thread_id, string_agg(on_core || ':' || n, ',' ORDER BY on_core) AS r FROM (SELECT thread_id, on_core, sum(step - since) AS n FROM q WHERE role = 0 AND was = 1 AND on_core IS NOT NULL GROUP BY thread_id, on_core) z GROUP BY thread_id)
SELECT q.thread_id, count(*) FILTER (role = 1) AS switch_in_count, count(*) FILTER (role = 0) AS switch_out_count, count(*) FILTER (role = 0 AND switch_reason IN ('Yield', 'Blocking')) AS voluntary_count,
  count(*) FILTER (role = 0 AND switch_reason IN ('Preemption', 'TimeSliceExpired', 'Interrupt')) AS involuntary_count, count(*) FILTER (role = 1 AND switch_reason = 'Migration') AS migration_count,
  array_to_string(list_sort(list(DISTINCT core) FILTER (core IS NOT NULL)), ',') AS cpu_cores, coalesce(any_value(c.r), '') AS core_residency FROM q LEFT JOIN c USING (thread_id) GROUP BY q.thread_id""")(
    lambda s: stats.scheduling(s).withColumns(
        {"cpu_cores": _text("cpu_cores"), "core_residency": F.array_join(F.transform("core_residency", lambda x: F.concat_ws(":", x["core"].cast("string"), x["steps"].cast("string"))), ",")}
    )
)
_query("agg_08", ("threads",), """RECURSIVE
WITH par AS (SELECT t.thread_id AS child, p.thread_id AS parent FROM tr_threads t LEFT JOIN tr_threads p ON t.parent_thread_id = p.thread_id AND t.parent_thread_id <> 0 AND t.parent_thread_id <> t.thread_id),
walk AS (SELECT child AS t, child AS cur, 0 AS n, [child] AS seen FROM par UNION ALL SELECT w.t, p.parent, w.n + 1, list_append(w.seen, p.parent) FROM walk w JOIN par p ON p.child = w.cur WHERE p.parent IS NOT NULL AND NOT list_contains(w.seen, p.parent))
SELECT t.thread_id, t.parent_thread_id, coalesce((SELECT string_agg(child, ',' ORDER BY child) FROM par WHERE parent = t.thread_id), '') AS children, create_step, exit_step,
  CASE WHEN exit_step >= create_step THEN exit_step - create_step END AS lifespan_steps, exit_step IS NULL AS is_alive, (SELECT max(n) FROM walk WHERE walk.t = t.thread_id) AS tree_depth, coalesce(name, '') AS name FROM tr_threads t""")(
    lambda t: stats.thread_lifecycle(t).withColumn("children", _text("children"))
)
_query("agg_09", ("threads", "states"), f"""
WITH i AS (SELECT s.*, greatest(0, coalesce(lead(step) OVER (PARTITION BY s.thread_id ORDER BY step), exit_step, step) - step) AS n FROM tr_states s LEFT JOIN tr_threads t USING (thread_id)),
g AS (SELECT thread_id, string_agg(new_state || ':' || n, ',' ORDER BY new_state) AS r FROM (SELECT thread_id, new_state, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY thread_id, new_state) z WHERE n > 0 GROUP BY thread_id)
SELECT thread_id, count(*) AS transition_count, coalesce(any_value(r), '') AS time_in_state, CAST(coalesce(sum(n) FILTER (new_state = 'Running'), 0) AS BIGINT) AS running_steps,
  CAST(coalesce(sum(n) FILTER (new_state IN ({_WAIT})), 0) AS BIGINT) AS waiting_steps, CAST(sum(n) AS BIGINT) AS total_steps, arg_max(new_state, step) AS final_state,
  CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (new_state IN ({_WAIT})), 0) / sum(n) ELSE 0.0 END AS blocked_ratio FROM i LEFT JOIN g USING (thread_id) GROUP BY thread_id""")(
    lambda t, s: stats.state_residency(t, s).withColumn("time_in_state", F.array_join(F.transform("time_in_state", lambda x: F.concat_ws(":", x["state"], x["steps"].cast("string"))), ","))
)
_query("agg_10", ("threads", "jni", "functions"), f"""
WITH a AS (SELECT DISTINCT thread_id, native_address AS x FROM tr_jni), n AS (SELECT thread_id, string_agg(x, ',' ORDER BY x) AS xs, string_agg(coalesce({_NAME_SQL.format(a="a.x")}, ''), ',' ORDER BY x) AS ns FROM a GROUP BY thread_id),
j AS (SELECT thread_id, count(*) AS total, count(*) FILTER (direction = 'JavaToNative') AS j2n, count(*) FILTER (direction = 'NativeToJava') AS n2j,
  array_to_string(list_sort(list(DISTINCT java_class || '.' || java_method)), ',') AS java_methods, min(seq) AS first_step, max(seq) AS last_step FROM tr_jni GROUP BY thread_id)
SELECT coalesce(j.thread_id, t.thread_id) AS thread_id, coalesce(t.is_jni_attached, false) AS is_jni_attached, coalesce(total, 0) AS total, coalesce(j2n, 0) AS j2n, coalesce(n2j, 0) AS n2j, coalesce(xs, '') AS native_addresses,
  coalesce(ns, '') AS native_names, coalesce(java_methods, '') AS java_methods, first_step, last_step FROM j LEFT JOIN n USING (thread_id) FULL JOIN tr_threads t ON t.thread_id = j.thread_id WHERE j.thread_id IS NOT NULL OR t.is_jni_attached""")(
    lambda t, j, f: stats.jni_boundary(t, j, f).withColumns({c: _text(c) for c in ("native_addresses", "native_names", "java_methods")})
)
_query("agg_12", ("instructions", "calls", "mem_writes", "mem_reads", "sync", "switches", "states", "jni", "threads"), """
SELECT 'instructions' AS kind, count(*) AS n FROM tr_instructions UNION ALL SELECT 'calls', count(*) FROM tr_calls UNION ALL SELECT 'memory_writes', count(*) FROM tr_mem_writes UNION ALL SELECT 'memory_reads', count(*) FROM tr_mem_reads
UNION ALL SELECT 'sync_events', count(*) FROM tr_sync UNION ALL SELECT 'context_switches', count(*) FROM tr_switches UNION ALL SELECT 'state_changes', count(*) FROM tr_states UNION ALL SELECT 'jni_calls', count(*) FROM tr_jni
UNION ALL SELECT 'threads', count(*) FROM tr_threads""")(
    lambda *v: stats.event_counts(dict(zip(("instructions", "calls", "memory_writes", "memory_reads", "sync_events", "context_switches", "state_changes", "jni_calls", "threads"), v)))
)
_query("agg_13", ("sync",), """
WITH c AS (SELECT thread_id, sync_object_addr, count(*) AS n FROM tr_sync GROUP BY 1, 2), t AS (SELECT DISTINCT thread_id FROM tr_sync),
p AS (SELECT a.thread_id AS thread_a, b.thread_id AS thread_b, sync_object_addr, sum(n) AS n FROM t a, t b, c WHERE a.thread_id <> b.thread_id AND c.thread_id IN (a.thread_id, b.thread_id) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY thread_a, thread_b ORDER BY n DESC, sync_object_addr) AS k FROM p)
SELECT thread_a, thread_b, sync_object_addr, 'Mutex' AS kind FROM r WHERE k = 1""")(stats.sync_mechanisms)

# -- pairs and graphs -----------------------------------------------------------------------

_OVER = "w.thread_id <> r.thread_id AND r.address < w.address + w.size AND w.address < r.address + r.size"
_SYNCED = "EXISTS (SELECT 1 FROM tr_sync x JOIN tr_sync y ON x.sync_object_addr = y.sync_object_addr WHERE x.thread_id = {a} AND y.thread_id = {b} AND x.step BETWEEN {f} AND {t} AND y.step BETWEEN {f} AND {t})"
# The same by the earliest common touch of each lock, which DuckDB can work out for many pairs.
_NEXT_SQL = """
lk AS (SELECT DISTINCT sync_object_addr AS lock, thread_id FROM tr_sync), acc AS (SELECT step, thread_id FROM tr_mem_writes UNION SELECT step, thread_id FROM tr_mem_reads),
nx AS (SELECT p.step, lk.thread_id, lk.lock, s.step AS nxt FROM (SELECT DISTINCT step FROM acc) p CROSS JOIN lk ASOF LEFT JOIN tr_sync s ON s.thread_id = lk.thread_id AND s.sync_object_addr = lk.lock AND s.step >= p.step),
fs AS (SELECT a.step, a.thread_id, b.thread_id AS other, min(greatest(a.nxt, b.nxt)) FILTER (a.nxt IS NOT NULL AND b.nxt IS NOT NULL) AS fs FROM nx a JOIN nx b ON a.step = b.step AND a.lock = b.lock AND a.thread_id <> b.thread_id
  JOIN acc ON acc.step = a.step AND acc.thread_id = a.thread_id GROUP BY 1, 2, 3)"""
_query("joi_01", ("mem_writes", "mem_reads"), f"""
SELECT w.step AS w_step, w.thread_id AS w_thread_id, w.address AS w_address, w.size AS w_size, r.step AS r_step, r.thread_id AS r_thread_id, r.address AS r_address, r.size AS r_size
FROM tr_mem_writes w JOIN tr_mem_reads r ON {_OVER} AND r.step >= w.step""")(
    lambda w, r: pairs.overlapping(pairs.accesses(w), pairs.accesses(r), "w", "r").where("r_step >= w_step").drop("w_ord", "r_ord")
)
_query("joi_02", ("mem_writes", "mem_reads", "sync"), f"""
WITH {_NEXT_SQL}
SELECT w.step, w.thread_id, r.thread_id AS other, r.step AS until, coalesce(fs.fs <= r.step, false) AS has_sync FROM tr_mem_writes w JOIN tr_mem_reads r ON {_OVER} AND r.step >= w.step
LEFT JOIN fs ON fs.step = w.step AND fs.thread_id = w.thread_id AND fs.other = r.thread_id""")(
    pairs.synced_overlaps
)
_RACES_SQL = f"""{_NEXT_SQL},
pr AS (SELECT 0 AS kind, w.step AS s1, w.thread_id AS t1, w.address AS a1, w.size AS z1, r.step AS s2, r.thread_id AS t2, r.address AS a2, r.size AS z2 FROM tr_mem_writes w JOIN tr_mem_reads r ON {_OVER} AND r.step >= w.step
  UNION ALL SELECT 1, w.step, w.thread_id, w.address, w.size, r.step, r.thread_id, r.address, r.size FROM tr_mem_writes w JOIN tr_mem_writes r ON {_OVER} AND (r.step > w.step OR (r.step = w.step AND w.thread_id < r.thread_id))
  UNION ALL SELECT 2, r.step, r.thread_id, r.address, r.size, w.step, w.thread_id, w.address, w.size FROM tr_mem_writes w JOIN tr_mem_reads r ON {_OVER} AND r.step < w.step),
un AS (SELECT pr.* FROM pr LEFT JOIN fs ON fs.step = s1 AND fs.thread_id = t1 AND fs.other = t2 WHERE fs.fs IS NULL OR fs.fs > s2),
cf AS (SELECT un.*, f.callee_address AS f1 FROM un ASOF LEFT JOIN tr_calls f ON f.thread_id = un.t1 AND un.s1 >= f.seq),
cg AS (SELECT cf.*, g.callee_address AS f2 FROM cf ASOF LEFT JOIN tr_calls g ON g.thread_id = cf.t2 AND cf.s2 >= g.seq),
cx AS (SELECT *, least(0.5::DOUBLE + CASE WHEN s2 - s1 < 100 THEN 0.3::DOUBLE WHEN s2 - s1 < 1000 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN f1 = f2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)
  * CASE WHEN kind = 1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN kind = 2 THEN a2 ELSE a1 END AS address FROM cg),
races AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, s1, t1, s2, t2 ORDER BY confidence DESC, kind, a1, a2) AS k FROM cx) z WHERE k = 1)"""
_RACE_COLUMNS = """address, s1 AS first_step, t1 AS first_thread, kind <> 2 AS first_is_write, z1 AS first_size, s2 AS second_step, t2 AS second_thread, kind <> 0 AS second_is_write, z2 AS second_size,
  greatest(a1, a2) AS overlap_address, least(a1 + z1, a2 + z2) - greatest(a1, a2) AS overlap_size, round(confidence, 6) AS confidence,
  printf('Thread %d %s %d bytes at 0x%X (step %d), then thread %d %s %d bytes at 0x%X (step %d) without synchronization; conflict range 0x%X-0x%X (%d bytes)', t1, CASE WHEN kind <> 2 THEN 'wrote' ELSE 'read' END, z1, a1, s1,
    t2, CASE WHEN kind <> 0 THEN 'wrote' ELSE 'read' END, z2, a2, s2, greatest(a1, a2), least(a1 + z1, a2 + z2), least(a1 + z1, a2 + z2) - greatest(a1, a2)) AS description"""
_RACE_VIEWS = ("mem_writes", "mem_reads", "sync", "calls")
_query("rac_01", _RACE_VIEWS, f"WITH {_RACES_SQL} SELECT {_RACE_COLUMNS} FROM races")(lambda w, r, s, c: pairs.races(w, r, s, c).withColumn("confidence", F.round("confidence", 6)))
_query("rac_02", _RACE_VIEWS, f"WITH {_RACES_SQL} SELECT round(confidence, 6) AS confidence, count(*) AS n FROM races GROUP BY 1")(
    lambda w, r, s, c: pairs.races(w, r, s, c).groupBy(F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
)
_query("agg_11", _RACE_VIEWS, f"""
WITH {_RACES_SQL}, sd AS (SELECT s1 AS step, t1 AS thread_id FROM races UNION ALL SELECT s2, t2 FROM races), rf AS (SELECT c.callee_address AS x, count(*) AS n FROM sd ASOF JOIN tr_calls c ON sd.thread_id = c.thread_id AND sd.step >= c.seq GROUP BY 1),
sf AS (SELECT c.callee_address AS x, count(*) AS n FROM tr_sync s ASOF JOIN tr_calls c ON s.thread_id = c.thread_id AND s.step >= c.seq GROUP BY 1),
k AS (SELECT callee_address, list_sort(list(DISTINCT thread_id)) AS ts FROM tr_calls GROUP BY 1)
SELECT callee_address, array_to_string(ts, ',') AS calling_threads, coalesce(sf.n, 0) AS sync_event_count, coalesce(rf.n, 0) AS race_count,
  CASE WHEN len(ts) <= 1 THEN 'Unknown' WHEN coalesce(rf.n, 0) > 0 THEN 'Unsafe' WHEN coalesce(sf.n, 0) > 0 THEN 'ThreadSafe' ELSE 'PotentiallyUnsafe' END AS safety
FROM k LEFT JOIN sf ON sf.x = callee_address LEFT JOIN rf ON rf.x = callee_address""")(
    lambda w, r, s, c: stats.function_safety(c, s, pairs.races(w, r, s, c)).withColumn("calling_threads", _text("calling_threads"))
)
_FLOWS_SQL = f"""{_NEXT_SQL},
pf AS (SELECT w.thread_id AS from_thread, r.thread_id AS to_thread, w.address, w.step AS write_step, w.size AS write_size, r.step AS read_step, r.address AS ra, r.size AS read_size,
  row_number() OVER (PARTITION BY w.thread_id, r.thread_id, w.address, w.step ORDER BY r.step, r.address) AS k FROM tr_mem_writes w JOIN tr_mem_reads r ON {_OVER} AND r.step > w.step),
flows AS (SELECT from_thread, to_thread, address, write_step, read_step, write_size, read_size, greatest(address, ra) AS overlap_address, least(address + write_size, ra + read_size) - greatest(address, ra) AS overlap_size,
  coalesce(fs.fs <= read_step, false) AS is_synchronized FROM pf LEFT JOIN fs ON fs.step = write_step AND fs.thread_id = from_thread AND fs.other = to_thread WHERE k = 1)"""
_query("flo_01", ("mem_writes", "mem_reads", "sync"), f"WITH {_FLOWS_SQL} SELECT * FROM flows")(pairs.data_flows)
_query("flo_02", ("mem_writes", "mem_reads", "sync"), f"""
WITH {_FLOWS_SQL}, ad AS (SELECT from_thread, to_thread, string_agg(address || ':' || ws || ':' || os, ',' ORDER BY address) AS addrs FROM
  (SELECT from_thread, to_thread, address, arg_min(write_size, write_step) AS ws, arg_min(overlap_size, write_step) AS os FROM flows GROUP BY 1, 2, 3) z GROUP BY 1, 2),
c AS (SELECT thread_id, sync_object_addr, count(*) AS n FROM tr_sync GROUP BY 1, 2), g AS (SELECT from_thread, to_thread, count(*) AS cycle_count, CAST(sum(read_step - write_step) // count(*) AS BIGINT) AS avg_latency_steps,
  max(read_step - write_step) AS max_latency_steps FROM flows GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT from_thread, to_thread, sync_object_addr, row_number() OVER (PARTITION BY from_thread, to_thread ORDER BY sum(n) DESC, sync_object_addr) AS k FROM g JOIN c ON c.thread_id IN (from_thread, to_thread) GROUP BY 1, 2, 3)
SELECT g.from_thread AS producer_thread, g.to_thread AS consumer_thread, ad.addrs AS shared_addresses, cycle_count, avg_latency_steps, max_latency_steps, sync_object_addr AS sync_address, 'Mutex' AS sync_kind
FROM g JOIN ad USING (from_thread, to_thread) LEFT JOIN m ON m.from_thread = g.from_thread AND m.to_thread = g.to_thread AND m.k = 1""")(
    lambda w, r, s: pairs.producer_consumer(pairs.data_flows(w, r, s), stats.sync_mechanisms(s)).withColumn(
        "shared_addresses", F.array_join(F.transform("shared_addresses", lambda x: F.concat_ws(":", x["address"].cast("string"), x["access_size"].cast("string"), x["overlap_size"].cast("string"))), ",")
    )
)
_EDGES_SQL = f"""{_HOLD_SQL},
aq AS (SELECT DISTINCT thread_id, sync_object_addr AS lock, step FROM tr_sync WHERE sync_type IN ({_ACQ}) AND result = 'Success'),
edges AS (SELECT DISTINCT o.lock AS held, a.lock AS taken, a.thread_id FROM opn o JOIN aq a ON a.thread_id = o.thread_id AND a.lock <> o.lock AND a.step > o.s AND (o.e IS NULL OR a.step < o.e))"""
_query("dlk_01", ("sync",), f"WITH {_EDGES_SQL} SELECT * FROM edges")(locks.lock_order)
_query("dlk_02", ("sync",), f"""RECURSIVE
WITH {_EDGES_SQL}, pairs AS (SELECT DISTINCT held, taken FROM edges),
paths AS (SELECT held AS start, taken AS last, [held, taken] AS path FROM pairs WHERE taken > held UNION ALL SELECT p.start, e.taken, list_append(p.path, e.taken) FROM paths p JOIN pairs e ON e.held = p.last WHERE e.taken > p.start AND NOT list_contains(p.path, e.taken)),
cyc AS (SELECT path FROM paths p JOIN pairs e ON e.held = p.last AND e.taken = p.start),
th AS (SELECT DISTINCT path, thread_id FROM cyc, edges WHERE list_contains(path, held) AND list_contains(path, taken) AND taken = path[(list_position(path, held) % len(path)) + 1]),
st AS (SELECT path, string_agg(step, ',' ORDER BY step) AS steps FROM (SELECT DISTINCT path, aq.step FROM th JOIN aq ON aq.thread_id = th.thread_id AND list_contains(path, aq.lock)) z GROUP BY path)
SELECT array_to_string(th.path, '>') AS cycle, string_agg(thread_id, ',' ORDER BY thread_id) AS threads, md5(any_value(steps)) AS violation_steps FROM th JOIN st ON st.path = th.path GROUP BY th.path""")(
    lambda s: locks.deadlocks(s).select(_text("cycle", ">").alias("cycle"), _text("threads").alias("threads"), F.md5(_text("violation_steps").cast("binary")).alias("violation_steps"))
)

# -- scalar functions -----------------------------------------------------------------------

_query("fn_scalars", ("mem_writes",), """
SELECT step, address - address % 4096 AS page, address % 4096 AS page_offset, '0x' || lower(printf('%x', address)) AS hex_address, CASE WHEN address >= 21000 THEN address - 21000 ELSE address END AS so_offset,
  md5(CAST(address AS VARCHAR)) AS digest, sha256(CAST(address AS VARCHAR)) AS sha FROM tr_mem_writes""")(
    lambda w: w.select(
        "step", scalars.page_align(F.col("address")).alias("page"), scalars.page_offset(F.col("address")).alias("page_offset"), scalars.hex_text(F.col("address")).alias("hex_address"),
        scalars.to_so_offset(F.col("address"), 21_000).alias("so_offset"), F.md5(F.col("address").cast("string").cast("binary")).alias("digest"), F.sha2(F.col("address").cast("string").cast("binary"), 256).alias("sha"),
    )
)
_query("hold_intervals", ("sync",), f"WITH {_HOLD_SQL} SELECT lock AS sync_object_addr, thread_id, s AS start_step, e AS end_step FROM opn")(
    lambda s: kernels.hold_intervals(s).select("sync_object_addr", "thread_id", "start_step", "end_step")
)

# -- beyond the core set --------------------------------------------------------------------

_query("ext_callers", ("calls",), "SELECT caller_address, count(*) AS call_count, min(seq) AS first_step FROM tr_calls WHERE callee_address = 4208 AND event_type <> 'Return' GROUP BY 1")(
    lambda c: extras.callers(c, 4_208)
)
_query("ext_call_graph", ("calls", "functions"), f"""
WITH c AS (SELECT caller_address, callee_address, count(*) AS call_count FROM tr_calls WHERE event_type <> 'Return' GROUP BY 1, 2) SELECT c.*, {_NAME_SQL.format(a="c.callee_address")} AS func_name FROM c""")(
    extras.call_graph
)
_query("ext_memory_history", ("mem_writes",), f"SELECT * FROM tr_mem_writes WHERE address < 20680 AND address + size > 20580 AND step >= 100")(lambda w: extras.memory_history(w, 20_580, 100, start=100))
_query("ext_memory_accessors", ("mem_writes", "mem_reads"), """
SELECT thread_id, CAST(sum(w) AS BIGINT) AS n_writes, CAST(sum(1 - w) AS BIGINT) AS n_reads FROM (SELECT thread_id, 1 AS w, address, size FROM tr_mem_writes UNION ALL SELECT thread_id, 0, address, size FROM tr_mem_reads) z
WHERE address < 20680 AND address + size > 20580 GROUP BY 1""")(lambda w, r: extras.memory_accessors(w, r, 20_580, 100))
_query("ext_jni_method", ("jni",), "SELECT * FROM tr_jni WHERE java_class = 'com.example.C3' AND java_method = 'click'")(lambda j: extras.jni_by_method(j, "com.example.C3", "click"))
_query("ext_jni_callers", ("jni",), "SELECT thread_id, java_class, java_method, count(*) AS n FROM tr_jni WHERE native_address = 4256 AND direction = 'JavaToNative' GROUP BY 1, 2, 3")(lambda j: extras.jni_callers(j, 4_256))
_query("ext_function_instructions", ("instructions", "functions"), f"""
WITH i AS (SELECT seq, {_NAME_SQL.format(a="i0.address")} AS func_name FROM tr_instructions i0) SELECT func_name, count(*) AS n_instructions, min(seq) AS first_step, max(seq) AS last_step FROM i WHERE func_name IS NOT NULL GROUP BY 1""")(
    extras.instructions_of_functions
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data races of the trace."""
    return QUERIES["rac_01"](spark, sf_dir)
