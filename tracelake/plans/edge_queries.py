"""The queries whose rules tell at ties, straddles and odd kinds, over derived tables that have them.

Four events share a step, writes cross pages and the middle of the address space, addresses go up to
its top, every sync type occurs, and register masks have one or two bits. Addresses are unsigned in
the SQL and in the results, as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import unsigned
from ..operators import asof, kernels, locks, pairs, stack
from ..schemas import ACQUIRES, HOLD_RELEASES, SHARED_ACQUIRES, SIGNALS
from ..sources.testdata import view_sql, view
from .trace_queries import _FLOWS_SQL, _RACES_SQL, _sql_set

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_TYPES = (*ACQUIRES, *HOLD_RELEASES, *SIGNALS)

_CLOCK = {"step": "event_id div 4", "ord": "event_id", "thread_id": "CAST(user_id % 6 + 1 AS INT)"}
_ADDRESS = "CASE WHEN event_id % 6 < 4 THEN 3584 + (event_id * 7919) % 1024 WHEN event_id % 6 = 4 THEN (event_id * 31) % 32 - 64 ELSE (event_id % 512) * 8 + 9223372036854771712 - CASE WHEN event_id % 12 = 5 THEN 0 ELSE 8 END END"
#: Table: filter, columns. The third kind of address ends at the largest signed number, so writes there go on among the negative ones.
_TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "mem_writes": ("event_type IN ('purchase', 'click')", {**_CLOCK, "address": _ADDRESS, "size": "1 + event_id % 24"}),
    "mem_reads": ("event_type = 'view'", {**_CLOCK, "address": _ADDRESS, "size": "1 + event_id % 24"}),
    "sync": ("event_type IN ('signup', 'error')", {
        **_CLOCK, "sync_type": "CASE event_id % {n} {cases} END".format(n=len(_TYPES), cases=" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES))),
        "sync_object_addr": "40960 + (user_id % 7) * 64", "result": "CASE event_id % 13 WHEN 0 THEN 'WouldBlock' WHEN 5 THEN 'Timeout' WHEN 9 THEN 'Error' ELSE 'Success' END",
        "wait_duration_ns": "CASE WHEN event_id % 4 = 0 THEN event_id END",
    }),
    "states": ("event_id > 0", {**_CLOCK, "new_state": "CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'Runnable' WHEN 'purchase' THEN 'Blocked' WHEN 'signup' THEN 'WaitingForFutex' ELSE 'Sleeping' END"}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("calls", "threads"):
        return view(spark, sf_dir, name)
    where, columns = _TABLES[name]
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(where).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _table_sql(name: str) -> str:
    if name in ("calls", "threads"):
        return view_sql(name)
    where, columns = _TABLES[name]
    rows = ", ".join(f"{e.replace(' div ', ' // ')} AS {c}" for c, e in columns.items())
    text = f"raw_{name} AS (SELECT {rows} FROM events WHERE {where})"
    if name in ("mem_writes", "mem_reads"):
        unsigned_ = "CASE WHEN address < 0 THEN CAST(address AS HUGEINT) + 18446744073709551616 ELSE address END"
        return f"{text}, tr_{name} AS (SELECT step, min(ord) AS ord, thread_id, {unsigned_} AS address, arg_min(size, ord) AS size FROM raw_{name} GROUP BY step, thread_id, address)"
    return f"{text}, tr_{name} AS (SELECT * FROM raw_{name})"


def _query(key: str, names: tuple[str, ...], sql: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        ORACLE[key] = f"WITH {', '.join(map(_table_sql, names))}, {sql}"
        return f

    return add


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: unsigned(F.col(c)).cast("string") for c in columns})


@_query("edge_rac_01", ("mem_writes", "mem_reads", "sync", "calls"), f"""{_RACES_SQL}
SELECT CAST(address AS VARCHAR) AS address, s1 AS first_step, t1 AS first_thread, kind <> 2 AS first_is_write, z1 AS first_size, s2 AS second_step, t2 AS second_thread, kind <> 0 AS second_is_write, z2 AS second_size,
  CAST(greatest(a1, a2) AS VARCHAR) AS overlap_address, CAST(least(a1 + z1, a2 + z2) - greatest(a1, a2) AS BIGINT) AS overlap_size, round(confidence, 6) AS confidence FROM races""")
def _races(writes, reads, sync, calls):
    found = pairs.races(writes, reads, sync, calls).withColumn("confidence", F.round("confidence", 6)).drop("description")
    return _shown(found, "address", "overlap_address")


@_query("edge_flo_01", ("mem_writes", "mem_reads", "sync"), f"""{_FLOWS_SQL.replace("ORDER BY r.step, r.address)", "ORDER BY r.step, r.ord)")}
SELECT from_thread, to_thread, CAST(address AS VARCHAR) AS address, write_step, write_size, read_step, read_size, CAST(overlap_address AS VARCHAR) AS overlap_address, CAST(overlap_size AS BIGINT) AS overlap_size, is_synchronized FROM flows""")
def _flows(writes, reads, sync):
    return _shown(pairs.data_flows(writes, reads, sync), "address", "overlap_address")


_HOLDS = f"""
ev AS (SELECT sync_object_addr AS lock, thread_id, step, ord, CASE WHEN sync_type IN ({_sql_set(HOLD_RELEASES)}) THEN -1 ELSE 1 END AS d FROM tr_sync
  WHERE sync_type IN ({_sql_set(HOLD_RELEASES)}) OR (sync_type IN ({_sql_set(ACQUIRES)}) AND result = 'Success')),
su AS (SELECT *, sum(d) OVER (PARTITION BY lock, thread_id ORDER BY step, ord) AS total FROM ev),
dep AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY lock, thread_id ORDER BY step, ord)) AS depth FROM su),
pre AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY lock, thread_id ORDER BY step, ord), 0) AS was FROM dep),
opn AS (SELECT lock, thread_id, step AS s, ord AS so, (SELECT q.step FROM pre q WHERE q.lock = p.lock AND q.thread_id = p.thread_id AND q.d = -1 AND q.was = 1 AND (q.step > p.step OR (q.step = p.step AND q.ord > p.ord)) ORDER BY q.step, q.ord LIMIT 1) AS e
  FROM pre p WHERE d = 1 AND was = 0)"""


@_query("edge_holds", ("sync",), f"{_HOLDS} SELECT lock AS sync_object_addr, thread_id, s AS start_step, so AS start_ord, e AS end_step FROM opn")
def _holds(sync):
    return kernels.hold_intervals(sync).drop("end_ord")


@_query("edge_stk_03", ("sync",), f"{_HOLDS} SELECT lock AS sync_object_addr, thread_id, arg_max(depth, ord) > 0 AS held FROM dep WHERE step <= 200 GROUP BY lock, thread_id")
def _held(sync):
    return stack.locks_held(sync, 200)


@_query("edge_dlk_01", ("sync",), f"""{_HOLDS},
ex AS (SELECT DISTINCT sync_object_addr AS lock FROM tr_sync WHERE sync_type IN ({_sql_set(t for t in ACQUIRES if t not in SHARED_ACQUIRES)})),
aq AS (SELECT thread_id, sync_object_addr AS lock, step, ord FROM tr_sync WHERE sync_type IN ({_sql_set(ACQUIRES)}) AND result = 'Success' AND sync_object_addr IN (SELECT lock FROM ex))
SELECT DISTINCT o.lock AS held, a.lock AS taken, a.thread_id FROM opn o JOIN aq a ON a.thread_id = o.thread_id AND a.lock <> o.lock AND (a.step > o.s OR (a.step = o.s AND a.ord > o.so)) AND (o.e IS NULL OR a.step < o.e)""")
def _order(sync):
    return locks.lock_order(sync)


@_query("edge_sta_02", ("states",), "z AS (SELECT 1) SELECT thread_id, arg_max(new_state, ord) AS state FROM tr_states GROUP BY thread_id")
def _states(states):
    return asof.thread_states(states.sparkSession.createDataFrame([], "thread_id int, exit_step long"), states)


_MEMORY = (4_080, 64, 200)


@_query("edge_mem_01", ("mem_writes",), f"""
one AS (SELECT step, ord, CASE WHEN address < 0 THEN CAST(address AS HUGEINT) + 18446744073709551616 ELSE address END AS address, size FROM raw_mem_writes WHERE step <= {_MEMORY[2]}),
bytes AS (SELECT ord, address + i AS pos, (step + i) % 256 AS byte FROM one, range(24) r(i) WHERE i < size),
cell AS (SELECT a, coalesce((SELECT byte FROM bytes WHERE pos = a ORDER BY ord DESC LIMIT 1), 0) AS byte FROM range({_MEMORY[0]}, {_MEMORY[0] + _MEMORY[1]}) t(a))
SELECT CAST({_MEMORY[0]} AS BIGINT) AS address, CAST(0 AS BIGINT) AS page_address, string_agg(lower(printf('%02x', byte)), '' ORDER BY a) AS value,
  (SELECT CAST(count(*) FILTER (address < 4096) + count(*) FILTER (address < 8192 AND address + size > 4096) AS BIGINT) FROM one) AS deltas_applied FROM cell""")
def _memory(writes):
    digits = F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: F.lpad(F.hex((F.col("step") + i) % 256), 2, "0"))
    return asof.memory_at(writes.withColumn("data", F.unhex(F.array_join(digits, ""))), *_MEMORY)


def _registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of one or two bits, sometimes with a value too few; four deltas share a step."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bit = "shiftleft(1L, cast(o_custkey % 34 as int))"
    deltas = orders.selectExpr(
        "o_orderkey div 4 as seq", "o_orderkey as ord", f"{bit} | shiftleft(1L, cast(o_orderkey % 34 as int)) as change_mask",
        "if(o_orderkey % 9 = 0, array(o_orderkey), array(o_orderkey, o_custkey * 5)) as values",
    )
    return asof.register_state(asof.register_writes(deltas), 300)


QUERIES["edge_reg_03"] = _registers
ORACLE["edge_reg_03"] = """
WITH d AS (SELECT o_orderkey // 4 AS seq, o_orderkey AS ord, o_custkey % 34 AS a, o_orderkey % 34 AS b, o_orderkey AS v1, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey * 5 END AS v2 FROM orders WHERE o_orderkey // 4 <= 300),
w AS (SELECT seq, ord, least(a, b) AS r, v1 AS v FROM d UNION ALL SELECT seq, ord, greatest(a, b), v2 FROM d WHERE a <> b),
l AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY seq DESC, ord DESC) AS k FROM w)
SELECT CAST(i AS INTEGER) AS register_id, CAST(coalesce(CASE WHEN i = 33 THEN v % 4294967296 ELSE v END, 0) AS BIGINT) AS value FROM range(34) t(i) LEFT JOIN l ON l.r = i AND l.k = 1"""
