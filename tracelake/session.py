"""The facade: a trace's tables and a method for each query over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import asof, locks, lookups, pairs, stack, stats
from .store import TraceStore


class TraceSession:
    """Queries over one trace. tables has event tables by name; functions is (ord, offset, size, name).

    Every method gives a lazy DataFrame.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], functions: DataFrame | None = None):
        self.spark = spark
        self.tables = {n: tables[n] if n in tables else spark.createDataFrame([], ddl) for n, ddl in schemas.TABLES.items()}
        self.functions = functions if functions is not None else spark.createDataFrame([], schemas.FUNCTIONS)

    @classmethod
    def load(cls, store: TraceStore, trace_id: int, functions: DataFrame | None = None) -> TraceSession:
        return cls(store.spark, store.load(trace_id), functions)

    def __getattr__(self, name: str) -> DataFrame:
        if name in schemas.TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def register_views(self, prefix: str = "") -> None:
        """Makes the tables, and functions, views of Spark SQL."""
        for name, rows in {**self.tables, "functions": self.functions}.items():
            rows.createOrReplaceTempView(prefix + name)

    # -- events ---------------------------------------------------------------------------

    def instruction(self, step: int) -> DataFrame:
        return lookups.instruction_at(self.instructions, step)

    def find_instructions(self, **conditions) -> DataFrame:
        return lookups.find_instructions(self.instructions, **conditions)

    def steps_at_address(self, address: int) -> DataFrame:
        return lookups.steps_by_address(self.instructions, address)

    def steps_of_thread(self, thread_id: int) -> DataFrame:
        return lookups.steps_by_thread(self.instructions, thread_id)

    def threads_at_address(self, address: int) -> DataFrame:
        return lookups.threads_at_address(self.instructions, address)

    def call_events(self, **conditions) -> DataFrame:
        return lookups.call_events(self.calls, **conditions)

    def jni_by_address(self, address: int, start: int | None = None, end: int | None = None) -> DataFrame:
        return lookups.jni_by_address(self.jni_calls, address, start, end)

    def jni_range(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return lookups.jni_range(self.jni_calls, start, end)

    def find_sync(self, **conditions) -> DataFrame:
        return lookups.find_sync(self.sync_events, self.tables["threads"], **conditions)

    def last_sync_access(self, lock: int, step: int) -> DataFrame:
        return lookups.last_sync_access(self.sync_events, lock, step)

    def switches(self, **conditions) -> DataFrame:
        return lookups.context_switches(self.context_switches, **conditions)

    def thread_list(self) -> DataFrame:
        return lookups.registered(self.tables["threads"])

    def thread(self, thread_id: int, step: int | None = None) -> DataFrame:
        """A thread's registration, its state at a step if one is given, and its counters."""
        info = lookups.thread_info(self.tables["threads"], thread_id).join(self.thread_stats(), "thread_id", "left")
        return info if step is None else info.join(asof.thread_state(self.state_changes, thread_id, step).select("thread_id", "new_state"), "thread_id", "left")

    # -- at a step ------------------------------------------------------------------------

    @cached_property
    def register_writes(self) -> DataFrame:
        return asof.register_writes(self.register_deltas)

    def register(self, register: int, step: int) -> DataFrame:
        return asof.register_at(self.register_writes, register, step)

    def register_history(self, register: int, start: int | None = None, end: int | None = None) -> DataFrame:
        return asof.register_history(self.register_writes, register, start, end)

    def register_state(self, step: int) -> DataFrame:
        return asof.register_state(self.register_writes, step)

    def memory(self, address: int, size: int, step: int) -> DataFrame:
        return asof.memory_at(self.memory_writes, address, size, step)

    def page(self, page: int, step: int) -> DataFrame:
        return asof.page_at(self.memory_writes, page, step)

    def current_page(self, page: int) -> DataFrame:
        return asof.page_at(self.memory_writes, page, (1 << 63) - 1)

    def snapshot(self, step: int) -> DataFrame:
        writes = self.memory_writes.withColumn("size", F.octet_length("data").cast("long"))
        return asof.step_snapshot(self.instructions, self.register_writes, writes, step)

    def thread_state(self, thread_id: int, step: int) -> DataFrame:
        return asof.thread_state(self.state_changes, thread_id, step)

    def current_thread(self) -> DataFrame:
        return asof.current_thread(self.state_changes, self.context_switches)

    def thread_states(self) -> DataFrame:
        return asof.thread_states(self.tables["threads"], self.state_changes)

    def timeline(self) -> DataFrame:
        return asof.timeline(self.tables)

    def find_timeline(self, **conditions) -> DataFrame:
        return asof.find_timeline(self.timeline(), self.calls, **conditions)

    def thread_timeline(self, thread_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
        return asof.thread_timeline(self.state_changes, self.sync_events, self.context_switches, thread_id, start, end)

    def function_names(self, probes: DataFrame, address: str = "address") -> DataFrame:
        return asof.function_names(probes, self.functions, address)

    def call_stack(self, thread_id: int, step: int) -> DataFrame:
        return stack.call_stacks(self.calls, step, thread_id)

    def is_lock_held(self, thread_id: int, lock: int, step: int) -> DataFrame:
        return stack.is_lock_held(self.sync_events, thread_id, lock, step)

    # -- analyses -------------------------------------------------------------------------

    def hot_paths(self, top: int | None = None) -> DataFrame:
        return stats.hot_paths(self.instructions, top)

    def branch_stats(self) -> DataFrame:
        return stats.branch_stats(self.instructions)

    def thread_stats(self) -> DataFrame:
        return stats.thread_stats(self.tables["threads"], self.state_changes, self.context_switches, self.sync_events)

    def event_counts(self) -> DataFrame:
        return stats.event_counts(self.tables)

    def races(self) -> DataFrame:
        return pairs.races(self.memory_writes, self.memory_reads, self.sync_events, self.calls)

    def data_flows(self) -> DataFrame:
        return pairs.data_flows(self.memory_writes, self.memory_reads, self.sync_events)

    def producer_consumer(self) -> DataFrame:
        return pairs.producer_consumer(self.data_flows(), stats.sync_mechanisms(self.sync_events))

    def deadlocks(self) -> DataFrame:
        return locks.deadlocks(self.sync_events)

    def analyses(self) -> dict[str, DataFrame]:
        """The twelve thread analyses by name."""
        threads, sync = self.tables["threads"], self.sync_events
        return {
            "races": self.races(),
            "deadlocks": self.deadlocks(),
            "contentions": stats.lock_contention(sync),
            "safety": stats.function_safety(self.calls, sync, self.races()),
            "function-assoc": stats.thread_functions(self.calls, self.functions),
            "data-flows": self.data_flows(),
            "producer-consumer": self.producer_consumer(),
            "scheduling": stats.scheduling(self.context_switches),
            "lifecycle": stats.thread_lifecycle(threads),
            "thread-states": stats.state_residency(threads, self.state_changes),
            "critical-sections": stats.critical_sections(sync),
            "jni-boundary": stats.jni_boundary(threads, self.jni_calls, self.functions),
        }
