"""Schemas of the trace tables, and what is fixed about their enumerations.

A trace is one table for each kind of event. Steps are a caller's clock: neither unique nor in
order, so `ord`, the arrival ordinal, breaks ties and (step, ord) is the total order. Addresses
are unsigned 64-bit numbers; they, register values and masks are BIGINT columns of the same 64
bits, so one of 2^63 or more is negative there. Operators compare them as unsigned, take them as
unsigned arguments, and scalars.unsigned() shows them so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = (1 << 64) - 1
PAGE = 4096
REGISTERS = 34  # x0-x30, SP, PC, NZCV

THREADS = (
    "ord BIGINT, thread_id BIGINT, pthread_id BIGINT, parent_thread_id BIGINT, create_step BIGINT, exit_step BIGINT, name STRING, "
    "stack_base BIGINT, stack_size BIGINT, tls_addr BIGINT, is_jni_attached BOOLEAN"
)
INSTRUCTIONS = "ord BIGINT, seq BIGINT, thread_id BIGINT, address BIGINT, timestamp BIGINT, is_branch BOOLEAN, branch_taken BOOLEAN, opcode BINARY"
REGISTER_DELTAS = "ord BIGINT, seq BIGINT, change_mask BIGINT, values ARRAY<BIGINT>"
CALLS = (
    "ord BIGINT, id BIGINT, thread_id BIGINT, event_type STRING, caller_address BIGINT, callee_address BIGINT, callee_func_id BIGINT, seq BIGINT, "
    "depth INT, return_seq BIGINT"
)
MEMORY_WRITES = "ord BIGINT, step BIGINT, thread_id BIGINT, address BIGINT, data BINARY"
MEMORY_READS = "ord BIGINT, step BIGINT, thread_id BIGINT, address BIGINT, size BIGINT"
SYNC_EVENTS = "ord BIGINT, step BIGINT, thread_id BIGINT, sync_type STRING, sync_object_addr BIGINT, result STRING, wait_duration_ns BIGINT"
CONTEXT_SWITCHES = "ord BIGINT, step BIGINT, from_thread BIGINT, to_thread BIGINT, switch_reason STRING, cpu_core BIGINT"
STATE_CHANGES = "ord BIGINT, step BIGINT, thread_id BIGINT, new_state STRING, prev_state STRING, prev_running_thread BIGINT"
JNI_CALLS = (
    "ord BIGINT, id BIGINT, seq BIGINT, thread_id BIGINT, direction STRING, java_class STRING, java_method STRING, java_signature STRING, "
    "native_func_id BIGINT, native_address BIGINT, jni_env_address BIGINT"
)
FUNCTIONS = "ord BIGINT, offset BIGINT, size BIGINT, name STRING"

#: Columns that hold 64 unsigned bits.
UNSIGNED = {
    "address", "caller_address", "callee_address", "sync_object_addr", "native_address", "jni_env_address", "stack_base", "stack_size", "tls_addr", "pthread_id", "change_mask", "offset",
}

#: Event tables in the order in which an envelope's arrays arrive.
TABLES = {
    "threads": THREADS,
    "instructions": INSTRUCTIONS,
    "register_deltas": REGISTER_DELTAS,
    "calls": CALLS,
    "memory_writes": MEMORY_WRITES,
    "memory_reads": MEMORY_READS,
    "sync_events": SYNC_EVENTS,
    "context_switches": CONTEXT_SWITCHES,
    "state_changes": STATE_CHANGES,
    "jni_calls": JNI_CALLS,
}
#: Column that holds an event's step.
STEP = {"threads": "create_step", "instructions": "seq", "register_deltas": "seq", "calls": "seq", "jni_calls": "seq"}

# The sync types and what each counts as.
ACQUIRES = ("MutexLock", "MutexLocked", "MutexTryLock", "RwLockRead", "RwLockWrite", "SemWait", "FutexWait")
HOLD_RELEASES = ("MutexUnlock", "RwLockUnlock", "SemPost", "FutexWake")
SIGNALS = ("CondvarWait", "CondvarSignal", "CondvarBroadcast", "BarrierWait", "FutexWakeCount")
RELEASES = ("MutexUnlock", "FutexWake", "FutexWakeCount", "CondvarSignal", "CondvarBroadcast", "RwLockUnlock", "SemPost")
SHARED_ACQUIRES = ("RwLockRead",)
PRIMITIVES = ("Mutex", "RwLock", "Sem", "Futex", "Condvar", "Barrier")
WAITING_STATES = ("Blocked", "WaitingForLock", "WaitingForFutex", "WaitingForCondvar", "WaitingForIO")
VOLUNTARY = ("Yield", "Blocking")
INVOLUNTARY = ("Preemption", "TimeSliceExpired", "Interrupt")


def primitive_kind(sync_type: Column) -> Column:
    """The primitive that a sync type belongs to: Mutex, RwLock, Semaphore, Futex, Condvar or Barrier."""
    out = F.lit(None).cast("string")
    for name in PRIMITIVES:
        out = F.when(sync_type.startswith(name), "Semaphore" if name == "Sem" else name).otherwise(out)
    return out


def is_contended(result: Column, wait: Column) -> Column:
    """Whether an acquire met contention: it waited, or did not get the lock at once."""
    return (F.coalesce(wait, F.lit(0)) > 0) | result.isin("WouldBlock", "Timeout")
