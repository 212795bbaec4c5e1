"""Lookups beyond the core set: call graph, memory history, JNI by method, instructions by function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import end_of, ordered, signed
from .asof import function_names
from .lookups import between


def callers(calls: DataFrame, callee: int) -> DataFrame:
    """(caller_address, call_count, first_step): call sites of a function; returns do not count."""
    rows = calls.where((F.col("callee_address") == signed(callee)) & (F.col("event_type") != "Return"))
    return rows.groupBy("caller_address").agg(F.count(F.lit(1)).alias("call_count"), F.min("seq").alias("first_step"))


def call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_address, callee_address, call_count, func_name): edges by call site, with the callee's name."""
    edges = calls.where(F.col("event_type") != "Return").groupBy("caller_address", "callee_address").agg(F.count(F.lit(1)).alias("call_count"))
    return function_names(edges, functions, "callee_address")


def memory_history(writes: DataFrame, address: int, size: int = 1, start: int | None = None, end: int | None = None) -> DataFrame:
    """Writes that touch a range of bytes, in a range of steps."""
    own = F.col("size") if "size" in writes.columns else F.octet_length("data")
    at, low = ordered(F.col("address")), address - (1 << 63)
    return between(writes.where((at < low + size) & (end_of(at, own) > low)), "step", start, end)


def memory_accessors(writes: DataFrame, reads: DataFrame, address: int, size: int = 1) -> DataFrame:
    """(thread_id, n_writes, n_reads): threads that touch a range of bytes."""
    sides = [memory_history(t, address, size).select("thread_id", F.lit(w).alias("w")) for t, w in ((writes, 1), (reads, 0))]
    rows = sides[0].unionByName(sides[1])
    return rows.groupBy("thread_id").agg(F.sum("w").alias("n_writes"), F.sum(1 - F.col("w")).alias("n_reads"))


def jni_by_method(jni: DataFrame, java_class: str, java_method: str | None = None) -> DataFrame:
    rows = jni.where(F.col("java_class") == java_class)
    return rows if java_method is None else rows.where(F.col("java_method") == java_method)


def jni_callers(jni: DataFrame, native_address: int) -> DataFrame:
    """(thread_id, java_class, java_method, n): who crosses to a native address."""
    rows = jni.where((F.col("native_address") == signed(native_address)) & (F.col("direction") == "JavaToNative"))
    return rows.groupBy("thread_id", "java_class", "java_method").agg(F.count(F.lit(1)).alias("n"))


def instructions_of_functions(instructions: DataFrame, functions: DataFrame) -> DataFrame:
    """(func_name, n_instructions, first_step, last_step): instructions within each function."""
    named = function_names(instructions.select("seq", "address"), functions).where("func_name is not null")
    return named.groupBy("func_name").agg(F.count(F.lit(1)).alias("n_instructions"), F.min("seq").alias("first_step"), F.max("seq").alias("last_step"))
