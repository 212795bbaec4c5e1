"""The native JSON envelope: one object with an array for each kind of event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalars import unsigned, wrapped

#: Arrays whose elements hold bytes as a list of numbers.
_BYTES = {"instructions": "opcode", "memory_writes": "data"}


def _wide(column: str, kind: str) -> str:
    """The type by which an envelope's numbers are read, so that all unsigned ones of 64 bits fit."""
    return "ARRAY<DECIMAL(20,0)>" if column == "values" else "DECIMAL(20,0)" if column in schemas.UNSIGNED else kind


def _element(name: str) -> str:
    fields = [f.strip().split(" ", 1) for f in schemas.TABLES[name].split(", ")]
    own = [f"{n}: {'ARRAY<SMALLINT>' if _BYTES.get(name) == n else _wide(n, t)}" for n, t in fields if n != "ord"]
    return f"ARRAY<STRUCT<{', '.join(own)}>>"


def schema() -> str:
    return "trace_id BIGINT, so_file_id BIGINT, " + ", ".join(f"{n} {_element(n)}" for n in schemas.TABLES)


def read_envelope(spark: SparkSession, path: str, http: bool = False) -> dict[str, DataFrame]:
    """Event tables of an envelope file.

    Missing arrays are empty. A read without size has size 1; by http the field is required, as is
    trace_id. A memory access without step, thread or address raises an error; a write without data
    has none. ord is the place in the array.
    """
    whole = spark.read.schema(schema()).option("mode", "FAILFAST").json(path, multiLine=True)
    return {name: _exploded(whole, name, http) for name in schemas.TABLES}


def _exploded(whole: DataFrame, name: str, http: bool) -> DataFrame:
    if http:
        whole = whole.where(F.coalesce(F.col("trace_id").isNotNull(), F.lit(False)) | F.raise_error(F.lit("trace_id is missing")).cast("boolean"))
    rows = whole.select(F.posexplode(name).alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")
    needed = {"memory_writes": ["step", "thread_id", "address"], "memory_reads": ["step", "thread_id", "address", *(["size"] if http else [])]}.get(name, [])
    for column in needed:
        rows = rows.withColumn(column, F.coalesce(column, F.raise_error(F.lit(f"{name} without {column}")).cast(rows.schema[column].dataType)))
    if name == "memory_reads":
        rows = rows.withColumn("size", F.coalesce("size", F.lit(1)))
    if name in _BYTES:
        digits = F.unhex(F.array_join(F.transform(_BYTES[name], lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))
        rows = rows.withColumn(_BYTES[name], F.coalesce(digits, F.unhex(F.lit(""))) if name == "memory_writes" else digits)
    fields = [f.strip().split(" ", 1) for f in schemas.TABLES[name].split(", ")]
    value = {n: wrapped(F.col(n)) if n in schemas.UNSIGNED else F.transform(n, wrapped) if n == "values" else F.col(n) for n, _ in fields}
    return rows.select(*(value[n].cast(t.lower()).alias(n) for n, t in fields))


def to_envelope(tables: dict[str, DataFrame], trace_id: int) -> DataFrame:
    """One row with an envelope's arrays, for writing as JSON; for traces that one row can hold."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select(F.lit(trace_id).cast("long").alias("trace_id"))
    for name, rows in tables.items():
        columns = [c for c in rows.columns if c != "ord"]
        if name in _BYTES:
            digits = F.transform(F.sequence(F.lit(1), F.octet_length(_BYTES[name])), lambda i: F.conv(F.substring(F.hex(_BYTES[name]), i * 2 - 1, F.lit(2)), 16, 10).cast("int"))
            rows = rows.withColumn(_BYTES[name], F.when(F.octet_length(_BYTES[name]) > 0, digits).otherwise(F.array().cast("array<int>")))
        plain = [c for c in columns if c in schemas.UNSIGNED]
        rows = rows.withColumns({c: unsigned(F.col(c)) for c in plain} | ({"values": F.transform("values", unsigned)} if "values" in columns else {}))
        array = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("e")))) if name not in _BYTES else F.sort_array(F.collect_list(F.struct("ord", F.struct(*columns).alias("e")))), lambda x: x["e"]).alias(name))
        out = out.join(F.broadcast(array))
    return out
