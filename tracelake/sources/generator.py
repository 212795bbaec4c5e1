"""A made-up trace of any length, for benchmarks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND = 32
BRANCH_SLOT, REGISTER_SLOT = 20, 15


def mixed_trace(spark: SparkSession, rounds: int, threads: int = 4) -> dict[str, DataFrame]:
    """Rounds of 32 instructions, each by one thread in turn: a branch in slot 20, a change of registers
    x0 and x5 in slot 15, and an 8-byte write at the end of every third round. The same for equal arguments."""
    rows = spark.range(rounds * ROUND).select(F.col("id").alias("seq"), F.expr(f"id div {ROUND}").alias("round"), (F.col("id") % ROUND).alias("slot"))
    rows = rows.withColumn("thread_id", F.col("round") % threads + 1)
    branch = F.col("slot") == BRANCH_SLOT
    instructions = rows.select(
        F.col("seq").alias("ord"), "seq", "thread_id", (0x1000 + F.col("round") % 64 * ROUND * 4 + F.col("slot") * 4).alias("address"), F.lit(None).cast("long").alias("timestamp"),
        branch.alias("is_branch"), (branch & (F.col("round") % 2 == 0)).alias("branch_taken"), F.lit(None).cast("binary").alias("opcode"),
    )
    registers = rows.where(F.col("slot") == REGISTER_SLOT).select(F.col("seq").alias("ord"), "seq", F.lit(0x21).cast("long").alias("change_mask"), F.array("seq", "round").alias("values"))
    data = F.unhex(F.lpad(F.hex("seq"), 16, "0"))
    writes = rows.where((F.col("slot") == ROUND - 1) & (F.col("round") % 3 == 0)).select(
        F.col("seq").alias("ord"), F.col("seq").alias("step"), "thread_id", (0x8000 + F.col("round") % 512 * 8).alias("address"), data.alias("data")
    )
    return {"instructions": instructions, "register_deltas": registers, "memory_writes": writes}
