"""What the operators share: reading tables, written intermediates and components of a link graph."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own; a cluster session is refused, as a local folder would lose files there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("tracelake.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tracelake-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("tracelake.shared.dir", f"file://{own}")
    return f"file://{own}"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracelake/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session has materialized; results that read them must have been written."""
    _delete(spark, _session_dir(spark))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df below the shared folder and returns the table read back.

    This cuts the lineage: what follows reads files, so a lost executor costs only its tasks,
    and values that a rerun could assign differently (block numbers) are fixed.
    """
    spark = df.sparkSession
    reachable(spark)
    path = f"{_session_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelake_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any longer."""
    _delete(df.sparkSession, df._tracelake_path)


def sheltered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... so that no name of theirs meets one of ours."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def give_back() -> None:
    """Returns freed memory of this Python worker to the system, as an idle worker keeps what it has."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def total_chars(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(node, parent))")).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating star contraction.

    edges has long columns a and b. Returns (node, root): every node that has a link to another
    node, with the smallest node of its component. Each round keeps at most as many links as it
    got, is written to the shared folder and replaces the one before; the number of rounds grows
    with the logarithm of the longest path. A hub's links are joined to its minimum, which a
    partial aggregate finds, so no task has to hold them together.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct(),
        "links",
    )
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("parent").alias("node"), F.col("node").alias("parent")))
        low = both.groupBy("node").agg(F.min("parent").alias("low")).select(F.col("node").alias("n"), F.least("node", "low").alias("low"))
        large = (
            both.join(low, F.col("node") == F.col("n")).where("parent > node").select(F.col("parent").alias("node"), F.col("low").alias("parent")).distinct()
        )
        least = large.groupBy("node").agg(F.min("parent").alias("low")).select(F.col("node").alias("n"), "low")
        small = (
            large.join(least, F.col("node") == F.col("n"))
            .select(F.explode(F.array(F.struct("node", F.col("low").alias("parent")), F.struct(F.col("parent").alias("node"), F.col("low").alias("parent")))).alias("e"))
            .select("e.node", "e.parent")
            .where("node > parent")
            .distinct()
        )
        after = materialize(small, "links")
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            return now.select("node", F.col("parent").alias("root"))
