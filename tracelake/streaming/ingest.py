"""Append-only ingestion of event lines on Structured Streaming.

Producers drop files of JSON lines into a folder, an event a line with its kind in the field kind
and the table's columns as fields. Micro-batches route lines to a table for each kind. Late and
unordered events are kept: nothing is dropped by event time, and order is restored when reading.
A batch writes to a path of its own number, so repeating one after a failure replaces it and
every event is stored exactly once. Lines that are no JSON object are kept apart and counted; an
event of an unknown kind ends ingestion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Kinds of lines that are no JSON, and of objects without a kind.
MALFORMED, NAMELESS = "-malformed", "-nameless"
_COUNTS = "stored BIGINT, malformed BIGINT"
_BYTES = {"instructions": "opcode", "memory_writes": "data"}


@dataclass(frozen=True)
class Status:
    """Counts of events: offered, answered by queries, and safely stored; durable <= queryable <= accepted.

    queued are files that no batch has taken yet, in_flight says whether a batch is at work, malformed
    counts lines that are no event.
    """

    accepted: int
    queryable: int
    durable: int
    error: str | None = None
    queued: int = 0
    in_flight: bool = False
    malformed: int = 0


def _typed(lines: DataFrame, kind: str) -> DataFrame:
    ddl = schemas.TABLES[kind]
    own = _BYTES.get(kind)
    read = ddl.replace(f"{own} BINARY", f"{own} STRING") if own else ddl
    rows = lines.select(F.from_json("value", read).alias("e"), "arrival").select("e.*", "arrival")
    if own:  # bytes are written in hex
        rows = rows.withColumn(own, F.unhex(F.coalesce(own, F.lit("")) if kind == "memory_writes" else F.col(own)))
    return rows.withColumn("ord", F.coalesce("ord", "arrival")).drop("arrival")


class TraceIngest:
    """A running ingestion from inbox to root. continuous: keep going; otherwise take what is there and end."""

    def __init__(self, spark: SparkSession, inbox: str, root: str, continuous: bool = False, files_per_batch: int = 1000):
        self.spark, self.inbox, self.root = spark, inbox, root.rstrip("/")
        stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(inbox)
        writer = stream.writeStream.foreachBatch(self._store).option("checkpointLocation", f"{self.root}/progress")
        self.query = (writer.trigger(processingTime="1 second") if continuous else writer.trigger(availableNow=True)).start()

    def _path(self, part: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _store(self, batch: DataFrame, number: int) -> None:
        """Writes a batch's lines once, by kind, then a table for each kind from there, and last its counts.

        Arrival is the batch, the line's partition and its place there, 20, 20 and 23 bits of one number.
        """
        row = F.monotonically_increasing_id()
        arrival = F.shiftleft(F.lit(number).cast("long"), 43) + F.shiftleft(F.shiftright(row, 33), 23) + (row.bitwiseAND(F.lit((1 << 33) - 1)))
        kind = F.coalesce(F.get_json_object("value", "$.kind"), F.when(F.try_parse_json("value").isNull(), MALFORMED).otherwise(NAMELESS))
        lines = batch.where("trim(value) <> ''").select("value", arrival.alias("arrival"), kind.alias("kind"))
        staged = f"{self.root}/staged/batch={number}"
        lines.write.mode("overwrite").partitionBy("kind").parquet(staged)
        held = self.spark.read.schema("value STRING, arrival BIGINT, kind STRING").parquet(staged)
        counts = {r["kind"]: r["count"] for r in held.groupBy("kind").count().collect()}  # a row for each kind
        for kind in counts:
            if kind not in schemas.TABLES and kind != MALFORMED:
                raise ValueError("an event without a kind" if kind == NAMELESS else f"an event of unknown kind {kind}")
        for kind in counts:
            own = held.where(F.col("kind") == kind)
            (own.select("value", "arrival") if kind == MALFORMED else _typed(own, kind)).write.mode("overwrite").parquet(f"{self.root}/events/{kind}/batch={number}")
        stored = sum(n for kind, n in counts.items() if kind != MALFORMED)
        told = self.spark.createDataFrame([(stored, counts.get(MALFORMED, 0))], _COUNTS)
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/batch={number}")
        fs, where = self._path(staged)
        fs.delete(where, True)

    def status(self) -> Status:
        """Counts of all batches so far, of earlier runs too, from the small file that each batch writes last."""
        fs, where = self._path(f"{self.root}/counts")
        total = self.spark.read.schema(_COUNTS).parquet(str(where)).agg(F.sum("stored"), F.sum("malformed")).first() if fs.exists(where) else (0, 0)
        done, malformed = (total[0] or 0, total[1] or 0)
        failed, progress = self.query.exception(), self.query.lastProgress
        busy = self.query.isActive and self.query.status["isTriggerActive"]
        queued = int(progress["sources"][0].get("metrics", {}).get("numFilesOutstanding", 0)) if progress and progress["sources"] else 0
        # A batch at work has been accepted, though its lines are counted only when it is stored.
        return Status(done, done, done, str(failed) if failed else None, queued, bool(busy), malformed)

    def drain(self, seconds: float | None = None) -> Status:
        """Waits until what was offered is stored. The first error ends ingestion and is raised here and after."""
        if self.query.isActive:
            self.query.processAllAvailable()
        else:
            self.query.awaitTermination(seconds)
        if self.query.exception():
            raise self.query.exception()
        return self.status()

    def stop(self) -> None:
        self.query.stop()


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The event tables that ingestion has stored so far."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for kind, ddl in schemas.TABLES.items():
        where = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/events/{kind}")
        stored = where.getFileSystem(conf).exists(where)
        out[kind] = spark.read.schema(ddl).parquet(f"{root.rstrip('/')}/events/{kind}") if stored else spark.createDataFrame([], ddl)
    return out
