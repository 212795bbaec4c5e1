"""A catalogue of traces and binaries on Parquet.

A trace's events lie below events/<kind>/trace_id=N/<version>. Each file is in step order, so files
overlap in steps only as far as the source's splits do, and a trace that comes in order is stored in
order without a shuffle; compact() rewrites any other. A version's files are written first; then one row in the catalogue names the versions that make up the trace. Readers
take the last row of a trace, so a failed write is never seen and rewriting is safe. Appending
adds a version and leaves the others as they are. Ids and serials follow the last ones in the
catalogue without a lock: a catalogue has one writer at a time.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

_CATALOGUE = "trace_id BIGINT, serial BIGINT, so_file_id BIGINT, source STRING, base_addr BIGINT, event_count BIGINT, versions ARRAY<STRING>, deleted BOOLEAN, created_at TIMESTAMP, events_sorted BOOLEAN"


class CountMismatch(ValueError):
    """A stream gave another number of events than was promised; nothing was published."""


class TraceStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ----------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _drop(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    # -- catalogue ------------------------------------------------------------------------

    def _catalogue(self) -> DataFrame:
        path = f"{self.root}/catalogue"
        rows = self.spark.read.schema(_CATALOGUE).parquet(path) if self._exists(path) else self.spark.createDataFrame([], _CATALOGUE)
        rest = [c for c in rows.columns if c != "trace_id"]
        return rows.groupBy("trace_id").agg(F.max_by(F.struct(*rest), "serial").alias("last")).select("trace_id", *(F.col(f"last.{c}").alias(c) for c in rest))

    def _publish(self, trace_id: int, **values) -> None:
        serial = (self._catalogue().agg(F.max("serial")).first()[0] or 0) + 1
        row = (trace_id, serial, values["so_file_id"], values["source"], values["base_addr"], values["event_count"], values["versions"], values.get("deleted", False), datetime.now(timezone.utc).replace(tzinfo=None), values.get("events_sorted", False))
        self.spark.createDataFrame([row], _CATALOGUE).coalesce(1).write.mode("append").parquet(f"{self.root}/catalogue")

    def list(self) -> DataFrame:
        """(trace_id, so_file_id, source, base_addr, event_count, events_sorted, created_at) of all traces.

        events_sorted is true where files are known to follow each other in steps, as after compact().
        """
        flag = F.coalesce("events_sorted", F.lit(False)).alias("events_sorted")
        return self._catalogue().where("not deleted").select("trace_id", "so_file_id", "source", "base_addr", "event_count", flag, "created_at")

    def summary(self, trace_id: int) -> DataFrame:
        return self.list().where(F.col("trace_id") == trace_id)

    def _entry(self, trace_id: int):
        row = self._catalogue().where((F.col("trace_id") == trace_id) & ~F.col("deleted")).first()
        if row is None:
            raise KeyError(f"no trace {trace_id}")
        return row

    # -- events ---------------------------------------------------------------------------

    def _write(self, trace_id: int, tables: dict[str, DataFrame], ranged: bool = False) -> tuple[str, int]:
        """Writes the tables at once and counts what was written; ranged: in ranges of steps that the planner sizes."""
        version = uuid.uuid4().hex
        if unknown := set(tables) - set(schemas.TABLES):
            raise KeyError(f"no event tables {sorted(unknown)}")

        def write(kind: str) -> int:
            step = schemas.STEP.get(kind, "step")
            path = f"{self.root}/events/{kind}/trace_id={trace_id}/{version}"
            rows = tables[kind].repartitionByRange(step, "ord") if ranged else tables[kind]
            rows.sortWithinPartitions(step, "ord").write.option("compression", "zstd").parquet(path)
            return self.spark.read.schema(tables[kind].schema).parquet(path).count()  # from the files' footers

        with ThreadPoolExecutor(max(1, len(tables))) as pool:
            return version, sum(pool.map(write, tables))

    def save(self, tables: dict[str, DataFrame], trace_id: int = 0, so_file_id: int = 0, source: str = "", base_addr: int = 0, expected: int | None = None) -> int:
        """Writes a trace and returns its id: the given one, whose trace it replaces, or the next free one for 0.

        With expected, a different number of events raises CountMismatch and publishes nothing.
        """
        if not trace_id:
            trace_id = (self._catalogue().agg(F.max("trace_id")).first()[0] or 0) + 1
        version, total = self._write(trace_id, tables)
        if expected is not None and total != expected:
            for kind in tables:
                self._drop(f"{self.root}/events/{kind}/trace_id={trace_id}/{version}")
            raise CountMismatch(f"{total} events instead of {expected}")
        self._publish(trace_id, so_file_id=so_file_id, source=source, base_addr=base_addr, event_count=total, versions=[version])
        return trace_id

    def append(self, trace_id: int, tables: dict[str, DataFrame]) -> int:
        """Adds events to a trace without touching what is there; returns the new number of events."""
        old = self._entry(trace_id)
        version, total = self._write(trace_id, tables)
        self._publish(trace_id, so_file_id=old.so_file_id, source=old.source, base_addr=old.base_addr, event_count=old.event_count + total, versions=[*old.versions, version])
        return old.event_count + total

    def load(self, trace_id: int) -> dict[str, DataFrame]:
        """All event tables of a trace, empty where it has no such events. Later versions follow earlier ones in ord."""
        versions = self._entry(trace_id).versions
        out = {}
        for kind, ddl in schemas.TABLES.items():
            paths = [(k, p) for k, v in enumerate(versions) if self._exists(p := f"{self.root}/events/{kind}/trace_id={trace_id}/{v}")]
            rows = self.spark.createDataFrame([], ddl) if not paths else None
            for k, path in paths:
                own = self.spark.read.parquet(path)
                own = own.withColumn("ord", F.col("ord") + (k << 48)) if k else own
                rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
            out[kind] = rows
        return out

    def compact(self, trace_id: int) -> None:
        """Rewrites a trace as one version in ranges of steps; rows stay as they are."""
        old = self._entry(trace_id)
        version, total = self._write(trace_id, {k: t for k, t in self.load(trace_id).items() if not t.isEmpty()}, ranged=True)
        self._publish(trace_id, so_file_id=old.so_file_id, source=old.source, base_addr=old.base_addr, event_count=total, versions=[version], events_sorted=True)

    def replay(self, trace_id: int) -> DataFrame:
        """(step, kind, ord, event): all events in step order, as JSON text, by kind and arrival within a step."""
        out = None
        for place, (kind, rows) in enumerate(self.load(trace_id).items()):
            own = rows.select(F.col(schemas.STEP.get(kind, "step")).alias("step"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), "ord", F.to_json(F.struct(*rows.columns)).alias("event"))
            out = own if out is None else out.unionByName(own)
        return out.orderBy("step", "place", "ord").drop("place")

    def delete(self, trace_id: int) -> None:
        old = self._entry(trace_id)
        self._publish(trace_id, so_file_id=old.so_file_id, source=old.source, base_addr=old.base_addr, event_count=0, versions=[], deleted=True)
        for kind in schemas.TABLES:
            self._drop(f"{self.root}/events/{kind}/trace_id={trace_id}")


class BinaryStore:
    """Parsed binaries, one for each content: saving a known one gives its id again."""

    _FILES = "so_file_id BIGINT, sha256 STRING, md5 STRING, path STRING, file_size BIGINT, arch STRING, build_id STRING, deleted BOOLEAN, serial BIGINT"

    def __init__(self, spark: SparkSession, root: str):
        self.traces = TraceStore(spark, root)
        self.spark, self.root = spark, f"{root.rstrip('/')}/binaries"

    def _rows(self) -> DataFrame:
        path = f"{self.root}/files"
        rows = self.spark.read.schema(self._FILES).parquet(path) if self.traces._exists(path) else self.spark.createDataFrame([], self._FILES)
        rest = [c for c in rows.columns if c != "so_file_id"]
        return rows.groupBy("so_file_id").agg(F.max_by(F.struct(*rest), "serial").alias("last")).select("so_file_id", *(F.col(f"last.{c}").alias(c) for c in rest))

    def list(self) -> DataFrame:
        return self._rows().where("not deleted").drop("deleted", "serial")

    def find(self, sha256: str) -> DataFrame:
        return self.list().where(F.col("sha256") == sha256)

    def save(self, binaries: DataFrame) -> DataFrame:
        """(so_file_id, sha256) of binaries, from elf.read_binaries; new contents get the next ids."""
        known = self.list().select("sha256", "so_file_id")
        top = self._rows().agg(F.coalesce(F.max("so_file_id"), F.lit(0)).alias("top"), F.coalesce(F.max("serial"), F.lit(0)).alias("serial")).first()
        fresh = binaries.dropDuplicates(["sha256"]).join(known, "sha256", "left_anti")
        # One row for each new file of one save.
        ids = fresh.select("sha256", "path").sort("path", "sha256").collect()
        if ids:
            given = self.spark.createDataFrame([(r.sha256, top.top + k) for k, r in enumerate(ids, 1)], "sha256 STRING, so_file_id BIGINT")
            numbered = fresh.join(given, "sha256")
            for part in ("segments", "symbols", "functions"):
                rows = numbered.select("so_file_id", F.posexplode(part).alias("id", "e")).select("so_file_id", F.col("id").cast("long").alias("id"), "e.*")
                rows.write.mode("append").parquet(f"{self.root}/{part}")
            files = numbered.select("so_file_id", "sha256", "md5", "path", "file_size", "arch", "build_id", F.lit(False).alias("deleted"), (F.col("so_file_id") - top.top + top.serial).alias("serial"))
            files.write.mode("append").parquet(f"{self.root}/files")
        return binaries.select("sha256").distinct().join(self.list().select("sha256", "so_file_id"), "sha256").select("so_file_id", "sha256")

    def load(self, so_file_id: int, part: str) -> DataFrame:
        """segments, symbols or functions of a binary."""
        return self.spark.read.parquet(f"{self.root}/{part}").where(F.col("so_file_id") == so_file_id)

    def functions(self, so_file_id: int) -> DataFrame:
        """The function table that asof.function_names takes."""
        return self.load(so_file_id, "functions").select(F.col("id").alias("ord"), "offset", "size", "name")

    def delete(self, so_file_id: int) -> None:
        serial = self._rows().agg(F.max("serial")).first()[0]
        gone = self._rows().where((F.col("so_file_id") == so_file_id) & ~F.col("deleted")).withColumns({"deleted": F.lit(True), "serial": F.lit(serial + 1).cast("long")})
        self._append(gone)

    def _append(self, rows: DataFrame) -> None:
        found = rows.select(*(f.strip().split()[0] for f in self._FILES.split(","))).collect()  # one row
        if not found:
            raise KeyError("no such binary")
        self.spark.createDataFrame(found, self._FILES).write.mode("append").parquet(f"{self.root}/files")
