import json
import time

import pytest

from tracelake.operators import lookups
from tracelake.session import TraceSession
from tracelake.sources import elf, testdata
from tracelake.store import BinaryStore, CountMismatch, TraceStore
from tracelake.streaming import ingest
from tests.test_sources import small_elf


def events(spark, *steps, thread=1):
    return {"instructions": spark.createDataFrame([(k, s, thread, 64 + s) for k, s in enumerate(steps)], "ord long, seq long, thread_id long, address long")}


def test_traces(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path))
    assert store.list().count() == 0
    one = store.save(events(spark, 5, 1, 3), source="test")
    two = store.save(events(spark, 9), trace_id=7)
    assert (one, two, store.save(events(spark, 1))) == (1, 7, 8)
    assert store.append(one, events(spark, 3, 2)) == 5
    rows = store.load(one)["instructions"].orderBy("seq", "ord").collect()
    assert [r.seq for r in rows] == [1, 2, 3, 3, 5] and lookups.instruction_at(store.load(one)["instructions"], 3).first().ord >= 1 << 48
    assert [r.step for r in store.replay(one).collect()] == [1, 2, 3, 3, 5]
    assert store.summary(one).first().event_count == 5
    before = [tuple(r) for r in store.replay(one).collect()]
    store.compact(one)
    assert store.summary(one).first().events_sorted and not store.summary(two).first().events_sorted
    assert [tuple(r) for r in store.replay(one).collect()] == before and store.summary(one).first().event_count == 5
    store.save(events(spark, 4), trace_id=one)
    assert [r.seq for r in store.load(one)["instructions"].collect()] == [4]
    store.delete(two)
    assert sorted(r.trace_id for r in store.list().collect()) == [1, 8]
    with pytest.raises(KeyError):
        store.load(two)
    with pytest.raises(CountMismatch):
        store.save(events(spark, 1, 2), trace_id=one, expected=3)
    assert [r.seq for r in store.load(one)["instructions"].collect()] == [4]


def test_binaries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.so").write_bytes(small_elf(True))
    (tmp_path / "in/b.so").write_bytes(small_elf(False))
    (tmp_path / "in/c.so").write_bytes(small_elf(True))
    store, files = BinaryStore(spark, str(tmp_path / "out")), elf.read_binaries(spark, str(tmp_path / "in"))
    ids = {r.sha256: r.so_file_id for r in store.save(files).collect()}
    assert sorted(ids.values()) == [1, 2] and {r.sha256: r.so_file_id for r in store.save(files).collect()} == ids
    assert sum(store.functions(k).count() for k in (1, 2)) == 3
    store.delete(1)
    assert [r.so_file_id for r in store.list().collect()] == [2]
    assert sorted(r.so_file_id for r in store.save(files).collect()) == [2, 3]


def test_session(spark, sf_dir):
    tables = {
        "instructions": testdata.view(spark, sf_dir, "instructions"), "calls": testdata.view(spark, sf_dir, "calls"), "memory_writes": testdata.view(spark, sf_dir, "mem_writes"),
        "memory_reads": testdata.view(spark, sf_dir, "mem_reads"), "sync_events": testdata.view(spark, sf_dir, "sync"), "context_switches": testdata.view(spark, sf_dir, "switches"),
        "state_changes": testdata.view(spark, sf_dir, "states"), "jni_calls": testdata.view(spark, sf_dir, "jni"), "threads": testdata.view(spark, sf_dir, "threads"),
    }
    session = TraceSession(spark, tables, testdata.view(spark, sf_dir, "functions"))
    found = session.analyses()
    assert len(found) == 12
    for name in ("races", "contentions", "critical-sections", "lifecycle", "thread-states", "scheduling", "jni-boundary", "function-assoc"):
        assert found[name].count() > 0, name
    session.register_views("t_")
    assert spark.sql("select count(*) from t_instructions").first()[0] == tables["instructions"].count()
    assert session.thread(3, 500).count() == 1 and session.hot_paths(3).count() == 3


def line(kind, **fields):
    return json.dumps({"kind": kind, **fields})


def test_ingest(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "1.jsonl").write_text("\n".join([line("instructions", seq=5, thread_id=1, address=9), line("memory_writes", step=2, thread_id=1, address=4, data="ff00"), "", line("instructions", seq=1, thread_id=1, address=8)]))
    run = ingest.TraceIngest(spark, str(inbox), root)
    status = run.drain()
    assert status.durable <= status.queryable <= status.accepted
    (inbox / "2.jsonl").write_text(line("instructions", seq=3, thread_id=2, address=7))
    ingest.TraceIngest(spark, str(inbox), root).drain()
    got = ingest.load(spark, root)
    assert [r.seq for r in got["instructions"].orderBy("seq").collect()] == [1, 3, 5]  # late events are kept
    assert bytes(got["memory_writes"].first().data) == b"\xff\x00" and got["calls"].count() == 0
    (inbox / "3.jsonl").write_text(line("nonsense", seq=3))
    bad = ingest.TraceIngest(spark, str(inbox), root)
    for _ in range(2):  # the error stays
        with pytest.raises(Exception, match="unknown kind"):
            bad.drain()
    assert bad.status().error


def test_ingest_counts_beyond_what_progress_keeps(spark, tmp_path):
    """More batches than a query remembers, lines that are no event, and a second run that goes on counting."""
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    keep = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for k in range(5):
            (inbox / f"{k}.jsonl").write_text(line("memory_reads", step=k, thread_id=1, address=9, size=4) + "\nnot json\n" * (k == 1))
        status = ingest.TraceIngest(spark, str(inbox), root, files_per_batch=1).drain()
        assert (status.accepted, status.durable, status.malformed, status.queued, status.in_flight) == (5, 5, 1, 0, False)
        (inbox / "9.jsonl").write_text(line("memory_reads", step=9, thread_id=1, address=9, size=4))
        assert ingest.TraceIngest(spark, str(inbox), root).drain().durable == 6
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", keep)
    rows = ingest.load(spark, root)["memory_reads"].collect()
    assert sorted(r.step for r in rows) == [0, 1, 2, 3, 4, 9] and len({r.ord for r in rows}) == 6


def test_continuous_ingest(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    run = ingest.TraceIngest(spark, str(inbox), root, continuous=True)
    (inbox / "1.jsonl").write_text(line("memory_reads", step=5, thread_id=1, address=9, size=4))
    for _ in range(60):
        run.drain()
        if ingest.load(spark, root)["memory_reads"].count():
            break
        time.sleep(0.5)
    run.stop()
    assert ingest.load(spark, root)["memory_reads"].count() == 1
