"""Sweeps over slices of four steps against a replay of all pairs in plain Python."""

import random

import pytest

from tests.test_operators import ACCESS, CALLS, SYNC
from tracelake.operators import kernels, pairs


@pytest.fixture(autouse=True)
def short_slices(monkeypatch):
    monkeypatch.setattr(kernels, "SLICE", 4)


def made_up(seed):
    """Writes, reads and sync events with ties, empty accesses, straddles of grains and long waits for a lock."""
    rng = random.Random(seed)
    touch = lambda n: (rng.randrange(24), n, rng.randrange(1, 4), 64 + rng.randrange(40), rng.choice((0, 1, 4, 9, 24)))
    first = {}
    rows = [{}, {}]
    for n in range(90):
        row = touch(n)
        side = rows[n % 2]
        side.setdefault((row[0], row[2], row[3]), row)  # of those alike in step, thread and address the first
        first[n] = row
    events = [(rng.randrange(24), n, rng.randrange(1, 4), "MutexLock", 900 + rng.randrange(3), "Success", None) for n in range(9)]
    return list(rows[0].values()), list(rows[1].values()), events


def synced(events, a, b, start, end):
    touched = lambda t: {e[4] for e in events if e[2] == t and start <= e[0] <= end}
    return bool(touched(a) & touched(b))


def meet(a, b):
    return a[2] != b[2] and a[3] < b[3] + b[4] and b[3] < a[3] + a[4]


@pytest.mark.parametrize("seed", range(2))
def test_flows_are_the_replay(spark, seed):
    writes, reads, events = made_up(seed)
    want = set()
    for w in writes:
        for t in {1, 2, 3} - {w[2]}:
            later = sorted((r for r in reads if r[2] == t and r[0] > w[0] and meet(w, r)), key=lambda r: r[:2])
            if later:
                r = later[0]
                low, high = max(w[3], r[3]), min(w[3] + w[4], r[3] + r[4])
                want.add((w[2], t, w[3], w[0], r[0], w[4], r[4], low, high - low, synced(events, w[2], t, w[0], r[0])))
    tables = (spark.createDataFrame(writes, ACCESS), spark.createDataFrame(reads, ACCESS), spark.createDataFrame(events, SYNC))
    got = pairs.data_flows(*tables).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_flows_join_no_pairs(spark):
    """Accesses meet in arrays within a slice: a join on what they share would be as large as the square of a busy address's accesses."""
    accesses = spark.createDataFrame([], ACCESS)
    plan = pairs.data_flows(accesses, accesses, spark.createDataFrame([], SYNC))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "w_address" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_races_are_the_replay(spark, seed):
    writes, reads, events = made_up(seed)
    want = set()
    for f, first in [(a, True) for a in writes] + [(a, False) for a in reads]:
        for s, second in [(a, True) for a in writes] + [(a, False) for a in reads]:
            later = s[0] > f[0] or (s[0] == f[0] and first and (not second or f[2] < s[2]))
            if (first or second) and later and meet(f, s) and not synced(events, f[2], s[2], f[0], s[0]):
                want.add(((f if first else s)[3], f[0], f[2], s[0], s[2]))
    empty = spark.createDataFrame([], CALLS)
    got = pairs.races(*(spark.createDataFrame(rows, ACCESS) for rows in (writes, reads)), spark.createDataFrame(events, SYNC), empty).collect()
    found = [(r.address, r.first_step, r.first_thread, r.second_step, r.second_thread) for r in got]
    assert len(found) == len(want) and set(found) == want
    assert any(b // 4 > a // 4 + 1 for _, a, _, b, _ in found)  # some lie slices apart


def test_races_join_pairs_of_a_slice_only(spark):
    """A busy grain's accesses are not joined over the whole history, only with slices before the next synchronisation."""
    accesses = spark.createDataFrame([], ACCESS)
    plan = pairs.races(accesses, accesses, spark.createDataFrame([], SYNC), spark.createDataFrame([], CALLS))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "s_grain" in line]
    assert joins and all("s_slice" in line for line in joins)


@pytest.mark.parametrize("seed", range(2))
def test_synced_overlaps_are_the_replay(spark, seed):
    writes, reads, events = made_up(seed)
    want = sorted((w[0], w[2], r[2], r[0], synced(events, w[2], r[2], w[0], r[0])) for w in writes for r in reads if r[0] >= w[0] and meet(w, r))
    got = pairs.synced_overlaps(*(spark.createDataFrame(rows, ACCESS) for rows in (writes, reads)), spark.createDataFrame(events, SYNC)).collect()
    assert sorted(map(tuple, got)) == want and {w[4] for w in want} == {True, False}


def test_no_pair_is_shuffled(spark):
    """Above the join of writes and reads nothing is exchanged: the pairs are as many as the square of a busy address's accesses."""
    from tracelake.plans import trace_queries

    plan = trace_queries.QUERIES["joi_02"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().splitlines()
    top = next(n for n, line in enumerate(plan) if "Join" in line)
    assert "w_start" in plan[top] and "r_start" in plan[top]
    assert not any("Window" in line or "Aggregate" in line for line in plan[:top])
