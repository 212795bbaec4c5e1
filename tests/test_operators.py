"""Edge cases of the operators on small tables, some against a replay in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import asof, kernels, locks, lookups, pairs, stack, stats

SYNC = "step long, ord long, thread_id int, sync_type string, sync_object_addr long, result string, wait_duration_ns long"
CALLS = "seq long, ord long, thread_id int, event_type string, callee_address long, caller_address long, callee_func_id long"
ACCESS = "step long, ord long, thread_id int, address long, size long"


@pytest.fixture(autouse=True)
def short_slices(monkeypatch):
    """Histories are cut every four steps here, so what is carried from slice to slice is tested throughout."""
    monkeypatch.setattr(kernels, "SLICE", 4)


def sync(spark, *rows):
    return spark.createDataFrame([(s, n, t, k, a, r, w) for n, (s, t, k, a, r, w) in enumerate(rows)], SYNC)


def access(spark, *rows):
    return spark.createDataFrame([(s, n, t, a, z) for n, (s, t, a, z) in enumerate(rows)], ACCESS)


@pytest.fixture(scope="module")
def no_sync(spark):
    return spark.createDataFrame([], SYNC)


@pytest.fixture(scope="module")
def no_calls(spark):
    return spark.createDataFrame([], CALLS)


def test_last_arrival_wins_and_threads_do_not_leak(spark):
    rows = spark.createDataFrame([(5, 0, 1, 10), (5, 1, 2, 20), (6, 2, 1, 30)], "seq long, ord long, thread_id int, address long")
    assert lookups.instruction_at(rows, 5).first().address == 20
    assert [r.address for r in lookups.thread_instructions(rows, 1, 5, 5).collect()] == [10]


def test_registers(spark):
    deltas = spark.createDataFrame(
        [(9, 0, 1, [7]), (5, 1, 1, [1]), (5, 2, 1, [2]), (3, 3, (1 << 32) | (1 << 33), [64, (1 << 32) + 5]), (11, 4, 0b11, [8])], "seq long, ord long, change_mask long, values array<long>"
    )
    writes = asof.register_writes(deltas)
    assert asof.register_at(writes, 0, 5).first().value == 2  # of one step the last arrival
    assert asof.register_at(writes, 0, 4).first() is None
    assert asof.register_at(writes, 1, 20).first().value is None  # the value is missing from the list
    state = {r.register_id: r.value for r in asof.register_state(writes, 9).collect()}
    assert len(state) == 34 and state[0] == 7 and state[32] == 64 and state[33] == 5 and state[7] == 0
    assert asof.register_state(writes, 2).count() == 0
    assert sorted(r.seq for r in asof.register_history(writes, 0).collect()) == [5, 9, 11]


def test_memory(spark):
    rows = [(1, 0, 1, 100, b"\x01\x02\x03\x04"), (2, 1, 1, 102, b"\xff"), (3, 2, 1, 4094, b"\xaa\xbb\xcc\xdd"), (9, 3, 1, 100, b"\x00")]
    writes = spark.createDataFrame(rows, "step long, ord long, thread_id int, address long, data binary")
    found = asof.memory_at(writes, 100, 4, 5).first()
    assert found.value == "0102ff04" and found.deltas_applied == 3 and found.page_address == 0
    across = asof.memory_at(writes, 4094, 4, 5).first()
    assert across.value == "aabbccdd" and across.deltas_applied == 4
    assert asof.memory_at(writes, 8192, 4, 5).first() is None
    assert asof.memory_at(writes, 100, 4, 0).first() is None
    assert set(asof.page_at(writes, 8192, 5).first().value) == {"0"}
    assert asof.page_at(writes, 4096, 5).first().value.startswith("ccdd00")


def replayed(events):
    stack_ = []
    for seq, _, _, kind, callee, site, func in events:
        if kind in ("Return", "TailCall") and stack_:
            stack_.pop()
        if kind != "Return":
            stack_.append((func, callee, site, seq))
    return [(k, *frame) for k, frame in enumerate(stack_)]


@pytest.mark.parametrize("seed", range(3))
def test_call_stack_is_the_replay(spark, seed):
    pick = random.Random(seed)
    events = [(k // 2, k, 1, pick.choice(["Call", "Call", "Return", "TailCall"]), pick.randrange(9), pick.randrange(9), pick.randrange(9)) for k in range(60)]
    got = stack.call_stacks(spark.createDataFrame(events, CALLS), 24).orderBy("depth").collect()
    assert [(r.depth, r.func_id, r.entry_address, r.call_site, r.call_seq) for r in got] == replayed([e for e in events if e[0] <= 24])


@pytest.mark.parametrize("seed", range(3))
def test_holds_are_the_replay(spark, seed):
    pick = random.Random(seed)
    kinds = ["MutexLock", "MutexUnlock", "MutexTryLock", "CondvarWait"]
    rows = [(k // 3, pick.randrange(1, 3), pick.choice(kinds), pick.randrange(2), pick.choice(["Success", "Success", "WouldBlock"]), None) for k in range(80)]
    depth, start, want = {}, {}, []
    for step, thread, kind, lock, result, _ in rows:
        key = lock, thread
        if kind == "MutexUnlock":
            if depth.get(key) == 1:
                want.append((*key, start[key], step))
            depth[key] = max(0, depth.get(key, 0) - 1)
        elif kind.startswith("Mutex") and result == "Success":
            if not depth.get(key):
                start[key] = step
            depth[key] = depth.get(key, 0) + 1
    events = sync(spark, *rows)
    got = kernels.hold_intervals(events).where("end_step is not null").collect()
    assert sorted((r.sync_object_addr, r.thread_id, r.start_step, r.end_step) for r in got) == sorted(want)
    held = {(r.sync_object_addr, r.thread_id): r.held for r in stack.locks_held(events, 1 << 40).collect()}
    assert all(held[k] == (d > 0) for k, d in depth.items())


def test_race_kinds(spark, no_sync, no_calls):
    writes = access(spark, (5, 1, 100, 4), (5, 2, 102, 4), (9, 2, 100, 4))
    reads = access(spark, (5, 2, 103, 1), (2, 2, 101, 2), (7, 1, 100, 4))
    got = {(r.first_step, r.first_thread, r.first_is_write, r.second_step, r.second_thread, r.second_is_write): r for r in pairs.races(writes, reads, no_sync, no_calls).collect()}
    assert (5, 1, True, 5, 2, True) not in got or (5, 1, True, 5, 2, False) in got  # one row for one pair of steps, threads and address
    assert (2, 2, False, 5, 1, True) in got and (5, 1, True, 9, 2, True) in got and (5, 2, True, 7, 1, False) in got and (7, 1, False, 9, 2, True) in got
    row = got[2, 2, False, 5, 1, True]
    assert (row.address, row.overlap_address, row.overlap_size, row.confidence) == (100, 101, 2, 0.8)
    assert got[5, 1, True, 9, 2, True].confidence == pytest.approx(0.64)
    assert "without synchronization" in row.description and "0x64" in row.description


def test_sync_between_suppresses_a_race(spark, no_calls):
    writes, reads = access(spark, (5, 1, 100, 4)), access(spark, (8, 2, 100, 4))
    both = sync(spark, (6, 1, "CondvarSignal", 1, "Success", None), (7, 2, "CondvarWait", 1, "Success", None))
    assert pairs.races(writes, reads, both, no_calls).count() == 0
    late = sync(spark, (6, 1, "MutexUnlock", 1, "Success", None), (9, 2, "MutexLock", 1, "Success", None))
    assert pairs.races(writes, reads, late, no_calls).count() == 1
    other = sync(spark, (6, 1, "MutexUnlock", 1, "Success", None), (7, 2, "MutexLock", 2, "Success", None))
    assert pairs.races(writes, reads, other, no_calls).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_has_sync_is_the_quantified_form(spark, seed):
    pick = random.Random(seed)
    rows = [(pick.randrange(40), pick.randrange(4), "MutexLock", pick.randrange(3), "Success", None) for _ in range(25)]
    probes = [(f, a, b, f + pick.randrange(12)) for f in range(0, 40, 3) for a in range(4) for b in range(4) if a != b]
    got = pairs.has_sync(spark.createDataFrame(probes, "step long, thread_id int, other int, until long"), sync(spark, *rows)).collect()
    touch = lambda t, f, u: {r[3] for r in rows if r[1] == t and f <= r[0] <= u}
    assert len(got) == len(probes)
    assert all(r.has_sync == bool(touch(r.thread_id, r.step, r.until) & touch(r.other, r.step, r.until)) for r in got)


@pytest.mark.parametrize("seed", range(2))
def test_active_function_is_the_last_call_before(spark, seed):
    pick = random.Random(seed)
    calls = [(pick.randrange(-20, 60), k, pick.choice([1, 2, None]), "Call", pick.randrange(9), 0, 0) for k in range(25)]
    probes = [(s, t) for s in range(-25, 70, 2) for t in (1, 2, 3)]
    got = asof.active_function(spark.createDataFrame(probes, "step long, thread_id int"), spark.createDataFrame(calls, CALLS)).collect()
    last = lambda s, t: max(((c[0], c[1], c[4]) for c in calls if c[2] == t and c[0] <= s), default=(0, 0, None))[2]
    assert sorted((r.step, r.thread_id) for r in got) == sorted(probes)
    assert all(r.active_function == last(r.step, r.thread_id) for r in got)


def test_no_task_orders_a_whole_history(spark):
    """One thread's events meet in tasks by slice, and only a row for each slice is ordered by the thread alone."""
    rows = spark.range(0, 4096, 1, 4).selectExpr("id as step", "id as ord", "1 as thread_id", "if(id % 2 = 0, 'MutexLock', 'MutexUnlock') as sync_type", "7L as sync_object_addr", "'Success' as result", "0L as wait_duration_ns")
    keys = ["sync_object_addr", "thread_id"]
    for found in (kernels.hold_intervals(rows), kernels.neighbours(rows, keys, ["step", "ord"], True, next="step"), kernels.least_later(rows, keys, ["step", "ord"], "step", "low")):
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        orders = [k for k, line in enumerate(plan) if "Window [" in line and "__group" not in line.split("], [")[1]]
        below = [next(line for line in plan[k + 1 :] if any(w in line for w in ("Aggregate", "Join", "Range ("))) for k in orders]
        assert orders and all("Aggregate" in line for line in below), below
    unknown = rows.withColumn("thread_id", F.lit(None).cast("int"))  # events of no thread are one history too
    assert kernels.hold_intervals(unknown).agg(F.count(F.lit(1)), F.sum(F.expr("end_step - start_step"))).first() == (2048, 2048)
    assert kernels.hold_intervals(rows).agg(F.count(F.lit(1)), F.sum(F.expr("end_step - start_step"))).first() == (2048, 2048)


def test_overlap_of_wide_and_empty_accesses(spark):
    left, right = access(spark, (1, 1, 0, 9000), (1, 1, 20000, 0)), access(spark, (2, 2, 4096, 4), (2, 2, 8999, 10), (2, 2, 9000, 4), (2, 2, 19990, 20))
    got = sorted((r.a_address, r.b_address) for r in pairs.overlapping(left, right).collect())
    assert got == [(0, 4096), (0, 8999), (20000, 19990)]


def test_data_flow_takes_the_first_later_read(spark):
    writes, reads = access(spark, (5, 1, 100, 4)), access(spark, (5, 2, 100, 4), (7, 2, 102, 4), (9, 2, 100, 4), (8, 3, 100, 1))
    locked = sync(spark, (6, 1, "MutexUnlock", 1, "Success", None), (7, 2, "MutexLock", 1, "Success", None))
    got = {(r.to_thread, r.read_step, r.overlap_size, r.is_synchronized) for r in pairs.data_flows(writes, reads, locked).collect()}
    assert got == {(2, 7, 2, True), (3, 8, 1, False)}


def test_lock_order_and_deadlock(spark):
    lock = lambda s, t, a, result="Success", kind="MutexLock": (s, t, kind, a, result, None)
    free = lambda s, t, a, kind="MutexUnlock": (s, t, kind, a, "Success", None)
    rows = [lock(1, 1, 10), lock(2, 1, 20), free(3, 1, 20), free(4, 1, 10), lock(5, 2, 20), lock(6, 2, 10), free(7, 2, 10), free(8, 2, 20)]
    got = locks.deadlocks(sync(spark, *rows)).first()
    assert got.cycle == [10, 20] and got.threads == [1, 2] and got.violation_steps == [1, 2, 5, 6]
    failed = [*rows[:5], lock(6, 2, 10, "WouldBlock")]
    assert locks.deadlocks(sync(spark, *failed)).count() == 0
    shared = [(s, t, k.replace("Mutex", "RwLock").replace("RwLockLock", "RwLockRead"), a, r, w) for s, t, k, a, r, w in rows]
    assert locks.lock_order(sync(spark, *shared)).count() == 0
    again = [lock(1, 1, 10), lock(2, 1, 10), free(3, 1, 10), lock(4, 1, 20)]
    assert [(r.held, r.taken) for r in locks.lock_order(sync(spark, *again)).collect()] == [(10, 20)]
    one_step = [lock(1, 1, 10), lock(1, 1, 20)]
    assert [(r.held, r.taken) for r in locks.lock_order(sync(spark, *one_step)).collect()] == [(10, 20)]


def test_cycles_of_small_and_large_graphs_are_the_same(spark):
    pick = random.Random(5)
    edges = sorted({(pick.randrange(7), pick.randrange(7)) for _ in range(22)} - {(k, k) for k in range(7)})
    table = spark.createDataFrame(edges, "held long, taken long")
    cycles = lambda small: sorted(r.cycle for r in locks.lock_cycles(table, small).collect())
    assert cycles(locks.SMALL) == cycles(1) and cycles(1)


def test_contention_is_counted_once_for_a_wait_that_timed_out(spark):
    row = stats.lock_contention(sync(spark, (1, 1, "MutexLock", 10, "Timeout", 500), (2, 2, "SemPost", 11, "Success", None))).orderBy("sync_object_addr").collect()
    assert (row[0].acquire_count, row[0].contention_count, row[0].avg_wait_ns, row[0].contending_threads) == (1, 1, 500, [1])
    assert (row[1].kind, row[1].acquire_count, row[1].contention_ratio) == ("Semaphore", 0, 0.0)


def test_lifecycle_of_odd_parents(spark):
    rows = [(0, 1, 0, 0, 9), (1, 2, 1, 3, 2), (2, 3, 99, 0, None), (3, 4, 5, 0, None), (4, 5, 4, 0, None), (5, 6, 6, 0, None), (6, 7, 2, 0, None)]
    threads = spark.createDataFrame([(*r, None) for r in rows], "ord long, thread_id int, parent_thread_id int, create_step long, exit_step long, name string")
    got = {r.thread_id: r for r in stats.thread_lifecycle(threads).collect()}
    assert {k: v.tree_depth for k, v in got.items()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1, 6: 0, 7: 2}
    assert got[1].children == [2] and got[2].lifespan_steps is None and not got[2].is_alive and got[3].is_alive and got[1].name == ""


def test_scheduling_residency(spark):
    rows = [(1, 0, 9, 1, "Yield", 0), (4, 1, 1, 2, "Preemption", None), (6, 2, 2, 1, "Migration", 3), (7, 3, 1, 1, "Yield", 2), (9, 4, 1, 2, "Blocking", 1)]
    switches = spark.createDataFrame(rows, "step long, ord long, from_thread int, to_thread int, switch_reason string, cpu_core int")
    got = {r.thread_id: r for r in stats.scheduling(switches).collect()}
    assert [(c.core, c.steps) for c in got[1].core_residency] == [(0, 3), (2, 2), (3, 1)]
    assert got[2].core_residency == [] and got[1].voluntary_count == 2 and got[1].migration_count == 1 and got[9].switch_in_count == 0


def test_state_residency(spark):
    threads = spark.createDataFrame([(0, 1, 0, 0, 20, None), (1, 2, 0, 0, None, None)], "ord long, thread_id int, parent_thread_id int, create_step long, exit_step long, name string")
    states = spark.createDataFrame([(2, 0, 1, "Running"), (7, 1, 1, "WaitingForLock"), (12, 2, 1, "Sleeping"), (3, 3, 2, "Blocked")], "step long, ord long, thread_id int, new_state string")
    got = {r.thread_id: r for r in stats.state_residency(threads, states).collect()}
    assert (got[1].running_steps, got[1].waiting_steps, got[1].total_steps, got[1].final_state) == (5, 5, 18, "Sleeping")
    assert got[2].total_steps == 0 and got[2].blocked_ratio == 0.0 and got[2].time_in_state == []


def test_current_thread(spark):
    states = spark.createDataFrame([(1, 0, 1, "Running"), (5, 1, 1, "Blocked"), (6, 2, 3, "Sleeping")], "step long, ord long, thread_id int, new_state string")
    switches = spark.createDataFrame([(3, 9, 1, 2, "Yield", 0)], "step long, ord long, from_thread int, to_thread int, switch_reason string, cpu_core int")
    assert asof.current_thread(states, switches).first().thread_id == 2
    assert asof.current_thread(states, switches.limit(0)).count() == 0


def test_function_names(spark):
    functions = spark.createDataFrame([(0, 100, 50, "outer"), (1, 110, 5, "inner"), (2, 200, 0, "point"), (3, 300, 9, "old"), (4, 300, 20_000, "new")], "ord long, offset long, size long, name string")
    probes = spark.createDataFrame([(a,) for a in (99, 100, 112, 120, 200, 201, 300, 15_000, 20_300)], "address long")
    got = {r.address: r.func_name for r in asof.function_names(probes, functions).collect()}
    assert got == {99: None, 100: "outer", 112: "inner", 120: None, 200: "point", 201: None, 300: "new", 15_000: "new", 20_300: None}


def test_thread_stats_count_from_registration_on(spark):
    threads = spark.createDataFrame([(0, 1, 5), (1, 1, 9)], "ord long, thread_id int, create_step long")
    states = spark.createDataFrame([(4, 0, 1, "Running"), (5, 1, 1, "Running"), (6, 2, 2, "Running")], "step long, ord long, thread_id int, new_state string")
    switches = spark.createDataFrame([(6, 0, 1, 1, "Yield", 0)], "step long, ord long, from_thread int, to_thread int, switch_reason string, cpu_core int")
    events = sync(spark, (6, 1, "MutexLock", 1, "Timeout", None), (7, 1, "CondvarSignal", 1, "Success", None))
    row = stats.thread_stats(threads, states, switches, events).collect()
    assert len(row) == 1 and row[0].steps_executed == 1 and row[0].context_switch_count == 2 and row[0].lock_release_count == 1
    assert row[0].avg_lock_wait_ns == 0 and row[0].max_lock_wait_ns is None


def test_empty_tables(spark, no_sync, no_calls):
    none = spark.createDataFrame([], ACCESS)
    assert pairs.races(none, none, no_sync, no_calls).count() == 0
    assert pairs.data_flows(none, none, no_sync).count() == 0
    assert locks.deadlocks(no_sync).count() == 0
    assert stack.call_stacks(no_calls, 5).count() == 0
    assert stats.critical_sections(no_sync).agg(F.count(F.lit(1))).first()[0] == 0


TOP = (1 << 64) - 1


def test_races_at_the_top_of_the_address_space(spark, no_sync, no_calls):
    """Addresses of 2^63 and more are negative numbers in the tables; an end beyond the last one is cut."""
    at = lambda a: a - (1 << 64) if a >= 1 << 63 else a
    writes = access(spark, (100, 1, at(TOP - 7), 16), (100, 1, (1 << 63) - 4, 8), (100, 1, 0, 4))
    reads = access(spark, (200, 2, at(TOP - 7), 4), (200, 2, at(1 << 63), 2), (200, 2, at(TOP - 1), 1), (200, 2, 5, 4))
    got = {(r.first_address if "first_address" in r else r.address, r.overlap_address, r.overlap_size) for r in pairs.races(writes, reads, no_sync, no_calls).collect()}
    assert {(a & TOP, o & TOP, n) for a, o, n in got} <= {(TOP - 7, TOP - 7, 4), (TOP - 7, TOP - 1, 1), ((1 << 63) - 4, 1 << 63, 2)} and len(got) == 2
    text = " ".join(r.description for r in pairs.races(writes, reads, no_sync, no_calls).collect())
    assert "0xFFFFFFFFFFFFFFF8" in text and "0x7FFFFFFFFFFFFFFC" in text and "conflict range 0x8000000000000000-0x8000000000000002" in text
    flows = {(r.address & TOP, r.overlap_address & TOP, r.overlap_size) for r in pairs.data_flows(writes, reads, no_sync).collect()}
    assert flows == {(TOP - 7, TOP - 7, 4), ((1 << 63) - 4, 1 << 63, 2)}


def test_memory_at_both_ends(spark):
    at = lambda a: a - (1 << 64) if a >= 1 << 63 else a
    data = bytearray(range(1, 9))
    rows = [(1, 0, 1, at(TOP - 7), data), (2, 1, 1, (1 << 63) - 4, data), (3, 2, 1, 0, data), (4, 3, 1, at((1 << 64) - 4096), data)]
    writes = spark.createDataFrame(rows, "step long, ord long, thread_id int, address long, data binary")
    value = lambda a, n, step=9: [r.value for r in asof.memory_at(writes, a, n, step).collect()]
    assert value(TOP - 7, 8) == ["0102030405060708"] and value(TOP - 7, 8, 0) == [] and value((1 << 63) - 2, 4) == ["03040506"] and value(0, 4) == ["01020304"]
    assert asof.memory_at(writes, TOP - 3, 4, 9).first().page_address & TOP == TOP - 4095 and asof.memory_at(writes, TOP - 3, 4, 9).first().deltas_applied == 2
    page = asof.page_at(writes, (1 << 64) - 4096, 9).first()
    assert page.value.startswith("0102030405060708") and page.value.endswith("0102030405060708") and page.page_address == -4096


def test_address_ranges_over_the_sign(spark):
    values = [0, 5, (1 << 63) - 1, 1 << 63, (1 << 63) + 5, TOP]
    rows = spark.createDataFrame([(k, k, 1, v - (1 << 64) if v >= 1 << 63 else v) for k, v in enumerate(values)], "seq long, ord long, thread_id int, address long")
    for low in (None, 5, 1 << 63):
        for high in (None, (1 << 63) - 1, (1 << 63) + 5):
            got = {r.address & TOP for r in lookups.find_instructions(rows, low=low, high=high).collect()}
            assert got == {v for v in values if (low is None or v >= low) and (high is None or v <= high)}, (low, high)
    assert lookups.find_instructions(rows, address=TOP).count() == lookups.steps_by_address(rows, 1 << 63).count() == 1
    assert [r.address & TOP for r in stats.hot_paths(rows.withColumn("is_branch", F.lit(False))).collect()] == values


def test_cycles_of_locks_at_the_top(spark):
    edges = spark.createDataFrame([(-8, 16), (16, -8)], "held long, taken long")
    for small in (10, 0):
        assert [list(r.cycle) for r in locks.lock_cycles(edges, small).collect()] == [[16, -8]]
