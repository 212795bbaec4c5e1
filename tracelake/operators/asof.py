"""Point-in-time reconstruction: what registers, memory, threads and the timeline held at a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import end_of, ordered, signed
from ..schemas import PAGE, REGISTERS, STEP
from .kernels import asof_last
from .lookups import addresses_between, between, instruction_at, writes_at


#: Steps between coordinated snapshots.
SNAPSHOT = 100_000


def register_writes(deltas: DataFrame) -> DataFrame:
    """(seq, ord, register_id, value): a row for each bit set in a delta's mask.

    Values follow the set bits in ascending order; a register whose value is missing at the end of
    the list has a null value, which still hides earlier ones.
    """
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), lambda r: F.getbit("change_mask", r) == 1)
    return deltas.select("seq", "ord", "change_mask", "values", F.explode(set_bits).alias("register_id")).selectExpr(
        "seq", "ord", "register_id", "try_element_at(values, cast(bit_count(change_mask & (shiftleft(1L, register_id) - 1)) as int) + 1) as value"
    )


def register_at(writes: DataFrame, register: int, step: int) -> DataFrame:
    """(register_id, value): a register's value at a step; no row if it was never written by then."""
    rows = writes.where((F.col("register_id") == register) & (F.col("seq") <= step))
    last = rows.groupBy("register_id").agg(F.max(F.struct("seq", "ord", "value")).alias("last"))
    return last.select("register_id", F.col("last.value").alias("value"))


def register_history(writes: DataFrame, register: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """(seq): the distinct steps that write a register."""
    return between(writes.where(F.col("register_id") == register), "seq", start, end).select("seq").distinct()


def register_state(writes: DataFrame, step: int) -> DataFrame:
    """(register_id, value): all registers at a step, 0 if unwritten, flags in 32 bits; no rows before the first write."""
    last = writes.where(F.col("seq") <= step).groupBy("register_id").agg(F.max(F.struct("seq", "ord", "value")).alias("last"))
    known = last.agg(F.map_from_entries(F.collect_list(F.struct("register_id", F.col("last.value").alias("value")))).alias("known"))
    rows = known.where(F.size("known") > 0).select("known", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1))).alias("register_id"))
    value = F.coalesce(F.try_element_at("known", F.col("register_id").cast(last.schema["register_id"].dataType)), F.lit(0))
    flags = F.col("register_id") == REGISTERS - 1
    return rows.select("register_id", F.when(flags, F.pmod(value, F.lit(1 << 32))).otherwise(value).alias("value"))


def register_snapshots(writes: DataFrame, interval: int = SNAPSHOT) -> DataFrame:
    """(snapshot_id, step, register_id, value): every register's value at each whole multiple of interval that the trace reaches.

    Registers not written by then have no row. Writes are first brought down to the last of each
    register and interval; the window over intervals has a row for each of those.
    """
    place = F.expr(f"(seq + {interval - 1}) div {interval}")  # the first snapshot that sees it
    last = writes.groupBy("register_id", place.alias("n")).agg(F.max(F.struct("seq", "ord", "value")).alias("last"))
    top = writes.agg(F.expr(f"max(seq) div {interval}").alias("top"))
    following = F.lead("n").over(Window.partitionBy("register_id").orderBy("n"))
    spans = last.withColumn("until", following).join(F.broadcast(top))
    high = F.least(F.col("top"), F.coalesce(F.col("until") - 1, F.col("top")))
    low = F.greatest(F.col("n"), F.lit(1))
    rows = spans.where(low <= high).select(F.explode(F.sequence(low, high)).alias("snapshot_id"), "register_id", F.col("last.value").alias("value"))
    return rows.select("snapshot_id", (F.col("snapshot_id") * interval).alias("step"), "register_id", "value")


def snapshot_before(snapshots: DataFrame, step: int) -> DataFrame:
    """(snapshot_id, step): the latest snapshot at step or earlier; no row without one."""
    return snapshots.where(F.col("step") <= step).groupBy().agg(F.max(F.struct("step", "snapshot_id")).alias("m")).where("m is not null").select("m.snapshot_id", "m.step")


def register_state_from(snapshots: DataFrame, writes: DataFrame, step: int) -> DataFrame:
    """register_state() from the last snapshot, which should be written, and the writes after it."""
    base = writes.sparkSession.range(1).join(F.broadcast(snapshot_before(snapshots, step)), how="left").select(F.coalesce("step", F.lit(-1)).alias("base"))
    held = snapshots.join(F.broadcast(base), F.col("step") == F.col("base")).select(F.col("step").alias("seq"), F.lit(-1).cast("long").alias("ord"), "register_id", "value")
    recent = writes.where(F.col("seq") <= step).join(F.broadcast(base), F.col("seq") > F.col("base")).select("seq", "ord", "register_id", "value")
    return register_state(held.unionByName(recent), step)


def full_state_deltas(states: DataFrame) -> DataFrame:
    """(seq, ord, register_id, value): what changed between full register states, given in long form."""
    before = Window.partitionBy("register_id").orderBy("seq", "ord")
    return states.withColumn("before", F.lag("value").over(before)).where("not value <=> before").drop("before")


def memory_at(writes: DataFrame, address: int, size: int, step: int) -> DataFrame:
    """(address, page_address, value, deltas_applied): size bytes at a step as lower-case hex.

    Bytes not written by then are 00. No row if the first page had no write at all by then.
    deltas_applied counts each write once for each page of the answer that it touches.
    """
    at, base = ordered(F.col("address")), address - (1 << 63)  # from here on in order as signed numbers
    first, last = base - base % PAGE, (base + size - 1) - (base + size - 1) % PAGE
    near = addresses_between(writes, "address", None, last + (1 << 63) + PAGE - 1)
    rows = near.where((F.col("step") <= step) & (F.octet_length("data") > 0)).select("step", "ord", at.alias("address"), "data")
    rows = rows.withColumn("end", end_of(F.col("address"), F.octet_length("data") - 1))
    rows = rows.where((F.col("address") <= last + PAGE - 1) & (F.col("end") >= first))
    touched = rows.select(
        "step", "ord", "address", "data", "end", F.greatest(F.lit(first), F.col("address") - F.pmod("address", F.lit(PAGE))).alias("low"), F.least(F.lit(last), F.col("end") - F.pmod("end", F.lit(PAGE))).alias("high")
    )
    pages = touched.agg(F.sum(F.expr(f"(high - low) div {PAGE} + 1")).alias("deltas_applied"), F.bool_or(F.col("low") == first).alias("known"))
    place = F.col("address") + F.col("i")
    bytes_ = touched.where((F.col("address") <= base + size - 1) & (F.col("end") >= base)).select(
        "step", "ord", "address", F.hex("data").alias("digits"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.lit(base) - F.col("address")), F.least(F.col("end"), F.lit(base + size - 1)) - F.col("address"))).alias("i"),
    )
    last_bytes = bytes_.groupBy(place.alias("at")).agg(F.max_by(F.substring("digits", F.col("i").cast("int") * 2 + 1, F.lit(2)), F.struct("step", "ord")).alias("byte"))
    known = last_bytes.agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("bytes"))
    digits = F.transform(F.sequence(F.lit(base), F.lit(base + size - 1)), lambda a: F.coalesce(F.try_element_at("bytes", a.cast(last_bytes.schema["at"].dataType)), F.lit("00")))
    return known.join(F.broadcast(pages.where("known"))).select(
        F.lit(signed(address)).cast("long").alias("address"), F.lit(signed(address - address % PAGE)).cast("long").alias("page_address"), F.lower(F.array_join(digits, "")).alias("value"), "deltas_applied"
    )


def page_at(writes: DataFrame, page: int, step: int) -> DataFrame:
    """(page_address, value): a whole page at a step, zeros where nothing was written; never empty."""
    if page % PAGE:
        value = writes.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))
    else:
        value = writes.sparkSession.range(1).join(F.broadcast(memory_at(writes, page, PAGE, step).select("value")), how="left").select("value")
    return value.select(F.lit(signed(page)).cast("long").alias("page_address"), F.coalesce("value", F.lit("00" * PAGE)).alias("value"))


def step_snapshot(instructions: DataFrame, registers: DataFrame, writes: DataFrame, step: int) -> DataFrame:
    """One row: the step's last instruction, all registers by number, and the step's own writes."""
    one = instructions.sparkSession.range(1).select(F.lit(step).cast("long").alias("step"))
    instruction = instruction_at(instructions, step).select(F.struct("thread_id", "address", "is_branch", "branch_taken").alias("instruction"))
    state = register_state(registers, step).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("register_id", "value")))).alias("registers"))
    own = writes_at(writes, step).agg(F.array_sort(F.collect_list(F.struct("ord", "thread_id", "address", "size"))).alias("writes"))
    return one.join(F.broadcast(instruction), how="left").join(F.broadcast(state)).join(F.broadcast(own))


def thread_state(states: DataFrame, thread_id: int, step: int) -> DataFrame:
    """The last state change of a thread up to a step: one row or none."""
    rows = states.where((F.col("thread_id") == thread_id) & (F.col("step") <= step))
    last = rows.groupBy("thread_id").agg(F.max(F.struct("step", "ord", "new_state")).alias("last"))
    return last.select("thread_id", F.col("last.step").alias("step"), F.col("last.new_state").alias("new_state"))


def current_thread(states: DataFrame, switches: DataFrame) -> DataFrame:
    """(thread_id): who runs at the end; no row if nobody does.

    A change to Running and a switch set the runner; a change of the runner to another state
    clears it. So it is the one set last, unless it left afterwards.
    """
    events = states.select("step", "ord", "thread_id", (F.col("new_state") == "Running").alias("sets"), F.lit(0).alias("kind")).unionByName(
        switches.select("step", "ord", F.col("to_thread").alias("thread_id"), F.lit(True).alias("sets"), F.lit(1).alias("kind"))
    )
    at = F.struct("step", "ord", "kind")
    last = events.where("sets").agg(F.max(F.struct(at.alias("at"), "thread_id")).alias("last"))
    left = events.where("not sets").groupBy("thread_id").agg(F.max(at).alias("left"))
    both = last.select("last.at", "last.thread_id").where("thread_id is not null").join(left, "thread_id", "left")
    return both.where("left is null or left < at").select("thread_id")


def thread_states(threads: DataFrame, states: DataFrame) -> DataFrame:
    """(thread_id, state): Terminated for threads that have exited, else the last change, else Runnable."""
    last = states.groupBy("thread_id").agg(F.max(F.struct("step", "ord", "new_state")).alias("last")).select("thread_id", F.col("last.new_state").alias("last"))
    known = threads.groupBy("thread_id").agg(F.max("exit_step").alias("exit_step"))
    return known.join(last, "thread_id", "full").select("thread_id", F.when(F.col("exit_step").isNotNull(), "Terminated").otherwise(F.coalesce("last", F.lit("Runnable"))).alias("state"))


#: Which tables a step's metadata comes from: flag, whether rows carry a thread and an address.
_TIMELINE = (
    ("instructions", "has_instruction", True, True), ("register_deltas", "has_register_delta", False, False), ("calls", "has_call_event", True, False),
    ("memory_writes", "has_memory_delta", True, False), ("sync_events", "has_sync_event", True, False), ("context_switches", "has_context_switch", False, False),
    ("state_changes", "has_thread_event", True, False), ("jni_calls", "has_jni_call", True, False),
)
FLAGS = tuple(flag for _, flag, _, _ in _TIMELINE if flag != "has_instruction")


def timeline(tables: dict[str, DataFrame]) -> DataFrame:
    """(step, thread_id, instruction_address, flags): a row for each step of any event but reads and threads.

    Thread and address are those of the first event, by kind in the order of arrival and then by
    ord; kinds without one give 0.
    """
    rows = None
    for place, (name, flag, has_thread, has_address) in enumerate(_TIMELINE):
        if name not in tables:
            continue
        table = tables[name]
        own = table.select(
            F.col(STEP.get(name, "step")).alias("step"), F.lit(place).alias("place"), F.col("ord").cast("long").alias("ord"),
            (F.col("thread_id") if has_thread else F.lit(0)).cast("long").alias("thread_id"), (F.col("address") if has_address else F.lit(0)).cast("long").alias("instruction_address"),
            *(F.lit(f == flag).alias(f) for f in FLAGS),
        )
        rows = own if rows is None else rows.unionByName(own)
    first = F.min(F.struct("place", "ord", "thread_id", "instruction_address")).alias("first")
    merged = rows.groupBy("step").agg(first, *(F.bool_or(f).alias(f) for f in FLAGS))
    return merged.select("step", F.col("first.thread_id").alias("thread_id"), F.col("first.instruction_address").alias("instruction_address"), *FLAGS)


def find_timeline(
    steps: DataFrame, calls: DataFrame | None = None, start: int | None = None, end: int | None = None, thread_id: int | None = None, low: int | None = None, high: int | None = None, func_id: int | None = None, limit: int | None = None
) -> DataFrame:
    """(step, total_count, has_more): steps that meet every condition in order, cut at limit after counting."""
    rows = addresses_between(between(steps, "step", start, end), "instruction_address", low, high)
    if thread_id is not None:
        rows = rows.where(F.col("thread_id") == thread_id)
    if func_id is not None:
        rows = rows.join(calls.where(F.col("callee_func_id") == func_id).select(F.col("seq").alias("step")).distinct(), "step", "left_semi")
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    found = rows.select("step").orderBy("step")
    found = found if limit is None else found.limit(limit)
    return found.join(F.broadcast(total)).withColumn("has_more", F.lit(False) if limit is None else F.col("total_count") > limit)


def thread_timeline(states: DataFrame, sync: DataFrame, switches: DataFrame, thread_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """(kind, step, ord, detail): a thread's state changes, sync events and switches in a range."""
    parts = (
        states.where(F.col("thread_id") == thread_id).select(F.lit("state_change").alias("kind"), "step", "ord", F.col("new_state").alias("detail")),
        sync.where(F.col("thread_id") == thread_id).select(F.lit("sync").alias("kind"), "step", "ord", F.col("sync_type").alias("detail")),
        switches.where((F.col("from_thread") == thread_id) | (F.col("to_thread") == thread_id)).select(F.lit("switch").alias("kind"), "step", "ord", F.col("switch_reason").alias("detail")),
    )
    return between(parts[0].unionByName(parts[1]).unionByName(parts[2]), "step", start, end)


def active_function(probes: DataFrame, calls: DataFrame, step: str = "step") -> DataFrame:
    """probes with active_function: the callee of the thread's last call event of any type up to step."""
    facts = calls.select("thread_id", "seq", "ord", F.col("callee_address").alias("active_function"))
    return asof_last(probes, facts, ["thread_id"], step, ["seq", "ord"], "active_function")


def function_spans(functions: DataFrame) -> DataFrame:
    """(low, high, func_name): addresses, high exclusive, that the nearest function below covers.

    Of functions at one offset the last registered counts; size 0 covers the offset alone. Spans
    are disjoint, for a nearer function hides an outer one even where it does not reach.
    """
    known = functions.groupBy("offset").agg(F.max_by(F.struct("size", "name"), "ord").alias("last"))
    nearest = F.lead("offset").over(Window.orderBy("offset"))
    end = F.col("offset") + F.greatest(F.col("last.size"), F.lit(1))
    return known.select("offset", F.col("last.name").alias("func_name"), F.least(end, F.coalesce(nearest, end)).alias("high")).select(F.col("offset").alias("low"), "high", "func_name")


def function_names(probes: DataFrame, functions: DataFrame, address: Column | str = "address") -> DataFrame:
    """probes with func_name, the function that covers address, or null.

    Spans are cut into pages, so this is an equality join on the page.
    """
    at = F.col(address) if isinstance(address, str) else address
    spans = function_spans(functions).select("low", "high", "func_name", F.explode(F.sequence(F.expr(f"low div {PAGE}"), F.expr(f"(high - 1) div {PAGE}"))).alias("__page"))
    rows = probes.withColumn("__at", at).withColumn("__p", F.expr(f"__at div {PAGE}"))
    joined = rows.join(spans, (F.col("__p") == F.col("__page")) & (F.col("__at") >= F.col("low")) & (F.col("__at") < F.col("high")), "left")
    return joined.drop("__at", "__p", "__page", "low", "high")
