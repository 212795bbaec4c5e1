"""Logs of external tools: memory checkers, system and library call tracers, disassemblers, profilers.

Each reader gives event tables from lines; lines that are no event are passed over. Threads go by
the process number that the tool prints, or 1 where it prints none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import labelled, ordered, parse_addr, signed, to_so_offset, wrapped
from .jsonl import _small, _table
from .lines import announced, counted, once, summed

# Operations and calls of the tools.
FUTEX_ALIASES = {
    "futex_wait": "FutexWait", "futex_wait_private": "FutexWait", "futex_wait_bitset": "FutexWait", "futex_wait_bitset_private": "FutexWait", "futex_lock_pi": "FutexWait", "futex_lock_pi2": "FutexWait",
    "futex_lock_pi_private": "FutexWait", "futex_unlock_pi": "FutexWake", "futex_unlock_pi_private": "FutexWake", "futex_wake": "FutexWakeCount", "futex_wake_private": "FutexWakeCount",
    "futex_wake_bitset": "FutexWakeCount", "futex_wake_bitset_private": "FutexWakeCount", "futex_requeue": "FutexWakeCount", "futex_requeue_private": "FutexWakeCount",
    "futex_cmp_requeue": "FutexWakeCount", "futex_cmp_requeue_private": "FutexWakeCount", "futex_wake_op": "FutexWakeCount",
}
LIBRARY_ALIASES = {
    "pthread_mutex_lock": "MutexLock", "pthread_mutex_trylock": "MutexTryLock", "pthread_mutex_unlock": "MutexUnlock", "pthread_rwlock_rdlock": "RwLockRead", "pthread_rwlock_wrlock": "RwLockWrite",
    "pthread_rwlock_unlock": "RwLockUnlock", "pthread_cond_wait": "CondvarWait", "pthread_cond_signal": "CondvarSignal", "pthread_cond_broadcast": "CondvarBroadcast", "sem_wait": "SemWait",
    "sem_post": "SemPost", "pthread_barrier_wait": "BarrierWait",
}
REPORTS = (
    "data race", "lock-order-inversion", "thread leak", "use of an invalid mutex", "double lock of a mutex", "destroy of a locked mutex", "unlock of an unlocked mutex",
)
MUTEX_REPORTS = {"locked": "Lock", "unlocked": "Unlock", "created": "Create", "destroyed": "Destroy"}
TRANSLATED_BRANCHES = (
    "b", "bl", "br", "blr", "ret", "eret", "cbz", "cbnz", "tbz", "tbnz", "beq", "bne", "blt", "bgt", "ble", "bge", "bhi", "blo", "bpl", "bmi", "bvs", "bvc", "bcs", "bcc", "bhs", "bls", "bal", "bnv",
    "jmp", "je", "jne", "jz", "jnz", "jl", "jle", "jg", "jge", "ja", "jae", "jb", "jbe", "js", "jns", "jo", "jno", "jp", "jnp", "jcxz", "jecxz", "jrcxz", "call", "retn", "retf", "loop", "loope", "loopne",
)
INVOKES = tuple(f"invoke-{kind}{form}" for kind in ("virtual", "static", "interface", "direct", "super", "polymorphic", "custom") for form in ("", "/range"))
BYTECODE_BRANCHES = (
    "if-eq", "if-ne", "if-lt", "if-ge", "if-gt", "if-le", "if-eqz", "if-nez", "if-ltz", "if-gez", "if-gtz", "if-lez", "goto", "goto/16", "goto/32", "packed-switch", "sparse-switch",
    "return", "return-void", "return-wide", "return-object", "throw",
)
_BRANCHES = r"^(b|bl|blr|br|ret|retq|cbn?z|tbn?z|b\.\w+|bx|blx|call\w*|j\w+|loop\w*)$"
_CALLS = r"^(bl|blr|blx|call\w*)$"


def _hex(column: str, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(column, pattern, group)
    return F.when(found != "", parse_addr(F.concat(F.lit("0x"), found)))


def read_memory_checker(lines: DataFrame, base: int = 0, size: int = 0) -> dict[str, DataFrame]:
    """Lines "I 04000,3", " L 1ffe,8", " S ..", " M .." of a memory checker, also after "==pid==".

    I is an instruction, L a load, S a store, M both at one step. Steps count from 1. With base, only
    addresses in base .. base + size count, relative to base. Stored bytes are unknown: zeros, at most eight.
    """
    pattern = r"^(?:==\d+==\s+)?([A-Z])\s+([0-9a-fA-F]+),(\d+)"
    rows = once(lines, "kind", F.regexp_extract("line", pattern, 1)).where(F.col("kind") != "")
    rows = once(rows, "at", wrapped(_hex("line", pattern, 2)))
    if base:
        at = ordered(F.col("at"))
        rows = rows.where((at >= base - (1 << 63)) & (at < base + size - (1 << 63)))
    rows = counted(rows, "n", F.lit(True)).withColumns({"seq": F.col("n") + 1, "size": F.regexp_extract("line", pattern, 3).cast("long"), "at": F.col("at") - signed(base)})
    zeros = F.unhex(F.repeat(F.lit("00"), F.least("size", F.lit(8)).cast("int")))
    one = F.lit(1)
    tables = {
        "instructions": _table("INSTRUCTIONS", rows.where("kind = 'I'"), seq=F.col("seq"), thread_id=one, address=F.col("at"), is_branch=F.lit(False), branch_taken=F.lit(False)),
        "memory_reads": _table("MEMORY_READS", rows.where("kind in ('L', 'M')"), step=F.col("seq"), thread_id=one, address=F.col("at"), size=F.col("size")),
        "memory_writes": _table("MEMORY_WRITES", rows.where("kind in ('S', 'M')"), step=F.col("seq"), thread_id=one, address=F.col("at"), data=zeros),
    }
    return tables | {"threads": announced(tables, at_start=True)}


def read_calls_log(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """Lines "123 12:00:00.1 futex(0x7f, FUTEX_WAIT, ..) = 0 <0.1>", "[pid 123] .." or ".." of call tracers.

    futex and the locks of the thread library are sync events, a mapping is a read of its range, a
    clone registers a thread. Unfinished and resumed calls are passed over. Steps count from 1.
    """
    rows = lines.where(~F.col("line").rlike(r"^(#|---|\+\+\+)|<unfinished|<\.\.\."))
    pattern = r"^(?:(\d+)\s+[\d:.]+\s+|\[pid\s+(\d+)\]\s+)?(?:[\w.]+->)?(\w+)\(([^)]*)\)\s*=\s*(0x[0-9a-fA-F]+|-?\d+|MAP_FAILED)"
    part = lambda k: F.regexp_extract("line", pattern, k)
    rows = once(once(once(rows, "call", part(3)).where(F.col("call") != ""), "args", part(4)), "value", part(5))
    tid = F.coalesce(F.when(part(1) != "", part(1)), F.when(part(2) != "", part(2)), F.lit("1")).cast("long")
    args = F.split("args", r",\s*")
    futex = labelled(F.regexp_extract("args", r"(FUTEX_\w+)", 1), FUTEX_ALIASES)
    rows = once(rows, "op", F.when(F.col("call") == "futex", futex).otherwise(labelled(F.col("call"), LIBRARY_ALIASES)))
    answer = parse_addr(F.col("value"))
    kind = F.when(F.col("op").isNotNull(), "sync").when(F.col("call").isin("mmap", "mmap2") & F.col("value").startswith("0x"), "map").when((F.col("call") == "clone") & ~F.col("value").startswith("-") & (answer > 0), "clone")
    rows = once(once(rows, "kind", kind).where("kind is not null"), "tid", tid)
    rows = counted(rows, "n", F.lit(True)).withColumn("seq", F.col("n") + 1)
    lock = F.coalesce(parse_addr(F.regexp_extract("args", "(0x[0-9a-fA-F]+)", 1)), F.lit(0).cast("decimal(20,0)"))
    failed = F.col("value").startswith("-")
    result = F.when((F.col("op") == "MutexTryLock") & (F.col("value") != "0"), "WouldBlock").when(failed, "Error").otherwise("Success")
    wait = (F.regexp_extract("line", r"<([\d.]+)>\s*$", 1).try_cast("double") * 1_000_000_000).cast("long")
    stack = F.coalesce(parse_addr(F.regexp_extract("args", "child_stack=(0x[0-9a-fA-F]+)", 1)), F.lit(0).cast("decimal(20,0)"))
    zero = F.lit(0)
    tables = {
        "threads": _table(
            "THREADS", rows.where("kind = 'clone'"), thread_id=_small(answer), parent_thread_id=F.col("tid"), create_step=F.col("seq"), stack_base=stack, stack_size=zero, tls_addr=zero, is_jni_attached=F.lit(False)
        ),
        "sync_events": _table("SYNC_EVENTS", rows.where("kind = 'sync'"), step=F.col("seq"), thread_id=F.col("tid"), sync_type=F.col("op"), sync_object_addr=lock, result=result, wait_duration_ns=wait),
        "memory_reads": _table(
            "MEMORY_READS", rows.where("kind = 'map'"), step=F.col("seq"), thread_id=F.col("tid"), address=to_so_offset(answer, base), size=F.coalesce(parse_addr(F.get(args, F.lit(1))), F.lit(0).cast("decimal(20,0)"))
        ).where("size > 0"),
    }
    tables["threads"] = tables["threads"].unionByName(announced(tables, at_start=True))
    return tables


def read_listing(lines: DataFrame) -> dict[str, DataFrame]:
    """A disassembly: "00001234 <name>:" heads a function, "  1234: aa bb  mnemonic operands" is an instruction.

    Instructions count from 1 in the order of the listing, as thread 1; calls have the target's address.
    """
    header = r"^([0-9a-fA-F]+)\s+<([^>]+)>:"
    pattern = r"^([0-9a-fA-F]+):\s+(?:(?:[0-9a-fA-F]{2}\s)+|(?:[0-9a-fA-F]{8}\s)+)\s*([a-zA-Z][\w.]*)\s*(.*)$"
    heads = lines.where(F.col("line").rlike(header))
    functions = heads.select("ord", wrapped(_hex("line", header)).alias("offset"), F.lit(0).cast("long").alias("size"), F.regexp_extract("line", header, 2).alias("name"))
    rows = lines.where(F.col("line").rlike(pattern))
    rows = once(once(rows, "mnemonic", F.lower(F.regexp_extract("line", pattern, 2))), "at", _hex("line", pattern))
    rows = counted(rows, "n", F.lit(True)).withColumn("seq", F.col("n") + 1)
    one, target = F.lit(1), _hex("line", r"\s(?:0x)?([0-9a-fA-F]+)(?:\s+<[^>]*>)?\s*$")
    calls = once(rows.where(F.col("mnemonic").rlike(_CALLS)), "target", target).where("target is not null")
    tables = {
        "instructions": _table("INSTRUCTIONS", rows, seq=F.col("seq"), thread_id=one, address=F.col("at"), is_branch=F.col("mnemonic").rlike(_BRANCHES), branch_taken=F.lit(False)),
        "calls": _table("CALLS", calls, id=F.lit(0), thread_id=one, event_type=F.lit("Call"), caller_address=F.col("at"), callee_address=F.col("target"), seq=F.col("seq"), depth=F.lit(0)),
    }
    return tables | {"threads": announced(tables, at_start=True), "functions": functions}


def read_samples(lines: DataFrame) -> dict[str, DataFrame]:
    """A profiler's call chains: a line "name 123 45.6: 1 cycles:" and below it frames "addr symbol (file)", innermost first.

    A thread's addresses are instructions at the sample that first has them. Neighbouring frames
    are calls, outermost first, a step each; a sample without any takes one step. Unknown frames are left out.
    """
    header, frame = r"^\S.*?\s+(\d+)(?:/\d+)?\s+[\d.]+:\s", r"^([0-9a-fA-F]+)\s+(\S+)\s+\(([^)]+)\)"
    rows = once(lines, "pid", F.regexp_extract("line", header, 1).try_cast("long"))
    rows = once(rows, "at", F.when(F.col("pid").isNull() & ~F.col("line").contains("[unknown]"), wrapped(_hex("line", frame))))
    rows = counted(rows.where("pid is not null or at is not null"), "before", F.col("pid").isNotNull())
    rows = rows.withColumn("sample", F.when(F.col("pid").isNotNull(), F.col("before") + 1).otherwise(F.col("before")))
    samples = rows.groupBy("sample").agg(
        F.max("pid").alias("pid"), F.min("ord").alias("ord"), F.min("part").alias("part"), F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("ord", "at"))), asc=False).alias("frames")
    )
    samples = samples.where("sample > 0").withColumn("steps", F.greatest(F.lit(1), F.size("frames") - 1))
    samples = summed(samples, "earlier", F.col("steps")).withColumn("first", F.col("earlier") + 1)
    seen = samples.select("pid", "ord", "first", F.explode("frames").alias("f")).groupBy("pid", "f.at").agg(F.min(F.struct("first", "ord")).alias("m"))
    hops = samples.where("size(frames) > 1").select("pid", "ord", "first", "frames", F.explode(F.sequence(F.lit(0), F.size("frames") - 2)).alias("i"))
    flag = F.lit(True)
    tables = {
        "instructions": _table("INSTRUCTIONS", seen.withColumn("ord", F.col("m.ord")), seq=F.col("m.first"), thread_id=F.col("pid"), address=F.col("at"), is_branch=flag, branch_taken=flag),
        "calls": _table(
            "CALLS", hops, id=F.lit(0), thread_id=F.col("pid"), event_type=F.lit("Call"), caller_address=F.get("frames", F.col("i"))["at"], callee_address=F.get("frames", F.col("i") + 1)["at"],
            seq=F.col("first") + F.col("i"), depth=F.col("i"),
        ),
    }
    order = Window.partitionBy("pid").orderBy("ord")
    own = samples.withColumn("n", F.row_number().over(order)).where("n = 1")
    zero = F.lit(0)
    threads = _table("THREADS", own, thread_id=F.col("pid"), parent_thread_id=zero, create_step=F.when(F.col("first") > 1, F.col("first")).otherwise(0), stack_base=zero, stack_size=zero, tls_addr=zero, is_jni_attached=F.lit(False))
    return tables | {"threads": threads}


def read_race_report(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """A race detector's report: "Write of size 8 at 0x.. by thread T1", "Previous read ..", "Mutex M1 (0x..) locked by thread T2".

    A mutex line is one step; an access is two, a read of its bytes and the acquisition of its
    address, Contended below a "data race" heading. Steps count from 1, threads from 1 as they
    first appear, with "Thread T1 (tid=9" too; without any there is thread 1.
    """
    access, mutex = r"^(?:Read|Write|Previous\s+(?:read|write)) of size (\d+) at 0x([0-9a-fA-F]+)\s+by\s+thread\s+(T\d+)", r"Mutex\s+\w+\s+\(0x([0-9a-fA-F]+)\)\s+(locked|unlocked|created|destroyed)\s+by\s+thread\s+(T\d+)"
    told, heading = r"Thread (T\d+)\s*\(tid=\d+", "WARNING: ThreadSanitizer: (" + "|".join(REPORTS) + ")"
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    kind = F.when(F.col("line").rlike(told), "thread").when(F.col("line").rlike(heading), "heading").when(F.col("line").rlike(mutex), "mutex").when(F.col("line").rlike(access), "access")
    rows = once(lines, "kind", kind).where("kind is not null")
    name = F.when(F.col("kind") == "thread", part(told, 1)).when(F.col("kind") == "mutex", part(mutex, 3)).when(F.col("kind") == "access", part(access, 3))
    rows = counted(once(rows, "name", name), "headings", F.col("kind") == "heading")
    heads = rows.where("kind = 'heading'").select((F.col("headings") + 1).alias("n"), (part(heading, 1) == "data race").alias("race"))
    rows = summed(rows, "earlier", F.when(F.col("kind") == "mutex", 1).when(F.col("kind") == "access", 2)).withColumn("seq", F.col("earlier") + 1)
    names = rows.where("name is not null").groupBy("name").agg(F.min("ord").alias("first"))
    numbered = names.select(F.col("name").alias("known"), "first", F.row_number().over(Window.orderBy("first")).cast("long").alias("tid"))  # a row for each thread
    rows = rows.join(numbered, F.col("name") == F.col("known")).join(heads, F.col("headings") == F.col("n"), "left")
    seen, locked = rows.where("kind = 'access'"), rows.where("kind = 'mutex'")
    at = F.when(F.col("kind") == "access", _hex("line", access, 2)).otherwise(_hex("line", mutex, 1))
    at = wrapped(at) - base
    taken = _table("SYNC_EVENTS", seen, step=F.col("seq") + 1, thread_id=F.col("tid"), sync_type=F.lit("MutexLock"), sync_object_addr=at, result=F.when(F.coalesce("race", F.lit(False)), "Contended").otherwise("Success"))
    done = F.concat(F.lit("Mutex"), labelled(part(mutex, 2), MUTEX_REPORTS))
    zero = F.lit(0)
    none = lines.sparkSession.range(1).select(F.lit("T1").alias("known"), F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("tid")).join(numbered.limit(1).select("tid").withColumnRenamed("tid", "any"), how="left").where("any is null").drop("any")
    own = numbered.unionByName(none).withColumn("ord", F.col("first"))
    return {
        "threads": _table("THREADS", own, thread_id=F.col("tid"), parent_thread_id=zero, create_step=zero, stack_base=zero, stack_size=zero, tls_addr=zero, is_jni_attached=F.lit(False)),
        "memory_reads": _table("MEMORY_READS", seen, step=F.col("seq"), thread_id=F.col("tid"), address=at, size=part(access, 1).cast("long")),
        "sync_events": taken.unionByName(_table("SYNC_EVENTS", locked, step=F.col("seq"), thread_id=F.col("tid"), sync_type=done, sync_object_addr=at, result=F.lit("Success"))),
    }


def read_translation_log(lines: DataFrame, base: int = 0, size: int = 0) -> dict[str, DataFrame]:
    """An emulator's log of translated blocks, "0x401000:  d10083ff  sub sp, sp, #32" below "IN:", and of executed ones, "Trace 0x.. [401000]".

    A block begins behind a heading, and where an address is below the block's first; of blocks that
    begin alike the last counts. With executed blocks their instructions follow one another as they ran,
    blocks that were not logged left out; without, blocks are in order of address. Steps count from
    1, as thread 1. With base, only addresses from base on, and with size below base + size, count,
    relative to base.
    """
    code, ran = r"^(0x[0-9a-fA-F]+):\s+[0-9a-fA-F]+\s+(.+)", r"^Trace\s+\S+\s+\[([0-9a-fA-F]+)\]"
    kind = F.when(F.col("line").rlike(ran), "run").when(F.col("line").rlike(code), "code").when(F.col("line").rlike("^(IN:|----)"), "head")
    rows = counted(once(lines, "kind", kind).where("kind is not null"), "group", F.col("kind") == "head")
    found = rows.where("kind = 'code'").withColumns({"at": ordered(wrapped(parse_addr(F.regexp_extract("line", code, 1)))), "word": F.lower(F.regexp_extract("line", code, 2))})
    # A block's first address is the lowest so far below its heading.
    begun = found.withColumn("start", F.min("at").over(Window.partitionBy("group").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    each = begun.groupBy("start", "group").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", "at", "word"))).alias("codes"))
    blocks = each.groupBy("start").agg(F.max_by(F.struct("codes", "ord"), "group").alias("last")).select("start", F.col("last.ord").alias("ord"), F.col("last.codes").alias("codes"))
    low, high = base - (1 << 63), base + size - (1 << 63)
    if base:
        blocks = blocks.withColumn("codes", F.filter("codes", lambda c: (c["at"] >= low) & (c["at"] < high) if size else c["at"] >= low))
    runs = rows.where("kind = 'run'").select("ord", "part", ordered(wrapped(_hex("line", ran))).alias("of"))
    if runs.isEmpty():
        sized = blocks.withColumn("n", F.size("codes"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
        told = sized.select("codes", before.alias("earlier"))
    else:
        told = summed(runs.join(blocks.select("start", "codes"), F.col("of") == F.col("start")), "earlier", F.size("codes")).select("codes", "earlier")
    steps = told.select("earlier", F.posexplode("codes").alias("k", "c")).withColumn("seq", F.col("earlier") + F.col("k") + 1).withColumn("ord", F.col("seq"))
    branch = F.regexp_replace(F.regexp_extract("c.word", r"^\S+", 0), r"\.+$", "").isin(*TRANSLATED_BRANCHES)
    tables = {"instructions": _table("INSTRUCTIONS", steps, seq=F.col("seq"), thread_id=F.lit(1), address=ordered(F.col("c.at")) - base, is_branch=branch, branch_taken=F.lit(False))}
    return tables | {"threads": announced(tables, at_start=True)}


def read_profile(lines: DataFrame) -> dict[str, DataFrame]:
    """A call-graph profile: "fn=.." begins a function, "1a2b 3 4" is an address with costs, "calls=2 1010" tells that the next one is a call's.

    An address with costs is a step, counted from 1 as thread 1: an instruction, or a call to the address told
    right before it, from the function's first instruction address above (0 without one). "fn=" and "cfn=" take
    back what "calls=" told. Relative addresses ("+3", "*") are passed over.
    """
    cost, told = r"^([0-9a-fA-F]{1,16})\s+\d", r"^calls=\S*\s+(?:0[xX])?([0-9a-fA-F]{1,16})(?:\s|$)"
    kind = F.when(F.col("line").startswith("fn="), "fn").when(F.col("line").startswith("cfn="), "cfn").when(F.col("line").rlike(r"^calls=\S*\s"), "calls").when(F.col("line").rlike(cost), "cost")
    rows = once(lines, "kind", kind).where("kind is not null")
    rows = once(rows, "at", wrapped(F.when(F.col("kind") == "cost", _hex("line", cost)).when(F.col("kind") == "calls", _hex("line", told))))
    rows = counted(counted(rows, "n", F.col("kind") == "cost"), "heads", F.col("kind") != "cost").withColumn("seq", F.col("n") + 1)
    rows = counted(rows, "functions", F.col("kind") == "fn")
    costs = rows.where("kind = 'cost'").select("ord", "part", "seq", "at", "heads", "functions")
    targets = rows.where("kind = 'calls' and at <> 0").select((F.col("heads") + 1).alias("head"), F.col("at").alias("callee"))
    firsts = costs.groupBy(F.col("heads").alias("of")).agg(F.min("ord").alias("first")).join(targets, F.col("of") == F.col("head")).select("first", "callee")
    costs = costs.join(firsts, F.col("ord") == F.col("first"), "left")
    run = costs.where("callee is null")
    entries = run.where("at <> 0").groupBy(F.col("functions").alias("function")).agg(F.min(F.struct("seq", "at")).alias("entry"))
    made = costs.where("callee is not null").join(entries, F.col("functions") == F.col("function"), "left")
    caller = F.coalesce(F.when(F.col("entry.seq") < F.col("seq"), F.col("entry.at")), F.lit(0))
    one = F.lit(1)
    tables = {
        "instructions": _table("INSTRUCTIONS", run, seq=F.col("seq"), thread_id=one, address=F.col("at"), is_branch=F.lit(False), branch_taken=F.lit(False)),
        "calls": _table("CALLS", made, id=F.lit(0), thread_id=one, event_type=F.lit("Call"), caller_address=caller, callee_address=F.col("callee"), seq=F.col("seq"), depth=F.lit(0)),
    }
    return tables | {"threads": announced(tables, at_start=True)}


def read_bytecode_listing(lines: DataFrame) -> dict[str, DataFrame]:
    """A listing of bytecode: "Class descriptor : 'La/B;'", "#0 : (in La/B;)", "name : 'f'", "type : '()V'", and below "code -" lines "000abc: 6e10 .. |0000: invoke-static {}, La/B;.f:()V // .." or, below "insns :", "0000: nop".

    An instruction is a step, counted from 1 as thread 1, at its offset within the method; only methods with a class and a
    name count, and what calls or jumps is a branch. A callee goes by the step of its first instruction, 0 if it is not in the
    listing; of methods listed twice the last with code counts.
    """
    part = lambda pattern, k=1: F.regexp_extract("line", pattern, k)
    of_class, of_name, of_type = r"Class descriptor\s*:\s*'L([^;]+);'", r"^name\s*:\s*'([^']+)'", r"^type\s*:\s*'([^']+)'"
    full, plain = r"\|([0-9a-fA-F]{1,8}):\s+(\S+)(.*)", r"^([0-9a-fA-F]{4,8}): (\S+)(.*)"
    line = F.col("line")
    kind = (
        F.when(line.rlike(of_class), "class").when(line.rlike(r"^#\d+\s+:"), "method").when(line.rlike(of_name), "name").when(line.rlike(of_type), "type")
        .when(line.rlike(r"^code\s+-$"), "code").when(line.rlike(r"^code\s*:\s*\(none\)|^catches\s*:"), "over").when(line.rlike(r"^insns\s*:"), "insns").when(line.rlike(full), "full").when(line.rlike(plain), "plain")
    )
    rows = once(lines, "kind", kind).where("kind is not null")
    text = F.when(F.col("kind") == "class", part(of_class)).when(F.col("kind") == "name", part(of_name)).when(F.col("kind") == "type", part(of_type))
    rows = once(rows, "text", text)
    # Methods and classes by the number of their headings; a class ends a method too.
    rows = counted(rows, "m", F.col("kind").isin("class", "method")).withColumn("m", F.col("m") + F.col("kind").isin("class", "method").cast("int"))
    rows = counted(rows, "c", F.col("kind") == "class")
    classes = rows.where("kind = 'class'").select((F.col("c") + 1).alias("class"), F.col("text").alias("of"))
    last = lambda k: F.max(F.when(F.col("kind") == k, F.struct("ord", "text")))["text"]
    methods = rows.groupBy("m").agg(last("name").alias("name"), F.coalesce(last("type"), F.lit("")).alias("type"), F.max("c").alias("class")).where("name is not null").join(classes, "class")
    methods = methods.select(F.col("m").alias("method"), F.concat("of", F.lit("->"), "name", "type").alias("full_name"))
    # What is code: behind "code -" up to its end; "insns :" opens the plain form until the next method or code.
    switch = rows.where(F.col("kind").isin("code", "over", "insns")).groupBy("m").agg(F.sort_array(F.collect_list(F.struct("ord", "kind"))).alias("marks"))
    found = rows.where("kind in ('full', 'plain')").join(methods, F.col("m") == F.col("method")).join(switch.withColumnRenamed("m", "marked"), F.col("m") == F.col("marked"))
    earlier = F.filter("marks", lambda x: x["ord"] < F.col("ord"))
    state = F.aggregate(earlier, F.lit(""), lambda now, x: F.when(x["kind"] == "code", "code").when(x["kind"] == "over", "").when((now != "") & (x["kind"] == "insns"), "insns").otherwise(now))
    found = once(found, "state", state).where("state = 'insns' or (state = 'code' and kind = 'full')")
    form = lambda k: F.when(F.col("kind") == "full", part(full, k)).otherwise(part(plain, k))
    found = once(once(once(found, "at", F.conv(form(1), 16, 10).cast("long")), "opcode", F.lower(form(2))), "operands", F.trim(F.regexp_replace(form(3), r"\s*//.*$", "")))
    found = counted(found.select("ord", "part", "full_name", "at", "opcode", "operands", "method"), "n", F.lit(True)).withColumn("seq", F.col("n") + 1)
    starts = found.groupBy("full_name", "method").agg(F.min("seq").alias("start")).groupBy(F.col("full_name").alias("callee")).agg(F.max_by("start", "method").alias("start"))
    target = r"L([^;]+);->([^(]+)(\([^)]*\)\S+)"
    invoked = found.where(F.col("opcode").isin(*INVOKES)).withColumn("wanted", F.concat(F.regexp_extract("operands", target, 1), F.lit("->"), F.regexp_extract("operands", target, 2), F.regexp_extract("operands", target, 3)))
    invoked = invoked.join(starts, F.col("wanted") == F.col("callee"), "left")
    one = F.lit(1)
    threads = lines.sparkSession.range(1).select(F.lit(0).cast("long").alias("ord"))
    zero = F.lit(0)
    return {
        "instructions": _table("INSTRUCTIONS", found, seq=F.col("seq"), thread_id=one, address=F.col("at"), is_branch=F.col("opcode").isin(*INVOKES, *BYTECODE_BRANCHES), branch_taken=F.lit(False)),
        "calls": _table("CALLS", invoked, id=zero, thread_id=one, event_type=F.lit("Call"), caller_address=F.col("at"), callee_address=F.coalesce("start", zero), seq=F.col("seq"), depth=zero),
        "threads": _table("THREADS", threads, thread_id=one, parent_thread_id=zero, create_step=zero, stack_base=zero, stack_size=zero, tls_addr=zero, is_jni_attached=F.lit(False)),
    }


READERS = {
    "memory-checker": read_memory_checker, "calls-log": read_calls_log, "listing": read_listing, "samples": read_samples, "race-report": read_race_report, "translation-log": read_translation_log,
    "profile": read_profile, "bytecode-listing": read_bytecode_listing,
}
#: The same by the names of tools that write so.
READERS |= {
    "lackey": read_memory_checker, "strace": read_calls_log, "ltrace": read_calls_log, "objdump": read_listing, "perf-script": read_samples, "tsan": read_race_report, "qemu": read_translation_log,
    "callgrind": read_profile, "dexdump": read_bytecode_listing,
}
