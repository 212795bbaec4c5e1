"""Plain-text traces of instrumentation tools, read by patterns.

Every reader gives event tables and "skipped", the number of lines that gave no event. Steps
count the events of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import little_endian, parse_addr, to_so_offset, wrapped
from .jsonl import _small, _table
from .lines import announced, counted, once, without_comments

# What marks a branch, a read and a write.
BRANCH_WORDS = ("branch", "call", "ret", "return", "jmp", "jmpq", "je", "jne", "jz", "jnz", "jb", "ja", "jl", "jg", "jle", "jge", "callq", "retq")
READ_WORDS, WRITE_WORDS = ("read", "r", "load"), ("write", "w", "store")


def _tokens(rows: DataFrame) -> DataFrame:
    rows = once(rows, "tokens", F.split("line", r"\s+"))
    return once(rows, "low", F.transform("tokens", F.lower))


def _all_once(rows: DataFrame, **columns: Column) -> DataFrame:
    for name, value in columns.items():
        rows = once(rows, name, value)
    return rows


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, ":+$", "")


def _hex(token: Column) -> Column:
    return F.when(_bare(token).rlike("^0[xX]"), parse_addr(_bare(token)))


def _any_number(token: Column) -> Column:
    return F.when(~_bare(token).startswith("-"), parse_addr(_bare(token)))


def _after(*keys: str) -> Column:
    """The token after the first of the keys."""
    at = F.array_min(F.filter(F.array(*(F.array_position("low", k) for k in keys)), lambda p: p > 0))
    return F.get("tokens", at.cast("int"))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _access(found: Column) -> Column:
    """Whether the first word of the kind says write; null without one."""
    return _first(F.transform(found, lambda t: F.when(t.isin(*READ_WORDS), False).when(t.isin(*WRITE_WORDS), True)))


def _numbered(rows: DataFrame) -> DataFrame:
    return counted(rows, "seq", F.lit(True))


def _skipped(lines: DataFrame, used: DataFrame) -> DataFrame:
    return lines.join(used.select("ord").distinct(), "ord", "left_anti").agg(F.count(F.lit(1)).alias("skipped"))


def _memory(rows: DataFrame, base: int) -> dict[str, DataFrame]:
    """Tables of reads and writes from rows with tid, is_write, address, size."""
    at = to_so_offset(F.col("address"), base)
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int")))
    return {
        "memory_writes": _table("MEMORY_WRITES", rows.where("is_write"), step=F.col("seq"), thread_id=F.col("tid"), address=at, data=zeros),
        "memory_reads": _table("MEMORY_READS", rows.where("not is_write"), step=F.col("seq"), thread_id=F.col("tid"), address=at, size=F.col("size")),
    }


def _leading_tid() -> Column:
    paired = F.when(F.exists("low", lambda t: t.isin("tid", "thread", "tid:")), _any_number(_after("tid", "thread", "tid:")))
    return _small(F.coalesce(paired, F.when(~F.exists("low", lambda t: t.isin("tid", "thread", "tid:")), _any_number(F.get("tokens", F.lit(0))))))


def read_instruction_trace(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """Lines "tid 7 pc 0x1000 [mnemonic] [taken]" or "7 0x1000".

    Without a pc key the first hex token that is not the thread's number is the address. What
    follows the pc is kept as opcode text. Threads begin at step 0.
    """
    lines = without_comments(lines, "#", "//")
    rows = once(_tokens(lines), "tid", _leading_tid())
    keyed = F.exists("low", lambda t: t.isin("pc", "pc:", "addr", "address"))
    loose = _first(F.filter(F.transform("tokens", _hex), lambda v: v != F.col("tid")))
    rows = once(rows, "address", F.when(keyed, _any_number(_after("pc", "pc:", "addr", "address"))).otherwise(loose)).where("tid is not null and address is not null")
    branch = F.exists("low", lambda t: t.isin(*BRANCH_WORDS))
    place = F.array_min(F.filter(F.array(F.array_position("low", "pc"), F.array_position("low", "addr")), lambda p: p > 0)).cast("int")
    rest = F.array_join(F.slice("tokens", F.coalesce(place, F.lit(1)) + 2, F.size("tokens")), " ")
    rows = _numbered(rows.withColumn("opcode", F.when(place.isNotNull() & (rest != ""), rest.cast("binary"))))
    tables = {
        "instructions": _table(
            "INSTRUCTIONS", rows, seq=F.col("seq"), thread_id=F.col("tid"), address=to_so_offset(F.col("address"), base), is_branch=branch, branch_taken=branch & F.array_contains("low", "taken"), opcode=F.col("opcode")
        )
    }
    return tables | {"threads": announced(tables, at_start=True), "skipped": _skipped(lines, rows)}


def read_memory_trace(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """Lines "tid 7 write 0x2000 8": the address is the first hex token, the size follows "size" or is the last number."""
    lines = without_comments(lines, "#", "//")
    rows = once(_tokens(lines), "tid", _leading_tid())
    sized = F.exists("low", lambda t: t.isin("size", "size:", "len"))
    last = F.element_at(F.concat(F.array(F.lit(None).cast("decimal(20,0)")), F.filter(F.transform("tokens", _any_number), lambda v: v.isNotNull())), -1)
    rows = _all_once(
        rows, is_write=_access(F.col("low")), address=_first(F.filter(F.transform("tokens", _hex), lambda v: v != F.col("tid"))), size=F.when(sized, _any_number(_after("size", "size:", "len"))).otherwise(last)
    )
    rows = _numbered(rows.where("tid is not null and is_write is not null and address is not null and size is not null"))
    tables = _memory(rows, base)
    return tables | {"threads": announced(tables, at_start=True), "skipped": _skipped(lines, rows)}


def _hex_tid(text: Column) -> Column:
    bare = F.regexp_replace(_bare(F.trim(text)), "^0[xX]", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{1,8}$"), F.conv(bare, 16, 10).cast("long"))


def read_access_trace(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """Lines "1f4: read 0x7fff": the thread in hex; every access has size 1."""
    lines = without_comments(lines, "#", "//")
    rows = once(lines, "tid", F.when(F.col("line").contains(":"), _hex_tid(F.regexp_extract("line", "^([^:]*):", 1))))
    rows = _tokens(rows.withColumn("line", F.trim(F.regexp_replace("line", "^[^:]*:", ""))))
    rows = _all_once(rows, is_write=_access(F.col("low")), address=_first(F.transform("tokens", _hex)), size=F.lit(1))
    rows = _numbered(rows.where("tid is not null and is_write is not null and address is not null"))
    tables = _memory(rows, base)
    return tables | {"threads": announced(tables, zero=True), "skipped": _skipped(lines, rows)}


def read_call_trace(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """Lines "tid 1f4 call 0xcaller 0xcallee": hex tokens that equal the thread are passed over; "ret" makes a return."""
    lines = without_comments(lines, "#", "//")
    rows = once(_tokens(lines), "tid", F.when(F.array_contains("low", "tid"), _hex_tid(_after("tid"))))
    rows = once(rows, "addresses", F.filter(F.transform("tokens", _hex), lambda v: v.isNotNull() & (v != F.col("tid")))).where("tid is not null and size(addresses) > 0")
    rows = _numbered(rows)
    kind = F.when(F.lower("line").contains("ret"), "Return").otherwise("Call")
    callee = F.coalesce(F.get("addresses", F.lit(1)), F.lit(0).cast("decimal(20,0)"))
    tables = {
        "calls": _table(
            "CALLS", rows, id=F.lit(0), thread_id=F.col("tid"), event_type=kind, caller_address=to_so_offset(F.get("addresses", F.lit(0)), base), callee_address=to_so_offset(callee, base), seq=F.col("seq"), depth=F.lit(0)
        )
    }
    return tables | {"threads": announced(tables, zero=True), "skipped": _skipped(lines, rows)}


def read_emulator_text(lines: DataFrame, base: int = 0) -> dict[str, DataFrame]:
    """An emulator's console: memory accesses, "call 0x.. -> 0x.." and "0xaddr: disassembly".

    The thread follows "tid" or is 1. Written bytes are the value's lowest, at most eight, or zeros
    without a value. A mnemonic that begins with b, or ret, is a branch.
    """
    lines = without_comments(lines, "#", "//")
    rows = _tokens(lines)
    tid = F.coalesce(_small(parse_addr(F.regexp_extract("line", r"(?i)(?:^|\s)(?:tid|thread_id):*\s+(0x[0-9a-f]+|\d+)", 1))), F.lit(1))
    low = F.lower("line")
    digits = lambda mark: parse_addr(F.regexp_extract("line", rf"(?i){mark}.*?(0x[0-9a-f]+)", 1))
    size = parse_addr(F.regexp_extract("line", r"(?i)data size[^0-9a-fx]*(0x[0-9a-f]+|\d+)", 1))
    pairs = F.transform(F.regexp_extract_all("line", F.lit("(?i)0x[0-9a-f]+"), F.lit(0)), parse_addr)
    is_memory, is_call = low.rlike("memory (read|write)"), low.rlike(r"(^| )(call|return) ") & (F.size(pairs) >= 2)
    pc = parse_addr(F.regexp_extract("line", r"(0[xX][0-9a-fA-F]+|\d+)[^0-9a-fA-FxX\s]*\s*:", 1))
    code = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    kind = (
        F.when(is_memory, F.when(digits("at").isNotNull(), F.when(low.contains("memory write"), "write").otherwise("read")))
        .when(is_call, "call")
        .when(pc.isNotNull() & (code != ""), "instruction")
    )
    rows = _all_once(rows, tid=tid, kind=kind, at=digits("at"), size=F.coalesce(size, F.lit(1)).cast("long"), value=digits("data value"), pairs=pairs, pc=pc, code=code)
    rows = _numbered(rows.where("kind is not null"))
    width = F.least("size", F.lit(8))
    data = F.when(F.col("value").isNotNull(), little_endian(wrapped(F.col("value")), width)).otherwise(F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int"))))
    mnemonic = F.lower(F.regexp_extract("code", r"^\S+", 0))
    tables = {
        "instructions": _table("INSTRUCTIONS", rows.where("kind = 'instruction'"), seq=F.col("seq"), thread_id=F.col("tid"), address=to_so_offset(F.col("pc"), base), is_branch=mnemonic.startswith("b") | (mnemonic == "ret"), branch_taken=F.lit(False)),
        "calls": _table(
            "CALLS", rows.where("kind = 'call'"), id=F.lit(0), thread_id=F.col("tid"), event_type=F.when(F.lower("line").contains("return"), "Return").otherwise("Call"),
            caller_address=to_so_offset(F.get("pairs", F.lit(0)), base), callee_address=to_so_offset(F.get("pairs", F.lit(1)), base), seq=F.col("seq"), depth=F.lit(0),
        ),
        "memory_writes": _table("MEMORY_WRITES", rows.where("kind = 'write'"), step=F.col("seq"), thread_id=F.col("tid"), address=to_so_offset(F.col("at"), base), data=data),
        "memory_reads": _table("MEMORY_READS", rows.where("kind = 'read'"), step=F.col("seq"), thread_id=F.col("tid"), address=to_so_offset(F.col("at"), base), size=F.col("size")),
    }
    return tables | {"threads": announced(tables), "skipped": _skipped(lines, rows)}


READERS = {
    "dr-cachesim": read_instruction_trace,
    "dr-memtrace": read_memory_trace,
    "pinatrace": read_access_trace,
    "pin-calls": read_call_trace,
    "emulator-text": read_emulator_text,
    "unidbg-text": read_emulator_text,
}
