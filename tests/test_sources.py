import json
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.functions.scalars import hex_text, little_endian, page_align, page_offset, parse_addr, to_so_offset
from tracelake.sources import elf, envelope, generator, jsonl, lines, text


def collected(tables, name):
    return [r.asDict() for r in tables[name].orderBy("ord").collect()]


def test_scalars(spark):
    texts = ["0x10", "16", "-1", "0xffffffffffffffff", "zz", "", None, "18446744073709551616", "-9223372036854775808"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.v is None else int(r.v) for r in rows.select(parse_addr(rows.t).alias("v")).collect()]
    assert got == [16, 16, (1 << 64) - 1, (1 << 64) - 1, None, None, None, None, 1 << 63]
    row = spark.range(1).selectExpr("5000L as a", "258L as b")
    one = row.select(page_align(row.a), page_offset(row.a), hex_text(row.a), to_so_offset(row.a, 4000), to_so_offset(row.a, 6000), little_endian(row.b, 2), to_so_offset(row.a, 0)).first()
    assert tuple(one) == (4096, 904, "0x1388", 1000, 5000, bytearray(b"\x02\x01"), 5000)


def brute_seq(given):
    """Numbers as a counter hands them out."""
    out, following = [], 0
    for seq in given:
        seq = following if seq is None else seq
        following = max(following, seq + 1)
        out.append(seq)
    return out


def test_allocated_numbers_across_parts(spark):
    given = [None, 5, None, 3, None, None, 20, None, 7, None, None]
    rows = spark.createDataFrame([(k, k // 3, g) for k, g in enumerate(given)], "ord long, part long, g long")
    got = lines.allocated(rows, rows.g).orderBy("ord").collect()
    assert [r.seq for r in got] == brute_seq(given)
    assert [r.n for r in lines.counted(rows, "n", rows.g.isNull()).orderBy("ord").collect()] == [sum(g is None for g in given[:k]) for k in range(len(given))]


def test_hook_lines(spark):
    told = [
        '{"type":"inst","tid":7,"pc":"0x1004","is_branch":true}',
        "// a remark",
        '{"type":"send","payload":{"type":"call","tid":7,"from":1,"to":"0x2000","depth":2}}',
        "{broken",
        '{"type":"memwrite","tid":8,"addr":"0x1010","value":258}',
        '{"type":"write","thread_id":8,"address":4,"data":[1,255]}',
        '{"type":"sync","tid":7,"op":"lock","addr":9,"result":"retry"}',
        '{"type":"sync","tid":7,"op":"unlock","addr":9,"seq":50}',
        '{"type":"switch","tid":8,"from":7,"reason":"nonsense"}',
        '{"type":"switch","tid":9,"from":7}',
        '{"type":"memread","tid":0,"address":4}',
        '{"type":"async","payload":[{"tid":5,"type":"J2N","class":"A","method":"f"},{"tid":5,"direction":"n2j"}]}',
        '{"type":"thread","tid":11,"name":"late","create_step":3}',
        '{"type":"what","tid":1}',
    ]
    got = jsonl.read_hooks(lines.from_texts(spark, told), "jnitrace", base=0x1000)
    assert [(r["seq"], r["address"], r["is_branch"]) for r in collected(got, "instructions")] == [(0, 4, True)]
    assert [(r["seq"], r["caller_address"], r["callee_address"], r["event_type"]) for r in collected(got, "calls")] == [(1, 1, 0x1000, "Call")]
    assert [(r["step"], r["address"], bytes(r["data"])) for r in collected(got, "memory_writes")] == [(2, 16, b"\x02\x01" + bytes(6)), (3, 4, b"\x01\xff")]
    assert [(r["step"], r["sync_type"], r["result"]) for r in collected(got, "sync_events")] == [(4, "MutexLock", "Error"), (50, "MutexUnlock", "Success")]
    # A line that fails after its number was given keeps it.
    assert [(r["step"], r["from_thread"], r["to_thread"], r["switch_reason"]) for r in collected(got, "context_switches")] == [(52, 7, 9, "Other")]
    assert [(r["step"], r["size"]) for r in collected(got, "memory_reads")] == [(53, 1)]
    assert [(r["seq"], r["direction"], r["java_class"]) for r in collected(got, "jni_calls")] == [(54, "JavaToNative", "A"), (55, "NativeToJava", "")]
    assert {(r["thread_id"], r["create_step"]) for r in collected(got, "threads")} == {(7, 0), (8, 2), (9, 52), (5, 54), (11, 3)}
    assert got["skipped"].first().skipped == 3


def test_emulator_lines(spark):
    told = [
        '{"event":"thread-start","seq":4,"tid":7,"name":"main"}',
        "# a remark",
        '{"type":"message","payload":{"kind":"mem.write","tid":7,"addr":"0x10","size":4,"value":"0x0102"}}',
        '{"type":"mem_write","tid":7,"addr":16,"size":1,"data":"aa:bb"}',
        '{"type":"read","tid":7,"addr":16,"data":"0xaabbcc"}',
        '{"type":"sync","tid":7,"op":"rd-lock","object":5,"result":"odd"}',
        '{"type":"sync","tid":7,"op":"rdlock","object":5,"result":"odd"}',
        '{"type":"switch","tid":8,"from":7,"reason":"odd","cpu":"3"}',
        '{"type":"state","tid":8,"state":"waiting for lock"}',
        '{"type":"register","mask":"0x80000000","values":["0xffffffffffffffff",2]}',
        '{"type":"post_call","tid":7,"callee":3}',
        '{"type":"jni","tid":12,"jni_type":"N2J","class":"B"}',
        '{"type":"inst","pc":3}',
    ]
    got = jsonl.read_emulator(lines.from_texts(spark, told))
    assert [(r["step"], bytes(r["data"])) for r in collected(got, "memory_writes")] == [(5, b"\x02\x01\x00\x00"), (6, b"\xaa")]
    assert [(r["step"], r["size"]) for r in collected(got, "memory_reads")] == [(7, 3)]
    assert [(r["step"], r["sync_type"], r["result"]) for r in collected(got, "sync_events")] == [(9, "RwLockRead", "Success")]
    assert [(r["switch_reason"], r["cpu_core"]) for r in collected(got, "context_switches")] == [("Other", 3)]
    assert [r["new_state"] for r in collected(got, "state_changes")] == ["WaitingForLock"]
    assert [(r["change_mask"], r["values"]) for r in collected(got, "register_deltas")] == [(1 << 31, [-1, 2])]
    assert [r["event_type"] for r in collected(got, "calls")] == ["Return"]
    assert {(r["thread_id"], r["is_jni_attached"]) for r in collected(got, "threads")} == {(7, False), (8, False), (12, True)}
    assert got["skipped"].first().skipped == 2


@pytest.mark.parametrize(
    "reader, told, table, want, threads, skipped",
    [
        ("dr-cachesim", ["tid 9 pc 0x1000", "9 0x1004", "tid 9 pc 0x1008 jne taken", "nothing"], "instructions", [(0, 0x1000, False, False), (1, 0x1004, False, False), (2, 0x1008, True, True)], {(9, 0)}, 1),
        ("dr-memtrace", ["tid 7 write 0x20 8", "7 load 0x30 size 0x10", "7 read"], "memory_reads", [(1, 0x30, 16)], {(7, 0)}, 1),
        ("pinatrace", ["1f4: read 0x10", "0x0: W 0x20", "zz: read 0x1"], "memory_reads", [(0, 0x10, 1)], {(0x1F4, 0), (0, 1)}, 1),
        ("pin-calls", ["tid 10 call 0x10 0x100 0x200", "tid 10 ret 0x300", "call 0x1 0x2"], "calls", [(0, 0x100, 0x200, "Call"), (1, 0x300, 0, "Return")], {(16, 0)}, 1),
        ("emulator-text", ["Memory WRITE at 0x10, data size = 2, data value = 0xabcd, PC=0x1", "0x40: bl 0x80", "0x44: nop", "tid 3 call 0x1 -> 0x2", "hm"], "instructions", [(1, 0x40, True, False), (2, 0x44, False, False)], {(1, 0), (3, 3)}, 1),
    ],
)
def test_text_traces(spark, reader, told, table, want, threads, skipped):
    got = text.READERS[reader](lines.from_texts(spark, told))
    columns = {"instructions": ("seq", "address", "is_branch", "branch_taken"), "memory_reads": ("step", "address", "size"), "calls": ("seq", "caller_address", "callee_address", "event_type")}[table]
    assert [tuple(r[c] for c in columns) for r in collected(got, table)] == want
    assert {(r["thread_id"], r["create_step"]) for r in collected(got, "threads")} == threads
    assert got["skipped"].first().skipped == skipped


def test_envelope_round_trip(spark, tmp_path):
    whole = {
        "trace_id": 3,
        "threads": [{"thread_id": 1, "parent_thread_id": 0, "create_step": 0, "name": "w"}],
        "memory_writes": [{"step": 5, "thread_id": 1, "address": 16, "data": [255, 0]}, {"step": 6, "thread_id": 1, "address": 17}],
        "memory_reads": [{"step": 8, "thread_id": 2, "address": 16}],
        "register_deltas": [{"seq": 1, "change_mask": 3, "values": [1, 2]}],
    }
    path = tmp_path / "e.json"
    path.write_text(json.dumps(whole))
    got = envelope.read_envelope(spark, str(path))
    assert [bytes(r["data"]) for r in collected(got, "memory_writes")] == [b"\xff\x00", b""]
    assert [r["size"] for r in collected(got, "memory_reads")] == [1]
    assert got["calls"].count() == 0
    envelope.to_envelope(got, 3).write.json(str(tmp_path / "out"))
    again = envelope.read_envelope(spark, str(tmp_path / "out"))
    for name in got:
        assert collected(got, name) == collected(again, name)
    path.write_text(json.dumps({"memory_writes": [{"step": 1, "address": 2}]}))
    with pytest.raises(Exception, match="without thread_id"):
        envelope.read_envelope(spark, str(path))["memory_writes"].collect()
    with pytest.raises(Exception, match="trace_id"):
        envelope.read_envelope(spark, str(path), http=True)["memory_writes"].collect()


def small_elf(static: bool) -> bytes:
    names = b"\0Java_a_f\0g\0puts\0"
    symbol = lambda name, info, where, value, size: struct.pack("<IBBHQQ", name, info, 0, where, value, size)
    table = symbol(0, 0, 0, 0, 0) + symbol(1, 0x12, 1, 0x400, 0x20) + symbol(10, 0x02, 1, 0x500, 0x10) + symbol(12, 0x10, 0, 0, 0)
    note = struct.pack("<III", 4, 4, 3) + b"GNU\0" + bytes.fromhex("deadbeef")
    section_names = b"\0.text\0.note.gnu.build-id\0.sym\0.str\0.shstr\0"
    parts = [b"\x90" * 16, note, table, names, section_names]
    at, places = 64 + 56, []
    for part in parts:
        places.append(at)
        at += len(part)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 183, 1, 0, 64, at, 0, 64, 56, 1, 64, 6, 5)
    segment = struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 200, 200, 4096)
    kinds, titles, links = [1, 7, 2 if static else 11, 3, 3], [1, 7, 26, 31, 36], [0, 0, 4, 0, 0]
    sections = bytes(64) + b"".join(struct.pack("<IIQQQQIIQQ", titles[k], kinds[k], 0, 0, places[k], len(parts[k]), links[k], 0, 1, 24 if k == 2 else 0) for k in range(5))
    return head + segment + b"".join(parts) + sections


def test_elf(spark, tmp_path):
    (tmp_path / "a.so").write_bytes(small_elf(True))
    (tmp_path / "b.so").write_bytes(small_elf(False))
    got = {r.path[-4:]: r for r in elf.read_binaries(spark, str(tmp_path)).collect()}
    full, stripped = got["a.so"], got["b.so"]
    assert (full.arch, full.build_id) == ("AArch64", "deadbeef")
    assert [(f.name, f.offset, f.size, f.is_jni, f.is_exported) for f in full.functions] == [("Java_a_f", 0x400, 0x20, True, True), ("g", 0x500, 0x10, False, False)]
    assert [s.seg_type for s in full.segments][:3] == ["Load", "Load", "Note"]
    assert [(f.name, f.size) for f in stripped.functions] == [("Java_a_f", 0)] and [(s.name, s.is_imported) for s in stripped.symbols] == [("Java_a_f", False), ("puts", True)]
    with pytest.raises(ValueError):
        elf.parse(b"MZ")


def test_generator(spark):
    made = generator.mixed_trace(spark, 7, 3)
    assert [made[k].count() for k in ("instructions", "register_deltas", "memory_writes")] == [224, 7, 3]
    assert made["instructions"].where("is_branch").count() == 7 and made["instructions"].select("thread_id").distinct().count() == 3
    assert [r.step for r in made["memory_writes"].orderBy("step").collect()] == [31, 127, 223]


def test_addresses_of_64_bits(spark, tmp_path):
    told = ['{"type":"inst","tid":7,"pc":"0xffffff8000001000"}', '{"type":"memwrite","tid":8,"addr":"18446744073709551615","value":"0xffffffffffffffff"}', '{"type":"inst","tid":7,"pc":"0x1000","seq":1234567890123456789}', '{"type":"inst","tid":7,"pc":"0x1004","seq":99999999999999999999}']
    got = jsonl.read_hooks(lines.from_texts(spark, told), "stalker")
    assert [(r["seq"], r["address"] % (1 << 64)) for r in collected(got, "instructions")] == [(0, 0xFFFFFF8000001000), (1234567890123456789, 0x1000), (1234567890123456790, 0x1004)]
    assert [(r["address"], bytes(r["data"])) for r in collected(got, "memory_writes")] == [(-1, b"\xff" * 8)]
    path = tmp_path / "trace.json"
    whole = {"trace_id": 1, "memory_reads": [{"step": 1, "thread_id": 1, "address": (1 << 64) - 8, "size": 4}], "register_deltas": [{"seq": 1, "change_mask": 1, "values": [(1 << 64) - 1]}]}
    path.write_text(json.dumps(whole))
    tables = envelope.read_envelope(spark, str(path))
    assert tables["memory_reads"].first().address == -8 and tables["register_deltas"].first()["values"] == [-1]
    again = json.loads(envelope.to_envelope({n: tables[n] for n in ("memory_reads", "register_deltas")}, 1).toJSON().first())
    assert again["memory_reads"][0]["address"] == (1 << 64) - 8 and again["register_deltas"][0]["values"] == [(1 << 64) - 1]


def test_many_records_and_deep_messages(spark):
    many = json.dumps({"type": "async", "payload": [{"tid": 5, "type": "J2N", "class": "A", "method": f"m{k}"} for k in range(700)]})
    got = jsonl.read_hooks(lines.from_texts(spark, ["{broken", many, '{"type":"inst","tid":7,"pc":"0x1004"}']), "jnitrace")
    assert [(r["seq"], r["java_method"]) for r in collected(got, "jni_calls")] == [(k, f"m{k}") for k in range(700)]
    assert collected(got, "instructions")[0]["seq"] == 700 and got["skipped"].first().skipped == 1
    message = {"event": "instruction", "tid": 3, "address": "0x40"}
    for _ in range(9):
        message = {"type": "send", "payload": message}
    got = jsonl.read_emulator(lines.from_texts(spark, [json.dumps(message), '{"event":"instruction","tid":3,"address":"0x44"}']))
    assert [r["address"] for r in collected(got, "instructions")] == [0x40, 0x44]


def test_lines_of_several_files_are_in_file_order(spark, tmp_path):
    """The first files are small, and splits are dealt to tasks by size."""
    told = [f"{k} line" for k in range(400)]
    at = 0
    for k, n in enumerate((1, 3, 90, 2, 200, 104)):
        (tmp_path / f"trace.{k}.log").write_text("\n".join(told[at : at + n]) + "\n\n")
        at += n
    rows = lines.read_lines(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.line for r in rows] == told and [r.part for r in rows] == sorted(r.part for r in rows)
    numbered = lines.counted(lines.read_lines(spark, str(tmp_path)), "n", F.lit(True)).collect()
    assert all(r.line == f"{r.n} line" for r in numbered)
