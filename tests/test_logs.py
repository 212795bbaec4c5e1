from tracelake.sources import lines, logs


def got(tables, name, *columns):
    return [tuple(r[c] for c in columns) for r in tables[name].orderBy("ord", *columns).collect()]


def test_memory_checker(spark):
    told = ["==12== lackey", "I  04000,3", "==12==  L 1ffe,8", " S 1fff,16", " M 2000,4", "junk"]
    found = logs.read_memory_checker(lines.from_texts(spark, told))
    assert got(found, "instructions", "seq", "address") == [(1, 0x4000)]
    assert got(found, "memory_reads", "step", "address", "size") == [(2, 0x1FFE, 8), (4, 0x2000, 4)]
    assert [(s, len(d)) for s, d in got(found, "memory_writes", "step", "data")] == [(3, 8), (4, 4)]
    near = logs.read_memory_checker(lines.from_texts(spark, told), 0x1FFF, 2)
    assert got(near, "memory_writes", "step", "address") == [(1, 0), (2, 1)]


def test_calls_log(spark):
    told = [
        "100 12:00:00.1 futex(0x7f00, FUTEX_WAIT_PRIVATE, 2, NULL) = 0 <0.000123>",
        "100 12:00:00.2 clone(child_stack=0x9000, flags=CLONE_VM) = 101",
        "[pid 101] libpthread.so.0->pthread_mutex_trylock(0x50, 1) = 16",
        "[pid 101] pthread_mutex_unlock(0x50) = 0",
        "mmap(NULL, 4096, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f1000",
        "100 12:00:00.3 futex(0x7f00, FUTEX_WAKE, 1) = 1 <unfinished ...>",
        "100 12:00:00.3 read(3, 0x1, 5) = 5",
    ]
    found = logs.read_calls_log(lines.from_texts(spark, told))
    assert got(found, "sync_events", "step", "thread_id", "sync_type", "sync_object_addr", "result", "wait_duration_ns") == [
        (1, 100, "FutexWait", 0x7F00, "Success", 123_000), (3, 101, "MutexTryLock", 0x50, "WouldBlock", None), (4, 101, "MutexUnlock", 0x50, "Success", None),
    ]
    assert got(found, "memory_reads", "step", "thread_id", "address", "size") == [(5, 1, 0x7F1000, 4096)]
    assert {(t, p) for t, p in got(found, "threads", "thread_id", "parent_thread_id")} == {(100, 0), (101, 100), (1, 0)}


def test_listing(spark):
    told = ["0000000000001000 <main>:", "    1000:\t94000004 \tbl\t1010 <helper>", "    1004:\td65f03c0 \tret", "0000000000001010 <helper>:", "    1010:\t55                   \tpush   %rbp", "    1011:\te8 00 00 00 00       \tcallq  1000 <main>"]
    found = logs.read_listing(lines.from_texts(spark, told))
    assert got(found, "instructions", "seq", "address", "is_branch") == [(1, 0x1000, True), (2, 0x1004, True), (3, 0x1010, False), (4, 0x1011, True)]
    assert got(found, "calls", "seq", "caller_address", "callee_address") == [(1, 0x1000, 0x1010), (4, 0x1011, 0x1000)]
    assert got(found, "functions", "offset", "name") == [(0x1000, "main"), (0x1010, "helper")]


def test_samples(spark):
    told = ["prog 7 1.5:  10 cycles:", "  30 c+0x1 (lib)", "  20 b (lib)", "  10 a (lib)", "", "prog 8 1.6:  10 cycles:", "  40 d (lib)", "", "prog 7 1.7:  10 cycles:", "  30 c (lib)", "  ff [unknown] ([unknown])", "  10 a (lib)"]
    found = logs.read_samples(lines.from_texts(spark, told))
    assert got(found, "calls", "seq", "thread_id", "caller_address", "callee_address", "depth") == [(1, 7, 0x10, 0x20, 0), (2, 7, 0x20, 0x30, 1), (4, 7, 0x10, 0x30, 0)]
    assert sorted(got(found, "instructions", "seq", "thread_id", "address")) == [(1, 7, 0x10), (1, 7, 0x20), (1, 7, 0x30), (3, 8, 0x40)]
    assert sorted(got(found, "threads", "thread_id", "create_step")) == [(7, 0), (8, 3)]


def test_race_report(spark):
    told = [
        "==================", "WARNING: ThreadSanitizer: data race (pid=9)", "  Write of size 8 at 0x7b04 by thread T2:", "    #0 f (a.out+0x1)", "  Previous read of size 4 at 0x7b00 by thread T1 (mutexes: write M1):",
        "  Mutex M1 (0x50) created by thread T1:", "  Thread T3 (tid=12, running) created by main thread at:", "WARNING: ThreadSanitizer: thread leak (pid=9)", "  Read of size 1 at 0xffffffffffffff00 by thread T3:",
    ]
    found = logs.read_race_report(lines.from_texts(spark, told))
    assert got(found, "memory_reads", "step", "thread_id", "address", "size") == [(1, 1, 0x7B04, 8), (3, 2, 0x7B00, 4), (6, 3, -256, 1)]
    assert got(found, "sync_events", "step", "thread_id", "sync_type", "sync_object_addr", "result") == [
        (2, 1, "MutexLock", 0x7B04, "Contended"), (4, 2, "MutexLock", 0x7B00, "Contended"), (5, 2, "MutexCreate", 0x50, "Success"), (7, 3, "MutexLock", -256, "Success"),
    ]
    assert [t for (t,) in got(found, "threads", "thread_id")] == [1, 2, 3]
    assert got(logs.read_race_report(lines.from_texts(spark, ["nothing"])), "threads", "thread_id") == [(1,)]


def test_translation_log(spark):
    block = ["IN: main", "0x0000000000401000:  d10083ff  sub sp, sp, #0x20", "0x0000000000401004:  94000000  bl #0x400ff0"]
    other = ["----------------", "0x0000000000400ff0:  d65f03c0  ret", "0x0000000000400fe0:  d503201f  nop"]
    found = logs.read_translation_log(lines.from_texts(spark, [*block, *other]))
    assert got(found, "instructions", "seq", "address", "is_branch") == [(1, 0x400FE0, False), (2, 0x400FF0, True), (3, 0x401000, False), (4, 0x401004, True)]
    ran = ["Trace 0x1 [0000000000401000] main", "Trace 0x2 [0000000000400ff0]", "Trace 0x3 [00000000deadbeef]", "Trace 0x1 [0000000000401000] main"]
    found = logs.READERS["qemu"](lines.from_texts(spark, [*block, ran[0], *other, *ran[1:]]), 0x400FF0, 0x14)
    assert got(found, "instructions", "seq", "thread_id", "address") == [(1, 1, 0x10), (2, 1, 0), (3, 1, 0x10)]


def test_profile(spark):
    told = ["version: 1", "fn=(1) main", "1000 3", "1004 1", "cfn=(2)", "calls=2 0x1010", "1008 9", "100c 1", "calls=1 2000", "fn=(2) helper", "calls=1 1000", "1010 5", "1014 2", "calls=1 +3", "1018 1", "* 4", "cfn=(1)", "calls=1 ffffffff81000000", "ffffffff81000010 4 4"]
    found = logs.read_profile(lines.from_texts(spark, told))
    assert got(found, "instructions", "seq", "address") == [(1, 0x1000), (2, 0x1004), (4, 0x100C), (6, 0x1014), (7, 0x1018)]
    assert got(found, "calls", "seq", "caller_address", "callee_address") == [(3, 0x1000, 0x1010), (5, 0, 0x1000), (8, 0x1014, 0xFFFFFFFF81000000 - (1 << 64))]
    assert got(found, "threads", "thread_id", "create_step") == [(1, 0)]
    assert logs.read_profile(lines.from_texts(spark, ["fn=x"]))["calls"].count() == 0


def test_bytecode_listing(spark):
    told = [
        "Class #0 -", "  Class descriptor  : 'La/B;'", "    #0              : (in La/B;)", "      name          : 'f'", "      type          : '()V'", "      access        : 0x0009 (PUBLIC STATIC)", "      code          -",
        "000158:                                        |[000158] a.B.f:()V", "000168: 7100 0100 0000                         |0000: invoke-static {}, La/B;->g(I)V // method@0001", "00016e: 0e00                                   |0003: return-void", "      catches       : (none)", "0001: nop",
        "    #1              : (in La/B;)", "      name          : 'n'", "      type          : '()V'", "      code          : (none)", "    #2              : (in La/B;)", "      name          : 'g'", "      type          : '(I)V'", "      code          -", "      insns         :",
        "        0000: const/4 v0, #int 0", "        0001: invoke-virtual/range {v0}, Lx/Y;->h()I",
    ]
    found = logs.READERS["dexdump"](lines.from_texts(spark, told))
    assert got(found, "instructions", "seq", "address", "is_branch") == [(1, 0, True), (2, 3, True), (3, 0, False), (4, 1, True)]
    assert got(found, "calls", "seq", "caller_address", "callee_address") == [(1, 0, 3), (4, 1, 0)]
    assert got(found, "threads", "thread_id") == [(1,)]
    assert logs.read_bytecode_listing(lines.from_texts(spark, ["name : 'f'"]))["instructions"].count() == 0


def test_kernel_addresses_in_logs(spark):
    high = 0xFFFFFFFF81000000 - (1 << 64)
    samples = logs.read_samples(lines.from_texts(spark, ["prog 7 1.5:  10 cycles:", "  ffffffff81000000 b (kernel)", "  10 a (lib)"]))
    assert got(samples, "calls", "caller_address", "callee_address") == [(0x10, high)]
    listing = logs.read_listing(lines.from_texts(spark, ["ffffffff81000000 <start>:", "ffffffff81000000:\t55                   \tpush   %rbp"]))
    assert got(listing, "instructions", "address") == got(listing, "functions", "offset") == [(high,)]
    near = logs.read_memory_checker(lines.from_texts(spark, [" L ffffffff81000008,8", " L 10,8"]), 0xFFFFFFFF81000000, 16)
    assert got(near, "memory_reads", "step", "address") == [(1, 8)]
