"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text: h = 2 * h + GEAR[byte], in 32 bits, so it depends on
the last 32 bytes. A chunk ends where the upper bits of h are zero, unless they were so within
the SPREAD bytes before, and nowhere inside a character. What has no such place for GAP bytes, as
a word repeated all over, is cut where h is smallest around. All this depends on nearby bytes
only, so boundaries move along with what is inserted before them, and a passage that two documents
share has the same chunks in both but for its first bytes.

Equal digests of chunks are equal chunks; chunks found in two different documents or more that
follow one another make a repeated run. Its ends are extended byte by byte over the equal text
beside them, and then runs of RUN bytes or more are reported.

The first pass counts 64 bits of a digest only, and rows that share them with no other row go no
further. Where a digest is very common its rows are joined to the aggregate's one row, so the
join can be split and no task has to hold them together. Texts are shuffled once, to the places
that are compared, and only the bytes beside those places travel on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable
from .common import discard, materialize, sheltered, table

#: A boundary has this many upper bits zero, and no other such place in the SPREAD bytes before: chunks of about 34 bytes.
CUT_BITS = 4
SPREAD = 12
#: Stretches longer than this are cut where the hash is the smallest of NEAR bytes to both sides.
GAP = 128
NEAR = 32
#: Bytes of a run that is reported, at least: about 25 words.
RUN = 150
#: A run is extended from its outermost stretch of so many bytes that has one and the same first place,
ANCHOR = 24
#: and from the longest of so many outermost stretches.
REACH = 4

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 2024) for b in range(256)], np.uint32)


def rolled(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, for all bytes at once: sums over 1, 2, 4, ... 32 bytes."""
    out = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        out[k:] = out[k:] + (out[:-k] << np.uint32(k))
    return out


def _inner(hashes: np.ndarray, inside: np.ndarray) -> list[int]:
    """Cuts of a stretch: places after the smallest hash of NEAR bytes to both sides, NEAR bytes apart."""
    low = np.where(inside, np.uint32(0xFFFFFFFF), hashes)
    least = low
    for k in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-k], least[k:])
    places = np.flatnonzero(low[NEAR : NEAR + least.size] == least) + NEAR + 1
    out, k = [], 0
    while k < places.size:
        out.append(int(places[k]))
        k = int(np.searchsorted(places, out[-1] + NEAR))
    return out


def boundaries(text: bytes, cut_bits: int = CUT_BITS) -> np.ndarray:
    """Where chunks end, the text's end last."""
    raw = np.frombuffer(text, np.uint8)
    if not raw.size:
        return np.empty(0, np.int64)
    hashes, inside = rolled(raw), (raw & 0xC0) == 0x80
    places = np.flatnonzero(hashes[:-1] >> np.uint32(32 - cut_bits) == 0) + 1
    places = places[~inside[places]]
    ends = np.append(places[np.diff(places, prepend=-SPREAD) >= SPREAD], raw.size)
    begins = np.concatenate(([0], ends[:-1]))
    more = [a + cut for a, b in zip(begins, ends) if b - a > GAP for cut in _inner(hashes[a : b - 1], inside[a + 1 : b])]
    return np.union1d(ends, more).astype(np.int64) if more else ends


def _chunk(cut_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rows in batches:
            for at in range(0, rows.num_rows, 1000):
                part = rows.slice(at, 1000)
                sizes, stops, digests = [], [], []
                for text in part.column(2):
                    text = text.as_py() or b""
                    ends = boundaries(text, cut_bits)
                    cuts = ends.tolist()
                    digests += [digest(text[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]
                    stops.append(ends)
                    sizes.append(ends.size)
                if not digests:
                    continue
                of = np.repeat(np.arange(part.num_rows), sizes)
                end = np.concatenate(stops)
                start = np.concatenate([np.concatenate(([0], s[:-1])) for s in stops if s.size])
                parts = np.frombuffer(b"".join(digests), np.dtype([("d1", "<i8"), ("d2", "<i4"), ("rest", "<i4")]))
                own = [part.column(k).take(pa.array(of)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (start.astype(np.int32), end.astype(np.int32), parts["d1"].copy(), parts["d2"].copy()))], ["doc_id", "doc", "start", "end", "d1", "d2"])

    return run


def _identity(doc_id: str, text: str):
    """What stands for a document: rows with equal doc_id and text are one."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("binary"))


def chunks(docs: DataFrame, cut_bits: int = CUT_BITS) -> DataFrame:
    """(doc_id, doc, start, end, d1, d2): the chunks of each row's text, by bytes of its UTF-8, with 96 bits of digest.

    doc stands for the pair of doc_id and text. Null and empty texts have no chunk.
    """
    reachable(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), _identity("doc_id", "text").alias("doc"), F.col("text").cast("binary"))
    return source.mapInArrow(_chunk(cut_bits), "doc_id long, doc long, start int, end int, d1 long, d2 int")


_PART = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n", pa.int32()), ("own", pa.bool_()), ("keep", pa.int64())])
_ASK = pa.struct([("at", pa.int32()), ("right", pa.bool_()), ("other", pa.int64()), ("place", pa.int32()), ("deep", pa.int32())])
_STRETCHES = (
    "doc long, doc_id long, parts array<struct<start:int,end:int,n:int,own:boolean,keep:long>>, asks array<struct<at:int,right:boolean,other:long,place:int,deep:int>>"
)


def _anchors(sizes: list[int]) -> set[int]:
    """Which of a run's stretches, from an end of it on, to extend that end from."""
    if sum(sizes) < ANCHOR:
        return set()
    longest = max(range(min(REACH, len(sizes))), key=lambda k: sizes[k])
    return {longest, next((k for k, n in enumerate(sizes) if n >= ANCHOR), longest)}


def stretches(shared: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """A document's shared chunks (start, end, own, keep, other, place) in fewer pieces, and what to compare.

    Chunks that follow one another here and at their first place become one part (start, end, n, own,
    keep). An ask (at, right, other, place, deep) is for the bytes beside a place here and beside the
    one in document other; deep of them lie in the run itself.
    """
    parts, offsets = [], []
    for start, end, own, keep, other, place in shared:
        if parts and parts[-1][1] == start and parts[-1][3] == own and offsets[-1] == (other, place - start):
            parts[-1] = (parts[-1][0], end, parts[-1][2] + 1, own, keep)
        else:
            parts.append((start, end, 1, own, keep))
            offsets.append((other, place - start))
    asks, a = [], 0
    for b in range(1, len(parts) + 1):
        if b < len(parts) and parts[b][0] == parts[b - 1][1]:
            continue
        sizes = [p[1] - p[0] for p in parts[a:b]]
        for right, of in ((False, _anchors(sizes)), (True, {len(sizes) - 1 - k for k in _anchors(sizes[::-1])})):
            for k in of:
                at = parts[a + k][1 if right else 0]
                other, offset = offsets[a + k]
                asks.append((at, right, other, at + offset, parts[b - 1][1] - at if right else at - parts[a][0]))
        a = b
    return parts, asks


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "end", "own", "keep", "other", "place")
    for rows in batches:
        for at in range(0, rows.num_rows, 1000):
            part = rows.slice(at, 1000)
            found = []
            for listed in part.column(2):
                each = zip(*(listed.values.field(n).to_pylist() for n in names))
                once = {chunk[0]: chunk for chunk in each}  # a repeated row has its chunks twice
                found.append(stretches([once[k] for k in sorted(once)]))
            lists = [pa.array([[dict(zip(kind.names, x)) for x in f[k]] for f in found], pa.list_(kind)) for k, kind in ((0, _PART), (1, _ASK))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc", "doc_id", "parts", "asks"])


def _beside(cut_bits: int):
    """The bytes beside wanted places, as far as equal ones can reach without making equal chunks.

    Equal bytes over a whole neighbouring chunk and what its boundary depends on, 32 + SPREAD bytes
    before it, would make it a chunk of both texts. A second neighbour is taken as well, for cuts of
    long stretches depend on more.
    """
    margin = 32 + SPREAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                out = []
                for doc, wanted, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    ends = np.concatenate(([0], boundaries(text, cut_bits)))
                    for want in wanted:
                        place = want["place"]
                        if want["right"]:
                            k = min(int(np.searchsorted(ends, place + want["deep"])) + 2, ends.size - 1)
                            beside = text[place : ends[k] + margin]
                            while beside and place + len(beside) < len(text) and text[place + len(beside)] & 0xC0 == 0x80:
                                beside = beside[:-1]
                        else:
                            k = max(int(np.searchsorted(ends, place - want["deep"], "right")) - 3, 0)
                            a = max(int(ends[k]) - margin, 0)
                            while text[a] & 0xC0 == 0x80:
                                a += 1
                            beside = text[a:place]
                        out.append((doc, place, want["right"], beside, want["other"], want["other_place"]))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc", "at", "right", "beside", "other", "place"])

    return run


def equal_bytes(mine: bytes, theirs: bytes, right: bool) -> int:
    """How many bytes of mine agree with theirs from the place between on, whole characters only."""
    n = min(len(mine), len(theirs))
    a, b = (mine[:n], theirs[:n]) if right else (mine[len(mine) - n :][::-1], theirs[len(theirs) - n :][::-1])
    differ = np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)
    n = int(differ.argmax()) if differ.any() else n
    edge = (lambda: n < len(mine) and mine[n]) if right else (lambda: n and mine[len(mine) - n])
    while n and edge() & 0xC0 == 0x80:
        n -= 1
    return n


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = [equal_bytes(*x) for x in zip(*(rows.column(n).to_pylist() for n in ("mine", "theirs", "right")))]
        yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("at"), rows.column("right"), pa.array(found, pa.int32())], ["doc", "at", "right", "n"])


def extended(parts: list[tuple], near: list[tuple]) -> list[tuple]:
    """parts and, beside their runs, the equal bytes that near (at, right, n) tells of, as parts without chunks, in order.

    Bytes equal to those beside a part's first place count as a copy; those beside a part that is in
    its first place are its own, also where they are a copy by another part. An extension ends at
    the next shared chunk; of two that meet in a gap the one to the right goes first.
    """
    begins, ends = {p[0]: k for k, p in enumerate(parts)}, {p[1]: k for k, p in enumerate(parts)}
    reach: dict[tuple[int, bool], tuple] = {}
    for at, right, n in near:
        k = ends[at] if right else begins[at]
        edge, step = k, 1 if right else -1
        while 0 <= edge + step < len(parts) and parts[min(edge, edge + step)][1] == parts[max(edge, edge + step)][0]:
            edge += step
        to = at + n if right else at - n
        beyond = to - parts[edge][1] if right else parts[edge][0] - to
        if beyond > reach.get((edge, right), (0,))[0]:
            reach[edge, right] = (beyond, parts[k][3], parts[k][4])
    out = []
    for k, part in enumerate(parts):
        if (k, False) in reach:
            n, own, keep = reach[k, False]
            start = max(part[0] - n, out[-1][1] if out else 0)
            if start < part[0]:
                out.append((start, part[0], 0, own, keep))
        out.append(part)
        if (k, True) in reach:
            n, own, keep = reach[k, True]
            end = min(part[1] + n, parts[k + 1][0]) if k + 1 < len(parts) else part[1] + n
            out.append((part[1], end, 0, own, keep))
    return out


def verdicts(parts: list[tuple], least: int) -> Iterator[tuple[list[tuple], bool]]:
    """The parts that follow one another over least bytes or more, broken where removed ones begin or end.

    Parts that are a copy are removed if least bytes or more of them follow one another; the rest
    stays, so no part in its first place is ever removed.
    """
    a = 0
    for b in range(1, len(parts) + 1):
        if b < len(parts) and parts[b][0] == parts[b - 1][1]:
            continue
        if parts[b - 1][1] - parts[a][0] >= least:
            kept: list = []
            for own, group in itertools.groupby(parts[a:b], key=lambda p: p[3]):
                group = list(group)
                if own or group[-1][1] - group[0][0] < least:
                    kept += group
                    continue
                if kept:
                    yield kept, False
                yield group, True
                kept = []
            if kept:
                yield kept, False
        a = b


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 1000):
                part = rows.slice(at, 1000)
                out = []
                for doc, doc_id, listed, near in zip(*(part.column(k).to_pylist() for k in range(4))):
                    parts = [tuple(p.values()) for p in listed]
                    for pieces, removed in verdicts(extended(parts, [tuple(x.values()) for x in near or ()]), least):
                        longest = max(pieces, key=lambda p: (p[2] > 0, p[1] - p[0], -p[0]))
                        out.append((doc_id, pieces[0][0], pieces[-1][1], sum(p[2] for p in pieces), longest[4], removed, doc))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "end", "n_chunks", "keep_doc_id", "removed", "doc"])

    return run


def _shared(docs: DataFrame, cut_bits: int) -> DataFrame:
    """(doc, doc_id, parts, asks) of each document with a chunk that another document has too."""
    cut = chunks(docs, cut_bits)
    # Written, so that both sides of the joins are plain shuffles, which can be split where a
    # digest is common.
    often = materialize(cut.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1"), "digests")
    some = materialize(cut.join(often, "d1", "left_semi").select("doc_id", "doc", "start", "end", "d1", "d2"), "chunks")
    discard(often)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "doc", "start")
    shared = some.groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(place).alias("first"), F.max(place).alias("last")).where("least <> most")
    firsts = materialize(shared.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first", "last"), "firsts")
    found = some.join(firsts, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    own = (F.col("first.doc") == F.col("doc")) & (F.col("first.start") == F.col("start"))
    other = F.when(own, F.col("last")).otherwise(F.col("first"))
    found = found.select("doc_id", "doc", "start", "end", F.col("first.doc_id").alias("keep"), own.alias("own"), other["doc"].alias("other"), other["start"].alias("place"))
    listed = found.groupBy("doc", "doc_id").agg(F.collect_list(F.struct("start", "end", "own", "keep", "other", "place")).alias("listed"))
    out = materialize(listed.mapInArrow(_stretched, _STRETCHES), "shared")
    discard(some)
    discard(firsts)
    return out


def repeated(docs: DataFrame, cut_bits: int = CUT_BITS, run: int = RUN) -> DataFrame:
    """(doc_id, start, end, n_chunks, keep_doc_id, removed, doc): runs of bytes that other documents have too.

    start and end count bytes of UTF-8. Of the places of a chunk the one in the smallest doc_id
    (nulls last), then text hash, then start is its first. A run is neighbouring shared chunks and,
    beyond them, the bytes equal to those beside the first place of chunks near that end (beside
    their last place, where the first is here), and has run bytes or more. It is broken
    into what is removed, copies of run bytes or more in a row, and what stays: chunks in their
    first place, and shorter copies beside them; keep_doc_id is the document that has the piece's
    longest stretch first, of equally long ones the earliest in it. Rows with equal doc_id and text are
    one document, so a repeated row is no repeat; passages that occur twice in one document alone
    are none either. Rows with equal doc_id and different texts are different documents. Null and
    empty texts have no runs, very long ones are cut like any other, an empty table gives an empty
    result, and other columns are not read.
    """
    by_doc = _shared(docs, cut_bits)
    asks = by_doc.select("doc", F.explode("asks").alias("a")).select("doc", "a.*")
    nobody = [F.lit(None).cast("long").alias("other"), F.lit(None).cast("int").alias("other_place")]
    mine = asks.select("doc", F.col("at").alias("place"), "right", "deep", "other", F.col("place").alias("other_place"))
    asked = asks.groupBy(F.col("other").alias("doc"), "place", "right").agg(F.max("deep").alias("deep")).select("doc", "place", "right", "deep", *nobody)
    wanted = mine.unionByName(asked).groupBy("doc").agg(F.collect_list(F.struct("place", "right", "deep", "other", "other_place")).alias("wanted"))
    texts = docs.select(_identity("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("raw"))
    met = wanted.join(texts, F.col("doc") == F.col("key")).select("doc", "wanted", "raw")
    beside = materialize(met.mapInArrow(_beside(cut_bits), "doc long, at int, right boolean, beside binary, other long, place int"), "beside")
    theirs = beside.where("other is null").groupBy(F.col("doc").alias("t_doc"), F.col("at").alias("t_at"), F.col("right").alias("t_right")).agg(F.min("beside").alias("theirs"))
    theirs = materialize(theirs, "theirs")  # a plain shuffle again, as many texts can ask for one place
    pairs = beside.where("other is not null").join(theirs, (F.col("other") == F.col("t_doc")) & (F.col("place") == F.col("t_at")) & (F.col("right") == F.col("t_right")))
    lengths = materialize(pairs.select("doc", "at", "right", F.col("beside").alias("mine"), "theirs").mapInArrow(_lengths, "doc long, at int, right boolean, n int"), "lengths")
    discard(beside)
    discard(theirs)
    near = lengths.groupBy(F.col("doc").alias("of")).agg(F.collect_set(F.struct("at", "right", "n")).alias("near"))
    whole = by_doc.join(near, F.col("doc") == F.col("of"), "left").select("doc", "doc_id", "parts", "near")
    return whole.mapInArrow(_runs(run), "doc_id long, start int, end int, n_chunks long, keep_doc_id long, removed boolean, doc long")


def _without(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = []
            for text, spans in zip(rows.column(at), rows.column(rows.num_columns - 1)):
                raw, done, out = (text.as_py() or "").encode(), 0, []
                for span in sorted(spans.as_py() or (), key=lambda s: s["start"]):
                    out.append(raw[done : span["start"]])
                    done = span["end"]
                texts.append(None if not text.is_valid else b"".join([*out, raw[done:]]).decode())
            yield rows.set_column(at, rows.schema.field(at).name, pa.array(texts, pa.string()).cast(rows.schema.field(at).type))

    return run


def drop_repeated(docs: DataFrame, cut_bits: int = CUT_BITS, run: int = RUN) -> DataFrame:
    """docs without the runs that repeated() gives as removed; rows and other columns stay as they are.

    Every chunk stays at its first place. Null texts stay null, a text that is all copies becomes
    empty, repeated rows are cut alike, an empty table stays empty, and columns may have any name.
    """
    names, safe = docs.columns, sheltered(docs)
    own_id, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    spans = repeated(safe.select(F.col(own_id).alias("doc_id"), F.col(text).alias("text")), cut_bits, run).where("removed")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = safe.withColumn("key", _identity(own_id, text)).join(spans, F.col("key") == F.col("doc"), "left").select(*safe.columns, "spans")
    return joined.mapInArrow(_without(names.index("text")), joined.schema).select(*safe.columns).toDF(*names)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).drop("doc")


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE: dict[str, str] = {}
