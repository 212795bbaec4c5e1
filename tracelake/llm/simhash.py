"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at MAX_BITS = 4 or fewer differing bits. Cut into three segments,
two linked fingerprints differ by at most one bit in some segment, for three segments with two
or more would make six. So each fingerprint is indexed under its 64 one-wildcard segment
variants: (position of the wildcard, segment without that bit). Linked fingerprints meet in an
equal variant, and whole fingerprints are compared there.

Only distinct fingerprints are indexed, so copies cost nothing. In a bucket of equal variants a
spanning forest of the links is enough for components, so no bucket emits all its pairs. A crowded
bucket is indexed again within itself: of five parts of the bits two linked fingerprints share one,
so the part's bits join the key. Other parts follow at the next level, until all bits are in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workers import reachable
from .common import components, give_back, materialize, sheltered, table

MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of more distinct fingerprints, 8 bytes each, is split by shuffle instead of in memory.
BUCKET = 200_000
#: Groups of more are split before they are compared.
SPLIT = 2_048
#: At each level five sets of bits: runs of so many bits are dealt to them in turn.
LEVELS = tuple(tuple(sum(1 << i for i in range(64) if i // run % (MAX_BITS + 1) == k) for k in range(MAX_BITS + 1)) for run in (13, 1, 3, 6))


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The signed 64-bit SimHash of a text's word shingles; zero for null and wordless texts."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _with_fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((fingerprint(x.as_py(), words) for x in batch.column(batch.num_columns - 1)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "fp"])
        give_back()

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of docs."""
    reachable(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_with_fingerprints(words), "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard segment variants of each fingerprint, the wildcard's position in the upper bits."""
    part = F.lit(None)
    for offset, length in reversed(SEGMENTS):
        own = F.expr(f"shiftrightunsigned(fp, {offset}) & {(1 << length) - 1}L & ~shiftleft(1L, i - {offset})")
        part = F.when(F.col("i") >= offset, F.coalesce(part, own)) if offset else F.coalesce(part, own)
    return distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select((F.shiftleft(F.col("i"), 22) + part.cast("int")).alias("key"), "fp")


def forest(found: np.ndarray, bits: int = MAX_BITS, level: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that hold the components of found (distinct uint64) together, as pairs of arrays."""
    out = []
    if found.size > SPLIT and level < len(LEVELS) and bits <= MAX_BITS:
        for mask in LEVELS[level]:
            value = found & np.uint64(mask)
            order = np.argsort(value, kind="stable")
            for group in np.split(found[order], np.flatnonzero(np.diff(value[order])) + 1):
                if group.size > 1:
                    out += forest(group, bits, level + 1)
        return out
    while found.size > 1:
        queue, found = [found[0]], found[1:]
        while queue and found.size:
            x = queue.pop()
            near = np.bitwise_count(found ^ x) <= bits
            if near.any():
                got, found = found[near], found[~near]
                out.append((np.full(got.size, x), got))
                queue.extend(got)
    return out


def _bucket_links(bits: int, limit: int, level: int):
    """Links (a, b) within runs of equal keys; where a run is longer than limit, its (key, a) instead."""

    def batch(pairs: list[tuple[np.ndarray, np.ndarray]], whole: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(a.size, pa.int64())], ["a", "b", "key"])
        for key, own in whole:
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.nulls(own.size, pa.int64()), pa.array(np.full(own.size, key, np.int64))], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, held, over = None, [], 0, False
        for rows in batches:
            if not rows.num_rows:
                continue
            keys = rows.column(0).to_numpy()
            fps = rows.column(1).to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [keys.size]))
            pairs, whole = [], []
            if keys[0] != key:
                if held > 1 and not over:
                    pairs += forest(np.concatenate(kept), bits, level)
                key, kept, held, over = keys[0], [], 0, False
            last = cuts.size - 2
            # The run that goes on from the batch before, or may go on into the next.
            kept.append(fps[: cuts[1]])
            held += cuts[1]
            if held > limit:
                whole += [(key, own) for own in kept]
                over, kept = True, []
            if last:
                if held > 1 and not over:
                    pairs += forest(np.concatenate(kept), bits, level)
                lengths = np.diff(cuts)
                inner = np.repeat((np.arange(last + 1) > 0) & (np.arange(last + 1) < last) & (lengths <= 8), lengths)
                for step in range(1, 8):
                    at = np.flatnonzero((keys[step:] == keys[:-step]) & inner[step:]) if keys.size > step else np.empty(0, np.int64)
                    at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
                    if at.size:
                        pairs.append((fps[at], fps[at + step]))
                for i in np.flatnonzero(lengths[:last] > 8):
                    if i:
                        pairs += forest(fps[cuts[i] : cuts[i + 1]], bits, level)
                key, kept, held, over = keys[-1], [fps[cuts[last] :]], int(lengths[last]), False
            yield from batch(pairs, whole)
        if held > 1 and not over:
            yield from batch(forest(np.concatenate(kept), bits, level), [])

    return run


def _finer(crowded: DataFrame, level: int) -> DataFrame:
    """(key, fp): the fingerprints of crowded buckets under their key and each of the level's five sets of bits."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in LEVELS[level]]
    parts = crowded.select("key", "a", F.posexplode(F.array(*map(F.lit, signed))).alias("part", "mask"))
    return parts.select(F.xxhash64("key", "part", F.col("a").bitwiseAND(F.col("mask"))).alias("key"), F.col("a").alias("fp"))


def links(distinct: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fp that differ by at most bits, which is MAX_BITS or less."""
    if bits > MAX_BITS:
        raise ValueError(f"segments are laid out for {MAX_BITS} bits")
    met, out = variants(distinct), None
    for level in range(len(LEVELS) + 1):
        limit = bucket if level < len(LEVELS) else 1 << 62  # by then nearly all bits are in the key
        sorted_ = met.repartition("key").sortWithinPartitions("key")
        found = materialize(sorted_.mapInArrow(_bucket_links(bits, limit, level), "a long, b long, key long"), "forest")
        own = found.where("b is not null").select("a", "b")
        out = own if out is None else out.unionByName(own)
        crowded = found.where("b is null")
        if crowded.isEmpty():
            break
        met = _finer(crowded, level)
    return out


def _grouped(own: DataFrame, bits: int, bucket: int) -> DataFrame:
    """own (doc_id, fp, ...), which is written, with label and component_id."""
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(first.select("fp"), bits, bucket))
    named = materialize(first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("label")), "named")
    # Written, so that the joins' sides are plain shuffles, which can be split where a component is large.
    smallest = materialize(named.groupBy(F.col("label").alias("of")).agg(F.min("first_id").alias("component_id")), "smallest")
    known = named.join(smallest, F.col("label") == F.col("of")).select(F.col("fp").alias("known"), "label", "component_id")
    return own.join(known, own["fp"] == known["known"], "left").drop("known")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, label, component_id), a row for each row of docs.

    label names the component by its smallest fingerprint, component_id by its smallest doc_id.
    Null and wordless texts have fingerprint zero and link like any other. Rows with a null
    doc_id take part; a component without any doc_id has component_id null. Repeated rows are
    answered each, as are different texts of one doc_id, which can be in different components. A
    very long text is one row as any other; other columns are not read. An empty table gives an
    empty result.
    """
    return _grouped(materialize(fingerprints(docs, words), "fingerprints"), bits, bucket).select("doc_id", "fp", "label", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """docs without near-duplicates: of each component exactly one row stays.

    It is the row with the smallest doc_id (nulls last), of several with that doc_id one whose text
    has the smallest hash, of repeated rows one. Null and wordless texts are one component, an empty
    table stays empty, and the columns are those of docs, whatever they are called.
    """
    reachable(docs.sparkSession)
    names, docs = docs.columns, sheltered(docs)
    own_id, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}").cast("binary")
    # Two hashes stand for the pair of doc_id and text.
    keyed = docs.select("*", F.xxhash64(own_id, text).alias("k1"), F.xxhash64(F.lit("second"), text, own_id).alias("k2"))
    source = keyed.select(own_id.alias("doc_id"), "k1", "k2", text.alias("text"))
    own = materialize(source.mapInArrow(_with_fingerprints(words), "doc_id long, k1 long, k2 long, fp long"), "fingerprints")
    found = _grouped(own, bits, BUCKET)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k1", "k2")).alias("first")
    keep = materialize(found.groupBy("label").agg(first).select(F.col("first.k1").alias("j1"), F.col("first.k2").alias("j2")), "kept")
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy("k1", "k2").orderBy(F.xxhash64(*plain))
    kept = keyed.join(keep, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    return kept.select(*docs.columns).toDF(*names)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLE: dict[str, str] = {}
