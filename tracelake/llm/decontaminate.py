"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of some words of a stretch; its mask says which, and the others may differ.
Seeds of test items and of documents are joined by equality. Around each hit the item is laid
along the document and words are compared in place: that is an overlap if STRETCH words in
a row have at least SHARE equal, or all of the item's words within the document have. The two
masks miss no overlap of 8 to 20 words with that share (the tests try all of them). An item of
fewer than LEAST words, which stand together by chance, is met where a whole line, or the whole
text, is just its words: the seed is the whole line then. In scripts that are written without
spaces each character is a word.

Before the join a fixed bitmap of the items' seeds, of BITS bits whatever their number, drops
nearly all seeds of documents on the spot. It never drops a hit, so the result does not depend
on it. Only the words beside hits travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable
from .common import give_back, materialize, sheltered, table

MASKS = ("11101", "1111")
#: Items of fewer words are looked for as whole lines or texts.
LEAST = 8
STRETCH = 12
SHARE = 0.8
BITS = 1 << 24
#: Words whose hashes a task remembers at once.
MEMO = 400_000

# Ranges of scripts written without spaces (Thai and Lao, Burmese, Khmer, kana, Han).
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_SPACELESS}]+|[{_SPACELESS}]")
_BITMAP = 8 * 4096  # bits of one bitmap of Spark's


class Words:
    """Hashes of a text's words, in lower case and without punctuation."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        return self._hashes(_WORD.findall((text or "").lower()))

    def by_line(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, and how many words each line has."""
        lines = [_WORD.findall(line) for line in (text or "").lower().split("\n")]
        return self._hashes([w for line in lines for w in line]), np.fromiter(map(len, lines), np.int64, len(lines))

    def _hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MEMO:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def whole_seed(words: np.ndarray) -> np.ndarray:
    """The seed of a short line as a whole."""
    return np.array([xxhash.xxh64_intdigest(words.tobytes(), 1)], np.uint64)


def short_lines(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Places of lines of 1 to LEAST - 1 words, and of the whole text if it is as short."""
    ends = np.cumsum(sizes)
    out = {(int(ends[k] - sizes[k]), int(ends[k])) for k in np.flatnonzero((sizes > 0) & (sizes < LEAST))}
    return sorted(out | {(0, words.size)} if 0 < words.size < LEAST else out)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place of a text where the mask fits."""
    places = words.size - len(mask) + 1
    if places <= 0:
        return np.empty(0, np.uint64)
    out = np.full(places, xxhash.xxh64_intdigest(mask), np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out = (out ^ words[k : k + places]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _probes(found: np.ndarray) -> list[np.ndarray]:
    """Three bits for each seed."""
    return [((found >> np.uint64(s)) % np.uint64(BITS)).astype(np.int64) for s in (0, 19, 38)]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = Words()
    for rows in batches:
        words = [hashed(x.as_py()) for x in rows.column(1)]
        each = [np.concatenate([seeds(w, m) for m in MASKS]) if w.size >= LEAST else whole_seed(w)[: w.size] for w in words]
        at = [np.concatenate([np.arange(max(0, w.size - len(m) + 1)) for m in MASKS]) if w.size >= LEAST else np.zeros(min(w.size, 1), np.int64) for w in words]
        lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (words, each, at)]
        yield pa.RecordBatch.from_arrays([rows.column(0), *lists], ["item_id", "words", "seeds", "places"])


def _bitmap(seed_rows: DataFrame) -> np.ndarray:
    """Which of BITS bits the seeds have set; at most BITS / 8 bytes reach the driver."""
    probes = F.array(*(F.pmod(F.shiftrightunsigned("seed", s), F.lit(BITS)) for s in (0, 19, 38)))
    bits = seed_rows.select(F.explode(probes).alias("bit"))
    found = bits.groupBy(F.floor(F.col("bit") / _BITMAP).alias("part")).agg(F.bitmap_construct_agg((F.col("bit") % _BITMAP).cast("long")).alias("map")).collect()
    out = np.zeros(BITS, bool)
    for part, bitmap in found:
        own = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        out[part * _BITMAP : (part + 1) * _BITMAP] = own
    return out


def _document_rows(packed, with_lines: bool):
    """Documents with seeds that may be an item's; with_lines says whether any item is looked for as a whole line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(packed.value, np.uint8)).view(bool)
        hashed, at = Words(), TaskContext.get().partitionId() << 32
        for rows in batches:
            out = []
            for doc_id, text, key in zip(*rows.columns):
                words, sizes = hashed.by_line(text.as_py()) if with_lines else (hashed(text.as_py()), None)
                hits, places = [], []
                short = short_lines(words, sizes) if with_lines else []
                whole = [whole_seed(words[a:b]) for a, b in short]
                for found, near in [*((seeds(words, mask), None) for mask in MASKS), (np.concatenate(whole or [np.empty(0, np.uint64)]), np.array([a for a, _ in short], np.int64))]:
                    of, near = near, np.arange(found.size)
                    for k in range(3):
                        near = near[bitmap[_probes(found[near])[k]]]
                    hits.append(found[near])
                    places.append(near if of is None else of[near])
                if sum(map(len, places)):
                    out.append((at, doc_id.as_py(), key.as_py(), *(x.view(np.int64) for x in (words, np.concatenate(hits), np.concatenate(places)))))
                    at += 1
            if out:
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "doc_id", "text_key", "words", "seeds", "places"])
        hashed.known.clear()
        give_back()

    return run


def best_overlap(document: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Equal words and compared ones of the overlap of two sequences of equal length; (0, 0) if it is none.

    It is one if SHARE of all words agree, or of the STRETCH in a row that agree most; of fewer
    than LEAST words all must. The item's words outside the document count as different.
    """
    equal = (document == item).astype(np.int64)
    n, whole = equal.size, int(equal.sum())
    if 0 < n < LEAST:
        return (n, n) if whole == n else (0, 0)
    if n >= LEAST and whole >= SHARE * n:
        return whole, n
    if n >= STRETCH:
        sums = np.convolve(equal, np.ones(STRETCH, np.int64), "valid")
        if sums.max() >= SHARE * STRETCH:
            return int(sums.max()), STRETCH
    return 0, 0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        for row, doc_id, key, part, item_words, lead, start, item in zip(*(c.to_pylist() for c in rows.columns)):
            laid = np.zeros(len(item_words), np.int64)
            valid = np.zeros(len(item_words), bool)
            laid[lead : lead + len(part)] = part
            valid[lead : lead + len(part)] = True
            own = np.array(item_words, np.int64)
            equal, length = best_overlap(np.where(valid, laid, ~own), own)
            if length:
                out.append((row, doc_id, key, item, start, equal, length))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "doc_id", "text_key", "item", "first_word", "n_equal", "n_compared"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_equal, n_compared, text_key): each item that overlaps a row of docs.

    first_word is the place in the document's words at which the item begins, negative if before
    its start; of several places the one with most equal words counts, then the first. text_key is
    a hash of the text. Null and wordless texts overlap nothing; equal items are compared once and
    listed each, a repeated item_id once, an item without id under null; repeated rows, several texts
    of one doc_id and null doc_ids are answered row by row. Very long texts are read whole, empty
    tables give empty results, and other columns are not read.
    """
    spark = docs.sparkSession
    reachable(spark)
    items = materialize(
        benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_rows, "item_id long, words array<long>, seeds array<long>, places array<long>"), "items"
    )
    alike = items.where(F.size("words") > 0).groupBy("words").agg(F.first("seeds").alias("seeds"), F.first("places").alias("places"))
    alike = materialize(alike.withColumn("item", F.monotonically_increasing_id()), "distinct-items")
    of_items = alike.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_place"))
    packed = spark.sparkContext.broadcast(np.packbits(_bitmap(of_items)).tobytes())
    with_lines = not alike.where(F.size("words") < LEAST).isEmpty()
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    hit = materialize(
        source.mapInArrow(_document_rows(packed, with_lines), "row long, doc_id long, text_key long, words array<long>, seeds array<long>, places array<long>"), "hits"
    )
    of_docs = hit.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    laid = of_docs.join(of_items, "seed").select("row", "item", (F.col("place") - F.col("item_place")).alias("start")).distinct()
    lead = F.greatest(F.lit(0), -F.col("start")).cast("int")
    part = F.slice("words", F.greatest(F.lit(0), F.col("start")).cast("int") + 1, F.greatest(F.lit(0), F.size("item_words") - lead))
    texts = alike.select(F.col("item").alias("of"), F.col("words").alias("item_words"))
    placed = laid.join(texts, F.col("item") == F.col("of")).join(hit.select("row", "doc_id", "text_key", "words"), "row")
    checked = placed.select("row", "doc_id", "text_key", part.alias("part"), "item_words", lead.alias("lead"), "start", "item").mapInArrow(
        _verify, "row long, doc_id long, text_key long, item long, first_word long, n_equal long, n_compared long"
    )
    best = checked.groupBy("row", "doc_id", "text_key", "item").agg(F.max(F.struct("n_equal", "n_compared", (-F.col("first_word")).alias("back"))).alias("b"))
    names = items.join(alike.select("words", "item"), "words").select("item", "item_id").distinct()
    return best.join(names, "item").select("doc_id", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.n_equal").alias("n_equal"), F.col("b.n_compared").alias("n_compared"), "text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item overlaps, with the columns that docs has, whatever they are called.

    Null and wordless texts stay, repeated rows go or stay alike, of several texts of one doc_id only
    those that an item overlaps go, and an empty benchmark or table changes nothing.
    """
    names, safe = docs.columns, sheltered(docs)
    own_id, text = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    found = overlaps(safe.select(F.col(own_id).alias("doc_id"), F.col(text).alias("text")), benchmark).select("doc_id", "text_key").distinct()
    meets = F.col(own_id).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_key"))
    return safe.join(found, meets, "left_anti").toDF(*names)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE: dict[str, str] = {}
