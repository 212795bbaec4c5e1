"""Language-model scoring by cross-entropy difference.

Two bigram models are matched: same vocabulary (every word of the corpus), same order, same
smoothing. The target model counts trusted documents, the background model all of them. Each
token's loss under the target model less its loss under the background model, averaged over a
document, is its score: the lower, the more like the target.

Counts are over the whole corpus and grow with it, so they never meet in one place. Documents
are dealt to blocks by a hash. A block sends each shard, a range of 64-bit n-gram hashes, its
sorted n-grams and counts in compressed form; the shard adds up what blocks have in common and
answers each block for the n-grams that it shares with others, the rest being known to the block
already. Then the block scores its documents. A frequent n-gram is one entry of a block like any
other, so no shard gets more than its range of every block. Nothing is sent for an empty range, so
messages are never more than the n-grams that blocks have.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable
from .common import give_back, materialize, table, total_chars

#: Bytes of text in a block, about.
BLOCK_BYTES = 4_000_000
#: Weight of the unigram model in the bigram model, in tokens of context, and that of each word of the vocabulary.
CONTEXT, EACH = 4.0, 0.1

_PACKED = "block int, shard int, payload binary"
_ANSWER = f"{_PACKED}, n_words long, n_tokens long, n_target long"


class Block(NamedTuple):
    sizes: np.ndarray  # tokens of each document
    targets: np.ndarray  # whether each is trusted
    keys: np.ndarray  # sorted hashes of all n-grams; odd ones are words
    background: np.ndarray  # count of each key in all documents
    target: np.ndarray  # and in trusted ones
    word_at: np.ndarray  # place in keys of each token's word
    pair_at: np.ndarray  # and of its pair with the word before
    before_at: np.ndarray  # and of the word before, -1 at a document's start


def _counted(texts: list[bytes], targets: np.ndarray) -> Block:
    codes: dict[bytes, int] = {}
    each = []
    for text in texts:
        words = text.lower().split()
        each.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    tokens = np.concatenate(each) if each else np.empty(0, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in codes), np.uint64, len(codes))
    one = np.uint64(1)
    first = np.zeros(tokens.size, bool)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    first[starts] = True
    before = np.concatenate(([0], tokens[:-1]))
    pairs, pair_of = np.unique(np.where(first, -1, before) * (len(codes) + 1) + tokens, return_inverse=True)
    left, right = np.divmod(pairs, len(codes) + 1)
    mixed = np.where(left < 0, np.uint64(0x5851F42D4C957F2D), hashes[left] if len(codes) else hashes) * np.uint64(0x9E3779B97F4A7C15) if pairs.size else np.empty(0, np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    pair_keys = ((mixed ^ (hashes[right] if pairs.size else mixed)) * np.uint64(0xFF51AFD7ED558CCD)) & ~one
    pair_keys ^= (pair_keys >> np.uint64(33)) & ~one
    keys, place = np.unique(np.concatenate((hashes | one, pair_keys)), return_inverse=True)
    trusted = np.repeat(targets, sizes)
    word_at, pair_at = place[tokens], place[hashes.size + pair_of] if pairs.size else pair_of
    total = np.bincount(word_at, minlength=keys.size) + np.bincount(pair_at, minlength=keys.size)
    own = np.bincount(word_at[trusted], minlength=keys.size) + np.bincount(pair_at[trusted], minlength=keys.size)
    return Block(sizes, targets, keys, total, own, word_at, pair_at, np.where(first, -1, place[before] if tokens.size else before))


def _squeeze(values: np.ndarray) -> bytes:
    """An array of unsigned numbers, by bytes of equal weight, as most upper ones are zero."""
    wide = np.ascontiguousarray(values, np.uint64)
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _expand(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [_squeeze(a) for a in arrays]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        size = int.from_bytes(payload[at : at + 4], "little")
        out.append(_expand(payload[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def _read(docs: pa.Table, trusted: list) -> tuple[list, Block]:
    """A block's documents; the order of rows is settled, as a shuffle's is not."""
    doc_ids, texts = docs.column("doc_id").to_pylist(), [x or b"" for x in docs.column("text").to_pylist()]
    order = sorted(range(len(doc_ids)), key=lambda k: (doc_ids[k] is None, doc_ids[k] or 0, texts[k]))
    doc_ids, texts = [doc_ids[k] for k in order], [texts[k] for k in order]
    chosen = set(trusted)
    return doc_ids, _counted(texts, np.fromiter((d in chosen for d in doc_ids), bool, len(doc_ids)))


def _bounds(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)


def _send(shards: int):
    def run(docs: pa.Table, labels: pa.Table) -> pa.Table:
        _, own = _read(docs, labels.column("trusted").to_pylist())
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        cuts = np.concatenate(([0], np.searchsorted(own.keys, _bounds(shards)), [own.keys.size]))
        rows = [
            (block, k, _pack(np.diff(own.keys[a:b], prepend=np.uint64(0)), own.background[a:b], own.target[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
        ]
        give_back()
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["block", "shard", "payload"])

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """Answers each block of a shard, and tells the shard's number of words and tokens beside the first answer."""
    blocks = rows.column("block").to_pylist()
    parts = [_unpack(x.as_py()) for x in rows.column("payload")]
    keys = np.concatenate([np.cumsum(p[0]) for p in parts])
    sizes = [p[0].size for p in parts]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sums = [np.add.reduceat(np.concatenate([p[k].astype(np.int64) for p in parts])[order], starts) for k in (1, 2)]
    times = np.diff(np.append(starts, ranked.size))
    group = np.empty(keys.size, np.int64)
    group[order] = np.repeat(np.arange(starts.size), times)
    shard = rows.column("shard")[0].as_py()
    words = (ranked[starts] & np.uint64(1)) == 1
    payloads, at = [], 0
    for size in sizes:
        own = group[at : at + size]
        common = np.flatnonzero(times[own] > 1)
        payloads.append(_pack(np.diff(common, prepend=0), sums[0][own[common]], sums[1][own[common]]))
        at += size
    give_back()
    totals = [pa.array([int(total), *[0] * (len(blocks) - 1)], pa.int64()) for total in (words.sum(), sums[0][words].sum(), sums[1][words].sum())]
    return pa.table(
        [pa.array(blocks, pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array(payloads, pa.binary()), *totals],
        names=["block", "shard", "payload", "n_words", "n_tokens", "n_target"],
    )


def losses(own: Block, vocabulary: float, tokens: tuple[float, float]) -> list[np.ndarray]:
    """Each token's loss in nats under the target and the background model, with the block's counts."""
    out = []
    starts = (own.before_at < 0).astype(bool)
    for counts, total in ((own.target, tokens[1]), (own.background, tokens[0])):
        word = (counts[own.word_at] + EACH) / (total + EACH * vocabulary)
        context = np.where(starts, 0, counts[own.before_at])
        pair = np.where(starts, 0, counts[own.pair_at])
        out.append(-np.log((pair + CONTEXT * word) / (context + CONTEXT)))
    return out


def _score(shards: int, vocabulary: float, tokens: tuple[float, float]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        shard, payload = answers.column("shard").to_pylist(), answers.column("payload")
        trusted = [x for k, s in enumerate(shard) if s < 0 for x in answers.column("trusted")[k].as_py()]
        doc_ids, own = _read(docs, trusted)
        cuts = np.concatenate(([0], np.searchsorted(own.keys, _bounds(shards)), [own.keys.size]))
        background, target = own.background.copy(), own.target.copy()
        for k, s in enumerate(shard):
            if s >= 0:
                steps, all_, few = _unpack(payload[k].as_py())
                at = cuts[s] + np.cumsum(steps.astype(np.int64))
                background[at], target[at] = all_, few
        each = losses(own._replace(background=background, target=target), vocabulary, tokens)
        give_back()
        ends = np.cumsum(own.sizes)
        sums = [np.concatenate(([0.0], np.cumsum(x)))[ends] - np.concatenate(([0.0], np.cumsum(x)))[ends - own.sizes] for x in each]
        means = [pa.array(s / np.maximum(own.sizes, 1), mask=own.sizes == 0) for s in sums]
        difference = pa.array((sums[0] - sums[1]) / np.maximum(own.sizes, 1), mask=own.sizes == 0)
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(own.sizes, pa.int64()), *means, difference], names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return run


def cross_entropy_difference(docs: DataFrame, trusted: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for each row of docs.

    trusted has the doc_ids of target documents. Tokens are words between white space, in lower
    case where ASCII has it; losses are means over tokens, in nats. A null or empty text has no
    token, and null losses. Repeated rows count and are answered each; a null doc_id is never
    trusted, all texts of a trusted doc_id are; trusted ids that are null, repeated or unknown change
    nothing. Without target documents every word is equally likely to the target model. A very long
    text is scored whole, an empty table gives an empty result, and other columns are not read.
    Documents are dealt by doc_id and text, so only rows alike in both meet in one block for certain.
    """
    reachable(docs.sparkSession)
    blocks = max(1, -(-total_chars(docs) // block_bytes))
    shards = blocks
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    source = source.withColumn("block", deal)
    ids = trusted.select(F.col("doc_id").cast("long").alias("trusted")).where("trusted is not null").distinct()
    # A doc_id with several texts is trusted in the block of each.
    places = source.select(F.col("doc_id").alias("of"), F.col("block").alias("at"))
    chosen = materialize(places.join(ids, F.col("of") == F.col("trusted")).select("trusted", F.col("at").alias("block")).distinct(), "trusted")
    grouped = source.groupBy("block")
    sent = grouped.cogroup(chosen.groupBy("block")).applyInArrow(_send(shards), _PACKED)
    answers = materialize(sent.groupBy("shard").applyInArrow(_add_up, _ANSWER), "answers")
    sums = [float(x or 0) for x in answers.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_target")).first()]
    lists = chosen.groupBy("block").agg(F.collect_list("trusted").alias("trusted")).select("block", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("payload"), "trusted")
    back = answers.select("block", "shard", "payload").withColumn("trusted", F.lit(None).cast("array<long>")).unionByName(lists)
    scored = grouped.cogroup(back.groupBy("block")).applyInArrow(
        _score(shards, sums[0], (sums[1], sums[2])), "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
    )
    return scored


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses to six places, as sums of many logarithms differ in the last ones by their order."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = cross_entropy_difference(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")))


def losses_sql() -> str:
    """DuckDB SQL for op1, by counting words and pairs as they are."""
    upper = "".join(map(chr, range(65, 91)))
    chance = lambda c, n, total: f"({c} + {EACH}::double) / ({total} + {EACH}::double * {n})"
    loss = lambda k: f"-ln((coalesce(p.{k}, 0) + {CONTEXT}::double * {chance(f'u.{k}', 'v.n', f'v.{k}')}) / (coalesce(b.{k}, 0) + {CONTEXT}::double))"
    return f"""
with d as (select row_number() over () as rid, doc_id, doc_id in (select doc_id from labels where quality = 1) as good,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') as words from documents),
w as (select rid, coalesce(good, false) as good, i, words[i] as word, case when i > 1 then words[i - 1] end as was from (select rid, good, words, unnest(generate_series(1, len(words))) as i from d) z),
u as (select word, count(*) as a, count(*) filter (good) as t from w group by word),
p as (select was, word, count(*) as a, count(*) filter (good) as t from w where was is not null group by was, word),
v as (select count(*) as n, sum(a) as a, sum(t) as t from u),
l as (select w.rid, {loss("t")} as target, {loss("a")} as background from w join u on u.word = w.word left join p on p.was = w.was and p.word = w.word left join u b on b.word = w.was cross join v),
s as (select rid, count(*) as n, sum(target) as target, sum(background) as background from l group by rid)
select doc_id, coalesce(n, 0) as n_tokens, round(target / n, 6) as target_loss, round(background / n, 6) as background_loss, round((target - background) / n, 6) as difference from d left join s on s.rid = d.rid"""


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLE = {"op1_lm_scoring": losses_sql()}
