"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding by a join with the token-byte table.

1. Each task cuts its documents into blocks. A block's texts become positions: for each
   document, in order, the numbers of its pre-tokens in the block's list of distinct ones. That
   is the explosion of pre-tokens with positions, with a number of one to three bytes for a row.
2. The distinct words of all blocks go to their shard, by hash. A shard holds all places of its
   words, makes them distinct over all blocks, encodes each once, and sends each block the ids of the
   words that it asked for. Shards grow in number with the text, so one has about as much as any block.
3. Ids join positions by block, and each document's ids are put together by position.

Blocks are written before they are used, so a lost executor cannot change their numbering. The
shuffle carries each distinct word once for each block instead of each pre-token, and a frequent
word is one entry of a block like any other, so no shard is hot. A task holds one block or one shard.

Decoding explodes ids with positions, joins them to the table of token bytes by id and puts the
bytes together by position. The table is as large as the vocabulary, so each task has its own and
ids need no shuffle.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable
from .common import give_back, materialize, table, total_chars

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 24_000_000
#: Bytes of text for each shard of words, about.
SHARD_BYTES = 12_000_000
#: Documents that are put together, or decoded, at once.
_DOCS = 512
#: Ids that are decoded at once, unless one document has more.
_IDS = 1 << 22

_BLOCK = "block long, shard int, doc_ids array<long>, counts array<int>, payload binary"


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@functools.lru_cache(2)
def _encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


#: Numbers that are packed or unpacked at once.
_SLICE = 1 << 18


def _pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers below 2**28 with seven bits to a byte, compressed."""
    return zstandard.compress(b"".join(_pack_slice(values[at : at + _SLICE].astype(np.uint32)) for at in range(0, values.size, _SLICE)), 3)


def _pack_slice(values: np.ndarray) -> bytes:
    sizes = 1 + (values >= 1 << 7).astype(np.int64) + (values >= 1 << 14) + (values >= 1 << 21)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]), np.uint8)
    starts = ends - sizes
    for k in range(4):
        at = np.flatnonzero(sizes > k)
        out[starts[at] + k] = (values[at] >> np.uint32(7 * k)) & np.uint32(127) | np.where(sizes[at] > k + 1, 128, 0)
    return out.tobytes()


def _unpack_numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    out, at = np.empty(int(np.count_nonzero(raw < 128)), np.uint32), 0
    start = 0
    while start < raw.size:
        stop = min(start + _SLICE, raw.size)
        while raw[stop - 1] >= 128:  # a number goes on
            stop += 1
        found = _unpack_slice(raw[start:stop])
        out[at : at + found.size] = found
        at, start = at + found.size, stop
    return out


def _unpack_slice(raw: np.ndarray) -> np.ndarray:
    first = np.ones(raw.size, bool)
    first[1:] = raw[:-1] < 128
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, raw.size))
    out = np.zeros(starts.size, np.uint32)
    for k in range(int(sizes.max())):
        at = np.flatnonzero(sizes > k)
        out[at] |= (raw[starts[at] + k] & np.uint32(127)).astype(np.uint32) << np.uint32(7 * k)
    return out


def _join(parts: list[bytes]) -> bytes:
    """Length of the lengths, lengths, contents."""
    sizes = _pack_numbers(np.fromiter(map(len, parts), np.uint32, len(parts)))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(b"".join(parts), 3)


def _split(packed: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(_unpack_numbers(packed[4:at]), dtype=np.int64).tolist()
    whole = zstandard.decompress(packed[at:])
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _blocks(shards: int, block_chars: int):
    def rows(block: int, doc_ids: list, counts: list, codes: list, words: dict) -> Iterator[tuple]:
        # Frequent words get small numbers.
        flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
        codes.clear()
        often = np.bincount(flat, minlength=len(words))
        order = np.argsort(-often, kind="stable")
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words))
        listed = list(words)
        raw = [listed[i].encode() for i in order.tolist()]
        shard = np.fromiter((xxhash.xxh32_intdigest(w) % shards for w in raw), np.int32, len(raw))
        packed = [_pack_numbers(number[flat]), _pack_numbers(shard)]
        yield block, -1, doc_ids, counts, len(packed[0]).to_bytes(4, "little") + packed[0] + packed[1]
        by = np.argsort(shard, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
            if at.size:
                yield block, int(shard[at[0]]), None, None, _join([raw[i] for i in at.tolist()])

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["block", "shard", "doc_ids", "counts", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(public_tokenizers.PATTERN).findall
        block, chars = TaskContext.get().partitionId() << 32, 0
        doc_ids, counts, codes, words = [], [], [], {}
        for rows_in in batches:
            for doc_id, text in zip(rows_in.column(0), rows_in.column(1)):
                text = text.as_py() or ""
                if chars and chars + len(text) > block_chars:
                    yield batch(list(rows(block, doc_ids, counts, codes, words)))
                    block, chars, doc_ids, counts, codes, words = block + 1, 0, [], [], [], {}
                    give_back()
                found = split(text)
                codes.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                doc_ids.append(doc_id.as_py())
                counts.append(len(found))
                chars += len(text)
        if doc_ids:
            yield batch(list(rows(block, doc_ids, counts, codes, words)))
        doc_ids, counts, codes, words = [], [], [], {}
        give_back()

    return run


def answered(messages: list[list[bytes]], one: Callable[[bytes], list[int]]) -> list[list[bytes]]:
    """For each message the ids of its words, as bytes of four each; one() is called once for each distinct word."""
    distinct = dict.fromkeys(word for words in messages for word in words)
    for word in distinct:
        distinct[word] = np.array(one(word), np.uint32).tobytes()
    return [[distinct[word] for word in words] for words in messages]


def _encode_shard(path: str):
    def run(rows: pa.Table) -> pa.Table:
        one = _encoder(path).encode_single_piece if hasattr(tiktoken.Encoding, "encode_single_piece") else _encoder(path)._core_bpe.encode_single_piece
        answers = []
        for out in answered([_split(payload.as_py()) for payload in rows.column("payload")], one):
            sizes = np.fromiter(map(len, out), np.int64, len(out)) >> 2
            ids = np.frombuffer(b"".join(out), np.uint32)
            lengths = _pack_numbers(sizes)
            halves = ids.astype(np.uint16).tobytes() if not ids.size or ids.max() < 1 << 16 else ids.tobytes()
            wide = int(len(halves) != 2 * ids.size)
            answers.append(bytes([wide]) + len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(halves, 3))
        give_back()
        return pa.table([rows.column("block"), rows.column("shard"), pa.array(answers, pa.binary())], names=["block", "shard", "payload"])

    return run


def _reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with their ids: positions joined to the ids of the block's words."""
    doc_ids, out = [], []
    for row in range(left.num_rows):
        payload = left.column("payload")[row].as_py()
        at = 4 + int.from_bytes(payload[:4], "little")
        numbers, shard = _unpack_numbers(payload[4:at]), _unpack_numbers(payload[at:])
        by = np.argsort(shard, kind="stable")
        sizes, parts = np.zeros(shard.size, np.int64), {}
        for of, packed in zip(right.column("shard").to_pylist(), right.column("payload")):
            packed = packed.as_py()
            at = 5 + int.from_bytes(packed[1:5], "little")
            own = by[np.searchsorted(shard[by], of) : np.searchsorted(shard[by], of, "right")]
            sizes[own] = _unpack_numbers(packed[5:at])
            parts[of] = np.frombuffer(zstandard.decompress(packed[at:]), np.uint32 if packed[0] else np.uint16).astype(np.int32)
        # The ids of all words, by shard and then by number, as they came.
        ids = np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.empty(0, np.int32)
        begins = np.empty(shard.size, np.int64)
        begins[by] = np.cumsum(sizes[by]) - sizes[by]
        counts = np.array(left.column("counts")[row].as_py(), np.int64)
        ends = np.cumsum(counts)
        for k in range(0, counts.size, _DOCS):
            own = numbers[ends[k] - counts[k] : ends[min(k + _DOCS, counts.size) - 1]]
            lengths = sizes[own]
            stops = np.cumsum(lengths)
            flat = ids[np.repeat(begins[own] - (stops - lengths), lengths) + np.arange(int(stops[-1]) if stops.size else 0)]
            edges = np.concatenate(([0], stops))[np.concatenate(([0], ends[k : k + _DOCS] - (ends[k] - counts[k])))]
            out.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32())))
        doc_ids += left.column("doc_ids")[row].as_py()
    lists = pa.chunked_array(out, pa.list_(pa.int32()))
    give_back()
    return pa.table([pa.chunked_array([pa.array(doc_ids, pa.int64())]), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str = RANKS, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text, as the tiktoken library's encode_ordinary gives.

    Null and empty texts have no ids. Repeated rows, several texts of one doc_id and null doc_ids are
    answered row by row; a very long text is a block of its own; an empty table gives an empty
    result, and other columns are not read. path names a file of ranks that every executor has.
    """
    reachable(docs.sparkSession)
    shards = max(1, -(-total_chars(docs) // shard_bytes))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    coded = materialize(source.mapInArrow(_blocks(shards, block_chars), _BLOCK), "blocks")
    words = coded.where("shard >= 0").select("block", "shard", "payload")
    ids = words.groupBy("shard").applyInArrow(_encode_shard(path), "block long, shard int, payload binary")
    positions = coded.where("shard < 0").select("block", "doc_ids", "counts", "payload")
    return positions.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_reassemble, "doc_id long, ids array<int>")


def token_bytes(path: str) -> pa.Table:
    """(id, piece): the bytes that each id of the vocabulary stands for."""
    known = ranks(path)
    return pa.table([pa.array(known.values(), pa.int32()), pa.array(known.keys(), pa.binary())], names=["id", "piece"])


def _joined(lists: pa.ListArray, tokens: pa.Table) -> pa.Array:
    """The bytes of each list of ids: ids with their positions joined to tokens, and put together by position."""
    sizes = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    flat = lists.flatten()
    met = pa.table([flat, pa.array(np.arange(len(flat)))], names=["id", "at"]).join(tokens, "id", join_type="left outer", use_threads=False)
    pieces = met.column("piece").combine_chunks().take(pa.array(np.argsort(met.column("at").to_numpy())))
    if pieces.null_count:
        raise ValueError("an id that is not in the vocabulary")
    ends = np.concatenate(([0], np.cumsum(sizes)))
    _, offsets, data = pieces.buffers()
    each = np.frombuffer(offsets, np.int32, len(pieces) + 1, pieces.offset * 4) if len(pieces) else np.zeros(1, np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(each[ends].astype(np.int32).tobytes()), data if data is not None else pa.py_buffer(b"")])
    return out if lists.null_count == 0 else pa.array([x if ok.as_py() else None for x, ok in zip(out, lists.is_valid())], pa.binary())


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for whole in batches:
            todo = [whole.slice(at, _DOCS) for at in range(whole.num_rows - 1 - (whole.num_rows - 1) % _DOCS, -1, -_DOCS)]
            while todo:
                rows = todo.pop()
                if rows.num_rows > 1 and len(rows.column(1).flatten()) > _IDS:
                    half = rows.num_rows // 2
                    todo += [rows.slice(half), rows.slice(0, half)]
                    continue
                yield pa.RecordBatch.from_arrays([*rows.columns, _joined(rows.column(1), tokens)], [*rows.schema.names, "decoded"])
            give_back()

    return run


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """encoded (doc_id, ids) with decoded: the bytes that the ids stand for, joined from the table of token bytes.

    The table has a row for each rank of the vocabulary file, so its size is that file's. Null
    ids decode to null, an empty list to no bytes; an unknown or null id in a list raises an error.
    """
    reachable(encoded.sparkSession)
    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(_decode(path), "doc_id long, ids array<int>, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE: dict[str, str] = {}
