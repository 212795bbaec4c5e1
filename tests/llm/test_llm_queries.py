"""Each query against SQL or a plain-Python account of its whole result."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from public_tokenizers import PATTERN

from tests.compare import rows_of, rows_of_sql
from tracelake.llm import bpe, chunks, decontaminate, lm_scores, pu_quality, registry, secrets, simhash


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(key, spark, sf_dir, duck):
    assert rows_of(registry.queries()[key](spark, sf_dir)) == rows_of_sql(duck, registry.oracle_sql()[key])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.queries()) == list(range(1, 11))


def counted_loss(docs, trusted):
    """Losses by plain counting."""
    from collections import Counter
    from math import log

    words = [(d, (t or "").encode().lower().split()) for d, t in docs]
    counts = []
    for chosen in ([w for d, w in words if d is not None and d in trusted], [w for _, w in words]):
        counts.append((Counter(x for w in chosen for x in w), Counter(p for w in chosen for p in zip(w, w[1:])), sum(map(len, chosen))))
    size, out = len(counts[1][0]), []
    for _, w in words:
        sums = []
        for single, pairs, total in counts:
            loss = 0.0
            for k, x in enumerate(w):
                p = (single[x] + lm_scores.EACH) / (total + lm_scores.EACH * size)
                c, n = (single[w[k - 1]], pairs[w[k - 1], x]) if k else (0, 0)
                loss -= log((n + lm_scores.CONTEXT * p) / (c + lm_scores.CONTEXT))
            sums.append(loss)
        out.append((len(w), *(s / len(w) if w else None for s in (*sums, sums[0] - sums[1]))))
    return out


@pytest.mark.parametrize("block_bytes", [60_000, 1 << 30])
def test_op1(spark, sf_dir, docs, block_bytes):
    table = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    want = dict(zip((d for d, _ in docs), counted_loss(docs, {r.doc_id for r in table.collect()})))
    got = lm_scores.cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), table, block_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.target_loss, r.background_loss, r.difference) == pytest.approx(want[r.doc_id], abs=1e-7)


def test_op3(spark, sf_dir, docs):
    hashed = decontaminate.Words()
    texts = [(d, hashed(t)) for d, t in docs]
    want = {}
    for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        item = hashed(row.text)
        pad = np.zeros(item.size, np.uint64)
        for doc_id, words in texts:
            laid = np.concatenate((pad, words, pad))
            views = np.lib.stride_tricks.sliding_window_view(laid, item.size)
            for k in np.flatnonzero((views == item).sum(axis=1) >= 7):
                start = int(k) - item.size
                inside = (np.arange(item.size) + start >= 0) & (np.arange(item.size) + start < words.size)
                equal, length = decontaminate.best_overlap(np.where(inside, views[k], ~item), item)
                if length:
                    want[doc_id, row.item_id] = max(want.get((doc_id, row.item_id), (0, 0, 0)), (equal, length, -start))
    got = registry.queries()["op3_decontamination"](spark, sf_dir).collect()
    assert want and {(r.doc_id, r.item_id): (r.n_equal, r.n_compared, -r.first_word) for r in got} == want and len(got) == len(want)


def pattern_spans(text):
    kinds = (
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    return [[(m.start(), k, m.end()) for m in pattern.finditer(text) if good(m)] for k, (pattern, good) in enumerate(kinds)]


def test_op5(spark):
    """The smallest tables have no secrets."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["op5_secret_scan"](spark, sf).collect()
    assert len(got) == len(texts) and any(r.spans for r in got)
    for r in got:
        spans = pattern_spans(texts[r.doc_id])
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(sum(spans, [])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, spans))
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) <= {*r.spans.split(","), ""}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    label = list(range(len(ids)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4).tolist():
            a, b = sorted((top(k), top(j)))
            label[b] = a
    return {i: ids[top(k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_op6(spark, sf_dir, docs, bucket):
    """Buckets of one fingerprint are split at all levels."""
    prints = {d: plain_fingerprint(t) for d, t in docs}
    want = plain_components(prints)
    got = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), bucket=bucket).collect()
    assert len(got) == len(docs)
    assert all(r.fp & (2**64 - 1) == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in got)
    shown = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op6_simhash_near_dedup"](spark, sf_dir).collect()}
    assert shown == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_op7(spark, sf_dir, docs):
    encoder = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.ranks(bpe.RANKS), special_tokens={})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    texts = dict(docs)
    got = registry.queries()["op7_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(texts[r.doc_id].encode()))


def test_op8_on_held_out_rows(spark):
    """On the larger of the small tables, as 200 documents have few labels."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = registry.queries()["op8_pu_quality"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) >= 0.9
    assert np.mean([r.score for r in got if labels.get(r.doc_id) == 1]) > 0.8


def test_op8_is_what_its_model_says(spark, sf_dir, docs):
    """Every score by plain loops over bins, from the model that the query fits."""
    from math import exp

    documents, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = pu_quality.fit(documents, labels)
    assert all(np.array_equal(a, b) for a, b in zip(model.edges, pu_quality.fit(documents.repartition(5), labels.repartition(3)).edges))
    got = {r.doc_id: r for r in registry.queries()["op8_pu_quality"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        at, z = 0, 0.0
        for value, edges in zip(pu_quality.measures(text), model.edges):
            z += model.weights[at + sum(e <= value for e in edges)]
            at += len(edges) + 1
        score = 1 / (1 + exp(-(z + model.weights[at])))
        assert got[doc_id].score == pytest.approx(score, abs=1e-9)
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and got[doc_id].predicted == (got[doc_id].score >= 0.3)


def plain_risk(weights, positive, unlabelled, prior):
    """The non-negative unbiased risk, and whether its negative part is below zero, row by row."""
    from math import exp, log

    loss = lambda bins, label: log(1 + exp(-sum(weights[b] for b in bins) if label else sum(weights[b] for b in bins)))
    mean = lambda rows, label: sum(loss(r, label) for r in rows) / len(rows)
    rest = mean(unlabelled, 0) - prior * mean(positive, 0)
    return prior * mean(positive, 1) + max(0.0, rest), rest < 0


def test_op8_minimises_the_risk():
    """Learned weights have a lower risk than none and than any of many nearby ones."""
    rows = np.random.default_rng(4)
    x = lambda n, mean: np.column_stack([rows.normal(mean, 1, n), *[rows.normal(0, 1, n)] * (len(pu_quality.MEASURES) - 1)])
    positive, mixed = x(150, 2), np.concatenate((x(60, 2), x(140, -2)))
    model = pu_quality.learn(positive, mixed)
    bins = [pu_quality._binned(t, model.edges).tolist() for t in (positive, mixed)]
    best, below = plain_risk(model.weights, *bins, model.prior)
    assert best < 0.5 * plain_risk(np.zeros_like(model.weights), *bins, model.prior)[0]
    for _ in range(20):
        other, _ = plain_risk(model.weights + rows.normal(0, 0.5, model.weights.size), *bins, model.prior)
        assert other > best - 0.02


def test_op8_prior():
    """Of unlabelled rows 30 % are positive; positives and negatives differ in one measure."""
    rows = np.random.default_rng(3)
    x = lambda n, mean: np.column_stack([rows.normal(mean, 1, n), *[rows.normal(0, 1, n)] * (len(pu_quality.MEASURES) - 1)])
    positive, mixed = x(3000, 3), np.concatenate((x(1800, 3), x(4200, -3)))
    model = pu_quality.learn(positive, mixed)
    assert 0.2 < model.prior < 0.33
    score = pu_quality._sigmoid(model.weights[pu_quality._binned(np.concatenate((x(500, 3), x(500, -3))), model.edges)].sum(axis=1))
    assert (score[:500] > 0.3).mean() > 0.95 and (score[500:] < 0.3).mean() > 0.95


def plain_chunks(text):
    """Chunks by a loop over bytes; where no boundary comes for long, by looking at every byte around."""
    value, hashes = 0, []
    for byte in text:
        value = ((value << 1) + int(chunks.GEAR[byte])) & 0xFFFFFFFF
        hashes.append(value)
    inside = [byte & 0xC0 == 0x80 for byte in text]
    ends, last = [], -chunks.SPREAD
    for at in range(1, len(text)):
        if hashes[at - 1] >> (32 - chunks.CUT_BITS) == 0 and not inside[at]:
            if at - last >= chunks.SPREAD:
                ends.append(at)
            last = at
    out = []
    for a, b in zip([0, *ends], [*ends, len(text)]):
        if b - a > chunks.GAP:
            low = [(1 << 32) - 1 if inside[at] else hashes[at - 1] for at in range(a + 1, b)]
            begin = a
            for k in range(chunks.NEAR, len(low) - chunks.NEAR + 1):
                if low[k] == min(low[k - chunks.NEAR : k + chunks.NEAR]) and a + k + 1 - begin >= chunks.NEAR:
                    out.append((begin, a + k + 1))
                    begin = a + k + 1
            a = begin
        out.append((a, b))
    return [(a, b) for a, b in out if b > a]


def plain_runs(texts):
    """Whole runs of shared chunks, extended over all equal bytes, by looking at whole texts."""
    cut = {d: [(a, b, t[a:b]) for a, b in plain_chunks(t)] for d, t in texts.items()}
    places = {}
    for d, pieces in cut.items():
        for a, _, piece in pieces:
            places.setdefault(piece, []).append((d, a))
    out = set()
    for d, pieces in cut.items():
        text, parts = texts[d], []
        for a, b, piece in pieces:
            if len({x for x, _ in places[piece]}) > 1:
                first = min(places[piece])
                own = first == (d, a)
                other, place = max(places[piece]) if own else first
                if parts and parts[-1]["end"] == a and parts[-1]["own"] == own and (parts[-1]["other"], parts[-1]["shift"]) == (other, place - a):
                    parts[-1] |= {"end": b, "n": parts[-1]["n"] + 1}
                else:
                    parts.append({"start": a, "end": b, "n": 1, "own": own, "keep": first[0], "other": other, "shift": place - a})
        groups = []
        for p in parts:
            groups.append([p]) if not groups or groups[-1][-1]["end"] != p["start"] else groups[-1].append(p)
        edges = [0, *(x for g in groups for x in (g[0]["start"], g[-1]["end"])), len(text)]
        grown = []
        for k, group in enumerate(groups):
            size = lambda p: p["end"] - p["start"]
            sides = []
            for side, order in ((-1, group), (1, group[::-1])):
                best = (0, None)
                if sum(map(size, group)) >= chunks.ANCHOR:
                    longest = max(order[: chunks.REACH], key=size)
                    for p in {id(p): p for p in (longest, next((p for p in order if size(p) >= chunks.ANCHOR), longest))}.values():
                        there, n = texts[p["other"]], 0
                        at = p["start"] - 1 if side < 0 else p["end"]
                        while 0 <= at + side * n < len(text) and 0 <= at + side * n + p["shift"] < len(there) and text[at + side * n] == there[at + side * n + p["shift"]]:
                            n += 1
                        to = at + side * n + (side < 0)
                        while to < len(text) and text[to] & 0xC0 == 0x80:
                            to -= side
                        beyond = group[0]["start"] - to if side < 0 else to - group[-1]["end"]
                        best = max(best, (beyond, p), key=lambda x: x[0])
                sides.append(best)
            (left, by), (right, of) = sides
            floor = max(edges[2 * k], grown[-1][1] if grown else 0)
            if left > 0 and max(floor, group[0]["start"] - left) < group[0]["start"]:
                grown.append((max(floor, group[0]["start"] - left), group[0]["start"], 0, by["own"], by["keep"]))
            grown += [(p["start"], p["end"], p["n"], p["own"], p["keep"]) for p in group]
            if right > 0 and edges[2 * k + 3] > group[-1]["end"]:
                grown.append((group[-1]["end"], min(edges[2 * k + 3], group[-1]["end"] + right), 0, of["own"], of["keep"]))
        run = []
        for part in [*grown, None]:
            if part and run and run[-1][1] == part[0]:
                run.append(part)
                continue
            if run and run[-1][1] - run[0][0] >= chunks.RUN:
                copies, pieces = [], []
                for p in run:
                    copies.append([p]) if not copies or copies[-1][-1][3] != p[3] else copies[-1].append(p)
                for group in copies:
                    gone = not group[0][3] and group[-1][1] - group[0][0] >= chunks.RUN
                    if pieces and not gone and not pieces[-1][1]:
                        pieces[-1] = (pieces[-1][0] + group, False)
                    else:
                        pieces.append((group, gone))
                for group, gone in pieces:
                    keep = max(group, key=lambda p: (p[2] > 0, p[1] - p[0], -p[0]))[4]
                    out.add((d, group[0][0], group[-1][1], sum(p[2] for p in group), keep, gone))
            run = [part] if part else []
    return out


def test_op10(spark, sf_dir, docs):
    want = plain_runs({d: t.encode() for d, t in docs})
    got = registry.queries()["op10_substring_dedup"](spark, sf_dir).collect()
    assert want and {(r.doc_id, r.start, r.end, r.n_chunks, r.keep_doc_id, r.removed) for r in got} == want and len(got) == len(want)


def test_pipeline(spark, sf_dir, duck):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.materialize(stage(spark, left, sf_dir), "test")
        seen[name] = left
        if name != "byte-level BPE":
            assert left.dtypes == documents.dtypes
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    sql = registry.oracle_sql()["op2_quality_rules"]
    assert ids("quality rules") == sorted(r[0] for r in duck.execute(f"select doc_id from ({sql}) where kept").fetchall())
    kept = {r.doc_id: r.text or "" for r in seen["quality rules"].collect()}
    groups = plain_components({d: plain_fingerprint(t) for d, t in kept.items()})
    assert ids("SimHash near-dedup") == sorted({*groups.values()})
    hit = {r.doc_id for r in registry.queries()["op3_decontamination"](spark, sf_dir).collect()}
    assert ids("benchmark decontamination") == [d for d in ids("SimHash near-dedup") if d not in hit]
    masked = {r.doc_id: r.text for r in seen["secret scans"].collect()}
    assert sorted(masked) == ids("benchmark decontamination")
    for doc_id, text in masked.items():
        if any(pattern_spans(kept[doc_id])):
            assert secrets.MASK in text and all(kept[doc_id][a:b] not in text for own in pattern_spans(kept[doc_id]) for a, _, b in own)
    encoder = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.ranks(bpe.RANKS), special_tokens={})
    tokens = {r.doc_id: r for r in seen["byte-level BPE"].collect()}
    assert {d: t.ids for d, t in tokens.items()} == {d: encoder.encode_ordinary(t) for d, t in masked.items()}
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(seen["byte-level BPE"])
