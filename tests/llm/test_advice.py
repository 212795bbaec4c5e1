"""Cases in which the training-data operators once did less than their whole job."""

import random

from tracelake.llm import chunks

DOCS = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randint(2, 8))) for _ in range(n))


def test_passages_of_51_words_are_found_to_their_ends(spark):
    rng, rows, planted = random.Random(7), [], {}
    for k in range(300):
        passage = f"ä{words(rng, 51)}漢"
        for doc_id in (k, 1000 + k):
            head = words(rng, 30) + " "
            rows.append((doc_id, f"{head}{passage} {words(rng, 30)}"))
            planted[doc_id] = (len(head.encode()), len(f"{head}{passage}".encode()))
    got = {}
    for r in chunks.repeated(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    texts = {d: t.encode() for d, t in rows}
    for doc_id, (start, end) in planted.items():
        for a, b in sorted(got.get(doc_id, [])):
            assert texts[doc_id][a:b].decode()
            start = max(start, b) if a <= start else start
        assert start >= end, doc_id


def test_a_removed_chunk_keeps_a_place(spark):
    rng = random.Random(11)
    short, long = words(rng, 60), words(rng, 200)
    rows = [(1, long), (2, f"{short} {long}"), (3, f"{short} {long}"), (11, short[::-1]), (12, f"{long[::-1]} {short[::-1]}"), (13, f"{long[::-1]} {short[::-1]}")]
    passages = [words(rng, rng.randint(20, 90)) for _ in range(12)]
    rows += [(100 + k, " ".join(rng.sample(passages, 5))) for k in range(25)]
    docs = spark.createDataFrame(rows, DOCS)
    left = {r.doc_id: r.text.encode() for r in chunks.drop_repeated(docs).collect()}
    texts = {d: t.encode() for d, t in rows}
    for doc_id, text in texts.items():
        ends = chunks.boundaries(text).tolist()
        for a, b in zip([0, *ends], ends):
            if sum(text[a:b] in other for other in texts.values()) > 1:
                assert any(text[a:b] in rest for rest in left.values())
    assert short[50:-50].encode() in left[2] and long[50:-50].encode() in left[1]
    assert long[50:-50].encode() not in left[2] and short[::-1][50:-50].encode() not in left[12]
    assert len(left[3]) < 50 and len(left[13]) < 50
