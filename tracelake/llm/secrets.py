"""Secret scanning: fixed patterns and a linear-chain conditional random field.

Tokens are tagged B (begins a secret), I (inside one) or O. A token's score for a tag sums
weights of its own shape, of the two tokens before it, of the one after it, and of its file;
tags also score by their neighbours. The field is trained here by maximum likelihood, on windows
around what the patterns find in a bounded sample of documents and on windows of made-up secrets
and harmless strings, so it tags secrets that no pattern covers. Decoding is Viterbi's.

Whole texts are decoded exactly without a step for each token: where O beats the other tags by
more than transitions could ever make up for, the best path has O, and the path between two
such tokens does not depend on anything outside. Only those stretches are decoded.
"""

from __future__ import annotations

import bisect
import itertools
import json
import random
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable
from .common import give_back, sheltered, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"[\w+/\-]+|[^\w\s]")
#: Documents looked at for training, at most.
SAMPLE = 2_000
#: Training windows from the sample, at most, of each of the two sorts.
WINDOWS = 600
SPAN = 20
WIDTH = 1 << 12
ROLES = ("own", "back1", "back2", "ahead", "file")
O, B, I = range(3)  # noqa: E741
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of what the patterns find, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def _shape(word: str) -> list[str]:
    n = len(word)
    size = next((k for k, top in enumerate((1, 2, 4, 7, 11, 15, 23, 39)) if n <= top), 8)
    if n == 1 and not word.isalnum():
        return ["mark", f"is {word}"]
    digits = sum(map(str.isdigit, word))
    upper, lower = sum(map(str.isupper, word)), sum(map(str.islower, word))
    kind = "".join(k for k, on in (("a", lower), ("A", upper), ("0", digits), ("-", n - digits - upper - lower)) if on)
    classes = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "-" for c in word]
    turns = min(8, sum(a != b for a, b in zip(classes, classes[1:])) * 8 // max(1, n - 1)) if n > 5 else 0
    rich = len(set(word)) * 6 // n if n > 5 else 6
    out = [f"kind {kind}", f"size {size}", f"{kind} {size}", f"turns {turns} {size}", f"rich {rich} {size}", f"digits {digits * 5 // n} {size}"]
    if not set(word) - set("0123456789abcdefABCDEF"):
        out.append(f"hex {size}")
    if n >= 12:
        out.append(f"starts {word[:4]}")
    return out


def _plain(word: str) -> tuple[str, int] | None:
    """Case and length of an ordinary word, None for other tokens."""
    if word.isalpha():
        case = "a" if word.islower() else "Aa" if word.istitle() else "A" if word.isupper() else ""
        if case:
            return case, min(len(word), 40)
    return None


def _features(word: str, known: set[str]) -> list[str]:
    """known: ordinary words that have a weight of their own; the others go by case and length."""
    plain = _plain(word)
    if plain and word.lower() not in known:
        return ["plain", f"plain {plain[0]}", f"plain {plain[0]} {plain[1]}"]
    return [*_shape(word), f"word {word.lower()}"] if len(word) <= 14 else _shape(word)


def _file_features(text: str) -> list[str]:
    n = max(1, len(text))
    dense = lambda marks: min(5, sum(map(text.count, marks)) * 100 // n)
    return ["file", f"length {len(str(n))}", f"assigns {dense('=:')}", f"quotes {dense(chr(34) + chr(39))}", f"marks {dense('{}[]();')}"]


def _ids(role: str, features: list[str]) -> list[int]:
    at = ROLES.index(role) * WIDTH
    return [at + zlib.crc32(f.encode()) % WIDTH for f in features]


def _window(words: list[str], at: int, file: list[int], known: set[str]) -> list[int]:
    out = _ids("own", _features(words[at], known)) + file
    out += _ids("back1", _features(words[at - 1], known) if at else ["edge"])
    out += _ids("back2", _features(words[at - 2], known) if at > 1 else ["edge"])
    return out + _ids("ahead", _features(words[at + 1], known) if at + 1 < len(words) else ["edge"])


def _tags(text: str, secrets: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    words, tags, spans = [], [], iter(secrets)
    now = next(spans, None)
    begun = False
    for m in _TOKEN.finditer(text):
        while now and now[1] <= m.start():
            now, begun = next(spans, None), False
        inside = bool(now) and m.start() >= now[0] and m.start() < now[1]
        words.append(m.group())
        tags.append((I if begun else B) if inside else O)
        begun = begun or inside
    return words, tags


def made_up(seed: int = 7, count: int = 500) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with secrets of many shapes, and with harmless strings, for training."""
    pick = random.Random(seed)
    some = lambda chars, n: "".join(pick.choices(chars, k=n))
    letters, every = string.ascii_lowercase, string.ascii_letters + string.digits
    word = lambda: some(letters, pick.randint(2, 9))
    secrets = (
        lambda: some(every, pick.randint(16, 44)),
        lambda: some(every + "+/", pick.randint(24, 60)),
        lambda: some("0123456789abcdef", pick.choice((32, 40, 64))),
        lambda: some("0123456789ABCDEF", pick.choice((32, 40, 64))),
        lambda: "ghp_" + some(every, 36),
        lambda: "sk-" + some(every, 40),
        lambda: "eyJ" + some(every, 30) + "." + some(every, 40) + "." + some(every, 43),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: word() + some(string.digits, 3) + some("!#%", 1) + some(string.ascii_uppercase, 3),
    )
    harmless = (
        lambda: some(string.digits, pick.randint(1, 16)),
        lambda: f"+1 ({some(string.digits, 3)}) {some(string.digits, 3)}-{some(string.digits, 4)}",
        lambda: f"{word()}.{word()}@{word()}.com",
        lambda: f"https://www.{word()}.org/{word()}/{some(string.digits, 4)}?page=2",
        lambda: f"20{some(string.digits, 2)}-0{pick.randint(1, 9)}-1{some(string.digits, 1)}",
        lambda: word().upper() + "!!",
        lambda: f"{word()}{word()}{word()}".upper() + "!!",
        lambda: word() + pick.choice(("###", "***", "%%%", "$$$", "&&&")),
        lambda: word() * 4,
        lambda: f"{word()}_{word()} = {word()}({some(string.digits, 2)})",
        lambda: f"v{some(string.digits, 1)}.{some(string.digits, 2)}.{some(string.digits, 1)}",
        lambda: f"{some(string.digits, 3)}-{some(string.digits, 2)}-{some(string.digits, 4)}",
        lambda: f"{some(string.digits, 3)}.{some(string.digits, 2)}.{some(string.digits, 1)}.{some(string.digits, 3)}",
        lambda: f"{word()}: {word()}",
        lambda: " ".join(f"{name}{k}" for name in (word(),) for k in range(pick.randint(0, 90), pick.randint(91, 96))),
        lambda: f"{word()}{some(string.digits, pick.randint(1, 4))}",
        lambda: f"{word()}{word().title()}{word().title()}({word()}{some(string.digits, 1)})",
    )
    keys = ("password", "pwd", "passphrase", "secret", "client_secret", "token", "access_token", "api_key", "apikey", "auth", "Bearer", "private_key", "credential", "signature", "key")
    out = []
    for k in range(count):
        text, spans = " ".join(word() for _ in range(pick.randint(0, 8))), []
        for _ in range(pick.randint(1, 3)):
            text += pick.choice((" ", "\n"))
            if k % 2:
                text += pick.choice(harmless)()
            else:
                text += pick.choice(keys) + pick.choice(("=", ": ", " = ", '="', " ", "': '"))
                secret = pick.choice(secrets)()
                spans.append((len(text), len(text) + len(secret)))
                text += secret
            text += pick.choice((" ", '" ', "\n", ", ")) + " ".join(word() for _ in range(pick.randint(1, 6)))
        out.append((text, spans))
    return out


def _windows(text: str, secrets: list[tuple[int, int]]) -> dict[str, list]:
    """What training can learn from a text: windows at up to four secrets, at two random places, and words before secrets.

    A window is (file features, words with two more to both sides, first and last place in them, tags).
    """
    merged: list[tuple[int, int]] = []
    for a, b in sorted(secrets):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    words, tags = _tags(text, merged)
    pick, file = random.Random(zlib.crc32(text.encode("utf-8", "replace"))), _file_features(text)
    hot = [k for k, t in enumerate(tags) if t == B][:4]

    def window(k: int) -> list:
        a, b = max(0, k - SPAN // 2), min(len(words), k + SPAN // 2)
        low = max(0, a - 2)
        return [file, words[low : b + 2], a - low, b - low, tags[a:b]]

    far = [pick.randrange(len(words)) for _ in range(2) if words]
    before = [sorted({w.lower() for w in words[max(0, k - 4) : k] if _plain(w)}) for k in hot]
    return {"near": [window(k) for k in hot], "far": [window(k) for k in far], "before": before}


def _examples(found: list[dict[str, list]]) -> tuple[list[tuple[list[list[int]], list[int]]], set[str]]:
    """Windows of feature ids with their tags, and the words that stand before secrets more than once."""
    pick, near, far, before = random.Random(11), [], [], Counter()
    for own in [*found, *(_windows(*x) for x in made_up())]:
        near += own["near"]
        far += own["far"]
        before.update(w for words in own["before"] for w in words)
    known = {w for w, n in before.items() if n > 2}
    for windows in (near, far):
        pick.shuffle(windows)
    out = []
    for features, words, a, b, tags in near[: 2 * WINDOWS] + far[: 2 * WINDOWS]:
        file = _ids("file", features)
        out.append(([_window(words, i, file, known) for i in range(a, b)], tags))
    return out, known


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(found: list[dict[str, list]], rounds: int = 60, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray, set[str]]:
    """Weights of B and I over O for each feature, transitions between tags, and the known words.

    found are the sampled documents' windows; without any, the made-up ones alone are learned from. The
    log-likelihood's gradient comes from the forward and backward recursions, over all windows
    at once, and Adagrad follows it for a fixed number of rounds.
    """
    examples, known = _examples(found)
    count, most = len(examples), max(len(f) for e, _ in examples for f in e)
    unused = len(ROLES) * WIDTH
    ids = np.full((count, SPAN, most), unused, np.int32)
    tags = np.zeros((count, SPAN), np.int64)
    sizes = np.array([len(t) for _, t in examples])
    for n, (rows, own) in enumerate(examples):
        for k, row in enumerate(rows):
            ids[n, k, : len(row)] = row
        tags[n, : len(own)] = own
    real = np.arange(SPAN) < sizes[:, None]
    weights, moves = np.zeros((unused + 1, 3)), np.zeros((3, 3))
    sums, move_sums = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    gold = np.eye(3)[tags] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    flat = ids.reshape(-1, most)
    for _ in range(rounds):
        score = weights[ids].sum(axis=2)
        ahead = np.zeros((count, SPAN, 3))
        ahead[:, 0] = score[:, 0]
        for k in range(1, SPAN):
            step = _log_sum(ahead[:, k - 1, :, None] + moves, 1) + score[:, k]
            ahead[:, k] = np.where(real[:, k, None], step, ahead[:, k - 1])
        behind = np.zeros((count, SPAN, 3))
        for k in range(SPAN - 2, -1, -1):
            step = _log_sum(moves + (score[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(real[:, k + 1, None], step, 0)
        total = _log_sum(ahead[:, -1], 1)
        held = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        expected = np.zeros((3, 3))
        for k in range(1, SPAN):
            pair = ahead[:, k - 1, :, None] + moves + (score[:, k] + behind[:, k])[:, None, :] - total[:, None, None]
            expected += (np.exp(pair) * real[:, k, None, None]).sum(axis=0)
        slope = (gold - held).reshape(-1, 3)
        each = np.repeat(slope, most, axis=0)
        up = np.stack([np.bincount(flat.ravel(), weights=each[:, t], minlength=unused + 1) for t in range(3)], axis=1) / count - decay * weights
        up[unused] = 0
        sums += up**2
        weights += 0.3 * up / np.sqrt(sums)
        move = (seen - expected) / count - decay * moves
        move_sums += move**2
        moves += 0.3 * move / np.sqrt(move_sums)
    return (weights[:, 1:] - weights[:, :1]).astype(np.float32), moves, known


class Tagger:
    """Decodes texts with a trained field.

    rows has the weights of a token's features in each role. Ordinary words share few rows; other
    tokens are remembered, up to MEMO of them.
    """

    MEMO = 200_000

    def __init__(self, model: tuple[np.ndarray, np.ndarray, set[str]]):
        self.weights, self.moves, self.known = model
        m = self.moves
        # What a tag other than O can gain at most by transitions, against O in the same place.
        # At a text's ends one of the two transitions is absent, so neither counts below zero.
        self.gain = np.array([max(0, *(m[a, t] - m[a, O] for a in range(3))) + max(0, *(m[t, b] - m[O, b] for b in range(3))) for t in (B, I)], np.float32)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, 8), np.float32)
        self.rows[0] = self._row(["edge"])
        self.used = 1
        self.plain: dict[tuple[str, int], int] = {}
        for word in self.known:
            for form in {word, word.title(), word.upper()}:
                self.index(form)

    def _row(self, features: list[str]) -> np.ndarray:
        return np.concatenate([self.weights[_ids(role, features)].sum(axis=0) for role in ROLES[:4]])

    def _add(self, features: list[str]) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[self.used] = self._row(features)
        self.used += 1
        return self.used - 1

    def index(self, word: str) -> int:
        plain = _plain(word)
        if plain and word.lower() not in self.known:
            found = self.plain.get(plain)
            if found is None:
                found = self.plain[plain] = self._add(_features(word, self.known))
            return found
        found = self.words[word] = self._add(_features(word, self.known))
        return found

    def spans(self, text: str) -> list[tuple[int, int]]:
        words = _TOKEN.findall(text)
        if not words:
            return []
        if len(self.words) > self.MEMO:
            self.clear()
        get, index = self.words.get, self.index
        at = np.fromiter((get(w) or index(w) for w in words), np.int32, len(words))
        rows, n = self.rows, at.size
        score = rows[at, 0:2].copy()
        score[1:] += rows[at[:-1], 2:4]
        score[0] += rows[0, 2:4]
        score[2:] += rows[at[:-2], 4:6]
        score[:2] += rows[0, 4:6]
        score[:-1] += rows[at[1:], 6:8]
        score[-1] += rows[0, 6:8]
        score += self.weights[_ids("file", _file_features(text))].sum(axis=0)
        open_ = np.flatnonzero(((score + self.gain) > 0).any(axis=1))
        if not open_.size:
            return []
        tags = np.zeros(n, np.int8)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags[run] = self._best(score[run].tolist(), run[0] > 0, run[-1] < n - 1)
        hit = np.flatnonzero(tags)
        if not hit.size:
            return []
        begins = {int(k) for k in hit if tags[k] == B or k == 0 or not tags[k - 1]}
        # A secret ends at white space, whatever the tags.
        tagged, out = set(hit.tolist()), []
        for k, m in enumerate(_TOKEN.finditer(text)):
            if k in begins or k in tagged and out[-1][1] < m.start():
                out.append((m.start(), m.end()))
            elif k in tagged:
                out[-1] = (out[-1][0], m.end())
        # Pieces of one secret with a mark of the likes of a dot between them.
        whole: list[tuple[int, int]] = []
        for start, end in out:
            if whole and start - whole[-1][1] == 1 and text[whole[-1][1]] in ".:_-~=+/":
                whole[-1] = (whole[-1][0], end)
            else:
                whole.append((start, end))
        return whole

    def _best(self, score: list[list[float]], before: bool, after: bool) -> list[int]:
        """Viterbi's path over a stretch, beside O where the text goes on."""
        m = self.moves.tolist()
        best = [(m[O][t] if before else 0.0) + e for t, e in zip(range(3), (0.0, *score[0]))]
        back = []
        for row in score[1:]:
            step, froms = [], []
            for t, e in zip(range(3), (0.0, *row)):
                options = [best[a] + m[a][t] for a in range(3)]
                a = max(range(3), key=options.__getitem__)
                step.append(options[a] + e)
                froms.append(a)
            best = step
            back.append(froms)
        last = [best[t] + (m[t][O] if after else 0.0) for t in range(3)]
        path = [max(range(3), key=last.__getitem__)]
        for froms in reversed(back):
            path.append(froms[path[-1]])
        return path[::-1]


def all_spans(text: str, tagger: Tagger) -> tuple[list, list]:
    """The patterns' spans as (start, kind, end), and those with the field's that reach beyond each of them."""
    base = [s[:3] for s in base_spans(text)]
    starts = [s[0] for s in base]
    reach = list(itertools.accumulate((s[2] for s in base), max))
    added = []
    for a, b in tagger.spans(text):
        k = bisect.bisect_right(starts, a)
        if b - a >= 6 and not (k and reach[k - 1] >= b):
            added.append((a, 3, b))
    return base, sorted([*base, *added])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _listed(spans: list) -> list[dict]:
    return [{"kind": (*KINDS, "crf")[kind], "start": start, "end": end} for start, kind, end in spans]


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for rows in batches:
            found = [all_spans(x.as_py() or "", tagger) for x in rows.column(1)]
            lists = (pa.array([_listed(f[k]) for f in found], _SPAN_TYPE) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], ["doc_id", "base", "spans"])
        give_back()

    return run


def _masked(text: str, tagger: Tagger) -> str:
    out, done = [], 0
    for start, _, end in all_spans(text, tagger)[1]:
        if start >= done:
            out += [text[done:start], MASK]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def _mask(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for rows in batches:
            texts = pa.array((x and _masked(x, tagger) for x in (x.as_py() for x in rows.column(at))), pa.string())
            yield rows.set_column(at, rows.schema.field(at).name, texts.cast(rows.schema.field(at).type))
        give_back()

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        texts = [x.as_py() for x in rows.column(1)]
        found = [json.dumps(_windows(t, [(s[3], s[2]) for s in base_spans(t)])) for t in texts]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.string())], ["pick", "found"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, set[str]]:
    """A field trained on windows of at most sample documents.

    A hash of doc_id and text picks the documents, so a rerun takes the same ones, and rows without
    a doc_id are picked like others. Windows are cut where the texts are, and a few of each reach
    the driver. Null and empty texts are left out; of repeated rows each counts. Without any text
    the made-up secrets alone are learned from.
    """
    reachable(docs.sparkSession)
    rows = docs.count()
    some = docs.where(F.length("text") > 0).select(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit("secrets")).alias("pick"), F.col("text").cast("string"))
    few = some.where(F.pmod("pick", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.8 * sample / max(1, rows))))
    found = few.mapInArrow(_sampled, "pick long, found string").orderBy("pick", "found").limit(sample).collect()
    return train([json.loads(r.found) for r in found])


def find_secrets(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, base, spans) for each row of docs; spans are structs of kind, start and end in code points.

    base are the patterns' spans, spans those and the field's, in order of start and kind. A null
    or empty text has none, a very long one is scanned whole. Repeated rows, several texts of one
    doc_id and null doc_ids are answered row by row. Overlapping spans of different kinds are all
    listed, but for the field's within a pattern's. An empty table gives an empty result, and other
    columns are not read. Without a model one is fitted to docs.
    """
    reachable(docs.sparkSession)
    model = model or fit(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(model), f"doc_id long, base {_SPANS}, spans {_SPANS}")


def redact(docs: DataFrame, model=None) -> DataFrame:
    """docs with every secret in text replaced by MASK, and n_chars, if there is one, counted anew where text changed.

    Spans that overlap are masked as one. Null and empty texts stay as they are, rows are neither
    dropped nor merged, an empty table stays empty, and columns may have any name.
    """
    reachable(docs.sparkSession)
    model = model or fit(docs)
    names, safe = docs.columns, sheltered(docs)
    at = names.index("text")
    if "n_chars" not in names:
        return safe.mapInArrow(_mask(model, at), safe.schema).toDF(*names)
    old, count = F.length(f"c{at}").alias("old_chars"), f"c{names.index('n_chars')}"
    marked = safe.select("*", old)
    out = marked.mapInArrow(_mask(model, at), marked.schema)
    fresh = F.length(f"c{at}")
    changed = out.withColumn(count, F.when(fresh != F.col("old_chars"), fresh.cast(safe.schema[count].dataType)).otherwise(F.col(count)))
    return changed.select(*safe.columns).toDF(*names)


def _written(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE: dict[str, str] = {}
