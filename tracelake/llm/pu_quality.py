"""A quality classifier learned from trusted positives and unlabelled text.

The model is linear over binned measures of a text's style. Its weights minimise the
non-negative unbiased risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior *
loss(positives as 0)). No negative label is read. The class prior is estimated too: a first
classifier of positives against unlabelled rows orders a held-back half, and the prior is the
smallest ratio, over score thresholds, of the unlabelled share above to the positives' share
above, less the sampling error: with too large a prior the risk has nothing left to push down.

Learning takes a bounded sample that a hash of doc_id picks; every row is scored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable
from .common import table

#: Rows of documents that learning looks at, at most.
SAMPLE = 20_000
#: Parts of the doc_ids, of which the first is held out from learning.
FOLDS = 5
CUT = 0.3
BINS = 10

MEASURES = (
    "log_words", "word_length", "symbols", "shouts", "capitals", "digits", "same_next", "distinct", "distinct_pairs",
    "same_lines", "line_words", "stops", "rare_marks",
)


def measures(text: str | None) -> list[float]:
    """The style of a text in numbers; an empty or null one has zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    lines = [x for x in text.split("\n") if x]
    ends = sum(map(text.count, ".?"))
    return [
        float(np.log1p(n)),
        len(text) / n,
        sum(map(text.count, "#*$%&|<>")) / n,
        text.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(words)) / n**0.9,
        len(set(zip(words, words[1:]))) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        ends / n,
        sum(map(text.count, "{}[]=_~^\\")) / n,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = pa.array([measures(x.as_py()) for x in rows.column(1)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), found, *rows.columns[2:]], ["doc_id", "x", *rows.schema.names[2:]])


class Model(NamedTuple):
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each row the positions of its ones: a bin of each measure, and the constant."""
    columns, at = [], 0
    for k, own in enumerate(edges):
        columns.append(at + np.searchsorted(own, x[:, k], side="right"))
        at += own.size + 1
    return np.stack([*columns, np.full(len(x), at)], axis=1)


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Quantiles of each measure among rows that are not zero there, and the smallest of those."""
    out = []
    for column in x.T:
        some = np.unique(column[column != 0])
        cuts = np.quantile(some, np.linspace(0, 1, BINS)) if some.size else np.empty(0)
        out.append(np.unique(cuts))
    return out


def _slope(bins: np.ndarray, pull: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(bins.ravel(), weights=np.repeat(pull, bins.shape[1]), minlength=size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(slope_at, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = slope_at(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, size: int) -> float:
    """The share of positives among unlabelled rows, both given by their bins."""

    def slope_at(w: np.ndarray) -> np.ndarray:
        up, un = _sigmoid(w[positive[::2]].sum(axis=1)) - 1, _sigmoid(w[unlabelled[::2]].sum(axis=1))
        return _slope(positive[::2], up / len(up), size) + _slope(unlabelled[::2], un / len(un), size) + 1e-3 * w

    w = _adam(slope_at, size, 200)
    p, u = np.sort(w[positive[1::2]].sum(axis=1)), np.sort(w[unlabelled[1::2]].sum(axis=1))
    if not p.size or not u.size:
        return 0.5
    above_p = 1 - np.searchsorted(p, p, side="left") / p.size
    above_u = 1 - np.searchsorted(u, p, side="left") / u.size
    slack = np.sqrt(np.log(20) / (2 * u.size)) + np.sqrt(np.log(20) / (2 * p.size))
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip((above_u[best] - slack) / above_p[best], 0.01, 0.99))


def learn(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600) -> Model:
    """A model from the measures of trusted positives and of unlabelled rows."""
    if not len(positive) or not len(unlabelled):
        edges = [np.empty(0)] * len(MEASURES)
        return Model(edges, np.zeros(len(MEASURES) + 1), 0.5)
    edges = _edges(np.concatenate((positive, unlabelled)))
    size = sum(e.size + 1 for e in edges) + 1
    p, u = _binned(positive, edges), _binned(unlabelled, edges)
    prior = estimate_prior(p, u, size)

    def slope_at(w: np.ndarray) -> np.ndarray:
        zp, zu = w[p].sum(axis=1), w[u].sum(axis=1)
        as_negative = _slope(u, _sigmoid(zu) / len(zu), size) - prior * _slope(p, _sigmoid(zp) / len(zp), size)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if risk < 0:  # below zero the estimate is overfitted: step back from it
            return -as_negative
        return prior * _slope(p, (_sigmoid(zp) - 1) / len(zp), size) + as_negative + 1e-4 * w

    return Model(edges, _adam(slope_at, size, steps), prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample rows of docs, and of labels those with quality 1 outside the held-out part.

    A hash of doc_id and text picks the rows, so a rerun takes the same ones, and rows without a
    doc_id are picked like others. A null or empty text has the measures of no words, repeated rows
    count each, and without trusted or without any rows all scores are one half.
    """
    docs, labels = docs.select(F.col("doc_id").cast("long"), "text"), labels.select(F.col("doc_id").cast("long"), "quality")
    reachable(docs.sparkSession)
    rows = docs.count()
    most = int((1 << 30) * min(1.0, 0.8 * sample / max(1, rows)))
    pick = F.xxhash64("doc_id", "text", F.lit("quality"))
    trusted = labels.where(~_held_out() & (F.col("quality") == 1)).select(F.col("doc_id").alias("trusted")).distinct()
    picked = docs.withColumn("pick", pick).where((F.pmod("pick", F.lit(1 << 30)) < most) & ~_held_out()).select("doc_id", "text", "pick")
    measured = picked.mapInArrow(_measure, "doc_id long, x array<double>, pick long")
    marked = measured.join(trusted, F.col("doc_id") == F.col("trusted"), "left").select("doc_id", "x", F.col("trusted").isNotNull().alias("positive"), "pick")
    found = marked.orderBy("pick", F.col("doc_id").asc_nulls_last()).limit(sample).collect()
    found.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.x))
    x = np.array([r.x for r in found]).reshape(-1, len(MEASURES))
    return learn(x[[k for k, r in enumerate(found) if r.positive]], x)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x = np.array([measures(t.as_py()) for t in rows.column(1)]).reshape(-1, len(MEASURES))
            z = model.weights[_binned(x, model.edges)].sum(axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_sigmoid(z))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs; score is the model's probability of quality 1.

    Null and empty texts have the score of a text without words, very long ones are measured whole.
    Repeated rows, several texts of one doc_id and null doc_ids are answered row by row; an empty
    table gives an empty result; lang, source and other columns are not read.
    """
    reachable(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(model), "doc_id long, score double")


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op8_pu_quality": op8_pu_quality}
ORACLE: dict[str, str] = {}
