"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, code_points, free_name, from_rows, picked_texts, texts_of, word_spans
from .quality_rules import _word_ids
from .toxicity import _chunked

_MIX = np.random.default_rng(20240608).integers(1, 2**63, 4, dtype=np.uint64) * 2 + 1
_SHAPE = np.zeros(256, np.uint64)  # 1 lower, 2 upper, 3 digit; other code points stand for themselves
_SHAPE[97:123] = _SHAPE[223:256] = 1
_SHAPE[65:91] = _SHAPE[192:223] = 2
_SHAPE[48:58] = 3


def hashed(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features of all texts: document, bucket, weight.

    Tokens are the shape trigrams of the text (classes of characters, so that they carry over to new words), its character
    trigrams, the shape of each word's end, and a mark for each word that repeats the one before; each group is scaled to 1.
    """
    cp, start = code_points(texts)
    c = cp.astype(np.uint64)
    shape = np.where(cp < 256, _SHAPE[np.minimum(cp, 255)], 0)
    shape = np.where(shape == 0, np.where(cp > 255, 1, c + 16), shape).astype(np.uint64)
    m = len(cp) - 2
    docs, buckets, weights = [], [], []
    if m > 0:
        doc = np.searchsorted(start, np.arange(m), side="right") - 1
        inside = np.flatnonzero(np.arange(m) + 2 < start[doc + 1])
        doc = doc[inside]
        size = np.bincount(doc, minlength=len(texts))
        for k, x in enumerate((shape, c)):
            h = (x[inside] * _MIX[0] + x[inside + 1] * _MIX[1] + x[inside + 2] * _MIX[2]) ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            h = (h ^ (h >> np.uint64(31))) * _MIX[3]
            docs.append(doc)
            buckets.append((h >> np.uint64(64 - bits)).astype(np.int64))
            weights.append(1.0 / size[doc])
    begin, end = word_spans(cp)
    if len(begin):
        doc = np.searchsorted(start, begin, side="right") - 1
        ids = _word_ids(texts)
        size = np.bincount(doc, minlength=len(texts))
        repeat = np.concatenate([[False], (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])])
        tail = (shape[end - 1] * _MIX[1] + shape[np.maximum(end - 2, begin)] * _MIX[2]) ^ np.uint64(12345)
        tail = (tail ^ (tail >> np.uint64(31))) * _MIX[3]
        docs += [doc, doc[repeat]]
        buckets += [(tail >> np.uint64(64 - bits)).astype(np.int64), np.full(repeat.sum(), 1, np.int64)]
        weights += [1.0 / size[doc], 1.0 / size[doc[repeat]]]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(docs), np.concatenate(buckets), np.concatenate(weights)


class CumulativeLink:
    """P(grade <= k) = sigmoid(t_k - w.x): one weight vector for all grades, ordered thresholds t_0 < t_1 < ...

    Thresholds are t_0 and sums of exponentials, so they stay in order. Fitted by Adam on class-balanced likelihood.
    """

    def __init__(self, grades: int, bits: int = 16):
        self.grades, self.bits = grades, bits
        self.w = np.zeros(1 << bits)
        self.free = np.linspace(-1, 0, grades - 1) if grades > 2 else np.zeros(1)

    def thresholds(self) -> np.ndarray:
        return np.concatenate([[self.free[0]], self.free[0] + np.cumsum(np.exp(self.free[1:]))])

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, by column."""
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds(), -50, 50)))

    def latent(self, texts: list[str]) -> np.ndarray:
        doc, bucket, weight = hashed(texts, self.bits)
        return np.bincount(doc, self.w[bucket] * weight, minlength=len(texts))[: len(texts)]

    def fit(self, texts: list[str], grades: list[int], steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> CumulativeLink:
        y = np.array(grades, np.int64)
        if len(set(grades)) < 2:
            self.free[0] = -4.0 if len(y) and y[0] > 0 else 4.0
            return self
        rows, cols, vals = [], [], []
        for a, b in _chunked(texts):
            doc, bucket, weight = hashed(texts[a:b], self.bits)
            pair, inverse = np.unique(doc << self.bits | bucket, return_inverse=True)
            rows.append((pair >> self.bits) + a)
            cols.append(pair & ((1 << self.bits) - 1))
            vals.append(np.bincount(inverse, weight).astype(np.float32))
        row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        n = len(y)
        count = np.bincount(y, minlength=self.grades)
        share = (n / self.grades / np.maximum(count, 1))[y]
        share /= share.sum()
        theta = np.concatenate([self.w, self.free])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for i in range(1, steps + 1):
            self.w, self.free = theta[: -len(self.free)], theta[-len(self.free) :]
            f = np.bincount(row, self.w[col] * val, minlength=n)
            tail = np.concatenate([np.ones((n, 1)), self.tails(f), np.zeros((n, 1))], 1)
            hi, lo = tail[np.arange(n), y], tail[np.arange(n), y + 1]
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p * share, lo * (1 - lo) / p * share
            g_f = d_hi - d_lo
            g_t = np.zeros(self.grades - 1)
            for k in range(1, self.grades):
                g_t[k - 1] = -d_hi[y == k].sum() + d_lo[y == k - 1].sum()
            g_free = np.concatenate([[g_t.sum()], [g_t[k:].sum() * np.exp(self.free[k]) for k in range(1, len(self.free))]])
            g = np.concatenate([np.bincount(col, val * g_f[row], minlength=len(self.w)) - ridge * self.w, g_free])
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        self.w, self.free = theta[: -len(self.free)].astype(np.float32).astype(np.float64), theta[-len(self.free) :].copy()
        return self


def graded(docs: DataFrame, ratings: DataFrame, rows: int, volume: int) -> list[tuple[str, int]]:
    """At most *rows* (text, grade) of each grade of *ratings* (doc_id, grade), by a hash of doc_id, of *volume* bytes together at most."""
    r = ratings.filter("doc_id is not null and grade is not null").dropDuplicates(["doc_id"])
    grades = sorted(x["grade"] for x in r.select("grade").distinct().collect())
    picked: list = []
    for g in grades:
        picked += [tuple(x) for x in r.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "grade").collect()]
    return picked_texts(docs, from_rows(docs.sparkSession, picked, "doc_id long, y int"), volume)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labels: 0 low quality, 1 fit but toxic, 2 fit and clean."""
    return labels.filter("quality is not null").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).cast("int").alias("grade"))


def train(docs: DataFrame, rated: DataFrame, rows: int = 500, volume: int = 32 << 20) -> CumulativeLink:
    """Learn from at most *rows* documents of each grade, of *volume* bytes together."""
    sample = graded(docs, rated, rows, volume)
    model = CumulativeLink(max([2, *(g + 1 for _, g in sample)]))
    return model.fit([t for t, _ in sample], [g for _, g in sample])


def grade(docs: DataFrame, model: CumulativeLink, least: int = 1, tail: float = 0.5) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, expected_grade, tail (P(grade >= *least*)), selected (tail >= *tail*).

    Null and empty texts have no features; their latent value is 0. Null doc_id: kept. Columns of *docs* beyond these are ignored.
    """
    return _appended(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, least, tail, ["doc_id"])


def select(docs: DataFrame, model: CumulativeLink, least: int = 1, tail: float = 0.5) -> DataFrame:
    """The rows of *docs* whose tail probability is high enough, with all their columns."""
    names = docs.columns
    return _appended(docs, model, least, tail, names, True).select(*(F.col(f"`{c}`") for c in names))


def _appended(docs: DataFrame, model: CumulativeLink, least: int, tail: float, keep: list[str], only: bool = False) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    made = [f"{free_name(keep, 'made')}_{x}" for x in ("expected_grade", "tail", "selected")]

    def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            p = model.tails(model.latent(texts_of(b)))
            ok = p[:, least - 1] >= tail
            out = pa.RecordBatch.from_arrays([*(b.column(i) for i, c in enumerate(b.schema.names) if c in keep), pa.array(p.sum(1)), pa.array(p[:, least - 1]), pa.array(ok)], [*(c for c in b.schema.names if c in keep), *made])
            yield out.filter(pa.array(ok)) if only else out

    out = docs.mapInArrow(work, ", ".join([*fields, f"{made[0]} double", f"{made[1]} double", f"{made[2]} boolean"]))
    return out if only else out.withColumnsRenamed(dict(zip(made, ("expected_grade", "tail", "selected"), strict=True)))
