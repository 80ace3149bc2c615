"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, batches, code_points, from_rows, picked_texts, texts_of, word_spans

_MIX = np.random.default_rng(20240607).integers(1, 2**63, 8, dtype=np.uint64) * 2 + 1

#: Zero vectors that join each average, so that a window of very few n-grams isn't judged by chance.
PAD = 40


class Subwords:
    """Hashed character n-grams of all words in a list of texts: bucket and word of each, document of each word."""

    def __init__(self, texts: list[str], bits: int, sizes: tuple[int, ...] = (3, 4, 5)):
        cp, start = code_points([t.lower() for t in texts])
        begin, _ = word_spans(cp)
        self.n_docs, self.n_words = len(texts), len(begin)
        self.doc = np.searchsorted(start, begin, side="right") - 1
        self.first = np.searchsorted(begin, start)  # first word of each document, and the end
        space = (cp == 32) | ((cp >= 9) & (cp <= 13))
        word = np.cumsum(np.bincount(begin, minlength=len(cp) + 1)[: len(cp)]) - 1
        # one space stands at each end of a word and is its boundary mark
        c = np.concatenate([[32], np.where(space, 32, cp)]).astype(np.uint64)
        gap = np.concatenate([[True], space])
        word = np.concatenate([word[:1] * 0 - 1, word])
        bucket, owner = [], []
        for n in sizes:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.zeros(m, np.uint64)
            inner = np.zeros(m, bool)
            for j in range(n):
                h += c[j : j + m] * _MIX[j]
                if 0 < j < n - 1:
                    inner |= gap[j : j + m]
            at = np.flatnonzero(~inner)
            h = (h[at] ^ (h[at] >> np.uint64(29))) * (_MIX[7] + np.uint64(2 * n))
            bucket.append((h >> np.uint64(64 - bits)).astype(np.int64))
            owner.append(np.where(gap[at], word[at + 1], word[at]))
        self.bucket = np.concatenate(bucket) if bucket else np.zeros(0, np.int64)
        self.word = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        # a word that repeats the one before it says nothing new and would fill a window
        seal = np.bincount(self.word, self.bucket + 1.0, minlength=self.n_words)
        same = np.concatenate([[False], (seal[1:] == seal[:-1]) & (self.doc[1:] == self.doc[:-1])]) if self.n_words else np.zeros(0, bool)
        fresh = ~same[self.word]
        self.bucket, self.word = self.bucket[fresh], self.word[fresh]


def _windows(per_word: np.ndarray, grams: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of each run of *width* words (of the whole text if shorter), with its document and first word."""
    total, count = np.concatenate([[0.0], np.cumsum(per_word)]), np.concatenate([[0], np.cumsum(grams)])
    words = np.diff(first)
    each = np.where(words > 0, np.maximum(words - width, 0) + 1, 0)
    doc = np.repeat(np.arange(len(words)), each)
    a = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first[doc]
    b = np.minimum(a + width, first[doc + 1])
    return (total[b] - total[a]) / (count[b] - count[a] + PAD), doc, a


class SubwordClassifier:
    """score(text) = softmax over two classes of the mean n-gram embedding of its most toxic window of *width* words.

    Averaging over a window and not over the text keeps one insult in a long text from being washed out. Embeddings
    and softmax are learnt together by AdaGrad on windows: the likeliest one of each toxic text against the likeliest
    and a random one of each clean text, chosen anew each round; the first choice is by document log-odds of n-grams.
    """

    def __init__(self, bits: int = 17, dim: int = 8, width: int = 16, seed: int = 1):
        self.bits, self.dim, self.width = bits, dim, width
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.e = (rng.standard_normal((1 << bits, dim)) * 0.05).astype(np.float32)
        self.w = (rng.standard_normal((dim, 2)) * 0.3).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.logit = np.zeros(1 << bits, np.float32)
        self.bias = -2.0

    def fit(self, texts: list[str], labels: list[int], rounds: int = 4, epochs: int = 6) -> SubwordClassifier:
        y = np.array(labels, np.int64)
        if not len(y) or y.min() == y.max():
            self.bias = -4.0 if not len(y) or y[0] == 0 else 4.0
            return self
        chunks = list(_chunked(texts))
        seen = np.zeros((2, 1 << self.bits))
        for a, b in chunks:
            s = Subwords(texts[a:b], self.bits)
            pair = np.unique(s.doc[s.word] << self.bits | s.bucket)
            for k in (0, 1):
                own = pair[y[a + (pair >> self.bits)] == k] & ((1 << self.bits) - 1)
                seen[k] += np.bincount(own, minlength=1 << self.bits)
        share = (seen + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
        self.logit = np.log(share[1] / share[0]).astype(np.float32)
        self.logit[seen.sum(0) < 3] = 0
        sums = [np.full_like(self.e, 1e-3), np.full_like(self.w, 1e-3), np.full_like(self.b, 1e-3)]
        for _ in range(rounds):
            ids, cut, label = self._instances(texts, y, chunks)
            for _ in range(max(epochs, 200 * 64 // len(label))):  # a small sample is gone through more often
                self._epoch(ids, cut, label, sums)
            self.logit = (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32)
            self.bias = float(self.b[1] - self.b[0])
        return self

    def _instances(self, texts, y, chunks):
        ids, label = [], []
        for a, b in chunks:
            s = Subwords(texts[a:b], self.bits)
            mean, doc, first = self._means(s)
            order = np.argsort(s.word, kind="stable")
            bucket, at = s.bucket[order], np.searchsorted(s.word[order], np.arange(s.n_words + 1))
            by = np.searchsorted(doc, np.arange(b - a + 1))
            for d in range(b - a):
                if by[d] == by[d + 1]:
                    continue
                own = slice(by[d], by[d + 1])
                picks = {int(first[own][np.argmax(mean[own])])}  # the first word of a text is never a repeat
                if y[a + d] == 0:
                    picks.add(int(first[own][self.rng.integers(by[d + 1] - by[d])]))
                for p in sorted(picks):
                    grams = bucket[at[p] : at[min(p + self.width, s.first[d + 1])]]
                    if len(grams):
                        ids.append(grams)
                        label.append(y[a + d])
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]), np.array(label)

    def _epoch(self, ids, cut, label, sums, batch: int = 64, rate: float = 0.2) -> None:
        weight = len(label) / (2.0 * np.maximum(np.bincount(label, minlength=2), 1))
        weight = np.minimum(weight, 3.0)
        order = self.rng.permutation(len(label))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            n = cut[rows + 1] - cut[rows]
            size = (n + PAD)[:, None]
            flat = np.concatenate([ids[cut[r] : cut[r + 1]] for r in rows])
            seg = np.repeat(np.arange(len(rows)), n)
            mean = np.add.reduceat(self.e[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / size
            z = mean @ self.w + self.b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(rows)), label[rows]] -= 1
            g = (g * weight[label[rows]][:, None] / len(rows)).astype(np.float32)
            gw, gb, ge = mean.T @ g + 1e-5 * self.w, g.sum(0), (g @ self.w.T) / size
            hit, inverse = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(inverse, ge[seg, k], len(hit)) for k in range(self.dim)], 1).astype(np.float32)
            sums[0][hit] += grad**2
            self.e[hit] -= rate * grad / np.sqrt(sums[0][hit])
            sums[1] += gw**2
            self.w -= rate * gw / np.sqrt(sums[1])
            sums[2] += gb**2
            self.b -= rate * gb / np.sqrt(sums[2])

    def _means(self, s: Subwords):
        grams = np.bincount(s.word, minlength=s.n_words)[: s.n_words]
        per_word = np.bincount(s.word, self.logit[s.bucket], minlength=s.n_words)[: s.n_words]
        return _windows(per_word, grams, s.first, self.width)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts without words get the bias alone."""
        s = Subwords(texts, self.bits)
        z = np.full(len(texts), self.bias)
        if s.n_words:
            mean, doc, _ = self._means(s)
            at = np.flatnonzero(np.diff(np.concatenate([[-1], doc])))
            z[doc[at]] = np.maximum.reduceat(mean, at) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def frozen(self) -> SubwordClassifier:
        """What scoring needs: one logit a bucket."""
        out = object.__new__(SubwordClassifier)
        out.bits, out.width, out.logit, out.bias = self.bits, self.width, self.logit, self.bias
        return out


def _chunked(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, volume: int) -> list[tuple[str, int]]:
    """At most *rows* (text, label) of each label value 0 and 1, by a hash of doc_id, of *volume* bytes together at most.

    The ids are chosen among the labels alone; the join's other side is these at most 2 * rows ids.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").dropDuplicates(["doc_id"])
    pick = ids.filter("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).union(ids.filter("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return picked_texts(docs, from_rows(docs.sparkSession, [tuple(r) for r in pick.collect()], "doc_id long, y int"), volume)


def train(docs: DataFrame, labels: DataFrame, rows: int = 2_500, volume: int = 64 << 20) -> SubwordClassifier:
    """From labels outside the held-out third, at most *rows* toxic and *rows* clean documents of *volume* bytes together."""
    sample = labelled(docs, labels.filter(~held_out(F.col("doc_id"))), "toxic", rows, volume)
    return SubwordClassifier().fit([t for t, _ in sample], [y for _, y in sample]).frozen()


def score_toxicity(docs: DataFrame, model: SubwordClassifier, threshold: float = 0.7) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, held_out, score, predicted. Only the text enters the score.

    Null and empty texts get the model's bias. Null doc_id: kept, not held out. Other columns are ignored.
    """

    def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(texts_of(b)), pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
