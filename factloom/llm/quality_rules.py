"""Quality rules: exact base counts, and lines labelled content or boilerplate by a linear-chain CRF."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, code_points, texts_of, word_spans
from .toxicity import labelled

SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ("bias", "symbols", "bars", "capitals", "digits", "shouts", "repeats", "variety", "word_length", "many_words", "sentence", "seen_before", "short")


class Lines:
    """Counts of each text and features of each line that has a word."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        cp, start = code_points(texts)
        begin, end = word_spans(cp)
        word_doc = np.searchsorted(start, begin, side="right") - 1
        self.first = np.searchsorted(begin, start)
        ids = _word_ids(texts)
        length = end - begin

        def per_doc(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[start[1:]] - total[start[:-1]]

        symbol = np.isin(cp, [ord(c) for c in SYMBOLS])
        self.n_words = np.diff(self.first)
        self.word_chars = np.bincount(word_doc, length, minlength=n).astype(np.int64)[:n]
        self.n_symbols = per_doc(symbol)
        self.n_repeat_words = _repeat_words(ids, word_doc, n)
        # lines: those of WORD's white space that split lines are newlines alone
        breaks = np.flatnonzero(cp == 10)
        line = np.searchsorted(breaks, begin)  # of each word
        used, at = np.unique(line, return_index=True)
        self.doc = word_doc[at] if len(at) else np.zeros(0, np.int64)
        self.words = np.diff(np.concatenate([at, [len(begin)]])) if len(at) else np.zeros(0, np.int64)
        seen_before = np.zeros(len(used), bool)
        self.n_dup_lines = np.zeros(n, np.int64)
        k = 0
        for d, t in enumerate(texts):
            seen: set[str] = set()
            for x in t.split("\n"):
                if not x.strip("\t\n\v\f\r "):
                    continue
                if x in seen:
                    seen_before[k] = True
                    self.n_dup_lines[d] += 1
                seen.add(x)
                k += 1
        lo = np.concatenate([[0], breaks + 1])[used]
        hi = breaks[used]

        def per_line(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[hi] - total[lo]

        def by_word(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, at) if len(at) else np.zeros(0)

        upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 192) & (cp <= 222) & (cp != 215))
        chars = np.maximum(per_line((cp != 32) & ((cp < 9) | (cp > 13))), 1)
        words = np.maximum(self.words, 1)
        repeat = np.concatenate([[False], (ids[1:] == ids[:-1]) & (line[1:] == line[:-1])]) if len(ids) else np.zeros(0, bool)
        last = cp[np.maximum(end[np.concatenate([at[1:], [len(begin)]]) - 1] - 1, 0)] if len(at) else np.zeros(0, np.int64)
        pairs = np.unique(line.astype(np.int64) << 32 | ids)
        variety = np.bincount(np.searchsorted(used, pairs >> 32), minlength=len(used)) / words if len(used) else np.zeros(0)
        self.x = np.stack(
            [
                np.ones(len(used)),
                np.minimum(1, 5 * per_line(symbol) / chars),
                np.minimum(1, 3 * by_word(cp[begin] == 124) / words),
                np.minimum(1, per_line(upper) / chars),
                np.minimum(1, 3 * per_line((cp >= 48) & (cp <= 57)) / chars),
                np.minimum(1, 5 * per_line(cp == 33) / chars),
                np.minimum(1, 2 * by_word(repeat) / words),
                variety,
                np.minimum(2, by_word(length) / words / 10),
                np.minimum(1, np.log1p(words) / 5),
                np.isin(last, [33, 46, 63, 0x2026]),
                seen_before,
                words < 4,
            ],
            axis=1,
        ).astype(np.float64)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)


def _word_ids(texts: list[str]) -> np.ndarray:
    """The words of all texts as numbers, equal exactly if the words are."""
    flat = pc.list_flatten(pc.ascii_split_whitespace(pa.array(texts, pa.large_string())))
    flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of five that their document has twice or more. Ranks of pairs, fours and fives are exact."""
    m = len(ids) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    whole = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    # only windows whose first pair recurs within the document can recur
    pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, times = np.unique(doc[whole] << 32 | pair[whole], return_inverse=True, return_counts=True)
    whole = whole[times[inverse] > 1]
    if not len(whole):
        return np.zeros(n, np.int64)
    four = np.unique(pair[whole] << 32 | pair[whole + 2], return_inverse=True)[1].astype(np.int64)
    five = np.unique(four << 32 | ids[whole + 4], return_inverse=True)[1].astype(np.int64)
    _, inverse, times = np.unique(doc[whole] << 32 | five, return_inverse=True, return_counts=True)
    hit = whole[times[inverse] > 1]
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + WINDOW, -1)
    return np.bincount(doc, np.cumsum(mark)[:-1] > 0, minlength=n).astype(np.int64)[:n]


class LineCRF:
    """Two states (0 boilerplate, 1 content): emission score x.w for content, a transition and a start weight for each state."""

    def __init__(self):
        self.w, self.trans, self.start = np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2)

    @staticmethod
    def _layout(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences sorted by length, longest first: their first lines, lengths, and how many reach each step."""
        _, first, size = np.unique(doc, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        reach = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        return first, size, reach

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.zeros(len(x)), x @ self.w], 1)

    def viterbi(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The likeliest labels of all lines; doc numbers their sequences. A tie goes to content."""
        out = np.zeros(len(doc), np.int64)
        if not len(doc):
            return out
        first, size, reach = self._layout(doc)
        e = self._emissions(x)
        back = np.zeros((len(doc), 2), np.int8)
        score = e[first] + self.start
        final = score.copy()
        for t in range(1, len(reach)):
            k = reach[t]
            step = score[:k, :, None] + self.trans
            from_1 = step[:, 1] >= step[:, 0]
            back[first[:k] + t] = from_1
            score = np.where(from_1, step[:, 1], step[:, 0]) + e[first[:k] + t]
            final[:k] = score
        state = (final[:, 1] >= final[:, 0]).astype(np.int64)
        for t in range(len(reach) - 1, -1, -1):
            k = reach[t]
            out[first[:k] + t] = state[:k]
            state[:k] = back[first[:k] + t, state[:k]]
        return out

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.15, ridge: float = 1e-3) -> LineCRF:
        """Maximum likelihood by Adam; gradients from forward and backward sums over all sequences at once."""
        if not len(doc):
            self.w[0] = 1.0
            return self
        first, size, reach = self._layout(doc)
        n = len(doc)
        after = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        seen_trans = np.zeros((2, 2))
        np.add.at(seen_trans, (y[after - 1], y[after]), 1)
        seen_start = np.bincount(y[first], minlength=2)
        theta = np.zeros(len(FEATURES) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        lse = np.logaddexp
        for i in range(1, steps + 1):
            self.w, self.trans, self.start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
            e = self._emissions(x)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[first] = e[first] + self.start
            for t in range(1, len(reach)):
                at = first[: reach[t]] + t
                p = alpha[at - 1]
                alpha[at] = e[at] + lse(p[:, :1] + self.trans[0], p[:, 1:] + self.trans[1])
            for t in range(len(reach) - 1, 0, -1):
                at = first[: reach[t]] + t
                q = e[at] + beta[at]
                beta[at - 1] = lse(self.trans[:, 0] + q[:, :1], self.trans[:, 1] + q[:, 1:])
            z = lse(*(alpha + beta).T)
            marginal = np.exp(alpha + beta - z[:, None])
            q = e[after] + beta[after]
            both = np.exp(alpha[after - 1][:, :, None] + self.trans + q[:, None, :] - z[after][:, None, None]).sum(0)
            g = np.concatenate([x.T @ (y - marginal[:, 1]), (seen_trans - both).ravel(), seen_start - marginal[first].sum(0)]) / n - ridge * theta
            m = 0.9 * m + 0.1 * g
            v = 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        self.w, self.trans, self.start = theta[:-6].copy(), theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy()
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = 400, volume: int = 16 << 20) -> LineCRF:
    """At most *rows* documents of each quality label, of *volume* bytes together; each line takes the label of its document."""
    sample = labelled(docs, labels, "quality", rows, volume)
    lines = Lines([t for t, _ in sample])
    y = np.array([y for _, y in sample], np.int64)
    return LineCRF().fit(lines.x, lines.doc, y[lines.doc] if len(y) else np.zeros(0, np.int64))


def quality_rules(docs: DataFrame, crf: LineCRF, share: float = 0.5) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, n_words, the base counts, base_failed, content_share, kept.

    A document is kept if it passes the base rules and at least *share* of its words are in lines that Viterbi decoding
    labels content. Null or empty text: no words, fails. Null doc_id: kept as null. Other columns are ignored.
    """
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean, n_lines long, n_boilerplate long"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = texts_of(b)
            s = Lines(texts)
            content = crf.viterbi(s.x, s.doc)
            n = len(texts)
            in_content = np.bincount(s.doc, s.words * content, minlength=n)[:n]
            kept_share = in_content / np.maximum(s.n_words, 1)
            failed = s.base_failed()
            lines = np.bincount(s.doc, minlength=n)[:n]
            boiler = lines - np.bincount(s.doc, content, minlength=n).astype(np.int64)[:n]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)), pa.array(failed), pa.array(kept_share), pa.array(~failed & (kept_share >= share)), pa.array(lines.astype(np.int64)), pa.array(boiler)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)
