"""Substring dedup: shared k-mer seeds chained with gap costs through a tree of maxima, and aligned."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, code_points, stored, texts_of, word_spans
from .minhash import _A, _finish, _places


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and each text's first word (and the end)."""
    cp, start = code_points(texts)
    begin, end = word_spans(cp)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    length = end - begin
    at = np.repeat(begin, length)
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    h = cp[at + inner].astype(np.uint64) * _places(int(length.max()))[inner]
    return _finish(np.add.reduceat(h, np.cumsum(length) - length) + length.astype(np.uint64)), np.searchsorted(begin, start)


def minimizers(words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers that are least among *window* in a row: any window has one, whatever surrounds it.

    Picks of one hash at equal steps, as in text with a period, are one: the third array has last - first place of such a run
    times (window + 1) plus its step, and 0 for a pick by itself.
    """
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s = s + words[j : j + m] * _A[j % 12]
    s = (_finish(s) >> np.uint64(1)).astype(np.int64)
    if m <= window:
        pick = np.array([int(np.argmin(s))])
    else:
        pick = np.unique(np.argmin(np.lib.stride_tricks.sliding_window_view(s, window), axis=1) + np.arange(m - window + 1))
    step = np.diff(pick, prepend=pick[0])
    same = np.concatenate([[False], s[pick][1:] == s[pick][:-1]])
    fresh = ~same
    fresh[1:] |= same[:-1] & (step[1:] != step[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(pick)) - 1
    run = np.where(last > first, (pick[last] - pick[first]) * (window + 1) + step[last], 0)
    return pick[first], s[pick[first]], run


def matches(at: int, run: int, partner_at: int, partner_run: int, k: int, window: int) -> Iterator[tuple[int, int]]:
    """The anchors of a link: the two places, or where both are runs of one step, the shorter run laid along the first one."""
    (span, step), (partner_span, partner_step) = divmod(run, window + 1), divmod(partner_run, window + 1)
    if not step or step != partner_step:
        yield from ((x, partner_at) for x in range(at, at + span + 1, step or 1))
        return
    for x in range(at, at + span + 1, partner_span + step):
        n = min(partner_span, at + span - x)
        yield from ((x + i, partner_at + i) for i in (*range(0, n, k), n))


class FenwickMaxima:
    """A Fenwick tree of maxima over places, with the item that has each; items leave in the order in which they came.

    Node j holds the largest of places j - lowbit(j) < place <= j. A place that falls is mended from the child nodes of each node
    above it; a range is walked down from its end by nodes that lie within it. Both take at most log(n)**2 steps.
    """

    NONE = (-np.inf, -1)

    def __init__(self, n: int):
        self.n = n
        self.node: list = [self.NONE] * (n + 1)
        self.at: list[deque] = [deque() for _ in range(n + 1)]

    def _own(self, i: int) -> tuple[float, int]:
        return self.at[i][0] if self.at[i] else self.NONE

    def _mend(self, i: int) -> None:
        while i <= self.n:
            best, child = self._own(i), 1
            while child < i & -i:
                best = max(best, self.node[i - child])
                child *= 2
            self.node[i] = best
            i += i & -i

    def put(self, i: int, value: float, item: int) -> None:
        q = self.at[i + 1]
        while q and q[-1][0] <= value:  # they leave earlier and never count again
            q.pop()
        q.append((value, item))
        if len(q) == 1:
            self._mend(i + 1)

    def drop(self, i: int, item: int) -> None:
        q = self.at[i + 1]
        if q and q[0][1] == item:
            q.popleft()
            self._mend(i + 1)

    def within(self, i: int, j: int) -> tuple[float, int]:
        """The largest over places i <= place < j."""
        out = self.NONE
        while j > i:
            if j - (j & -j) >= i:
                out = max(out, self.node[j])
                j -= j & -j
            else:
                out = max(out, self._own(j))
                j -= 1
        return out


def diagonal_runs(anchors: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Matches in a row on one diagonal, joined where they touch: x and y of the first, x of the last."""
    runs: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for x, y in sorted(anchors):
        r = open_.get(x - y)
        if r is not None and x - r[2] <= k:
            r[2] = x
        else:
            open_[x - y] = r = [x, y, x]
            runs.append(r)
    return [(x, y, last) for x, y, last in runs]


def linked(runs: list[tuple[int, int, int]], k: int, gap_cost: float, reach: int) -> tuple[list[float], list[int]]:
    """The best score of a chain that ends in each run, and the run before it there (-1: none).

    A run's own score is its words. Its best predecessor has the largest score less *gap_cost* for each word skipped on either
    side, among those that end at most *reach* words before it on both sides; farther ones are none, so that a chain is cut
    where it skips more.
    """
    ends = [(last + k, y + last - x + k) for x, y, last in runs]
    ys = sorted({y for _, y in ends})
    tree = FenwickMaxima(len(ys))
    score, before = [0.0] * len(runs), [-1] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: runs[i])
    waiting = sorted(range(len(runs)), key=lambda i: ends[i][0])
    w = gone = 0
    for i in order:
        x, y, x_last = runs[i]
        while w < len(waiting) and ends[waiting[w]][0] <= x:  # those that end before this one starts
            j = waiting[w]
            tree.put(bisect_left(ys, ends[j][1]), score[j] + gap_cost * sum(ends[j]), j)
            w += 1
        while gone < w and ends[waiting[gone]][0] < x - reach:
            tree.drop(bisect_left(ys, ends[waiting[gone]][1]), waiting[gone])
            gone += 1
        own = float(x_last - x + k)
        value, j = tree.within(bisect_left(ys, y - reach), bisect_left(ys, y + 1))
        gain = value - gap_cost * (x + y)
        score[i], before[i] = (own + gain, j) if gain > 0 else (own, -1)
    return score, before


def chains(anchors: list[tuple[int, int]], k: int, gap_cost: float = 0.05, reach: int = 60) -> list[tuple[int, int, int, int]]:
    """Collinear chains of matches (x, y) of k words: (x from, x to, y from, y to), ends exclusive, that share no match; best first."""
    runs = diagonal_runs(anchors, k)
    score, before = linked(runs, k, gap_cost, reach)
    out, used = [], [False] * len(runs)
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        if used[i]:
            continue
        last, j = i, i
        while True:
            used[j] = True
            if before[j] < 0 or used[before[j]]:
                break
            j = before[j]
        out.append((runs[j][0], runs[last][2] + k, runs[j][1], runs[last][1] + runs[last][2] - runs[last][0] + k))
    return out


def align(a: np.ndarray, b: np.ndarray, band: int = 64) -> float:
    """Share of equal words in a global alignment within a band, by the longer side.

    The band is *band* words wide on each side of the diagonal, and as much more as the lengths differ; only its cells are held
    and computed.
    """
    n, m = len(a), len(b)
    if n == m:
        same = int((a == b).sum())
        if same >= 0.95 * n:
            return same / max(n, 1)
    band = max(band, abs(n - m) + 16)
    lo, prev = 0, np.zeros(min(m, band) + 1, np.int32)  # columns lo .. lo + len(prev) - 1: equal words of the first so many of b
    for i in range(n):
        new_lo, hi = max(0, i * m // n - band), min(m, i * m // n + band)
        up = prev[new_lo - lo :]
        up = np.concatenate([up, np.full(max(0, hi + 1 - new_lo - len(up)), prev[-1], np.int32)])[: hi + 1 - new_lo]
        left = np.concatenate([[prev[new_lo - 1 - lo] if new_lo > lo else 0], up[:-1]])
        row = np.maximum(up, left + (np.concatenate([[False], b[:hi] == a[i]])[new_lo:] if new_lo == 0 else b[new_lo - 1 : hi] == a[i]))
        lo, prev = new_lo, np.maximum.accumulate(row).astype(np.int32)
    return int(prev[-1]) / max(n, m, 1)


def substring_dedup(docs: DataFrame, k: int = 8, window: int = 12, least: int = 50, identity: float = 0.8, reach: int = 60) -> DataFrame:
    """Passages of *least* words or more that a document shares with one of smaller doc_id, exactly or nearly; repeats within one
    document are none.

    One row each: doc_id, start, end, partner_id, partner_start, partner_end (words, ends exclusive), n_words, identity.
    Seeds are minimizers of k-word hashes; where a period repeats one, its run is one seed with a length. All places of a seed are linked with its owner, the first by (doc_id, place), and
    with no other, so a passage in n documents gives n - 1 links. A document's links with one owner are chained; neighbouring
    chains whose owners differ are one passage, whose partner is the owner of the longest; chains are then aligned word by word.
    Partners' words that a passage repeats count once towards *least*.

    Null or short text, null doc_id: no rows. Rows of one doc_id are one document, whose text is the last of theirs in order of
    code points. Texts equal as a whole are passages too. Words
    are `[^\\x20\\x09-\\x0D]+`. Empty input: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    if _repeats(docs):
        docs = stored(docs.groupBy("doc_id").agg(F.max("text").alias("text")), "texts")

    def seed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            words, first = word_hashes(texts_of(b))
            cols: list = [[], [], [], []]
            for d, i in enumerate(b.column(0).to_pylist()):
                at, h, run = minimizers(words[first[d] : first[d + 1]], k, window)
                for c, v in zip(cols, (h, np.full(len(h), i), at, run), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols], ["seed", "doc_id", "at", "run"])

    seeds = stored(docs.mapInArrow(seed, "seed long, doc_id long, at long, run long"), "seeds")  # read for the owners and for the links
    # 37 digits: 19 of the doc_id, then 9 each for place and run
    place = F.col("doc_id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + (F.col("at") * 10**9 + F.col("run")).cast("decimal(19,0)")
    owner = seeds.groupBy("seed").agg(F.min(place).alias("o"), F.min("doc_id").alias("partner_id"), F.max("doc_id").alias("far")).filter("far > partner_id")
    owner = owner.select("seed", "partner_id", (F.col("o") - F.col("partner_id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)")).cast("long").alias("partner_place"))
    links = seeds.join(owner.hint("merge"), "seed").filter("doc_id != partner_id").select("doc_id", "at", "run", "partner_id", "partner_place")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "at")

    def chain(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for doc, rows in groupby((r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0]):
            by: dict[int, list] = {}
            for _, at, run, partner, partner_place in rows:
                partner_at, partner_run = divmod(partner_place, 10**9)
                anchors = by.setdefault(partner, [])
                if run:
                    anchors += matches(at, run, partner_at, partner_run, k, window)
                else:
                    anchors.append((at, partner_at))
            found = sorted((c[0], c[1], p, c[2], c[3]) for p, anchors in by.items() for c in chains(anchors, k, reach=reach))
            group: list = []
            end = -1
            for c in [*found, None]:
                if group and (c is None or c[0] > end + k):
                    # minimizers sit inside the passage: it reaches up to a window beyond the outer ones
                    if end - group[0][0] + 2 * window >= least:
                        out += [(doc, group[0][0], *g) for g in group]
                    group, end = [], -1
                if c is not None:
                    group.append(c)
                    end = max(end, c[1])
            if len(out) > 20_000:
                yield _columns(out)
                out = []
        yield _columns(out)

    chained = stored(links.mapInArrow(chain, _CHAIN), "chains")
    ask = chained.withColumn("chain", F.xxhash64("doc_id", "from", "partner_id", "partner_from", "to"))
    ask = ask.select("chain", F.lit(0).alias("side"), F.col("doc_id").alias("of"), F.col("from").alias("a"), F.col("to").alias("b"), "doc_id", "group", "partner_id").union(ask.select("chain", F.lit(1), "partner_id", "partner_from", "partner_to", "doc_id", "group", "partner_id"))

    def cut(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = window + k
        for b in batches(it):
            words, first = word_hashes(texts_of(b))
            rows = []
            for d, (chain_, side, a, z, doc, group, partner) in enumerate(zip(*(b.column(i).to_pylist() for i in range(1, 8)), strict=True)):
                w = words[first[d] : first[d + 1]]
                lo, hi = max(0, a - margin), min(len(w), z + margin)
                rows.append((chain_, side, doc, group, partner, a, z, lo, w[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chain", "side", "doc_id", "group", "partner_id", "a", "b", "lo", "words"])

    got = docs.withColumnRenamed("doc_id", "of").join(ask, "of").select("text", "chain", "side", "a", "b", "doc_id", "group", "partner_id").mapInArrow(cut, "chain long, side int, doc_id long, group long, partner_id long, a long, b long, lo long, words binary")
    got = stored(got, "spans")
    x, y = got.filter("side = 0").alias("x"), got.filter("side = 1").alias("y")
    pairs = x.join(y, F.expr("x.chain = y.chain")).select("x.doc_id", "x.group", "x.partner_id", F.col("x.a").alias("xa"), F.col("x.b").alias("xb"), F.col("x.lo").alias("xl"), F.col("x.words").alias("xw"), F.col("y.a").alias("ya"), F.col("y.b").alias("yb"), F.col("y.lo").alias("yl"), F.col("y.words").alias("yw"))
    pairs = pairs.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "group", "xa")

    def measure(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (doc, _), rows in groupby((r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2]):
            lo = hi = None
            parts_, best = [], None
            for _, _, partner, xa, xb, xl, xw, ya, yb, yl, yw in rows:
                w, v = np.frombuffer(xw, np.uint64), np.frombuffer(yw, np.uint64)
                p, q, r, s = xa - xl, xb - xl, ya - yl, yb - yl
                while p > 0 and r > 0 and w[p - 1] == v[r - 1]:
                    p, r = p - 1, r - 1
                while q < len(w) and s < len(v) and w[q] == v[s]:
                    q, s = q + 1, s + 1
                same = align(w[p:q], v[r:s])
                if same < identity:
                    continue
                a, z = p + xl, q + xl
                if lo is not None and a > hi + k:
                    out += _passage(doc, lo, hi, parts_, best, least)
                    lo, parts_, best = None, [], None
                lo, hi = (a, z) if lo is None else (min(lo, a), max(hi, z))
                parts_.append((a, z, same, partner, r + yl, s + yl))
                if best is None or z - a > best[0]:
                    best = (z - a, partner, r + yl, s + yl)
            if lo is not None:
                out += _passage(doc, lo, hi, parts_, best, least)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64() if i == 7 else pa.int64()) for i in range(8)], ["doc_id", "start", "end", "partner_id", "partner_start", "partner_end", "n_words", "identity"])

    return pairs.mapInArrow(measure, "doc_id long, start long, end long, partner_id long, partner_start long, partner_end long, n_words long, identity double")


def _union(spans: list[tuple]) -> int:
    """Words in the union of (text, start, end)."""
    n, at = 0, None
    for t, a, b in sorted(spans):
        if at is None or at[0] != t:
            at = (t, a)
        n += max(0, b - max(a, at[1]))
        at = (t, max(b, at[1]))
    return n


def _passage(doc: int, lo: int, hi: int, parts: list, best: tuple, least: int) -> list[tuple]:
    if hi - lo < least:
        return []
    # a few partner's words that the document repeats are no longer than they are there
    gaps = hi - lo - _union([(0, a, z) for a, z, *_ in parts])
    if gaps + _union([(p, r, max(s, r + z - a)) for a, z, _, p, r, s in parts]) < least:
        return []
    return [(doc, lo, hi, best[1], best[2], best[3], hi - lo, sum((z - a) * same for a, z, same, *_ in parts) / sum(z - a for a, z, *_ in parts))]


_CHAIN = "doc_id long, group long, from long, to long, partner_id long, partner_from long, partner_to long"


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], ["doc_id", "group", "from", "to", "partner_id", "partner_from", "partner_to"])


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
