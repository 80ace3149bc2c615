"""MinHash near-duplicates: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, batches, code_points, discard, from_rows, joined, numbered, stored, texts_of, word_spans

_RNG = np.random.default_rng(20240609)
_A, _B = (_RNG.integers(1, 2**63, 16, dtype=np.uint64) * 2 + 1 for _ in range(2))
#: A list of more members than this is searched from its centre first and by whole sets then, not pair by pair.
SMALL = 16
#: So many members of a longer list, each the commonest of its share, are its centres.
CENTRES = 8
#: Chance that a pair at the threshold is missed by sketches; fixes how many retained values it must share.
LOSS = 1e-9
#: Places of texts are broadcast up to this number: 24 bytes each, some 10 MB as a hash table.
FEW = 200_000
#: log2 of the cells that count how common hashed values are; they only set an order, so collisions cost time, not pairs.
CELLS = 20


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A[14]
    h = (h ^ (h >> np.uint64(29))) * _A[15]
    return h ^ (h >> np.uint64(32))


def _places(n: int) -> np.ndarray:
    """A random odd factor for each place in a word."""
    i = np.arange(n, dtype=np.uint64)
    return _finish(i * _B[0] + _B[1]) | np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles of *words* words, A-Z in lower case.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    cp, start = code_points(texts)
    cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp)
    begin, end = word_spans(cp)
    out = [np.zeros(0, np.int64)] * len(texts)
    if not len(begin):
        return out
    length = end - begin
    at = np.repeat(begin, length)
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    h = cp[at + inner].astype(np.uint64) * _places(int(length.max()))[inner]
    word = _finish(np.add.reduceat(h, np.cumsum(length) - length) + length.astype(np.uint64) * _B[2])
    first = np.searchsorted(begin, start)
    m = len(word) - words + 1
    if m > 0:
        s = np.full(m, _B[3])
        for j in range(words):
            s = s + word[j : j + m] * _A[j % 12] + np.uint64(j)
        shingle = (_finish(s) >> np.uint64(1)).astype(np.int64)
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        if b - a >= words:
            out[d] = np.unique(shingle[a : b - words + 1])
        elif b > a:
            s = np.array([_B[4] + np.uint64(b - a)])
            for j in range(a, b):
                s = s * _A[12] + word[j]
            out[d] = (_finish(s) >> np.uint64(1)).astype(np.int64)
    return out


def node_of(s: np.ndarray) -> int:
    """One number for a whole set: rows with equal sets are one node. Depends on every member and on their order."""
    u = s.astype(np.uint64)
    return int(_finish(np.array([np.sum(_finish(u * _A[13]) * (np.arange(len(u), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64) + np.uint64(len(u))]))[0] >> np.uint64(1))


def needed(k: int, num: int, den: int) -> int:
    """How many of k retained values of the union are shared, but for a chance of LOSS, at a Jaccard of num / den."""
    t, total = num / den, 0.0
    for o in range(k + 1):
        total += math.comb(k, o) * t**o * (1 - t) ** (k - o)
        if total > LOSS:
            return max(o, 1)
    return k


class Rule:
    """Sizes that the threshold allows, in integers."""

    def __init__(self, num: int, den: int, k: int):
        self.num, self.den, self.k, self.o = num, den, k, needed(k, num, den)

    def least(self, n):
        """Members of a set of size n that any partner shares."""
        return -(-self.num * n // self.den)

    def overlap(self, n, m):
        """Shared members that two sets need."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """Of a sketch: with the rarest values first, two partners' prefixes of this length meet."""
        if n * self.den <= self.k * self.num:  # it and all partners are retained whole
            return n - self.least(n) + 1
        return min(n, self.k) - self.o + 1

    def estimate(self, a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
        """Whether the bottom of the union of two sketches has shared values enough."""
        both = np.intersect1d(a, b, assume_unique=True)
        if n <= self.k and m <= self.k:
            return len(both) >= self.overlap(n, m)
        union = np.union1d(a, b)[: self.k]
        return np.isin(union, both, assume_unique=True).sum() >= self.o


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which members of the sorted set x the sorted set y has."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _cells(h: np.ndarray) -> np.ndarray:
    return (_finish(h.astype(np.uint64)) >> np.uint64(64 - CELLS)).astype(np.int64)


def _frequencies(df: DataFrame, column: str) -> np.ndarray:
    """How often values occur in the arrays (binary int64) of *column*, by cell; at most 2**CELLS numbers reach the driver."""

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int64)
        for b in it:
            for x in b.column(0):
                np.add.at(total, _cells(np.frombuffer(x.as_py(), np.int64)), 1)
        used = np.flatnonzero(total)
        part = used >> (CELLS - 4)
        rows = [(int(p), used[part == p].astype(np.int32).tobytes(), total[used[part == p]].tobytes()) for p in np.unique(part)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "cells", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << (CELLS - 4), np.int64)
        p = int(pdf["part"].iloc[0])
        for c, n in zip(pdf["cells"], pdf["counts"], strict=True):
            total[np.frombuffer(c, np.int32) - (p << (CELLS - 4))] += np.frombuffer(n, np.int64)
        return pd.DataFrame({"part": [p], "counts": [total.tobytes()]})

    out = np.zeros(1 << CELLS, np.int64)
    for r in df.select(column).mapInArrow(count, "part int, cells binary, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        p = r["part"]
        out[p << (CELLS - 4) : (p + 1) << (CELLS - 4)] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of *edges* (a, b): comp is the least node that can be reached.

    Each round hooks every node to its least neighbour, follows those pointers a few times, and contracts the edges; all
    tables are written to the shared folder, none comes to the driver but the number of edges left.
    """
    e = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    labels = before = None
    while True:
        parent = e.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("comp"))
        hook = parent = stored(parent, "hook")
        for _ in range(3):
            up = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            parent = parent.join(up, "comp").select("node", F.col("top").alias("comp"))
        parent = stored(parent, "jump")
        labels = parent if labels is None else labels.join(parent.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        old, labels = (before, e), stored(labels, "labels")
        before = labels
        pa_, pb = parent.select(F.col("node").alias("a"), F.col("comp").alias("x")), parent.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        e = stored(e.join(pa_, "a").join(pb, "b").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "contracted")
        discard(hook, parent, *(x for x in old if x is not None))
        if e.isEmpty():
            discard(e)
            return labels


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """*labels* (node, comp) after *links* (a, b) between nodes, of which those without a label are components of their own.

    The former labels are discarded. The work is on the components that the links touch, not on all nodes again.
    """

    e = links.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    e = stored(e.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a != b").distinct(), "joins")
    if e.isEmpty():
        discard(e)
        return labels
    found = components(e)
    top = found.toDF("comp", "top")
    moved = labels.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = top.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti").toDF("node", "comp")
    out = stored(moved.unionByName(new), "labels")
    discard(e, found, labels)
    return out


def _arrow(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))


class NearDuplicates:
    """The job over one corpus; see near_duplicates()."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int, k: int, at: str | None = None):
        docs, at = (docs, at) if at else numbered(docs)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(at).alias("at"))
        self.words, self.rule = words, Rule(num, den, k)

    def sets(self) -> DataFrame:
        words, k = self.words, self.rule.k

        def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                s = shingle_sets(texts_of(b), words)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(x) for x in s], pa.int64()), pa.array([node_of(x) if len(x) else None for x in s], pa.int64()), pa.array([x[:k].tobytes() for x in s], pa.binary())], ["doc_id", "at", "n", "node", "sketch"])

        return stored(self.docs.mapInArrow(work, f"doc_id long, at {ROW}, n long, node long, sketch binary"), "sketches")

    def postings(self, classes: DataFrame) -> DataFrame:
        """The rarest retained values of each node, so many that two partners share one: value, node, n, rare.

        rare is least for the node whose values are the commonest: of a group of edited copies, that is the text they were made from.
        """
        rule = self.rule
        seen = classes.sparkSession.sparkContext.broadcast(_frequencies(classes, "sketch"))

        def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common = seen.value
            for b in it:
                cols: list = [[], [], [], []]
                for node, n, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    h = np.frombuffer(x, np.int64)
                    f = common[_cells(h)]
                    pick = h[np.lexsort((h, f))[: rule.prefix(n)]]
                    for c, v in zip(cols, (pick, np.full(len(pick), node), np.full(len(pick), n), np.full(len(pick), -int(1000 * np.log2(np.clip(f, 1, 64)).sum()))), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols], ["value", "node", "n", "rare"])

        return classes.select("node", "n", "sketch").mapInArrow(work, "value long, node long, n long, rare long")

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Those of *pairs* (a, b) whose whole sets reach the threshold, after the union-sketch estimate."""
        rule = self.rule
        side = classes.select("node", "n", "sketch", "who")

        def likely(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                keep = [rule.estimate(np.frombuffer(x, np.int64), n, np.frombuffer(y, np.int64), m) for n, x, m, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        both = both.filter(F.least("na", "nb") * rule.den >= F.greatest("na", "nb") * rule.num)
        few = stored(both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(likely, "a long, b long"), "likely")
        nodes = few.select(F.col("a").alias("node")).union(few.select("b")).distinct()
        whole = stored(self.whole_sets(nodes.join(side.select("node", "who"), "node")), "whole")
        out = stored(self.exact(few, whole), "links")
        discard(few, whole)
        return out

    def exact(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """Those of *pairs* (a, b) whose sets in *whole* (node, members) reach the threshold; not stored."""
        rule = self.rule

        def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                    shared = int(_within(x, y).sum())
                    keep.append(rule.den * shared >= rule.num * (len(x) + len(y) - shared))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        sets = pairs.join(whole.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a").join(whole.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b")
        return sets.select("a", "b", "ma", "mb").mapInArrow(work, "a long, b long")

    def whole_sets(self, ids: DataFrame, then: Callable = iter, schema: str = "node long, members binary") -> DataFrame:
        """The sets of the nodes in *ids* (node, who), from the text of one row each: node, members (sorted int64).

        *then* makes *schema* of their record batches in the same Python worker: by a second mapInArrow each task would hold two.
        """
        words = self.words

        def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches(it):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(texts_of(b), words)], pa.binary())], ["node", "members"])

        ids = stored(ids.select("node", F.col("who.at").alias("at")), "ids")
        # 24 bytes a row: counted, and sent to the texts if it is small; otherwise both sides are dealt by place
        few = F.broadcast(ids) if ids.count() <= FEW else ids
        key = lambda s: F.xxhash64(f"{s}.at.file", f"{s}.at.row")  # noqa: E731  one number, which Spark's tables hold in less memory
        texts = self.docs.alias("d").join(few.alias("i"), (key("d") == key("i")) & (F.col("d.at") == F.col("i.at"))).select("node", "text")
        return texts.mapInArrow(lambda it: then(work(it)), schema)

    def counted(self, ids: DataFrame, total: int) -> DataFrame:
        """Each whole set of the nodes in *ids* (node, who), of *total* members together, with how many of these sets hold each of its shingles: node, members, seen (int64).

        Sets are cut by ranges of hash values, a task counts all values of its ranges, and the counted parts come back
        together by batch of sets.
        """
        parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // 2_000_000) + 1)
        edges = np.linspace(0, 2.0**63, parts + 1)[1:-1].astype(np.int64)

        kinds = ("part", "batch", "head", "places", "members"), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

        def scatter(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each batch of sets a row with its nodes and sizes, and one row for each range of hash values."""
            for i, b in enumerate(joined(it, "members", 8 << 20)):
                uid = TaskContext.get().partitionId() << 32 | i
                sets = [np.frombuffer(x.as_py(), np.int64) for x in b.column(1)]
                h = np.concatenate(sets)
                head = np.array([b.column(0).to_pylist(), [len(x) for x in sets]], np.int64)
                part = np.searchsorted(edges, h, side="right")
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(uid % parts, uid, head.tobytes(), b"", b"")]
                rows += [(k, uid, b"", order[p:q].tobytes(), h[order[p:q]].tobytes()) for k, (p, q) in enumerate(zip(cut, cut[1:], strict=False)) if q > p]
                yield _arrow(rows, *kinds)

        def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            sizes = np.cumsum([0] + [len(r[4]) // 8 for r in held])
            _, inverse, times = np.unique(np.frombuffer(b"".join(r[4] for r in held), np.int64), return_inverse=True, return_counts=True)
            seen = times[inverse].astype(np.int64) if len(times) else np.zeros(0, np.int64)
            for i in range(0, len(held), 1_000):
                yield _arrow([(*r[1:], seen[sizes[j] : sizes[j + 1]].tobytes()) for j, r in enumerate(held[i : i + 1_000], i)], ("batch", "head", "places", "members", "seen"), (pa.int64(), *[pa.binary()] * 4))

        def gather(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in groupby((r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0]):
                rows = list(rows)
                node, size = np.frombuffer(next(r[1] for r in rows if r[1]), np.int64).reshape(2, -1)
                h, f = np.zeros(size.sum(), np.int64), np.zeros(size.sum(), np.int64)
                for r in rows:
                    at = np.frombuffer(r[2], np.int64)
                    h[at], f[at] = np.frombuffer(r[3], np.int64), np.frombuffer(r[4], np.int64)
                end = np.cumsum(size)
                yield _arrow([(i, h[q - n : q].tobytes(), f[q - n : q].tobytes()) for i, n, q in zip(node.tolist(), size.tolist(), end.tolist(), strict=True)], ("node", "members", "seen"), (pa.int64(), pa.binary(), pa.binary()))

        parted = self.whole_sets(ids, scatter, "part long, batch long, head binary, places binary, members binary").repartition(parts, "part").mapInArrow(count, "batch long, head binary, places binary, members binary, seen binary")
        return stored(parted.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(gather, "node long, members binary, seen binary"), "counted")

    def deltas(self, members: DataFrame, counted: DataFrame) -> DataFrame:
        """What sets the sets in long lists apart from their lists' pivots, as far as two partners must share it.

        *members*: (node, pivot). Let D be the symmetric difference of a set and the pivot; removed values are written
        as complements. Partners x, y differ in H = (den - num)(x + y) / (den + num) values at most, so they share
        (|Dx| + |Dy| - H) / 2 of their D at least, and where that is none, both are linked with the pivot: a pair of two
        components has a far member, one not linked with the pivot. Values of D are in order: added ones, the rarest first,
        then removed ones. The first value that partners share leaves both enough of D behind it; a near set's is in its first
        half, and so is a far one's that meets a far one. Only those are posted. Edited copies differ from their pivot in
        values of their own, so that few of them meet here, though their sets are nearly alike.

        Rows: pivot, value, node, n, d = |D|, left (of D from this value on), near, half; a null value is a link of
        node and pivot.
        """
        num, den = self.rule.num, self.rule.den

        def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(),) * 6 + (pa.bool_(),) * 2
            for b in it:
                cols: list = [[] for _ in kinds]
                for node, pivot, x, f, c, g in zip(*b.columns, strict=True):
                    x, f, c, g = (np.frombuffer(y.as_py(), np.int64) for y in (x, f, c, g))
                    new, gone = ~_within(x, c), ~_within(c, x)
                    a, r = x[new], c[gone]
                    d = len(a) + len(r)
                    if not d:
                        continue
                    i, j = np.lexsort((a, f[new])), np.lexsort((r, -g[gone]))
                    value = np.concatenate([a[i], ~r[j]])
                    met = np.concatenate([f[new][i] > 1, np.ones(len(r), bool)])
                    left = np.arange(d, 0, -1)
                    half = (num + den) * (2 * left - d) + (den - num) * (len(x) - len(c)) > 0
                    near = (num + den) * d <= (den - num) * (len(x) + len(c))
                    keep = np.flatnonzero(met & (half if near else left >= max(1, d - (den - num) * len(x) // num)))
                    if near:
                        for col, v in zip(cols, (pivot.as_py(), None, node.as_py(), len(x), d, d, True, True), strict=True):
                            col.append(pa.array([v]))
                    m = len(keep)
                    for col, v in zip(cols, (np.full(m, pivot.as_py()), value[keep], np.full(m, node.as_py()), np.full(m, len(x)), np.full(m, d), left[keep], np.full(m, near), half[keep]), strict=True):
                        col.append(pa.array(v))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([y.cast(k) for y in col]) if col else pa.array([], k) for col, k in zip(cols, kinds, strict=True)], ["pivot", "value", "node", "n", "d", "left", "near", "half"])

        x, c = counted.toDF("node", "members", "seen"), counted.toDF("pivot", "pivot_members", "pivot_seen")
        both = members.join(x, "node").join(c, "pivot").select("node", "pivot", "members", "seen", "pivot_members", "pivot_seen")
        return stored(both.mapInArrow(work, "pivot long, value long, node long, n long, d long, left long, near boolean, half boolean"), "deltas")

    def crossing(self, x: str, y: str) -> "F.Column":
        """Whether two postings of one value may be partners' first shared one, and are of two components."""
        num, den = self.rule.num, self.rule.den
        c = lambda s, k: F.col(f"{s}.{k}")
        enough = (num + den) * (c(x, "d") + c(y, "d")) - (den - num) * (c(x, "n") + c(y, "n")) <= 2 * (num + den) * F.least(c(x, "left"), c(y, "left"))
        size = F.least(c(x, "n"), c(y, "n")) * den >= F.greatest(c(x, "n"), c(y, "n")) * num
        meet = F.when(c(x, "near"), ~c(y, "near")).when(c(y, "near"), True).otherwise(c(x, "half") & c(y, "half"))
        return (c(x, "comp") != c(y, "comp")) & meet & size & enough

    def dense(self, lists: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels after the links that cross components within long lists (value, node, rare), by differences from pivots.

        Postings are first compared with the nearest to the pivot and with their neighbours in order of that distance,
        the links are contracted, and only pairs that still cross components are compared after that.
        """
        pivot = lists.groupBy("value").agg(F.min_by("node", F.struct("rare", "node")).alias("pivot"))
        members = stored(lists.join(pivot, "value").select("node", "pivot").distinct(), "members")
        ids = classes.join(members.select("node").union(members.select("pivot")).distinct(), "node", "left_semi")
        whole = self.counted(ids, ids.agg(F.sum("n")).first()[0] or 0)
        found = self.deltas(members.filter("node != pivot"), whole)
        labels = contracted(labels, found.filter("value is null").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        posted = found.filter("value is not null")
        for nearest in (True, False):
            named = posted.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            open_ = named.groupBy("pivot", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "n", "d", "left", "near", "half", "comp"), F.struct("d", "node")).alias("first")).filter("lo != hi")
            named = stored(named.join(open_.select("pivot", "value", "first"), ["pivot", "value"]), "open-deltas")
            if nearest:
                pairs = named.alias("x").select("x.*", "first").filter(self.crossing("x", "first")).select(F.col("node").alias("a"), F.col("first.node").alias("b")).union(self.neighbours(named))
            else:
                x, y = named.filter("not near").alias("x"), named.alias("y")
                same = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.value") == F.col("y.value")) & self.crossing("x", "y")
                # two far ones meet by halves; a far and a near one by any posting
                far = x.filter("half").join(y.filter("half and not near"), same & (F.col("x.node") < F.col("y.node")))
                pairs = far.select("x.node", "y.node").union(x.join(y.filter("near"), same).select("x.node", "y.node")).toDF("a", "b")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            labels = contracted(labels, self.exact(pairs, whole))
            discard(named)
        discard(members, whole, found)
        return labels

    def neighbours(self, named: DataFrame) -> DataFrame:
        """Pairs (a, b) of postings of one value that follow each other in order of d; a range partitioning, so no task holds a whole list."""
        num, den = self.rule.num, self.rule.den
        key = ["pivot", "value", "d", "node"]

        def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for b in it:
                t = pa.Table.from_batches([b] if last is None else [last, b])
                last = b.slice(b.num_rows - 1)
                c = {k: t.column(k).to_numpy(zero_copy_only=False) for k in ("pivot", "value", "node", "n", "d", "left", "near", "half", "comp")}
                x, y = ({k: v[s] for k, v in c.items()} for s in (slice(None, -1), slice(1, None)))
                enough = (num + den) * (x["d"] + y["d"]) - (den - num) * (x["n"] + y["n"]) <= 2 * (num + den) * np.minimum(x["left"], y["left"])
                size = np.minimum(x["n"], y["n"]) * den >= np.maximum(x["n"], y["n"]) * num
                meet = (x["near"] != y["near"]) | (~x["near"] & ~y["near"] & x["half"] & y["half"])
                ok = (x["pivot"] == y["pivot"]) & (x["value"] == y["value"]) & (x["comp"] != y["comp"]) & meet & size & enough
                yield pa.RecordBatch.from_arrays([pa.array(x["node"][ok]), pa.array(y["node"][ok])], ["a", "b"])

        rows = named.select("pivot", "value", "node", "n", "d", "left", "near", "half", "comp")
        return rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(work, "a long, b long")

    def run(self) -> DataFrame:
        sets = self.sets()
        has = sets.filter("node is not null")
        classes = stored(has.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "at")).alias("who")), "classes")
        posted = stored(self.postings(classes), "postings")
        # first each list's centres, the members of the commonest values, against the others
        many = posted.groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        part = F.when(F.col("m") > SMALL, F.pmod("node", F.lit(CENTRES))).otherwise(0)
        sized = posted.join(many, "value").withColumn("part", part)
        centre = sized.groupBy("value", "part").agg(F.min_by(F.struct("node", "n"), F.struct("rare", "node")).alias("c")).select("value", "c")
        fits = F.least("n", "c.n") * self.rule.den >= F.greatest("n", "c.n") * self.rule.num
        star = sized.join(centre, "value").filter((F.col("node") != F.col("c.node")) & fits).select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        links = self.verified(star, classes)
        if links.isEmpty():
            labels = from_rows(links.sparkSession, [], "node long, comp long")
        else:
            labels = components(links)
        # then whatever a list still holds in several components
        held = stored(posted.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "held")
        open_ = held.groupBy("value").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("m > 1 and lo != hi").select("value", "m")
        rest = stored(held.join(open_, "value"), "open")
        x, y = (rest.filter(F.col("m") <= SMALL).alias(s) for s in "xy")
        size = F.least("x.n", "y.n") * self.rule.den >= F.greatest("x.n", "y.n") * self.rule.num
        pairs = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & size).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        more = self.verified(pairs, classes)
        labels = contracted(labels, more)
        discard(more, links, posted, held)
        long_ = rest.filter(F.col("m") > SMALL)
        if not long_.isEmpty():
            labels = self.dense(long_.select("value", "node", "rare"), classes, labels)
        discard(rest)
        named = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("who").alias("least"))
        named = named.select("node", "comp").join(least, "comp").select("node", "least")
        out = sets.select("doc_id", "at", "n", "node").join(named, "node", "left")
        alone = F.col("node").isNull()
        return out.select("at", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), (alone | (F.col("least.at") == F.col("at"))).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, k: int = 32) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Documents whose sets of *words*-word shingles have a Jaccard of num / den or more are linked. Rows of equal sets are one
    node. Each node keeps the k least hashes of its set; a pair at the threshold shares so many of them that one is among the
    rarest k - o + 1 of both (chance of less: LOSS), so only these are posted. In each inverted list centres are compared with
    the others, the links give components, and pairs that cross components are compared after that: all of them in lists of
    SMALL members at most, in longer ones those whose differences from the list's pivot allow it (NearDuplicates.deltas;
    lossless, so SMALL changes the time and not the result). The union-sketch estimate drops unlikely pairs, exact Jaccard on
    whole sets decides. Copies and edited copies cost in proportion to their number, unless many share their edits too and
    still are of several components.

    Rows are told apart by their place in the input and not by doc_id. kept: one row of each component, the one of least
    doc_id (nulls last), ties by place. Null or wordless text: an empty set, linked with nothing, kept. Null doc_id: linked
    like any other; a component of null ids only has the id null. A repeated doc_id is two documents of one id. Other
    columns are ignored. Empty input: no rows.
    """
    return NearDuplicates(docs, words, num, den, k).run().drop("at")


def survivors(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, k: int = 32) -> DataFrame:
    """The rows of *docs* that near_duplicates() keeps, with all their columns, whatever their names."""
    rows, at = numbered(docs)
    return rows.join(NearDuplicates(rows, words, num, den, k, at).run().filter("kept").select(F.col("at").alias(at)), at, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
