"""Secret scans: base patterns, and formats inferred from labelled credentials as probabilistic automata."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, code_points, stored, texts_of

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "format")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Candidates for the automata are whole runs of letters, digits and +/_.=- from this length up, the least of a labelled value.
SHORTEST = 6
_HEX = np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
#: Classes of characters that automata and the background read: digit, a-f, other lower, upper, and each sign by itself.
_CLASS = np.full(128, -1, np.int64)
for _i, _chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")):
    _CLASS[[ord(c) for c in _chars]] = _i
_EDGE = 10  # before the first character and after the last one
_CODES = str.maketrans({chr(i): "0azA+/_.=-"[k] for i, k in enumerate(_CLASS.tolist()) if k >= 0})


def symbols(s: str) -> str:
    """The class of each character of a candidate: 0, a, z, A or the sign itself."""
    return s.translate(_CODES)


class Automaton:
    """Deterministic probabilistic automaton learnt by state merging.

    Starts from the prefix tree of the sample. States are compared in breadth-first order and are compatible if their
    stop and step frequencies, down all shared continuations, differ by no more than Hoeffding's bound at *alpha* allows, and
    the distributions of what is left of their strings by no more than the two-sample Kolmogorov-Smirnov bound: that is
    what keeps a format's length. A state joins the compatible one whose remaining lengths are the most alike; where fewer than *support*
    strings reach it, the bounds tell nothing and the lengths must be alike by half at least. Merged states fold their
    subtrees so that the result stays deterministic.
    """

    def __init__(self, sample: Iterable[str], alpha: float = 0.05, support: int = 20):
        self.n, self.stop, self.to, self.left = [0], [0], [{}], [Counter()]
        for s in sample:
            at = 0
            for i, c in enumerate(s):
                self.n[at] += 1
                self.left[at][len(s) - i] += 1
                if c not in self.to[at]:
                    self.to[at][c] = [len(self.n), 0]
                    self.n.append(0)
                    self.stop.append(0)
                    self.to.append({})
                    self.left.append(Counter())
                self.to[at][c][1] += 1
                at = self.to[at][c][0]
            self.n[at] += 1
            self.left[at][0] += 1
            self.stop[at] += 1
        self.k = math.sqrt(0.5 * math.log(2 / alpha))
        self.support = support
        red, blue = [0], deque((0, c) for c in sorted(self.to[0]))
        while blue:
            src, c = blue.popleft()
            node = self.to[src][c][0]
            if node in red:
                continue
            best = min(((d, r) for r in red if (d := self._distance(r, node)) is not None), default=None)
            if best is not None:
                self.to[src][c][0] = best[1]
                self._fold(best[1], node)
            else:
                red.append(node)
            held, members = {(s, c) for s, c in blue}, set(red)
            blue.extend((s, x) for s in red for x in sorted(self.to[s]) if self.to[s][x][0] not in members and (s, x) not in held)
        self.states = sorted(red)

    def _distance(self, a: int, b: int) -> float | None:
        """Between what is left of two states' strings; None if the states aren't compatible."""
        n, m = self.n[a], self.n[b]
        up, apart = 0.0, 0.0
        for x in sorted(self.left[a].keys() | self.left[b].keys()):
            up += self.left[a][x] / n - self.left[b][x] / m
            apart = max(apart, abs(up))
        most = 0.5 if min(n, m) < self.support else self.k * math.sqrt(1 / n + 1 / m)
        return apart if apart <= most and self._alike(a, b) else None

    def _close(self, a: int, n: int, b: int, m: int) -> bool:
        return not n or not m or abs(a / n - b / m) <= self.k * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            p, q = pair
            n, m = self.n[p], self.n[q]
            if not self._close(self.stop[p], n, self.stop[q], m):
                return False
            for c in self.to[p].keys() | self.to[q].keys():
                x, y = self.to[p].get(c), self.to[q].get(c)
                if not self._close(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            if p == q:
                continue
            self.n[p] += self.n[q]
            self.stop[p] += self.stop[q]
            self.left[p] += self.left[q]
            for c, (node, k) in self.to[q].items():
                if c in self.to[p]:
                    self.to[p][c][1] += k
                    todo.append((self.to[p][c][0], node))
                else:
                    self.to[p][c] = [node, k]

    def log_likelihood(self, s: str, floor: float = 1e-4) -> float:
        """Of the class string; a step that the sample never took costs log(floor) and stays in its state."""
        at, total = 0, 0.0
        for c in s:
            step = self.to[at].get(c)
            if step is None or not self.n[at]:
                total += math.log(floor)
                continue
            total += math.log(max(floor, step[1] / self.n[at]))
            at = step[0]
        return total + math.log(max(floor, self.stop[at] / self.n[at] if self.n[at] else 0))


def families(values: Iterable[str], support: int = 20) -> dict[str, list[str]]:
    """Labelled values by format, under a name: a literal prefix that all share, if there is one, and the classes of the rest.

    Values with a prefix up to a _ or - among their first eight characters that *support* values share are apart from others.
    Then values of the same classes belong together, and those of fewer classes to the smallest larger set of classes that more
    values have: by chance a string lacks a class. Families of fewer than *support* distinct values tell no format and are left out.
    """
    values = sorted(set(values))
    heads = Counter(m[0] for v in values if (m := _HEAD.match(v)))
    apart: dict[str, list[str]] = {}
    for v in values:
        m = _HEAD.match(v)
        apart.setdefault(m[0] if m and heads[m[0]] >= support else "", []).append(v)
    out: dict[str, list[str]] = {}
    for head, own in sorted(apart.items()):
        by: dict[frozenset, list[str]] = {}
        for v in own:
            by.setdefault(frozenset(symbols(v[len(head) :])), []).append(v)
        for k in sorted(by, key=lambda k: (len(by[k]), sorted(k))):
            larger = [x for x in by if k < x and len(by[x]) >= len(by[k])]
            if larger:
                by[min(larger, key=lambda x: (len(x), -len(by[x]), sorted(x)))] += by.pop(k)
        for k, group in sorted(by.items(), key=lambda x: sorted(x[0])):
            if len(group) >= support:
                prefix = os.path.commonprefix(group)
                prefix = prefix if len(prefix) >= 3 and all(len(v) > len(prefix) for v in group) else ""
                out[f"{prefix}[{''.join(sorted(k))}]"] = group
    return out


_HEAD = re.compile(r"[A-Za-z0-9]{1,7}[_-]")


class Formats:
    """An automaton for each family of labelled values, and a background for all candidates; a candidate's score is the log ratio.

    The background is the chain of character classes, each by the one before, over all candidates of all texts (*pairs*: their
    counts, with edges). A candidate from the background scores above t with a chance of e**-t at most, so the threshold
    log(candidates) + *margin* lets e**-margin of them through in all, however many there are. A literal prefix is part of its
    format: what lacks it is none of that format.
    """

    def __init__(self, values: Iterable[str], pairs: np.ndarray, margin: float = 3.0, support: int = 20):
        self.kinds: dict[str, tuple[str, Automaton]] = {}
        for name, group in families(values, support).items():
            prefix = name[: name.rindex("[")]
            self.kinds[name] = prefix, Automaton((symbols(v[len(prefix) :]) for v in group), support=support)
        seen = pairs.astype(np.float64) + 0.5
        self.step = np.log(seen / seen.sum(1, keepdims=True))
        self.threshold = math.log(max(1, int(pairs[_EDGE].sum()))) + margin if self.kinds else math.inf
        self._known: dict[str, bool] = {}

    def background(self, classes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log likelihoods of the runs first[i]:end[i] of an array of classes."""
        inner = np.concatenate([[0.0], np.cumsum(self.step[classes[:-1], classes[1:]])])
        return self.step[_EDGE, classes[first]] + inner[end - 1] - inner[first] + self.step[classes[end - 1], _EDGE]

    def score(self, s: str) -> float:
        c = _CLASS[np.frombuffer(s.encode("ascii"), np.uint8)]
        return self.likelihood(s) - float(self.background(c, np.array([0]), np.array([len(c)]))[0])

    def likelihood(self, s: str) -> float:
        """Of the likeliest format."""
        return max((a.log_likelihood(symbols(s[len(p) :])) for p, a in self.kinds.values() if s.startswith(p)), default=-math.inf)

    def hot(self, s: str, background: float) -> bool:
        got = self._known.get(s)
        if got is None:
            got = self.likelihood(s) - background > self.threshold
            if len(self._known) >= 100_000:
                self._known.clear()
            if len(s) <= 200:
                self._known[s] = got
        return got


def candidates(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all code points (-1: none), and starts and ends of the candidates: whole runs of SHORTEST or more."""
    classes = np.where(cp < 128, _CLASS[np.minimum(cp, 127)], -1)
    return classes, *runs(classes >= 0, SHORTEST)


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


def scan(texts: list[str], formats: Formats | None) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind index, end) of each text in order; base kinds first, then added ones that touch none of them."""
    cp, start = code_points(texts)
    low = np.minimum(cp, 127)  # 127 is in neither class
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, t in enumerate(texts):
        lower = t.lower()
        if any(h in lower for h in _HINTS):
            out[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        if "AKIA" in t:
            out[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    a, b = runs(_HEX[low], 24)
    for i, x, y in zip((np.searchsorted(start, a, side="right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
        out[i].append((x - int(start[i]), 2, y - int(start[i])))
    if formats is not None and formats.kinds:
        classes, a, b = candidates(cp)
        if len(a):
            ground = formats.background(np.maximum(classes, 0), a, b)
            # no format is likelier than 1, so that only these can score above the threshold
            may = np.flatnonzero(-ground > formats.threshold)
            clear = apart(a[may], b[may], out, start)
            for i, x, y, g in zip((np.searchsorted(start, a[may], side="right") - 1)[clear].tolist(), a[may][clear].tolist(), b[may][clear].tolist(), ground[may][clear].tolist(), strict=True):
                x, y = x - int(start[i]), y - int(start[i])
                if formats.hot(texts[i][x:y], g):
                    out[i].append((x, 3, y))
    return [sorted(s) for s in out]


def apart(a: np.ndarray, b: np.ndarray, spans: list[list[tuple[int, int, int]]], start: np.ndarray) -> np.ndarray:
    """Which of the disjoint runs a[i]:b[i] touch none of the texts' spans; by search, so many runs and many spans are no square."""
    held = [(s + int(start[i]), e + int(start[i])) for i, own in enumerate(spans) for s, _, e in own]
    ok = np.ones(len(a), bool)
    for s, e in held:
        x, y = np.searchsorted(b, s, side="right"), np.searchsorted(a, e, side="left")
        ok[x:y] = False
    return ok


def learn(docs: DataFrame, values: int = 2_000, margin: float = 3.0, support: int = 20) -> Formats:
    """Formats from the whole of *docs* (text), read once.

    The labelled credentials are the values that the base patterns find; the automata learn from at most *values* distinct ones of
    each kind, the first by a hash, of 200 characters at most each (longer ones are no format but data; they stay candidates). The background counts
    the class pairs of all candidates. To the driver come these values and 121 counts.
    """

    def found(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = np.zeros((11, 11), np.int64), set()
        for b in batches(it):
            texts = texts_of(b)
            for t, spans in zip(texts, scan(texts, None), strict=True):
                for s, k, e in spans:
                    m = ASSIGN.match(t, s) if k == 0 else None
                    held.add((KINDS[k], m[2] if m else t[s:e]))
            pairs += class_pairs(texts)
            if len(held) > 50_000:  # the rest of the partition starts anew: values are made distinct after the shuffle
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held]), pa.array([v for _, v in held]), pa.array([1] * len(held), pa.int64())], ["kind", "value", "n"])
                held = set()
        rows = [(*x, 1) for x in sorted(held)] + [("pair", str(i), int(n)) for i, n in enumerate(pairs.ravel()) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "value", "n"])

    got = stored(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(found, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs = np.zeros(121, np.int64)
    for r in got.filter("kind = 'pair'").collect():
        pairs[int(r["value"])] = r["n"]
    labelled: list[str] = []
    for k in KINDS[:3]:
        labelled += [r["value"] for r in got.filter((F.col("kind") == k) & (F.length("value") <= 200)).orderBy(F.xxhash64("value"), "value").limit(values).collect()]
    return Formats(labelled, pairs.reshape(11, 11), margin, support)


def class_pairs(texts: list[str]) -> np.ndarray:
    """How often a class follows another in the candidates of *texts*, with their edges: 11 by 11."""
    classes, a, b = candidates(code_points(texts)[0])
    inside = np.zeros(len(classes) + 1, np.int64)
    np.add.at(inside, a, 1)
    np.add.at(inside, b - 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    pair = np.concatenate([classes[at] * 11 + classes[at + 1], _EDGE * 11 + classes[a], classes[b - 1] * 11 + _EDGE])
    return np.bincount(pair, minlength=121).reshape(11, 11)


def find_secrets(docs: DataFrame, formats: Formats) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, found array<struct<start, end, kind>>, by start and then kind.

    Positions are code points, the end is exclusive. Null or empty text: no spans. Null doc_id: kept. Whole texts are read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def work(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in spans] for spans in scan(texts_of(b), formats)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, found array<struct<start: long, end: long, kind: string>>")


def redact(text: str, spans: Iterable[tuple[int, int]], mask: str = "[secret]") -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])

