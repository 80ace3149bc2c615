"""Exact duplicate removal: owners of equal texts kept in Patricia tries over length-and-content-hash partitions."""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


class Node:
    """An edge label and what hangs below it; *owner* is set on terminal nodes."""

    __slots__ = ("kids", "label", "owner", "spilled")

    def __init__(self, label: bytes = b""):
        self.label = label
        self.kids: dict[int, Node] = {}
        self.owner: list | None = None  # [best id, rows, [representatives]]
        self.spilled = None  # file that holds this subtree


class PatriciaTrie:
    """Compressed radix trie of full byte strings.

    A terminal node stores the surviving identifier, the number of rows and the representatives that
    reached it. Beyond *budget* bytes of labels, the heaviest subtree under the root's branch point is
    written to a task-local file; later keys of that prefix are appended there, and the file gets a trie
    of its own (with the same budget) once the input has ended.
    """

    def __init__(self, better: Callable, budget: int = 64 << 20, depth: int = 0):
        self.root, self.better, self.budget, self.depth = Node(), better, budget, depth
        self.bytes = 0

    def insert(self, key: bytes, best, rows: int, reps: list[int]) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                _record(node.spilled, key, best, rows, reps)
                return
            if at == len(key):
                break
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = kid = Node(key[at:])
                self.bytes += len(key) - at
                node, at = kid, len(key)
                break
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            same = _common(label, key, at)
            mid = Node(label[:same])
            kid.label = label[same:]
            mid.kids[kid.label[0]] = kid
            node.kids[key[at]] = mid
            node, at = mid, at + same
        if node.owner is None:
            node.owner = [best, rows, list(reps)]
        else:
            o = node.owner
            o[0], o[1] = self.better(o[0], best), o[1] + rows
            o[2].extend(reps)
        if self.bytes > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Write out the heaviest subtree below the first branch."""
        top, path = self.root, b""
        while len(live := [k for k in top.kids.values() if k.spilled is None]) == 1 and live[0].kids and len(top.kids) == 1 and top.owner is None:
            top, path = live[0], path + live[0].label
        if not live:
            return
        weigh = {id(k): sum(len(n.label) for n in _walk(k)) for k in live}
        kid = max(live, key=lambda k: weigh[id(k)])
        out = tempfile.TemporaryFile()  # noqa: SIM115  read at the end of the task, gone with it
        for key, owner in _terminals(kid, path):
            _record(out, key, *owner)
        self.bytes -= weigh[id(kid)]
        kid.kids, kid.owner, kid.spilled = {}, None, out
        kid.label = kid.label[:1]  # everything that starts so goes to the file

    def owners(self) -> Iterator[tuple[bytes, list]]:
        for node, key in _walk_keys(self.root, b""):
            if node.owner is not None:
                yield key, node.owner
            if node.spilled is not None:
                node.spilled.seek(0)
                # a subtree that cannot be cut further by its first byte gets twice the budget
                deeper = PatriciaTrie(self.better, self.budget * 2, self.depth + 1)
                for rec in _records(node.spilled):
                    deeper.insert(*rec)
                node.spilled.close()
                yield from deeper.owners()


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of label and key[at:], by halving on slices."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(n.kids.values())


def _walk_keys(node: Node, key: bytes) -> Iterator[tuple[Node, bytes]]:
    todo = [(node, key + node.label)]
    while todo:
        n, k = todo.pop()
        yield n, k
        todo.extend((x, k + x.label) for x in n.kids.values())


def _terminals(node: Node, key: bytes) -> Iterator[tuple[bytes, list]]:
    for n, k in _walk_keys(node, key):
        if n.owner is not None:
            yield k, n.owner


def _record(f, *rec) -> None:
    data = pickle.dumps(rec, pickle.HIGHEST_PROTOCOL)
    f.write(struct.pack("<q", len(data)) + data)


def _records(f) -> Iterator[tuple]:
    while head := f.read(8):
        yield pickle.loads(f.read(struct.unpack("<q", head)[0]))  # noqa: S301  written by this task


def _better(keep: str) -> Callable:
    pick = {"smallest": min, "largest": max}[keep]
    return lambda a, b: b if a is None else a if b is None else pick(a, b)


_TAGGED = "doc_id long, rep long, n_bytes long, text_sha256 string, content binary, best long, n long"


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise: Callable[[str], str] | None = None, budget: int = 64 << 20, flush: int = 32 << 20) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Each map task folds its own copies first, by their bytes, so a text that fills a third of the corpus
    reaches the tries once a task (and once every *flush* bytes) and not once a row. What is left is dealt
    by length and SHA-256; each partition inserts full byte strings into a trie. Rows find their owner
    through the representative of their own task, a join whose keys hold no more rows than one task folds.

    Null text: counts as empty; empty texts equal each other. Null doc_id: the row belongs to its group
    and counts in group_size; it survives only if the whole group has no id (keep_id null). Rows that repeat
    both id and text of a survivor are survivors too. Other columns are ignored. Empty input: no rows.
    """
    better = _better(keep)

    def fold(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[bytes, list] = {}
        ids: list = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows: list = [[] for _ in range(7)]
            volume = 0
            first: set = set()
            for i, key, h in ids:
                e = held[key]
                lead = key not in first
                if lead:
                    first.add(key)
                for c, v in zip(rows, (i, e[0], len(key), h, key if lead else None, e[1] if lead else None, e[2] if lead else None), strict=True):
                    c.append(v)
                volume += len(key) if lead else 0
                if volume > 8 << 20:
                    yield _batch(rows)
                    rows, volume = [[] for _ in range(7)], 0
            if rows[0]:
                yield _batch(rows)

        for b in it:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = text.as_py() or ""
                key = (normalise(s) if normalise else s).encode("utf-8", "surrogatepass")
                e = held.get(key)
                if e is None:
                    held[key] = e = [task << 40 | made, i, 0, hashlib.sha256(key).hexdigest()]
                    made += 1
                    size += len(key) + 200
                e[1], e[2] = better(e[1], i), e[2] + 1
                ids.append((i, key, e[3]))
                if size > flush or len(ids) > 200_000:
                    yield from out()
                    held, ids, size = {}, [], 0
        yield from out()

    def own(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(better, budget)
        for b in it:
            for rep, key, best, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                trie.insert(key, best, n, [rep])
        rep, keep_id, n = [], [], []
        for _, (best, rows, reps) in trie.owners():
            for r in reps:
                rep.append(r)
                keep_id.append(best)
                n.append(rows)
            if len(rep) > 20_000:
                yield _owners(rep, keep_id, n)
                rep, keep_id, n = [], [], []
        yield _owners(rep, keep_id, n)

    tagged = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fold, _TAGGED), "exact")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = tagged.filter("content is not null").repartition(parts, "n_bytes", "text_sha256").select("rep", "content", "best", "n").mapInArrow(own, "rep long, keep_id long, group_size long")
    return tagged.select("doc_id", "rep", "text_sha256").join(owners.hint("merge"), "rep").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, keep: str = "smallest", normalise: Callable[[str], str] | None = None, budget: int = 64 << 20, flush: int = 32 << 20) -> DataFrame:
    """The surviving row of each group of equal texts, with all columns of *docs*; groups as in exact_dedup().

    Only survivors of each map task's own fold are shuffled, whole, and the terminal node of their text holds the best row,
    so nothing is joined back. Rows that repeat id and text are one. A text of null survives as null if its row is the best.
    """
    names, schema = docs.columns, docs.schema
    at, key_at = names.index("doc_id"), names.index("text")
    pick = _better(keep)

    def better(a: tuple, b: tuple) -> tuple:
        return a if pick(a[at], b[at]) == a[at] else b

    def key_of(text: str | None) -> bytes:
        text = text or ""
        return (normalise(text) if normalise else text).encode("utf-8", "surrogatepass")

    def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in b.columns), strict=True)

    def out(rows: Iterable[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r[key_at] or "")
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], names)

    def fold(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        size, kinds = 0, None
        for b in it:
            kinds = b.schema
            for r in rows_of(b):
                key = key_of(r[key_at])
                if key in held:
                    held[key] = better(held[key], r)
                else:
                    held[key] = r
                    size += len(key) + 200
                if size > flush:
                    yield from out(held.values(), kinds)
                    held, size = {}, 0
        if held:
            yield from out(held.values(), kinds)

    def own(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kinds = PatriciaTrie(better, budget), None
        for b in it:
            kinds = b.schema
            for r in rows_of(b):
                # the text itself is the path to its node, and only kept beside it if it isn't equal to that
                key = key_of(r[key_at])
                same = r[key_at] is not None and not normalise
                trie.insert(key, r[:key_at] + ((True,) if same else ((r[key_at],),)) + r[key_at + 1 :], 1, [])
        if kinds is not None:
            yield from out((best[:key_at] + (key.decode("utf-8", "surrogatepass") if best[key_at] is True else best[key_at][0],) + best[key_at + 1 :] for key, (best, _, _) in trie.owners()), kinds)

    text = F.coalesce(F.col("text"), F.lit("")) if not normalise else None
    folded = docs.mapInArrow(fold, schema)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if normalise:
        hash_ = F.pandas_udf(lambda s: s.map(lambda t: hashlib.sha256(key_of(t)).hexdigest()), "string")
        folded = folded.repartition(parts, hash_("text"))
    else:
        folded = folded.repartition(parts, F.octet_length(text), F.sha2(text, 256))
    return folded.mapInArrow(own, schema)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "rep", "n_bytes", "text_sha256", "content", "best", "n"])


def _owners(rep: list, keep_id: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rep, keep_id, n)], ["rep", "keep_id", "group_size"])
