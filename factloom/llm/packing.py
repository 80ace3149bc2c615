"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

The instance is its histogram: with integer lengths up to the capacity there are at most *capacity* kinds of
item however large the corpus is. Reduction and best fit run on that histogram on the driver (bounded by capacity
squared, not by rows) and give filling patterns with multiplicities; each piece then finds its place from its
rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, stored, texts_of

Pattern = tuple[tuple[int, ...], int]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix sets that provably dominate every other set holding their largest item; returns them and what is left.

    A set dominates another if the other's items, the shared one aside, can be dealt into its items so that none
    overflows: swapping them never costs a sequence. For the item j with r = capacity - j left, k the largest item <= r:
    {j} if nothing fits; {j, k} if k = r, if no two items fit together, or if at most two fit and the best pair is
    no longer than k; {j, k, b} if at most two fit and b, the largest item beside k, is as long as any item <= r / 2.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Pattern] = []

    def take(items: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for w in items:
            need[w] += 1
        times = min(left[w] // n for w, n in need.items())
        fixed.append((items, times))
        for w, n in need.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
                del sizes[bisect_left(sizes, w)]

    def largest(limit: int, without: tuple[int, ...]) -> int | None:
        i = bisect_left(sizes, limit + 1) - 1
        while i >= 0 and left[sizes[i]] <= without.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for w in sizes:
            out += [w] * min(n - len(out), left[w] - (w == without))
            if len(out) == n:
                break
        return out

    def dominating(j: int) -> tuple[int, ...] | None:
        r = capacity - j
        k = largest(r, (j,))
        if k is None:
            return (j,)
        if k == r:
            return (j, k)
        small = smallest(3, j)
        if len(small) < 2 or small[0] + small[1] > r:
            return (j, k)
        if len(small) == 3 and sum(small) <= r:
            return None
        best = max((a + b for a in sizes if a <= r and left[a] > (a == j) and (b := largest(r - a, (j, a))) is not None), default=0)
        if best <= k:
            return (j, k)
        b = largest(r - k, (j, k))
        half = largest(r // 2, (j,))
        return (j, k, b) if b is not None and half is not None and b >= half else None

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left and (items := dominating(j)):
                take(items)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, all items of a length at once: equal to placing them one by one."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [items, sequences]
    rooms: list[int] = []

    def put(items: tuple[int, ...], times: int, room: int) -> None:
        if times:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append([items, times])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                q = capacity // w
                put((w,) * q, n // q, capacity - q * w)
                put((w,) * (n % q), 1 if n % q else 0, capacity - n % q * w)
                break
            room = rooms[i]
            q = room // w
            items, times = open_[room].pop()
            if not open_[room]:
                rooms.pop(i)
            full = min(times, n // q)
            put(items + (w,) * q, full, room - q * w)
            n -= full * q
            if full < times and n:
                put(items + (w,) * n, 1, room - n * w)
                n, full = 0, full + 1
            put(items, times - full, room)
    return [(tuple(items), times) for group in open_.values() for items, times in group]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise (doc_id, text) and cut: doc_id, piece, start, length, ids_crc32, task, rank, and ids if asked for.

    A document is its ids and *end_id*. One longer than *capacity* is cut so that all pieces but the first are full.
    task and rank place a piece among those of its length that the same task made. *encoder* builds, on the executor,
    the function from text to ids. Null text: empty, one piece of *end_id* alone. Null doc_id: kept as null.
    """
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("rank", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def cut(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches(it):
            out: list = [[] for _ in kinds]
            for i, text in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    n = ((len(ids) - at - 1) % capacity + 1) if piece == 0 else capacity
                    own = ids[at : at + n]
                    for c, v in zip(out, (i, piece, at, n, zlib.crc32(own.tobytes()), task, seen[n], own.astype("int32")), strict=False):
                        c.append(v)
                    seen[n] += 1
                    at, piece = at + n, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds, strict=True)], [k for k, _ in kinds])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each piece a sequence_id and an offset; other columns stay. Empty input: no rows.

    Rank within a length = rank within (task, length) + the pieces of that length in earlier tasks, from a table of
    one row for each (task, length). No task ever holds all pieces of a length.
    """
    cut = stored(cut, "pieces")
    runs = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most *capacity* rows
    first = dict(zip(sorted(counts), np.cumsum([0, *(counts[w] for w in sorted(counts))]).tolist(), strict=False))
    used, spans, sequences = dict.fromkeys(counts, 0), [], 0
    for items, times in plan(counts, capacity):
        offset = 0
        for w in items:
            spans.append((first[w] + used[w], sequences, offset))
            used[w] += times
            offset += w
        sequences += times
    spans.sort()
    lo, seq, off = (np.array(c, np.int64) for c in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
    names = [f for f in cut.columns if f not in ("task", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names) + ", sequence_id long, offset long"

    def place(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            at = np.array([first[w] for w in length.tolist()], np.int64) + b.column(b.schema.get_field_index("place")).to_numpy()
            k = np.searchsorted(lo, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq[k] + at - lo[k]), pa.array(off[k])], [*names, "sequence_id", "offset"])

    ranked = cut.join(runs.select("task", "length", "ahead").hint("merge"), ["task", "length"]).withColumn("place", F.col("rank") + F.col("ahead"))
    return ranked.select(*names, "place").mapInArrow(place, schema)


def byte_bpe(path: str, ranks_path: str | None = None, pattern: str | None = None, special: str = "<|endoftext|>") -> Callable[[], Callable[[str], np.ndarray]]:
    """Encoder builder for a byte-level BPE file of the `tokenizers` library, without added special tokens.

    With *ranks_path* (the same vocabulary as ranks) and *pattern* the ids come from the faster library; they are equal
    (tests compare them), except that a text which spells the special token goes to the first one.
    """

    def build() -> Callable[[str], np.ndarray]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        slow: list = []

        def plain(text: str) -> np.ndarray:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        if not (ranks_path and pattern):
            return plain
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: plain(text) if special in text else np.array(fast.encode_ordinary(text), np.uint32)

    return build
