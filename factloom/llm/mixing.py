"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, stored


def targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target size of each source.

    *totals*: source, source_size. The i-th source by code point (null last) weighs weights[i % len(weights)]; the
    mix is *share* times all sizes. A source stops at *cap* times its size and what it can't take goes to the others
    by weight: with sources in order of size over weight, the capped ones are a prefix. Works on one row per source.
    """
    every = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(int(x)) for x in weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    up = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(every) * float(share))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("capped", F.col("most") <= F.col("level") * F.col("w"))
    # the level at the first source that isn't capped holds for all after it
    t = t.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)["level"])
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of *docs* (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    Each document of a source has the same expected number of copies, its source's target over its size. In order of
    size and doc_id these are summed up from the source's offset in [0, 1) (from MD5 of seed and source), and a document is emitted
    once for each integer that its step crosses: at most ceil(expected) times. The order by size makes the sample stratified,
    so the words taken miss the target by about the longest document's size at most.

    The rank of a document within its source comes from one range partitioning of all rows by (source, size, doc_id)
    and the row counts by (partition, source): no task holds a source, and a hot one is spread over many.

    Null text: size 0. Null source: a source of its own, last in order. Null doc_id: sorted first, returned as null. A
    source of size 0 takes nothing. Rows alike in source, size and doc_id are ranked by their place in the input. Empty input:
    no rows. Other columns are ignored.
    """
    return _mix(*numbered(docs), weights, share, cap, seed).drop("at")


def emitted(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row of *docs* as often as mix() has copies of it, with all its columns, whatever their names."""
    rows, at = numbered(docs)
    some = _mix(rows, at, weights, share, cap, seed).filter("copies > 0").select(F.col("at").alias(at), F.col("copies").alias(f"{at}_copies"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.join(some, at).select(*names, F.explode(F.sequence(F.lit(1), F.col(f"{at}_copies"))).alias(f"{at}_copy")).select(*names)


def _mix(docs: DataFrame, at: str, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    # the range partitioning reads its input twice, once for a sample: not the texts
    d = stored(docs.select("doc_id", F.col(at).alias("at"), "source", n_words(F.col("text")).alias("size")), "sizes")
    key = ["source", "size", "doc_id", "at"]
    d = d.repartitionByRange(*(F.col(c).asc_nulls_last() for c in key)).sortWithinPartitions(*(F.col(c).asc_nulls_last() for c in key))
    d = stored(d.withColumn("mid", F.monotonically_increasing_id()), "mix").withColumn("part", F.shiftright("mid", 33))
    runs = d.groupBy("part", "source").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    # one row for each partition and source in it, at most partitions + sources
    by = Window.partitionBy("source")
    runs = runs.withColumn("ahead", F.coalesce(F.sum("rows").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    runs = runs.alias("r").join(t.alias("t"), F.expr("r.source <=> t.source")).select("part", "r.source", "first", "ahead", "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d.source"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("mid") - F.col("first") + F.col("ahead")
    out = d.alias("d").join(runs.alias("r"), F.expr("d.part = r.part and d.source <=> r.source")).withColumn("offset", offset).withColumn("rate", expected).withColumn("rank", rank.cast("double"))
    copies = (F.floor((F.col("rank") + 1.0) * F.col("rate") + F.col("offset")) - F.floor(F.col("rank") * F.col("rate") + F.col("offset"))).cast("long")
    return out.select("at", "doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))

