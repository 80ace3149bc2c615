"""Joins of points with address ranges and with the start before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import fixed, sized

#: So few ranges are compared with every point; beyond that points and ranges meet by page.
DOZENS = 64


def range_join(points: DataFrame, ranges: DataFrame, point: str = "addr", how: str = "inner", page: int = 12) -> DataFrame:
    """Points with the ranges [lo, hi) that hold them. *how*: inner or left. An empty range holds nothing, a null point is in none.

    Some dozens of ranges (counted) are broadcast. More are cut into pages of 2**page addresses and joined on the page, with the
    bounds as residual; points without a range come back through a left join on the same key.
    """
    hit = (F.col(point) >= F.col("lo")) & (F.col(point) < F.col("hi"))
    if ranges.limit(DOZENS + 1).count() <= DOZENS:
        return points.join(F.broadcast(ranges), hit, how)
    cut = sized(ranges.filter("lo < hi").withColumn("__page", F.explode(F.sequence(F.shiftright("lo", page), F.shiftright(F.col("hi") - 1, page)))))
    paged = points.withColumn("__at", F.shiftright(F.col(point), page))
    return paged.join(cut, (F.col("__at") == F.col("__page")) & hit, how).drop("__page", "__at")


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """*rows* with each of *values* replaced by its last non-null one up to the row, by *keys* in *order* (a total one).

    One range partitioning by (keys, order) spreads a hot key over many tasks. Each part carries forward by itself; what it
    takes over from earlier parts of its key comes from a table of one row for each part and key in it.
    """
    by = [*keys, *order]
    first = [F.col(c).asc_nulls_first() for c in by]
    # the partitioning samples its input, so it is written first; written again after, so that part numbers hold
    d = fixed(fixed(rows).repartitionByRange(*first).sortWithinPartitions(*first).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part", *keys).orderBy(*first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = d.groupBy("__part", *keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in values))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select("__part", *keys, *(F.last(c, True).over(earlier).alias(f"__{c}") for c in values))
    same = F.col("d.__part") == F.col("t.__part")
    for k in keys:
        same = same & F.col(f"d.`{k}`").eqNullSafe(F.col(f"t.`{k}`"))
    local = d.withColumns({c: F.last(c, True).over(own) for c in values})
    out = local.alias("d").join(taken.alias("t"), same)
    return out.select(*(F.coalesce(F.col(f"d.`{c}`"), F.col(f"t.`__{c}`")).alias(c) if c in values else F.col(f"d.`{c}`") for c in rows.columns))


def ranks(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """*rows* with *rank* from 0 in the whole order: a range partitioning, and a table of one row a part for what comes before it."""
    first = [F.col(c).asc_nulls_first() for c in order]
    d = fixed(rows.repartitionByRange(*first).sortWithinPartitions(*first).withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    parts = d.groupBy("__part").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    return d.join(sized(parts.withColumn("__before", before).drop("n")), "__part").withColumn("rank", F.col("__before") + F.col("__id") - F.col("__first")).drop("__part", "__id", "__first", "__before")


def owner_asof(points: DataFrame, starts: DataFrame, keys: Sequence[str] = ("source",), point: str = "at", tolerance: int = 256) -> DataFrame:
    """Points with the last start at or before them, by *keys*, null if that ends more than *tolerance* earlier.

    *starts*: keys, addr, size. Points and starts are one ordered sequence, the last start carries forward; equal places put
    the start first. No task holds a whole key.
    """
    p = points.select(*points.columns, F.lit(None).cast("long").alias("__addr"), F.lit(None).cast("long").alias("__end"), F.lit(1).alias("__kind"))
    names = [c for c in points.columns if c not in keys and c != point]
    s = starts.select(*keys, F.col("addr").alias(point), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names), F.col("addr").alias("__addr"), (F.col("addr") + F.col("size")).alias("__end"), F.lit(0).alias("__kind"))
    both = carried(p.unionByName(s), keys, [point, "__kind", "__end"], ["__addr", "__end"])
    near = F.col(point) < F.col("__end") + tolerance
    return both.filter("__kind = 1").withColumn("owner", F.when(near, F.col("__addr"))).drop("__addr", "__end", "__kind")


def resolve_registers(accesses: DataFrame, registers: DataFrame, blocks: DataFrame, alias: bool = True) -> DataFrame:
    """accesses (address) with peripheral, register_name and alias: the register at the address, else the block that holds it, else
    what an atomic alias (+0x1000 XOR, +0x2000 SET, +0x3000 CLR, in this order) stands for, register or block, else UNKNOWN_<address>;
    a null address has no peripheral.

    *registers*: address, peripheral, register_name. *blocks*: lo, hi, peripheral. Both are one chip's dimension tables. Distinct
    addresses are looked up, and each of their bases once, so that a register that is read often costs once.
    """
    # fixed values: the alias offsets
    kinds = [(0x1000, "XOR"), (0x2000, "SET"), (0x3000, "CLR")] if alias else []
    # end of fixed values
    asked = fixed(accesses.filter("address is not null").select("address").distinct())
    tries = asked.select("address", F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(off).cast("long").alias("off"), F.lit(k).alias("alias")) for i, (off, k) in enumerate([(0, None), *kinds])))).alias("t"))
    tries = tries.select("address", "t.step", "t.alias", (F.col("address") - F.col("t.off")).alias("base")).filter("base >= 0")
    own = sized(registers.groupBy(F.col("address").alias("base")).agg(F.min(F.struct("peripheral", "register_name")).alias("r")))
    hit = range_join(tries.join(own, "base", "left"), blocks.select("lo", "hi", F.col("peripheral").alias("inside")), "base", "left")
    hit = hit.filter("r is not null or inside is not null").groupBy("address").agg(F.min(F.struct("step", F.coalesce("r.peripheral", "inside").alias("peripheral"), F.coalesce("r.register_name", F.lit("")).alias("register_name"), "alias")).alias("h"))
    out = accesses.join(hit, "address", "left")
    unknown = F.when(F.col("address").isNotNull(), F.concat(F.lit("UNKNOWN_"), F.format_string("0x%08x", F.col("address"))))
    return out.withColumn("peripheral", F.coalesce("h.peripheral", unknown)).withColumn("register_name", F.coalesce("h.register_name", F.lit(""))).withColumn("alias", F.col("h.alias")).drop("h")
