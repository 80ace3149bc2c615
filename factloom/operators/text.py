"""Operators over function bodies and ordered accesses."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import sized


def body_search(bodies: DataFrame, needles: Sequence[str], body: str = "decompiled_c") -> DataFrame:
    """Bodies that contain any of *needles*, with those they contain in the given order."""
    found = F.filter(F.array(*(F.lit(n) for n in needles)), lambda n: F.col(body).contains(n))
    return bodies.withColumn("found", found).filter(F.size("found") > 0)


def constants(bodies: DataFrame, key: str, body: str, known: DataFrame, least: int = 0x100) -> DataFrame:
    """Literals of each line that *known* (value, name) has: key, line, value, name, kind.

    Literals are hexadecimal, whatever their sign, or decimal of three digits or more, and *least* or more. Exact, if *known* has the value; else, above
    0xFFFF, the lower 16 bits or the upper ones, the first of them that is *least* or more and known. One row a value, line
    and name; lines count from 0.
    """
    # a key need not be unique or non-null: lines are told apart by their own text
    lines = bodies.select(key, F.posexplode(F.split(body, "\n")).alias("line", "text"))
    hexes = F.transform(F.regexp_extract_all("text", F.lit(r"\b0[xX]([0-9a-fA-F]{1,15})\b"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    decimals = F.transform(F.regexp_extract_all("text", F.lit(r"(?<![\w])([1-9][0-9]{2,17})(?![\w])"), F.lit(1)), lambda x: x.cast("long"))
    v = lines.select(key, "line", F.explode(F.array_distinct(F.concat(hexes, decimals))).alias("value")).filter(F.col("value") >= least)
    k = sized(known.select("value", "name").distinct())
    exact = v.join(k, "value").select(key, "line", "value", "name", F.lit("exact").alias("kind"))
    rest = v.filter(F.col("value") > 0xFFFF).join(k, "value", "left_anti")
    names = k.withColumnsRenamed({"value": "half"})
    low, high = F.col("value").bitwiseAND(F.lit(0xFFFF)), F.shiftright("value", 16).bitwiseAND(F.lit(0xFFFF))
    halves = rest.join(sized(names.toDF("low", "low_name")), (low == F.col("low")) & (F.col("low") >= least), "left")
    halves = halves.join(sized(names.toDF("high", "high_name")), F.col("low").isNull() & (high == F.col("high")) & (F.col("high") >= least), "left").filter("low is not null or high is not null")
    return exact.union(halves.select(key, "line", "value", F.coalesce("low_name", "high_name"), F.when(F.col("low").isNotNull(), "lower").otherwise("upper")))


def annotate(bodies: DataFrame, body: str, names: dict[int, str]) -> DataFrame:
    """Adds a comment with the register's name after each address of *names* (one chip's map); what is annotated already stays."""
    import re

    word = re.compile(r"(0x[0-9A-Fa-f]{8}|DAT_[0-9a-f]{8})(?!\s*/\*)")

    def one(m: re.Match) -> str:
        name = names.get(int(m[1].removeprefix("DAT_").removeprefix("0x"), 16))
        return f"{m[1]} /* {name} */" if name else m[1]

    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else word.sub(one, t))

    return bodies.withColumn(body, work(body))


def boundaries(accesses: DataFrame, keys: Sequence[str], order: str, category: str, gap: int = 100, span: int = 8, least: int = 3, infra: Sequence[str] = ()) -> DataFrame:
    """Adds *segment*: a new one where the gap to the access before is over *gap*, or where the dominant category of the last *span*
    accesses differs from that of the next.

    Windows are compared where both are whole and one more access follows, and the commonest category that is not in *infra* must
    have *least* accesses or more in the next. Dominant is the commonest category that is not in *infra*, else the commonest one; the first
    seen of equally common ones.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    outside = ~F.col(category).isin(*infra) if infra else F.lit(True)

    def dominant(frame) -> tuple[Column, Column]:
        """Of a window: its dominant category and, if that isn't in *infra*, how often it occurs."""
        seen = F.collect_list(F.struct(outside.alias("outside"), F.col(category).alias("k"))).over(frame)
        counted = F.transform(F.array_distinct(seen), lambda k, i: F.struct((~k["outside"]).alias("infra"), (-F.size(F.filter(seen, lambda s: s == k))).alias("n"), i.alias("i"), k["k"].alias("k")))
        best = F.array_min(counted)
        return best["k"], F.when(best["infra"], 0).otherwise(-best["n"])

    before, _ = dominant(w.rowsBetween(-span, -1))
    after, most = dominant(w.rowsBetween(0, span - 1))
    whole = (F.row_number().over(w) > span) & (F.lead(order, span).over(w).isNotNull())
    out = accesses.withColumns({"__gap": F.col(order) - F.lag(order).over(w), "__new": whole & (before != after) & (most >= least)})
    out = out.withColumn("__cut", F.coalesce((F.col("__gap") > gap) | F.col("__new"), F.lit(False)).cast("int"))
    return out.withColumn("segment", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap", "__new", "__cut")


def segments(accesses: DataFrame, keys: Sequence[str], order: str, category: str, gap: int = 100, span: int = 8, least: int = 3, infra: Sequence[str] = ()) -> DataFrame:
    """Phases of each function: keys, phase, start, end, hits, label.

    A segment of under *least* accesses outside *infra* joins its predecessor, then neighbours of one dominant category become
    one. hits counts all accesses. The label is the dominant category: the commonest one outside *infra*, else the commonest
    one; the first seen of equally common ones. Nulls are a category of their own, outside *infra*.

    Both merges are sums over windows: a segment that doesn't join starts a group, and as a category that is dominant on both
    sides of a seam stays so in the union, runs of one label are the second merge.
    """
    own = F.coalesce(~F.col("kind").isin(*infra), F.lit(True)) if infra else F.lit(True)
    w = Window.partitionBy(*keys).orderBy("segment")
    cut = boundaries(accesses, keys, order, category, gap, span, least, infra)
    counted = cut.groupBy(*keys, "segment", F.col(category).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    whole = Window.partitionBy(*keys, "segment")
    # kinds of one segment share its number, so a range up to the current number covers the segments before and this one
    first = F.first("segment").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) == F.col("segment")
    kinds = counted.withColumn("__own", F.sum(F.when(own, F.col("n")).otherwise(0)).over(whole))
    kinds = kinds.withColumn("__lead", F.row_number().over(whole.orderBy("lo", "kind")) == 1).withColumn("__start", F.col("__lead") & (first | (F.col("__own") >= least)))
    kinds = kinds.withColumn("__group", F.sum(F.col("__start").cast("int")).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = kinds.groupBy(*keys, "__group", "kind").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("segment", "lo", "kind")).alias("seen"))
    groups = merged.groupBy(*keys, "__group").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct((~own).alias("infra"), (-F.col("n")).alias("n"), "seen", "kind")).alias("best"))
    w = Window.partitionBy(*keys).orderBy("__group")
    label = F.col("best.kind")
    new = F.row_number().over(w).eqNullSafe(1) | ~label.eqNullSafe(F.lag(label).over(w))
    runs = groups.withColumn("__new", new).withColumn("phase", (F.sum(F.col("__new").cast("int")).over(w) - 1).cast("int"))
    return runs.groupBy(*keys, "phase").agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.sum("n").alias("hits"), F.first(label).alias("label"))
