"""Feature assembly and structural signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import auto_named
from .tables import portions, tiled

KEY = ["source", "addr"]
STRICT = ["size", "blocks", "instructions", "out_calls", "distinct_callees", "reads", "writes", "jumps"]
RELAXED = STRICT[:5]
SKELETON = STRICT[:3]


def structural_signature(functions: DataFrame, blocks: DataFrame, calls: DataFrame, xrefs: DataFrame, least_size: int = 8) -> DataFrame:
    """The 8-tuple of each function; computed jumps are no jumps of it: one aggregate a fact table, all joined on (source, addr) so that they share a partitioning.

    Thunks and functions smaller than *least_size* are left out before the joins; a function without facts counts 0. The number of
    partitions follows the tables' size: one task holds rows of all four.
    """
    n = portions(functions, blocks, calls, xrefs)
    f = functions.filter((F.col("size") >= least_size) & ~F.coalesce("is_thunk", F.lit(False)))
    b = blocks.groupBy("source", F.col("function_addr").alias("addr")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("instruction_count").cast("long")).alias("instructions"))
    c = calls.groupBy("source", F.col("caller_addr").alias("addr")).agg(F.count(F.lit(1)).alias("out_calls"), F.count_distinct("callee_addr").alias("distinct_callees"))
    kind = F.col("ref_type")
    x = xrefs.groupBy("source", F.col("function_addr").alias("addr")).agg(F.count_if(kind == "READ").alias("reads"), F.count_if(kind == "WRITE").alias("writes"), F.count_if(kind.isin("CONDITIONAL_JUMP", "UNCONDITIONAL_JUMP")).alias("jumps"))
    f, b, c, x = (d.repartition(n, *KEY) for d in (f, b, c, x))
    out = f.join(b, KEY, "left").join(c, KEY, "left").join(x, KEY, "left")
    return out.select(*functions.columns, *(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k) for k in STRICT[1:]))


def clusters(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signatures over *columns* found in more than one source: their sources, members and size."""
    g = features.groupBy(*columns).agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("members"))
    return g.filter("sources > 1")


def discrimination(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By source: functions and distinct signatures."""
    return features.groupBy("source").agg(F.count(F.lit(1)).alias("functions"), F.count_distinct(F.struct(*columns)).alias("signatures"))


def collisions(features: DataFrame, columns: Sequence[str], names: int = 5) -> DataFrame:
    """Signatures that several functions of a source share, with some of their names in order."""
    g = features.groupBy("source", *columns).agg(F.count(F.lit(1)).alias("functions"), F.array_sort(F.collect_set("name")).alias("all"))
    return g.filter("functions > 1").withColumn("names", F.slice("all", 1, names)).drop("all")


def confirmed(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signatures in more than one source with their real names: confirmed if they have one, a collision if they have several.

    Extractors' own names (FUN_) are none; a cluster without a real name is unnamed.
    """
    real = F.when(~auto_named(F.col("name")), F.col("name"))
    g = features.groupBy(*columns).agg(F.count_distinct("source").alias("sources"), F.count_distinct(real).alias("names"), F.min(real).alias("name"))
    verdict = F.when(F.col("names") == 1, "confirmed").when(F.col("names") > 1, "collision").otherwise("unnamed")
    return g.filter("sources > 1").withColumn("verdict", verdict)


def name_precision(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: (name, signature) pairs in more than one source, signatures in more than one source with several real names,
    and the share of the former in percent."""
    named = features.filter(~auto_named(F.col("name"))).groupBy("name", *columns).agg(F.count_distinct("source").alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("confirmed"))
    several = confirmed(features, columns).agg(F.count_if(F.col("names") > 1).alias("collisions"))
    both = named.crossJoin(several)  # one row each
    return both.withColumn("unambiguous_pct", F.round(100.0 * F.try_divide(F.col("confirmed").cast("double"), (F.col("confirmed") + F.col("collisions")).cast("double")), 1))


def disambiguated(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Colliding signatures (in more than one source, with several real names) with the distinct body hashes of their functions.

    *features* has body_hash; functions without one don't count, and a cluster of such functions only is left out.
    """
    real = F.when(~auto_named(F.col("name")), F.col("name"))
    g = features.groupBy(*columns).agg(F.count_distinct("source").alias("sources"), F.count_distinct(real).alias("names"), F.count_distinct("body_hash").alias("hashes"))
    return g.filter("sources > 1 and names > 1 and hashes > 0").select(*columns, "names", "hashes")


def hash_confirmed(features: DataFrame, columns: Sequence[str] = ("size", "blocks", "instructions")) -> DataFrame:
    """Real names whose functions in more than one source agree on body hash and *columns*, with those sources in order."""
    g = features.filter(~auto_named(F.col("name")) & F.col("body_hash").isNotNull()).groupBy("name", "body_hash", *columns).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return g.filter(F.size("sources") > 1)


def shape_vector() -> Column:
    """The seven counts over the size: what structural cosine compares."""
    return F.array(*(F.try_divide(F.col(c).cast("double"), F.col("size").cast("double")) for c in STRICT[1:]))


def frequency_vector(histogram: Column, vocabulary: Sequence[str]) -> Column:
    """Counts of *vocabulary* in a JSON histogram, as doubles; what it lacks counts 0. Cosine doesn't depend on their scale."""
    counts = F.from_json(histogram, "map<string, double>")
    return F.transform(F.array(*(F.lit(v) for v in vocabulary)), lambda v: F.coalesce(F.try_element_at(counts, v), F.lit(0.0)))


def constant_sets(xrefs: DataFrame, functions: DataFrame, kind: str = "full", least_size: int = 16) -> DataFrame:
    """source, addr, name, members: addresses that each function refers to as data, in order.

    *kind*: "full", three or more; "peripheral", two or more in the peripheral and system regions; "relative", offsets from the
    function's start, three or more addresses. Thunks and functions smaller than *least_size* have none.
    """
    from .recovery import region

    f = functions.filter((F.col("size") >= least_size) & ~F.coalesce("is_thunk", F.lit(False))).select(*KEY, "name")
    x = xrefs.filter(F.col("ref_type").isin("DATA", "READ", "WRITE", "PARAM") & F.col("to_addr").isNotNull()).select("source", F.col("function_addr").alias("addr"), "to_addr")
    if kind == "peripheral":
        x = x.filter(region(F.col("to_addr")).isin("peripheral", "system"))
    value = F.col("to_addr") - F.col("addr") if kind == "relative" else F.col("to_addr")
    own = x.groupBy(*KEY).agg(F.array_sort(F.collect_set(value)).alias("members")).filter(F.size("members") >= (2 if kind == "peripheral" else 3))
    return f.join(own, KEY)


def twins(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of functions of two sources (a < b) that agree on *columns*.

    The columns' hash is the shuffle key, which keeps it 8 bytes wide; equality of all columns is checked after it. A signature's
    twins grow with the square of its functions, so they are made by tiles.
    """
    whole = features.filter(" and ".join(f"`{c}` is not null" for c in columns)).withColumn("k", F.xxhash64(*columns))
    side = lambda s: whole.select("k", *(F.col(c).alias(f"{s}_{c}") for c in dict.fromkeys([*KEY, "name", *columns])))
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    return tiled(side("a"), side("b"), ["k"], ["a_source", "a_addr"], ["b_source", "b_addr"]).filter(same & (F.col("a_source") < F.col("b_source"))).drop("k")


def sets(rows: DataFrame, value: str, into: str, least: int = 1) -> DataFrame:
    """(source, addr) with the ordered set of *value*; nulls are no members, sets smaller than *least* are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*KEY).agg(F.array_sort(F.collect_set(value)).alias(into)).filter(F.size(into) >= least)


def equal_sets(members: DataFrame, column: str) -> DataFrame:
    """Pairs of two sources with equal sets: the set's hash is the join key, the arrays are compared after it."""
    side = members.select(*KEY, F.col(column), F.xxhash64(column).alias("k"))
    a, b = side.alias("a"), side.alias("b")
    hit = a.join(b, F.col("a.k") == F.col("b.k")).filter((F.col("a.source") < F.col("b.source")) & (F.col(f"a.{column}") == F.col(f"b.{column}")))
    return hit.select(F.col("a.source").alias("a_source"), F.col("a.addr").alias("a_addr"), F.col("b.source").alias("b_source"), F.col("b.addr").alias("b_addr"), F.size(f"a.{column}").cast("long").alias("n"))


def twin_precision(features: DataFrame, columns: Sequence[str], members: DataFrame | None = None, column: str = "members") -> DataFrame:
    """One row: twins on *columns* (and on equal sets of *members*, if given), those of one name, and their share in percent.

    Twins are counted and not made: pairs of two sources are those of all functions of a signature less those within each
    source, and pairs of one name likewise within the name. Null columns make no twins.
    """
    if members is not None:
        features = features.join(members.select(*KEY, F.col(column).alias("__set")), KEY)
        columns = [*columns, "__set"]
    whole = features.filter(" and ".join(f"`{c}` is not null" for c in columns)).groupBy(*columns, "source", "name").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda all_, own: (F.sum(all_) * F.sum(all_) - F.sum(own * own)) / 2
    # by name first: one row a (signature, source), and one a (signature, name)
    by_source = whole.groupBy(*columns, "source").agg(F.sum("n").alias("n")).groupBy(*columns).agg(pairs(F.col("n"), F.col("n")).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).cast("long").alias("pairs"))
    by_name = whole.filter("name is not null").groupBy(*columns, "name").agg(pairs(F.col("n"), F.col("n")).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0.0)).cast("long").alias("same_name"))
    g = by_source.crossJoin(by_name)  # one row each
    return g.withColumn("precision_pct", 100.0 * F.try_divide(F.col("same_name").cast("double"), F.col("pairs").cast("double")))
