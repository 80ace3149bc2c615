"""Intermediate tables of iterative operators, and sizes that broadcasts depend on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input files whose rows make one of `portions`.
SPREAD = 8_000_000
#: Rows of one side in a tile, about, and pairs that one task makes, about.
TILE, PAIRS = 2048, 4_000_000
#: Tables up to this many rows are broadcast: dimension tables of a few narrow columns.
FEW = 50_000


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    Where spark.checkpoint.dir is unset, a local master gets a temporary folder; a cluster, whose machines don't share one, is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "factloom-shared"))
    return sc._jsc.sc().getCheckpointDir().get()


def fixed(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: cuts the lineage that a loop would pile up, and survives lost executors."""
    shared(df.sparkSession)
    return df.checkpoint()


def portions(*frames: DataFrame) -> int:
    """Partitions that the files which the largest of *frames* reads ask for, so that a task's part of a table doesn't grow with it.

    The session's number of partitions at least; what isn't read from files has no size here.
    """

    def size(df: DataFrame) -> int:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        return sum(s for s in sizes if s < 1 << 60)

    least = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(20_000, -(-max(map(size, frames)) // SPREAD)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """*df* by *keys* in its `portions`."""
    return df.repartition(portions(df), *keys)


def sized(df: DataFrame) -> DataFrame:
    """*df*, to be broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def tiled(a: DataFrame, b: DataFrame, keys: Sequence[str], by_a: Sequence[str], by_b: Sequence[str], tile: int = TILE, pairs: int = PAIRS) -> DataFrame:
    """Inner join on *keys* of two tables that make far more pairs than they have rows, by few keys or hot ones.

    Each key's rows are cut by the hash of *by_a* and *by_b* (what tells its rows apart) into chunks of about *tile* rows; each
    chunk of one side meets each of the other in a tile of its own, so a key is dealt out to many tasks. The number of tasks
    follows the counted pairs and not the bytes that go in. What is shuffled is each row once for each *tile* partners. The inputs
    are stored first: they are read for the counts and for the join.
    """
    a, b = fixed(a), fixed(b)
    n = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("__na")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nb")), list(keys))
    n = fixed(n)
    work = n.agg(F.sum(F.col("__na").cast("double") * F.col("__nb"))).first()[0] or 0.0
    tasks = max(1, min(50_000, -int(-work // pairs)))
    n = sized(n.select(*keys, *(F.ceil(F.col(f"__n{s}") / tile).cast("int").alias(f"__{s}") for s in "ab")))

    def dealt(rows: DataFrame, own: str, other: str, by: Sequence[str]) -> DataFrame:
        chunk = F.pmod(F.xxhash64(*by), F.col(f"__{own}")).cast("int")
        r = rows.join(n, list(keys)).withColumn(f"__t{own}", chunk).withColumn(f"__t{other}", F.explode(F.sequence(F.lit(0), F.col(f"__{other}") - 1)))
        return r.drop("__a", "__b").repartition(tasks, *keys, "__ta", "__tb")

    return dealt(a, "a", "b", by_a).join(dealt(b, "b", "a", by_b).hint("shuffle_hash"), [*keys, "__ta", "__tb"]).drop("__ta", "__tb")
