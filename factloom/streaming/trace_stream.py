"""Traces as streams. The windowed and deduplicating operators are extensions over event tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACCESS = "source string, scenario string, sequence_idx long, pc long, address long, value long, direction string"


def access_stream(lines: DataFrame) -> DataFrame:
    """Register accesses of a stream of parsed trace rows (source, scenario, line, pc, direction, address, io_value).

    State of a (source, scenario): the last program counter and the next number. Rows of a micro-batch are put in line order
    first; a scenario's lines must not arrive in a later batch than lines after them.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pc, idx = state.get if state.exists else (None, 0)
        rows = []
        for r in pd.concat(list(frames)).sort_values("line").itertuples(index=False):
            if pd.notna(r.pc):
                pc = int(r.pc)
            if r.direction is not None:
                rows.append((*key, idx, pc, int(r.address), int(r.io_value), r.direction))
                idx += 1
        state.update((pc, idx))
        out = pd.DataFrame(rows, columns=["source", "scenario", "sequence_idx", "pc", "address", "value", "direction"])
        out["pc"] = out["pc"].astype("Int64")
        yield out

    return lines.groupBy("source", "scenario").applyInPandasWithState(step, ACCESS, "pc long, next long", "append", GroupStateTimeout.NoTimeout)


def read_stream(spark: SparkSession, directory: str, schema, files: int | None = 1) -> DataFrame:
    """New Parquet files of a directory or glob, *files* of them a trigger; None: all that are there."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(directory)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, into the in-memory table *name*; meant for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Append sink with exactly-once files; resumes from *checkpoint*."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows and sum of value by window and keys; rows later than *late* behind the watermark are dropped in a stream. Batch or stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = e.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row a key within the watermark; streaming only."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
