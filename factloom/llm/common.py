"""Shared helpers: scratch tables in the shared checkpoint folder, batching by text volume, words, session settings."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word of the contracts: a run of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters handled at once by the numpy code; bounds a Python worker's memory except for one longer text.
CHUNK_CHARS = 1 << 18
#: Bytes of a batch of rows for Python.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where that is unset, a local master gets a temporary one; a cluster is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "factloom-shared")
        spark.conf.set("spark.checkpoint.dir", f"file://{at}")
        at = f"file://{at}"
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write *df* as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, fixes partitions.

    From then on the session's batches for Python are BATCH_BYTES at most, unless its setting is not the default: rows may hold
    whole texts or sets, and the JVM and the worker of each task hold several batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _made[path] = spark
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that stored() returned and that nothing reads any more; other frames are left alone.

    What a result still reads stays until the session ends, or until release().
    """
    for df in frames:
        _delete(getattr(df, "_stored_at", ""))


def release() -> None:
    """Delete all tables that stored() has written so far: for long sessions, once results are written elsewhere."""
    for path in list(_made):
        _delete(path)


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


atexit.register(_clean)


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small DataFrame of integer columns from the driver's rows, by Arrow.

    Lists given to createDataFrame pass through Python workers of another kind than those of mapInArrow, which stay beside them in each executor.
    """
    t = StructType.fromDDL(schema)
    cols = list(zip(*rows, strict=True)) or [()] * len(t.fields)
    return spark.createDataFrame(pa.table({f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(t.fields, cols, strict=True)}), t)


def batches(it: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most *limit* bytes of text each (one row at least)."""
    for b in it:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        n = pc.fill_null(pc.binary_length(col), 0).to_numpy()
        start, total = 0, 0
        for i, x in enumerate(n):
            if total and total + x > limit:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += x
        yield b.slice(start)


def joined(it: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Put record batches together to at most *limit* bytes of text each (one batch at least)."""
    held, total = [], 0
    for b in it:
        n = pc.sum(pc.binary_length(b.column(b.schema.get_field_index(text)))).as_py() or 0
        if held and total + n > limit:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield pa.concat_batches(held)


def texts_of(b: pa.RecordBatch, text: str = "text") -> list[str]:
    """The batch's texts, nulls as empty."""
    return [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each followed by a newline, and the start of each text (and the end)."""
    buf = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return buf, np.concatenate([[0], ends])


def word_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of WORD in an array of code points that ends with white space."""
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    return edge[::2], edge[1::2]


#: The type of a row's place in its input.
ROW = "struct<file: long, row: long>"


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that is none of *taken*, nor the start of one."""
    low = [c.lower() for c in taken]
    return next(n for i in range(len(low) + 1) if not any(c.startswith(n := f"{stem}_{i}") for c in low))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """*docs* with a column of ROW that is another one for each row, and that column's name, which *docs* has not.

    The place is that in the Parquet files that *docs* reads, so that it costs no pass and is the same whenever a task is run again. Other
    DataFrames, and those with more than projections and filters above the files, are stored first.
    """
    name = free_name(docs.columns, "at")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("row")).alias(name)
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    try:
        return (docs if plan.nodeName() == "LogicalRelation" else stored(docs, "rows")).select("*", place), name
    except AnalysisException:  # files of another kind
        return stored(docs, "rows").select("*", place), name


def n_words(col) -> "F.Column":
    """Number of WORD runs, JVM-side; null texts count none."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def picked_texts(docs: DataFrame, pick: DataFrame, volume: int) -> list[tuple[str, int]]:
    """(text, y) of the documents in *pick* (doc_id, y; few), whole texts only, of *volume* bytes together at most.

    In an order by hash of doc_id each text that still fits is taken, so the driver's memory has a bound and no length is
    one by itself. Of rows that repeat an id the shortest text counts. Null texts are left out.
    """
    own = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(pick), "doc_id")
    own = stored(own.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.length("text"), "text")).alias("text")), "labelled")
    ids, used = [], 0
    for r in own.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if used + r["size"] <= volume:
            ids.append((r["doc_id"],))
            used += r["size"]
    few = own.join(F.broadcast(from_rows(docs.sparkSession, ids, "doc_id long")), "doc_id").select("doc_id", "text", "y")
    return [(r["text"], r["y"]) for r in sorted(few.collect(), key=lambda r: r["doc_id"])]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
