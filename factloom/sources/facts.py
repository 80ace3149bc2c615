"""Readers and writers of facts: JSONL, symbol tables, traces, register maps, raw words, TSV."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from ..operators.ranges import carried, ranks
from ..operators.tables import fixed, sized
from ..schemas import DEFAULTS, REQUIRED, TABLES


def read_jsonl(spark: SparkSession, path: str, table: str, source: str) -> DataFrame:
    """Records of one table in its schema. Blank lines are skipped, malformed JSON and missing required integers fail the job.

    A histogram object becomes a JSON string with sorted keys; missing text columns take the table's defaults.
    """
    schema = TABLES[table]
    kinds = (LongType, IntegerType, DoubleType, BooleanType)
    fields = [f for f in schema if f.name not in ("source", "extracted_at")]
    given = StructType()
    for f in fields:
        given.add(f.name, MapType(StringType(), IntegerType()) if f.name == "pcode_histogram" else f.dataType if isinstance(f.dataType, (*kinds, StringType)) else StringType())
    raw = spark.read.schema(given).option("mode", "FAILFAST").json(path)
    out = [F.lit(source).alias("source")]
    for f in fields:
        c = F.col(f.name)
        if f.name == "pcode_histogram":
            c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        if f.name in REQUIRED.get(table, ()):
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{table}: {f.name} is missing")).cast(f.dataType))
        default = DEFAULTS.get(table, {}).get(f.name)
        out.append((F.coalesce(c, F.lit(default)) if default is not None else c).cast(f.dataType).alias(f.name))
    if "extracted_at" in schema.names:
        out.append(F.current_timestamp().alias("extracted_at"))
    return raw.select(*out)


def read_symbols(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Code symbols (type T global, t local) of lines `addr [size] type name`; other lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(p.alias("p"), F.size(p).alias("n")).filter("n in (3, 4)")
    kind, long = F.get("p", F.col("n") - 2), F.col("n") == 4
    hexed = lambda c: F.conv(c, 16, 10).cast("long")
    ok = lines.filter(kind.isin("T", "t"))
    return ok.select(F.lit(source).alias("source"), hexed(F.get("p", F.lit(0))).alias("addr"), F.when(long, hexed(F.get("p", F.lit(1)))).alias("size"), F.get("p", F.col("n") - 1).alias("name"), F.when(kind == "T", "global").otherwise("local").alias("bind"))


def trace_lines(lines: DataFrame) -> DataFrame:
    """Adds pc, direction, address and value to lines (column value): instruction and register-access lines, others dropped."""
    insn = F.regexp_extract("value", r"^\s*0x([0-9A-Fa-f]+):\s*0x[0-9A-Fa-f]+", 1)
    io = lambda g: F.regexp_extract("value", r"MemoryIO(Read|Write) with address 0x([0-9A-Fa-f]+), value 0x([0-9A-Fa-f]+)", g)
    number = lambda c: F.when(c != "", F.conv(c, 16, 10).cast("long"))
    out = lines.withColumn("pc", number(insn)).withColumn("direction", F.when(io(1) != "", F.lower(io(1)))).withColumn("address", number(io(2))).withColumn("io_value", number(io(3)))
    return out.filter("pc is not null or direction is not null")


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """*into*: the last non-null *value* up to each row, by *keys* in *order*; no task holds a whole key."""
    return carried(rows.withColumn(into, F.col(value)), keys, order, [into])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of text files in order of file and place; *line* grows but may leave gaps.

    A file is read in splits. Splits are numbered in order of file and start, which is the order of a scan with one file a
    partition group; the place within a split follows the reading.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    d = fixed(lines)
    # ids grow along a split; splits of a file are put in order by their start
    ends = d.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a split
    return d.join(sized(ends.withColumn("before", before)), ["file", "start"]).select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def read_trace(spark: SparkSession, path: str, source: str, scenario: str) -> DataFrame:
    """Register accesses of one trace with the program counter before each, numbered in order of its lines. Files are split."""
    t = trace_lines(numbered_lines(spark, path)).withColumn("scenario", F.lit(scenario))
    t = fixed(carry_forward(t, ["scenario"], ["line"], "pc", "last_pc").filter("direction is not null"))
    ranked = ranks(t, ["line"])
    return ranked.select(F.lit(source).alias("source"), "scenario", F.col("rank").alias("sequence_idx"), F.col("last_pc").alias("pc"), "address", F.col("io_value").alias("value"), "direction")


def read_register_map(spark: SparkSession, path: str) -> DataFrame:
    """Peripherals of an SVD file: name, base, size (0x1000 if it states none), registers array<struct<name, offset>>.

    A peripheral derived from another has that one's block and registers where it has none of its own.
    """
    schema = "name string, _derivedFrom string, baseAddress string, addressBlock struct<size: string>, registers struct<register: array<struct<name: string, addressOffset: string>>>"
    number = lambda c: F.when(F.lower(c).startswith("0x"), F.conv(F.substring(c, 3, 20), 16, 10).cast("long")).otherwise(c.cast("long"))
    p = spark.read.format("xml").option("rowTag", "peripheral").schema(schema).load(path)
    p = p.select("name", F.col("_derivedFrom").alias("parent"), number(F.col("baseAddress")).alias("base"), number(F.col("addressBlock.size")).alias("size"), F.transform("registers.register", lambda r: F.struct(r["name"].alias("name"), number(r["addressOffset"]).alias("offset"))).alias("registers"))
    up = p.select(F.col("name").alias("parent"), F.col("size").alias("up_size"), F.col("registers").alias("up_registers"))
    return p.join(up, "parent", "left").select("name", "base", F.coalesce("size", "up_size", F.lit(0x1000)).alias("size"), F.coalesce("registers", "up_registers").alias("registers"))


def read_words(spark: SparkSession, path: str, base: int) -> DataFrame:
    """Little-endian 32-bit words of raw images at addresses from *base*: path, addr, word. A rest of under four bytes is dropped."""
    import numpy as np

    def unpack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                w = np.frombuffer(content[: len(content) // 4 * 4], "<u4").astype("int64")
                for a in range(0, len(w), 1 << 18):
                    part = w[a : a + (1 << 18)]
                    yield pd.DataFrame({"path": name, "addr": base + 4 * (a + np.arange(len(part))), "word": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, addr long, word long")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """One table of SQLite files, read-only, through Spark's file systems: *schema* names its columns. A file is read by one task."""
    import sqlite3

    names = [f.name for f in StructType.fromDDL(schema).fields]
    ask = "SELECT " + ", ".join(f'"{n}"' for n in names) + f' FROM "{table}"'

    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                cursor = db.execute(ask)
                while part := cursor.fetchmany(10_000):
                    yield pd.DataFrame(part, columns=names, dtype=object)
                db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def write_relations(relations: dict[str, DataFrame], path: str) -> None:
    """Each relation as headerless tab-separated files in a folder of its name."""
    for name, df in relations.items():
        write_tsv(df, f"{path}/{name}")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless tab-separated facts."""
    return spark.read.schema(schema).option("sep", "\t").option("header", "false").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def write_json_report(matches: DataFrame, path: str) -> None:
    """One JSON object a match under *path*/matches, and one with the counts of all and by tier under *path*/summary. *matches*: tier and what else there is."""
    matches.write.mode("overwrite").json(f"{path}/matches")
    tiers = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tiers")
    matches.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).filter("tier is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), tiers).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
