"""Line dedup by content-defined chunks of lines. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _chunked(docs: DataFrame, every: int, window: int) -> DataFrame:
    """doc_id, lines, cuts: the index of the last line of each chunk.

    A rolling hash over the last *window* line hashes cuts after a line where it is 0 modulo *every*. It depends on those lines
    alone, so a block that moves within or between texts gets the same inner cuts.
    """
    d = docs.select("doc_id", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1).alias("lines"))
    d = d.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))

    def rolled(i):
        return F.xxhash64(*(F.get("hashes", i - j) for j in range(window)))

    ends = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (F.pmod(rolled(i), F.lit(every)) == 0) | (i == F.size("lines") - 1))
    return d.withColumn("cuts", ends).drop("hashes")


def _chunks(d: DataFrame) -> DataFrame:
    """Adds *chunks*: struct<k, size, body> for each chunk in order."""
    first = lambda k: F.when(k == 0, 0).otherwise(F.get("cuts", k - 1) + 1)

    def chunk(k):
        size = F.get("cuts", k) - first(k) + 1
        return F.struct(k.alias("k"), size.alias("size"), F.array_join(F.slice("lines", first(k) + 1, size), "\n").alias("body"))

    return d.withColumn("chunks", F.transform(F.sequence(F.lit(0), F.size("cuts") - 1), chunk))


def line_dedup(docs: DataFrame, every: int = 3, window: int = 2, least_lines: int = 2) -> DataFrame:
    """One row per row of *docs* (doc_id, text): doc_id, text without repeated chunks, n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    Of all chunks with the same bytes and *least_lines* lines or more, the first by (doc_id, place) stays, the others go.
    Chunks of one hash are brought together and then compared by their bytes: grouping is by the hash and the text itself. A
    chunk that is in a third of all documents is one row a task before it is grouped, and joins from a side that Spark can split.
    Only the bytes of chunks whose hash recurs are moved for that; texts move by doc_id, twice.

    Null text: empty, one empty line. Null doc_id: after all others; rows of null ids lose only what a row with an id has. A repeated
    doc_id loses the chunks that any of its rows must lose at that place if their bytes agree. Empty input: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunked = _chunks(_chunked(docs, every, window))
    # hashes first, without the bytes; the outer form, as for explode() Spark would add a filter that works the array out anew
    hashed = chunked.select("doc_id", F.explode_outer("chunks").alias("c")).filter(F.col("c.size") >= least_lines).select("doc_id", F.col("c.k").alias("k"), F.xxhash64("c.body").alias("key"))
    hashed = stored(hashed, "line-hashes")
    repeated = hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    asked = hashed.join(repeated.hint("merge"), "key").groupBy("doc_id").agg(F.collect_set("k").alias("ks"))
    # then the bytes of chunks whose hash recurs
    some = chunked.alias("d").join(asked.alias("a"), F.expr("d.doc_id <=> a.doc_id")).select("d.doc_id", F.explode_outer(F.transform("ks", lambda k: F.get("chunks", k))).alias("c")).filter(F.col("c.size") >= least_lines)
    bodies = stored(some.select("doc_id", F.col("c.k").alias("k"), F.xxhash64("c.body").alias("key"), F.col("c.body").alias("body")), "line-bodies")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("k")).alias("k"))
    owner = bodies.groupBy("key", "body").agg(F.min(place).alias("owner"))
    lost = bodies.join(owner.hint("merge"), ["key", "body"]).filter(place != F.col("owner")).select("doc_id", "k", "key").groupBy("doc_id").agg(F.collect_set(F.struct("k", "key")).alias("lost"))
    whole = chunked.alias("d").join(lost.alias("l"), F.expr("d.doc_id <=> l.doc_id"), "left")
    ids = F.transform("chunks", lambda c: F.struct(c["k"].alias("k"), F.xxhash64(c["body"]).alias("key")))
    whole = whole.withColumn("ids", ids).withColumn("stay", F.when(F.col("lost").isNull(), F.col("ids")).otherwise(F.array_except("ids", "lost")))
    text = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("stay", lambda s: F.get("chunks", s["k"])["body"]), "\n"))
    kept_lines = F.aggregate("stay", F.lit(0), lambda a, s: a + F.get("chunks", s["k"])["size"])
    return whole.select(
        "d.doc_id",
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("chunks").cast("long").alias("n_chunks"),
        (F.size("chunks") - F.size("stay")).cast("long").alias("n_removed_chunks"),
        (F.size("lines") - kept_lines).cast("long").alias("n_removed_lines"),
    )
