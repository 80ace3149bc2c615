"""The warehouse: fact tables in a directory tree, seen as logical views, and scripts of SQL over them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.names import auto_named
from .schemas import TABLES


class Warehouse:
    """`root/<target>/tables/<table>.parquet`, read through Spark's file systems, or one `root/<table>` partitioned by source.

    Each table name is a view over all targets, united by column name; a column that a target lacks is null there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _glob(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return [s.getPath() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []]

    def tables(self) -> dict[str, list[str]]:
        """Table names and their paths: files of targets, and folders that save() wrote."""
        out: dict[str, set[str]] = {}
        for p in self._glob("*/tables/*.parquet"):
            out.setdefault(p.getName().removesuffix(".parquet"), set()).add(p.toString())
        for p in self._glob("*/source=*"):
            out.setdefault(p.getParent().getName(), set()).add(p.getParent().toString())
        return {k: sorted(v) for k, v in sorted(out.items())}

    def table(self, name: str, source: str | None = None) -> DataFrame:
        """All rows of a table, or one target's. A name that no target has is a KeyError."""
        df = None
        for kind in (True, False):
            paths = [p for p in self.tables()[name] if p.endswith(f"/tables/{name}.parquet") == kind]
            if not paths:
                continue
            part = self.spark.read.option("mergeSchema", "true").parquet(*paths)
            part = part if kind else part.withColumn("source", F.col("source").cast("string"))
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
        return df if source is None else df.filter(F.col("source") == source)

    def register(self, source: str | None = None, only: Sequence[str] | None = None) -> list[str]:
        """Temp views for all tables (or those in *only* that exist). With *source*, `name` is that target and `name_all` every one."""
        names = []
        for name in self.tables():
            if only is not None and name not in only:
                continue
            every = self.table(name)
            if source is None:
                every.createOrReplaceTempView(name)
            else:
                every.createOrReplaceTempView(f"{name}_all")
                every.filter(F.col("source") == source).createOrReplaceTempView(name)
            names.append(name)
        return names

    def save(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        """Write *df* as zstd Parquet, partitioned by source, so that a filter on source prunes files."""
        df.write.mode(mode).option("compression", "zstd").partitionBy("source").parquet(f"{self.root}/{name}")

    def sql(self, text: str, *values, **args) -> DataFrame:
        """A statement with its parameters bound, either ? in order or :name."""
        return self.spark.sql(text, args=list(values) or args or None)

    def run_script(self, text: str) -> Iterator[Result]:
        """Each statement's frame or error, in order; an error doesn't stop the rest."""
        for statement in split_statements(text):
            try:
                yield Result(statement, self.spark.sql(statement), None)
            except Exception as e:  # noqa: BLE001  any error of a statement is its result
                yield Result(statement, None, e)

    # the tool surface
    def list_targets(self) -> DataFrame:
        """Rows of each fact table by source."""
        tables = self.tables()
        names = [n for n in ("functions", "calls", "basic_blocks", "xrefs", "strings") if n in tables]
        if not names:
            return self.spark.createDataFrame([], "source string")
        counts = [self.table(n).groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.lit(n).alias("t"), "n") for n in names]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out.groupBy("source").pivot("t", names).agg(F.first("n")).na.fill(0).orderBy("source")

    def find_functions(self, pattern: str, limit: int = 50) -> DataFrame:
        return self.table("functions").filter(F.col("name").ilike(f"%{pattern}%")).select("source", "addr", "name", "size").orderBy("source", "addr").limit(limit)

    def function_info(self, source: str, addr: int) -> DataFrame:
        """One row: the function with its callers, callees and the strings that it refers to as nested lists; without such tables, empty ones."""
        f = self.table("functions", source).filter(F.col("addr") == addr)
        have = self.tables()
        none = F.array().cast("array<long>")
        if "calls" in have:
            calls = self.table("calls", source)
            callers = calls.filter(F.col("callee_addr") == addr).agg(F.array_sort(F.collect_set("caller_addr")).alias("callers"))
            callees = calls.filter(F.col("caller_addr") == addr).agg(F.array_sort(F.collect_set("callee_addr")).alias("callees"))
            f = f.crossJoin(callers).crossJoin(callees)  # each side is one row
        else:
            f = f.withColumns({"callers": none, "callees": none})
        if "xrefs" not in have or "strings" not in have:
            return f.withColumn("strings", F.array().cast("array<string>"))
        used = self.table("xrefs", source).filter(F.col("function_addr") == addr).select(F.col("to_addr").alias("addr")).distinct()
        return f.crossJoin(self.table("strings", source).join(used, "addr", "left_semi").agg(F.array_sort(F.collect_set("value")).alias("strings")))

    def topics(self, question: str) -> list[str]:
        """The topics that a question's words call for, in fixed order; the overview if none do."""
        low = question.lower()
        return [t for t, words in TOPICS.items() if any(w in low for w in words)] or ["overview"]

    def analyze(self, source: str, question: str, limit: int = 20) -> dict[str, DataFrame]:
        """For each topic of the question a frame of *limit* rows at most; topics whose tables are missing are left out."""
        have = self.tables()
        t = lambda n: self.table(n, source)
        name = lambda side: t("functions").select(F.col("addr").alias(side), F.col("name").alias(f"{side.removesuffix('_addr')}_name"))
        makers = {
            "calls": (("calls", "functions"), lambda: t("calls").filter("callee_addr is not null").groupBy("callee_addr").agg(F.count_distinct("caller_addr").alias("callers")).join(name("callee_addr"), "callee_addr", "left").orderBy(F.desc("callers"), "callee_addr")),
            "strings": (("strings",), lambda: t("strings").select("addr", "value").orderBy("addr")),
            "peripherals": (("peripheral_xrefs",), lambda: self.peripheral_map(source)),
            "data": (("xrefs",), lambda: t("xrefs").groupBy("to_addr").agg(F.count_if(F.col("ref_type") == "READ").alias("reads"), F.count_if(F.col("ref_type") == "WRITE").alias("writes"), F.count_distinct("function_addr").alias("functions")).orderBy(F.desc("functions"), "to_addr")),
            "size": (("functions",), lambda: t("functions").select("addr", "name", "size").orderBy(F.desc("size"), "addr")),
            "recovered": (("recovered_calls",), lambda: t("recovered_calls").groupBy("mechanism").agg(F.count(F.lit(1)).alias("edges"), F.avg("confidence").alias("confidence")).orderBy("mechanism")),
            "bodies": (("decompiled",), lambda: t("decompiled").select("addr", F.length("decompiled_c").alias("chars")).orderBy(F.desc("chars"), "addr")),
            "overview": (("functions",), lambda: t("functions").agg(F.count(F.lit(1)).alias("functions"), F.count_if(~auto_named(F.col("name"))).alias("named"), F.sum(F.col("size").cast("long")).alias("bytes"))),
        }
        return {k: makers[k][1]().limit(limit) for k in self.topics(question) if all(n in have for n in makers[k][0])}

    def report(self, source: str) -> str:
        """A page of markdown on one target: rows by table, then every topic's frame."""
        parts = [f"# {source}", render(self.list_targets().filter(F.col("source") == source))]
        every = " ".join(w for words in TOPICS.values() for w in words)
        for topic, frame in {**self.analyze(source, ""), **self.analyze(source, every)}.items():
            parts += [f"## {topic}", render(frame)]
        return "\n\n".join(parts) + "\n"

    def peripheral_map(self, source: str) -> DataFrame:
        x = self.table("peripheral_xrefs", source)
        return x.groupBy("peripheral_group", "peripheral").agg(F.count(F.lit(1)).alias("accesses"), F.count_distinct("function_addr").alias("functions"), F.count_distinct("register_name").alias("registers")).orderBy(F.desc("accesses"), "peripheral")


#: Words of a question, by the topic that they call for.
TOPICS = {
    "calls": ("call", "caller", "callee", "graph"),
    "strings": ("string", "text", "message"),
    "peripherals": ("peripheral", "register", "gpio", "uart", "spi", "hardware"),
    "data": ("global", "variable", "data", "state", "memory"),
    "size": ("large", "big", "size"),
    "recovered": ("recover", "indirect", "vector", "pointer"),
    "bodies": ("decompil", "body", "code"),
}


@dataclass
class Result:
    statement: str
    frame: DataFrame | None
    error: Exception | None


def split_statements(text: str) -> list[str]:
    """Split at semicolons outside `--` comments, single and double quotes; empty statements are left out."""
    out, cur, quote, i = [], [], "", 0
    while i < len(text):
        c = text[i]
        if quote:
            cur.append(c)
            if c == quote:
                quote = ""
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            cur.append("\n")
        elif c in "'\"":
            quote = c
            cur.append(c)
        elif c == ";":
            out.append("".join(cur).strip())
            cur = []
        else:
            cur.append(c)
        i += 1
    out.append("".join(cur).strip())
    return [s for s in out if s]


def render(df: DataFrame, limit: int = 200, style: str = "markdown") -> str:
    """At most *limit* rows as a table in "markdown", "html" or "text"; whole numbers above 0xFFFF in hexadecimal, nulls blank."""
    from html import escape

    def show(v) -> str:
        if v is None:
            return ""
        return f"0x{v:08x}" if isinstance(v, int) and not isinstance(v, bool) and v > 0xFFFF else str(v)

    rows = [[show(v) for v in r] for r in df.limit(limit).collect()]
    if style == "html":
        cells = lambda r, tag: "".join(f"<{tag}>{escape(v)}</{tag}>" for v in r)
        return "<table><tr>" + "</tr><tr>".join([cells(df.columns, "th"), *(cells(r, "td") for r in rows)]) + "</tr></table>"
    if style == "text":
        width = [max(map(len, c)) for c in zip(df.columns, *rows, strict=True)]
        return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [df.columns, *rows])
    plain = lambda v: v.replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(plain, r)) + " |" for r in rows)])


__all__ = ["TABLES", "Result", "Warehouse", "render", "split_statements"]
