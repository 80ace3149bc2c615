"""The fixture tables in the shape of fact tables. One text serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import portions

# fact table: its definition over the fixture tables
SHAPES = {
    "functions": "SELECT p_brand AS source, p_partkey AS addr, CASE WHEN p_partkey % 7 = 0 THEN 'FUN_0001' ELSE p_name END AS name, CAST(p_size AS BIGINT) AS size, p_partkey % 20 = 0 AS is_thunk, CAST(p_partkey % 6 AS INT) AS num_params, p_type AS signature, p_type AS body_hash FROM part",
    "basic_blocks": "SELECT p_brand AS source, l_partkey AS function_addr, l_orderkey AS block_addr, CAST(l_quantity AS INT) AS instruction_count FROM lineitem JOIN part ON l_partkey = p_partkey",
    "xrefs": "SELECT p_brand AS source, l_partkey AS function_addr, l_orderkey * 10 + l_linenumber AS from_addr, l_suppkey AS to_addr, CASE l_returnflag WHEN 'R' THEN 'READ' WHEN 'A' THEN 'WRITE' ELSE 'DATA' END AS ref_type FROM lineitem JOIN part ON l_partkey = p_partkey",
    "calls": "SELECT p_brand AS source, l_partkey AS caller_addr, l_orderkey AS call_site_addr, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS callee_addr FROM lineitem JOIN part ON l_partkey = p_partkey",
    "edges": "SELECT DISTINCT user_id AS src, nxt AS dst FROM (SELECT user_id, value, LEAD(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events) AS e WHERE value > 150 AND nxt <> user_id",
    "tree": "SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON (b.p_partkey >> 1) = a.p_partkey WHERE a.p_size >= b.p_size - 25",
    # few facts a function, so that whole signatures and sets recur across sources
    "routines": "SELECT o_orderpriority AS source, o_orderkey AS addr, CASE WHEN o_orderkey % 7 = 0 THEN concat('FUN_', o_orderkey) ELSE concat('fn_', o_orderkey % 50, '_', o_custkey % 3) END AS name, CAST(8 + o_orderkey % 50 AS BIGINT) AS size, o_orderkey % 41 = 0 AS is_thunk, CAST(o_custkey % 6 AS INT) AS num_params, CASE WHEN o_custkey % 11 <> 0 THEN concat('h', o_orderkey % 50, '_', o_custkey % 6) END AS body_hash FROM orders",
    "routine_blocks": "SELECT o_orderpriority AS source, l_orderkey AS function_addr, l_linenumber AS block_addr, CAST(l_linenumber % 3 + 1 AS INT) AS instruction_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "routine_calls": "SELECT o_orderpriority AS source, l_orderkey AS caller_addr, CAST(l_linenumber AS BIGINT) AS call_site_addr, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey % 5 END AS callee_addr FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "routine_refs": "SELECT o_orderpriority AS source, l_orderkey AS function_addr, CAST(l_linenumber AS BIGINT) AS from_addr, CASE l_orderkey % 4 WHEN 0 THEN 1073741824 + (l_partkey % 60) * 4 WHEN 1 THEN 536870912 + l_partkey % 400 WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 3758096384 + (l_partkey % 40) * 4 ELSE 805306368 + l_partkey % 40 END ELSE l_orderkey + l_partkey % 15 END AS to_addr, CASE WHEN l_linenumber = 4 THEN 'CONDITIONAL_JUMP' WHEN l_linenumber = 6 THEN 'COMPUTED_JUMP' WHEN l_returnflag = 'R' THEN 'READ' WHEN l_returnflag = 'A' THEN 'WRITE' ELSE 'DATA' END AS ref_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "slots": "SELECT o_orderpriority AS source, CAST(o_orderkey % 300 AS INT) AS slot, o_orderkey * 2 + o_custkey % 2 AS word FROM orders",
    "words": "SELECT o_orderpriority AS source, l_orderkey + l_linenumber AS addr, l_partkey * 7 + l_linenumber % 2 AS word FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "histograms": "SELECT p_brand AS source, p_partkey AS addr, count(l_partkey) AS pcode_ops_total, concat(chr(123), '\"COPY\": ', count(CASE WHEN l_linenumber = 1 THEN 1 END), ', \"LOAD\": ', count(CASE WHEN l_linenumber = 2 THEN 1 END), ', \"STORE\": ', count(CASE WHEN l_linenumber = 3 THEN 1 END), ', \"CALL\": ', count(CASE WHEN l_linenumber = 4 THEN 1 END), ', \"OTHER\": ', count(CASE WHEN l_linenumber > 4 THEN 1 END), chr(125)) AS pcode_histogram FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand, p_partkey",
    "bodies": "SELECT event_id AS id, concat('a = 0x', CASE event_id % 4 WHEN 0 THEN '40000000' WHEN 1 THEN '40000004' WHEN 2 THEN '12345abc' ELSE 'ABC04321' END, ';', chr(10), 'b = DAT_4000000', event_id % 8, ' + ', event_id % 2000, ' - 0x', event_id % 10, '00;') AS body FROM events",
    "trials": "SELECT event_id, CAST(event_id % 8 AS INT) AS instructions_executed, event_id % 3 = 0 AS has_prologue, CASE event_id % 5 WHEN 0 THEN 'UC_ERR_INSN_INVALID' WHEN 1 THEN 'UC_ERR_FETCH_UNMAPPED' WHEN 2 THEN 'UC_ERR_READ_UNMAPPED' END AS error FROM events",
    "claims": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified, (event_id % 100) / 100.0D AS confidence, CASE WHEN event_id % 4 = 0 THEN event_id - 1 END AS supersedes FROM events",
    "accesses": "SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events",
    "evidence": "SELECT conv_id AS addr, turn AS id, (length(text) % 100) / 100.0D AS confidence, role AS method FROM conversations",
    "versions": "SELECT year(o_orderdate) AS version, o_custkey AS addr, min(o_orderpriority) AS hash FROM orders GROUP BY year(o_orderdate), o_custkey",
}
ORACLE = {k: v.replace("100.0D", "100.0::DOUBLE").replace("year(o_orderdate)", "CAST(year(o_orderdate) AS INT)") for k, v in SHAPES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact table of SHAPES."""
    text = SHAPES[name]
    # the fixture tables stand in for their names, without views in the session
    frames = {t: table(spark, sf_dir, t) for t in ("part", "lineitem", "events", "conversations", "orders") if f" {t}" in text}
    if "lineitem JOIN orders ON l_orderkey = o_orderkey" in text:  # two large tables: partitions by their size, which the functions' facts keep
        n = portions(frames["lineitem"])
        frames = {t: f.repartition(n, {"lineitem": "l_orderkey", "orders": "o_orderkey"}[t]) for t, f in frames.items()}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **frames)


def with_shapes(sql: str, *names: str) -> str:
    """Oracle text with the definitions of *names* in front."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({ORACLE[n]})" for n in names) + ("" if sql.lstrip().startswith(",") else " ") + sql
