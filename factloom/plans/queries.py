"""Queries over the fixture tables, each with its oracle: one for every family of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import graph, identity, ranges, recovery, similarity, text
from ..operators.tables import fixed, spread
from .registry import query
from .views import shape, table, with_shapes

STRICT = "size, blocks, instructions, out_calls, distinct_callees, reads, writes, jumps"


def feature_sql(functions: str, blocks: str, calls: str, refs: str) -> str:
    return f"""
, b AS (SELECT source, function_addr AS addr, count(*) AS blocks, sum(instruction_count)::BIGINT AS instructions FROM {blocks} GROUP BY ALL),
c AS (SELECT source, caller_addr AS addr, count(*) AS out_calls, count(DISTINCT callee_addr) AS distinct_callees FROM {calls} GROUP BY ALL),
x AS (SELECT source, function_addr AS addr, sum(CASE WHEN ref_type = 'READ' THEN 1 ELSE 0 END) AS reads, sum(CASE WHEN ref_type = 'WRITE' THEN 1 ELSE 0 END) AS writes, sum(CASE WHEN ref_type IN ('CONDITIONAL_JUMP', 'UNCONDITIONAL_JUMP') THEN 1 ELSE 0 END) AS jumps FROM {refs} GROUP BY ALL),
feat AS (SELECT f.*, coalesce(blocks, 0)::BIGINT AS blocks, coalesce(instructions, 0)::BIGINT AS instructions, coalesce(out_calls, 0)::BIGINT AS out_calls, coalesce(distinct_callees, 0)::BIGINT AS distinct_callees,
         coalesce(reads, 0)::BIGINT AS reads, coalesce(writes, 0)::BIGINT AS writes, coalesce(jumps, 0)::BIGINT AS jumps
         FROM {functions} f LEFT JOIN b USING (source, addr) LEFT JOIN c USING (source, addr) LEFT JOIN x USING (source, addr) WHERE size >= 8 AND NOT is_thunk) """


FACTS = ("functions", "basic_blocks", "calls", "xrefs")
ROUTINES = ("routines", "routine_blocks", "routine_calls", "routine_refs")


def feat(sql: str) -> str:
    return with_shapes(feature_sql(*FACTS) + sql, *FACTS)


def rfeat(sql: str) -> str:
    return with_shapes(feature_sql(*ROUTINES) + sql, *ROUTINES)


def features(spark, d, facts=FACTS):
    return ft.structural_signature(*(shape(spark, d, f) for f in facts))


def routines(spark, d):
    return features(spark, d, ROUTINES)


@query("structural_signature", feat(f"SELECT source, addr, name, {STRICT} FROM feat"))
def structural_signature(spark, d):
    return features(spark, d).select("source", "addr", "name", *ft.STRICT)


@query("routine_signature", rfeat(f"SELECT source, addr, name, {STRICT} FROM feat"))
def routine_signature(spark, d):
    return routines(spark, d).select("source", "addr", "name", *ft.STRICT)


def cluster_sql(columns: str) -> str:
    return rfeat(f"SELECT {columns}, count(DISTINCT source) AS sources, count(*) AS members FROM feat GROUP BY {columns} HAVING count(DISTINCT source) > 1")


@query("signature_clusters", cluster_sql(STRICT))
def signature_clusters(spark, d):
    return ft.clusters(routines(spark, d), ft.STRICT)


@query("relaxed_clusters", cluster_sql("size, blocks, instructions, out_calls, distinct_callees"))
def relaxed_clusters(spark, d):
    return ft.clusters(routines(spark, d), ft.RELAXED)


@query("skeleton_clusters", cluster_sql("size, blocks, instructions"))
def skeleton_clusters(spark, d):
    return ft.clusters(routines(spark, d), ft.SKELETON)


REAL = "CASE WHEN NOT starts_with(name, 'FUN_') THEN name END"


@query("name_confirmed", rfeat(f"SELECT {STRICT}, count(DISTINCT source) AS sources, count(DISTINCT {REAL}) AS names, min({REAL}) AS name, CASE WHEN count(DISTINCT {REAL}) = 1 THEN 'confirmed' WHEN count(DISTINCT {REAL}) > 1 THEN 'collision' ELSE 'unnamed' END AS verdict FROM feat GROUP BY {STRICT} HAVING count(DISTINCT source) > 1"))
def name_confirmed(spark, d):
    return ft.confirmed(routines(spark, d), ft.STRICT)


# the named pairs and the colliding clusters are two statements of their own, as the measure defines them
NAMED = f""", name_matches AS (SELECT name, {STRICT}, count(DISTINCT source) AS targets FROM feat WHERE NOT starts_with(name, 'FUN_') GROUP BY name, {STRICT} HAVING count(DISTINCT source) > 1),
cross_target AS (SELECT {STRICT} FROM feat GROUP BY {STRICT} HAVING count(DISTINCT source) > 1),
collided AS (SELECT {STRICT}, count(DISTINCT {REAL}) AS names FROM feat JOIN cross_target USING ({STRICT}) GROUP BY {STRICT} HAVING count(DISTINCT {REAL}) > 1) """


@query("name_precision", rfeat(NAMED + "SELECT (SELECT count(*) FROM name_matches) AS confirmed, (SELECT count(*) FROM collided) AS collisions, round(100.0::DOUBLE * (SELECT count(*) FROM name_matches) / nullif((SELECT count(*) FROM name_matches) + (SELECT count(*) FROM collided), 0), 1) AS unambiguous_pct"))
def name_precision(spark, d):
    return ft.name_precision(routines(spark, d), ft.STRICT)


@query("hash_disambiguation", rfeat(NAMED + f"SELECT {STRICT}, any_value(names) AS names, count(DISTINCT body_hash) AS hashes FROM collided JOIN feat USING ({STRICT}) WHERE body_hash IS NOT NULL GROUP BY {STRICT}"))
def hash_disambiguation(spark, d):
    return ft.disambiguated(routines(spark, d), ft.STRICT)


@query("hash_confirmed", rfeat("SELECT name, body_hash, size, blocks, instructions, list(DISTINCT source ORDER BY source) AS sources FROM feat WHERE NOT starts_with(name, 'FUN_') AND body_hash IS NOT NULL GROUP BY name, body_hash, size, blocks, instructions HAVING count(DISTINCT source) > 1"))
def hash_confirmed(spark, d):
    return ft.hash_confirmed(routines(spark, d))


@query("signature_collisions", rfeat(f"SELECT source, {STRICT}, count(*) AS functions, list_slice(list(DISTINCT name ORDER BY name), 1, 5) AS names FROM feat GROUP BY source, {STRICT} HAVING count(*) > 1"))
def signature_collisions(spark, d):
    return ft.collisions(routines(spark, d), ft.STRICT)


@query("signature_discrimination", rfeat(f"SELECT source, count(*) AS functions, count(DISTINCT ({STRICT})) AS signatures FROM feat GROUP BY source"))
def signature_discrimination(spark, d):
    return ft.discrimination(routines(spark, d), ft.STRICT)


@query("tuple_twin_join", with_shapes("SELECT a.source AS a_source, a.addr AS a_addr, a.name AS a_name, b.source AS b_source, b.addr AS b_addr FROM functions a JOIN functions b ON a.name = b.name AND a.size = b.size AND a.signature = b.signature AND a.source < b.source", "functions"))
def tuple_twin_join(spark, d):
    return ft.twins(shape(spark, d, "functions"), ["name", "size", "signature"]).select("a_source", "a_addr", "a_name", "b_source", "b_addr")


@query("hash_match", "SELECT a.source AS a_source, b.source AS b_source, count(*) AS pairs FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.source < b.source GROUP BY ALL")
def hash_match(spark, d):
    h = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")).groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"))
    # copies are counted by source before the join: it makes sources squared rows a text and not copies squared
    a, b = h.alias("a"), h.alias("b")
    return a.join(b, F.expr("a.h = b.h and a.source < b.source")).groupBy(F.col("a.source").alias("a_source"), F.col("b.source").alias("b_source")).agg(F.sum(F.expr("a.n * b.n")).alias("pairs"))


ON_TUPLE = " AND ".join(f"a.{c} = b.{c}" for c in STRICT.split(", ")) + " AND a.source < b.source AND CAST(a.source[1] AS INT) % 2 = CAST(b.source[1] AS INT) % 2"
AUTO_A, AUTO_B = "starts_with(a.name, 'FUN_')", "starts_with(b.name, 'FUN_')"


@query(
    "fingerprint_tiers",
    rfeat(
        f""", h AS (SELECT a.source AS s1, a.addr AS a1, a.name AS n1, b.source AS s2, b.addr AS a2, b.name AS n2 FROM feat a JOIN feat b ON {ON_TUPLE} WHERE a.body_hash IS NOT NULL AND a.body_hash = b.body_hash),
        sn AS (SELECT a.source AS s1, a.addr AS a1, a.name AS n1, b.source AS s2, b.addr AS a2, b.name AS n2 FROM feat a JOIN feat b ON {ON_TUPLE} WHERE NOT {AUTO_A} AND NOT {AUTO_B} AND a.name = b.name AND NOT EXISTS (SELECT 1 FROM h WHERE s1 = a.source AND a1 = a.addr AND s2 = b.source AND a2 = b.addr)),
        nn AS (SELECT a.source AS s1, a.addr AS a1, a.name AS n1, b.source AS s2, b.addr AS a2, b.name AS n2 FROM feat a JOIN feat b ON {ON_TUPLE} WHERE {AUTO_A} <> {AUTO_B} AND NOT EXISTS (SELECT 1 FROM h WHERE s1 = a.source AND a1 = a.addr AND s2 = b.source AND a2 = b.addr)),
        hd AS (SELECT s1 AS source, a1 AS addr, n1 AS own, n2 AS other FROM h UNION ALL SELECT s2, a2, n2, n1 FROM h),
        directed AS (SELECT source, addr, other, CASE WHEN NOT starts_with(own, 'FUN_') AND NOT starts_with(other, 'FUN_') AND own = other THEN 'body_hash_exact+structural_8tuple_name_match' WHEN starts_with(own, 'FUN_') AND NOT starts_with(other, 'FUN_') THEN 'body_hash_exact+structural_8tuple_no_name' ELSE 'body_hash_exact' END AS method, 1.0::DOUBLE AS confidence FROM hd
          UNION ALL SELECT s1, a1, n2, 'structural_8tuple_name_match', 0.96 FROM sn UNION ALL SELECT s2, a2, n1, 'structural_8tuple_name_match', 0.96 FROM sn
          UNION ALL SELECT s1, a1, n2, 'structural_8tuple_no_name', 0.85 FROM nn UNION ALL SELECT s2, a2, n1, 'structural_8tuple_no_name', 0.85 FROM nn),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source, addr ORDER BY confidence DESC, method, starts_with(other, 'FUN_'), other) AS rn, count(DISTINCT other) FILTER (NOT starts_with(other, 'FUN_')) OVER (PARTITION BY source, addr) AS names FROM directed)
        SELECT source, addr, CASE WHEN NOT starts_with(other, 'FUN_') THEN other END AS inferred_name, confidence, method AS evidence_method, names > 1 AS conflict FROM ranked WHERE rn = 1"""
    ),
)
def fingerprint_tiers(spark, d):
    f = routines(spark, d)
    builds = shape(spark, d, "routines").select("source", (F.substring("source", 1, 1).cast("int") % 2).alias("build")).distinct()
    return identity.fingerprint_tiers(f, ft.STRICT, builds)


@query("coverage_full_outer", "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS both, count(*) FILTER (r.doc_id IS NULL) AS left_only, count(*) FILTER (l.doc_id IS NULL) AS right_only, 100.0::DOUBLE * count(*) FILTER (l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) / count(r.doc_id) AS covered_pct FROM (SELECT DISTINCT doc_id FROM documents) l FULL JOIN (SELECT DISTINCT doc_id FROM labels) r ON l.doc_id = r.doc_id")
def coverage_full_outer(spark, d):
    return identity.coverage(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("orphan_anti", with_shapes("SELECT source, count(*) AS orphans, min(printf('0x%08x', callee_addr)) AS example FROM calls c WHERE callee_addr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM functions f WHERE f.source = c.source AND f.addr = c.callee_addr) GROUP BY source", "calls", "functions"))
def orphan_anti(spark, d):
    f = shape(spark, d, "functions").select("source", F.col("addr").alias("callee_addr"))
    c = shape(spark, d, "calls").filter("callee_addr is not null").join(f, ["source", "callee_addr"], "left_anti")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("orphans"), F.min(F.format_string("0x%08x", "callee_addr")).alias("example"))


@query("consistency_check", with_shapes("SELECT f.source, f.addr, f.size, count(b.block_addr) AS counted FROM functions f LEFT JOIN basic_blocks b ON f.source = b.source AND f.addr = b.function_addr GROUP BY f.source, f.addr, f.size HAVING count(b.block_addr) <> f.size", "functions", "basic_blocks"))
def consistency_check(spark, d):
    b = shape(spark, d, "basic_blocks").groupBy("source", F.col("function_addr").alias("addr")).agg(F.count("block_addr").alias("counted"))
    return shape(spark, d, "functions").select("source", "addr", "size").join(b, ["source", "addr"], "left").na.fill(0, ["counted"]).filter("counted != size")


@query("fan_out", with_shapes("SELECT c.source, c.caller_addr AS addr, f.name, count(DISTINCT callee_addr) AS callees FROM calls c JOIN functions f ON f.source = c.source AND f.addr = c.caller_addr GROUP BY ALL ORDER BY callees DESC, c.source, addr LIMIT 10", "calls", "functions"))
def fan_out(spark, d):
    g = shape(spark, d, "calls").groupBy("source", F.col("caller_addr").alias("addr")).agg(F.count_distinct("callee_addr").alias("callees"))
    return g.join(shape(spark, d, "functions").select("source", "addr", "name"), ["source", "addr"]).orderBy(F.desc("callees"), "source", "addr").limit(10)


@query("fan_in", with_shapes("SELECT callee_addr, count(DISTINCT caller_addr) AS callers, count(*) AS sites FROM calls WHERE callee_addr IS NOT NULL GROUP BY callee_addr ORDER BY callers DESC, callee_addr LIMIT 10", "calls"))
def fan_in(spark, d):
    return shape(spark, d, "calls").filter("callee_addr is not null").groupBy("callee_addr").agg(F.count_distinct("caller_addr").alias("callers"), F.count(F.lit(1)).alias("sites")).orderBy(F.desc("callers"), "callee_addr").limit(10)


@query("shared_names_structs", with_shapes("SELECT name, count(DISTINCT source) AS sources, list(source || ':' || addr || ':' || size ORDER BY source, addr) AS members FROM functions WHERE NOT starts_with(name, 'FUN_') GROUP BY name HAVING count(DISTINCT source) > 1", "functions"))
def shared_names_structs(spark, d):
    g = shape(spark, d, "functions").filter(~identity.auto_named(F.col("name"))).groupBy("name").agg(F.count_distinct("source").alias("sources"), F.array_sort(F.collect_list(F.struct("source", "addr", "size"))).alias("m"))
    return g.filter("sources > 1").select("name", "sources", F.transform("m", lambda x: F.concat_ws(":", x["source"], x["addr"].cast("string"), x["size"].cast("string"))).alias("members"))


@query("topk_per_group", with_shapes("SELECT source, addr, size, rank FROM (SELECT source, addr, size, row_number() OVER (PARTITION BY source ORDER BY size DESC, addr)::INT AS rank FROM functions) WHERE rank <= 5", "functions"))
def topk_per_group(spark, d):
    return similarity.top_k(shape(spark, d, "functions").select("source", "addr", "size"), ["source"], [F.desc("size"), F.col("addr")], 5)


@query("primary_category", with_shapes("SELECT source, addr, ref_type FROM (SELECT source, function_addr AS addr, ref_type, row_number() OVER (PARTITION BY source, function_addr ORDER BY count(*) DESC, ref_type) AS k FROM xrefs GROUP BY source, function_addr, ref_type) WHERE k = 1", "xrefs"))
def primary_category(spark, d):
    g = shape(spark, d, "xrefs").groupBy("source", F.col("function_addr").alias("addr"), "ref_type").agg(F.count(F.lit(1)).alias("n"))
    return identity.latest(g, ["source", "addr"], [F.desc("n"), F.col("ref_type")]).select("source", "addr", "ref_type")


@query(
    "percent_rank_priority",
    with_shapes(
        """, g AS (SELECT source, caller_addr AS addr, count(DISTINCT callee_addr) AS degree FROM calls GROUP BY ALL),
        t AS (SELECT f.source, f.addr, f.name, percent_rank() OVER (PARTITION BY f.source ORDER BY coalesce(degree, 0)) AS r FROM functions f LEFT JOIN g USING (source, addr)),
        n AS (SELECT DISTINCT source, callee_addr AS addr FROM calls WHERE callee_addr IS NOT NULL)
        SELECT t.source, t.addr, 0.5::DOUBLE * r + 0.35::DOUBLE * (1.0 - CASE WHEN starts_with(name, 'FUN_') THEN 0.0 ELSE t.addr % 100 / 100.0::DOUBLE END) + 0.15::DOUBLE * (n.addr IS NOT NULL)::INT AS priority
        FROM t LEFT JOIN n USING (source, addr) WHERE starts_with(name, 'FUN_') OR t.addr % 100 / 100.0::DOUBLE < 0.85""",
        "calls",
        "functions",
    ),
)
def percent_rank_priority(spark, d):
    f, c = shape(spark, d, "functions"), shape(spark, d, "calls")
    degree = c.groupBy("source", F.col("caller_addr").alias("addr")).agg(F.count_distinct("callee_addr").alias("degree"))
    conf = f.select("source", "addr", F.when(identity.auto_named(F.col("name")), 0.0).otherwise((F.col("addr") % 100) / F.lit(100.0)).alias("confidence"), F.lit(False).alias("conflict"))
    front = c.filter("callee_addr is not null").select("source", F.col("callee_addr").alias("addr"))
    return identity.priority(f, degree, front, conf)


@query("evidence_latest", with_shapes("SELECT addr, id, confidence, method FROM evidence QUALIFY row_number() OVER (PARTITION BY addr ORDER BY confidence DESC, id DESC, method) = 1", "evidence"))
def evidence_latest(spark, d):
    return identity.latest(shape(spark, d, "evidence"), ["addr"], [F.desc("confidence"), F.desc("id"), F.col("method")])


@query("confidence_composed", with_shapes("SELECT addr, max(confidence) AS confidence, string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM evidence GROUP BY addr", "evidence"))
def confidence_composed(spark, d):
    return identity.composed(shape(spark, d, "evidence"), ["addr"])


@query("best_name_coalesce", with_shapes("SELECT f.source, f.addr, coalesce(e.name, w.name, CASE WHEN NOT starts_with(f.name, 'FUN_') THEN f.name END, printf('FUN_%08x', f.addr)) AS name, CASE WHEN e.name IS NOT NULL THEN 'evidence' WHEN w.name IS NOT NULL THEN 'enriched' WHEN NOT starts_with(f.name, 'FUN_') THEN 'raw' ELSE 'address' END AS origin FROM functions f LEFT JOIN (SELECT source, addr, 'e' || addr AS name FROM functions WHERE addr % 5 = 0) e USING (source, addr) LEFT JOIN (SELECT source, addr, 'w' || addr AS name FROM functions WHERE addr % 3 = 0) w USING (source, addr)", "functions"))
def best_name_coalesce(spark, d):
    f = shape(spark, d, "functions")
    named = lambda k, n: f.filter(F.col("addr") % n == 0).select("source", "addr", F.concat(F.lit(k), F.col("addr")).alias("name"))
    return identity.best_name(f, named("e", 5), named("w", 3))


@query("jaccard_sets", with_shapes(", s AS (SELECT DISTINCT function_addr AS k, to_addr AS v FROM xrefs WHERE ref_type = 'READ'), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.v = b.v AND a.k < b.k GROUP BY a.k, b.k) SELECT a, b, shared, shared::DOUBLE / (x.n + y.n - shared) AS jaccard FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.25", "xrefs"))
def jaccard_sets(spark, d):
    return similarity.similar_sets(shape(spark, d, "xrefs").filter("ref_type = 'READ'"), "function_addr", "to_addr", 1, 4)


CONST = """, fc AS (SELECT x.source, x.function_addr, f.name, x.to_addr, CASE WHEN x.to_addr BETWEEN 1073741824 AND 1610612735 THEN 'peripheral' WHEN x.to_addr >= 3758096384 THEN 'system' WHEN x.to_addr BETWEEN 536870912 AND 805306367 THEN 'sram' ELSE 'other' END AS addr_class
FROM routine_refs x JOIN routines f ON f.source = x.source AND f.addr = x.function_addr WHERE x.ref_type IN ('DATA', 'READ', 'WRITE', 'PARAM') AND x.to_addr IS NOT NULL AND NOT f.is_thunk AND f.size >= 16), """
SETS = {
    "full": "s AS (SELECT source, function_addr, list(DISTINCT to_addr ORDER BY to_addr) AS v FROM fc GROUP BY ALL HAVING count(DISTINCT to_addr) >= 3)",
    "peripheral": "s AS (SELECT source, function_addr, list(DISTINCT to_addr ORDER BY to_addr) AS v FROM fc WHERE addr_class IN ('peripheral', 'system') GROUP BY ALL HAVING count(DISTINCT to_addr) >= 2)",
    "relative": "s AS (SELECT source, function_addr, list(DISTINCT to_addr - function_addr ORDER BY to_addr - function_addr) AS v FROM fc GROUP BY ALL HAVING count(DISTINCT to_addr) >= 3)",
}
EQUAL = " SELECT a.source AS a_source, a.function_addr AS a_addr, b.source AS b_source, b.function_addr AS b_addr, len(a.v) AS n FROM s a JOIN s b ON a.v = b.v AND a.source < b.source"


def constant_sets(spark, d, kind):
    return ft.constant_sets(shape(spark, d, "routine_refs"), shape(spark, d, "routines"), kind)


def _register_sets(kind):
    @query(f"equal_{kind}_sets", with_shapes(CONST + SETS[kind] + EQUAL, "routines", "routine_refs"))
    def run(spark, d):
        return ft.equal_sets(constant_sets(spark, d, kind), "members")


for _kind in SETS:
    _register_sets(_kind)


@query("set_equality_join", with_shapes(", s AS (SELECT source, function_addr, list(DISTINCT to_addr ORDER BY to_addr) AS v FROM routine_refs GROUP BY ALL)" + EQUAL, "routine_refs"))
def set_equality_join(spark, d):
    """Equal sets of all referenced addresses of all functions."""
    x = shape(spark, d, "routine_refs").withColumnRenamed("function_addr", "addr")
    return ft.equal_sets(ft.sets(x, "to_addr", "v"), "v")


@query("region_counts", with_shapes(" SELECT CASE WHEN to_addr BETWEEN 1073741824 AND 1610612735 THEN 'peripheral' WHEN to_addr >= 3758096384 THEN 'system' WHEN to_addr BETWEEN 536870912 AND 805306367 THEN 'sram' ELSE 'other' END AS region, count(*) AS refs, count(DISTINCT to_addr) AS addresses FROM routine_refs GROUP BY 1", "routine_refs"))
def region_counts(spark, d):
    return shape(spark, d, "routine_refs").groupBy(recovery.region(F.col("to_addr")).alias("region")).agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("to_addr").alias("addresses"))


@query("cosine_dense", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def cosine_dense(spark, d):
    """The stated query set of searches (ids divisible by 20) against all vectors of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("*", similarity.squared(F.col("v")).alias("sq"))
    a, b = e.filter("vec_id % 20 = 0").alias("a"), e.alias("b")
    hit = a.join(b, F.expr("a.label = b.label and a.vec_id != b.vec_id"))
    cosine = similarity.cosine(similarity.dot(F.col("a.v"), F.col("b.v")), F.col("a.sq"), F.col("b.sq"))
    return hit.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), cosine.alias("cosine")).filter("cosine >= 0.3").withColumn("cosine", F.round("cosine", 6))


SPARSE = ", w AS (SELECT l_partkey AS id, l_suppkey AS key, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY id), c AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)), 9) AS cosine FROM w a JOIN w b ON a.key = b.key AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id WHERE a.id % 20 = 0 GROUP BY a.id, b.id)"


def _sparse(spark, d):
    """The stated query set of searches (ids divisible by 20) against all vectors."""
    w = spread(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey").groupBy(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("key")).agg(F.count(F.lit(1)).alias("w"))
    return similarity.sparse_cosine(w, F.col("id") % 20 == 0).withColumn("cosine", similarity.rounded(F.col("cosine"), 9))


@query("cosine_sparse", "WITH" + SPARSE[1:] + " SELECT a, b, cosine FROM c WHERE cosine >= 0.2")
def cosine_sparse(spark, d):
    return _sparse(spark, d).filter("cosine >= 0.2")


@query("similarity_histogram", "WITH" + SPARSE[1:] + " SELECT CASE WHEN cosine >= 0.4 THEN 0.4 WHEN cosine >= 0.2 THEN 0.2 WHEN cosine >= 0.1 THEN 0.1 WHEN cosine >= 0 THEN 0.0 END::DOUBLE AS bucket, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM c GROUP BY 1")
def similarity_histogram(spark, d):
    return similarity.histogram(_sparse(spark, d), "cosine", [0.0, 0.1, 0.2, 0.4])


@query("precision_curve", "WITH" + SPARSE[1:] + ", t AS (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold) SELECT threshold, count(a) AS pairs, coalesce(sum((a % 5 = b % 5)::INT), 0)::BIGINT AS correct, 100.0::DOUBLE * sum((a % 5 = b % 5)::INT) / nullif(count(a), 0) AS precision_pct FROM t LEFT JOIN c ON cosine >= threshold GROUP BY threshold")
def precision_curve(spark, d):
    return similarity.precision_curve(_sparse(spark, d), "cosine", F.expr("a % 5 = b % 5"), [0.05, 0.1, 0.2, 0.3, 0.5])


@query("signal_stats", "SELECT p_type AS kind, count(*) AS n, avg(p_size) AS mean, median(p_size)::DOUBLE AS median, stddev_samp(p_size) AS sd, max(p_size) AS top FROM part GROUP BY p_type")
def signal_stats(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("mean"), F.median("p_size").alias("median"), F.stddev_samp("p_size").alias("sd"), F.max("p_size").alias("top"))


@query("signal_correlation", "SELECT round(corr(p_size, p_retailprice), 9) AS corr FROM part")
def signal_correlation(spark, d):
    return similarity.correlation(table(spark, d, "part"), "p_size", "p_retailprice").select(F.round("corr", 9).alias("corr"))


BAND = "FROM functions r JOIN functions t ON t.size BETWEEN 0.5 * r.size AND 2.0 * r.size WHERE r.source = 'Brand#11' AND t.source = 'Brand#12'"


def _one_pair(f):
    """The registered pair of sources in the size band: r_* and t_* columns."""
    f = fixed(f.filter("source in ('Brand#11', 'Brand#12')"))
    return similarity.size_band(f.filter("source = 'Brand#11'"), f.filter("source = 'Brand#12'"))


@query("size_band_candidates", with_shapes(f"SELECT r.addr AS r_addr, t.addr AS t_addr {BAND}", "functions"))
def size_band_candidates(spark, d):
    f = shape(spark, d, "functions")
    return _one_pair(f.select("source", "addr", "size")).select("r_addr", "t_addr")


def _scored(spark, d):
    x = shape(spark, d, "xrefs").withColumnRenamed("function_addr", "addr")
    f = features(spark, d).join(ft.sets(x.filter("ref_type = 'READ'"), "to_addr", "registers"), ["source", "addr"], "left").withColumn("strings", F.array("signature"))
    f = f.select("source", "addr", "name", "size", "blocks", "out_calls", "distinct_callees", "reads", "writes", "registers", "strings", "body_hash")
    marks = {"registers": 4, "strings": 1}
    return similarity.weighted_score(_one_pair(similarity.marked(f, marks)), marks)


SCORED = """, g AS (SELECT source, function_addr AS addr, list(DISTINCT to_addr) AS registers FROM xrefs WHERE ref_type = 'READ' GROUP BY ALL),
f AS (SELECT feat.*, coalesce(registers, []) AS registers FROM feat LEFT JOIN g USING (source, addr)),
p AS (SELECT r.addr AS r_addr, t.addr AS t_addr,
 CASE WHEN r.size = 0 OR t.size = 0 THEN 0.0 ELSE exp(-3.0 * power((r.size::DOUBLE - t.size) / greatest(r.size, t.size), 2)) END AS s1,
 CASE WHEN r.blocks = t.blocks THEN 1.0 WHEN abs(r.blocks - t.blocks) = 1 THEN 0.7 WHEN abs(r.blocks - t.blocks) <= 3 THEN 0.3 ELSE 0.0 END::DOUBLE AS s2,
 CASE WHEN r.out_calls = t.out_calls AND r.distinct_callees = t.distinct_callees THEN 1.0 WHEN r.distinct_callees = t.distinct_callees THEN 0.8 WHEN abs(r.distinct_callees - t.distinct_callees) <= 1 THEN 0.5 WHEN abs(r.distinct_callees - t.distinct_callees) <= 2 THEN 0.2 ELSE 0.0 END::DOUBLE AS s3,
 CASE WHEN len(r.registers) = 0 OR len(t.registers) = 0 THEN 0 ELSE len(list_intersect(r.registers, t.registers))::DOUBLE / len(list_distinct(list_concat(r.registers, t.registers))) END AS s4,
 (r.signature = t.signature)::INT::DOUBLE AS s5, CASE WHEN r.body_hash IS NOT NULL AND r.body_hash <> '' AND r.body_hash = t.body_hash THEN 1.0 ELSE 0.0 END::DOUBLE AS s6,
 CASE WHEN r.reads = t.reads AND r.writes = t.writes THEN 1.0 WHEN abs(r.reads - t.reads) <= 2 AND abs(r.writes - t.writes) <= 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS s7
 FROM f r JOIN f t ON t.size BETWEEN 0.5 * r.size AND 2.0 * r.size WHERE r.source = 'Brand#11' AND t.source = 'Brand#12'),
s AS (SELECT r_addr, t_addr, round(0.15 * s1 + 0.15 * s2 + 0.10 * s3 + 0.25 * s4 + 0.20 * s5 + 0.05 * s6 + 0.10 * s7, 6)::DOUBLE AS score, (s1 > 0.5)::INT + (s2 > 0.5)::INT + (s3 > 0.5)::INT + (s4 > 0)::INT + (s5 > 0)::INT + (s6 > 0)::INT + (s7 > 0.5)::INT AS active FROM p) """


@query("weighted_score", feat(SCORED + "SELECT r_addr, t_addr, score, active FROM s"))
def weighted_score(spark, d):
    return _scored(spark, d).select("r_addr", "t_addr", similarity.rounded(F.col("score"), 6).alias("score"), "active")


@query("match_top3", feat(SCORED + "SELECT r_addr, t_addr, score, CASE WHEN score >= 0.5 AND active >= 3 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS tier, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY r_addr ORDER BY score DESC, t_addr)::INT AS k FROM s) WHERE k <= 3"))
def match_top3(spark, d):
    s = similarity.leaders(weighted_score(spark, d), "r_addr", "score", "t_addr", 3)
    s = similarity.top_k(s, ["r_addr"], [F.desc("score"), F.col("t_addr")], 3)
    return s.select("r_addr", "t_addr", "score", similarity.tier(F.col("score"), F.col("active")).alias("tier"), "rank")


# components over size, and operation counts; a vector of zeros or of too few operations has no cosine
COSINES = """, v AS (SELECT feat.*, [blocks / size, instructions / size, out_calls / size, distinct_callees / size, reads / size, writes / size, jumps / size]::DOUBLE[] AS shape FROM feat),
h AS (SELECT source, addr, [coalesce(json_extract(pcode_histogram, '$.COPY')::DOUBLE, 0), coalesce(json_extract(pcode_histogram, '$.LOAD')::DOUBLE, 0), coalesce(json_extract(pcode_histogram, '$.STORE')::DOUBLE, 0), coalesce(json_extract(pcode_histogram, '$.CALL')::DOUBLE, 0), coalesce(json_extract(pcode_histogram, '$.NONE')::DOUBLE, 0)] AS ops FROM histograms WHERE pcode_ops_total >= 20),
cs AS (SELECT source, caller_addr AS addr, list(DISTINCT callee_addr) AS callees FROM calls WHERE callee_addr IS NOT NULL GROUP BY ALL),
w AS (SELECT v.source, v.addr, v.size, v.name, v.signature, shape, ops, callees FROM v LEFT JOIN h USING (source, addr) LEFT JOIN cs USING (source, addr)),
p AS (SELECT a.addr AS a_addr, b.addr AS b_addr, list_dot_product(a.shape, b.shape) / nullif(sqrt(list_dot_product(a.shape, a.shape)) * sqrt(list_dot_product(b.shape, b.shape)), 0) AS structural,
 list_dot_product(a.ops, b.ops) / nullif(sqrt(list_dot_product(a.ops, a.ops)) * sqrt(list_dot_product(b.ops, b.ops)), 0) AS histogram,
 CASE WHEN a.callees IS NOT NULL AND b.callees IS NOT NULL THEN len(list_intersect(a.callees, b.callees))::DOUBLE / len(list_distinct(list_concat(a.callees, b.callees))) ELSE 0 END AS callees,
 (a.signature = b.signature)::INT::DOUBLE AS strings
 FROM w a JOIN w b ON b.size BETWEEN 0.5 * a.size AND 2.0 * a.size WHERE a.source = 'Brand#11' AND b.source = 'Brand#12') """
OPS = ["COPY", "LOAD", "STORE", "CALL", "NONE"]


def _composite(spark, d):
    """One pair of sources, in the size band: the reference function's source against the other's."""
    h = shape(spark, d, "histograms").filter("pcode_ops_total >= 20").select("source", "addr", ft.frequency_vector(F.col("pcode_histogram"), OPS).alias("ops"))
    c = ft.sets(shape(spark, d, "calls").withColumnRenamed("caller_addr", "addr"), "callee_addr", "callees")
    f = features(spark, d).select("source", "addr", "size", ft.shape_vector().alias("shape"), F.array("signature").alias("strings"))
    f = f.join(h, ["source", "addr"], "left").join(c, ["source", "addr"], "left")
    marks, units = {"callees": 4, "strings": 1}, {"shape": len(ft.STRICT) - 1, "ops": len(OPS)}
    pairs = _one_pair(similarity.unit_columns(similarity.marked(f, marks), units))
    return similarity.composite(pairs.withColumnsRenamed({x: ("a_" if x[0] == "r" else "b_") + x[2:] for x in pairs.columns}), units, marks)


@query("structural_cosine", with_shapes(feature_sql(*FACTS) + COSINES + "SELECT a_addr, b_addr, round(structural, 9) AS structural FROM p WHERE round(structural, 9) >= 0.9", *FACTS, "histograms"))
def structural_cosine(spark, d):
    d = _composite(spark, d).filter(similarity.rounds_up_to(F.col("structural"), 9, 0.9))
    return d.select("a_addr", "b_addr", similarity.rounded(F.col("structural"), 9).alias("structural"))


@query("histogram_cosine", with_shapes(feature_sql(*FACTS) + COSINES + "SELECT a_addr, b_addr, round(histogram, 9) AS histogram FROM p WHERE histogram IS NOT NULL", *FACTS, "histograms"))
def histogram_cosine(spark, d):
    return _composite(spark, d).filter("histogram is not null").select("a_addr", "b_addr", similarity.rounded(F.col("histogram"), 9).alias("histogram"))


@query("composite_score", with_shapes(feature_sql(*FACTS) + COSINES + "SELECT a_addr, b_addr, round(0.25 * coalesce(structural, 0) + 0.25 * coalesce(histogram, 0) + 0.25 * callees + 0.25 * strings, 9) AS score FROM p", *FACTS, "histograms"))
def composite_score(spark, d):
    return _composite(spark, d).select("a_addr", "b_addr", similarity.rounded(F.col("score"), 9).alias("score"))


SEED = "(SELECT min(src) AS node FROM edges)"


def _seed(e):
    return e.agg(F.min("src").alias("node"))


@query("reach_min_depth", with_shapes(f", r(node, depth) AS (SELECT node, 0 FROM {SEED} UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node", "edges"))
def reach_min_depth(spark, d):
    e = shape(spark, d, "edges")
    return graph.reach(e, _seed(e), 4)


@query("reverse_reach", with_shapes(f", r(node, depth) AS (SELECT node, 0 FROM {SEED} UNION SELECT e.src, depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node", "edges"))
def reverse_reach(spark, d):
    e = shape(spark, d, "edges")
    return graph.reverse_reach(e, _seed(e), 3)


@query("reach_set", with_shapes(f", r(node) AS (SELECT node FROM {SEED} UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node) SELECT node FROM r", "edges"))
def reach_set(spark, d):
    e = shape(spark, d, "edges")
    return graph.reach(e, _seed(e)).select("node")


@query("multi_root_reach", with_shapes(", r(node, depth) AS (SELECT DISTINCT src, 0 FROM edges WHERE src % 25 = 1 UNION SELECT e.dst, depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node", "edges"))
def multi_root_reach(spark, d):
    e = shape(spark, d, "edges")
    return graph.reach(e, e.filter("src % 25 = 1").select(F.col("src").alias("node")), 3)


# one program's graph: entries are parts 2 and 3, main is part 5
REPORT = ", n AS (SELECT p_partkey AS node, CASE WHEN p_partkey = 5 THEN 'main' ELSE p_name END AS name FROM part), p(src, dst) AS (SELECT src, dst FROM tree UNION SELECT p.src, t.dst FROM p JOIN tree t ON t.src = p.dst), m AS (SELECT node FROM n WHERE name = 'main'), en AS (SELECT node FROM m UNION SELECT 2 UNION SELECT 3)"


def _report(spark, d, *only):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") == 5, "main").otherwise(F.col("p_name")).alias("name"))
    return graph.reach_report(shape(spark, d, "tree"), n, spark.createDataFrame([(2,), (3,)], "node long"), least=2, only=only)


@query("report_unreachable", with_shapes(REPORT + " SELECT n.node, n.name, n.node NOT IN (SELECT node FROM en) AND n.node NOT IN (SELECT dst FROM p WHERE src IN (SELECT node FROM en)) AS truly FROM n WHERE n.name <> 'main' AND n.node NOT IN (SELECT dst FROM p WHERE src IN (SELECT node FROM m))", "tree"))
def report_unreachable(spark, d):
    r = _report(spark, d, "unreachable_from_main", "truly_unreachable")
    return r["unreachable_from_main"].join(r["truly_unreachable"].select("node", F.lit(True).alias("truly")), "node", "left").na.fill(False, ["truly"])


@query("report_counts", with_shapes(REPORT + " SELECT n.node, n.name, (SELECT count(*) FROM p WHERE p.src = n.node) AS reachable FROM n", "tree"))
def report_counts(spark, d):
    return _report(spark, d, "reach_count")["reach_count"]


@query("subsystem_pairs", with_shapes(", s AS (SELECT a.src AS a, b.src AS b, count(*) AS shared FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 2) SELECT 'f' || a AS name_a, 'f' || b AS name_b, shared FROM s", "edges"))
def subsystem_pairs(spark, d):
    e = shape(spark, d, "edges")
    n = e.select(F.col("src").alias("node")).distinct().withColumn("name", F.concat(F.lit("f"), F.col("node")))
    return graph.reach_report(e, n, n.select("node").limit(0), least=2, only=["subsystem_pairs"])["subsystem_pairs"]


@query("default_handlers", "WITH s AS (SELECT o_orderpriority AS source, o_orderkey % 300 AS slot, o_custkey % 40 * 4 + o_custkey % 2 AS word FROM orders), g AS (SELECT source, word & ~1 AS handler, count(*) AS slots, min(slot) AS first FROM s WHERE slot >= 1 AND word <> 0 GROUP BY ALL) SELECT source, handler, slots FROM g WHERE slots >= 3 QUALIFY row_number() OVER (PARTITION BY source ORDER BY slots DESC, first, handler) = 1")
def default_handlers(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 300).alias("slot"), (F.col("o_custkey") % 40 * 4 + F.col("o_custkey") % 2).alias("word"))
    return recovery.default_handlers(s)


@query("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("framed_windows", with_shapes(" SELECT source, addr, size, lead(size) OVER w AS next_size, ntile(4) OVER w AS quarter, avg(size) OVER (PARTITION BY source ORDER BY addr ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM functions WINDOW w AS (PARTITION BY source ORDER BY addr)", "functions"))
def framed_windows(spark, d):
    w = Window.partitionBy("source").orderBy("addr")
    return shape(spark, d, "functions").select("source", "addr", "size", F.lead("size").over(w).alias("next_size"), F.ntile(4).over(w).cast("long").alias("quarter"), F.avg("size").over(w.rowsBetween(-2, 2)).alias("around"))


TREE = ", p(src, dst) AS (SELECT src, dst FROM tree UNION SELECT p.src, t.dst FROM p JOIN tree t ON t.src = p.dst)"


@query("closure_counts", with_shapes(TREE + " SELECT src AS node, count(*) AS reachable FROM p GROUP BY src", "tree"))
def closure_counts(spark, d):
    return graph.closure(shape(spark, d, "tree")).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("reachable"))


@query("orchestrators", with_shapes(TREE + " SELECT n.node, count(DISTINCT t.dst) AS direct, (SELECT count(*) FROM p WHERE p.src = n.node) AS reachable FROM (SELECT p_partkey AS node FROM part) n JOIN tree t ON t.src = n.node GROUP BY n.node HAVING count(DISTINCT t.dst) >= 2 AND reachable >= 10", "tree"))
def orchestrators(spark, d):
    return graph.orchestrators(shape(spark, d, "tree"), table(spark, d, "part").select(F.col("p_partkey").alias("node")), 2, 10)


@query("unreachable_anti", with_shapes(", r(node) AS (SELECT 1::BIGINT UNION SELECT t.dst FROM r JOIN tree t ON t.src = r.node) SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)", "tree"))
def unreachable_anti(spark, d):
    return graph.unreachable(shape(spark, d, "tree"), table(spark, d, "part").select(F.col("p_partkey").alias("node")), spark.createDataFrame([(1,)], "node long"))


@query("shared_neighbors", with_shapes(" SELECT a.src AS a, b.src AS b, count(*) AS shared FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 2", "edges"))
def shared_neighbors(spark, d):
    return graph.shared_callees(shape(spark, d, "edges"), 2)


@query("affinity_decay", with_shapes(", l0 AS (SELECT p_partkey AS node, p_type AS label, 1.0::DOUBLE AS weight FROM part WHERE p_size > 40), l1 AS (SELECT src AS node, label, sum(weight) * 0.5 AS weight FROM l0 JOIN tree ON dst = node GROUP BY ALL), l2 AS (SELECT src AS node, label, sum(weight) * 0.5 AS weight FROM l1 JOIN tree ON dst = node GROUP BY ALL), l3 AS (SELECT src AS node, label, sum(weight) * 0.5 AS weight FROM l2 JOIN tree ON dst = node GROUP BY ALL), s AS (SELECT node, label, sum(weight) AS w FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) GROUP BY ALL) SELECT node, label, w / max(w) OVER (PARTITION BY node) AS affinity FROM s", "tree"))
def affinity_decay(spark, d):
    own = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("label"), F.lit(1.0).alias("weight"))
    return graph.affinity(shape(spark, d, "tree"), own)


@query("registrar_edges", with_shapes(", direct AS (SELECT DISTINCT source, caller_addr AS a, callee_addr AS c FROM calls WHERE callee_addr IS NOT NULL), used AS (SELECT source, callee_addr AS c FROM calls WHERE callee_addr IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), held AS (SELECT DISTINCT x.source, function_addr AS a, to_addr AS b FROM xrefs x JOIN functions f ON f.source = x.source AND f.addr = x.to_addr WHERE ref_type = 'DATA') SELECT DISTINCT d.source, d.c AS caller_addr, h.b AS callee_addr FROM direct d JOIN used u ON u.source = d.source AND u.c = d.c JOIN functions f ON f.source = d.source AND f.addr = d.c AND f.num_params >= 4 JOIN held h ON h.source = d.source AND h.a = d.a WHERE h.b <> d.a AND h.b <> d.c", "calls", "xrefs", "functions"))
def registrar_edges(spark, d):
    x = shape(spark, d, "xrefs").filter("ref_type = 'DATA'")
    return recovery.registrar_edges(shape(spark, d, "calls"), x, shape(spark, d, "functions")).select("source", "caller_addr", "callee_addr")


@query("pointer_edges", with_shapes(" SELECT x.source, function_addr AS caller_addr, to_addr AS callee_addr, min(from_addr) AS call_site_addr, 0.7::DOUBLE AS confidence FROM xrefs x JOIN functions f ON f.source = x.source AND f.addr = x.to_addr WHERE ref_type IN ('DATA', 'PARAM', 'WRITE', 'INDIRECTION', 'DATA_IND') AND function_addr <> to_addr GROUP BY ALL", "xrefs", "functions"))
def pointer_edges(spark, d):
    e = recovery.pointer_edges(shape(spark, d, "xrefs"), shape(spark, d, "functions"))
    return recovery.merged([e]).select("source", "caller_addr", "callee_addr", "call_site_addr", "confidence")


@query("vector_edges", with_shapes(", w AS (SELECT DISTINCT source, word & ~1 AS target FROM slots WHERE slot BETWEEN 1 AND 256 AND word <> 0), o AS (SELECT w.source, w.target, f.addr, f.size FROM w ASOF LEFT JOIN routines f ON f.source = w.source AND w.target >= f.addr) SELECT source, target AS callee_addr, CASE WHEN target = addr THEN 1.0 WHEN target < addr + size THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM o", "slots", "routines"))
def vector_edges(spark, d):
    return recovery.vector_edges(shape(spark, d, "slots"), shape(spark, d, "routines")).select("source", "callee_addr", "confidence")


@query("veneer_edges", with_shapes(" SELECT source, function_addr AS caller_addr, to_addr AS callee_addr, from_addr AS call_site_addr FROM routine_refs x WHERE ref_type = 'COMPUTED_JUMP' AND to_addr IS NOT NULL AND to_addr <> function_addr AND (source, to_addr) IN (SELECT source, addr FROM routines)", "routine_refs", "routines"))
def veneer_edges(spark, d):
    return recovery.veneer_edges(shape(spark, d, "routine_refs"), shape(spark, d, "routines")).select("source", "caller_addr", "callee_addr", "call_site_addr")


@query("constant_edges", with_shapes(", hit AS (SELECT w.source, w.addr AS place, f.addr AS target FROM words w JOIN routines f ON f.source = w.source AND f.addr % 2 = 0 AND w.word IN (f.addr, f.addr + 1) WHERE w.addr % 4 = 0 AND w.addr <> f.addr), o AS (SELECT h.source, h.place, h.target, f.addr AS owner, f.size FROM hit h ASOF JOIN (SELECT * FROM routines WHERE addr % 2 = 0) f ON f.source = h.source AND h.place >= f.addr) SELECT source, owner AS caller_addr, target AS callee_addr, min(place) AS call_site_addr FROM o WHERE place < owner + size + 256 AND owner <> target GROUP BY source, owner, target", "words", "routines"))
def constant_edges(spark, d):
    # entries are even addresses, as the Thumb bit asks
    f = shape(spark, d, "routines").filter("addr % 2 = 0")
    return recovery.constant_edges(shape(spark, d, "words"), f).select("source", "caller_addr", "callee_addr", "call_site_addr")


@query("edge_verdicts", with_shapes(" SELECT x.source, function_addr AS caller_addr, to_addr AS callee_addr, from_addr AS call_site_addr, from_addr - (function_addr + c.size) AS after, CASE WHEN c.name LIKE 'fn_1%' AND t.name LIKE 'fn_2%' THEN 'TP: callback' WHEN t.name LIKE 'FUN!_%' ESCAPE '!' THEN 'AMBIG: unnamed' WHEN c.name = t.name THEN 'FP: self-reference' ELSE 'REVIEW' END AS verdict FROM routine_refs x JOIN routines c ON c.source = x.source AND c.addr = x.function_addr JOIN routines t ON t.source = x.source AND t.addr = x.to_addr WHERE ref_type = 'COMPUTED_JUMP' AND to_addr <> function_addr", "routine_refs", "routines"))
def edge_verdicts(spark, d):
    f = shape(spark, d, "routines")
    rules = [("fn_1%", "fn_2%", "TP: callback"), ("%", "FUN\\_%", "AMBIG: unnamed")]
    return recovery.edge_verdicts(recovery.veneer_edges(shape(spark, d, "routine_refs"), f), f, rules).select("source", "caller_addr", "callee_addr", "call_site_addr", "after", "verdict")


MAP = [(0, 10, "CORE"), (10, 20, "TIMER"), (20, 35, "UART"), (40, 50, "GPIO")]


@query("range_classify", f"SELECT coalesce(name, 'unmapped') AS peripheral, count(*) AS n, count(DISTINCT p_brand) AS sources FROM part LEFT JOIN (VALUES {', '.join(map(str, MAP))}) m(lo, hi, name) ON p_size >= lo AND p_size < hi GROUP BY 1")
def range_classify(spark, d):
    m = spark.createDataFrame(MAP, "lo long, hi long, name string")
    hit = ranges.range_join(table(spark, d, "part").select("p_brand", F.col("p_size").cast("long").alias("addr")), m, how="left")
    return hit.groupBy(F.coalesce("name", F.lit("unmapped")).alias("peripheral")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("sources"))


@query("owner_asof", "WITH p AS (SELECT c_nationkey AS source, c_custkey * 7 AS at FROM customer), s AS (SELECT s_nationkey AS source, s_suppkey * 100 AS addr, 50 AS size FROM supplier) SELECT p.source, p.at, CASE WHEN p.at < s.addr + s.size + 25 THEN s.addr END AS owner FROM p ASOF LEFT JOIN s ON p.source = s.source AND p.at >= s.addr")
def owner_asof(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("source"), (F.col("c_custkey") * 7).alias("at"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("source"), (F.col("s_suppkey") * 100).alias("addr"), F.lit(50).alias("size"))
    return ranges.owner_asof(p, s, tolerance=25).select("source", "at", "owner")


@query("region_profile", with_shapes(" SELECT source, function_addr, count(*) AS accesses, list(DISTINCT ref_type ORDER BY ref_type) AS peripherals, count(DISTINCT to_addr % 4) AS groups FROM xrefs GROUP BY ALL HAVING count(DISTINCT to_addr % 4) >= 2", "xrefs"))
def region_profile(spark, d):
    x = shape(spark, d, "xrefs").withColumn("peripheral", F.col("ref_type")).withColumn("peripheral_group", F.col("to_addr") % 4)
    return recovery.peripheral_profile(x, 2)


@query("offset_map", with_shapes(" SELECT source, to_addr - 1 AS \"offset\", count(*) FILTER (ref_type = 'READ') AS reads, count(*) FILTER (ref_type = 'WRITE') AS writes, count(DISTINCT function_addr) AS functions, printf('0x%03X', to_addr - 1) AS label FROM xrefs WHERE to_addr >= 1 AND to_addr < 33 GROUP BY source, to_addr", "xrefs"))
def offset_map(spark, d):
    return recovery.offset_map(shape(spark, d, "xrefs"), 1, 33)


@query("writer_reader_flow", with_shapes(" SELECT w.source, w.function_addr AS writer, r.function_addr AS reader, count(*) AS shared FROM (SELECT DISTINCT source, function_addr, to_addr FROM xrefs WHERE ref_type = 'WRITE') w JOIN (SELECT DISTINCT source, function_addr, to_addr FROM xrefs WHERE ref_type = 'READ') r ON w.source = r.source AND w.to_addr = r.to_addr AND w.function_addr <> r.function_addr GROUP BY ALL HAVING count(*) >= 3", "xrefs"))
def writer_reader_flow(spark, d):
    return recovery.writer_reader_flow(shape(spark, d, "xrefs"), 3)


@query("shared_globals", with_shapes(", g AS (SELECT source, to_addr, list(DISTINCT function_addr ORDER BY function_addr) FILTER (ref_type = 'WRITE') AS writers, list(DISTINCT function_addr ORDER BY function_addr) FILTER (ref_type = 'READ') AS readers FROM xrefs WHERE to_addr >= 10 AND to_addr < 60 GROUP BY ALL) SELECT * FROM g WHERE len(writers) > 0 AND len(readers) > 0", "xrefs"))
def shared_globals(spark, d):
    return recovery.shared_globals(shape(spark, d, "xrefs"), 10, 60)


@query("version_matrix", with_shapes(", p AS (SELECT version, lead(version) OVER (ORDER BY version) AS nxt FROM (SELECT DISTINCT version FROM versions)), a AS (SELECT p.version AS f, p.nxt AS t, v.addr, v.hash FROM p JOIN versions v ON v.version = p.version WHERE nxt IS NOT NULL), b AS (SELECT p.version AS f, p.nxt AS t, v.addr, v.hash FROM p JOIN versions v ON v.version = p.nxt) SELECT coalesce(a.f, b.f) AS \"from\", coalesce(a.t, b.t) AS \"to\", count(*) FILTER (a.hash = b.hash) AS identical, count(*) FILTER (a.hash <> b.hash) AS changed, count(*) FILTER (a.addr IS NULL) AS added, count(*) FILTER (b.addr IS NULL) AS removed FROM a FULL JOIN b ON a.f = b.f AND a.t = b.t AND a.addr = b.addr GROUP BY 1, 2", "versions"))
def version_matrix(spark, d):
    return identity.version_matrix(shape(spark, d, "versions"), F.col("version"))


@query("stable_core", "WITH v AS (SELECT CAST(year(o_orderdate) AS INT) AS version, o_custkey % 400 AS addr, min(o_orderstatus) AS hash FROM orders GROUP BY ALL) SELECT addr, min(hash) AS hash FROM v GROUP BY addr HAVING count(DISTINCT version) = (SELECT count(DISTINCT version) FROM v) AND count(DISTINCT hash) = 1")
def stable_core(spark, d):
    v = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("version"), (F.col("o_custkey") % 400).alias("addr")).agg(F.min("o_orderstatus").alias("hash"))
    return identity.stable_core(v)


@query("intersect_hashes", "SELECT sha256(text) AS hash FROM documents WHERE source < 'src2' INTERSECT SELECT sha256(text) FROM documents WHERE source >= 'src2'")
def intersect_hashes(spark, d):
    h = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("hash"))
    return h.filter("source < 'src2'").select("hash").intersect(h.filter("source >= 'src2'").select("hash"))


@query("body_search", "SELECT doc_id, list_filter(['password', 'token', 'License'], lambda x: contains(text, x)) AS found FROM documents WHERE len(list_filter(['password', 'token', 'License'], lambda x: contains(text, x))) > 0")
def body_search(spark, d):
    return text.body_search(table(spark, d, "documents"), ["password", "token", "License"], "text").select("doc_id", "found")


@query("token_match_quality", "WITH t AS (SELECT a.p_partkey AS id, CASE WHEN a.p_partkey % 9 = 0 THEN upper(a.p_name) ELSE a.p_name END AS said, CASE WHEN a.p_partkey % 3 = 0 THEN a.p_name ELSE b.p_name END AS truth FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), n AS (SELECT id, replace(said, ' ', '_') AS said, replace(truth, ' ', '_') AS truth FROM t) SELECT id, {} AS quality FROM (SELECT *, list_filter(string_split(lower(said), '_'), lambda z: z <> '') AS x, list_filter(string_split(lower(truth), '_'), lambda z: z <> '') AS y FROM n)".format("CASE WHEN said = truth THEN 'exact' WHEN contains(lower(said), lower(truth)) OR contains(lower(truth), lower(said)) THEN 'contained' WHEN len(list_intersect(x, y))::DOUBLE / greatest(len(list_distinct(x)), len(list_distinct(y))) > 0.5 THEN 'similar' ELSE 'wrong' END"))
def token_match_quality(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey")
    line = lambda c: F.regexp_replace(c, " ", "_")
    said = F.when(F.col("p_partkey") % 9 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    truth = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("next"))
    return j.select(F.col("p_partkey").alias("id"), identity.name_match(line(truth), line(said)).alias("quality"))


@query("carry_forward_pc", "WITH t AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN (props->>'k')::BIGINT END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS pc FROM events) SELECT user_id, event_id, event_type, pc FROM t WHERE event_type IN ('click', 'purchase')")
def carry_forward_pc(spark, d):
    from ..sources.facts import carry_forward

    e = table(spark, d, "events").withColumn("own", F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("long")))
    return carry_forward(e, ["user_id"], ["event_id"], "own", "pc").filter("event_type in ('click', 'purchase')").select("user_id", "event_id", "event_type", "pc")


@query("neighbourhood_siblings", with_shapes(", u AS (SELECT dst AS node, src AS caller FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 3), s AS (SELECT u.node, u.caller, e.dst AS sibling FROM u JOIN edges e ON e.src = u.caller WHERE e.dst <> u.node QUALIFY row_number() OVER (PARTITION BY u.node, u.caller ORDER BY e.dst) <= 8) SELECT u.node, u.caller, coalesce(list(s.sibling ORDER BY s.sibling) FILTER (s.sibling IS NOT NULL), []) AS siblings FROM u LEFT JOIN s ON s.node = u.node AND s.caller = u.caller GROUP BY u.node, u.caller", "edges"))
def neighbourhood_siblings(spark, d):
    return recovery.neighbourhood(shape(spark, d, "edges"))


@query("hardware_roles", with_shapes(f", r(node, depth) AS (SELECT node, 0 FROM {SEED} UNION SELECT e.src, depth + 1 FROM r JOIN edges e ON e.dst = r.node WHERE depth < 4) SELECT node, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'driver' WHEN min(depth) = 1 THEN 'service' WHEN min(depth) <= 3 THEN 'control' ELSE 'application' END AS role FROM r GROUP BY node", "edges"))
def hardware_roles(spark, d):
    e = shape(spark, d, "edges")
    return recovery.hardware_roles(e, _seed(e), 4)


@query("window_daily", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def window_daily(spark, d):
    from ..streaming.trace_stream import windowed

    return windowed(table(spark, d, "events"), "ts", "1 day", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_gaps", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_gaps(spark, d):
    from ..streaming.trace_stream import sessions

    s = sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _event_stream(spark, d):
    """The events as a stream whose one trigger takes all files; a glob, because a stream's path must be no single file."""
    from ..streaming.trace_stream import read_stream

    return read_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema, files=None)


def _drained(spark, stream):
    """What the append sink wrote of *stream*, in the shared folder."""
    from ..operators.tables import shared
    from ..streaming.trace_stream import to_parquet

    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    to_parquet(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("stream_trace", "WITH t AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN event_id * 4 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS pc FROM events) SELECT 'trace' AS source, user_id::VARCHAR AS scenario, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence_idx, pc, event_id % 64 AS address, floor(value)::BIGINT AS value, CASE event_type WHEN 'click' THEN 'read' ELSE 'write' END AS direction FROM t WHERE event_type <> 'view'")
def stream_trace(spark, d):
    from ..streaming.trace_stream import access_stream

    view = F.col("event_type") == "view"
    cols = {"pc": F.when(view, F.col("event_id") * 4), "direction": F.when(~view, F.when(F.col("event_type") == "click", "read").otherwise("write")), "address": F.col("event_id") % 64, "io_value": F.floor("value")}
    lines = _event_stream(spark, d).select(F.lit("trace").alias("source"), F.col("user_id").cast("string").alias("scenario"), F.col("event_id").alias("line"), *(c.cast("string" if k == "direction" else "long").alias(k) for k, c in cols.items()))
    return _drained(spark, access_stream(lines))


@query("stream_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    from ..operators.tables import shared
    from ..streaming.trace_stream import run_once, windowed

    name = f"windows_{uuid.uuid4().hex}"
    w = windowed(_event_stream(spark, d), "ts", "1 day", ["event_type"])
    return run_once(w, name, f"{shared(spark)}/{name}", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    from ..streaming.trace_stream import first_seen

    return _drained(spark, first_seen(_event_stream(spark, d), "ts", ["user_id", "event_type"]).select("user_id", "event_type"))


# accesses to five kinds, one of them infrastructure; ids jump in places
SEGMENTED = """, e AS (SELECT user_id, event_id + 60 * (event_id // 400) AS place, CASE WHEN event_id % 7 = 0 THEN 'RCC' ELSE event_type END AS kind FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
c AS (SELECT a.user_id, a.i, b.kind, b.i < a.i AS before, count(*) AS hits, min(b.i) AS first FROM n a JOIN n b ON b.user_id = a.user_id AND b.i >= a.i - 8 AND b.i < a.i + 8 WHERE a.i >= 8 AND a.i < a.n - 8 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, i, before ORDER BY kind = 'RCC', hits DESC, first) AS k FROM c),
dom AS (SELECT user_id, i, max(kind) FILTER (before) AS dom_before, max(kind) FILTER (NOT before) AS dom_after, max(CASE WHEN kind <> 'RCC' THEN hits ELSE 0 END) FILTER (NOT before) AS hits FROM o WHERE k = 1 GROUP BY ALL),
cut AS (SELECT n.user_id, n.place, coalesce(n.place - lag(n.place) OVER (PARTITION BY n.user_id ORDER BY n.place) > 100, false) OR coalesce(dom_before <> dom_after AND hits >= 3, false) AS fresh FROM n LEFT JOIN dom USING (user_id, i))
SELECT user_id, place, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY place)::BIGINT AS segment FROM cut"""


def _kinds(spark, d):
    return table(spark, d, "events").select("user_id", F.expr("event_id + 60 * (event_id DIV 400)").alias("place"), F.when(F.col("event_id") % 7 == 0, "RCC").otherwise(F.col("event_type")).alias("kind"))


@query("segment_boundaries", "WITH" + SEGMENTED[1:])
def segment_boundaries(spark, d):
    return text.boundaries(_kinds(spark, d), ["user_id"], "place", "kind", infra=["RCC"]).select("user_id", "place", "segment")


# a segment of under three accesses outside RCC joins the one before, then neighbours of one dominant kind are one phase
PHASES = "WITH" + SEGMENTED[1:].replace("SELECT n.user_id, n.place,", "SELECT n.user_id, n.place, n.kind,").replace("SELECT user_id, place, sum", ", sg AS (SELECT user_id, place, kind, sum") + """),
own AS (SELECT user_id, segment, count(*) FILTER (kind <> 'RCC') AS own FROM sg GROUP BY ALL),
g AS (SELECT user_id, segment, count(*) FILTER (own >= 3 OR segment = 0) OVER (PARTITION BY user_id ORDER BY segment) AS g FROM own),
q AS (SELECT user_id, g, kind, count(*) AS n, min(place) AS lo, max(place) AS hi FROM sg JOIN g USING (user_id, segment) GROUP BY ALL),
l AS (SELECT user_id, g, kind AS label FROM q QUALIFY row_number() OVER (PARTITION BY user_id, g ORDER BY kind = 'RCC', n DESC, lo) = 1),
ch AS (SELECT *, coalesce(label <> lag(label) OVER (PARTITION BY user_id ORDER BY g), false) AS fresh FROM l),
p AS (SELECT user_id, g, label, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY g) AS phase FROM ch)
SELECT user_id, phase::INT AS phase, min(lo) AS start, max(hi) AS "end", sum(n)::BIGINT AS hits, label FROM q JOIN p USING (user_id, g) GROUP BY user_id, phase, label"""


@query("segment_phases", PHASES)
def segment_phases(spark, d):
    return text.segments(_kinds(spark, d), ["user_id"], "place", "kind", infra=["RCC"])


@query("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("global_share", "SELECT p_type, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM part GROUP BY p_type")
def global_share(spark, d):
    g = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()).cast("double"))


@query("static_vs_full_reach", with_shapes(f", more AS (SELECT src, dst FROM edges UNION SELECT DISTINCT user_id AS src, user_id % 50 + 1 AS dst FROM events WHERE event_type = 'purchase'), a(node) AS (SELECT node FROM {SEED} UNION SELECT e.dst FROM a JOIN edges e ON e.src = a.node), b(node) AS (SELECT node FROM {SEED} UNION SELECT e.dst FROM b JOIN more e ON e.src = b.node) SELECT (SELECT count(*) FROM a) AS static_nodes, (SELECT count(*) FROM b) AS full_nodes", "edges"))
def static_vs_full_reach(spark, d):
    e = shape(spark, d, "edges")
    more = e.union(table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", (F.col("user_id") % 50 + 1).alias("dst"))).distinct()
    a, b = graph.reach(e, _seed(e)), graph.reach(more, _seed(e))
    return a.agg(F.count(F.lit(1)).alias("static_nodes")).crossJoin(b.agg(F.count(F.lit(1)).alias("full_nodes")))  # one row each


@query("frontier_nodes", with_shapes(", u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) SELECT DISTINCT dst AS node FROM u WHERE src % 10 = 0 AND dst % 3 <> 0", "edges"))
def frontier_nodes(spark, d):
    e = shape(spark, d, "edges")
    ends = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return recovery.frontier(e, ends.filter("node % 3 = 0"), ends.filter("node % 10 = 0"))


@query("revisit_set", with_shapes(", u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), n AS (SELECT src AS node, count(*) AS links FROM u WHERE dst % 10 = 0 GROUP BY src HAVING count(*) >= 2), c AS (SELECT DISTINCT src AS node, src % 100 / 100.0::DOUBLE AS confidence FROM u) SELECT c.node, confidence, links FROM c JOIN n USING (node) WHERE confidence < 0.7 ORDER BY confidence, c.node LIMIT 50", "edges"))
def revisit_set(spark, d):
    e = shape(spark, d, "edges")
    ends = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return recovery.revisit(ends.withColumn("confidence", (F.col("node") % 100) / F.lit(100.0)), e, ends.filter("node % 10 = 0"))


@query("recovery_audit", with_shapes(", d AS (SELECT DISTINCT source, caller_addr, callee_addr FROM routine_calls WHERE callee_addr IS NOT NULL), e AS (SELECT 'func_ptr_ref' AS mechanism, x.source, function_addr AS caller_addr, to_addr AS callee_addr, min(from_addr) AS site FROM routine_refs x JOIN routines f ON f.source = x.source AND f.addr = x.to_addr WHERE ref_type IN ('DATA', 'PARAM', 'WRITE', 'INDIRECTION', 'DATA_IND') AND function_addr <> to_addr GROUP BY ALL UNION ALL SELECT 'veneer_jump', x.source, function_addr, to_addr, min(from_addr) FROM routine_refs x JOIN routines f ON f.source = x.source AND f.addr = x.to_addr WHERE ref_type = 'COMPUTED_JUMP' AND function_addr <> to_addr GROUP BY ALL) SELECT mechanism, count(*) AS edges, count(d.source) AS direct, count(*) FILTER (abs(e.callee_addr - site) <= 32) AS near, count(*) FILTER (abs(e.callee_addr - site) > 32 AND abs(e.callee_addr - site) <= 128) AS mid, count(*) FILTER (abs(e.callee_addr - site) > 128) AS far FROM e LEFT JOIN d ON d.source = e.source AND d.caller_addr = e.caller_addr AND d.callee_addr = e.callee_addr GROUP BY mechanism", "routine_refs", "routines", "routine_calls"))
def recovery_audit(spark, d):
    x, f = shape(spark, d, "routine_refs"), shape(spark, d, "routines")
    return recovery.audit(recovery.merged([recovery.pointer_edges(x, f), recovery.veneer_edges(x, f)]), shape(spark, d, "routine_calls"))


QUALITY = "CASE WHEN said = truth THEN 'exact' WHEN contains(lower(said), lower(truth)) OR contains(lower(truth), lower(said)) THEN 'contained' WHEN len(list_intersect(x, y))::DOUBLE / greatest(len(list_distinct(x)), len(list_distinct(y))) > 0.5 THEN 'similar' ELSE 'wrong' END"
TOKENS = "list_filter(string_split(lower({}), '_'), lambda z: z <> '')"
# truth lacks every 13th name; fingerprints name a third of the functions, agents others, in every quality
BLIND = f""", f AS (SELECT source, addr, CASE WHEN addr % 3 = 0 THEN CASE WHEN addr % 4 = 0 THEN 'fn_off' ELSE 'fn_' || addr % 50 || '_' || num_params % 3 END END AS inferred, CASE WHEN addr % 13 <> 0 THEN 'fn_' || addr % 50 || '_' || num_params % 3 END AS truth,
 CASE addr % 6 WHEN 1 THEN 'fn_' || addr % 50 || '_' || num_params % 3 WHEN 2 THEN 'FN_' || addr % 50 || '_' || num_params % 3 || '_x' WHEN 4 THEN addr % 50 || '__fn_other' WHEN 3 THEN 'zzz' END AS said FROM routines),
q AS (SELECT *, inferred IS NULL AND said IS NOT NULL AS proposed, CASE WHEN inferred IS NULL AND said IS NOT NULL AND truth IS NOT NULL THEN {QUALITY} END AS quality FROM (SELECT *, {TOKENS.format('said')} AS x, {TOKENS.format('truth')} AS y FROM f)) """


@query("blind_recovery", with_shapes(BLIND + " SELECT count(*) AS total, count(truth) AS with_truth, count(inferred) AS fp_matched, count(*) FILTER (inferred = truth) AS fp_correct, count(*) FILTER (inferred <> truth) AS fp_wrong, count(*) FILTER (proposed) AS proposed, count(*) FILTER (quality = 'exact') AS exact, count(*) FILTER (quality = 'contained') AS contained, count(*) FILTER (quality = 'similar') AS similar, count(*) FILTER (quality = 'wrong') AS wrong, count(*) FILTER (coalesce(inferred = truth, false) OR coalesce(quality <> 'wrong', false)) AS combined, count(*) FILTER (inferred IS NULL AND said IS NULL) AS unnamed, round(100.0::DOUBLE * count(*) FILTER (inferred = truth) / count(inferred), 3) AS fp_precision_pct, round(100.0::DOUBLE * count(*) FILTER (coalesce(inferred = truth, false) OR coalesce(quality <> 'wrong', false)) / count(*), 3) AS combined_pct FROM q", "routines"))
def blind_recovery(spark, d):
    real = "concat('fn_', addr % 50, '_', num_params % 3)"
    f = shape(spark, d, "routines").withColumn("inferred_name", F.expr(f"CASE WHEN addr % 3 = 0 THEN CASE WHEN addr % 4 = 0 THEN 'fn_off' ELSE {real} END END"))
    truth = f.filter("addr % 13 != 0").select("source", "addr", F.expr(real).alias("name"))
    agents = f.select("source", "addr", F.expr(f"CASE addr % 6 WHEN 1 THEN {real} WHEN 2 THEN concat('FN_', addr % 50, '_', num_params % 3, '_x') WHEN 4 THEN concat(addr % 50, '__fn_other') WHEN 3 THEN 'zzz' END").alias("name"))
    return identity.blind_recovery(f, truth, agents)


KNOWN = [(0x40000000, "PERIPH"), (0x400, "kilo"), (0x5ABC, "low half"), (0x1234, "high half"), (0xABC0, "other half"), (500, "baud"), (256, "page"), (1500, "mtu")]


@query(
    "constant_scan",
    with_shapes(
        f""", k(value, name) AS (VALUES {', '.join(f"({v}::BIGINT, '{n}')" for v, n in KNOWN)}),
        l AS (SELECT id, unnest(string_split(body, chr(10))) AS text, generate_subscripts(string_split(body, chr(10)), 1)::INT - 1 AS line FROM bodies),
        v AS (SELECT DISTINCT id, line, unnest(list_concat(list_transform(regexp_extract_all(text, '\\b0[xX]([0-9a-fA-F]+)\\b', 1), lambda h: ('0x' || h)::BIGINT), list_transform(regexp_extract_all(text, '\\b([1-9][0-9]{{2,}})\\b', 1), lambda h: h::BIGINT))) AS value FROM l),
        w AS (SELECT * FROM v WHERE value >= 256),
        j AS (SELECT w.*, k.name AS exact, a.name AS lower, b.name AS upper FROM w LEFT JOIN k ON k.value = w.value LEFT JOIN k a ON a.value = w.value & 65535 AND a.value >= 256 AND w.value > 65535 LEFT JOIN k b ON b.value = (w.value >> 16) & 65535 AND b.value >= 256 AND w.value > 65535)
        SELECT id, line, value, coalesce(exact, lower, upper) AS name, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN lower IS NOT NULL THEN 'lower' ELSE 'upper' END AS kind FROM j WHERE coalesce(exact, lower, upper) IS NOT NULL""",
        "bodies",
    ),
)
def constant_scan(spark, d):
    return text.constants(shape(spark, d, "bodies"), "id", "body", spark.createDataFrame(KNOWN, "value long, name string"))


@query("annotated_bodies", with_shapes(" SELECT id, replace(replace(replace(replace(body, '0x40000000', '0x40000000 /* CR */'), '0x40000004', '0x40000004 /* SR */'), 'DAT_40000000', 'DAT_40000000 /* CR */'), 'DAT_40000004', 'DAT_40000004 /* SR */') AS body FROM bodies", "bodies"))
def annotated_bodies(spark, d):
    names = {0x40000000: "CR", 0x40000004: "SR"}
    return text.annotate(text.annotate(shape(spark, d, "bodies"), "body", names), "body", names)  # a second time changes nothing


@query("executability", with_shapes(" SELECT event_id, CASE WHEN instructions_executed >= 5 THEN 'code' WHEN has_prologue AND instructions_executed >= 3 THEN 'code' WHEN instructions_executed <= 1 AND (contains(error, 'INSN_INVALID') OR contains(error, 'FETCH_UNMAPPED')) THEN 'data' WHEN instructions_executed = 0 THEN 'data' ELSE 'uncertain' END AS classification, CASE WHEN instructions_executed >= 5 OR has_prologue AND instructions_executed >= 3 THEN true WHEN instructions_executed <= 1 AND (contains(error, 'INSN_INVALID') OR contains(error, 'FETCH_UNMAPPED')) OR instructions_executed = 0 THEN false END AS executable FROM trials", "trials"))
def executability(spark, d):
    return identity.executability(shape(spark, d, "trials")).select("event_id", "classification", "executable")


@query("claim_ledger", with_shapes(" SELECT id, verified, CASE verified WHEN true THEN 1.0 WHEN false THEN least(confidence, 0.2) ELSE confidence END::DOUBLE AS confidence FROM claims c WHERE NOT EXISTS (SELECT 1 FROM claims d WHERE d.supersedes = c.id)", "claims"))
def claim_ledger(spark, d):
    return identity.ledger(shape(spark, d, "claims")).select("id", "verified", "confidence")


# blocks end before their aliases begin; a register without a block, a block without registers, an alias of each
REGISTERS = [(8192, "UART0", "CTRL"), (8196, "UART0", "STAT"), (30000, "LONE", "ONLY")]
BLOCKS = [(8192, 8292, "UART0"), (9000, 9200, "SPI0")]


@query(
    "register_resolution",
    f"""WITH a AS (SELECT event_id, 8000 + (event_id * 37) % 26000 AS address FROM events), r(address, peripheral, register_name) AS (VALUES {', '.join(map(str, REGISTERS))}), b(lo, hi, peripheral) AS (VALUES {', '.join(map(str, BLOCKS))}),
    s(step, off, alias) AS (VALUES (0, 0, NULL), (1, 4096, 'XOR'), (2, 8192, 'SET'), (3, 12288, 'CLR')),
    h AS (SELECT event_id, a.address, step, alias, coalesce(r.peripheral, b.peripheral) AS peripheral, coalesce(register_name, '') AS register_name FROM a, s LEFT JOIN r ON r.address = a.address - off LEFT JOIN b ON a.address - off >= lo AND a.address - off < hi WHERE a.address - off >= 0 AND coalesce(r.peripheral, b.peripheral) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY step) = 1)
    SELECT a.event_id, a.address, coalesce(h.peripheral, printf('UNKNOWN_0x%08x', a.address)) AS peripheral, coalesce(register_name, '') AS register_name, alias FROM a LEFT JOIN h ON h.event_id = a.event_id""",
)
def register_resolution(spark, d):
    regs, blocks = spark.createDataFrame(REGISTERS, "address long, peripheral string, register_name string"), spark.createDataFrame(BLOCKS, "lo long, hi long, peripheral string")
    a = table(spark, d, "events").select("event_id", F.expr("8000 + (event_id * 37) % 26000").alias("address"))
    return ranges.resolve_registers(a, regs, blocks).select("event_id", "address", "peripheral", "register_name", "alias")


@query("unreferenced_strings", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unreferenced_strings(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("list_targets", with_shapes(" SELECT source, (SELECT count(*) FROM functions f WHERE f.source = s.source) AS functions, (SELECT count(*) FROM calls c WHERE c.source = s.source) AS calls, (SELECT count(*) FROM xrefs x WHERE x.source = s.source) AS xrefs FROM (SELECT DISTINCT source FROM functions) s", "functions", "calls", "xrefs"))
def list_targets(spark, d):
    out = shape(spark, d, "functions").select("source").distinct()
    for n in ("functions", "calls", "xrefs"):
        out = out.join(shape(spark, d, n).groupBy("source").agg(F.count(F.lit(1)).alias(n)), "source", "left").na.fill(0, [n])
    return out


@query("name_ilike", with_shapes(" SELECT source, addr, name FROM functions WHERE name ILIKE '%RED%' AND name NOT LIKE 'FUN!_%' ESCAPE '!' ORDER BY source, addr LIMIT 50", "functions"))
def name_ilike(spark, d):
    f = shape(spark, d, "functions").filter(F.col("name").ilike("%RED%") & ~F.expr("name LIKE 'FUN!_%' ESCAPE '!'"))
    return f.select("source", "addr", "name").orderBy("source", "addr").limit(50)


@query("tuple_in_subquery", with_shapes(" SELECT source, addr, name FROM functions WHERE (source, addr) IN (SELECT source, callee_addr FROM calls WHERE callee_addr IS NOT NULL)", "functions", "calls"))
def tuple_in_subquery(spark, d):
    c = shape(spark, d, "calls").select("source", F.col("callee_addr").alias("addr"))
    return shape(spark, d, "functions").join(c, ["source", "addr"], "left_semi").select("source", "addr", "name")


@query(
    "module_assignment",
    with_shapes(
        """, l0 AS (SELECT p_partkey AS node, p_type AS label, 1.0::DOUBLE AS weight FROM part WHERE p_size > 40), l1 AS (SELECT src AS node, label, sum(weight) * 0.5 AS weight FROM l0 JOIN tree ON dst = node GROUP BY ALL), l2 AS (SELECT src AS node, label, sum(weight) * 0.5 AS weight FROM l1 JOIN tree ON dst = node GROUP BY ALL), l3 AS (SELECT src AS node, label, sum(weight) * 0.5 AS weight FROM l2 JOIN tree ON dst = node GROUP BY ALL), s AS (SELECT node, label, sum(weight) AS w FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) GROUP BY ALL), aff AS (SELECT node, label, w / max(w) OVER (PARTITION BY node) AS affinity FROM s), seed AS (SELECT node, label AS module FROM aff QUALIFY row_number() OVER (PARTITION BY node ORDER BY affinity DESC, label) = 1),
        u AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree), votes AS (SELECT u.src AS node, module, count(*) AS n FROM u JOIN seed ON seed.node = u.dst GROUP BY ALL HAVING count(*) >= 2),
        near AS (SELECT node, module FROM votes WHERE node NOT IN (SELECT node FROM seed) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, module) = 1)
        SELECT p_partkey AS node, coalesce(seed.module, near.module, CASE WHEN p_partkey % 100 / 100.0 >= 0.8 THEN 'library' ELSE 'unknown' END) AS module, CASE WHEN seed.module IS NOT NULL THEN 'seed' WHEN near.module IS NOT NULL THEN 'neighbour' ELSE 'rest' END AS method FROM part LEFT JOIN seed ON seed.node = p_partkey LEFT JOIN near ON near.node = p_partkey""",
        "tree",
    ),
)
def module_assignment(spark, d):
    own = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("label"), F.lit(1.0).alias("weight"))
    tree = shape(spark, d, "tree")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("node"), ((F.col("p_partkey") % 100) / 100.0).alias("confidence"))
    return recovery.modules(graph.affinity(tree, own), tree, names)


def _rounds(n: int) -> str:
    """Ten rounds written out: each adds its votes to the labels held, unless a round before added under 5 % or nothing."""
    text = ", near AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h0 AS (SELECT DISTINCT src AS node, CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END AS label, 0 AS round FROM edges WHERE src % 7 = 0), go0 AS (SELECT true AS go)"
    for i in range(1, n + 1):
        h, go = f"h{i - 1}", f"go{i - 1}"
        text += f""", v{i} AS (SELECT src AS node, label, count(*) AS votes FROM near JOIN {h} ON {h}.node = dst WHERE src NOT IN (SELECT node FROM {h}) AND (SELECT go FROM {go}) GROUP BY ALL HAVING count(*) >= 2),
        n{i} AS MATERIALIZED (SELECT node, label, {i} AS round FROM v{i} QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, label) = 1),
        h{i} AS MATERIALIZED (SELECT * FROM {h} UNION ALL SELECT * FROM n{i}),
        go{i} AS MATERIALIZED (SELECT (SELECT count(*) FROM n{i}) > 0 AND (SELECT count(*) FROM n{i}) >= 0.05 * (SELECT count(*) FROM {h}) AS go)"""
    return text + f" SELECT node, label, round FROM h{n}"


@query("label_propagation", with_shapes(_rounds(10), "edges"))
def label_propagation(spark, d):
    e = shape(spark, d, "edges")
    known = e.select(F.col("src").alias("node")).distinct().filter("node % 7 = 0").withColumn("label", F.when(F.col("node") % 2 == 0, "even").otherwise("odd"))
    return graph.propagate_labels(e, known)


@query(
    "function_dossier",
    with_shapes(
        """, t AS (SELECT source, addr AS to_addr, 's' || addr AS value FROM functions WHERE addr % 3 = 0), p AS (SELECT source, function_addr AS addr, ref_type, to_addr % 4 AS register, count(*) AS accesses FROM xrefs GROUP BY ALL),
        o AS (SELECT source, caller_addr AS addr, count(DISTINCT callee_addr) AS callees FROM calls WHERE callee_addr IS NOT NULL GROUP BY ALL), i AS (SELECT source, callee_addr AS addr, count(DISTINCT caller_addr) AS callers FROM calls WHERE callee_addr IS NOT NULL GROUP BY ALL),
        r AS (SELECT source, function_addr AS addr, count(DISTINCT (ref_type, to_addr)) AS refs FROM xrefs GROUP BY ALL), st AS (SELECT x.source, function_addr AS addr, count(DISTINCT x.to_addr) AS strings, string_agg(DISTINCT value, ',' ORDER BY value) AS texts FROM xrefs x JOIN t USING (source, to_addr) GROUP BY ALL),
        pe AS (SELECT source, addr, count(*) AS registers, max(accesses) AS most FROM p GROUP BY ALL), b AS (SELECT source, function_addr AS addr, count(*) AS blocks, sum(instruction_count)::BIGINT AS instructions FROM basic_blocks GROUP BY ALL),
        both_ AS (SELECT source, to_addr FROM xrefs GROUP BY ALL HAVING count(*) FILTER (ref_type = 'READ') > 0 AND count(*) FILTER (ref_type = 'WRITE') > 0 AND to_addr < 60), sh AS (SELECT x.source, function_addr AS addr, count(DISTINCT (x.to_addr, ref_type)) AS shared FROM xrefs x JOIN both_ USING (source, to_addr) WHERE ref_type IN ('READ', 'WRITE') GROUP BY ALL)
        SELECT f.source, f.addr, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(refs, 0) AS refs, coalesce(strings, 0) AS strings, texts, coalesce(registers, 0) AS registers, most, blocks, instructions, coalesce(shared, 0) AS shared
        FROM functions f LEFT JOIN o USING (source, addr) LEFT JOIN i USING (source, addr) LEFT JOIN r USING (source, addr) LEFT JOIN st USING (source, addr) LEFT JOIN pe USING (source, addr) LEFT JOIN b USING (source, addr) LEFT JOIN sh USING (source, addr)""",
        "functions", "calls", "xrefs", "basic_blocks",
    ),
)
def function_dossier(spark, d):
    f, x = shape(spark, d, "functions"), shape(spark, d, "xrefs")
    strings = f.filter("addr % 3 = 0").select("source", "addr", F.concat(F.lit("s"), F.col("addr")).alias("value"))
    registers = x.select("source", "function_addr", F.col("ref_type").alias("peripheral"), (F.col("to_addr") % 4).cast("string").alias("register_name"))
    one = recovery.dossier(f, shape(spark, d, "calls"), x, strings, peripherals=registers, blocks=shape(spark, d, "basic_blocks"), globals_=recovery.shared_globals(x, 0, 60))
    size = lambda c, n: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(n)
    texts = F.array_join(F.array_sort(F.transform("strings", lambda s: s["value"])), ",").alias("texts")
    most = F.array_max(F.transform("peripherals", lambda p: p["accesses"])).alias("most")
    return one.select("source", "addr", size("callers", "callers"), size("callees", "callees"), size("references", "refs"), size("strings", "strings"), texts, size("peripherals", "registers"), most, "blocks", "instructions", size("shared", "shared"))


@query("implied_edges", with_shapes(" SELECT DISTINCT a.source, a.addr AS caller_addr, b.addr AS callee_addr, 'handler' AS category FROM functions a JOIN functions b ON a.source = b.source AND a.addr <> b.addr WHERE a.name LIKE 'red%' AND b.name LIKE 'blue%' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.source = a.source AND c.caller_addr = a.addr AND c.callee_addr = b.addr)", "functions", "calls"))
def implied_edges(spark, d):
    rules = spark.createDataFrame([(1, "red%", "blue%", "handler")], "rule int, caller_like string, callee_like string, category string")
    return recovery.implied_edges(shape(spark, d, "functions"), rules, shape(spark, d, "calls"))


@query("gap_categories", with_shapes(", r(node) AS (SELECT 1::BIGINT UNION SELECT t.dst FROM r JOIN tree t ON t.src = r.node) SELECT CASE WHEN starts_with(p_name, 'red') THEN 'warm' WHEN starts_with(p_name, 'blue') THEN 'cold' ELSE 'other' END AS category, count(*) AS missing FROM part WHERE p_partkey NOT IN (SELECT node FROM r) GROUP BY 1", "tree"))
def gap_categories(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    return recovery.gap_categories(nodes, shape(spark, d, "tree"), spark.createDataFrame([(1,)], "node long"), [("red", "warm"), ("blue", "cold")])


@query("round_priority", with_shapes(", g AS (SELECT src AS node, count(*) AS degree FROM edges GROUP BY src), n AS (SELECT DISTINCT src AS node FROM edges) SELECT n.node, 0.6::DOUBLE * degree / (SELECT max(degree) FROM g) + 0.4::DOUBLE * (n.node % 10 = 0)::INT AS priority FROM n JOIN g USING (node)", "edges"))
def round_priority(spark, d):
    e = shape(spark, d, "edges")
    n = e.select(F.col("src").alias("node")).distinct()
    return identity.round_priority(n, e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree")), n.filter("node % 10 = 0"))


@query("convergence", "WITH f AS (SELECT o_custkey AS addr, min(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) // 30) AS round FROM orders GROUP BY o_custkey), c AS (SELECT round, count(*) AS fresh FROM f GROUP BY round), s AS (SELECT *, (sum(fresh) OVER (ORDER BY round))::BIGINT AS named FROM c) SELECT *, fresh::DOUBLE / named AS ratio, fresh::DOUBLE / named < 0.05 AS converged FROM s")
def convergence(spark, d):
    return identity.convergence(table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.expr("CAST(datediff(o_orderdate, DATE'1990-01-01') DIV 30 AS BIGINT)").alias("round")))


# the 7-tuple of the precision comparison: distinct addresses read or taken as data, and written
SEVEN = "size, blocks, instructions, out_calls, distinct_callees, reads, writes"
COMBINED = """, y AS (SELECT source, function_addr AS addr, count(DISTINCT CASE WHEN ref_type IN ('READ', 'DATA') THEN to_addr END) AS r, count(DISTINCT CASE WHEN ref_type = 'WRITE' THEN to_addr END) AS w FROM routine_refs GROUP BY ALL),
g AS (SELECT feat.source, feat.addr, name, size, blocks, instructions, out_calls, distinct_callees, coalesce(r, 0) AS reads, coalesce(w, 0) AS writes FROM feat LEFT JOIN y USING (source, addr) WHERE size >= 16)"""
TWINS = "count(*) AS pairs, count(*) FILTER (a.name = b.name) AS same_name, 100.0::DOUBLE * count(*) FILTER (a.name = b.name) / nullif(count(*), 0) AS precision_pct FROM g a JOIN g b ON " + " AND ".join(f"a.{c} = b.{c}" for c in SEVEN.split(", ")) + " AND a.source < b.source"


def _seven(spark, d):
    x = shape(spark, d, "routine_refs")
    y = x.groupBy("source", F.col("function_addr").alias("addr")).agg(F.count_distinct(F.when(F.col("ref_type").isin("READ", "DATA"), F.col("to_addr"))).alias("r"), F.count_distinct(F.when(F.col("ref_type") == "WRITE", F.col("to_addr"))).alias("w"))
    f = routines(spark, d).filter("size >= 16").drop("reads", "writes").join(y, ["source", "addr"], "left")
    return f.withColumns({"reads": F.coalesce("r", F.lit(0)), "writes": F.coalesce("w", F.lit(0))})


@query("twin_precision", rfeat(COMBINED + " SELECT " + TWINS))
def twin_precision(spark, d):
    return ft.twin_precision(_seven(spark, d), SEVEN.split(", "))


@query("twin_precision_constants", rfeat(CONST + SETS["full"] + COMBINED + " SELECT " + TWINS + " JOIN s m ON m.source = a.source AND m.function_addr = a.addr JOIN s o ON o.source = b.source AND o.function_addr = b.addr AND o.v = m.v"))
def twin_precision_constants(spark, d):
    return ft.twin_precision(_seven(spark, d), SEVEN.split(", "), constant_sets(spark, d, "full").select("source", "addr", "members"))
