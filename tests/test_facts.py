"""Hand fixtures for the fact operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from factloom.catalog import Warehouse, render, split_statements
from factloom.operators import features, graph, identity, ranges, recovery, similarity, text
from factloom.sources import facts


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_reach_cycle_self_loop_and_null(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (1, 2), (4, None))
    seed = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reach(e, seed), "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.reach(e, seed, include_seeds=False), "node", "depth") == [(1, 3), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.reach(e, seed, 1), "node", "depth") == [(1, 0), (2, 1)]
    assert rows(graph.reverse_reach(e, spark.createDataFrame([(4,)], "node long"), 1), "node", "depth") == [(3, 1), (4, 0)]


def test_closure_and_counts(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (7, 7))
    assert rows(graph.closure(e), "src", "dst") == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(7, 7)]
    nodes = spark.createDataFrame([(1,), (9,)], "node long")
    assert rows(graph.reach_counts(e, nodes), "node", "direct", "reachable") == [(1, 1, 3), (9, 0, 0)]
    assert rows(graph.unreachable(e, nodes, spark.createDataFrame([(2,)], "node long")), "node") == [(9,)]


def test_affinity_counts_paths_and_normalises(spark):
    e = edges(spark, (1, 2), (2, 3))
    own = spark.createDataFrame([(3, "uart", 2.0), (1, "spi", 1.0)], "node long, label string, weight double")
    assert rows(graph.affinity(e, own), "node", "label", "affinity") == [(1, "spi", 1.0), (1, "uart", 0.5), (2, "uart", 1.0), (3, "uart", 1.0)]


def test_label_propagation_needs_two_links(spark):
    e = edges(spark, (1, 3), (2, 3), (1, 4))
    known = spark.createDataFrame([(1, "a"), (2, "a")], "node long, label string")
    assert rows(graph.propagate_labels(e, known), "node", "label", "round") == [(1, "a", 0), (2, "a", 0), (3, "a", 1)]


def functions(spark, data):
    return spark.createDataFrame(data, "source string, addr long, name string, size long, is_thunk boolean, num_params int, body_hash string")


def test_signature_drops_thunks_and_stubs(spark):
    f = functions(spark, [("a", 1, "f", 10, False, 0, "h"), ("a", 2, "t", 10, True, 0, "h"), ("a", 3, "s", 7, None, 0, "h")])
    b = spark.createDataFrame([("a", 1, 1, 3), ("a", 1, 2, 4)], "source string, function_addr long, block_addr long, instruction_count int")
    c = spark.createDataFrame([("a", 1, 5, 9), ("a", 1, 6, 9), ("a", 1, 7, None)], "source string, caller_addr long, call_site_addr long, callee_addr long")
    x = spark.createDataFrame([("a", 1, 1, 2, "READ"), ("a", 1, 1, 2, "COMPUTED_JUMP"), ("a", 1, 1, 2, "CONDITIONAL_JUMP")], "source string, function_addr long, from_addr long, to_addr long, ref_type string")
    assert rows(features.structural_signature(f, b, c, x), "addr", *features.STRICT) == [(1, 10, 2, 7, 3, 1, 1, 0, 1)]


def test_fingerprint_tiers(spark):
    f = functions(spark, [("a", 1, "alpha", 10, False, 0, "h1"), ("b", 1, "alpha", 10, False, 0, "h1"), ("a", 2, "FUN_2", 20, False, 0, "x"), ("b", 2, "beta", 20, False, 0, "y"), ("b", 3, "gamma", 20, False, 0, "z"), ("c", 2, "beta", 20, False, 0, "y"), ("a", 4, "FUNX1", 30, False, 0, "q"), ("b", 4, "FUNX1", 30, False, 0, "r")])
    builds = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "source string, build string")
    got = {r["source"] + str(r["addr"]): r for r in identity.fingerprint_tiers(f, ["size"], builds).collect()}
    assert (got["a1"]["inferred_name"], got["a1"]["confidence"], got["a1"]["evidence_method"], got["a1"]["conflict"]) == ("alpha", 1.0, "body_hash_exact+structural_8tuple_name_match", False)
    assert (got["a2"]["inferred_name"], got["a2"]["confidence"], got["a2"]["conflict"]) == ("beta", 0.85, True)
    assert got["a2"]["evidence_method"] == "structural_8tuple_no_name"
    assert got["a4"]["evidence_method"] == "structural_8tuple_name_match"  # the underscore is no wildcard
    assert "c2" not in got  # another build
    assert (got["b2"]["inferred_name"], got["b2"]["confidence"], got["b2"]["conflict"]) == (None, 0.85, False)  # its twin has no real name
    back = identity.write_back(f, identity.fingerprint_tiers(f, ["size"], builds))
    assert back.count() == 8 and back.filter("conflict is null").count() == 0


def test_sets_jaccard_and_cosine(spark):
    d = spark.createDataFrame([([], [1]), ([1, 2], [2, 3]), (None, [1]), ([1], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(1 / 3), 0.0, 1.0]
    w = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 2.0), (2, "y", 4.0), (3, "z", 1.0)], "id long, key string, w double")
    assert [(r["a"], r["b"], round(r["cosine"], 9)) for r in similarity.sparse_cosine(w).collect()] == [(1, 2, 1.0)]
    s = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("b", 9, 6), ("b", 9, 5), ("b", 8, None), ("b", 7, 5)], "source string, addr long, v long")
    assert rows(features.equal_sets(features.sets(s, "v", "m"), "m"), "a_addr", "b_addr", "n") == [(1, 9, 2)]


def test_sparse_cosine_against_brute_force_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PRODUCTS", 40)
    data = [(f"v{i}", (i * 5 + j * 3) % 17, float((i + j) % 4 - 1)) for i in range(40) for j in range(i % 6)] + [("v1", None, 1.0)]
    vec = {}
    for i, k, w in data:
        if w:
            vec.setdefault(i, {})[k] = w
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vec.items()}
    want = {(a, b): sum(vec[a][k] * vec[b][k] for k in set(vec[a]) & set(vec[b]) - {None}) / (norm[a] * norm[b]) for a in vec for b in vec if set(vec[a]) & set(vec[b]) - {None} and a != b}
    w = spark.createDataFrame(data, "id string, key int, w double")
    for asked, keep in ((None, lambda a, b: a < b), (F.col("id").endswith("3"), lambda a, b: a.endswith("3"))):
        out = similarity.sparse_cosine(w, asked)
        got = {(r["a"], r["b"]): r["cosine"] for r in out.collect()}
        assert len(got) == out.count() and got == pytest.approx({k: v for k, v in want.items() if keep(*k)})
        assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]  # products aren't shuffled


def test_cosine_dense_applies_its_threshold_before_rounding(spark, tmp_path):
    from factloom.plans import queries

    side = lambda c: [c, math.sqrt(1 - c * c)]
    data = [(0, [1.0, 0.0], 1), (1, side(0.2999997), 1), (2, side(0.3000002), 1), (3, [3.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, [1.0, 0.0], 2)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = rows(queries.cosine_dense(spark, str(tmp_path)), "a", "b", "cosine")
    assert got[:2] == [(0, 2, 0.3), (0, 3, 1.0)] and [r[1] for r in got[2:]] == [4] and math.isnan(got[2][2])  # a zero vector's NaN passes, as in SQL


def test_size_band_edges(spark):
    r = spark.createDataFrame([(100, 1)], "size long, id int")
    t = spark.createDataFrame([(49, 1), (50, 2), (200, 3), (201, 4), (0, 5)], "size long, id int")
    assert rows(similarity.size_band(r, t), "t_id") == [(2,), (3,)]


def test_pairs_of_one_bucket_are_dealt_to_many_tasks(spark):
    from factloom.operators.tables import tiled

    a = spark.range(60).selectExpr("if(id < 40, 1, if(id < 50, id, null)) as k", "id as x")
    b = spark.range(50).selectExpr("if(id < 30, 1, id) as k", "id as y")
    out = tiled(a, b, ["k"], ["x"], ["y"], tile=4, pairs=50)
    assert rows(out, "k", "x", "y") == rows(a.join(b, "k"), "k", "x", "y")
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 10 and max(per_task) < 300  # of 1,210 pairs, all but ten of one key
    sizes = spark.range(4000).selectExpr("40 as size", "id")
    assert similarity.size_band(sizes, sizes).groupBy(F.spark_partition_id()).count().count() > 1


def test_twins_of_one_signature_are_dealt_to_many_tasks(spark):
    one = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b') as source", "id as addr", "'n' as name", "9L as size")
    out = features.twins(one.union(one.selectExpr("source", "addr", "name", "null")).coalesce(1), ["name", "size"])
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 2000 * 2000 and len(per_task) > 1


def test_implied_edges_by_several_rules_and_without_calls(spark):
    f = spark.createDataFrame([("s", 1, "red one"), ("s", 2, "red blue"), ("s", 3, "blue"), ("t", 4, "blue"), (None, 5, "blue"), ("s", 1, "red one"), ("s", 6, "green")], "source string, addr long, name string")
    rules = spark.createDataFrame([(1, "red%", "%blue", "x"), (2, "red%", "blue%", "x"), (3, "%one", "%blue", "y"), (4, "green", "red%", None)], "rule int, caller_like string, callee_like string, category string")
    calls = spark.createDataFrame([("s", 2, 3), ("s", 1, None), ("t", 1, 3)], "source string, caller_addr long, callee_addr long")
    out = recovery.implied_edges(f, rules, calls)
    got = rows(out.fillna("none", "category"), "source", "caller_addr", "callee_addr", "category")
    assert got == [("s", 1, 2, "x"), ("s", 1, 2, "y"), ("s", 1, 3, "x"), ("s", 1, 3, "y"), ("s", 6, 1, "none"), ("s", 6, 2, "none")]
    # the edges meet neither the calls nor each other again
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_follow_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    from factloom.operators import tables

    def facts(name, text):
        spark.range(6000).selectExpr(*text).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    f = facts("f", ["'a' as source", "id % 600 as addr", "'n' as name", "9L as size", "false as is_thunk"]).dropDuplicates(["addr"])
    b = facts("b", ["'a' as source", "id % 600 as function_addr", "id as block_addr", "1 as instruction_count"])
    c = facts("c", ["'a' as source", "id % 600 as caller_addr", "id as call_site_addr", "id % 1200 as callee_addr"])
    x = facts("x", ["'a' as source", "id % 600 as function_addr", "id as from_addr", "id % 7 as to_addr", "if(id % 2 = 0, 'READ', 'WRITE') as ref_type"])
    monkeypatch.setattr(tables, "SPREAD", 1000)
    monkeypatch.setattr(recovery, "MET", 1000)
    out = features.structural_signature(f, b, c, x)
    assert out.rdd.getNumPartitions() == tables.portions(f, b, c, x) > 8
    assert out.count() == 600 and out.filter("blocks = 10 and out_calls = 10 and distinct_callees = 2 and reads + writes = 10 and jumps = 0").count() == 600
    flow = recovery.writer_reader_flow(x, 3)
    assert flow.groupBy(F.spark_partition_id()).count().count() > 8
    sets_ = {k: {} for k in ("READ", "WRITE")}
    for r in x.select("function_addr", "to_addr", "ref_type").distinct().collect():
        sets_[r["ref_type"]].setdefault(r["function_addr"], set()).add(r["to_addr"])
    want = [("a", w, r, len(a & b)) for w, a in sets_["WRITE"].items() for r, b in sets_["READ"].items() if w != r and len(a & b) >= 3]
    assert rows(flow, "source", "writer", "reader", "shared") == sorted(want)


def test_marked_jaccard_rounded_and_leaders(spark):
    data = [(i, [(i * 7 + j * j) % 90 for j in range(i % 5)], [f"s{i % 3}"] * (i % 3)) for i in range(30)] + [(30, None, None)]
    d = spark.createDataFrame(data, "id int, v array<int>, s array<string>")
    marks = {"v": 2, "s": 1}
    m = similarity.marked(d, marks)
    side = lambda d, s: d.toDF(*(f"{s}_{c}" for c in d.columns))
    got = side(m, "a").crossJoin(side(m, "b")).select("a_id", "b_id", *(similarity.marked_jaccard("a_", "b_", c, n).alias(c) for c, n in marks.items()))
    want = side(d, "a").crossJoin(side(d, "b")).select("a_id", "b_id", *(similarity.jaccard(F.col(f"a_{c}"), F.col(f"b_{c}")).alias(c) for c in marks))
    assert rows(got, "a_id", "b_id", *marks) == rows(want, "a_id", "b_id", *marks)
    x = [0.1234565, 0.1234575, 0.12345649999, 2.5e-7, 5e-7, -1e-9, -0.3, 1e15 / 3, 0.0, 1.0, None, math.inf] + [i / 7919 for i in range(2000)]
    d = spark.createDataFrame([(v,) for v in x], "x double")
    assert d.filter(~similarity.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6))).count() == 0
    edge = spark.createDataFrame([(0.8999999995,), (0.89999999949999,), (0.9,), (0.8999999996,)], "x double")
    assert edge.filter(similarity.rounds_up_to(F.col("x"), 9, 0.9) != (F.round("x", 9) >= 0.9)).count() == 0
    s = spark.range(3000).selectExpr("id % 7 as k", "pmod(id * 37, 101) / 10.0D as score", "id as tie").repartition(3).sortWithinPartitions("k")
    few, order = similarity.leaders(s, "k", "score", "tie", 3), [F.desc("score"), F.col("tie")]
    assert few.count() <= 3 * 3 * 7 and rows(similarity.top_k(few, ["k"], order, 3), "k", "rank", "tie") == rows(similarity.top_k(s, ["k"], order, 3), "k", "rank", "tie")


def test_weighted_score(spark):
    cols = ["size", "blocks", "out_calls", "distinct_callees", "reads", "writes", "registers", "strings", "body_hash"]

    def pairs(*rs):
        kinds = ["long"] * 6 + ["array<string>"] * 2 + ["string"]
        return spark.createDataFrame([(*a, *b) for a, b in rs], ", ".join(f"{s}_{c} {k}" for s in "rt" for c, k in zip(cols, kinds, strict=True)))

    base = (10, 3, 4, 2, 5, 5, ["a"], ["s"], "h")
    d = pairs((base, base), (base, (20, 4, 5, 2, 7, 3, [], None, None)), ((10, 3, 4, 2, 5, 5, [], [], ""), (0, 6, 4, 3, 5, 8, ["a"], [], "")), ((10, 3, 4, 2, 5, 5, [], [], ""), (10, 7, 4, 4, 5, 5, [], [], "")))
    one, two, three, four = similarity.weighted_score(d).collect()
    assert one["score"] == pytest.approx(1.0) and one["active"] == 7 and one["tier"] == "high"
    # size half, one block apart, callees alike but not calls, both accesses two apart; .47 and .5 are not active
    assert two["score"] == pytest.approx(0.15 * math.exp(-0.75) + 0.15 * 0.7 + 0.1 * 0.8 + 0.1 * 0.5) and two["active"] == 2 and two["tier"] == "medium"
    # size 0, three blocks apart, one callee apart, writes three apart, empty hashes
    assert three["score"] == pytest.approx(0.15 * 0.3 + 0.1 * 0.5) and three["active"] == 0 and three["tier"] == "low"
    assert four["score"] == pytest.approx(0.15 + 0.1 * 0.2 + 0.1) and four["active"] == 2


def test_composite_and_vectors(spark):
    v = spark.createDataFrame([(10, 1, 2, 0, 0, 3, 0, 0, '{"COPY": 3, "X": 9}', 5)], "size int, blocks int, instructions int, out_calls int, distinct_callees int, reads int, writes int, jumps int, h string, n int")
    r = v.select(features.shape_vector().alias("s"), features.frequency_vector(F.col("h"), ["COPY", "LOAD"]).alias("o")).first()
    assert r["s"] == pytest.approx([0.1, 0.2, 0, 0, 0.3, 0, 0]) and r["o"] == [3.0, 0.0]
    d = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], [3.0, 4.0], [4.0, 3.0], ["f"], ["f", "g"], [], []), ([0.0, 0.0], [1.0, 0.0], None, [1.0, 1.0], None, [], ["s"], ["s"])], "a_shape array<double>, b_shape array<double>, a_ops array<double>, b_ops array<double>, a_callees array<string>, b_callees array<string>, a_strings array<string>, b_strings array<string>")
    one, two = similarity.composite(d).collect()
    assert one["score"] == pytest.approx(0.25 * (1 + 0.96 + 0.5 + 0)) and two["score"] == pytest.approx(0.25) and two["structural"] is None
    ready = similarity.marked(d, {f"{s}_{c}": 1 for s in "ab" for c in ("callees", "strings")})
    ready = similarity.unit_columns(ready, {f"{s}_{c}": 2 for s in "ab" for c in ("shape", "ops")})
    cols = ["structural", "histogram", "callees", "strings", "score"]
    assert similarity.composite(ready, {"shape": 2, "ops": 2}, {"callees": 1, "strings": 1}).select(cols).collect() == similarity.composite(d).select(cols).collect()


@pytest.mark.parametrize(("num", "den"), [(1, 4), (1, 2), (4, 5), (1, 1)])
def test_similar_sets_against_brute_force(spark, num, den):
    import random

    r = random.Random(num)
    sets = {k: {int(30 * r.random() ** 2) for _ in range(r.choice([1, 1, 2, 3, 5, 9, 12]))} for k in range(120)}
    d = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s] + [(5, None), (None, 3)], "k int, v int")
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}
    assert {(x["a"], x["b"]): x["shared"] for x in similarity.similar_sets(d, "k", "v", num, den).collect()} == want


def test_precision_curve_and_correlation(spark):
    d = spark.createDataFrame([(0.95, True), (0.9, False), (0.2, True)], "s double, ok boolean")
    assert rows(similarity.precision_curve(d, "s", F.col("ok"), [0.9, 0.99, 0.1]), "threshold", "pairs", "correct") == [(0.1, 3, 2), (0.9, 2, 1), (0.99, 0, 0)]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert similarity.correlation(flat, "x", "y").first()[0] is None


def test_range_join_both_ways(spark, monkeypatch):
    p = spark.createDataFrame([(0,), (10,), (19,), (20,), (5000,), (-1,)], "addr long")
    r = spark.createDataFrame([(10, 20, "a"), (4000, 9000, "b")], "lo long, hi long, name string")
    want = [(-1, None), (0, None), (10, "a"), (19, "a"), (20, None), (5000, "b")]
    get = lambda: sorted((x["addr"], x["name"]) for x in ranges.range_join(p, r, how="left").collect())
    assert get() == want
    monkeypatch.setattr(ranges, "DOZENS", 0)
    assert get() == want


def test_owner_tolerance(spark):
    p = spark.createDataFrame([("a", 5), ("a", 10), ("a", 365), ("a", 366), ("b", 10)], "source string, at long")
    s = spark.createDataFrame([("a", 10, 100)], "source string, addr long, size long")
    assert rows(ranges.owner_asof(p, s), "source", "at", "owner")[0:4] == [("a", 5, None), ("a", 10, 10), ("a", 365, 10), ("a", 366, None)]


def test_register_resolution_alias(spark):
    a = spark.createDataFrame([(0x100,), (0x108,), (0x2100,), (0x3108,), (0x9999,), (None,)], "address long")
    regs = spark.createDataFrame([(0x100, "P", "CTRL")], "address long, peripheral string, register_name string")
    blocks = spark.createDataFrame([(0x100, 0x200, "P")], "lo long, hi long, peripheral string")
    got = ranges.resolve_registers(a, regs, blocks)
    assert sorted(((x["address"], x["alias"]) for x in got.filter("alias is not null").collect())) == [(0x2100, "SET"), (0x3108, "CLR")]
    assert sorted(((x["address"], x["peripheral"], x["register_name"]) for x in got.collect()), key=lambda x: (x[0] is None, x)) == [(0x100, "P", "CTRL"), (0x108, "P", ""), (0x2100, "P", "CTRL"), (0x3108, "P", ""), (0x9999, "UNKNOWN_0x00009999", ""), (None, None, "")]


def test_recovery(spark):
    f = functions(spark, [("a", 0x100, "reg", 16, False, 4, ""), ("a", 0x200, "main", 64, False, 0, ""), ("a", 0x300, "cb", 16, False, 3, "")])
    calls = spark.createDataFrame([("a", 0x200, 0x204, 0x100), ("a", 0x200, 0x208, 0x100), ("a", 0x200, 0x20C, None)], "source string, caller_addr long, call_site_addr long, callee_addr long")
    x = spark.createDataFrame([("a", 0x200, 0x210, 0x300, "DATA"), ("a", 0x200, 0x214, 0x200, "DATA"), ("a", 0x300, 0x304, 0x100, "COMPUTED_JUMP"), ("a", 0x300, 0x308, 0x300, "COMPUTED_JUMP"), ("a", 0x200, 0x218, 0x100, "WRITE"), ("a", 0x100, 0x10C, 0x300, "READ")], "source string, function_addr long, from_addr long, to_addr long, ref_type string")
    slots = spark.createDataFrame([("a", 1, 0x101), ("a", 2, 0x205), ("a", 3, 0x901), ("a", 0, 0x777)], "source string, slot int, word long")
    words = spark.createDataFrame([("a", 0x220, 0x301), ("a", 0x224, 0x300), ("a", 0x222, 0x300)], "source string, addr long, word long")
    got = rows(recovery.recover_calls(f, calls, x, slots, words), "mechanism", "callee_addr", "confidence")
    assert got == [("binary_const", 0x300, 0.5), ("func_ptr_ref", 0x100, 0.7), ("func_ptr_ref", 0x300, 0.7), ("registrar_dispatch", 0x300, 0.6), ("vector_table", 0x100, 1.0), ("vector_table", 0x204, 0.9), ("vector_table", 0x900, 0.85), ("veneer_jump", 0x100, 0.95)]


def phases(acc, gap=100, span=8, infra=()):
    """Boundaries and both merges over one function's (place, category) in order, in plain Python."""
    from collections import Counter

    def top(xs):
        own = Counter(c for _, c in xs if c not in infra) or Counter(c for _, c in xs)
        return own.most_common(1)[0][0]

    n, cuts = len(acc), {0}
    cuts |= {i for i in range(1, n) if acc[i][0] - acc[i - 1][0] > gap}
    for i in range(span, n - span):
        own = Counter(c for _, c in acc[i : i + span] if c not in infra)
        if top(acc[i - span : i]) != top(acc[i : i + span]) and own and own.most_common(1)[0][1] >= 3:
            cuts.add(i)
    at = sorted(cuts)
    parts = [acc[a:b] for a, b in zip(at, [*at[1:], n], strict=True)]
    for join in (lambda p, x: sum(c not in infra for _, c in x) < 3, lambda p, x: top(p) == top(x)):
        out = []
        for x in parts:
            if out and join(out[-1], x):
                out[-1] = out[-1] + x
            else:
                out.append(x)
        parts = out
    return at, [(i, p[0][0], p[-1][0], len(p), top(p)) for i, p in enumerate(parts)]


@pytest.mark.parametrize("seed", range(4))
def test_segments_against_plain_python(spark, seed):
    import random

    r = random.Random(seed)
    acc, rows_ = {}, []
    for f in ("f", "g", "h"):
        at, mine = 0, []
        for _ in range(r.choice([1, 5, 60, 90])):
            kind = r.choice(["uart", "spi", "RCC"])
            for _ in range(r.choice([1, 2, 9, 12])):
                at += r.choice([4, 4, 4, 150])
                mine.append((at, kind if r.random() < 0.8 else r.choice(["uart", "gpio", "RCC"])))
        acc[f] = mine
        rows_ += [(f, *x) for x in mine]
    d = spark.createDataFrame(rows_, "fn string, place long, cat string")
    cut = text.boundaries(d, ["fn"], "place", "cat", infra=["RCC"])
    got = text.segments(d, ["fn"], "place", "cat", infra=["RCC"]).collect()
    for f, mine in acc.items():
        at, want = phases(mine, infra={"RCC"})
        assert cut.filter(F.col("fn") == f).agg(F.max("segment")).first()[0] == len(at) - 1
        assert sorted(tuple(x[1:]) for x in got if x["fn"] == f) == want
    assert text.segments(d.limit(0), ["fn"], "place", "cat").count() == 0


def test_label_propagation_against_plain_python(spark):
    import random
    from collections import Counter

    r = random.Random(3)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(140)}
    near = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    held = {i: ("x" if i % 2 else "y", 0) for i in range(0, 60, 7)}
    want = dict(held)
    for i in range(1, 11):
        fresh = {}
        for n in {a for a, _ in near} - want.keys():
            votes = [(-c, lab) for lab, c in Counter(want[b][0] for a, b in near if a == n and b in want).items() if c >= 2]
            if votes:
                fresh[n] = (min(votes)[1], i)
        before = len(want)
        want |= fresh
        if not fresh or len(fresh) < 0.05 * before:
            break
    e = spark.createDataFrame([*edges, (None, 1)], "src int, dst int")
    k = spark.createDataFrame([(n, lab) for n, (lab, _) in held.items()], "node int, label string")
    assert {x["node"]: (x["label"], x["round"]) for x in graph.propagate_labels(e, k).collect()} == want


def test_carried_and_ranks_over_many_parts(spark):
    import random

    r = random.Random(1)
    data = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.choice([None, None, None, i])) for i in range(3000)]
    d = spark.createDataFrame(data, "k string, i long, v long").repartition(7)
    want, last = {}, {}
    for k, i, v in data:
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert {x["i"]: x["v"] for x in ranges.carried(d, ["k"], ["i"], ["v"]).collect()} == want
    assert {x["i"]: x["rank"] for x in ranges.ranks(d, ["i"]).collect()} == {i: i for i in range(3000)}
    assert ranges.carried(d.limit(0), ["k"], ["i"], ["v"]).count() == 0 and ranges.ranks(d.limit(0), ["i"]).count() == 0


def test_regions_and_constant_sets(spark):
    a = spark.createDataFrame([(0x20000000,), (0x2FFFFFFF,), (0x30000000,), (0x40000000,), (0x5FFFFFFF,), (0x60000000,), (0xE0000000,), (0x1_0000_0000,), (None,)], "a long")
    assert [x[0] for x in a.select(recovery.region(F.col("a"))).collect()] == ["sram", "sram", "other", "peripheral", "peripheral", "other", "system", "system", "other"]
    f = functions(spark, [("a", 0x100, "f", 16, False, 0, ""), ("b", 0x200, "g", 16, False, 0, ""), ("b", 0x300, "t", 8, False, 0, "")])
    x = spark.createDataFrame([(s, fn, fn + 4 * i, fn + 8 * i if rel else 0x40000000 + i, "READ") for s, fn, rel in [("a", 0x100, True), ("b", 0x200, True), ("b", 0x300, True), ("a", 0x100, False)] for i in range(1, 4)], "source string, function_addr long, from_addr long, to_addr long, ref_type string")
    assert features.constant_sets(x, f, "peripheral").count() == 1 and features.constant_sets(x, f).count() == 2
    assert features.equal_sets(features.constant_sets(x.filter("to_addr < 4096"), f, "relative"), "members").count() == 1


def test_executability_and_name_match(spark):
    t = spark.createDataFrame([(5, False, None), (3, True, None), (1, False, "UC_ERR_FETCH_UNMAPPED"), (1, False, "UC_ERR_INSN_INVALID"), (1, False, None), (0, False, None), (2, False, "UC_ERR_FETCH_UNMAPPED")], "instructions_executed int, has_prologue boolean, error string")
    assert [x["classification"] for x in identity.executability(t).collect()] == ["code", "code", "data", "data", "uncertain", "data", "uncertain"]
    n = spark.createDataFrame([("main", "main"), ("main", "Main"), ("a_b_c", "c_b_x_a"), ("a_b", "a_c"), ("__x_y", "y_x"), ("x", None)], "t string, g string")
    assert [x[0] for x in n.select(identity.name_match(F.col("t"), F.col("g"))).collect()] == ["exact", "contained", "similar", "wrong", "similar", None]


def test_text_operators(spark):
    d = spark.createDataFrame([(1, "x = 0x20000000;\ny = -0x100; z = 500; w = 12;"), (2, "DAT_40000000 + 0x40000000 /* P */"), (3, None), (4, "0xABCD01F4 0x01F40001 0x1F40 0x00AB01FF")], "id long, body string")
    known = spark.createDataFrame([(0x20000000, "SRAM"), (500, "baud")], "value long, name string")
    assert rows(text.constants(d, "id", "body", known), "id", "line", "name", "kind") == [(1, 0, "SRAM", "exact"), (1, 1, "baud", "exact"), (4, 0, "baud", "lower"), (4, 0, "baud", "upper")]
    once = text.annotate(d, "body", {0x40000000: "P"})
    assert once.filter("id = 2").first()["body"] == "DAT_40000000 /* P */ + 0x40000000 /* P */"
    assert text.annotate(once, "body", {0x40000000: "P"}).filter("id = 2").first()["body"] == once.filter("id = 2").first()["body"]


def test_coverage_ledger_and_versions(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "addr long, name string")
    b = spark.createDataFrame([(1,), (3,)], "addr long")
    r = identity.coverage(a, b, ["addr"]).first()
    assert (r["both"], r["left_only"], r["right_only"], r["covered_pct"]) == (1, 1, 1, 50.0)
    c = spark.createDataFrame([(1, None, 0.5, None), (2, True, 0.5, 1), (3, False, 0.5, None), (4, None, 0.4, None)], "id long, verified boolean, confidence double, supersedes long")
    assert rows(identity.ledger(c), "id", "confidence") == [(2, 1.0), (3, 0.2), (4, 0.4)]
    v = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 10, "a"), (2, 11, "c"), (2, 12, "d")], "version int, addr long, hash string")
    assert rows(identity.version_matrix(v, F.col("version")), "identical", "changed", "added", "removed") == [(1, 1, 1, 0)]
    assert rows(identity.stable_core(v), "addr", "hash") == [(10, "a")]


def test_sources(spark, tmp_path):
    p = tmp_path / "f.jsonl"
    p.write_text('{"addr": 4294967295, "pcode_ops_total": 3, "pcode_histogram": {"b": 2, "a": 1}}\n\n')
    r = facts.read_jsonl(spark, str(p), "pcode_features", "t").first()
    assert (r["addr"], json.loads(r["pcode_histogram"]), r["source"]) == (4294967295, {"a": 1, "b": 2}, "t")
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"name": "x"}\n')
    with pytest.raises(Exception, match="addr is missing"):
        facts.read_jsonl(spark, str(bad), "functions", "t").collect()
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"addr": \n')
    with pytest.raises(Exception):  # noqa: B017
        facts.read_jsonl(spark, str(broken), "functions", "t").collect()
    s = tmp_path / "syms"
    s.write_text("00000100 T main\n00000200 00000010 t helper\n00000300 D data\nfoo bar\n")
    assert rows(facts.read_symbols(spark, str(s), "t"), "addr", "name", "bind") == [(0x100, "main", "global"), (0x200, "helper", "local")]
    t = tmp_path / "trace"
    t.write_text("MemoryIORead with address 0x40000000, value 0x1\n0x100: 0xBF00\nnoise\nMemoryIOWrite with address 0x40000004, value 0xFF\n")
    assert [tuple(r) for r in facts.read_trace(spark, str(t), "t", "boot").orderBy("sequence_idx").select("sequence_idx", "pc", "address", "value", "direction").collect()] == [(0, None, 0x40000000, 1, "read"), (1, 0x100, 0x40000004, 255, "write")]
    x = tmp_path / "m.svd"
    x.write_text('<device><peripherals><peripheral><name>U0</name><baseAddress>0x40000000</baseAddress><addressBlock><size>0x400</size></addressBlock><registers><register><name>CR</name><addressOffset>0x4</addressOffset></register></registers></peripheral><peripheral derivedFrom="U0"><name>U1</name><baseAddress>0x40001000</baseAddress></peripheral></peripherals></device>')
    m = {r["name"]: r for r in facts.read_register_map(spark, str(x)).collect()}
    assert m["U1"]["size"] == 0x400 and m["U1"]["registers"][0]["offset"] == 4 and m["U0"]["base"] == 0x40000000
    w = tmp_path / "img.bin"
    w.write_bytes(b"\x01\x01\x00\x00\xff\xff\xff\xff\x00")
    assert rows(facts.read_words(spark, str(w), 0x8000), "addr", "word") == [(0x8000, 0x101), (0x8004, 0xFFFFFFFF)]
    facts.write_tsv(spark.createDataFrame([(1, 2)], "a long, b long"), str(tmp_path / "tsv"))
    assert rows(facts.read_tsv(spark, str(tmp_path / "tsv"), "a long, b long"), "a", "b") == [(1, 2)]


def test_sqlite_relations_and_report(spark, tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "e.db")
    db.execute("CREATE TABLE evidence_log (id INTEGER, name TEXT, confidence REAL, supersedes_id INTEGER)")
    db.executemany("INSERT INTO evidence_log VALUES (?, ?, ?, ?)", [(1, "a", 0.5, None), (2, None, 1.0, 1)])
    db.commit()
    db.close()
    got = facts.read_sqlite(spark, str(tmp_path / "e.db"), "evidence_log", "id long, name string, confidence double, supersedes_id long")
    assert sorted(got.collect()) == [(1, "a", 0.5, None), (2, None, 1.0, 1)]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 2), (4, 3), (5, 2), (5, 3), (6, None)], "src int, dst int")
    f = spark.createDataFrame([(i, "main" if i == 1 else f"f{i}") for i in range(1, 8)], "node int, name string")
    r = graph.reach_report(e, f, spark.createDataFrame([(4,)], "node int"), least=2)
    assert list(r) == ["reaches", "reach_count", "orchestrators", "unreachable_from_main", "subsystem_pairs", "truly_unreachable"]
    assert rows(r["unreachable_from_main"], "node") == [(4,), (5,), (6,), (7,)] and rows(r["truly_unreachable"], "node") == [(5,), (6,), (7,)]
    assert rows(r["subsystem_pairs"], "name_a", "name_b", "shared") == [("f4", "f5", 2)] and r["reaches"].count() == 15
    facts.write_relations({k: r[k] for k in ("subsystem_pairs", "reach_count")}, str(tmp_path / "out"))
    assert rows(facts.read_tsv(spark, str(tmp_path / "out" / "subsystem_pairs"), "a string, b string, n int"), "a", "b", "n") == [("f4", "f5", 2)]
    m = spark.createDataFrame([(1, "high"), (2, "low"), (3, "low")], "id int, tier string")
    facts.write_json_report(m, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "summary")).first()["tiers"].asDict() == {"high": 1, "low": 2} and spark.read.json(str(tmp_path / "json" / "matches")).count() == 3
    t = spark.createDataFrame([(70000, "<a|b>")], "n int, s string")
    assert render(t, style="html") == "<table><tr><th>n</th><th>s</th></tr><tr><td>0x00011170</td><td>&lt;a|b&gt;</td></tr></table>"
    assert render(t, style="text").splitlines()[1] == "0x00011170  <a|b>" and "<a\\|b>" in render(t)
    assert Warehouse(spark, "x").sql("SELECT ? + 1 AS a", 4).first()[0] == 5 and Warehouse(spark, "x").sql("SELECT :v AS a", v="q").first()[0] == "q"


def test_warehouse(spark, tmp_path):
    for t, extra in (("t1", ""), ("t2", ", 5 AS extra")):
        (tmp_path / t / "tables").mkdir(parents=True)
        spark.sql(f"SELECT '{t}' AS source, 1L AS addr, 'main_{t}' AS name, 70000L AS size{extra}").coalesce(1).write.parquet(str(tmp_path / t / "tables" / "functions.parquet"))
    w = Warehouse(spark, str(tmp_path))
    assert w.register("t1") == ["functions"]
    assert spark.table("functions").count() == 1 and spark.table("functions_all").count() == 2
    assert rows(w.find_functions("MAIN"), "source") == [("t1",), ("t2",)]
    out = list(w.run_script("SELECT 1 AS a; SELECT nope; -- c;\nSELECT ';' AS b"))
    assert [r.error is None for r in out] == [True, False, True]
    assert split_statements("a 'x;y' ; ; b") == ["a 'x;y'", "b"]
    assert "0x00011170" in render(w.table("functions", "t1"))
    w.save(spark.createDataFrame([("t1", 1, 2), ("t2", 1, 3)], "source string, caller_addr long, callee_addr long"), "calls")
    assert set(w.tables()) == {"functions", "calls"} and w.table("calls", "t1").count() == 1
    w.save(spark.createDataFrame([("7", 9, "new", 5)], "source string, addr long, name string, size long"), "functions")
    assert rows(w.table("functions"), "source") == [("7",), ("t1",), ("t2",)]
    info = w.function_info("t1", 1).first()
    assert info["callees"] == [2] and info["callers"] == [] and info["strings"] == []
    assert w.topics("Who calls the largest functions?") == ["calls", "size"] and w.topics("hm") == ["overview"]
    assert set(w.analyze("t1", "calls and strings")) == {"calls"} and "## size" in w.report("t1")
    assert Warehouse(spark, str(tmp_path / "empty")).list_targets().count() == 0


def test_streamed_trace_equals_batch(spark, tmp_path):
    from factloom.streaming import trace_stream as ts

    schema = "source string, scenario string, line long, pc long, direction string, address long, io_value long"
    one = spark.createDataFrame([("s", "boot", 2, None, "read", 8, 1), ("s", "boot", 1, 100, None, None, None)], schema)
    two = spark.createDataFrame([("s", "boot", 3, None, "write", 9, 2)], schema)
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    two.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = ts.run_once(ts.access_stream(ts.read_stream(spark, str(tmp_path / "in"), one.schema)), "acc", str(tmp_path / "ck"))
    assert rows(got, "sequence_idx", "pc", "address") == [(0, 100, 8), (1, 100, 9)]


def test_streams_resume_window_and_drop_repeats(spark, tmp_path):
    """Append sink that goes on from its checkpoint (new files only), late rows, repeats within the watermark, latest per key."""
    from factloom.streaming import trace_stream as ts

    schema = "k string, ts timestamp, value double, confidence double"
    at = lambda h: f"2024-01-01 {h:02d}:10:00"

    def put(name, data):
        spark.createDataFrame(data, "k string, ts string, value double, confidence double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    put("in", [("a", at(1), 1.0, 0.5), ("a", at(1), 2.0, 0.9), ("b", at(2), 3.0, 0.1)])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for n in (3, 4):
        ts.to_parquet(ts.read_stream(spark, str(tmp_path / "in"), schema), out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == n
        put("in", [("a", at(9), 4.0, 0.2)])
    best = identity.latest(spark.read.parquet(out), ["k"], [F.desc("confidence"), F.col("ts")])
    assert rows(best, "k", "confidence") == [("a", 0.9), ("b", 0.1)]
    batch = spark.read.parquet(out)
    assert rows(ts.windowed(batch, "ts", "1 hour", ["k"]), "k", "n", "total") == [("a", 1, 4.0), ("a", 2, 3.0), ("b", 1, 3.0)]
    assert rows(ts.sessions(batch, "ts", "3 hours", ["k"]), "k", "n") == [("a", 1), ("a", 2), ("b", 1)]
    once = ts.run_once(ts.first_seen(ts.read_stream(spark, out, schema), "ts", ["k"]), "once", str(tmp_path / "ck2"))
    assert once.filter("k = 'b'").count() == 1 and once.filter("k = 'a'").count() <= 2


def test_entry_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copytree(f"{ROOT}/factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reach_set' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
