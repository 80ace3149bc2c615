"""Identity of functions: fingerprint write-back, coverage, validation, versions, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import auto_named
from .tables import sized

KEY = ["source", "addr"]


# fixed values: methods and their confidence
HASH, NAMED, UNNAMED = "body_hash_exact", "structural_8tuple_name_match", "structural_8tuple_no_name"
TIERS = {HASH: 1.0, NAMED: 0.96, UNNAMED: 0.85}
# end of fixed values


def fingerprint_tiers(features: DataFrame, columns: Sequence[str], builds: DataFrame) -> DataFrame:
    """Functions with the best name that a twin in another source of the same build gives them, its confidence, method and conflict.

    Twins agree on *columns*. Equal hashes: 1.0, and the method says whether the names agree or only the twin's is real; equal
    real names: .96; a real name on one side only: .85, to both sides. The name is null where the best twin has no real one.
    *builds*: source, build; only sources of one build are compared. Conflict: twins have more than one real name. Ties: method,
    real names first, then by name. A function meets the distinct (source, name, hash) of its signature and not each twin.
    """
    f = features.join(builds, "source")
    key = [*columns, "build"]
    sides = f.select("source", "name", "body_hash", *key).distinct()
    own, other = f.select(F.xxhash64(*key).alias("k"), *KEY, "name", "body_hash", *key).alias("f"), sides.withColumn("k", F.xxhash64(*key)).alias("t")
    same = F.col("f.k") == F.col("t.k")
    for c in key:
        same = same & (F.col(f"f.{c}") == F.col(f"t.{c}"))
    said = F.col("t.name")
    auto, auto_said = auto_named(F.col("f.name")), auto_named(said)
    agree = ~auto & ~auto_said & (F.col("f.name") == said)
    detail = F.when(agree, f"{HASH}+{NAMED}").when(auto & ~auto_said, f"{HASH}+{UNNAMED}").otherwise(HASH)
    tier = F.when(F.col("f.body_hash") == F.col("t.body_hash"), HASH).when(agree, NAMED).when(auto != auto_said, UNNAMED)
    level = F.coalesce(*(F.when(F.col("tier") == k, F.lit(v)) for k, v in TIERS.items()))
    claims = own.join(other, same & (F.col("f.source") != F.col("t.source"))).select("f.source", "f.addr", F.when(~auto_said, said).alias("claimed"), tier.alias("tier"), F.when(tier == HASH, detail).otherwise(tier).alias("method"))
    claims = claims.filter("tier is not null").withColumn("confidence", level)
    order = F.struct(-F.col("confidence"), F.col("method"), F.col("claimed").isNull(), F.col("claimed"))
    best = claims.groupBy(*KEY).agg(F.min_by(F.struct("claimed", "confidence", "method"), order).alias("b"), F.size(F.collect_set("claimed")).alias("names"))
    return best.select(*KEY, F.col("b.claimed").alias("inferred_name"), F.col("b.confidence").alias("confidence"), F.col("b.method").alias("evidence_method"), (F.col("names") > 1).alias("conflict"))


def write_back(functions: DataFrame, claims: DataFrame) -> DataFrame:
    """Functions with the enriched columns; without a claim the conflict is false and the rest null."""
    return functions.join(claims, KEY, "left").withColumn("inferred_library", F.lit(None).cast("string")).withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct keys in both, in the left only and in the right only, and the right's share that the left has."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    g = both.groupBy(*by).agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))
    return g.withColumn("covered_pct", 100.0 * F.try_divide(F.col("both").cast("double"), (F.col("both") + F.col("right_only")).cast("double")))


def name_match(truth: Column, guess: Column) -> Column:
    """exact (case counts), contained (either in the other, whatever the case), similar (over half of the larger set of tokens
    between underscores shared) or wrong; null if either is null."""
    a, b = F.lower(truth), F.lower(guess)
    tokens = lambda c: F.array_remove(F.array_distinct(F.split(c, "_")), "")
    x, y = tokens(a), tokens(b)
    share = F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y)).cast("double"))
    return F.when(truth == guess, "exact").when(a.contains(b) | b.contains(a), "contained").when(share > 0.5, "similar").when(truth.isNotNull() & guess.isNotNull(), "wrong")


def blind_recovery(functions: DataFrame, truth: DataFrame, agents: DataFrame) -> DataFrame:
    """One row over *functions* (source, addr, inferred_name), whose names *truth* (source, addr, name) has, in two halves.

    Fingerprints: fp_matched functions with an inferred name, fp_correct of them with the true one exactly, fp_wrong with
    another, the rest can't be verified; fp_precision_pct. Agents' proposals (*agents*: source, addr, name), for functions
    that no fingerprint names: proposed, and by match quality exact, contained, similar and wrong. combined: right by either,
    where all but wrong proposals are right; combined_pct of all; unnamed: named by neither.
    """
    j = functions.select(*KEY, "inferred_name").join(truth.select(*KEY, F.col("name").alias("truth")), KEY, "left").join(agents.select(*KEY, F.col("name").alias("said")), KEY, "left")
    fp, said = F.col("inferred_name").isNotNull(), F.col("inferred_name").isNull() & F.col("said").isNotNull()
    right = F.coalesce(F.col("inferred_name") == F.col("truth"), F.lit(False))
    quality = F.when(said, name_match(F.col("truth"), F.col("said")))
    n = lambda c, name: F.count_if(c).alias(name)
    either = right | F.coalesce(quality.isin("exact", "contained", "similar"), F.lit(False))
    g = j.agg(F.count(F.lit(1)).alias("total"), n(F.col("truth").isNotNull(), "with_truth"), n(fp, "fp_matched"), n(fp & right, "fp_correct"), n(fp & F.col("truth").isNotNull() & ~right, "fp_wrong"), n(said, "proposed"), *(n(quality == q, q) for q in ("exact", "contained", "similar", "wrong")), n(either, "combined"), n(~fp & ~said, "unnamed"))
    share = lambda a, b: F.round(100.0 * F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 3)
    return g.withColumn("fp_precision_pct", share("fp_correct", "fp_matched")).withColumn("combined_pct", share("combined", "total"))


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in *order*; the order must be total."""
    return log.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def ledger(contracts: DataFrame) -> DataFrame:
    """Claims that no other supersedes; verified ones have confidence 1, refuted ones 0.2 at most."""
    gone = contracts.filter("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    level = F.when(F.col("verified"), F.lit(1.0)).when(~F.col("verified"), F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence"))
    return contracts.join(gone, "id", "left_anti").withColumn("confidence", level)


def composed(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest confidence of each key, its methods joined by + in order."""
    return claims.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))


def best_name(functions: DataFrame, evidence: DataFrame, enriched: DataFrame) -> DataFrame:
    """source, addr, name, origin: evidence, else enriched, else the raw name, else FUN_<address>. The others: source, addr, name, one row each."""
    j = functions.select(*KEY, F.when(~auto_named(F.col("name")), F.col("name")).alias("raw")).join(evidence.select(*KEY, F.col("name").alias("e")), KEY, "left").join(enriched.select(*KEY, F.col("name").alias("w")), KEY, "left")
    origin = F.when(F.col("e").isNotNull(), "evidence").when(F.col("w").isNotNull(), "enriched").when(F.col("raw").isNotNull(), "raw").otherwise("address")
    return j.select(*KEY, F.coalesce("e", "w", "raw", F.format_string("FUN_%08x", "addr")).alias("name"), origin.alias("origin"))


def version_matrix(versions: DataFrame, order: Column) -> DataFrame:
    """Steps between neighbouring versions: identical, changed, added, removed. *versions*: version, addr, hash; one row a version and addr."""
    v = versions.select("version").distinct().withColumn("next", F.lead("version").over(Window.orderBy(order)))  # one row a version
    a = versions.join(sized(v.filter("next is not null")), "version").select(F.col("version").alias("from"), F.col("next").alias("to"), "addr", F.col("hash").alias("h0"))
    b = versions.join(sized(v.filter("next is not null").select(F.col("next").alias("version"), F.col("version").alias("from"))), "version").select("from", F.col("version").alias("to"), "addr", F.col("hash").alias("h1"))
    j = a.withColumn("in0", F.lit(True)).join(b.withColumn("in1", F.lit(True)), ["from", "to", "addr"], "full_outer")
    both = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    same = F.col("h0").eqNullSafe(F.col("h1"))
    return j.groupBy("from", "to").agg(F.count_if(both & same).alias("identical"), F.count_if(both & ~same).alias("changed"), F.count_if(F.col("in0").isNull()).alias("added"), F.count_if(F.col("in1").isNull()).alias("removed"))


def stable_core(versions: DataFrame) -> DataFrame:
    """Addresses that every version has with one hash."""
    n = versions.agg(F.count_distinct("version").alias("n"))
    g = versions.groupBy("addr").agg(F.count_distinct("version").alias("versions"), F.count_distinct("hash").alias("hashes"), F.min("hash").alias("hash"))
    return g.crossJoin(F.broadcast(n)).filter("versions = n and hashes = 1").select("addr", "hash")  # the other side is one row


def priority(functions: DataFrame, degree: DataFrame, frontier: DataFrame, confidence: DataFrame) -> DataFrame:
    """Candidates (no real name, confidence below .85, or conflict) by .50 percent rank of degree + .35 gap + .15 frontier."""
    j = functions.join(degree, KEY, "left").join(confidence, KEY, "left").join(frontier.select(*KEY).distinct().withColumn("front", F.lit(1.0)), KEY, "left")
    j = j.withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    j = j.withColumn("rank", F.percent_rank().over(Window.partitionBy("source").orderBy("degree")))
    j = j.filter(auto_named(F.col("name")) | (F.col("confidence") < 0.85) | F.coalesce("conflict", F.lit(False)))
    return j.select(*KEY, (0.5 * F.col("rank") + 0.35 * (1.0 - F.col("confidence")) + 0.15 * F.coalesce("front", F.lit(0.0))).alias("priority"))


def executability(t: DataFrame) -> DataFrame:
    """Verdict on each function of a trace table: code, data or uncertain, and executable true, false or null."""
    n, bad = F.col("instructions_executed"), F.col("error").contains("INSN_INVALID") | F.col("error").contains("FETCH_UNMAPPED")
    verdict = F.when(n >= 5, "code").when(F.col("has_prologue") & (n >= 3), "code").when((n <= 1) & F.coalesce(bad, F.lit(False)), "data").when(n == 0, "data").otherwise("uncertain")
    return t.withColumn("classification", verdict).withColumn("executable", F.when(verdict == "code", True).when(verdict == "data", False))


def round_priority(nodes: DataFrame, degree: DataFrame, frontier: DataFrame) -> DataFrame:
    """node, priority: .60 degree over the largest degree + .40 for the frontier."""
    j = nodes.select("node").join(degree, "node", "left").join(frontier.select("node").distinct().withColumn("front", F.lit(1.0)), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = j.agg(F.max("degree").cast("double").alias("most"))
    return j.crossJoin(F.broadcast(most)).select("node", (0.6 * F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("most")), F.lit(0.0)) + 0.4 * F.coalesce("front", F.lit(0.0))).alias("priority"))  # the other side is one row


def convergence(log: DataFrame, share: float = 0.05) -> DataFrame:
    """By round: entities first named in it, all named so far, their ratio, and whether that is under *share*. *log*: entity, round."""
    first = log.groupBy("entity").agg(F.min("round").alias("round")).groupBy("round").agg(F.count(F.lit(1)).alias("fresh"))
    named = F.sum("fresh").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0))  # one row a round
    out = first.withColumn("named", named)
    return out.withColumn("ratio", F.col("fresh").cast("double") / F.col("named")).withColumn("converged", F.col("ratio") < share)
