"""Recovered call edges and what references say about peripherals, state and data flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import owner_asof
from .tables import fixed, sized, spread, tiled

#: Meetings of a writer and a reader at an address that one task of writer_reader_flow() counts, about; rows of a side that one joins.
MET = 1_000_000

EDGE = ["source", "caller_addr", "callee_addr", "call_site_addr", "mechanism", "confidence"]


def vector_edges(slots: DataFrame, functions: DataFrame) -> DataFrame:
    """Handlers in vector slots 1 to 256 (source, slot, word; bit 0 marks Thumb): entry 1.0, inside a function .9, in a gap .85."""
    s = slots.filter(F.col("slot").between(1, 256) & (F.col("word") != 0)).select("source", F.col("word").bitwiseAND(F.lit(~1)).alias("at")).distinct()
    own = owner_asof(s, functions.select("source", "addr", "size"), tolerance=0)
    level = F.when(F.col("owner") == F.col("at"), 1.0).when(F.col("owner").isNotNull(), 0.9).otherwise(0.85)
    none = F.lit(None).cast("long")
    return own.select("source", none.alias("caller_addr"), F.col("at").alias("callee_addr"), none.alias("call_site_addr"), F.lit("vector_table").alias("mechanism"), level.alias("confidence"))


def default_handlers(slots: DataFrame, least: int = 3) -> DataFrame:
    """source, handler, slots: the address that most slots of a vector table (source, slot from 1 on, word) hold, if *least* or more do;
    of equally common ones the one that comes first."""
    g = slots.filter("slot >= 1 and word != 0").groupBy("source", F.col("word").bitwiseAND(F.lit(~1)).alias("handler")).agg(F.count(F.lit(1)).alias("slots"), F.min("slot").alias("first"))
    best = g.groupBy("source").agg(F.min_by(F.struct("handler", "slots"), F.struct(-F.col("slots"), F.col("first"), F.col("handler"))).alias("b"))
    return best.select("source", "b.handler", "b.slots").filter(F.col("slots") >= least)


def pointer_edges(xrefs: DataFrame, functions: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Data references to entries: .7 for known functions, .55 for discovered addresses; a function's own entry is no target."""
    t = functions.select("source", F.col("addr").alias("to_addr"), F.lit(0.7).alias("confidence"))
    if discovered is not None:
        t = t.union(discovered.select("source", F.col("addr").alias("to_addr"), F.lit(0.55))).groupBy("source", "to_addr").agg(F.max("confidence").alias("confidence"))
    x = xrefs.filter(F.col("ref_type").isin("DATA", "PARAM", "WRITE", "INDIRECTION", "DATA_IND")).filter("function_addr != to_addr")
    return x.join(t, ["source", "to_addr"]).select("source", F.col("function_addr").alias("caller_addr"), F.col("to_addr").alias("callee_addr"), F.col("from_addr").alias("call_site_addr"), F.lit("func_ptr_ref").alias("mechanism"), "confidence")


def veneer_edges(xrefs: DataFrame, functions: DataFrame) -> DataFrame:
    """Computed jumps to entries, .95; a function's own entry is no target."""
    t = functions.select("source", F.col("addr").alias("to_addr"))
    return xrefs.filter("ref_type = 'COMPUTED_JUMP' and function_addr != to_addr").join(t, ["source", "to_addr"], "left_semi").select("source", F.col("function_addr").alias("caller_addr"), F.col("to_addr").alias("callee_addr"), F.col("from_addr").alias("call_site_addr"), F.lit("veneer_jump").alias("mechanism"), F.lit(0.95).alias("confidence"))


def constant_edges(words: DataFrame, functions: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Aligned words equal to an entry, with or without the Thumb bit; .5, or .35 if only discovered; first by address of each (owner, target)."""
    t = functions.select("source", F.col("addr").alias("target"), F.lit(0.5).alias("confidence"))
    if discovered is not None:
        t = t.union(discovered.select("source", F.col("addr").alias("target"), F.lit(0.35))).groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    w = words.filter("addr % 4 = 0").select("source", F.col("addr").alias("at"), F.col("word").bitwiseAND(F.lit(~1)).alias("target"))
    own = owner_asof(w.join(t, ["source", "target"]), functions.select("source", "addr", "size")).filter("owner is not null and owner != target and at != target")
    g = own.groupBy("source", "owner", "target").agg(F.min("at").alias("at"), F.max("confidence").alias("confidence"))
    return g.select("source", F.col("owner").alias("caller_addr"), F.col("target").alias("callee_addr"), F.col("at").alias("call_site_addr"), F.lit("binary_const").alias("mechanism"), "confidence")


# fixed values: name parts of functions that register callbacks
REGISTRARS = ("xtaskcreate", "xtimercreate", "xtimergenericcommand", "xcallbackregister", "set_exclusive_handler", "set_handler", "add_repeating_timer", "add_alarm", "register_callback", "create_task", "create_timer", "install_handler", "add_at_time_worker", "add_when_pending_worker")
# end of fixed values


def registrar_edges(calls: DataFrame, refs: DataFrame, functions: DataFrame, names: Sequence[str] = REGISTRARS, params: int = 4, callers: int = 2) -> DataFrame:
    """C -> B where A refers to B as data and calls C, and C, called from *callers* sites or more, takes *params* or more parameters or
    has one of *names* in its name, in either case."""
    direct = calls.filter("callee_addr is not null").select("source", F.col("caller_addr").alias("a"), F.col("callee_addr").alias("c")).distinct()
    used = calls.filter("callee_addr is not null").groupBy("source", F.col("callee_addr").alias("c")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= callers)
    able = F.col("num_params") >= params
    for n in names:
        able = able | F.lower("name").contains(n.lower())
    able = functions.filter(able).select("source", F.col("addr").alias("c"))
    registrar = able.join(used, ["source", "c"], "left_semi")
    held = refs.select("source", F.col("function_addr").alias("a"), F.col("to_addr").alias("b")).join(functions.select("source", F.col("addr").alias("b")), ["source", "b"], "left_semi").distinct()
    hit = direct.join(registrar, ["source", "c"], "left_semi").join(held, ["source", "a"]).filter("b != a and b != c")
    none = F.lit(None).cast("long")
    return hit.select("source", F.col("c").alias("caller_addr"), F.col("b").alias("callee_addr"), none.alias("call_site_addr"), F.lit("registrar_dispatch").alias("mechanism"), F.lit(0.6).alias("confidence")).distinct()


def merged(edges: Sequence[DataFrame]) -> DataFrame:
    """All mechanisms' edges, one for each (source, caller, callee, mechanism): the most confident, then the first site."""
    out = edges[0].select(*EDGE)
    for e in edges[1:]:
        out = out.unionByName(e.select(*EDGE))
    return out.groupBy("source", "caller_addr", "callee_addr", "mechanism").agg(F.max("confidence").alias("confidence"), F.min_by("call_site_addr", F.struct(-F.col("confidence"), F.col("call_site_addr"))).alias("call_site_addr")).select(*EDGE)


def recover_calls(functions: DataFrame, calls: DataFrame, xrefs: DataFrame, slots: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """All mechanisms in order; what the vector table discovers is a target of those after it."""
    edges, found = [], None
    if slots is not None:
        edges.append(vector_edges(slots, functions))
        found = edges[0].filter("confidence < 1").select("source", F.col("callee_addr").alias("addr")).distinct()
    edges += [pointer_edges(xrefs, functions, found), veneer_edges(xrefs, functions)]
    if words is not None:
        edges.append(constant_edges(words, functions, found))
    edges.append(registrar_edges(calls, xrefs.filter("ref_type in ('DATA', 'PARAM')"), functions))
    return merged(edges)


def audit(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """By mechanism: edges, those that direct calls have too, and distance bands of site and target; without a site it is in no band."""
    direct = calls.filter("callee_addr is not null").select("source", "caller_addr", "callee_addr").distinct().withColumn("d", F.lit(1))
    far = F.abs(F.col("callee_addr") - F.col("call_site_addr"))
    j = edges.join(direct, ["source", "caller_addr", "callee_addr"], "left")
    return j.groupBy("mechanism").agg(F.count(F.lit(1)).alias("edges"), F.count("d").alias("direct"), F.count_if(far <= 32).alias("near"), F.count_if((far > 32) & (far <= 128)).alias("mid"), F.count_if(far > 128).alias("far"))


def region(addr: Column) -> Column:
    """peripheral, system, sram or other; a null address is in none and gives other."""
    # fixed values: address regions of the chips
    peripheral, system, sram = (0x40000000, 0x5FFFFFFF), 0xE0000000, (0x20000000, 0x2FFFFFFF)
    # end of fixed values
    return F.when(addr.between(*peripheral), "peripheral").when(addr >= system, "system").when(addr.between(*sram), "sram").otherwise("other")


def prefix_group(name: Column, prefixes: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The group of the first prefix, in the given order, that *name* starts with."""
    out = F.lit(None).cast("string")
    for p, g in prefixes:
        out = F.coalesce(out, F.when(name.startswith(p), F.lit(g)))
    return F.coalesce(out, F.lit(default))


def peripheral_profile(x: DataFrame, least: int = 1) -> DataFrame:
    """By function: accesses, ordered peripherals and groups; functions of *least* groups or more."""
    g = x.groupBy("source", "function_addr").agg(F.count(F.lit(1)).alias("accesses"), F.array_sort(F.collect_set("peripheral")).alias("peripherals"), F.count_distinct("peripheral_group").alias("groups"))
    return g.filter(F.col("groups") >= least)


def offset_map(x: DataFrame, base: int, end: int) -> DataFrame:
    """Reads, writes and functions of each offset in [base, end)."""
    inside = x.filter((F.col("to_addr") >= base) & (F.col("to_addr") < end))
    g = inside.groupBy("source", (F.col("to_addr") - base).alias("offset")).agg(F.count_if(F.col("ref_type") == "READ").alias("reads"), F.count_if(F.col("ref_type") == "WRITE").alias("writes"), F.count_distinct("function_addr").alias("functions"))
    return g.withColumn("label", F.format_string("0x%03X", "offset"))


def writer_reader_flow(x: DataFrame, least: int = 1) -> DataFrame:
    """Pairs writer, reader of two functions with the number of addresses one writes and the other reads, *least* or more.

    Functions that write, or read, fewer addresses than that are in no pair and don't reach the join. The number of tasks follows
    the counted meetings at an address, so that none has to hold more than some MET of them.
    """
    kind = x.filter("ref_type in ('READ', 'WRITE') and source is not null and to_addr is not null").select("source", "to_addr", "function_addr", "ref_type")
    kind = spread(kind, "source", "function_addr").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("source", "function_addr", "ref_type"))
    kind = fixed(kind if least < 2 else kind.withColumn("n", n).filter(F.col("n") >= least).drop("n"))
    w = kind.filter("ref_type = 'WRITE'").select("source", "to_addr", F.col("function_addr").alias("writer"))
    r = kind.filter("ref_type = 'READ'").select("source", "to_addr", F.col("function_addr").alias("reader"))
    key = ["source", "to_addr"]
    counts = kind.groupBy(*key).agg(F.count_if(F.col("ref_type") == "WRITE").cast("double").alias("w"), F.count_if(F.col("ref_type") == "READ").alias("r"))
    met, rows = counts.agg(F.sum(F.col("w") * F.col("r")), F.sum(F.col("w") + F.col("r"))).first()
    parts, sides = (max(1, min(20_000, -int(-(v or 0.0) // MET))) for v in (met, rows))
    pairs = w.repartition(sides, *key).join(r.repartition(sides, *key), key).filter("writer != reader").select("source", "writer", "reader").repartition(parts, "source", "writer", "reader")
    return pairs.groupBy("source", "writer", "reader").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def shared_globals(x: DataFrame, lo: int, hi: int) -> DataFrame:
    """Addresses in [lo, hi) that some function writes and some reads, with ordered lists of both."""
    inside = x.filter((F.col("to_addr") >= lo) & (F.col("to_addr") < hi))
    who = lambda kind: F.array_sort(F.collect_set(F.when(F.col("ref_type") == kind, F.col("function_addr"))))
    return inside.groupBy("source", "to_addr").agg(who("WRITE").alias("writers"), who("READ").alias("readers")).filter((F.size("writers") > 0) & (F.size("readers") > 0))


def hardware_roles(edges: DataFrame, accessors: DataFrame, depth: int = 8) -> DataFrame:
    """node, depth, role: how far each function is from one that touches the hardware."""
    from .graph import reverse_reach

    role = F.when(F.col("depth") == 0, "driver").when(F.col("depth") == 1, "service").when(F.col("depth") <= 3, "control").otherwise("application")
    return reverse_reach(edges, accessors, depth).withColumn("role", role)


def modules(affinity: DataFrame, edges: DataFrame, names: DataFrame, links: int = 2, sure: float = 0.8) -> DataFrame:
    """node, module, method: seeded by the strongest affinity, then one synchronous round to neighbours with *links* links or more,
    the rest library (confidence of at least *sure*) or unknown. *names*: node, confidence."""
    seed = affinity.groupBy("node").agg(F.min_by("label", F.struct(-F.col("affinity"), F.col("label"))).alias("module"))
    e = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    votes = e.join(seed.select(F.col("node").alias("dst"), "module"), "dst").groupBy(F.col("src").alias("node"), "module").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= links)
    near = votes.join(seed, "node", "left_anti").groupBy("node").agg(F.min_by("module", F.struct(-F.col("n"), F.col("module"))).alias("near"))
    j = names.join(seed, "node", "left").join(near, "node", "left")
    method = F.when(F.col("module").isNotNull(), "seed").when(F.col("near").isNotNull(), "neighbour").otherwise("rest")
    return j.select("node", F.coalesce("module", "near", F.when(F.col("confidence") >= sure, "library").otherwise("unknown")).alias("module"), method.alias("method"))


def frontier(edges: DataFrame, named: DataFrame, fresh: DataFrame) -> DataFrame:
    """Neighbours of newly named nodes that have no name yet."""
    e = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    return e.join(fresh.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(named, "node", "left_anti")


def revisit(best: DataFrame, edges: DataFrame, fresh: DataFrame, below: float = 0.7, links: int = 2, cap: int = 50) -> DataFrame:
    """The *cap* least sure nodes below *below* with *links* newly named neighbours or more: a report of that many rows."""
    e = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = e.join(fresh.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("links")).filter(F.col("links") >= links)
    return best.filter(F.col("confidence") < below).join(near, "node").orderBy("confidence", "node").limit(cap)


def neighbourhood(edges: DataFrame, callers: int = 3, siblings: int = 8) -> DataFrame:
    """Each node with up to *callers* callers and up to *siblings* other callees of each, least addresses first."""
    e = edges.select("src", "dst").distinct()
    first = lambda key, by, n: F.row_number().over(Window.partitionBy(*key).orderBy(by)) <= n
    up = e.withColumn("ok", first(["dst"], "src", callers)).filter("ok").select(F.col("dst").alias("node"), F.col("src").alias("caller"))
    side = up.join(e.select(F.col("src").alias("caller"), F.col("dst").alias("sibling")), "caller").filter("sibling != node")
    side = side.withColumn("ok", first(["node", "caller"], "sibling", siblings)).filter("ok")
    return up.join(side.groupBy("node", "caller").agg(F.array_sort(F.collect_list("sibling")).alias("siblings")), ["node", "caller"], "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<long>")))


def dossier(functions: DataFrame, calls: DataFrame, xrefs: DataFrame, strings: DataFrame | None = None, bodies: DataFrame | None = None, peripherals: DataFrame | None = None, blocks: DataFrame | None = None, recovered: DataFrame | None = None, evidence: DataFrame | None = None, globals_: DataFrame | None = None) -> DataFrame:
    """One nested row for each function, each section from one pass over its table: what a reader of the function is given.

    callers, callees (other, other_name), references (ref_type, to_addr) always; of the tables given: strings (addr, value) that it
    refers to, body (its text) and body_chars, peripherals (peripheral, register_name, accesses), blocks and instructions,
    recovered (callee_addr, mechanism, confidence), evidence (confidence, method, name; surest first), shared (to_addr, access:
    globals that it writes or reads and others read or write). Sections without rows are null.
    """
    key = ["source", "addr"]
    named = functions.select("source", "addr", "name")
    out = calls.filter("callee_addr is not null").select("source", F.col("caller_addr").alias("addr"), F.col("callee_addr").alias("other")).distinct()
    into = calls.filter("callee_addr is not null").select("source", F.col("callee_addr").alias("addr"), F.col("caller_addr").alias("other")).distinct()
    who = named.select("source", F.col("addr").alias("other"), F.col("name").alias("other_name"))
    own = xrefs.select("source", F.col("function_addr").alias("addr"), "to_addr", "ref_type")

    def gathered(rows: DataFrame, name: str, *columns) -> DataFrame:
        return rows.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias(name))

    sections = [gathered(d.join(who, ["source", "other"], "left"), n, "other", "other_name") for d, n in ((into, "callers"), (out, "callees"))]
    sections.append(gathered(own, "references", "ref_type", "to_addr"))
    if strings is not None:
        held = own.select(*key, "to_addr").distinct().join(strings.select("source", F.col("addr").alias("to_addr"), "value"), ["source", "to_addr"])
        sections.append(gathered(held, "strings", F.col("to_addr").alias("addr"), "value"))
    if bodies is not None:
        sections.append(bodies.groupBy(*key).agg(F.min("decompiled_c").alias("body")).withColumn("body_chars", F.length("body").cast("long")))
    if peripherals is not None:
        p = peripherals.groupBy("source", F.col("function_addr").alias("addr"), "peripheral", "register_name").agg(F.count(F.lit(1)).alias("accesses"))
        sections.append(gathered(p, "peripherals", "peripheral", "register_name", "accesses"))
    if blocks is not None:
        sections.append(blocks.groupBy("source", F.col("function_addr").alias("addr")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("instruction_count").cast("long")).alias("instructions")))
    if recovered is not None:
        sections.append(gathered(recovered.withColumnRenamed("caller_addr", "addr"), "recovered", "callee_addr", "mechanism", "confidence"))
    if evidence is not None:
        e = evidence.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct((-F.col("confidence")).alias("order"), "confidence", "method", "name"))).alias("evidence"))
        sections.append(e.select(*key, F.transform("evidence", lambda x: F.struct(x["confidence"], x["method"], x["name"])).alias("evidence")))
    if globals_ is not None:
        g = own.filter("ref_type in ('READ', 'WRITE')").join(globals_.select("source", "to_addr"), ["source", "to_addr"], "left_semi")
        sections.append(gathered(g, "shared", "to_addr", F.col("ref_type").alias("access")))
    d = functions
    for s in sections:
        d = d.join(s, key, "left")
    return d


def edge_verdicts(edges: DataFrame, functions: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "REVIEW") -> DataFrame:
    """Edges between named functions with caller_name, callee_name, after (the site's distance from the caller's end) and verdict.

    *rules*: (LIKE pattern of the caller, of the callee, verdict), the first that fits wins; then a function that refers to
    itself by name is a false positive, and the rest is *default*.
    """
    f = functions.select("source", "addr", "name", "size")
    j = edges.join(f.toDF("source", "caller_addr", "caller_name", "size"), ["source", "caller_addr"]).join(f.drop("size").toDF("source", "callee_addr", "callee_name"), ["source", "callee_addr"])
    verdict = F.lit(None).cast("string")
    for caller, callee, said in rules:
        verdict = F.coalesce(verdict, F.when(F.col("caller_name").like(caller) & F.col("callee_name").like(callee), F.lit(said)))
    verdict = F.coalesce(verdict, F.when(F.col("caller_name") == F.col("callee_name"), F.lit("FP: self-reference")), F.lit(default))
    return j.withColumn("after", F.col("call_site_addr") - (F.col("caller_addr") + F.col("size"))).withColumn("verdict", verdict).drop("size")


def implied_edges(functions: DataFrame, rules: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges that naming conventions imply and no call shows. *rules*: rule, caller_like, callee_like, category (a few rows, written by hand).

    Both sides are matched with the broadcast rules first and then meet on (source, rule), by tiles: a convention can hold for many
    functions of few sources. The edges are never shuffled: both sides are distinct, a pair of several rules of a category is made
    by the least of them, and a caller brings along which of the callees it calls.
    """
    few, key = sized(rules), ["source", "addr"]
    side = lambda c: functions.join(few, F.expr(f"name LIKE {c}"))
    a, b = side("caller_like").select(*key, "rule", "category").distinct(), side("callee_like").select(*key, "rule").distinct()
    a_rules = a.groupBy(*key, "category").agg(F.collect_set("rule").alias("a_rules"))
    direct = calls.select("source", F.col("caller_addr").alias("addr"), "callee_addr").join(b.select("source", F.col("addr").alias("callee_addr")).distinct(), ["source", "callee_addr"], "left_semi")
    called = direct.groupBy(*key).agg(F.collect_set("callee_addr").alias("called"))
    same = F.col("x.category").eqNullSafe(F.col("y.category"))
    for c in key:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    a = a.alias("x").join(a_rules.alias("y"), same).select("x.*", "y.a_rules").join(called, key, "left")
    b = b.join(b.groupBy(*key).agg(F.collect_set("rule").alias("b_rules")), key)
    out = tiled(a.withColumnRenamed("addr", "caller_addr"), b.withColumnRenamed("addr", "callee_addr"), ["source", "rule"], ["caller_addr"], ["callee_addr"])
    first = (F.size("a_rules") == 1) | (F.array_min(F.array_intersect("a_rules", "b_rules")) == F.col("rule"))
    known = F.coalesce(F.array_contains("called", F.col("callee_addr")), F.lit(False))
    return out.filter((F.col("caller_addr") != F.col("callee_addr")) & first & ~known).select("source", "caller_addr", "callee_addr", "category")


def gap_categories(nodes: DataFrame, edges: DataFrame, roots: DataFrame, categories: Sequence[tuple[str, str]]) -> DataFrame:
    """What no root reaches, by the first name prefix that fits: category, missing. *nodes*: node, name."""
    from .graph import unreachable

    gone = unreachable(edges, nodes, roots)
    return gone.groupBy(prefix_group(F.col("name"), categories).alias("category")).agg(F.count(F.lit(1)).alias("missing"))
