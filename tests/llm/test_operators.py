"""Each operator against a brute-force version, and over nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, queries, secrets, substring_dedup, toxicity
from factloom.llm.common import texts_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, kept boolean"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark):
    """Nulls, empty and blank texts, a long text, copies, a repeated row and columns named like the operators' own."""
    r = random.Random(5)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "Ünï", "x" * 3000]) for _ in range(3000))
    one = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, one), (5, one), (5, one), (6, one + " "), (None, one), (7, long), (8, long), (9, "word"), (10, "word"), (None, None)]
    return spark.createDataFrame([(i, t, "en", None if i and i % 3 == 0 else "s", 1, 7, "k", False) for i, t in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sf(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return WORDS.findall(t or "")


# 5 exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    d = odd_docs(spark)
    rows = d.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    pick = min if keep == "smallest" else max
    want = collections.Counter()
    for r in rows:
        ids = [i for i in groups[r["text"] or ""] if i is not None]
        best = pick(ids) if ids else None
        want[(r["doc_id"], best, len(groups[r["text"] or ""]), r["doc_id"] == best, hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(d, keep, flush=100)  # folds in many pieces
    assert collections.Counter(tuple(x) for x in got.collect()) == want
    kept = exact_dedup.survivors(d, keep)
    assert kept.columns == d.columns
    assert collections.Counter((x["doc_id"], x["text"] or "") for x in kept.collect()) == collections.Counter({(pick([i for i in v if i is not None]), k): 1 for k, v in groups.items()})
    assert exact_dedup.exact_dedup(none(spark)).count() == 0 and exact_dedup.survivors(none(spark)).count() == 0


def test_normalised_dedup(spark):
    d = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.survivors(d, normalise=str.lower).collect()) == [(1, "A b"), (3, "c")]


def test_trie_spills_by_subtree():
    r = random.Random(1)
    keys = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(3000)]
    trie = exact_dedup.PatriciaTrie(min, budget=200)
    want: dict = {}
    for i, k in enumerate(keys):
        trie.insert(k, i, 1, [i])
        want.setdefault(k, []).append(i)
    assert any(n.spilled for n in exact_dedup._walk(trie.root))
    got = {k: (o[0], o[1], sorted(o[2])) for k, o in trie.owners()}
    assert got == {k: (min(v), len(v), v) for k, v in want.items()}


# 9 mixing


def test_targets_fill_up_and_reshare(spark):
    t = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(t, (5, 2, 1), 1.5, 2.0).collect()}
    assert got["a"] == 20 and got[None] == 0
    assert sum(got.values()) == pytest.approx(1.5 * 1110)
    assert got["b"] == pytest.approx(2 * (1665 - 20) / 3) and got["c"] == pytest.approx(200) or got["c"] <= 200


def test_mix(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 50), "s" if i % 3 else None) for i in range(3000)] + [(None, None, "s"), (5, "w", "t")], "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    assert len(rows) == 3002 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in ("s", None, "t"):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none(spark)).count() == 0 and mixing.mix(odd_docs(spark)).count() == 13
    got = mixing.emitted(d)
    assert got.columns == d.columns and got.count() == sum(r["copies"] for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in got.collect()) == +taken


# 6 packing


def test_plan_is_whole_and_near_the_bound():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([10, 60, 100])
        counts = dict(collections.Counter(r.randint(1, cap) for _ in range(r.randint(1, 60))))
        got: collections.Counter = collections.Counter()
        bins = 0
        for items, times in packing.plan(counts, cap):
            assert 0 < sum(items) <= cap and times > 0
            bins += times
            for w in items:
                got[w] += times
        assert dict(got) == counts
        assert bins <= 1.25 * -(-sum(w * n for w, n in counts.items()) // cap) + 1


def test_reduction_never_costs_a_bin():
    def best(items, cap):
        """Fewest bins by exhaustion."""
        items = sorted(items, reverse=True)
        out = [len(items)]

        def go(i, bins):
            if len(bins) >= out[0]:
                return
            if i == len(items):
                out[0] = len(bins)
                return
            seen = set()
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap and bins[k] not in seen:
                    seen.add(bins[k])
                    go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return out[0]

    r = random.Random(3)
    for _ in range(150):
        cap = 20
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        fixed, left = packing.reduce_by_dominance(dict(collections.Counter(items)), cap)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (best(rest, cap) if rest else 0) == best(items, cap)


def test_packing_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    d = odd_docs(spark).filter("doc_id is not null").unionByName(spark.createDataFrame([(99, "a <|endoftext|> b", None, None, 0, 0, "", True)], SCHEMA)).dropDuplicates(["doc_id"])
    got = packing.pack(packing.pieces(d, queries.gpt_encoder(), 64, with_ids=True), 64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for r in d.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(by[r["doc_id"]], key=lambda x: x["piece"])
        assert [i for x in own for i in x["ids"]] == ids
        assert [x["start"] for x in own] == [sum(y["length"] for y in own[:k]) for k in range(len(own))]
        assert all(x["length"] == 64 for x in own[1:])
    seq = collections.defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seq.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 64
    assert packing.pack(packing.pieces(none(spark), queries.gpt_encoder())).count() == 0


def test_fast_ids_are_the_tokenizers(spark):
    import public_tokenizers as P

    fast, plain = queries.gpt_encoder()(), packing.byte_bpe(P.path("byte_bpe_50k.json"))()
    for r in sf(spark).limit(60).collect():
        assert (fast(r["text"]) == plain(r["text"])).all()


# 7 near duplicates


def brute_components(rows, n, num, den):
    def shingles(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(s[a] & s[b])
            if i and den * i >= num * (len(s[a]) + len(s[b]) - i):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def near_corpus():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    out, i = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([2, 6, 40, 120]))]
        for _ in range(r.choice([1, 3, 30])):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            out.append((i, (" " if i % 2 else "\n").join(t)))
            i += 1
    passage = " ".join(r.choice(vocab) for _ in range(30))
    for _ in range(60):  # a common passage links nobody
        out.append((i, passage + " " + " ".join(r.choice(vocab) for _ in range(60))))
        i += 1
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, num):
    rows = near_corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows, n, num, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, n, num).collect()}
    assert got == want


def dense_group(seed, copies, length, edits, words):
    """Edited copies of one text and of some of its copies: edits replace, drop or add a word, so that many copies link with each other only."""
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(words)]
    base = [r.choice(vocab) for _ in range(length)]
    made = [base]
    for _ in range(copies):
        t = list(base if r.random() < 0.7 else r.choice(made))
        for _ in range(r.choice(edits)):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice([[r.choice(vocab)], [], [t[i], r.choice(vocab)]])
        made.append(t)
    made += [base[: len(base) - i] for i in range(0, length // 2, 2)]  # cut copies: a chain
    return [(i, " ".join(t)) for i, t in enumerate(made)]


@pytest.mark.parametrize(("n", "num", "length", "edits"), [(3, 85, 100, [0, 1, 2, 3, 4, 5, 6]), (5, 80, 80, [2, 3, 4])])
def test_near_duplicates_in_a_dense_group(spark, n, num, length, edits):
    rows = dense_group(n, 500, length, edits, 60)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows, n, num, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, n, num).collect()}
    assert got == want


def python_steps(plan):
    """How many Python operators the stage above a physical plan's first exchanges chains, and the most of any of its stages."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return python_steps(plan.executedPlan())
    below = [python_steps(plan.children().apply(i)) for i in range(plan.children().size())]
    here = max((b[0] for b in below), default=0) + (plan.nodeName() in ("MapInArrow", "FlatMapGroupsInPandas"))
    return 0 if "Exchange" in plan.nodeName() else here, max([here, *(b[1] for b in below)])


def test_near_duplicates_hold_one_python_worker_a_task(spark, monkeypatch):
    steps, stored = {}, minhash.stored

    def seen(df, name):
        steps[name] = max(steps.get(name, 0), python_steps(df._jdf.queryExecution().executedPlan())[1])
        return stored(df, name)

    monkeypatch.setattr(minhash, "stored", seen)
    d = spark.createDataFrame(dense_group(3, 40, 60, [0, 1, 2], 60), "doc_id long, text string")
    assert minhash.near_duplicates(d, 3, 85).count() == d.count()
    assert steps["counted"] == 1 and max(steps.values()) == 1, steps


def test_near_survivors_by_place(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, "a"), (None, text + " x", "b"), (7, text, "c"), (7, text, "c"), (None, "other words only", "d"), (None, None, "e"), (3, "", "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, at_0 string")
    got = minhash.survivors(d)
    assert got.columns == d.columns and got.count() == 4
    assert sorted((r["doc_id"] or 0, r["at_0"]) for r in got.collect()) == [(0, "d"), (0, "e"), (3, "f"), (7, "c")]
    assert minhash.survivors(none(spark)).count() == 0


def test_near_duplicates_odd_rows(spark):
    d = odd_docs(spark)
    got = minhash.near_duplicates(d, 3, 85).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[3]["component_id"] == 3
    assert by[6]["component_id"] == 4 and by[10]["component_id"] == 9 and by[8]["component_id"] == 7
    assert minhash.near_duplicates(none(spark)).count() == 0


# 2 substring dedup


def test_substring_dedup(spark):
    r = random.Random(11)
    w = lambda k: " ".join(f"{r.randrange(10**6)}" for _ in range(k))
    passage = w(70)
    fuzzy = passage.split()
    fuzzy[20], fuzzy[45] = "changed", "too"
    rows = [(1, w(100) + " " + passage + " " + w(30)), (2, w(10) + " " + passage), (3, w(200)), (4, " ".join(fuzzy) + " " + w(50)), (5, None), (6, ""), (None, passage), (7, passage[: len(passage) // 3])]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["partner_id"]) for x in got} == {(2, 1), (4, 1)}
    two = next(x for x in got if x["doc_id"] == 2)
    assert (two["start"], two["end"], two["partner_start"], two["partner_end"], two["identity"]) == (10, 80, 100, 170, 1.0)
    assert substring_dedup.substring_dedup(none(spark)).count() == 0
    # of the odd rows, 7 and 8 have one long text; 5 is there twice
    assert [(x["doc_id"], x["partner_id"], x["start"], x["end"], x["identity"]) for x in substring_dedup.substring_dedup(odd_docs(spark)).collect()] == [(8, 7, 0, 3000, 1.0)]


def test_substring_dedup_of_repeated_ids_is_the_same_in_any_partitions(spark):
    r = random.Random(15)
    w = lambda k: " ".join(f"{r.randrange(10**6)}" for _ in range(k))
    passage = w(80)
    d = spark.createDataFrame([(1, f"{w(20)} {passage}"), (2, f"b {passage}"), (2, f"a {w(90)}"), (3, f"{passage} {w(20)} {passage}")], "doc_id long, text string")
    got = {p: sorted(tuple(x) for x in substring_dedup.substring_dedup(d.repartition(p)).collect()) for p in (1, 2, 3, 5)}
    assert all(x == got[1] for x in got.values()) and [(x[0], x[3]) for x in got[1]] == [(2, 1), (3, 1), (3, 1)]


def test_substring_dedup_fuzzy_recall_and_precision(spark):
    """Planted passages with edits, against all pairs of passages in plain Python: found, whole but for their ends, and nothing else."""
    r = random.Random(16)
    w = lambda k: [f"{r.randrange(10**6)}" for _ in range(k)]
    rows, want = [], {}
    for i in range(60):
        p = w(r.randint(70, 160))
        q = list(p)
        for _ in range(r.randint(0, len(p) // 25)):
            j = r.randrange(len(q))
            q[j : j + 1] = r.choice([w(1), [], [q[j], *w(1)]])
        head = w(r.randint(0, 80))
        rows += [(2 * i, " ".join([*w(40), *p, *w(40)])), (2 * i + 1, " ".join([*head, *q, *w(40)]))]
        want[2 * i + 1] = (2 * i, len(head), len(head) + len(q))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {x["doc_id"] for x in got} <= set(want)
    good = 0
    for i, (partner, a, b) in want.items():
        own = [x for x in got if x["doc_id"] == i]
        covered = sum(max(0, min(b, x["end"]) - max(a, x["start"])) for x in own)
        good += all(x["partner_id"] == partner for x in own) and covered >= 0.8 * (b - a) and sum(x["n_words"] for x in own) <= 1.1 * (b - a)
    assert good >= 0.9 * len(want)


def test_align_matches_the_full_table():
    r = random.Random(17)
    for _ in range(60):
        a = np.array([r.randrange(30) for _ in range(r.randint(1, 150))], np.uint64)
        b = [x for x in a.tolist() if r.random() < 0.9]
        for _ in range(r.randint(0, 10)):
            b.insert(r.randrange(len(b) + 1), r.randrange(30))
        b = np.array(b, np.uint64)
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (a[i] == b[j]))
        got = substring_dedup.align(a, b, 200) if len(a) != len(b) or (a == b).sum() < 0.95 * len(a) else None
        assert got is None or got == t[-1, -1] / max(len(a), len(b), 1)
        assert substring_dedup.align(a, b, 8) <= t[-1, -1] / max(len(a), len(b), 1) + 1e-9


def test_chains_by_fenwick_match_quadratic():
    r = random.Random(4)
    for n in range(120):
        wide = r.choice([60, 200, 900])
        anchors = {(r.randrange(wide), r.randrange(wide)) for _ in range(r.randint(0, 60))} | {(x, x + 5) for x in range(0, wide, r.choice([6, 20, 70]))}
        runs = substring_dedup.diagonal_runs(list(anchors), 8)
        cost, reach = r.choice([0.0, 0.05, 0.3]), r.choice([10, 60])
        best: dict = {}
        for x, y, last in sorted(runs, key=lambda q: q[0]):
            gains = [best[p] - cost * (x - p[2] - 8 + y - (p[1] + p[2] - p[0] + 8)) for p in best if p[2] + 8 <= x <= p[2] + 8 + reach and 0 <= y - (p[1] + p[2] - p[0] + 8) <= reach]
            best[x, y, last] = last - x + 8 + max([0.0, *gains])
        score, before = substring_dedup.linked(runs, 8, cost, reach)
        assert score == pytest.approx([best[q] for q in runs])
        for i, j in enumerate(before):
            if j >= 0:
                (x, y, _), (px, py, pl) = runs[i], runs[j]
                assert 0 <= x - pl - 8 <= reach and 0 <= y - (py + pl - px + 8) <= reach
        found = substring_dedup.chains(list(anchors), 8, cost, reach)
        assert {x for x, *_ in found} <= {x for x, *_ in runs} and all(any(a <= x and last + 8 <= b for a, b, _, _ in found) for x, _, last in runs)


def test_substring_dedup_finds_all_repeats(spark):
    d = sf(spark).select("doc_id", "text")
    occ = collections.defaultdict(set)
    for r in d.collect():
        w = words(r["text"])
        for a in range(len(w) - 49):
            occ[tuple(w[a : a + 50])].add(r["doc_id"])
    need = {i for v in occ.values() if len(v) > 1 for i in v}
    got = substring_dedup.substring_dedup(d).collect()
    assert need <= {x for r in got for x in (r["doc_id"], r["partner_id"])}


# 3 line dedup


def brute_line_dedup(rows, every=3, window=2, least=2):
    """By (doc_id, text): chunk boundaries from chained xxhash64, later chunks of equal bytes removed."""
    import xxhash

    def chunks(text):
        lines = (text or "").split("\n")
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
        out, cur = [], []
        for i, x in enumerate(lines):
            seed = 42
            for j in range(window):
                if i - j >= 0:
                    seed = xxhash.xxh64_intdigest(h[i - j].to_bytes(8, "little"), seed)
            cur.append(x)
            signed = seed - 2**64 if seed >= 2**63 else seed
            if signed % every == 0 or i == len(lines) - 1:
                out.append(cur)
                cur = []
        return out

    first, out = {}, {}
    for i, t in sorted(rows):
        for k, c in enumerate(chunks(t)):
            if len(c) >= least:
                first.setdefault("\n".join(c), (i, k))
    for i, t in rows:
        own = chunks(t)
        stay = [c for k, c in enumerate(own) if len(c) < least or first["\n".join(c)] == (i, k)]
        out[i] = ("\n".join("\n".join(c) for c in stay), len(own), len(own) - len(stay), sum(map(len, own)) - sum(map(len, stay)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [[f"line {r.randrange(10**6)} ä" for _ in range(r.randint(1, 25))] for _ in range(12)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randint(0, 5)):
            lines += r.choice(pool) if r.random() < 0.6 else [f"own {r.randrange(10**6)}" for _ in range(r.randint(1, 6))] + [""] * r.randint(0, 2)
        rows.append((i, "\n".join(lines)))
    got = {x["doc_id"]: (x["text"], x["n_chunks"], x["n_removed_chunks"], x["n_removed_lines"]) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute_line_dedup(rows)
    assert got == want and sum(x[2] for x in want.values()) > 50


def test_line_dedup_removes_later_chunks(spark):
    block = "\n".join(f"license line {i}" for i in range(40))
    rows = [(1, "a b c\n" + block + "\nend one"), (2, "other\nlines\n" + block + "\nend two"), (3, "plain"), (4, None), (5, block + "\n" + block)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed_chunks"] == 0 and got[1]["text"] == rows[0][1]
    assert got[3]["text"] == "plain" and got[4]["text"] == ""
    assert 20 <= got[2]["n_removed_lines"] <= 42 and got[2]["text"].startswith("other") and got[2]["text"].endswith("end two")
    assert got[5]["n_removed_lines"] >= 40
    assert line_dedup.line_dedup(none(spark)).count() == 0
    odd = line_dedup.line_dedup(odd_docs(spark)).collect()
    assert len(odd) == 13


# 10 secrets


def brute_base(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan_base_spans():
    r = random.Random(9)
    bits = ["password", "PASSWD", "Secret", "api_key", "apikey", "token", " = ", ": ", "'", '"', "abc123XYZ", "AKIA", "AKIA" + "Q7" * 10, "deadbeef" * 3, "0f" * 11, " ", "é\U0001f600", "\n", "ſecret=", "ordinary words", "x" * 2000]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)] + [""]
    assert secrets.scan(texts, None) == [brute_base(t) for t in texts]


def made(r, alphabet, n, prefix=""):
    return prefix + "".join(r.choice(alphabet) for _ in range(n))


HEX, UPPER, WIDE = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def test_automaton_is_a_distribution_that_keeps_lengths():
    r = random.Random(6)
    sample = ["".join(r.choice("ab") for _ in range(r.choice([3, 3, 5]))) for _ in range(400)]
    a = secrets.Automaton(sample)
    # all strings of up to seven characters by brute force: what the sample can't be is nearly impossible, the rest sums to 1
    by = collections.Counter()
    for n in range(8):
        for k in range(2**n):
            s = "".join("ab"[k >> i & 1] for i in range(n))
            by[n] += np.exp(a.log_likelihood(s, 1e-12))
    assert sum(by.values()) == pytest.approx(1, abs=1e-6)
    assert by[3] == pytest.approx(sum(len(s) == 3 for s in sample) / 400, abs=0.02) and by[3] + by[5] == pytest.approx(1, abs=1e-6)
    assert sum(a.stop[x] for x in a.states) == 400 and a.n[0] == 400
    free = secrets.Automaton(["a" * r.randint(1, 40) for _ in range(400)])
    assert 1 < len(a.states) < 20 and len(free.states) < 40 and free.log_likelihood("b") < -9


def test_families_and_their_states():
    r = random.Random(7)
    hexes = [made(r, HEX, 40) for _ in range(150)] + [made(r, "0123456789", 40)]
    keys = [made(r, UPPER, 16, "AKIA") for _ in range(150)]
    git = [made(r, WIDE, 36, "ghp_") for _ in range(100)]
    odd = [made(r, WIDE, 11, "xoxb-") for _ in range(5)]
    got = secrets.families(hexes + keys + git + odd + hexes)
    assert {k: len(v) for k, v in got.items()} == {"AKIA[0A]": 150, "ghp_[0Aaz]": 100, "[0a]": 151}
    f = secrets.Formats(hexes + keys + git, np.full((11, 11), 1000))
    assert all(len(a.states) >= n for (_, a), n in ((f.kinds["[0a]"], 41), (f.kinds["AKIA[0A]"], 17), (f.kinds["ghp_[0Aaz]"], 37)))
    one = f.kinds["[0a]"][1]
    assert one.log_likelihood(secrets.symbols(made(r, HEX, 40))) > one.log_likelihood(secrets.symbols(made(r, HEX, 33)))
    assert f.likelihood("ghq_" + "a" * 36) < -50 < f.likelihood(made(r, WIDE, 36, "ghp_"))


def test_planted_formats_are_found_and_others_are_not(spark):
    """Bare credentials of formats that other documents label are found; words, numbers, dates, addresses and paths are not."""
    r = random.Random(8)
    word = lambda: made(r, "abcdefghijklmnoprstuvwy", r.randint(4, 14))
    plain = [lambda: made(r, "0123456789", 16), lambda: f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}", lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{word()}.{word()}/{word()}.html", lambda: word().capitalize() + word(), lambda: f"{word()}_{r.randint(1, 9)}"]
    formats = {"hex18": lambda: made(r, HEX, 18), "ghp": lambda: made(r, WIDE, 36, "ghp_"), "upper": lambda: made(r, UPPER, 22)}
    texts, want = [], []
    for i in range(900):
        t = [word() if r.random() < 0.9 else r.choice(plain)() for _ in range(60)]
        if i < 300:  # labelled
            t.insert(5, f"token = {r.choice(list(formats.values()))()}")
        bare = [r.choice(list(formats.values()))() for _ in range(r.choice([0, 1, 2]))] if i >= 800 else []
        for x in bare:
            t.insert(r.randrange(len(t)), x)
        texts.append(" ".join(t))
        want.append(set(bare))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    f = secrets.learn(d)
    assert len(f.kinds) == 3 and all(len(a.states) > 10 for _, a in f.kinds.values())
    got = {x["doc_id"]: {texts[x["doc_id"]][s["start"] : s["end"]] for s in x["found"] if s["kind"] == "format"} for x in secrets.find_secrets(d, f).collect()}
    hits, found, planted = sum(len(got[i] & want[i]) for i in got), sum(map(len, got.values())), sum(map(len, want))
    assert planted > 80 and hits >= 0.98 * planted and hits >= 0.98 * found
    # the background counted every candidate of every whole text
    assert f.threshold == pytest.approx(3 + np.log(sum(len(re.findall(r"[A-Za-z0-9+/_.=-]{6,}", t)) for t in texts)))
    again = secrets.learn(d.repartition(1))
    assert f.threshold == again.threshold and {k: a.states for k, (_, a) in f.kinds.items()} == {k: a.states for k, (_, a) in again.kinds.items()}


def test_scores_against_brute_force():
    r = random.Random(9)
    pairs = np.array([[r.randrange(50) for _ in range(11)] for _ in range(11)])
    f = secrets.Formats([made(r, HEX, 18) for _ in range(60)], pairs)
    codes = "0azA+/_.=-"
    step = np.log((pairs + 0.5) / (pairs + 0.5).sum(1, keepdims=True))
    for _ in range(200):
        w = made(r, WIDE + "+/_.=-", r.randint(6, 30)) if r.random() < 0.5 else made(r, HEX, r.randint(6, 30))
        k = [10, *(codes.index(c) for c in secrets.symbols(w)), 10]
        ground = sum(step[x, y] for x, y in zip(k, k[1:], strict=False))
        assert f.score(w) == pytest.approx(f.kinds["[0a]"][1].log_likelihood(secrets.symbols(w)) - ground)
        base = [(s, e) for s, _, e in secrets.scan([f"é {w}"], None)[0]]
        hot = f.score(w) > f.threshold and not any(s < 2 + len(w) and e > 2 for s, e in base)
        assert [x for x in secrets.scan([f"é {w}"], f)[0] if x[1] == 3] == ([(2, 3, 2 + len(w))] if hot else [])


def test_secret_scan_odd_rows(spark):
    d = odd_docs(spark)
    got = secrets.find_secrets(d, secrets.learn(d)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in d.collect()) and not any(r["found"] for r in got)
    assert secrets.find_secrets(none(spark), secrets.learn(none(spark))).count() == 0
    assert secrets.redact("abcdef", [(1, 3), (2, 4)]) == "a[secret]ef"


# 4 quality rules


def test_base_counts_are_exact(spark):
    r = random.Random(8)
    texts = [t for t in texts_of_rows(sf(spark))] + ["", " \n ", "a b c d e a b c d e", "x " * 50, "l1\nl1\n\nl1 \nl1", "#*$%&|<>", "é ü\x0bß\x0cq"] + [" ".join(r.choice("abc") for _ in range(40)) for _ in range(30)]
    s = quality_rules.Lines(texts)
    for i, t in enumerate(texts):
        w = words(t)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        assert (s.n_words[i], s.word_chars[i], s.n_symbols[i], s.n_dup_lines[i], s.n_repeat_words[i]) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(rep)), t[:80]


def texts_of_rows(df):
    return [r["text"] or "" for r in df.select("text").collect()]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    crf = quality_rules.LineCRF()
    crf.w, crf.trans, crf.start = rng.normal(size=len(quality_rules.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2)
    x = rng.normal(size=(14, len(quality_rules.FEATURES)))
    doc = np.array([0] * 6 + [1] * 1 + [2] * 7)
    got = crf.viterbi(x, doc)
    e = x @ crf.w

    def score(path, lo):
        s = crf.start[path[0]] + e[lo] * path[0]
        for k in range(1, len(path)):
            s += crf.trans[path[k - 1], path[k]] + e[lo + k] * path[k]
        return s

    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = [[(m >> k) & 1 for k in range(len(at))] for m in range(1 << len(at))]
        best = max(paths, key=lambda p: score(p, at[0]))
        assert list(got[at]) == best


def test_quality_rules_and_classifier_on_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = labels.filter("doc_id % 2 = 0")
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 2 = 1").collect()}
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, quality_rules.train(docs, train)).collect()}
    right = sum((out[i]["content_share"] >= 0.5) == bool(q) for i, q in truth.items() if not out[i]["base_failed"])
    assert right >= 0.95 * sum(not out[i]["base_failed"] for i in truth)
    model = quality_classifier.train(docs, quality_classifier.ratings(train))
    assert (np.diff(model.thresholds()) > 0).all()
    sel = {r["doc_id"]: r for r in quality_classifier.grade(docs, model).collect()}
    assert sum(sel[i]["selected"] == bool(q) for i, q in truth.items()) >= 0.95 * len(truth)
    d = odd_docs(spark)
    assert quality_classifier.grade(d, model).count() == 13 and quality_classifier.select(d, model).columns == d.columns
    crf = quality_rules.train(docs, train)
    odd = quality_rules.quality_rules(d, crf).collect()
    assert len(odd) == 13 and all(r["base_failed"] and not r["kept"] for r in odd if r["n_words"] == 0)
    assert quality_rules.quality_rules(none(spark), quality_rules.train(none(spark), labels)).count() == 0
    assert quality_classifier.grade(none(spark), quality_classifier.train(none(spark), quality_classifier.ratings(labels))).count() == 0


# 1 toxicity


def test_toxicity_scores_from_given_weights():
    """Every text's score by plain Python: n-grams of each word with its edges, windows, softmax over two classes."""
    r = random.Random(18)
    mix, bits, width = toxicity._MIX, 10, 5
    m = toxicity.SubwordClassifier(bits=bits, width=width).frozen()
    m.logit = np.array([r.uniform(-3, 3) for _ in range(1 << bits)], np.float32)
    m.bias = -0.7

    def gram(g):
        h = sum(ord(c) * int(mix[j]) for j, c in enumerate(g)) % 2**64
        return ((h ^ (h >> 29)) * (int(mix[7]) + 2 * len(g)) % 2**64) >> (64 - bits)

    def score(t):
        ws = WORDS.findall(t.lower())
        each = [sorted(gram(f" {w} "[i : i + n]) for n in (3, 4, 5) for i in range(len(w) + 3 - n)) for w in ws]
        each = [[] if i and each[i] == each[i - 1] else g for i, g in enumerate(each)]
        if not ws:
            return 1 / (1 + np.exp(-m.bias))
        runs = [sum(each[i : i + width], []) for i in range(max(1, len(ws) - width + 1))]
        z = max(sum(float(m.logit[b]) for b in g) / (len(g) + toxicity.PAD) for g in runs) + m.bias
        return 1 / (1 + np.exp(-z))

    vocab = ["a", "Bad", "xy", "wörd", "longerword", "\u4f60\u597d", "9", "it's"]
    texts = ["", " \n", "a", "a a a b", *(" ".join(r.choice(vocab) for _ in range(r.randint(1, 30))) for _ in range(60))]
    assert m.scores(texts) == pytest.approx([score(t) for t in texts], abs=1e-5)


def test_ordinal_model_against_brute_force():
    """Tail probabilities and the fitted optimum by plain Python: no small step in any used weight or threshold is likelier."""
    r = random.Random(19)
    texts = [" ".join(r.choice(["good", "fine", "ok", "Bad", "junk!!", "12"][2 * g : 2 * g + 4]) for _ in range(12)) for g in (0, 1, 2) for _ in range(15)]
    y = [g for g in (0, 1, 2) for _ in range(15)]
    m = quality_classifier.CumulativeLink(3, bits=8).fit(texts, y, steps=400, rate=0.05, ridge=0.0)
    doc, bucket, weight = quality_classifier.hashed(texts, 8)

    def likelihood(w, t):
        out = 0.0
        for d, g in enumerate(y):
            f = sum(w[b] * v for b, v in zip(bucket[doc == d], weight[doc == d], strict=True))
            tail = [1.0, *(1 / (1 + np.exp(-(f - x))) for x in t), 0.0]
            out += np.log(max(tail[g] - tail[g + 1], 1e-9))
        return out

    f = np.array([sum(m.w[b] * v for b, v in zip(bucket[doc == d], weight[doc == d], strict=True)) for d in range(len(texts))])
    assert m.latent(texts) == pytest.approx(f)
    t = m.thresholds()
    assert t[0] < t[1] and m.tails(f)[:, 1] == pytest.approx(1 / (1 + np.exp(-(f - t[1]))))
    best = likelihood(m.w, t)
    assert best > likelihood(np.zeros_like(m.w), np.array([-0.69, 0.69])) + 20
    start = quality_classifier.CumulativeLink(3, bits=8)
    early = start.fit(texts, y, steps=5, rate=0.05, ridge=0.0)
    assert likelihood(early.w, early.thresholds()) < best


def test_labelled_texts_have_a_bound_in_bytes_and_none_in_length(spark):
    from factloom.llm.common import picked_texts

    d = spark.createDataFrame([(1, "x" * 300_000), (2, "abc"), (2, "ab"), (3, None), (4, "é" * 10), (5, "not picked")], "doc_id long, text string")
    pick = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, y int")
    got = picked_texts(d, pick, 1 << 20)
    assert sorted((len(t), y) for t, y in got) == [(2, 0), (10, 0), (300_000, 1)]
    assert sorted(len(t) for t, _ in picked_texts(d, pick, 30)) == [2, 10] and picked_texts(d, pick.limit(0), 30) == []


def test_toxicity_learns_and_shares_misspellings(spark):
    r = random.Random(12)
    syl = ["ba", "ko", "ri", "nel", "tas", "um", "der", "sol"]
    plain = lambda k: [" ".join("".join(r.choice(syl) for _ in range(r.randint(1, 3))) for _ in range(60)) for _ in range(k)]
    bad = []
    for t in plain(150):
        w = t.split()
        w[r.randrange(60)] = r.choice(["idiot", "pathetic", "scum"])
        bad.append(" ".join(w))
    m = toxicity.SubwordClassifier().fit(bad[:100] + plain(100), [1] * 100 + [0] * 100)
    score = m.scores
    assert (score(bad[100:]) >= 0.7).mean() > 0.9 and (score(plain(50)) >= 0.7).mean() < 0.1
    assert score(["ba ko ri idiotic nel tas um der sol ba"])[0] > score(["ba ko ri kori nel tas um der sol ba"])[0]
    assert score(["", " "]).max() < 0.7
    d = odd_docs(spark)
    got = toxicity.score_toxicity(d, m.frozen()).collect()
    assert len(got) == 13 and all(0 <= x["score"] <= 1 for x in got)
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1)
    assert toxicity.score_toxicity(none(spark), m.frozen()).count() == 0


def test_batches_read_whole_texts():
    import pyarrow as pa

    from factloom.llm.common import batches

    b = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a" * 50, None, "b" * 200]})
    got = [x for p in batches([b], limit=60) for x in texts_of(p)]
    assert got == ["a" * 50, "", "b" * 200]


def test_joined_batches_keep_all_rows_in_order():
    import pyarrow as pa

    from factloom.llm.common import joined

    made = [pa.RecordBatch.from_pydict({"node": [i, -i], "members": [b"x" * n, b""]}) for i, n in enumerate([30, 20, 10, 200, 5, 0])]
    got = list(joined(made, "members", 60))
    assert [b.num_rows for b in got] == [6, 2, 4]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(made).combine_chunks())
    assert list(joined([], "members")) == []


# the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "source mixing", "best-fit packing"]
    frames = [d]
    for name, stage in p.STAGES:
        out = stage(spark, frames[-1], SF)
        out.write.mode("overwrite").parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames[:4]]
    assert all(f.columns == d.columns for f in frames[:5])
    by: dict = {}
    for i, t in sorted(rows[1].items()):
        by.setdefault(t, i)
    assert set(rows[2]) == set(by.values())
    comp = brute_components(list(rows[2].items()), 5, 80, 100)
    assert set(rows[3]) == {i for i, (_, c) in comp.items() if c == i}
    copies = collections.Counter(r["doc_id"] for r in frames[4].collect())
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(frames[3]).collect() if r["copies"]}
    assert dict(copies) == taken
    assert frames[5].agg(F.sum("length")).first()[0] == sum(n * (len(queries.gpt_encoder()()(rows[3][i])) + 1) for i, n in copies.items())


def test_pipeline_run_on_odd_rows(spark, tmp_path):
    """Null and equal ids, null and empty texts, clashing columns: run() is its stages' result; and no documents give no rows."""
    import corpus_pipeline as p

    one = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(None, t) for t in one[:10]] + [(i // 2, t) for i, t in enumerate(one[10:])] + [(None, None), (None, ""), (99, one[0])]
    d = spark.createDataFrame([(*r, "s", True, 1.0, "c") for r in rows], "doc_id long, text string, source string, kept boolean, tail double, made_0_tail string")
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quality_classifier.train(docs, quality_classifier.ratings(spark.read.parquet(str(tmp_path / "labels.parquet"))))
    selected = [r["selected"] for r in quality_classifier.grade(docs, model).collect()]
    kept = [r["text"] or "" for r, s in zip(docs.collect(), selected, strict=True) if s]
    texts = sorted(set(kept))
    comp = brute_components(list(enumerate(texts)), 5, 80, 100)
    groups = len({c for _, c in comp.values()})
    near = p.near(spark, p.exact(spark, p.quality(spark, docs, str(tmp_path)), str(tmp_path)), str(tmp_path))
    assert near.count() == groups and near.columns == d.columns
    copies = sum(r["copies"] for r in mixing.mix(near).collect())
    assert p.mixed(spark, near, "").count() == copies <= 2 * groups
    out = p.run(spark, str(tmp_path))
    assert out.filter("piece = 0").count() == copies
    empty = tmp_path / "none"
    d.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(empty / "labels.parquet"))
    assert p.run(spark, str(empty)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


# cuts that a review found


def test_chains_pass_over_far_predecessors():
    far, line = [(x, x + 7) for x in range(0, 400, 8)], [(x, x + 7) for x in range(500, 900, 20)]
    assert sorted(substring_dedup.chains(far + line, 8, reach=60)) == [(0, 400, 7, 407), (500, 888, 507, 895)]
    r = random.Random(14)
    for _ in range(40):
        tree, held = substring_dedup.FenwickMaxima(9), []
        for item in range(60):
            held.append((r.randrange(9), float(r.randrange(20)), item))
            tree.put(*held[-1])
            while held and r.random() < 0.5:
                tree.drop(held[0][0], held.pop(0)[2])
            i, j = sorted(r.choices(range(10), k=2))
            assert tree.within(i, j)[0] == max((v for p, v, _ in held if i <= p < j), default=-np.inf)


def test_substring_dedup_finds_a_fuzzy_passage_after_a_long_one(spark):
    r = random.Random(12)
    w = lambda k: [f"{r.randrange(10**6)}" for _ in range(k)]
    rows, need = [], []
    for i in range(20):
        first, between, passage = w(500), w(100), w(70)
        fuzzy = list(passage)
        fuzzy[20], fuzzy[45] = "changed", "too"
        rows += [(2 * i, " ".join([*first, *between, *passage, *w(30)])), (2 * i + 1, " ".join([*first, *w(100), *fuzzy, *w(30)]))]
        need.append(2 * i + 1)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i in need:
        spans = sorted((x["start"], x["end"]) for x in got if x["doc_id"] == i)
        assert len(spans) == 2 and spans[0] == (0, 500) and spans[1][0] <= 602 and spans[1][1] >= 668, spans


def test_substring_dedup_keeps_the_length_of_periodic_passages(spark):
    r = random.Random(13)
    w = lambda k: " ".join(f"{r.randrange(10**6)}" for _ in range(k))
    slogan = {p: w(p) for p in (1, 2, 5, 11, 12)}
    rows, whole = [], {}
    for i, (p, t) in enumerate(slogan.items()):
        n = 240 // p
        own = [" ".join([t] * n), " ".join([t] * n), " ".join([t] * (3 * n)), f"{w(90)} {' '.join([t] * n)} {w(90)}"]
        rows += [(10 * i + j, x) for j, x in enumerate(own)]
        whole |= {10 * i + 1: (0, p * n), 10 * i + 2: (0, 3 * p * n), 10 * i + 3: (90, 90 + p * n)}
    uneven = " ".join((["a"] * 9 + ["b", "c"]) * 20)
    rows += [(100, uneven), (101, uneven)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: (x["start"], x["end"]) for x in got} == whole | {101: (0, 220)} and len(got) == len(whole) + 1
    assert all(x["identity"] == 1.0 and x["partner_id"] == x["doc_id"] // 10 * 10 for x in got)
    for x in got:
        if x["doc_id"] % 10 == 1 and x["doc_id"] < 100:
            assert (x["partner_start"], x["partner_end"]) == (x["start"], x["end"])


def test_substring_dedup_repeats_of_few_shared_words_are_no_passage(spark):
    few, block = "buy now cheap pills today my friend hello", " ".join(["a"] * 9 + ["b", "c"])
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(90))
    texts = [f"{own(0)} {few} {own(1)}", " ".join([few] * 50), f"{own(2)} {block} {own(3)}", " ".join([block] * 20)]
    assert substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0
