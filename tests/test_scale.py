"""Operators that once held a whole group in one task, or stopped at a cap: against brute force on small tables."""

import itertools
import random
from statistics import median

import numpy as np
import pytest

from cellarflow import session
from cellarflow.operators import entities as E
from cellarflow.operators import lexicon as L
from cellarflow.operators import metrics as M
from cellarflow.operators import phrases as P
from cellarflow.operators import skew
from cellarflow.operators import text as X
from cellarflow.operators import vectors as V
from cellarflow.operators.order import running_sums


def test_folds_are_greedy(spark):
    import hashlib

    rng = random.Random(5)
    rows = [(f"g{g}",) for g in range(120) for _ in range(rng.choice([1, 1, 2, 2, 3, 7, 40 if g == 3 else 1]))] + [(None,)]
    got = {r.g: (r.n, r.fold) for r in E.group_folds(spark.createDataFrame(rows, "g string"), "g", 4).collect()}
    sizes = {g: sum(r[0] == g for r in rows) for g in {r[0] for r in rows if r[0]}}
    load, want = [0] * 4, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(g.encode()).hexdigest(), g)):
        fold = load.index(min(load))
        load[fold] += sizes[g]
        want[g] = (sizes[g], fold)
    assert got == want
    assert E.group_folds(spark.createDataFrame([], "g string"), "g", 4).count() == 0


def test_dealing_in_stretches():
    for seed in range(3000):
        rng = random.Random(seed)
        k = rng.randint(1, 6)
        one, dealt = [0] * k, [0] * k
        for size in sorted(rng.sample(range(1, 30), rng.randint(1, 6)), reverse=True):
            count, want = rng.randint(1, 40), []
            for _ in range(count):
                at = one.index(min(one))
                one[at] += size
                want.append(at)
            runs = E._deal(dealt, size, count)
            turns = [[r for r in runs if r[0] <= t][-1] for t in range(count)]
            assert [turn[(t - start) % len(turn)] for t, (start, turn) in enumerate(turns)] == want and one == dealt and len(runs) <= k


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(300, 301), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in E.components(edges).collect()}
    assert got == {i: 0 for i in range(151)} | {300: 300, 301: 300}
    assert E.components(edges.limit(0)).count() == 0


def test_support_within_one_edit(spark):
    words = ["", "a", "ab", "abc", "axc", "abcd", "bcd", "acbd", "vino", "vena", "vina", "vinno", "ino"]
    rows = [("q", f"r{i % 5}", w) for i, w in enumerate(words * 2)] + [("p", "r1", "abc"), ("q", "r9", None)]
    got = {(r.g, r.n): (r.support, r.r) for r in L.fuse_support(spark.createDataFrame(rows, "g string, r string, n string"), "g", "r", "n").collect()}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        return a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))

    want = {}
    for g, _, w in rows:
        if w is not None:
            found = {r for h, r, x in rows if h == g and x is not None and near(w, x)}
            want[g, w] = (len(found), min(found))
    assert got == want


def test_medians_of_levels(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice([None, float(rng.randrange(9))]), rng.random()) for _ in range(200)]
    got = {(r.level, r.k, r.j): (r.n, r.v, r.w) for r in M.level_medians(spark.createDataFrame(rows, "k string, j int, v double, w double"), [["k", "j"], ["k"], []], ["v", "w"], 3).collect()}
    want = {}
    for number, level in enumerate([(0, 1), (0,), ()]):
        for key in {tuple(r[i] if i in level else None for i in (0, 1)) for r in rows if all(r[i] is not None for i in level)}:
            group = [r for r in rows if all(r[i] == key[i] for i in level)]
            middle = lambda c, group=group: round(median(x), 3) if (x := [r[c] for r in group if r[c] is not None]) else None
            want[(number, *key)] = (len(group), middle(2), middle(3))
    assert got.keys() == want.keys()
    for k, (n, v, w) in want.items():
        assert got[k][0] == n and (v is None) == (got[k][1] is None) and (v is None or abs(got[k][1] - v) < 2e-3) and abs(got[k][2] - w) < 2e-3


def test_thresholds(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), float(rng.randrange(12)), rng.random() < 0.5) for _ in range(150)] + [(1, None, True), (None, 2.0, True), (2, 3.0, None)]
    known = [r for r in rows if None not in r]
    got = {r.f: (r.threshold, round(r.accuracy, 9)) for r in M.threshold_out_of_fold(spark.createDataFrame(rows, "f int, s double, ok boolean"), "f", "s", "ok").collect()}
    want = {}
    for fold in range(3):
        others = [r for r in known if r[0] != fold]
        best = max(sorted({s for _, s, _ in others}), key=lambda t: (sum((s >= t) == ok for _, s, ok in others), -t))
        own = [r for r in known if r[0] == fold]
        want[fold] = (best, round(sum((s >= best) == ok for _, s, ok in own) / len(own), 9))
    assert got == want
    assert M.threshold_out_of_fold(spark.createDataFrame([], "f int, s double, ok boolean"), "f", "s", "ok").count() == 0


def test_running_sums(spark):
    rows = [(i, i % 7) for i in range(500)]
    got = {r.k: r.sum_v for r in running_sums(spark.createDataFrame(rows, "k long, v long").repartition(9), ["k"], ["v"]).collect()}
    assert got == dict(zip(range(500), itertools.accumulate(v for _, v in rows)))


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 1), (None, 2), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c"), ("other", "o")], "k string, v string")
    got = sorted(map(tuple, skew.salted_lookup(left, right, "k", "i", 30).select("k", "i", "v").collect()), key=str)
    assert got == sorted([*[("hot", i, "h") for i in range(200)], ("cold", 1, "c"), (None, 2, None), ("none", 3, None)], key=str)


def test_phrase_rules(spark):
    texts = {1: "это вредно для здоровья", 2: "употребление вина не очень вредит", 3: "употребление вина совсем не очень вредит", 4: "на этикетке написано", 5: "на этикетке и без этикетки", 6: "drink it responsibly", 7: "please drink responsibly now", 8: ""}
    words = spark.createDataFrame([(d, i, w) for d, t in texts.items() for i, w in enumerate(t.split())] + [(9, 0, None)], "d int, p int, w string")
    rules = P.rule_table(spark, [("health", 1, "здоров*", False), ("drink", 2, "употребл* ..3 вред*", False), ("drink", 2, "drink responsibly", False), ("label", 3, "этикет*", False), ("label", 3, "на этикетке", True)])
    hits = P.rule_hits(words, "d", "p", "w", rules)
    assert {r.d: r.topic for r in P.barred(hits, "d").collect()} == {1: "health", 2: "drink", 5: "label", 7: "drink"}
    names = spark.createDataFrame([(10, ["на", "этикетке"]), (11, ["вина"]), (12, [])], "id int, ws array<string>")
    found = P.rule_hits(words, "d", "p", "w", P.phrase_table(names, "id", "ws"))
    assert {(r.d, r.rule, r.start, r.end) for r in found.collect()} == {(4, 10, 0, 1), (5, 10, 0, 1), (2, 11, 1, 1), (3, 11, 1, 1)}
    assert {(r.d, r.rule) for r in P.without_negated(found, words, "d", "p", "w", ["употребление"]).collect()} == {(4, 10), (5, 10)}
    with pytest.raises(ValueError):
        P.rule_table(spark, [("x", 1, "ab*", False)])


def test_form_pairs(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("аб") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    one = spark.createDataFrame([(w,) for w in words], "x string")
    got = {tuple(r) for r in X.form_pairs(one, one.withColumnRenamed("x", "y")).collect()}

    def match(a, b):
        n = min(len(a), len(b))
        stem = min(5, max(n - 1, 3))
        return a == b or (n >= 4 and a[:stem] == b[:stem] and abs(len(a) - len(b)) <= 3)

    assert got == {(a, b) for a in words for b in words if match(a, b)}


def test_search_in_small_blocks_and_pieces(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    index = spark.createDataFrame([(i, f"s{i * 7 % 11}", i % 3, i % 4 != 1, v.tolist()) for i, v in enumerate(vectors)] + [(90, "s1", 0, True, None), (91, "s1", 0, True, [1.0])], "row_id long, slug string, view int, is_base boolean, vec array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i % 4}", i, vectors[i].tolist()) for i in range(0, 40, 2)] + [("q9", 77, None)], "query string, window long, vec array<double>")
    sims = {}
    for q, w, vec in [(f"q{i % 4}", i, vectors[i]) for i in range(0, 40, 2)]:
        for i in range(60):
            if i != w:
                sims[q, w, i] = float(vec @ vectors[i])
    scale = {}
    for q in {k[0] for k in sims}:
        whole = [s for (a, _, i), s in sims.items() if a == q and i % 4 != 1]
        for w in {k[1] for k in sims if k[0] == q}:
            for view in range(3):
                block = [s for (a, b, i), s in sims.items() if a == q and b == w and i % 3 == view and i % 4 != 1]
                flat = np.std(whole) < 1e-6 or np.std(block) < 1e-6
                scale[w, view] = (1.0, 0.0) if flat else (np.std(whole) / np.std(block), np.mean(whole) - np.std(whole) / np.std(block) * np.mean(block))
    for block, piece in ((4096, 1024), (3, 7)):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        monkeypatch.setattr(V, "PIECE", piece)
        for how in V.AGGREGATIONS:
            value = lambda w, i, s, how=how: s * scale[w, i % 3][0] + scale[w, i % 3][1] if how == "zmax" else s
            best = {}
            for (q, w, i), s in sims.items():
                best[q, i] = max(best.get((q, i), -1e9), value(w, i, s))
            of_slug = {}
            for (q, i), s in best.items():
                of_slug.setdefault((q, f"s{i * 7 % 11}"), []).append((s, i))
            want = {}
            for q in {k[0] for k in of_slug}:
                scored = [((sum(s for s, _ in rows) / len(rows) if how == "mean" else max(rows)[0]), min(i for _, i in rows), slug) for (a, slug), rows in of_slug.items() if a == q]
                top = sorted(scored, key=lambda x: (-round(x[0], 9), x[1]))
                want[q] = ([slug for _, _, slug in top[:3]], max(0.0, top[0][0] - top[1][0]))
            found = {}
            for r in sorted(V.search(index, queries, 3, how, skip_self=True).collect(), key=lambda r: r["rank"]):
                found.setdefault(r.query, ([], r.margin))[0].append(r.slug)
            assert found.keys() == want.keys()
            for q in want:
                assert found[q][0] == want[q][0] and abs(found[q][1] - want[q][1]) < 1e-6, (how, q)
        near = {}
        for r in sorted(V.nearest_rows(index, queries, 4, skip_self=True).collect(), key=lambda r: r["rank"]):
            near.setdefault(r.window, []).append(r.row_id)
        assert near == {w: sorted((i for q, v, i in sims if v == w), key=lambda i, w=w: (-sims[f"q{w % 4}", w, i], i))[:4] for w in range(0, 40, 2)}


def test_scratch_on_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Held:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

    fake = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)


def test_text_columns_as_their_functions(spark):
    rng = random.Random(11)
    words = [None, "", "Шaтo", "tshchya", "quick", "Вино2019", "мoлoкo"] + ["".join(rng.choice("аеоршшЖxyzABCc19 -éй") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["".join(rng.choice("schzktyao") for _ in range(6)) for _ in range(200)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fold_homoglyphs("w").alias("a"), X.transcribe("w").alias("b")).collect()
    for r in rows:
        assert r.a == X.fold_homoglyphs_text(r.w), r.w
        assert r.b == X.transcribe_text(r.w), r.w


def test_weighted_fuzzy_join(spark):
    rng = random.Random(12)
    entries = ["".join(rng.choice("винодл0o1laе") for _ in range(rng.randrange(3, 14))) for _ in range(60)] + ["wo0oabc"]
    words = ["w0ooabc", *entries[:20]] + ["".join(rng.choice("винодл0o1laе") if rng.random() < 0.15 else c for c in e) for e in entries] + [None, ""]
    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {(r.word, r.norm): (r.edits, round(r.cost, 6)) for r in L.fuzzy_hits(one(words, "word"), one(entries, "norm").distinct(), weighted=True).collect()}

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    allowed = lambda n: 0 if n <= 3 else 0.5 if n <= 5 else 1 if n <= 8 else 1.5 if n <= 12 else 2
    want = {}
    for w in {w for w in words if w}:
        for e in set(entries):
            if (n := plain(w, e)) <= 2 and (cost := X.weighted_edits_text(w, e, 2.0)) <= allowed(len(e)):
                want[w, e] = (n, round(cost, 6))
    assert got == want and any(n > allowed(len(e)) for (_, e), (n, _) in want.items())


def test_weighted_edits_of_many_pairs(spark):
    rng = random.Random(13)
    made = lambda: "".join(rng.choice("rnmvwcliudьыио0o1 5sшщ") for _ in range(rng.randrange(0, 9)))
    pairs = [(made(), made()) for _ in range(600)]
    pairs += [(x, x.replace("m", "rn").replace("0", "o")) for x, _ in pairs] + [("", ""), ("a" * 40, "a" * 39)]
    for cutoff in (0.5, 2.0):
        want = [X.weighted_edits_text(x, y, cutoff) for x, y in pairs]
        got = X.weighted_edits_arrays([x for x, _ in pairs], [y for _, y in pairs], cutoff, block=100)
        assert np.allclose(got, want)
    rows = spark.createDataFrame([*pairs[:50], (None, "a"), ("a", None)], "a string, b string").select("a", "b", X.weighted_edits("a", "b").alias("c")).collect()
    for r in rows:
        assert (r.c is None) if r.a is None or r.b is None else r.c == pytest.approx(X.weighted_edits_text(r.a, r.b, 2.0))
