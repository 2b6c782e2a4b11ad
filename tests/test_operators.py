"""Operators that SQL can't express, and hand-made cases: nulls, empty tables, ties, repeated rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarflow.operators import entities as E
from cellarflow.operators import facets as C
from cellarflow.operators import lexicon as L
from cellarflow.operators import metrics as M
from cellarflow.operators import ranking as R
from cellarflow.operators import rules as U
from cellarflow.operators import text as X
from cellarflow.operators import vectors as V
from cellarflow.sources import files as S


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        step = [i]
        for j, y in enumerate(b, 1):
            step.append(min(row[j] + 1, step[-1] + 1, row[j - 1] + (x != y)))
        row = step
    return row[-1]


def test_rule_language(spark):
    df = spark.createDataFrame([(1, 0.0, ["a", "b"], None), (7, 2.0, [], "x")], "n int, d double, s array<string>, t string")
    names, sets = {c: F.col(c) for c in df.columns}, {"s"}
    value = lambda text: [r[0] for r in df.select(U.compile_rule(text, names, sets)).collect()]
    assert value("1 <= n < 5 or len(s & {'a'}) == 0") == [True, True]
    assert value("d != 0 and n / d > 3") == [False, True]  # lazily: no division by zero
    assert value("max(n, 3) + round(d, 1)") == [3.0, 9.0] and value("not n in {1, 2}") == [False, True]
    for bad in ("__import__('os')", "n.__class__", "s[0]", "lambda: 1", "open('x')", "n if d else 1", "n ** 2", "(n", "[x for x in s]", "unknown"):
        with pytest.raises(U.RuleError):
            U.compile_rule(bad, names, sets)
    with pytest.raises(Exception):
        value("n / d > 3")


def test_fuzzy_blocking_is_complete(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("абвгдеон") for _ in range(rng.randint(2, 15))) for _ in range(120)]
    words = []
    for name in names:
        word = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word)) if word else 0
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "ж", "а"])
        words.append("".join(word))
    got = {(r.word, r.norm): r.edits for r in L.fuzzy_hits(spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "word string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "norm string")).collect()}
    budget = lambda n: 0 if n <= 3 else 0.5 if n <= 5 else 1 if n <= 8 else 1.5 if n <= 12 else 2
    want = {(w, n): edits(w, n) for w in words for n in names if w and len(n) >= 3 and edits(w, n) <= budget(len(n))}
    assert got == want


def test_cer(spark):
    df = spark.createDataFrame([("мерло", "вино МЕРЛ о"), ("мерло", ""), (None, "x"), ("а б", "а в б")], "token string, text string").withColumn("text", F.lower("text"))
    assert [r.cer for r in L.best_cer(df, "token", "text").collect()] == [0.2, None, None, pytest.approx(1 / 3)]


def test_support_across_readings(spark):
    df = spark.createDataFrame([("q", "r1", "мерло"), ("q", "r2", "мерла"), ("q", "r2", "сира"), ("p", "r1", "мерло"), (None, "r1", None)], "g string, r string, n string")
    assert {(x.g, x.n): x.support for x in L.fuse_support(df, "g", "r", "n").collect()} == {("q", "мерло"): 2, ("q", "мерла"): 2, ("q", "сира"): 1, ("p", "мерло"): 1}


def test_text_functions(spark):
    assert X.label_norm_text("  Ёлка Й  Cuvée 12,5 % съ 3 / 4!") == "елка й cuvee 12,5 % с 3/4"
    assert X.fold_homoglyphs_text("шaтo") == "шато" and X.transcribe_text("Shato") == "шато"
    assert X.weighted_edits_text("rnerlo", "merlo", 2) == 0.4 and X.weighted_edits_text("abc", "xyz", 2) == math.inf and X.weighted_edits_text("мерло", "мepлo", 2) == 0.0
    df = spark.createDataFrame([("XIV", "a\nA\n\nb", "вина 2020"), ("IIX", None, None), ("", "one one one one one", "")], "t string, l string, s string")
    rows = df.select(X.roman_value("t").alias("v"), X.clean_lines("l").alias("c"), X.looks_looped("l").alias("o"), X.invented_numbers("s", F.lit("2019")).alias("i"), X.token_kind("t").alias("k")).collect()
    assert [r.v for r in rows] == [14, None, None] and rows[0].c == ["a", "b"] and rows[2].o and rows[0].i == ["2020"] and [r.k for r in rows] == ["roman", "word", "word"]
    spans = spark.createDataFrame([("d", 0, 2, 3, "aaa"), ("d", 1, 1, 1, "b"), ("d", 3, 3, 1, "c"), ("d", 2, 3, 2, "cc")], "k string, start int, end int, exact int, text string")
    assert sorted(r.text for r in X.greedy_phrases(spans, ["k"]).collect()) == ["aaa", "c"]
    assert {r.text for r in X.outermost(spans, ["k"]).collect()} == {"aaa", "cc"}
    words = spark.createDataFrame([("g", 1, "мерло"), ("g", 2, "мерла"), ("g", 3, "мурла"), ("g", 4, "сира")], "g string, i int, w string")
    assert [r.lead for r in sorted(X.cluster_unmatched(words, "g", "i", "w").collect(), key=lambda r: r.i)] == ["мерло", "мерло", "мурла", "сира"]


def test_reading_order(spark):
    box = lambda x, y: (x, y, x + 1.0, y + 1.0)
    rows = [("r", 1, box(5.0, 0.1)), ("r", 2, box(0.0, 0.0)), ("r", 3, None), ("r", 4, box(0.0, 3.0)), (None, 5, None)]
    df = spark.createDataFrame(rows, "g string, k int, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert [r.k for r in sorted(X.reading_order(df, "g", "k", "box").collect(), key=lambda r: r.place)] == [2, 1, 4, 3]


def test_listwise_fit_and_temperature(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q in range(200):
        x = rng.standard_normal((4, 2))
        p = np.exp(2 * x[:, 0])
        best = rng.choice(4, p=p / p.sum())
        rows += [(q, float(a), float(b), i == best) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "q int, a double, b double, y boolean")
    fitted = {w["name"]: w["coef"] / w["scale"] for w in R.fit_listwise(df, "q", ["a", "b"], "y", {"b": 1})}
    assert 1.4 < fitted["a"] < 2.7 and 0 <= fitted["b"] < 0.4
    t = R.fit_temperature(df.withColumn("s", 4 * F.col("a")), "q", "s", "y", steps=8)
    assert 1.2 < t < 3.2


def test_whitening(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4)) @ np.diag([3, 1, 1, 0.2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "i int, v array<double>")
    mean, matrix = V.pca_whitening(df, "v", alpha=0.5, shrink=0.0)
    assert np.allclose(np.cov(((x - mean) @ matrix).T, bias=True), np.eye(4), atol=1e-6)
    mapped = {r.i: r.mapped for r in V.apply_linear(df, "v", mean, matrix).collect()}
    assert mapped[999] is None and np.isclose(np.linalg.norm(mapped[0]), 1)


def test_alignment_guards_and_margin(spark):
    rows = [("q", 1, i, f"s{i}", 0, True, 0.5) for i in range(3)]
    sims = spark.createDataFrame(rows, "query string, window int, row_id int, slug string, view int, is_base boolean, sim double")
    assert {r.aligned for r in V.aligned(sims).collect()} == {0.5}
    one = spark.createDataFrame([("q", "a", 1.4, 0)], "query string, slug string, score double, view int")
    row = V.top_entities(one, 3, True).first()
    assert row.score == 1.0 and row.margin == 0.0


def test_metrics_on_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double, ok boolean")
    assert M.nearest_rank(empty, ["g"], "v", {"p50": 0.5}).count() == 0
    assert empty.agg(M.share(F.count_if("ok"), F.count("*")).alias("s"), M.rate(F.count_if("ok"), F.count("*")).alias("r")).first() == (None, 0.0)
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 5)] + [("a", None)], "g string, v double")
    assert M.nearest_rank(df, [], "v", {"p50": 0.5}).first().p50 == 3.0 and M.nearest_rank(df, [], "v", {"p50": 0.5}, True).first().p50 == 2.0
    boot = M.grouped_bootstrap(spark.createDataFrame([(i % 20, i % 4 != 0) for i in range(200)], "g int, ok boolean"), "g", "ok").first()
    assert boot.lo <= boot.accuracy == 0.75 <= boot.hi


def test_folds_and_components(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(12) for _ in range(i + 1)] + [(None,)], "g string")
    rows = E.group_folds(df, "g", 3).collect()
    load = [sum(r.n for r in rows if r.fold == f) for f in range(3)]
    assert len(rows) == 12 and max(load) - min(load) <= 3
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3)], "a int, b int")
    got = {r.node: r.component for r in E.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_fixes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, value string")
    fixes = spark.createDataFrame([(2, None, "b"), (3, "x", "y")], "k int, old string, new string")
    assert {r.k: r.value for r in E.apply_fixes(df, fixes, ["k"]).collect()} == {1: "a", 2: "b"}
    assert [r.k for r in E.unused_fixes(df, fixes, ["k"]).collect()] == [3]
    with pytest.raises(Exception, match="fix of another value"):
        E.apply_fixes(df, spark.createDataFrame([(1, "z", "b")], "k int, old string, new string"), ["k"]).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "a", "n": 1}\n\n{"q": "a", "n": 2}\nbroken\n{"n": 3}\n')
    good, problems = S.read_jsonl_with_problems(spark, str(tmp_path / "a.jsonl"), "q string, n int", "q")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and sorted(r.problem for r in problems.collect()) == ["no key", "not JSON", "repeated"]
    assert S.merge_patch_text('{"a": {"b": 1, "c": 2}}', '{"a": {"b": null}, "d": [1]}') == '{"a": {"c": 2}, "d": [1]}'
    with pytest.raises(Exception, match="key twice"):
        S.unique(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()
    for bad in ("../x", "/etc", ""):
        with pytest.raises(Exception, match="path not allowed"):
            S.checked_manifest(spark.createDataFrame([("a", bad)], "k string, p string"), "k", "p").collect()
    with pytest.raises(ValueError):
        S.model_from_json(S.model_to_json([], 2), 3)
    S.save_index(spark.createDataFrame([("s", "v", True, [1.0])], "slug string, view string, is_base boolean, vec array<double>"), str(tmp_path / "ix"), "m1")
    with pytest.raises(ValueError):
        S.load_index(spark, str(tmp_path / "ix"), "m2")


def test_agreement(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["a"], ["c"]), ([], ["c"]), (None, None)], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(C.agreement_sets(F.col("x"), F.col("y"))).collect()] == ["match", "conflict", "unknown", "unknown"]
    assert [r[0] for r in df.select(C.jaccard("x", "y")).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_global_order(spark):
    from cellarflow.operators.order import numbered, tiles

    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 7]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, i int").repartition(7)
    got = {r.i: (r.number, r.t) for r in numbered(df, ["v", "i"]).withColumn("t", tiles(F.col("number"), F.lit(500), 7)).collect()}
    parts = np.array_split(np.arange(500), 7)
    tile = {int(n): k + 1 for k, part in enumerate(parts) for n in part}
    assert {i: n for i, (n, _) in got.items()} == {i: n for n, (_, i) in enumerate(sorted(rows))}
    assert all(t == tile[n] for n, t in got.values())
    assert numbered(df.limit(0), ["v", "i"]).count() == 0


def test_routes(spark):
    from cellarflow.operators import chat as H

    rows = [("a", 1, "Привет!"), ("a", 2, "Я беременна"), ("a", 3, "что к рыбе?"), ("b", 1, "что к рыбе?"), ("b", 2, None), ("b", 3, "hm")]
    df = spark.createDataFrame(rows, "u string, t int, q string")
    got = {(r.u, r.t): r.route for r in H.routed(df, "u", ["t"], "q").collect()}
    assert got == {("a", 1): "hello", ("a", 2): "pregnancy", ("a", 3): "pregnancy", ("b", 1): "dish", ("b", 2): "unknown", ("b", 3): "unknown"}
    words = spark.createDataFrame([("d", i, w) for i, w in enumerate("вредит ваше чрезмерное употребление".split())], "d string, i int, w string")
    assert H.near_words(words, ["d"], "i", "w", ["употребление"], ["вредит"], 3).count() == 1 and H.near_words(words, ["d"], "i", "w", ["употребление"], ["вредит"], 2).count() == 0


def test_registry(spark):
    from cellarflow.functions import registry as G

    df = spark.createDataFrame([("a\n\n b",), (None,), ("",)], "t string")
    assert [r.lines for r in G.read_lines(df, "t", "lines").collect()] == [["a", "b"], None, []]
    vectors = [r.vec for r in G.embed(df, "t", "letters").collect()]
    assert vectors[1] is None and abs(sum(x * x for x in vectors[0]) - 1) < 1e-9
    with pytest.raises(ValueError):
        G.register_reader("lines", str.split)


def test_layered_rules_and_first_match(spark):
    base = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y"), ("c", 3.0, "z")], "id string, weight double, text string")
    none = base.limit(0)
    over, patch = base.where("id = 'b'").withColumn("weight", F.lit(9.0)), spark.createDataFrame([("c", None, "patched")], "id string, weight double, text string")
    got = {r.id: (r.weight, r.text) for r in U.layered_rules(base, over, patch, ["a"], spark.createDataFrame([("n", 0.0, "new")], "id string, weight double, text string")).collect()}
    assert got == {"b": (9.0, "y"), "c": (3.0, "patched"), "n": (0.0, "new")}
    with pytest.raises(Exception, match="rule twice"):
        U.layered_rules(base, none, none, [], base.where("id = 'a'")).collect()
    rules = spark.createDataFrame([(2, "any", None, None), (1, "big x", "x", 5)], "ord int, rule string, kind string, least int")
    rows = spark.createDataFrame([(1, "x", 9), (2, "x", 1), (3, None, None)], "k int, kind string, size int")
    assert {r.k: r.rule for r in U.first_rule(rows, "k", rules, ["kind"], {"size": "least"}).collect()} == {1: "big x", 2: "any", 3: "any"}
