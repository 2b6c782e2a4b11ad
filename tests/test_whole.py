"""Queries that have to answer for whole tables: against brute force, on small tables that hold what a cut would lose."""

import itertools
import math

from cellarflow.plans import facets as P
from cellarflow.plans import ranking as K
from cellarflow.plans import scans as I
from cellarflow.plans import words as W


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_forms_of_all_words(spark, tmp_path):
    texts = ["вино вина винам виноград", "Вино, вины", "дом дома домами стол столы столами", "сухое сухого суховатый", "abc abcd abce abcdefg abcdefgh ab", None, ""]
    d = tables(spark, tmp_path, documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))

    def match(a, b):  # words_match of one pair
        n = min(len(a), len(b))
        stem = min(5, max(n - 1, 3))
        return n >= 4 and a[:stem] == b[:stem] and abs(len(a) - len(b)) <= 3

    words = sorted({w for t in texts if t for w in t.lower().replace(",", "").split()})
    got = [tuple(r) for r in W.tx15_forms(spark, d).select("a", "b").collect()]
    assert sorted(got) == [p for p in itertools.combinations(words, 2) if match(*p)] and ("вина", "вино") in got


def test_dish_check_of_all_suppliers(spark, tmp_path):
    parts = [(k, f"Brand#{k % 2}", ("PROMO", "SMALL", "ECONOMY")[k % 3], k * 7 % 50 + 1, 900.0 + k * 13 % 17) for k in range(1, 61)]  # few prices: many ties
    dishes = [(k, k % 9, 4400.0 + k * 41 % 700 if k % 4 else -5.0) for k in range(1, 25)]
    d = tables(spark, tmp_path, part=(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double"), supplier=(dishes, "s_suppkey long, s_nationkey int, s_acctbal double"))
    verdicts = {(r.p_partkey, r.s_suppkey): r.verdict for r in P._verdicts(spark, d).collect()}
    want = set()
    for s, *_ in dishes:
        for a, brand, _, _, price in parts:
            if verdicts[a, s] == "no":
                good = sorted((abs(price - p), k) for k, b, _, _, p in parts if b == brand and verdicts[k, s] == "yes")
                want |= {(s, a, k, i) for i, (_, k) in enumerate(good[:2], 1)}
    got = [tuple(r) for r in P.so17_dish_check(spark, d).select("s_suppkey", "asked", "p_partkey", "place").collect()]
    assert len(got) == len(want) and set(got) == want and any(s >= 10 for s, *_ in want)


def test_rules_of_all_parts_and_log_of_all_events(spark, tmp_path):
    parts = [(k, "red hat" if k % 9 == 0 else f"hat {k}", k % 50 + 1) for k in range(1, 101)]
    events = [(i, ("view", "click", "purchase", "signup", "error", None)[i % 6]) for i in range(30)]
    d = tables(spark, tmp_path, part=(parts, "p_partkey long, p_name string, p_size int"), events=(events, "event_id long, event_type string"))
    want = {f"r{k}": (1.0 if size > 40 else float(size), "patched" if name[:3] == "red" else "over" if size > 40 else name) for k, name, size in parts if k > 2}
    rules = I.io19_layered_rules(spark, d).collect()
    assert {r.id: (r.weight, r.text) for r in rules} == want | {"n1": (5.0, "new")} and len(rules) == 99
    log = {r.event_type: (r.n, r.last) for r in I.io14_append_log(spark, d).collect()}
    assert log == {kind: (5, 24 + i) for i, kind in enumerate(("view", "click", "purchase", "signup", "error", None))}


def test_negation_of_all_words(spark, tmp_path):
    texts = ["не сладкое вино, сухое", "шашлыка у нас совсем нет", "борща сегодня не будет; рыба есть", "без сахара: вино", "один два три четыре пять нет", None]
    d = tables(spark, tmp_path, documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r.w: (r.n, r.negated) for r in W.wn12_negation(spark, d).collect()}
    negated = {"сладкое", "вино", "шашлыка", "у", "нас", "совсем", "борща", "сегодня", "сахара", "два", "три", "четыре", "пять", "будет"}
    assert {w for w, (_, k) in got.items() if k} == negated and got["вино"] == (2, 1)
    assert set(got) == {w for t in texts if t for w in t.replace(",", "").replace(";", "").replace(":", "").split()}


def test_temperature_is_the_best(spark, tmp_path):
    lines = [(q, q * 7 + i, 1, i, float((q * 5 + i * 11) % 13), 100.0 * ((q * 5 + i * 11) % 13 + (q + i) * 3 % 8), 0.0, 0.0) for q in range(40) for i in range(1, 6)]
    d = tables(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"))
    queries = [[(x[4], x[5]) for x in lines if x[0] == q] for q in range(40)]

    def loss(log_t):
        ones = []
        for rows in queries:
            total = sum(math.exp(s / math.exp(log_t)) for s, _ in rows)
            ones += [math.log(total) - s / math.exp(log_t) for s, y in rows if y == max(y for _, y in rows)]
        return sum(ones) / len(ones)

    a, b = math.log(0.05), math.log(20)
    for _ in range(100):
        c, e = a + (b - a) / 3, b - (b - a) / 3
        a, b = (a, e) if loss(c) < loss(e) else (c, b)
    got = K.ma11_temperature(spark, d).first().temperature
    assert 0.1 < got < 19 and abs(got / math.exp(a) - 1) < 1e-4
