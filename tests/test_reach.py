"""Queries over the matrix of parts and suppliers that don't make it: against brute force, on numbers at the edge of reach."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cellarflow.operators.nearest import BAD, GOOD, two_nearest
from cellarflow.operators.reach import near_and_far
from cellarflow.plans import facets as P

ODD = [None, math.nan, math.inf, -math.inf]


def around(x, width):
    """Numbers at the distance of width from x, and those beside them."""
    found = []
    for at in (x - width, x + width):
        down = up = at
        for _ in range(3):
            found += [down, up]
            down, up = math.nextafter(down, -math.inf), math.nextafter(up, math.inf)
    return found


@pytest.mark.parametrize("width", [1000, 7])
def test_near_and_far(spark, width):
    rng = random.Random(width)
    asked = [0.0, 1000.0, 1e-300, 999.9999999999999, 3500.1, 7506.15, 8191.999, -0.1, 5e-8 + 1000, *[rng.uniform(-4, 12) * width for _ in range(20)]]
    values = [v for x in asked for v in around(x, width)] + [rng.uniform(-6, 14) * width for _ in range(60)]
    rng.shuffle(values)
    points = [(("a", "b", None)[i % 3], v, i) for i, v in enumerate(values + ODD * 3)] + [("c", None, 9001), ("d", 5.0, 9002)]
    got = {(r.q if r.q is None or r.q == r.q else "nan", r.g): (r.near, r.far) for r in near_and_far(spark.createDataFrame([(x,) for x in asked + ODD], "q double"), spark.createDataFrame(points, "g string, v double, payload long"), width).collect()}
    want = {}
    for x in asked + ODD:
        for g in ("a", "b", "c", "d", None):
            near = {p for h, v, p in points if h == g and v is not None and x is not None and abs(x - v) < width}
            far = {p for h, _, p in points if h == g} - near
            want[x if x is None or x == x else "nan", g] = (min(near, default=None), min(far, default=None))
    assert got == want
    assert near_and_far(spark.createDataFrame([], "q double"), spark.createDataFrame(points, "g string, v double, payload long"), width).count() == 0


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    """A folder with parts and suppliers, nulls, equal keys and prices at the edge among them, and their judged pairs."""
    rng = random.Random(3)
    parts = [(k // 2 if k < 6 else k, f"Brand#{k % 2}", rng.choice(["PROMO", "SMALL", "LARGE", None]), rng.choice([None, *range(1, 51)]), rng.choice([None, 900.1, 901.23, 1501.23, 1700.0, 2050.5])) for k in range(90)] + [(None, "Brand#1", "PROMO", 3, 900.1), (None, "Brand#1", "SMALL", 45, 1700.0)]
    prices = sorted({x[4] for x in parts if x[4]})
    edge = [v for x in prices for v in around(x * 5, 1000)]
    dishes = [(k, rng.choice([None, *range(25)]), rng.choice([None, -5.0, rng.uniform(-900, 9900), rng.choice(edge), rng.choice(edge)])) for k in range(160)] + [(None, 3, 5000.0), (7, 3, 4400.0), (161, 33, -5.0)]
    d = str(tmp_path_factory.mktemp("matrix"))
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(dishes, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return d, P._verdicts(spark, d).select("p_partkey", "s_suppkey", "s_nationkey", "total", "verdict").collect()


@pytest.fixture
def no_matrix(monkeypatch):
    """Pairs of all parts with all suppliers fail: at 60 times sf0.1 they are 72 thousand million."""

    def refuse(*_):
        raise AssertionError("the matrix is made")

    monkeypatch.setattr(P, "_crossed", refuse)


def test_goes_with(spark, matrix, no_matrix):
    d, pairs = matrix
    want = {r.p_partkey for r in pairs if r.verdict == "yes" and r.s_nationkey == 3}
    got = [r.p_partkey for r in P.jn11_goes_with(spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and None in want and len(want) < 89


def test_top_dishes(spark, matrix, no_matrix):
    d, pairs = matrix
    last = lambda r: (-r.total, r.s_suppkey is None, r.s_suppkey or 0)
    best = {}
    for r in sorted((r for r in pairs if r.verdict == "yes"), key=last):
        best.setdefault(r.p_partkey, {}).setdefault(r.s_nationkey, r)
    want = {(p, r.s_suppkey, i) for p, nations in best.items() for i, r in enumerate(sorted(nations.values(), key=last)[:5], 1)}
    got = [tuple(r) for r in P.so08_top_dishes(spark, d).select("p_partkey", "s_suppkey", "place").collect()]
    assert len(got) == len(want) and set(got) == want and any(p is None for p, *_ in want)


def test_group_verdict(spark, matrix, no_matrix):
    d, pairs = matrix
    best = {}
    for r in pairs:
        at = ("yes", "caveat", "neutral", "no").index(r.verdict)
        best[r.p_partkey, r.s_nationkey] = min(at, best.get((r.p_partkey, r.s_nationkey), at))
    want = Counter(best.values())
    assert {r.best: r.n for r in P.ag45_group_verdict(spark, d).collect()} == want and len(want) == 4


def test_dish_check(spark, tmp_path, no_matrix):
    rng = random.Random(8)
    parts = [(k, rng.choice(["Brand#1", "Brand#2", None]), rng.choice(["PROMO", "SMALL", None]), rng.choice([None, *range(1, 51)]), rng.choice([None, 900.1, 901.23, 1501.23, 1700.0, 2050.5])) for k in range(70)]
    parts += [(90, "Brand#3", "SMALL", 3, 900.0), (91, "Brand#3", "PROMO", 4, None), (92, "Brand#3", "PROMO", 4, 1000.0), (93, "Brand#3", "PROMO", 4, None), (94, "Brand#3", "SMALL", 3, None)]
    edge = [v for x in sorted({x[4] for x in parts if x[4]}) for v in around(x * 5, 1000)]
    dishes = [(k, rng.choice([None, *range(25)]), v) for k, v in enumerate([None, -5.0, *edge, *(rng.uniform(-900, 9900) for _ in range(40))])] + [(None, 3, 5000.0), (900, 3, 9000.0), (901, 3, 9000.0)]
    d = str(tmp_path)
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(dishes, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    pairs = [(*p, *s) for p in parts for s in dishes]
    frame = spark.createDataFrame(pairs, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double, s_suppkey long, s_nationkey int, s_acctbal double")
    verdicts = {(r.p_partkey, r.s_suppkey): r.verdict for r in P._judged(P.R.score_rules(frame, P._rules())).select("p_partkey", "s_suppkey", "verdict").collect()}
    gap = lambda a, b: (1, 0) if a is None or b is None else (0, abs(a - b))
    want = set()
    for s, *_ in dishes:
        for a, brand, _, _, price in parts:
            if s is not None and brand and verdicts[a, s] == "no":
                good = sorted((gap(price, p), k) for k, b, _, _, p in parts if b == brand and verdicts[k, s] == "yes")
                want |= {(s, a, k, i) for i, (_, k) in enumerate(good[:2], 1)}
    got = [tuple(r) for r in P.so17_dish_check(spark, d).select("s_suppkey", "asked", "p_partkey", "place").collect()]
    assert len(got) == len(want) and set(got) == want and {(900, 90, 92, 1), (900, 90, 91, 2), (901, 94, 91, 1), (901, 94, 92, 2)} <= want


def test_two_nearest(spark):
    """Equal, missing and infinite prices, and such that lie equally far only as rounded, in blocks of one share and of several."""
    rng = random.Random(5)
    close = [1000.5, 0.1, math.nextafter(0.1, 1), math.nextafter(0.1, 0), 0.2, 5000.25, -3.0]
    rows = [(f"b{b}", None if k == 3 else 1000 * b + k * 7 % 90, rng.choice(close if b < 3 else [900.0, 901.5, 907.25, *ODD] if b < 5 else [float(k), None]), rng.uniform(0, 9), rng.randrange(4)) for b in range(7) for k in range(90 if b < 4 else 8)]
    rows += [("hot", 9000 + k, rng.choice([rng.uniform(900, 2000), 950.0]), rng.uniform(0, 9), rng.randrange(4)) for k in range(500)]
    bands = [(rng.randrange(3), *sorted((rng.uniform(0, 9), rng.uniform(0, 9)))) for _ in range(12)] + [(1, math.nan, math.nan)]
    verdicts = np.array([[[rng.choice([0, BAD, BAD, GOOD]) for _ in range(4)] for _ in range(2)] for _ in range(3)], np.int8)
    groups = {"number": np.arange(len(bands)) + 50, "code": np.array([g[0] for g in bands]), "first": np.array([g[1] for g in bands]), "last": np.array([g[2] for g in bands])}

    def far(a, b):
        gap = None if a is None or b is None else abs(a - b)
        return (2, 0) if gap is None else (1, 0) if gap != gap else (0, gap)

    want = set()
    for i, (code, low, high) in enumerate(bands):
        judged = [(*r, verdicts[code][int(low <= r[3] <= high)][r[4]]) for r in rows]
        for block, key, price, *_, bad in judged:
            good = sorted((far(price, r[2]), r[1] is None, r[1] or 0) for r in judged if r[0] == block and r[5] == GOOD) if bad == BAD else []
            want |= {(i + 50, key, None if none else near, place) for place, (_, none, near) in enumerate(good[:2], 1)}
    frame = spark.createDataFrame(rows, "block string, key long, price double, value double, code int")
    for tasks in (1, 6):
        got = [tuple(r) for r in two_nearest(frame, groups, verdicts, tasks).select("number", "asked", "near", "place").collect()]
        assert not sorted(set(got) ^ want, key=str)[:6] and len(got) == len(want) > 3000


def test_dish_check_moves_no_pairs(spark, tmp_path):
    """At 60 times sf0.1 the pairs of parts and groups of dishes filled the disk."""
    rng = random.Random(4)
    parts = [(k, f"Brand#{k % 3}", rng.choice(["PROMO", "SMALL"]), rng.randrange(1, 51), 900.0 + k) for k in range(300)]
    dishes = [(k, k % 25, 3600.0 + 11 * k) for k in range(200)]  # each in reach of other prices
    d = str(tmp_path)
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(dishes, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    sc = spark.sparkContext._jsc.sc()

    def moved():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return {(s.stageId(), s.attemptId()): max(s.shuffleWriteRecords(), s.outputRecords()) for s in stages}

    before = moved()
    n = P.so17_dish_check(spark, d).count()
    after = moved()
    assert n > 4000 and sum(v for k, v in after.items() if k not in before) < 20 * (len(parts) + len(dishes))
