import numpy as np
import pytest

from cellarflow.llm.neighbours import balanced_parts, nearest, neighbour_graph, unit_rows


def exact(rows, k):
    """Ids, cosines: all against all in doubles."""
    ids = np.array([i for i, _ in rows])
    unit = unit_rows(np.array([v for _, v in rows], np.float32))
    scores = np.round(unit @ unit.T, 12)
    np.fill_diagonal(scores, -3)
    out = {}
    for n, i in enumerate(ids):
        order = np.lexsort((ids, -scores[n]))[: min(k, len(ids) - 1)]
        out[int(i)] = [(int(ids[m]), float(scores[n, m])) for m in order]
    return out


def clustered(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    return (centres[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float16).astype(np.float32)


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append((r.other, r.score))
    return out


def test_exact_when_all_parts_are_searched(spark):
    vectors = clustered(300, 1)
    rows = [(i + 1, vectors[i].tolist()) for i in range(300)]
    rows += [(500 + i, vectors[0].tolist()) for i in range(25)] + [(600, vectors[3].tolist()), (601, (2 * vectors[3]).tolist())]
    extra = [(900, None), (901, [0.0] * 16), (902, []), (903, [float("nan")] * 16), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + extra], "id long, vec array<float>, score string")
    got, want = got_of(nearest(df, "id", "vec", part_rows=40)), exact(rows, 10)
    assert got.keys() == want.keys()
    for i in want:
        assert [o for o, _ in got[i]] == [o for o, _ in want[i]], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in want[i]])
    assert nearest(df.where("id > 899"), "id", "vec").count() == 0
    assert got_of(nearest(df.where("id <= 4"), "id", "vec"))[1].__len__() == 3


def test_recall(spark):
    vectors = clustered(4000, 2)
    rows = [(i, vectors[i].tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got, want = got_of(nearest(df, "id", "vec", sample=2000, part_rows=50)), exact(rows, 10)
    hits = sum(len({o for o, _ in got[i]} & {o for o, _ in want[i]}) for i in want)
    assert hits >= 0.93 * 40_000 and all(len(v) == 10 for v in got.values())


def test_balance():
    unit = unit_rows(clustered(2000, 3))
    graph = neighbour_graph(unit)
    label = balanced_parts(unit, graph, 20)
    assert np.bincount(label, minlength=20).max() <= 115
    assert (label[graph] == label[:, None]).mean() > 0.6


@pytest.mark.parametrize("block", [64])
def test_blocks(spark, monkeypatch, block):
    import cellarflow.llm.neighbours as module

    monkeypatch.setattr(module, "BASE_BLOCK", block)
    monkeypatch.setattr(module, "QUERY_BLOCK", 2 * block)
    vectors = clustered(300, 4)
    rows = [(i, vectors[i].tolist()) for i in range(300)]
    got = got_of(nearest(spark.createDataFrame(rows, "id long, vec array<float>"), "id", "vec", part_rows=1000))
    want = exact(rows, 10)
    assert {i: [o for o, _ in v] for i, v in got.items()} == {i: [o for o, _ in v] for i, v in want.items()}


def test_two_levels(spark):
    vectors = clustered(4000, 2)
    rows = [(i, vectors[i].tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got, want = got_of(nearest(df, "id", "vec", sample=2000, part_rows=50, most_parts=8)), exact(rows, 10)
    hits = sum(len({o for o, _ in got[i]} & {o for o, _ in want[i]}) for i in want)
    assert hits >= 0.9 * 40_000 and all(len(v) == 10 for v in got.values())


def test_each_length_by_itself(spark):
    a, b = clustered(60, 5), clustered(40, 6, dim=7) + np.float32(1e-6)  # not exact in half precision
    rows = [(i, a[i].tolist()) for i in range(60)], [(100 + i, b[i].tolist()) for i in range(40)]
    got = got_of(nearest(spark.createDataFrame([*rows[0], *rows[1], (200, [1.0, 2.0])], "id long, vec array<float>"), "id", "vec", part_rows=10))
    want = exact(rows[0], 10) | exact(rows[1], 10)
    found = sum(len({o for o, _ in got[i]} & {o for o, _ in want[i]}) for i in want)
    assert set(got) == set(want) and found >= 0.95 * sum(map(len, want.values()))
    assert all(abs(dict(got[i])[o] - s) < 1e-9 for i in want for o, s in want[i] if o in dict(got[i]))
