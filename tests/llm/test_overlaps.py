import random

from cellarflow.llm.overlaps import overlap_counts, split_overlaps, weighted_cosine_join
from cellarflow.operators.skew import salted_join

FRAMES = "frame_id long, query_id string, set_name string, source string, slug string, dhash string"


def test_against_all_pairs(spark):
    rng = random.Random(6)
    hashes = [rng.getrandbits(64) for _ in range(12)]
    frames, digests = [], {}
    for i in range(260):
        h = rng.choice(hashes)
        for _ in range(rng.randint(0, 9)):
            h ^= 1 << rng.randrange(64)
        dress = rng.choice([str, str.upper, lambda x: x + " ", lambda x: x.replace("-", "_")])
        frames.append((i, f"q{i}", rng.choice(["train", "TRN ", "val", "Test", "", None, "holdout"]), rng.choice(["a", "b"]), dress(rng.choice(["x-y", "x-z"])) if rng.random() > 0.1 else None, f"{h:016x}" if rng.random() > 0.1 else None))
        if rng.random() > 0.3:
            digests[i] = f"{rng.randrange(40):064x}"
    sent = [(f"q{i}", rng.choice(["sha256:" + x, x.upper(), x + "\n", " ".join(x[k : k + 8] for k in range(0, 64, 8)), ":".join(x[k : k + 2] for k in range(0, 64, 2))])) for i, x in digests.items()]
    sent += sent[:30] + [("q1", None), (None, "0x" + "0" * 64), ("q2", "zz")]
    f = spark.createDataFrame([*frames, (999, "q999", "train", None, None, None)], FRAMES)
    p = spark.createDataFrame(sent, "query_id string, image_sha256 string")
    side = {"train": "t", "trn": "t", "val": "e", "test": "e", "holdout": "e"}
    want = set()
    for a in frames:
        for b in frames:
            if side.get((a[2] or "").strip().lower()) == "t" and side.get((b[2] or "").strip().lower()) == "e":
                same = a[0] in digests and digests[a[0]] == digests.get(b[0])
                slug = lambda x: x and x.strip().lower().replace("_", "-")
                near = a[4] and slug(a[4]) == slug(b[4]) and a[5] and b[5] and (int(a[5], 16) ^ int(b[5], 16)).bit_count() <= 6
                if same or near:
                    want.add((a[0], b[0]))
    found = split_overlaps(f, p)
    assert set(found.select("train_id", "eval_id").collect()) == want and found.count() == len(want) > 100
    assert sum(r.n_pairs for r in overlap_counts(found, f).collect()) == len(want)
    assert split_overlaps(f.limit(0), p).count() == 0 and split_overlaps(f, p.limit(0)).count() > 0


def test_weighted_vectors(spark):
    rng = random.Random(8)

    def vectors(n):
        rows = []
        for i in range(n):
            terms = rng.sample("abcdefghij", rng.randint(1, 6))
            raw = [rng.random() for _ in terms]
            norm = sum(x * x for x in raw) ** 0.5
            rows.append((i, terms, [x / norm for x in raw], 0.7))
        return rows

    a, b = vectors(60), vectors(50)
    schema = "id long, terms array<string>, weights array<double>, least double"
    got = {(r.id_a, r.id_b): r.dot for r in weighted_cosine_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), []).collect()}
    want = {(x[0], y[0]): sum(w * dict(zip(y[1], y[2])).get(t, 0) for t, w in zip(x[1], x[2])) for x in a for y in b}
    want = {k: v for k, v in want.items() if v >= 0.7}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_salted(spark):
    left = spark.createDataFrame([(i, "hot" if i < 90 else None if i < 95 else f"k{i}") for i in range(120)], "id long, k string")
    right = spark.createDataFrame([(i, "hot" if i < 40 else f"k{i + 60}") for i in range(60)], "other long, k string")
    want = sorted(map(tuple, left.join(right, "k").select("id", "other").collect()))
    assert sorted(map(tuple, salted_join(left, right, "k", "id", 100).select("id", "other").collect())) == want
