"""The k most similar vectors of every vector, by learned partitions.

On a bounded sample the exact neighbour graph is cut into balanced parts; a small classifier learns from it which part
a vector and its neighbours lie in. Every vector is then indexed in its most probable part, routed as a query to the
most probable ones until they hold nearly all of the probability, and reranked exactly there. Where one classifier
can't have a part for every PART_ROWS vectors, each of its parts gets a classifier of its own, fitted on a bounded
sample of the part. Parts that are larger than a block are cut, queries too, so no task holds more than one block of
each, and equal vectors are searched once, however many rows have them. Vectors travel as half-precision numbers where
that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.operators.skew import salted_join
from cellarflow.session import Scratch

SAMPLE = 20_000  # vectors that graph and classifier are fitted on, by the hash of their ids
PART_ROWS = 500  # vectors a part has on average
MOST_PARTS = 512  # of one classifier; more parts take a second level
PART_SAMPLE = 5_000  # vectors of a part that a classifier of the second level is fitted on, by the hash of their ids
PROBES, LEAST_PROBES = 20, 8  # parts a query is sent to at most and at least,
MASS = 0.95  # between them until they have so much of the probability
BASE_BLOCK, QUERY_BLOCK = 4_096, 8_192
SPARE = 6  # candidates beyond k that are scored exactly


def unit_rows(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def neighbour_graph(unit: np.ndarray, k: int = 10) -> np.ndarray:
    """Indices of the k nearest rows of each row, itself left out."""
    unit = unit.astype(np.float32)
    out = np.zeros((len(unit), min(k, len(unit) - 1)), np.int64)
    for a in range(0, len(unit), 1000):
        scores = unit[a : a + 1000] @ unit.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -2
        out[a : a + 1000] = _top(scores, out.shape[1])
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 10) -> np.ndarray:
    """A part for each row, of nearly equal sizes, with few graph edges between parts.

    Begins with cuts at quantiles along principal directions; then rows move to the part of most of their neighbours,
    those that gain most first, as long as the part has room.
    """
    label = np.zeros(len(unit), np.int64)
    stack = [(np.arange(len(unit)), 0, parts)]
    rng = np.random.default_rng(11)
    while stack:
        rows, first, count = stack.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        centred = unit[rows] - unit[rows].mean(0)
        direction = rng.standard_normal(unit.shape[1])
        for _ in range(12):
            direction = centred.T @ (centred @ direction)
            direction /= max(np.linalg.norm(direction), 1e-12)
        order = rows[np.argsort(centred @ direction, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        stack += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    room = int(np.ceil(slack * len(unit) / parts))
    rows = np.arange(len(unit))
    for _ in range(rounds):
        counts = np.zeros((len(unit), parts), np.float32)
        np.add.at(counts, (np.repeat(rows, graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(counts, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        want = counts.argmax(1)
        gain = counts[rows, want] - counts[rows, label]
        movers = np.flatnonzero(gain > 0)
        if not len(movers):
            break
        movers = movers[np.lexsort((-gain[movers], want[movers]))]
        target = want[movers]
        start = np.searchsorted(target, target)
        free = np.maximum(room - np.bincount(label, minlength=parts), 0)
        movers = movers[np.arange(len(movers)) - start < free[target]]
        label[movers] = want[movers]
    return label


def fit_router(unit: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, steps: int = 120, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of a softmax classifier of the part of a row and its neighbours; begins at the parts' means."""
    centre = np.zeros((parts, unit.shape[1]))
    np.add.at(centre, label, unit)
    size = np.maximum(np.bincount(label, minlength=parts), 1)[:, None]
    centre /= size
    weight = (10.0 * centre).astype(np.float32)
    offset = (-5.0 * (centre**2).sum(1)).astype(np.float32)
    rng = np.random.default_rng(12)
    unit = unit.astype(np.float32)
    m1, m2 = [np.zeros_like(weight), np.zeros_like(offset)], [np.zeros_like(weight), np.zeros_like(offset)]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(unit), min(batch, len(unit)))
        logits = unit[at] @ weight.T + offset
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        k = graph.shape[1]
        rows = np.arange(len(at))
        np.add.at(p, (rows, label[at]), -0.5)
        np.add.at(p, (np.repeat(rows, k), label[graph[at]].ravel()), -0.5 / k)
        p /= len(at)
        for i, (value, slope) in enumerate(((weight, p.T @ unit[at]), (offset, p.sum(0)))):
            m1[i] = 0.9 * m1[i] + 0.1 * slope
            m2[i] = 0.999 * m2[i] + 0.001 * slope**2
            value -= 0.05 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return weight, offset


@dataclass
class Router:
    weight: np.ndarray
    offset: np.ndarray
    probes: int

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most probable parts of each row, the most probable first, and the logarithms of their probabilities."""
        logits = unit.astype(np.float32) @ self.weight.T + self.offset
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        top = _top(logits, self.probes)
        order = np.argsort(-np.take_along_axis(logits, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        return top, np.take_along_axis(logits, top, 1)


def enough(log_p: np.ndarray, mass: float = MASS) -> np.ndarray:
    """Which of the parts, the most probable first, a row is sent to: LEAST_PROBES, and those before which ``mass`` isn't reached."""
    p = np.exp(log_p)
    return (np.cumsum(p, axis=1) - p < mass) | (np.arange(p.shape[1]) < LEAST_PROBES)


def _encode(rows: np.ndarray) -> pa.Array:
    """Rows of single-precision numbers as bytes, in half precision where that is exact."""
    with np.errstate(over="ignore"):
        half = rows.astype(np.float16)
    exact = (half.astype(np.float32) == rows).all(1)
    return pa.array([h.tobytes() if e else r.tobytes() for h, r, e in zip(half, rows, exact)], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of bytes, single or half precision by their length, as a matrix."""
    raw = column.to_pylist()
    half = np.array([len(r) == 2 * dim for r in raw], bool)
    out = np.empty((len(raw), dim), np.float32)
    out[half] = np.frombuffer(b"".join(r for r, h in zip(raw, half) if h), np.float16).reshape(-1, dim)
    out[~half] = np.frombuffer(b"".join(r for r, h in zip(raw, half) if not h), np.float32).reshape(-1, dim)
    return out


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, raw): the vectors that can be compared, as bytes of floats: not null, not all zero, every number finite."""
    source = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v, np.float32) if v is not None else np.zeros(0, np.float32) for v in (batch.column(1).to_pylist())]
            keep = [i for i, v in enumerate(rows) if len(v) and np.isfinite(v).all() and v.any()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([(rows[i] + 0.0).tobytes() for i in keep], pa.binary())], ["id", "raw"])

    return source.mapInArrow(pack, "id long, raw binary")


def fit_parts(unit: np.ndarray, parts: int) -> Router:
    """The classifier of balanced parts of the neighbour graph of ``unit``; one part if that is all, or too few rows."""
    parts = int(np.clip(parts, 1, max(1, len(unit) // 20)))
    if parts == 1:
        return Router(np.zeros((1, unit.shape[1]), np.float32), np.zeros(1, np.float32), 1)
    graph = neighbour_graph(unit)
    return Router(*fit_router(unit, graph, balanced_parts(unit, graph, parts), parts), min(parts, PROBES))


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, sample: int = SAMPLE, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS) -> DataFrame:
    """(id, other, score, rank): the k vectors of highest cosine to each vector, equal cosines by the smaller id.

    Null, empty, all-zero and not finite vectors take no part; vectors of different lengths are not compared, each
    length is searched by itself. A vector has fewer than k rows only if there are no more others that it was compared
    with. Rows stored twice are each other's neighbours of score 1. Ids are unique. An empty table gives no rows.
    Approximate: see the README for the measured recall.
    """
    scratch = Scratch(df.sparkSession, "nearest")
    cleaned = scratch.save(clean_vectors(df, key, vector).withColumn("sig", F.sha2("raw", 256)), "cleaned")
    # equal vectors: all of a group are found through the smallest id, of which the first k + 1 members are enough
    ordered = Window.partitionBy("sig").orderBy("id")
    first = cleaned.withColumn("n", F.row_number().over(ordered)).where(F.col("n") <= k + 1)
    distinct = scratch.save(first.groupBy("sig").agg(F.min("id").alias("id"), F.min("raw").alias("raw"), F.array_sort(F.collect_list("id")).alias("members")), "distinct")
    sizes = {r["size"]: r["count"] for r in distinct.groupBy((F.length("raw") / 4).cast("int").alias("size")).count().collect()}
    lists = None
    for dim, n in sorted(sizes.items()):
        one = _search(distinct.where(F.length("raw") == 4 * dim).select("id", "raw"), dim, n, k, sample, part_rows, most_parts, Scratch(df.sparkSession, f"nearest-{dim}"))
        lists = one if lists is None else lists.unionByName(one)
    if lists is None:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), T.StructField("other", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    several = distinct.where(F.size("members") > 1).select(F.col("id").alias("other"), "members")
    spelled = lists.select("id", F.explode("best").alias("x")).select("id", F.col("x.score").alias("score"), F.col("x.other").alias("other")).join(several, "other", "left")
    found = spelled.select("id", "score", F.explode(F.coalesce("members", F.array("other"))).alias("other"))
    own = distinct.where(F.size("members") > 1).select("id", F.lit(1.0).alias("score"), F.explode("members").alias("other"))
    entries = found.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("negative"), F.col("other")))).alias("all"))
    # rows by the vector they hold; a vector that is stored often is cut into parts
    reps = distinct.select(F.col("id").alias("rep"), "sig").join(entries.withColumnRenamed("id", "rep"), "rep").select("sig", "all")
    rows = salted_join(cleaned.select("id", "sig"), scratch.save(reps, "found"), "sig", "id")
    best = rows.select("id", F.posexplode(F.slice(F.filter("all", lambda x: x["other"] != F.col("id")), 1, k)).alias("rank", "x"))
    return best.select("id", F.col("x.other").alias("other"), (-F.col("x.negative")).alias("score"), (F.col("rank") + 1).alias("rank"))


def _routed(distinct: DataFrame, dim: int, n: int, sample: int, part_rows: int, most_parts: int, scratch: Scratch) -> str:
    """The kept table (id, raw, parts): each vector with the parts it is sent to, its own first."""
    spark = distinct.sparkSession
    rows = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    unit = unit_rows(np.stack([np.frombuffer(r.raw, np.float32) for r in rows]))
    wanted = max(1, round(n / part_rows))
    router = fit_parts(unit, min(wanted, most_parts))
    sent = spark.sparkContext.broadcast(router)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1), dim)
            parts, log_p = router.route(unit_rows(vectors))
            kept = enough(log_p)
            offsets = pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept], t)) for x, t in ((parts, pa.int32()), (log_p, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _encode(vectors), *lists], ["id", "raw", "parts", "log_p"])

    routed = scratch.save(distinct.mapInArrow(assign, "id long, raw binary, parts array<int>, log_p array<float>"), "routed")
    if wanted <= most_parts:
        return "routed"

    # second level: a classifier for each part, on its own rows
    home = {r.part: r["count"] for r in routed.groupBy(F.col("parts")[0].alias("part")).count().collect()}
    asked = {r.part: r["count"] for r in routed.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}
    first = Window.partitionBy("part").orderBy(F.xxhash64("id"), "id")
    fitted_on = routed.select("id", "raw", F.col("parts")[0].alias("part")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= PART_SAMPLE)

    def fit_one(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        fitted = fit_parts(unit_rows(_matrix(rows.column("raw"), dim)), round(home[part] / part_rows))
        return pa.table({"part": pa.array([part], pa.int32()), "weight": pa.array([fitted.weight.tobytes()], pa.binary()), "offset": pa.array([fitted.offset.tobytes()], pa.binary())})

    models = scratch.save(fitted_on.groupBy("part").applyInArrow(fit_one, "part int, weight binary, offset binary"), "models")
    cuts = [spark.createDataFrame([(p, -(-asked.get(p, 0) // QUERY_BLOCK)) for p in home], "part int, n int") for _ in range(2)]
    models = models.join(cuts[0], "part").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).groupBy("part", "cut")
    # a part that is nobody's own has no rows to find
    sent_to = routed.select("id", "raw", F.explode(F.arrays_zip("parts", "log_p")).alias("x")).select("id", "raw", F.col("x.parts").alias("part"), F.col("x.log_p").alias("log_p"))
    sent_to = sent_to.join(cuts[1], "part").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).groupBy("part", "cut")

    def refine(queries: pa.Table, models: pa.Table) -> pa.Table:
        if not queries.num_rows or not models.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "log_p": pa.array([], pa.float32())})
        weight = np.frombuffer(models.column("weight")[0].as_py(), np.float32).reshape(-1, dim)
        inner = Router(weight, np.frombuffer(models.column("offset")[0].as_py(), np.float32), min(len(weight), PROBES))
        parts, log_p = inner.route(unit_rows(_matrix(queries.column("raw"), dim)))
        number = queries.column("part").to_numpy().astype(np.int64)[:, None] << 32 | parts
        total = queries.column("log_p").to_numpy()[:, None] + log_p
        return pa.table({"id": pa.array(np.repeat(queries.column("id").to_numpy(), parts.shape[1])), "part": pa.array(number.ravel()), "log_p": pa.array(total.ravel().astype(np.float32))})

    finer = sent_to.cogroup(models).applyInArrow(refine, "id long, part long, log_p float")
    best = finer.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("log_p")).alias("m"), "part"))), 1, PROBES).alias("x"))
    # until they have MASS of the probability, as above
    reached = F.aggregate("x", F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("n")), lambda s, y: F.when((s["p"] < MASS) | (s["n"] < LEAST_PROBES), F.struct((s["p"] + F.exp(-y["m"].cast("double"))).alias("p"), (s["n"] + 1).alias("n"))).otherwise(s))
    kept = best.select("id", F.transform(F.slice("x", F.lit(1), reached["n"]), lambda y: y["part"]).alias("parts"))
    scratch.save(routed.select("id", "raw").join(kept, "id"), "finer")
    return "finer"


def _search(distinct: DataFrame, dim: int, n: int, k: int, sample: int, part_rows: int, most_parts: int, scratch: Scratch) -> DataFrame:
    """(id, best): the k best (score, other) of each distinct vector, itself left out."""
    name = _routed(distinct, dim, n, sample, part_rows, most_parts, scratch)
    routed = scratch.load(name)
    home = scratch.load(name).select("id", "raw", F.col("parts")[0].cast("long").alias("part"))
    query = routed.select("id", "raw", F.explode(F.col("parts").cast("array<long>")).alias("part"))
    # blocks of bounded size: the counts by part say into how many each part is cut
    counts = home.groupBy("part").agg(F.count("*").alias("own")).join(query.groupBy("part").agg(F.count("*").alias("asked")), "part")
    cuts = scratch.save(counts.select("part", F.ceil(F.col("own") / BASE_BLOCK).cast("int").alias("nb"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("nq")), "cuts")
    cut = lambda df, own, other, own_n, other_n: df.join(cuts, "part").select("id", "raw", "part", F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))
    base_b = cut(home, "b", "q", "nb", "nq").groupBy("part", "b", "q")
    query_b = cut(query, "q", "b", "nq", "nb").groupBy("part", "b", "q")

    def scan(queries: pa.Table, bases: pa.Table) -> pa.Table:
        names = ["id", "best"]
        kind = pa.struct([("negative", pa.float64()), ("other", pa.int64())])
        if not queries.num_rows or not bases.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "best": pa.array([], pa.list_(kind))})
        q_id, b_id = queries.column("id").to_numpy(), bases.column("id").to_numpy()
        order = np.argsort(b_id)
        b_id = b_id[order]
        q, b = unit_rows(_matrix(queries.column("raw"), dim)), unit_rows(_matrix(bases.column("raw"), dim))[order]
        q32, b32 = q.astype(np.float32), b.astype(np.float32)
        keep = min(k, len(b_id))
        ids, scores = [], []
        for a in range(0, len(q), 1024):
            rough = q32[a : a + 1024] @ b32.T
            rough[q_id[a : a + 1024, None] == b_id] = -3
            top = np.sort(_top(rough, k + SPARE), axis=1)
            exact = np.round(np.einsum("ij,ikj->ik", q[a : a + 1024], b[top]), 12)
            exact[b_id[top] == q_id[a : a + 1024, None]] = -3
            best = np.argsort(-exact, axis=1, kind="stable")[:, :keep]
            ids.append(b_id[np.take_along_axis(top, best, 1)])
            scores.append(np.take_along_axis(exact, best, 1))
        ids, scores = np.concatenate(ids), np.concatenate(scores)
        real = scores > -2
        offsets = np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(-scores[real]), pa.array(ids[real])], fields=list(kind))
        return pa.Table.from_arrays([pa.array(q_id), pa.ListArray.from_arrays(pa.array(offsets), entries)], names)

    scanned = query_b.cogroup(base_b).applyInArrow(scan, "id long, best array<struct<negative: double, other: long>>")
    merged = scanned.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select("id", F.transform("best", lambda x: F.struct((-x["negative"]).alias("score"), x["other"].alias("other"))).alias("best"))
