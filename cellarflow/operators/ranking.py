"""Ranking features of candidate blocks, linear scores, softmax, and a listwise logistic ranker."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_features(df: DataFrame, query: str, score: str, tie: str, margin: str | None = None) -> DataFrame:
    """``df`` with what a candidate's score says within its query.

    rank, inv_rank, gap (to the best), z (population; 0 if flat), minmax (1 if flat), is_top1, and margin_top1 where a
    margin is given. Equal scores rank by ``tie``.
    """
    whole = Window.partitionBy(query)
    order = whole.orderBy(F.col(score).desc(), tie)
    lo, hi, sd = F.min(score).over(whole), F.max(score).over(whole), F.stddev_pop(score).over(whole)
    made = df.withColumn("rank", F.row_number().over(order)).withColumn("inv_rank", 1 / F.col("rank")).withColumn("gap", hi - F.col(score))
    made = made.withColumn("z", F.when(sd > 1e-12, (F.col(score) - F.avg(score).over(whole)) / sd).otherwise(0.0)).withColumn("minmax", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0))
    made = made.withColumn("is_top1", (F.col("rank") == 1).cast("int"))
    return made.withColumn("margin_top1", F.col(margin) * F.col("is_top1")) if margin else made


def group_mates(df: DataFrame, query: str, rank: str, group: str) -> DataFrame:
    """``df`` with top_mate (in the group of the query's first) and log_size (ln of the group's candidates in the query)."""
    first = F.first(group).over(Window.partitionBy(query).orderBy(rank))
    size = F.count("*").over(Window.partitionBy(query, group))
    known = F.col(group).isNotNull()
    return df.withColumn("top_mate", F.coalesce((F.col(group) == first), F.lit(False)).cast("int")).withColumn("log_size", F.when(known, F.log(size.cast("double"))).otherwise(0.0))


def relative_count(df: DataFrame, query: str, count: str, floor: float = -3.0) -> DataFrame:
    """``df`` with relative: the count less the best of its query, cut at ``floor`` and scaled to [-1, 0]."""
    return df.withColumn("relative", F.greatest(F.col(count) - F.max(count).over(Window.partitionBy(query)), F.lit(floor)) / -floor)


def softmax(df: DataFrame, query: str, score: str, temperature: float = 1.0, name: str = "p") -> DataFrame:
    """``df`` with the probability of each candidate within its query."""
    whole = Window.partitionBy(query)
    part = F.exp((F.col(score) - F.max(score).over(whole)) / temperature)
    return df.withColumn("__e", part).withColumn(name, F.col("__e") / F.sum("__e").over(whole)).drop("__e")


def argmax(df: DataFrame, query: str, score: str, order: str) -> DataFrame:
    """The best row of each query, of equal ones the first by ``order``."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), order))).where("__k = 1").drop("__k")


def linear_score(weights: list[dict], skip: set[str] = frozenset()) -> Column:
    """w . (x - mean) / scale of a model's features, those in ``skip`` left out."""
    total = F.lit(0.0)
    for w in weights:
        if w["name"] not in skip:
            total = total + F.lit(float(w["coef"])) * (F.col(w["name"]).cast("double") - F.lit(float(w["mean"]))) / F.lit(float(w["scale"]))
    return total


def hand_score(rules: list[tuple[Column, Column, float, float]], base: Column) -> Column:
    """``base`` plus match or conflict weights: for each (match, conflict, plus, minus); unknown adds nothing."""
    total = base
    for match, conflict, plus, minus in rules:
        total = total + F.when(F.coalesce(match, F.lit(False)), plus).when(F.coalesce(conflict, F.lit(False)), minus).otherwise(0.0)
    return total


def contributions(df: DataFrame, query: str, weights: list[dict], groups: dict[str, str], top: int = 3) -> DataFrame:
    """(query, group, contribution, place): what feature groups add to a row's score, the ``top`` largest by size."""
    parts = F.array(*[F.struct(F.lit(groups.get(w["name"], w["name"])).alias("group"), (F.lit(float(w["coef"])) * (F.col(w["name"]) - float(w["mean"])) / float(w["scale"])).alias("c")) for w in weights])
    rows = df.select(query, F.inline(parts)).groupBy(query, "group").agg(F.sum("c").alias("contribution"))
    order = Window.partitionBy(query).orderBy(F.abs("contribution").desc(), "group")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def fit_listwise(df: DataFrame, query: str, features: list[str], positive: str, signs: dict[str, int] | None = None, l2: float = 0.01, rounds: int = 25) -> list[dict]:
    """Weights of a listwise logistic model (softmax over a query's candidates), some bounded to a sign.

    Projected Newton steps with an Armijo line search. Gradient, Hessian and loss are sums over queries; each partition
    sends one matrix of features x features, and whole queries are brought together by one shuffle that is kept.
    """
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([stats[f"m_{c}"] for c in features])
    scale = np.array([stats[f"s_{c}"] or 1.0 for c in features])
    scale[scale < 1e-12] = 1.0
    blocks = df.select(query, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(positive).cast("double").alias("y")).repartition(query).sortWithinPartitions(query).persist()
    bound = np.array([(signs or {}).get(c, 0) for c in features])

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
            loss, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
            if table is not None and table.num_rows:
                x = (table.column("x").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) - mean) / scale
                y = table.column("y").to_numpy()
                key = table.column(query).combine_chunks().dictionary_encode().indices.to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                for a, b in zip(starts, [*starts[1:], len(y)]):
                    if not y[a:b].any():
                        continue
                    z = x[a:b] @ w
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    t = y[a:b] / y[a:b].sum()
                    loss -= float((t * np.log(np.maximum(p, 1e-300))).sum())
                    g += x[a:b].T @ (p - t)
                    xp = x[a:b] * p[:, None]
                    h += x[a:b].T @ xp - np.outer(xp.sum(0), xp.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], ["loss", "g", "h"])

        rows = blocks.mapInArrow(add, "loss double, g binary, h binary").collect()
        g, h = (sum(np.frombuffer(r[n], np.float64) for r in rows) for n in ("g", "h"))
        return sum(r.loss for r in rows) + l2 / 2 * float(w @ w), g + l2 * w, h.reshape(len(w), -1) + l2 * np.eye(len(w))

    w = np.zeros(len(features))
    loss, g, h = sums(w)
    for _ in range(rounds):
        free = ~((bound > 0) & (w <= 0) & (g > 0) | (bound < 0) & (w >= 0) & (g < 0))
        if np.abs(g[free]).max(initial=0.0) < 1e-6:
            break
        step = np.zeros_like(w)
        step[free] = -np.linalg.solve(h[np.ix_(free, free)], g[free])
        size, moved = 1.0, None
        while size > 1e-4:
            trial = w + size * step
            trial = np.where((bound > 0) & (trial < 0) | (bound < 0) & (trial > 0), 0.0, trial)
            made = sums(trial)
            if made[0] <= loss + 1e-4 * float(g @ (trial - w)):
                moved = made
                break
            size /= 2
        if moved is None or loss - moved[0] < 1e-10:
            break
        w, (loss, g, h) = trial, moved
    blocks.unpersist()
    return [{"name": c, "coef": float(a), "mean": float(m), "scale": float(s)} for c, a, m, s in zip(features, w, mean, scale)]


def fit_temperature(df: DataFrame, query: str, score: str, positive: str, low: float = 0.05, high: float = 20.0, steps: int = 20, width: float = 1e-6) -> float:
    """The temperature of least log loss; queries without a positive don't count.

    Each step takes the losses of 16 temperatures in one aggregate and keeps the logarithms next to the best, until they are ``width`` apart.
    """
    kept = df.join(df.where(F.col(positive)).select(query).distinct(), query, "left_semi").select(query, score, positive).persist()
    whole = Window.partitionBy(query)
    below = kept.withColumn("__s", F.col(score) - F.max(score).over(whole))

    def losses(logs: list[float]) -> list[float]:
        parts = [F.exp(F.col("__s") / math.exp(t)) for t in logs]
        p = below.select(positive, *[(e / F.sum(e).over(whole)).alias(f"__p{i}") for i, e in enumerate(parts)])
        return [x or 0.0 for x in p.where(F.col(positive)).agg(*[F.avg(-F.log(F.greatest(f"__p{i}", F.lit(1e-300)))) for i in range(len(logs))]).first()]

    a, b, n = math.log(low), math.log(high), 16
    for _ in range(steps):
        if b - a <= width:
            break
        logs = [a + (b - a) * i / (n - 1) for i in range(n)]
        values = losses(logs)
        best = values.index(min(values))
        a, b = logs[max(best - 1, 0)], logs[min(best + 1, n - 1)]
    kept.unpersist()
    return math.exp((a + b) / 2)
