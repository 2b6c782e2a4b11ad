"""Counts, shares, percentiles, rank tables, calibration, tests: what judges a run against the truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.operators.order import numbered, running_sums, tiles


def share(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator, null where there is nothing to share."""
    return F.try_divide(F.col(numerator) if isinstance(numerator, str) else numerator, F.nullif(F.col(denominator) if isinstance(denominator, str) else denominator, F.lit(0)))


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / max(1, denominator): 0 where there is nothing."""
    return numerator / F.greatest(denominator, F.lit(1))


def _keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("__all", F.lit(1)), ["__all"])


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """``by``, n and a column for each of ``ranks(n)``: the value at that place of the group's order, from 0.

    Null values don't count; a group without values is left out. Places come from one global order by key and value, so
    a group of any size is spread over tasks.
    """
    df, keys = _keys(df.where(F.col(value).isNotNull()), by)
    ordered = numbered(df.select(*keys, value), [*keys, value], "__at")
    groups = ordered.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    wanted = ranks(F.col("n"))
    targets = F.array(*[F.struct(F.lit(name).alias("__q"), (F.col("__first") + rank).cast("long").alias("__at")) for name, rank in wanted.items()])
    picked = groups.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "n", F.inline(targets)).join(ordered, "__at")
    return picked.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__q") == name, F.col(value))).alias(name) for name in wanted]).drop("__all")


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], ceil_rule: bool = False) -> DataFrame:
    """``by``, n and one column for each quantile: the value at rank rint(q (n - 1)) from 0, ties to even.

    With ``ceil_rule`` the value at rank ceil(q n) from 1. Null values don't count; a group without values is left out.
    """
    rank = lambda q, n: F.greatest(F.ceil(F.lit(q) * n), F.lit(1)) - 1 if ceil_rule else F.rint(F.lit(q) * (n - 1))
    return at_ranks(df, by, value, lambda n: {name: rank(q, n) for name, q in quantiles.items()})


def level_medians(df: DataFrame, levels: list[list[str]], values: list[str], digits: int = 2) -> DataFrame:
    """Medians and support of ``values`` on each level of keys; a key that is null leaves the row out of that level.

    Columns: level (its number), the keys of the first level (null where a level lacks them), n, and the medians. A median
    is the mean of the two middle values of a global order, so the level without keys is no task of its own.
    """
    keys = levels[0]
    leveled = None
    for number, level in enumerate(levels):
        rows = df.where(" and ".join(f"{k} is not null" for k in level)) if level else df
        rows = rows.select(F.lit(number).alias("level"), *[F.col(k) if k in level else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], *values)
        leveled = rows if leveled is None else leveled.unionByName(rows)
    by = ["level", *keys]
    result = leveled.groupBy(*by).agg(F.count("*").alias("n"))
    for v in values:
        middle = at_ranks(leveled, by, v, lambda n: {"lo": F.floor((n - 1) / 2), "hi": F.ceil((n - 1) / 2)})
        middle = middle.select(*[F.col(k).alias(f"__{k}") for k in by], F.round((F.col("lo") + F.col("hi")) / 2, digits).alias(v))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
        result = result.join(middle, same, "left").drop(*[f"__{k}" for k in by])
    return result.select(*by, "n", *values)


def with_fallback(df: DataFrame, medians: DataFrame, levels: list[list[str]], values: list[str], least: int = 5) -> DataFrame:
    """``df`` with ``level`` and the medians of the first level that has at least ``least`` rows for its keys."""
    found = []
    for number, level in enumerate(levels):
        block = medians.where((F.col("level") == number) & (F.col("n") >= least)).select(*level, F.lit(number).alias(f"__l{number}"), *[F.col(v).alias(f"__{v}_{number}") for v in values])
        df = df.join(block, level, "left") if level else df.crossJoin(F.broadcast(block)) if block.limit(1).count() else df.withColumn(f"__l{number}", F.lit(None).cast("int")).withColumns({f"__{v}_{number}": F.lit(None).cast("double") for v in values})
        found.append(number)
    made = {"level": F.coalesce(*[F.col(f"__l{n}") for n in found])} | {v: F.coalesce(*[F.when(F.col(f"__l{n}").isNotNull(), F.col(f"__{v}_{n}")) for n in found]) for v in values}
    # only the first level that is there counts, even where its value is null
    for v in values:
        expression = F.lit(None).cast("double")
        for n in reversed(found):
            expression = F.when(F.col(f"__l{n}").isNotNull(), F.col(f"__{v}_{n}")).otherwise(expression)
        made[v] = expression
    return df.withColumns({k: c for k, c in made.items()}).drop(*[c for n in found for c in [f"__l{n}", *[f"__{v}_{n}" for v in values]]])


def most_frequent(df: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """``by``, value, n: the most frequent value of each key, of equal counts the one met first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("__first"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "__first", value)
    return counts.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__first")


def top_share(df: DataFrame, by: list[str], rank: str, ks: list[int]) -> DataFrame:
    """``by``, n and top@k for each k, a null rank being a miss; null shares for no rows."""
    aggregates = [F.count("*").alias("n"), *[share(F.count_if(F.col(rank) <= k), F.count("*")).alias(f"top{k}") for k in ks]]
    return df.groupBy(*by).agg(*aggregates)


def truth_ranks(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank): the smallest rank at which a candidate is an accepted answer; null if there is none.

    ``candidates`` (query_id, slug, rank), ``truth`` (query_id, slug): one row for each accepted answer.
    """
    hits = candidates.join(truth, ["query_id", "slug"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left")


def rank_label(rank: Column | str, known: Column | str, depth: int = 5) -> Column:
    """The rank as text, ``>depth`` beyond, ``out`` where the truth isn't in the catalogue at all."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.when(~(F.col(known) if isinstance(known, str) else known), "out").when(rank <= depth, rank.cast("string")).otherwise(f">{depth}")


def tie_fair_top1(scored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(query_id, credit): 1 / k if the truth is among the k best equal scores, else 0. ``scored``: query_id, score, is_truth."""
    whole = Window.partitionBy("query_id")
    best = scored.withColumn("__best", F.max("score").over(whole)).where(F.col("score") >= F.col("__best") - tolerance)
    return best.groupBy("query_id").agg((F.max(F.col("is_truth").cast("double")) / F.count("*")).alias("credit"))


def fix_break(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: queries of both runs (query_id, ok) by what changed."""
    both = before.select("query_id", F.col("ok").alias("a")).join(after.select("query_id", F.col("ok").alias("b")), "query_id")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("a") & F.col("b")).alias("fixes"), F.count_if(F.col("a") & ~F.col("b")).alias("breaks"), F.count_if(F.col("a") & F.col("b")).alias("both_right"))


def sign_test(fixes: Column, breaks: Column) -> Column:
    """Exact two-sided probability of a split at least so uneven under equal chances; 1 without any change."""
    n, small = fixes + breaks, F.least(fixes, breaks)
    # log of n choose i as a sum of logs, i from 0 to small
    choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(j <= i, F.log((n - i + j).cast("double")) - F.log(j.cast("double"))).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), small), F.lit(0.0), lambda s, i: s + F.exp(choose(i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0)))


def calibration(df: DataFrame, probability: str, ok: str, bins: int, order: list[str]) -> DataFrame:
    """(bin, n, p_mean, accuracy, gap): bins of equal counts by probability, the first ones one larger."""
    known = df.where(F.col(probability).isNotNull())
    n = known.count()
    binned = numbered(known.select(probability, ok, *[c for c in order if c not in (probability, ok)]), [probability, *order]).withColumn("bin", tiles(F.col("number"), F.lit(n), bins))
    right = F.col(ok).cast("double")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(probability).alias("p_mean"), F.avg(right).alias("accuracy"), F.abs(F.avg(probability) - F.avg(right)).alias("gap"))


def calibration_error(df: DataFrame, probability: str, ok: str, bins: int, order: list[str]) -> DataFrame:
    """One row: expected calibration error over equal-count bins and Brier score."""
    table = calibration(df, probability, ok, bins, order)
    error = table.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    brier = df.where(F.col(probability).isNotNull()).agg(F.avg((F.col(probability) - F.col(ok).cast("double")) ** 2).alias("brier"))
    return error.crossJoin(brier)


def grouped_bootstrap(df: DataFrame, group: str, ok: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """One row (accuracy, lo, hi): accuracy with 2.5 and 97.5 percentiles over resamples of whole groups.

    The Poisson bootstrap: drawing with replacement needs the groups' number to be dealt out among them, a Poisson weight
    for each is its limit and needs nothing else. Each replicate gives each group a weight: how many of as many draws as there are groups hit it, drawn as a
    Poisson(1) count from a hash of replicate and group, so a group of any size is one row that is weighed.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(ok).alias("right"))
    u = F.pmod(F.xxhash64(F.lit(seed), "replicate", group), F.lit(1 << 40)) / F.lit(float(1 << 40))
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(16):  # cumulative Poisson(1), to the last bit of u
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum(((u >= F.lit(step)).cast("int") for step in steps[1:]), (u >= F.lit(steps[0])).cast("int"))
    drawn = groups.crossJoin(df.sparkSession.range(replicates).withColumnRenamed("id", "replicate")).withColumn("w", weight)
    accuracies = drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col("right")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("a"))
    whole = groups.agg((F.sum("right") / F.sum("n")).alias("accuracy"))
    return whole.crossJoin(accuracies.agg(F.percentile("a", 0.025).alias("lo"), F.percentile("a", 0.975).alias("hi")))


def judge(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: ids missing and extra, answered, right, and accuracy over all of the truth; a null truth expects null.

    ``truth`` (id, slug), ``answers`` (id, slug); both with unique ids.
    """
    both = truth.select("id", F.col("slug").alias("want"), F.lit(True).alias("t")).join(answers.select("id", F.col("slug").alias("got"), F.lit(True).alias("a")), "id", "full_outer")
    known = F.coalesce("t", F.lit(False))
    right = known & F.coalesce("a", F.lit(False)) & F.col("want").eqNullSafe(F.col("got"))
    return both.agg(
        F.count_if(known).alias("n_truth"), F.count_if(known & F.col("a").isNull()).alias("n_missing"), F.count_if(~known).alias("n_extra"),
        F.count_if(known & F.col("got").isNotNull()).alias("n_answered"), F.count_if(right).alias("n_right"), share(F.count_if(right), F.count_if(known)).alias("accuracy"),
    )


def f1_at(df: DataFrame, ks: list[int]) -> DataFrame:
    """One row: precision over answered queries, recall over those in the catalogue, and F1, at each k.

    ``df`` has (in_catalogue, answered, rank); a null rank is a miss.
    """
    columns = []
    for k in ks:
        hits = F.count_if(F.col("rank") <= k)
        p, r = share(hits, F.count_if("answered")), share(hits, F.count_if("in_catalogue"))
        columns += [p.alias(f"p{k}"), r.alias(f"r{k}"), F.try_divide(2 * p * r, F.nullif(p + r, F.lit(0.0))).alias(f"f{k}")]
    return df.agg(*columns)


def threshold_out_of_fold(df: DataFrame, fold: str, score: str, ok: str) -> DataFrame:
    """(fold, threshold, accuracy): for each fold the threshold that is best on the others, judged on the fold.

    Predicting ``ok`` where score >= threshold; of equally good thresholds the smallest. The folds are few. Scores are
    counted by value and added up along one global order; nothing is held for a whole fold. Rows with a null fold,
    score or ok don't count.
    """
    known = df.where(F.col(fold).isNotNull() & F.col(score).isNotNull() & F.col(ok).isNotNull())
    totals = {r[0]: (r.good, r.bad) for r in known.groupBy(fold).agg(F.count_if(F.col(ok)).alias("good"), F.count_if(~F.col(ok)).alias("bad")).collect()}
    names = sorted(totals)
    if not names:
        return df.select(F.col(fold), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("accuracy")).limit(0)
    counts = [F.count_if((F.col(fold) == n) & right).alias(f"{kind}{i}") for i, n in enumerate(names) for kind, right in (("good", F.col(ok)), ("bad", ~F.col(ok)))]
    # of each score, and of all that are lower, how many are right and wrong in each fold
    scored = running_sums(known.groupBy(score).agg(*counts), [score], [f"{kind}{i}" for i in range(len(names)) for kind in ("good", "bad")])
    columns = [f"{kind}{i}" for i in range(len(names)) for kind in ("good", "bad")]
    best = []
    for k, name in enumerate(names):
        others = [i for i in range(len(names)) if i != k]
        # at this threshold: wrong ones that lie below it, and right ones that don't
        below = lambda kind: sum((F.col(f"sum_{kind}{i}") - F.col(f"{kind}{i}") for i in others), F.lit(0))  # noqa: B023, E731
        right = below("bad") + sum(totals[names[i]][0] for i in others) - below("good")
        there = sum((F.col(f"{kind}{i}") for i in others for kind in ("good", "bad")), F.lit(0)) > 0
        best.append(F.struct(F.lit(name).alias("held"), F.max_by(score, F.when(there, F.struct(right, -F.col(score)))).alias("threshold")))
    chosen = scored.select(score, *columns, *[f"sum_{c}" for c in columns]).agg(F.array(*best).alias("x")).select(F.inline("x"))
    judged = known.join(chosen, F.col(fold) == F.col("held"))
    return judged.groupBy(fold).agg(F.first("threshold").alias("threshold"), F.avg(((F.col(score) >= F.col("threshold")) == F.col(ok)).cast("double")).alias("accuracy"))
