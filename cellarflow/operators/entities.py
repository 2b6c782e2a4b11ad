"""Entity groups, components, splits and folds, overrides and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.operators.order import numbered
from cellarflow.operators.skew import salted_join, salted_lookup
from cellarflow.session import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of each node of (a, b) edges the smallest node that it is connected with.

    Labels spread to neighbours and jump to their label's label each round, until no label changes; the tables of a round
    replace the last. Joins on hot nodes are cut into parts.
    """
    scratch = Scratch(edges.sparkSession, "components")
    both = edges.where("a is not null and b is not null").select("a", "b").union(edges.where("a is not null and b is not null").select("b", "a")).toDF("a", "b").distinct()
    both = scratch.save(both, "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels-0")
    step, changed = 0, not labels.isEmpty()
    while changed:
        step += 1
        near = salted_lookup(both, labels.select(F.col("node").alias("b"), "component"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jumped = salted_lookup(moved, labels.select(F.col("node").alias("mid"), F.col("component").alias("up")), "mid", "node").select("node", "old", F.least("mid", "up").alias("component"))
        jumped = scratch.save(jumped, f"labels-{step}")
        changed = not jumped.where("old <> component").isEmpty()
        scratch.drop(f"labels-{step - 1}")
        labels = jumped.select("node", "component")
    return labels


def hash_split(key: Column, dev_share: float = 0.4) -> Column:
    """dev if the first eight bytes of the key's SHA-256, over 2^64, are below the share; else test."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(number.cast("double") / 18446744073709551616.0 < dev_share, "dev").otherwise("test")


def first_known(*keys: tuple[str, Column]) -> Column:
    """The first key that isn't null, with its name before it."""
    return F.coalesce(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in keys])


def _deal(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """How ``count`` groups of one size go to the lightest fold each: (from which group on, the folds in turn).

    Adds to ``loads``. Folds within one size of the lightest take turns, always in the same order, until they reach the
    next fold, so there are at most as many stretches as folds.
    """
    runs, done = [], 0
    while done < count:
        order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
        low = (loads[order[0]] + size, order[0])
        turn = [i for i in order if (loads[i], i) < low]
        rounds = -(-(count - done) // len(turn))
        if len(turn) < len(loads):
            # as many rounds as end, with the last one in turn, before the next fold is lighter
            far, last = order[len(turn)], turn[-1]
            behind = loads[far] - loads[last]
            rounds = min(rounds, behind // size + 1 if behind % size or last < far else behind // size)
        taken = min(count - done, rounds * len(turn))
        runs.append((done, turn))
        for k, i in enumerate(turn):
            loads[i] += size * (taken // len(turn) + (k < taken % len(turn)))
        done += taken
    return runs


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): groups by falling size, then by hash, each to the lightest fold so far, the first of equal ones.

    Groups are numbered in that order in the cluster. Within one size the folds take turns in a few stretches, which the
    driver works out from how many groups each size has: sizes that occur are few, at most the root of twice the rows.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    ordered = numbered(sizes, [F.col("n").desc(), F.sha2(F.col(group).cast("string"), 256), F.col(group)])
    loads, first, stretches = [0] * folds, 0, []
    for row in sizes.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.col("n").desc()).toLocalIterator():
        stretches += [(row.n, first + at, turn) for at, turn in _deal(loads, row.n, row.m)]
        first += row.m
    table = df.sparkSession.createDataFrame(stretches, "n long, start long, turn array<int>").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("start", "turn"))).alias("s"))
    joined = salted_lookup(ordered, table, "n", group)
    at = F.element_at(F.filter("s", lambda x: x["start"] <= F.col("number")), -1)
    return joined.select(group, "n", F.element_at(at["turn"], (F.pmod(F.col("number") - at["start"], F.size(at["turn"])) + 1).cast("int")).alias("fold"))


def elect(df: DataFrame, group: str, key: str, preferences: list[Column]) -> DataFrame:
    """(group, key, n): of each group the row that the first preference holds for, then the next, then the smallest key."""
    rank = F.struct(*[(~F.coalesce(p, F.lit(False))).alias(f"p{i}") for i, p in enumerate(preferences)], key)
    return df.groupBy(group).agg(F.min_by(key, rank).alias(key), F.count("*").alias("n"))


def twin_pairs(df: DataFrame, group: str, key: str, fields: list[str]) -> DataFrame:
    """(key_a, key_b, differs): pairs of one group with the first field that both have and that differs, if any.

    The result is the pairs; a hot group is cut into parts.
    """
    a, b = df.select(group, *[F.col(c).alias(f"{c}_a") for c in [key, *fields]]), df.select(group, *[F.col(c).alias(f"{c}_b") for c in [key, *fields]])
    first = F.coalesce(*[F.when(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(c)) for c in fields])
    return salted_join(a, b, group, f"{key}_a").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b", first.alias("differs"))


def apply_fixes(df: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (keys, value) with fixes (keys, old, new) applied where the value is still the old one.

    A fix whose old value isn't the current one is an error when its row is read.
    """
    joined = df.join(fixes.withColumn("__f", F.lit(True)), keys, "left")
    bad = F.col("__f").isNotNull() & ~F.col("value").eqNullSafe(F.col("old"))
    value = F.when(bad, F.raise_error(F.concat(F.lit("fix of another value: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))).when(F.col("__f").isNotNull(), F.col("new")).otherwise(F.col("value"))
    return joined.select(*keys, value.alias("value"))


def unused_fixes(df: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Fixes that meet no row."""
    return fixes.join(df.select(*keys).distinct(), keys, "left_anti")


def lineage(steps: DataFrame, loaded: str, trained: str, flags: list[str], most: int = 30) -> DataFrame:
    """(depth, source, target): the steps walked back from ``loaded`` to ``trained``; steps whose flag is off break it."""
    spark = steps.sparkSession
    usable = steps.where(F.col("flag").isNull() | F.col("flag").isin(flags)) if flags else steps.where(F.col("flag").isNull())
    usable.createOrReplaceTempView("__lineage_steps")
    return spark.sql(
        """with recursive chain(depth, source, target) as (
          select 1, source, target from __lineage_steps where target = :loaded
          union all select c.depth + 1, s.source, s.target from chain c join __lineage_steps s on s.target = c.source where c.source <> :trained and c.depth < :most)
        select * from chain""",
        {"loaded": loaded, "trained": trained, "most": most},
    )


def merged_readers(df: DataFrame, key: str, order: str, lists: list[str], singles: list[str]) -> DataFrame:
    """One row for each key: lists of all readers put together in order, singles from the first that has them."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]))
    return df.groupBy(key).agg(*[whole(c).alias(c) for c in lists], *[first(c).alias(c) for c in singles])


def brands(df: DataFrame, owner: str, key: str, words: str, least: int = 4, share: float = 0.25) -> DataFrame:
    """(owner, gram, n): words and word pairs in a quarter of an owner's rows; a pair absorbs its own words."""
    sizes = df.groupBy(owner).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    w = F.col(words)
    grams = F.array_distinct(F.concat(w, F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array())))
    counts = df.where(F.size(words) > 0).select(owner, key, F.explode(grams).alias("gram")).groupBy(owner, "gram").agg(F.countDistinct(key).alias("n")).join(sizes, owner).where(F.col("n") >= share * F.col("size")).drop("size")
    absorbed = counts.where(F.col("gram").contains(" ")).select(owner, F.explode(F.split("gram", " ")).alias("gram")).distinct()
    return counts.join(absorbed, [owner, "gram"], "left_anti")


def prefix_families(df: DataFrame, name: str) -> DataFrame:
    """(name, family): the shortest other name that is a word prefix of it, else the name itself."""
    names = df.select(name).distinct()
    words = F.split(name, " ")
    prefixes = names.where(F.size(words) > 1).select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias("prefix"))
    found = prefixes.join(names.select(F.col(name).alias("prefix")), "prefix").groupBy(name).agg(F.min_by("prefix", F.length("prefix")).alias("family"))
    return names.join(found, name, "left").select(name, F.coalesce("family", name).alias("family"))


def topic_of(questions: DataFrame, triggers: DataFrame, key: str, word: str) -> DataFrame:
    """(key, topic, score): two points for each trigger and one for each context word a question's words begin with.

    ``triggers`` has (topic, stem, is_trigger, needs_context, narrow). A topic needs a trigger, and context if it says
    so; of equal scores a narrow one, then by name. Stems meet words on their first three letters.
    """
    asked = questions.select(key, F.col(word).alias("w")).where(F.length("w") >= 3).distinct().withColumn("k", F.substring("w", 1, 3))
    met = asked.join(triggers.withColumn("k", F.substring("stem", 1, 3)), "k").where(F.col("w").startswith(F.col("stem")))
    sums = met.select(key, "topic", "stem", "is_trigger", "needs_context", "narrow").distinct().groupBy(key, "topic").agg(F.sum(F.when(F.col("is_trigger"), 2).otherwise(1)).alias("score"), F.bool_or("is_trigger").alias("t"), F.bool_or(~F.col("is_trigger")).alias("c"), F.bool_or("needs_context").alias("needs"), F.bool_or("narrow").alias("narrow"))
    kept = sums.where("t and (c or not needs)")
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("narrow").desc(), "topic")
    return kept.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "topic", "score")
