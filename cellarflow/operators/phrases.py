"""Rules over words as data: stems, phrases and gapped phrases joined with tokens, and what excuses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.operators.skew import salted_join

STEM = 3  # letters of a stem that a join goes by; a shorter part is a whole word


def rule_table(spark: SparkSession, rules: list[tuple[str, int, str, bool]]) -> DataFrame:
    """(rule, topic, rank, excuse, step, part, gap, steps) of rules (topic, rank, pattern, excuse).

    A pattern has words with single spaces; ``stem*`` stands for all words that begin so, ``..2`` between two of them
    for up to two other words. A smaller rank goes before. An excuse takes away the hits of its topic that it covers.
    """
    rows = []
    for number, (topic, rank, pattern, excuse) in enumerate(rules):
        steps, gap = [], 0
        for part in pattern.split():
            if part.startswith(".."):
                gap = int(part[2:])
                continue
            if part.endswith("*") and len(part) <= STEM:
                raise ValueError(f"a stem needs {STEM} letters: {pattern}")
            steps.append((part, gap))
            gap = 0
        rows += [(number, topic, rank, excuse, k, part, gap, len(steps)) for k, (part, gap) in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "rule int, topic string, rank int, excuse boolean, step int, part string, gap int, steps int")


def phrase_table(phrases: DataFrame, rule: str, words: str) -> DataFrame:
    """Rules of whole words, one after the other, from a table: each row's array of words is one; empty ones are none."""
    parts = phrases.where(F.size(words) > 0).select(F.col(rule).alias("rule"), F.posexplode(words).alias("step", "part"), F.size(words).alias("steps"))
    return parts.select("rule", F.lit(None).cast("string").alias("topic"), F.lit(0).alias("rank"), F.lit(False).alias("excuse"), (F.col("step") + 1).alias("step"), "part", F.lit(0).alias("gap"), "steps")


def rule_hits(words: DataFrame, key: str, position: str, word: str, rules: DataFrame) -> DataFrame:
    """(key, rule, topic, rank, excuse, start, end): where the rules' patterns stand in the words of each key.

    Words meet the parts of all rules in one join, whole words by themselves and stems by their first letters, hot
    words cut into parts; the steps of longer patterns then follow by position, so nothing is joined by key alone. Null
    words meet nothing.
    """
    parts = rules.withColumn("stem", F.col("part").endswith("*")).withColumn("text", F.regexp_replace("part", r"\*$", ""))
    parts = parts.withColumn("__k", F.when(F.col("stem"), F.concat(F.lit("*"), F.substring("text", 1, STEM))).otherwise(F.concat(F.lit("="), F.col("text"))))
    tokens = words.where(F.col(word).isNotNull()).select(F.col(key).alias("key"), F.col(position).cast("int").alias("pos"), F.col(word).alias("w"))
    keyed = tokens.select("key", "pos", "w", F.explode(F.array(F.concat(F.lit("="), F.col("w")), F.concat(F.lit("*"), F.substring("w", 1, STEM)))).alias("__k"))
    met = salted_join(keyed, parts, "__k", "key").where(~F.col("stem") | F.col("w").startswith(F.col("text")))
    met = met.select("key", "pos", "rule", "topic", "rank", "excuse", "step", "gap", "steps")
    open_ = met.where("step = 1").select("key", "rule", "topic", "rank", "excuse", "steps", F.col("pos").alias("start"), F.col("pos").alias("end"))
    done = open_.where("steps = 1")
    for k in range(2, (rules.agg(F.max("steps")).first()[0] or 0) + 1):
        following = met.where(F.col("step") == k).select("key", "rule", F.col("pos").alias("end"), F.explode(F.transform(F.sequence(F.lit(0), F.col("gap")), lambda g: F.col("pos") - 1 - g)).alias("at"))
        open_ = open_.where(F.col("steps") >= k).withColumnRenamed("end", "at").join(following, ["key", "rule", "at"]).drop("at").distinct()
        done = done.unionByName(open_.where(F.col("steps") == k))
    return done.select(F.col("key").alias(key), "rule", "topic", "rank", "excuse", "start", "end")


def barred(hits: DataFrame, key: str) -> DataFrame:
    """(key, topic): of each key the topic of smallest rank with a hit that no excuse of the topic covers; others are left out."""
    excuses = hits.where("excuse").select(F.col(key).alias("__key"), F.col("topic").alias("__topic"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    covers = (F.col(key) == F.col("__key")) & (F.col("topic") == F.col("__topic")) & (F.col("__a") <= F.col("start")) & (F.col("__b") >= F.col("end"))
    return hits.where("not excuse").join(excuses, covers, "left_anti").groupBy(key).agg(F.min_by("topic", F.struct("rank", "topic")).alias("topic"))


def without_negated(hits: DataFrame, words: DataFrame, key: str, position: str, word: str, negations: list[str]) -> DataFrame:
    """Hits that no negation stands right before."""
    before = words.where(F.col(word).isin(negations)).select(key, (F.col(position).cast("int") + 1).alias("start")).distinct()
    return hits.join(before, [key, "start"], "left_anti")
