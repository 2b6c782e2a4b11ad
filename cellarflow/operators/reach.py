"""What lies within a distance, and what beyond it, without making the pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 1e15  # numbers beyond it, infinite ones and NaN, are within reach of nothing


def _sum(a: Column, b: Column) -> tuple[Column, Column]:
    """a + b as the rounded sum and exactly what rounding left off."""
    s = a + b
    c = s - a
    return s, (a - (s - c)) + (b - c)


def _known(c: Column) -> Column:
    return F.coalesce(F.abs(c) < MOST, F.lit(False))


def near_and_far(asked: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """(q, g, near, far) for each ``q`` of ``asked`` with each group of ``points``: the least payload of the group's
    points with abs(q - v) < width, and that of its other points; null if there are none.

    ``asked`` has q, each once, ``points`` g, v and payload; any may be null except payload, q and v are doubles. What is
    near lies between two edges, one in either direction. An edge is held as a rounded number and the rest, since the
    rounded difference of q and v has to be under ``width``. Points and edges are sorted together within blocks of
    ``width``; least payloads run up to an edge from either end of its block, and whole blocks add theirs. Work is in
    proportion to points and asked numbers times groups.
    """
    gap = (width - math.nextafter(width, 0)) / 2  # differences from width - gap on are rounded to width
    groups = points.groupBy("g").agg(F.min("payload").alias("every"), F.min(F.when(~_known(F.col("v")), F.col("payload"))).alias("odd"))
    pairs = asked.crossJoin(groups)
    block = lambda c: F.floor(c / width)
    edges = pairs.where(_known(F.col("q"))).select("q", "g", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    t, rest = _sum(F.col("q"), F.col("side") * float(width))
    edges = edges.select("q", "g", "side", t.alias("t"), rest.alias("rest"))
    v, e = _sum(F.col("t"), F.col("rest") - F.col("side") * gap)
    edges = edges.select("q", "g", "side", v.alias("v"), e.alias("e"))
    known = points.where(_known(F.col("v"))).select("g", "payload", F.lit(0).alias("side"), "v", F.lit(0.0).alias("e"))
    # a point on an edge is beyond it: it comes before the lower edge and after the upper one
    rows = known.unionByName(edges, allowMissingColumns=True).withColumns({"block": block(F.col("v")), "tie": -F.col("side")})
    order = ["v", "e", "tie"]
    runs = Window.partitionBy("g", "block").rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("payload")
    at_edges = rows.withColumn("below", least.over(runs.orderBy(*order))).withColumn("above", least.over(runs.orderBy(*[F.col(c).desc() for c in order]))).where("side <> 0")
    others = Window.partitionBy("g").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("g", "block").agg(least.alias("own"))
    blocks = blocks.withColumn("before", F.min("own").over(others.orderBy("block"))).withColumn("after", F.min("own").over(others.orderBy(F.col("block").desc())))
    lower = F.col("side") < 0
    found = at_edges.alias("r").join(blocks.alias("b"), F.col("r.g").eqNullSafe(F.col("b.g")) & (F.col("r.block") == F.col("b.block"))).select(
        "q", "r.g", F.when(lower, F.col("above")).otherwise(F.col("below")).alias("near"), F.when(lower, F.least("below", "before")).otherwise(F.least("above", "after")).alias("far")
    )
    spans = edges.groupBy("q", "g").agg(block(F.min("v")).alias("low"), block(F.max("v")).alias("high")).where("high - low >= 2").select("q", "g", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1)).alias("block"))
    between = spans.alias("s").join(blocks.alias("b"), F.col("s.g").eqNullSafe(F.col("b.g")) & (F.col("s.block") == F.col("b.block"))).select("q", "s.g", F.col("own").alias("near"))
    rest = pairs.select("q", "g", F.when(_known(F.col("q")), F.col("odd")).otherwise(F.col("every")).alias("far"))
    return found.unionByName(between, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True).groupBy("q", "g").agg(F.min("near").alias("near"), F.min("far").alias("far"))
