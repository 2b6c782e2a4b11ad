"""Global order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.session import Scratch


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in a global order, from 0; the order has to be total.

    A range-partitioned sort is written with each row's place in its partition; the partitions' sizes, one number for
    each, give the offsets. Equal leading keys, however frequent, are parted by the columns behind them.
    """
    scratch = Scratch(df.sparkSession, "order")
    sorted_ = scratch.save(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    part, at = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = {r.p: r.n for r in sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    table = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return sorted_.withColumn(name, F.element_at(table, part.cast("int")).cast("long") + at).drop("__m")


def running_sums(df: DataFrame, order: list[Column | str], columns: list[str]) -> DataFrame:
    """``df`` with ``sum_`` columns: the sums of ``columns`` up to and with each row in a global order, which has to be total.

    As in ``numbered``: a range-partitioned sort is written, the sums of its partitions, a few numbers for each, give what
    comes before each partition, and the rest is added up within partitions.
    """
    scratch = Scratch(df.sparkSession, "sums")
    sorted_ = scratch.save(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted").withColumn("__p", F.shiftright("__m", 33).cast("int"))
    before, total = [], [0] * len(columns)
    for r in sorted_.groupBy("__p").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("__p").collect():
        before.append((r["__p"], list(total)))
        total = [t + r[c] for t, c in zip(total, columns)]
    base = F.create_map(*[x for p, sums in before for x in (F.lit(p), F.array(*[F.lit(v).cast("long") for v in sums]))]) if before else F.create_map(F.lit(0), F.array(*[F.lit(0).cast("long") for _ in columns]))
    up = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    return sorted_.withColumns({f"sum_{c}": F.sum(c).over(up) + F.element_at(F.element_at(base, F.col("__p")), i + 1) for i, c in enumerate(columns)}).drop("__m", "__p")


def tiles(number: Column, n: Column, k: int) -> Column:
    """The tile from 1 of a place from 0 among n rows in k tiles, the first ones one row larger."""
    size, rest = F.floor(n / k), F.pmod(n, F.lit(k))
    large = rest * (size + 1)
    tile = F.when(number < large, F.floor(number / (size + 1))).otherwise(rest + F.floor((number - large) / F.greatest(size, F.lit(1))))
    return (tile + 1).cast("int")
