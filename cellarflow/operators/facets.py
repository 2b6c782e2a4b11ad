"""Facets of catalogue rows: agreement, closeness, similar rows, diversity, style profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.operators.skew import salted_join

# Steps of sweetness, what an unknown gap costs, axes' bounds.
SUGAR_STEPS = {"ekstra_bryut": 0, "extra_brut": 0, "brut": 1, "suhoe": 1, "polusuhoe": 2, "polusladkoe": 3, "sladkoe": 4}
UNKNOWN_STRENGTH_GAP, UNKNOWN_SUGAR_GAP, STRENGTH_STEP = 3.0, 9, 0.5


def sugar_step(column: Column | str) -> Column:
    """The ordinal step of a sugar class; null if it isn't known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SUGAR_STEPS.items() for x in pair]), F.lower(column))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of two sets, 0 if both are empty; a null set is an empty one."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in (a, b))
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def agreement_sets(a: Column, b: Column) -> Column:
    """match, conflict or unknown of two sets: unknown if either isn't filled."""
    return F.when((F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0), "unknown").when(F.arrays_overlap(a, b), "match").otherwise("conflict")


def agreement(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """match, conflict or unknown of two values; numbers may differ by ``tolerance``."""
    same = F.abs(a - b) <= tolerance if tolerance else a == b
    return F.when(a.isNull() | b.isNull(), "unknown").when(same, "match").otherwise("conflict")


def close_ordinal(a: Column, b: Column, step: int = 1) -> Column:
    """Within ``step`` on an ordinal scale; unknown passes."""
    return F.coalesce(F.abs(a - b) <= step, F.lit(True))


def differs(pairs: list[tuple[Column, Column]], strength: tuple[Column, Column] | None = None, sets: tuple[Column, Column] | None = None) -> Column:
    """Whether at least one known fact differs; unknown facts never do."""
    parts = [F.coalesce(a != b, F.lit(False)) for a, b in pairs]
    if strength:
        parts.append(F.coalesce(F.abs(strength[0] - strength[1]) >= STRENGTH_STEP, F.lit(False)))
    if sets:
        filled = (F.size(sets[0]) > 0) & (F.size(sets[1]) > 0)
        parts.append(F.coalesce(filled & (F.array_sort(sets[0]) != F.array_sort(sets[1])), F.lit(False)))
    result = parts[0]
    for part in parts[1:]:
        result = result | part
    return result


def pool(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal on each given column; None puts no restriction."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def one_per_group(df: DataFrame, by: list[str], group: str, order: list[Column | str], k: int) -> DataFrame:
    """The k first rows of each ``by``, the first of each group before any second one."""
    in_group = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
    ranked = df.withColumn("__in", in_group)
    place = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("__in") > 1), *order))
    return ranked.withColumn("place", place).where(F.col("place") <= k).drop("__in")


def with_contrast(ranked: DataFrame, by: list[str], place: str, contrast: str, k: int) -> DataFrame:
    """The k first places, the last one given to the first row beyond them that differs if none of the k does."""
    whole = Window.partitionBy(*by)
    some = F.max(F.when(F.col(place) <= k, F.col(contrast).cast("int"))).over(whole) == 1
    first = F.min(F.when((F.col(place) > k) & F.col(contrast), F.col(place))).over(whole)
    marked = ranked.withColumn("__some", some).withColumn("__first", first)
    kept = marked.where((F.col(place) < k) | ((F.col(place) == k) & (F.col("__some") | F.col("__first").isNull())) | (~F.col("__some") & (F.col(place) == F.col("__first"))))
    return kept.withColumn(place, F.least(F.col(place), F.lit(k))).drop("__some", "__first")


def similar_pairs(anchors: DataFrame, rows: DataFrame, block: str) -> DataFrame:
    """Anchor × row of one block, with the parts of the nearness key; an anchor never meets itself or its winery.

    Both have (slug, winery, category, grapes, sugar_class, strength) and the column ``block``; ``a_`` names the anchor's.
    A block of many pairs is cut into parts by the anchors' slugs. Rows of a null block meet nothing.
    """
    a = anchors.select(block, *[F.col(c).alias(f"a_{c}") for c in ("slug", "winery", "category", "grapes", "sugar_class", "strength")])
    pairs = salted_join(a, rows, block, "a_slug").where((F.col("slug") != F.col("a_slug")) & ~F.col("winery").eqNullSafe(F.col("a_winery")))
    gap = F.abs(sugar_step("sugar_class") - sugar_step("a_sugar_class"))
    return pairs.withColumn("alike", F.round(jaccard("grapes", "a_grapes"), 6)).withColumn("sugar_gap", F.coalesce(gap, F.lit(UNKNOWN_SUGAR_GAP))).withColumn("strength_gap", F.round(F.coalesce(F.abs(F.col("strength") - F.col("a_strength")), F.lit(UNKNOWN_STRENGTH_GAP)), 6))


def strength_axis(strength: Column) -> Column:
    """Strength in per cent to an axis from 0 to 5: 8 % and less is 0, 12 % is 2.5, 16 % and more is 5; null stays null."""
    return F.when(strength.isNotNull(), F.least(F.greatest((strength - 8.0) * (5.0 / 8.0), F.lit(0.0)), F.lit(5.0)))


def age_shift(vintage: Column, year: int) -> Column:
    """Years beyond three, at most twelve; null vintage shifts nothing."""
    return F.coalesce(F.when(F.lit(year) - vintage >= 3, F.least(F.lit(year) - vintage, F.lit(12))), F.lit(0))


def profile_distance(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Sum of differences over axes known on both sides (each over 5, two digits), and how many there are."""
    parts = [F.round(F.abs(x - y) / 5, 2) for x, y in zip(a, b)]
    known = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)), known
