"""Records of evaluation splits that lie, as the same file or nearly the same picture, in the training split.

A weighted cosine join: records are vectors of weighted terms of length 1, the terms in one global order, rarest
first. Of each vector only a prefix is put into the inverted lists: its rest can't reach the threshold, by the largest
weight that each term has on the other side or by the norm of the rest. Pairs that meet in a list are taken at their
first common term only, their exact dot product is computed, and the pairs are counted by groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.operators.skew import salted_join
from cellarflow.session import Scratch

# How the names of the splits are written.
TRAIN = ["train", "training", "trn"]
VALIDATION = ["validation", "valid", "val", "dev"]
TEST = ["test", "holdout"]
MOST_BITS = 6
BANDS = 8  # bytes of a hash; with at most MOST_BITS of them touched at least BANDS - MOST_BITS agree


def split_name(column: Column | str) -> Column:
    """train, validation or test; null for anything else."""
    plain = F.lower(F.trim(F.regexp_replace(column, r"[\s_-]+", " ")))
    return F.when(plain.isin(TRAIN), "train").when(plain.isin(VALIDATION), "validation").when(plain.isin(TEST), "test")


def plain_digest(column: Column | str) -> Column:
    """64 hex digits in small letters, without prefix, spaces and separators; null if that isn't what is left."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(column), r"^\s*(sha-?256\s*[:=]\s*|0x)", ""), r"[\s:_-]", "")
    return F.when(digits.rlike("^[0-9a-f]{64}$"), digits)


def plain_slug(column: Column | str) -> Column:
    """A slug in small letters with single hyphens; null if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(column), r"[\s_-]+", "-"), "^-|-$", "")
    return F.when(slug != "", slug)


def plain_hash(column: Column | str) -> Column:
    """A 64-bit picture hash as a long; null if it isn't 16 hex digits."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(column), r"^\s*0x", ""), r"[\s:_-]", "")
    high, low = (F.conv(F.substring(digits, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.when(digits.rlike("^[0-9a-f]{16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def weighted_cosine_join(left: DataFrame, right: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs (id_a, id_b, dot) of a row of ``left`` and one of ``right`` whose dot product is at least ``least``.

    Both have (id, terms array<string>, weights array<double>, least double) with vectors of length 1 or less, no term
    twice in a vector, and columns ``extra`` that come along as ``name_a``, ``name_b``; rows that share a term have
    one ``least``. Every pair is found, none twice. Vectors without terms or null pair with nothing. The prefixes are
    written to the shared folder, so that counting hot terms doesn't make them twice.
    """
    scratch = Scratch(left.sparkSession, "cosine")

    def exploded(df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, F.explode(F.arrays_zip("terms", "weights")).alias("x")).select(*keep, F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))

    def stats(df: DataFrame, name: str) -> DataFrame:
        return exploded(df, []).groupBy("term").agg(F.count("*").alias(f"df_{name}"), F.max("weight").alias(f"max_{name}"))

    # a term that only one side has can't be part of a dot product
    terms = stats(left, "l").join(stats(right, "r"), "term").withColumn("df", F.col("df_l") + F.col("df_r"))

    def prefixed(df: DataFrame, other: str) -> DataFrame:
        """The prefix terms of each vector, each with the whole vector in the global order."""
        rows = exploded(df, ["id", "least", *extra]).join(terms.select("term", "df", F.col(f"max_{other}").alias("most")), "term")
        vector = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "weight", "most"))).alias("vec"), *[F.first(c).alias(c) for c in ["least", *extra]])
        backwards = Window.partitionBy("id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
        places = vector.select("id", "vec", "least", *extra, F.posexplode("vec").alias("place", "x"))
        bound = F.least(F.sum(F.col("x.weight") * F.col("x.most")).over(backwards), F.sqrt(F.sum(F.col("x.weight") ** 2).over(backwards)))
        # the term at a place belongs to the prefix if what begins there could still reach the threshold
        kept = places.withColumn("bound", bound).where(F.col("bound") >= F.col("least") - 1e-9)
        return kept.select("id", "place", F.col("x.term").alias("term"), F.col("vec.term").alias("all"), F.col("vec.weight").alias("w"), "least", *extra)

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select("term", *[F.col(c).alias(f"{c}_{side}") for c in ["id", "place", "all", "w", "least", *extra]])

    met = salted_join(scratch.save(named(prefixed(left, "r"), "a"), "left"), scratch.save(named(prefixed(right, "l"), "b"), "right"), "term", "id_a")
    # the first common term: none of the terms before it in a are in b
    first = ~F.arrays_overlap(F.slice("all_a", 1, F.col("place_a")), F.slice("all_b", 1, F.col("place_b")))
    dot = F.aggregate(
        F.zip_with("all_a", "w_a", lambda t, w: w * F.coalesce(F.try_element_at("w_b", F.nullif(F.array_position("all_b", t), F.lit(0)).cast("int")), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x
    )
    pairs = met.where(first | (F.col("place_a") == 0) | (F.col("place_b") == 0)).withColumn("dot", dot).where(F.col("dot") >= F.col("least_a") - 1e-9)
    return pairs.select("id_a", "id_b", "dot", *[f"{c}_{s}" for c in extra for s in "ab"])


def split_overlaps(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """(train_id, eval_id, same_file, bits): a training and a validation or test record that overlap.

    They overlap if they have one image digest, whatever their slugs, or one slug and picture hashes that differ in at
    most MOST_BITS bits. Digests, slugs, hashes and split names count as equal however they are written. ``bits`` is
    null where slugs or hashes don't allow to compare. Rows without a split, digest, slug or hash that can be read
    take no part in what needs it; repeated predictions count once; empty tables give no pairs.
    """
    digests = predictions.select("query_id", plain_digest("image_sha256").alias("digest")).where("digest is not null and query_id is not null").distinct()
    known = frames.select(F.col("frame_id").alias("id"), "query_id", split_name("set_name").alias("split"), plain_slug("slug").alias("slug"), plain_hash("dhash").alias("hash")).where("split is not null")
    # one vector for the file, one for the picture; a key of both kinds and records keeps them apart
    vector = lambda kind, terms, weight, least: [F.struct(F.lit(kind).alias("kind"), "id").alias("id"), "split", F.array(*terms).alias("terms"), F.array(*[F.lit(weight)] * len(terms)).alias("weights"), F.lit(least).alias("least"), "slug", "hash", "digest"]
    # terms as 64-bit hashes; slug, bits and digest are compared themselves in the end
    bands = [F.xxhash64(F.col("slug"), F.lit(i), F.shiftright("hash", 8 * i).bitwiseAND(255)) for i in range(BANDS)]
    files = known.join(digests, "query_id").select(*vector("file", [F.xxhash64("digest")], 1.0, 1.0))
    pictures = known.where("slug is not null and hash is not null").withColumn("digest", F.lit(None).cast("string")).select(*vector("picture", bands, 1.0 / BANDS**0.5, (BANDS - MOST_BITS) / BANDS))
    vectors = Scratch(frames.sparkSession, "overlaps").save(files.unionByName(pictures), "vectors")
    met = weighted_cosine_join(vectors.where("split = 'train'"), vectors.where("split <> 'train'"), ["slug", "hash", "digest"])
    bits = F.when(F.col("slug_a") == F.col("slug_b"), F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))))
    pairs = met.select(F.col("id_a.id").alias("train_id"), F.col("id_b.id").alias("eval_id"), (F.coalesce(F.col("id_a.kind") == "file", F.lit(False)) & F.coalesce(F.col("digest_a") == F.col("digest_b"), F.lit(False))).alias("same_file"), bits.alias("bits"))
    return pairs.where(F.col("same_file") | (F.col("bits") <= MOST_BITS)).groupBy("train_id", "eval_id").agg(F.max("same_file").alias("same_file"), F.min("bits").alias("bits"))


def overlap_counts(overlaps: DataFrame, frames: DataFrame) -> DataFrame:
    """Of each evaluation split and source: pairs, those with one file, and the evaluation records concerned."""
    named = frames.select(F.col("frame_id").alias("eval_id"), split_name("set_name").alias("split"), "source")
    return overlaps.join(named, "eval_id").groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.count_if("same_file").alias("n_same_file"), F.countDistinct("eval_id").alias("n_records"))
