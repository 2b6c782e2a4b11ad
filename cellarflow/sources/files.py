"""Readers and sinks of the file formats: explicit schemas, problems reported, first row wins, gates on versions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a line by a given schema; blank lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_jsonl_with_problems(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and (place, key, problem) of lines that don't parse, lack the key or repeat it.

    Lines are numbered within the text file by Spark's own row position, so "first" is the first in the file.
    """
    numbered = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("place")).where(F.trim("value") != "")
    parsed = numbered.select("__f", "place", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("__f", "place", "r.*")
    order = F.row_number().over(Window.partitionBy(key).orderBy("__f", "place"))
    marked = parsed.withColumn("__n", F.when(F.col("_bad").isNull() & F.col(key).isNotNull(), order))
    # rows without the key are numbered among themselves and never first
    problem = F.when(F.col("_bad").isNotNull(), "not JSON").when(F.col(key).isNull(), "no key").when(F.col("__n") > 1, "repeated")
    good = marked.where("__n = 1").drop("_bad", "__n", "__f", "place")
    return good, marked.withColumn("problem", problem).where("problem is not null").select("place", key, "problem")


def read_table_file(spark: SparkSession, path: str, columns: list[str], separator: str = "\t") -> DataFrame:
    """A delimited file with header, all strings; rows that are too short are filled with empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep=separator, header=True, mode="PERMISSIVE", enforceSchema=True, quote='"', escape='"', multiLine=False)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; reading a row whose key comes twice is an error."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("key twice: "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("__n")


def checked_manifest(df: DataFrame, key: str, path: str) -> DataFrame:
    """A manifest with unique keys and paths that stay inside their folder; anything else is an error when it is read."""
    unsafe = F.col(path).rlike(r"(^|/)\.\.(/|$)|^/|\\|^\s*$")
    return unique(df.withColumn(path, F.when(F.coalesce(unsafe, F.lit(True)), F.raise_error(F.concat(F.lit("path not allowed: "), F.coalesce(path, F.lit("null"))))).otherwise(F.col(path))), key)


def resolve_map(df: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with values replaced by corrections of the same key, where there are any."""
    fixed = corrections.select(key, F.col(value).alias("__v"))
    return df.join(fixed, key, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def save_index(index: DataFrame, path: str, model: str) -> None:
    """An index of vectors (slug, view, is_base, vec) as Parquet, with its passport beside it."""
    dims = index.agg(F.max(F.size("vec")).alias("dim"), F.countDistinct("slug").alias("n_slugs"), F.count("*").alias("n_vectors")).withColumn("model", F.lit(model))
    index.write.mode("overwrite").parquet(f"{path}/rows")
    dims.coalesce(1).write.mode("overwrite").json(f"{path}/passport")


def load_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The index saved at a path; an error if another model made it or rows are missing."""
    passport = spark.read.schema("dim int, n_slugs long, n_vectors long, model string").json(f"{path}/passport").first()
    if passport is None or passport.model != model:
        raise ValueError(f"index of model {passport and passport.model}, wanted {model}")
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != passport.n_vectors:
        raise ValueError("index is not complete")
    return rows


def model_to_json(weights: list[dict], features: int, temperature: float = 1.0) -> str:
    return json.dumps({"format": 1, "features": features, "temperature": temperature, "weights": weights}, sort_keys=True)


def model_from_json(text: str, features: int) -> dict:
    """A model of format 1 and the given version of the features; anything else is an error."""
    model = json.loads(text)
    if model.get("format") != 1 or model.get("features") != features:
        raise ValueError(f"model of format {model.get('format')} and features {model.get('features')}")
    return model


def cached_readings(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the content-addressed cache has of the wanted keys, and what is missing."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def cacheable(readings: DataFrame, key: str, failure: str) -> DataFrame:
    """Readings to add to a cache: failures of the environment never are; the first of each key."""
    return readings.where(F.col(failure).isNull()).dropDuplicates([key])


def write_by_split(df: DataFrame, path: str, split: str = "split", sealed: str = "test") -> None:
    """Rows by split in folders of their own, those of the sealed split under a path that reports don't read."""
    df.where(F.col(split) != sealed).write.mode("overwrite").partitionBy(split).parquet(f"{path}/open")
    df.where(F.col(split) == sealed).write.mode("overwrite").parquet(f"{path}/sealed")


def merge_patch_text(target: str | None, patch: str | None) -> str | None:
    """JSON merge patch: objects merge by key, null removes, anything else replaces."""

    def merge(a: object, b: object) -> object:
        if not isinstance(b, dict):
            return b
        a = dict(a) if isinstance(a, dict) else {}
        for key, value in b.items():
            if value is None:
                a.pop(key, None)
            else:
                a[key] = merge(a.get(key), value)
        return a

    if patch is None:
        return target
    return json.dumps(merge(json.loads(target) if target else {}, json.loads(patch)), sort_keys=True, ensure_ascii=False)


def sitemap_slugs(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(slug): the distinct slugs that a page lists."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("slug")).distinct()


def table_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the table whatever the order of its rows, and how many there are."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def strict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df``; a row that fails a named check is an error when it is read."""
    first = df.columns[0]
    bad = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return df.withColumn("__bad", bad).withColumn(first, F.when(F.col("__bad").isNotNull(), F.raise_error(F.concat(F.lit("check failed: "), "__bad"))).otherwise(F.col(first))).drop("__bad")


def query_set(records: DataFrame, name: str, key: str, slug: str, folder: str, suffix: str, number: str | None = None, needs_slug: bool = False) -> DataFrame:
    """(query_id, image_path, slug, meta) of one set of queries: what is asked, where its picture lies, what it shows.

    A record without a key, or with ``needs_slug`` without a slug, and a key that comes twice are errors when they are
    read. A null slug means that the thing isn't in the catalogue. ``number`` names a column of the record's place in its
    file, which is then the seed of its distortion. Other columns are dropped.
    """
    trimmed = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    missing = trimmed(key).isNull() | (trimmed(slug).isNull() if needs_slug else F.lit(False))
    query = F.when(missing, F.raise_error(F.concat(F.lit(f"{name}: key or slug missing: "), F.coalesce(trimmed(key), F.lit("null"))))).otherwise(trimmed(key))
    meta = [F.lit("set"), F.lit(name)] + ([F.lit("seed"), F.col(number).cast("string")] if number else [])
    rows = records.select(query.alias("query_id"), F.concat(F.lit(f"{folder}/"), trimmed(key), F.lit(suffix)).alias("image_path"), trimmed(slug).alias("slug"), F.create_map(*meta).alias("meta"))
    return unique(rows, "query_id")


def load_queries(name: str, sets: dict[str, DataFrame]) -> DataFrame:
    """The query set of a name; an unknown name is an error, no empty set."""
    if name not in sets:
        raise ValueError(f"no query set {name}: one of {', '.join(sorted(sets))}")
    return sets[name]


# What a conversation's context may hold.
CONTEXT_STRINGS, MOST_SHOWN, MOST_SIGNS = ["intent", "dish", "food", "want", "step", "refusal_topic"], 12, 200


def checked_context(column: Column | str, known: dict[str, list[str]]) -> Column:
    """(problem, context): a JSON text checked and read as a context.

    Null is an empty context. A problem, the first of: no object, a string field of another type or too long, ``shown``
    no list of strings, too long a list or too long a string in it. Other keys are ignored, values that ``known`` doesn't
    list for their field become null, and shown things count once, in order.
    """
    column = F.col(column) if isinstance(column, str) else column
    parsed = F.try_parse_json(column)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("VOID"))
    text = lambda name: F.try_variant_get(parsed, f"$.{name}", "string")
    shown = F.try_variant_get(parsed, "$.shown", "array<string>")
    checks = [(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")]
    for name in CONTEXT_STRINGS:
        checks += [(~kind(f"$.{name}").isin("STRING", "VOID"), f"{name}: no string"), (F.length(text(name)) > MOST_SIGNS, f"{name}: too long")]
    checks += [(~kind("$.shown").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), "shown: no list of strings"), ((F.size(shown) > MOST_SHOWN) | F.exists(shown, lambda x: F.length(x) > MOST_SIGNS), "shown: too long")]
    problem = F.when(column.isNull(), F.lit(None).cast("string")).when(parsed.isNull(), "no JSON")
    for bad, name in checks:
        problem = problem.when(F.coalesce(bad, F.lit(False)), name)
    kept = [F.when(text(n).isin(known[n]) if n in known else text(n) != "", text(n)).alias(n) for n in CONTEXT_STRINGS]
    context = F.struct(*kept, F.coalesce(F.array_distinct(shown), F.array().cast("array<string>")).alias("shown"))
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), context).alias("context"))
