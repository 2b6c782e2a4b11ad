"""Queries of vector retrieval on the embeddings: label is the entity, vec_id % 3 the view, and every row whose id is divisible by 20 is a query window against all other rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.operators import vectors as V
from cellarflow.sources.tables import table


def _index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("row_id"), F.col("label").alias("slug"), (F.col("vec_id") % 3).alias("view"), (F.col("vec_id") % 5 != 1).alias("is_base"), F.col("embedding").alias("vec"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id % 20 = 0")
    return rows.select(F.expr("vec_id div 100").alias("query"), F.col("vec_id").alias("window"), F.col("embedding").alias("vec"))


def _sims(spark: SparkSession, d: str, align: bool = False, all_base: bool = False) -> DataFrame:
    index = _index(spark, d)
    return V.similarities(index.withColumn("is_base", F.lit(True)) if all_base else index, _queries(spark, d), skip_self=True, align=align)


def _slugs(spark: SparkSession, d: str, how: str) -> DataFrame:
    return V.per_slug(_index(spark, d), _queries(spark, d), how, skip_self=True)


def vr01_unit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.unit("embedding")).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 5).alias("x"))


def vr02_similarities(spark: SparkSession, d: str) -> DataFrame:
    return _sims(spark, d).select("query", "window", "row_id", F.round("sim", 5).alias("sim"))


def vr03_best_window(spark: SparkSession, d: str) -> DataFrame:
    return V.best_window(_index(spark, d), _queries(spark, d), skip_self=True).select("query", "row_id", F.round("best", 5).alias("best"))


def vr04_slug_max(spark: SparkSession, d: str) -> DataFrame:
    return _slugs(spark, d, "max").select("query", "slug", F.round("score", 5).alias("score"), "view")


def vr05_slug_mean(spark: SparkSession, d: str) -> DataFrame:
    return _slugs(spark, d, "mean").select("query", "slug", F.round("score", 5).alias("score"))


def vr06_aligned(spark: SparkSession, d: str) -> DataFrame:
    return _sims(spark, d, align=True, all_base=True).select("query", "window", "row_id", F.round("aligned", 5).alias("aligned"))


def vr07_aligned_base(spark: SparkSession, d: str) -> DataFrame:
    return _sims(spark, d, align=True).select("query", "window", "row_id", F.round("aligned", 5).alias("aligned"))


def vr08_search_zmax(spark: SparkSession, d: str) -> DataFrame:
    found = V.search(_index(spark, d), _queries(spark, d), 5, skip_self=True)
    return found.select("query", "slug", F.round("score", 5).alias("score"), "view", "rank", F.round("margin", 5).alias("margin"))


def vr10_search_max(spark: SparkSession, d: str) -> DataFrame:
    found = V.search(_index(spark, d), _queries(spark, d), 3, "max", skip_self=True)
    return found.select("query", "slug", F.round("score", 5).alias("score"), "view", "rank", F.round("margin", 5).alias("margin"))


def _map(dim: int = 64, out: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """A fixed linear map that SQL can repeat: mean 0.01 * (i % 5), weight 1 / (1 + (i + 3 j) % 7)."""
    i, j = np.arange(dim)[:, None], np.arange(out)[None, :]
    return 0.01 * (np.arange(dim) % 5), 1.0 / (1 + (i + 3 * j) % 7)


def vr11_adapter(spark: SparkSession, d: str) -> DataFrame:
    mapped = V.apply_linear(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", *_map())
    return mapped.select("vec_id", F.posexplode("mapped").alias("pos", "x")).select("vec_id", "pos", F.round("x", 5).alias("x"))


def vr12_whitened(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    mean, matrix = V.pca_whitening(rows, "embedding", dims=16)
    return V.apply_linear(rows, "embedding", mean, matrix).select("vec_id", "mapped")


def vr13_learned_whitening(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    mean, matrix = V.learned_whitening(rows.join(first, "label"), "embedding", "anchor", dims=16)
    return V.apply_linear(rows.select("vec_id", "embedding"), "embedding", mean, matrix).select("vec_id", "mapped")


def vr16_text_top_slugs(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "token_spans").where("norm is not null").select("query_id", "norm")
    entries = table(spark, d, "lex_entries").where("not is_part").select("norm", F.col("lex_field").alias("field"), "canonical", "idf", "slugs")
    hits = tokens.join(entries, "norm").select(F.col("query_id").alias("query"), "field", "canonical", "idf", F.lit(0.0).alias("cost"), "slugs")
    return V.text_top_slugs(hits, 3).select("query", "slug", F.round("score", 6).alias("score"), "rank")


def jn13_neighbour_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("vec"))
    voted = V.neighbour_vote(rows.where("row_id % 20 = 0").select("row_id", "vec"), rows, near=0.05, skip_self=True)
    return voted.select("row_id", "label", F.round("share", 5).alias("share"))


_SIMS = """sims as (select q.vec_id // 100 as query, q.vec_id as "window", i.vec_id as row_id, i.label as slug, i.vec_id % 3 as view, i.vec_id % 5 <> 1 as is_base,
  list_inner_product(i.embedding::double[], q.embedding::double[]) as sim from embeddings i, embeddings q where i.vec_id <> q.vec_id and q.vec_id % 20 = 0)"""
_ALIGNED = """aligned as (select *, case when sd < 1e-6 or block_sd < 1e-6 then sim else mean + sd * (sim - block_mean) / block_sd end as aligned from (select *,
  avg(case when {base} then sim end) over (partition by query, "window", view) as block_mean, stddev_pop(case when {base} then sim end) over (partition by query, "window", view) as block_sd,
  avg(case when {base} then sim end) over (partition by query) as mean, stddev_pop(case when {base} then sim end) over (partition by query) as sd from sims))"""
_TOP = """slugs as (select query, slug, max(best) as score, arg_max(view, struct_pack(b := best, r := -row_id)) as view from (select query, row_id, slug, view, max({score}) as best from {source} group by all) group by query, slug),
firsts as (select label as slug, min(vec_id) as first from embeddings group by 1),
ranked as (select *, row_number() over (partition by query order by round(score, 12) desc, first) as rank, coalesce(greatest(score - lead(score) over (partition by query order by round(score, 12) desc, first), 0), 0) as gap from slugs join firsts using (slug))
select query, slug, round({shown}, 5) as score, view, rank::int as rank, round(max(case when rank = 1 then gap end) over (partition by query), 5) as margin from ranked qualify rank <= {k}"""

QUERIES = {f.__name__: f for f in (vr01_unit, vr02_similarities, vr03_best_window, vr04_slug_max, vr05_slug_mean, vr06_aligned, vr07_aligned_base, vr08_search_zmax, vr10_search_max, vr11_adapter, vr12_whitened, vr13_learned_whitening, vr16_text_top_slugs, jn13_neighbour_vote)}
SQL = {
    "vr01_unit": "select vec_id, (p - 1)::int as pos, round(embedding[p]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 5) as x from embeddings, range(1, 65) t(p)",
    "vr02_similarities": f'with {_SIMS} select query, "window", row_id, round(sim, 5) as sim from sims',
    "vr03_best_window": f"with {_SIMS} select query, row_id, round(max(sim), 5) as best from sims group by all",
    "vr04_slug_max": f"with {_SIMS} select query, slug, round(max(best), 5) as score, arg_max(view, struct_pack(b := best, r := -row_id)) as view from (select query, row_id, slug, view, max(sim) as best from sims group by all) group by query, slug",
    "vr05_slug_mean": f"with {_SIMS} select query, slug, round(avg(best), 5) as score from (select query, row_id, slug, max(sim) as best from sims group by all) group by query, slug",
    "vr06_aligned": f'with {_SIMS}, {_ALIGNED.format(base="true")} select query, "window", row_id, round(aligned, 5) as aligned from aligned',
    "vr07_aligned_base": f'with {_SIMS}, {_ALIGNED.format(base="is_base")} select query, "window", row_id, round(aligned, 5) as aligned from aligned',
    "vr08_search_zmax": f"with {_SIMS}, {_ALIGNED.format(base='is_base')}, {_TOP.format(score='aligned', source='aligned', shown='greatest(score, 0)', k=5)}",
    "vr10_search_max": f"with {_SIMS}, {_TOP.format(score='sim', source='sims', shown='least(greatest(score, 0), 1)', k=3)}",
    "vr11_adapter": """with m as (select vec_id, o.j, sum((embedding[i.i + 1]::double - 0.01 * (i.i % 5)) / (1 + (i.i + 3 * o.j) % 7)) as y from embeddings, range(64) i(i), range(8) o(j) group by all)
select vec_id, j::int as pos, round(y / sqrt(sum(y * y) over (partition by vec_id)), 5) as x from m""",
    "vr16_text_top_slugs": """with votes as (select query_id as query, lex_field, canonical, max(idf) as vote, any_value(slugs) as slugs from token_spans join lex_entries using (norm) where not is_part group by all),
sums as (select query, slug, sum(vote) as score from (select query, vote, unnest(slugs) as slug from votes) group by all)
select query, slug, round(score, 6) as score, (row_number() over (partition by query order by round(score, 9) desc, slug))::int as rank from sums qualify rank <= 3""",
    "jn13_neighbour_vote": """with s as (select i.vec_id as row_id, a.label, round(list_inner_product(i.embedding::double[], a.embedding::double[]), 12) as sim, row_number() over (partition by i.vec_id order by sim desc, a.vec_id) as n
  from embeddings i, embeddings a where i.vec_id % 20 = 0 and a.vec_id <> i.vec_id), w as (select row_id, label, sum(greatest(sim - 0.05, 0)) as weight from s where n <= 5 group by all),
r as (select *, sum(weight) over (partition by row_id) as total from w qualify row_number() over (partition by row_id order by weight desc, label) = 1)
select row_id, case when weight / nullif(total, 0) >= 0.55 then label end as label, round(case when weight / nullif(total, 0) >= 0.55 then weight / nullif(total, 0) end, 5) as share from r""",
}
