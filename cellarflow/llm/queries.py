"""Queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.llm.bpe import encode_corpus
from cellarflow.llm.leaks import leaked_items
from cellarflow.llm.listings import product_groups, product_pairs
from cellarflow.llm.looks import same_look_pairs, with_looks
from cellarflow.llm.names import match_names
from cellarflow.llm.neighbours import nearest
from cellarflow.llm.overlaps import overlap_counts, split_overlaps
from cellarflow.llm.splits import Components, kept_splits, split_of_records
from cellarflow.llm.subjects import assign_subjects, composition
from cellarflow.session import Scratch
from cellarflow.sources.tables import table


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its group and what was read of it."""
    return product_groups(table(spark, sf_dir, "wine_cards"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of the same wine."""
    return product_pairs(p1_groups(spark, sf_dir))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlaps(table(spark, sf_dir, "frames"), table(spark, sf_dir, "predictions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation frame that are the same file or nearly the same picture."""
    return _overlaps(spark, sf_dir).select(F.least("train_id", "eval_id").alias("frame_id_a"), F.greatest("train_id", "eval_id").alias("frame_id_b"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps by evaluation split and source."""
    return overlap_counts(_overlaps(spark, sf_dir), table(spark, sf_dir, "frames"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar other vectors of every vector, with their cosine."""
    return nearest(table(spark, sf_dir, "index_vectors"), "vec_id", "vec").select(F.col("id").alias("vec_id"), F.col("other").alias("other_vec_id"), F.round("score", 6).alias("score"), "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of which one is among the ten most similar to the other."""
    found = p3_neighbours(spark, sf_dir)
    return found.select(F.least("vec_id", "other_vec_id").alias("vec_id_a"), F.greatest("vec_id", "other_vec_id").alias("vec_id_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tokens of one photo that look the same but are different strings."""
    return same_look_pairs(table(spark, sf_dir, "token_spans"), "token_id", "query_id", "text")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with one consistent form of its text, and the norm and skeleton built from that form."""
    tokens = table(spark, sf_dir, "token_spans").select("token_id", "query_id", "text")
    formed = with_looks(with_looks(tokens, {"text": "look"}), {"text": "form"}, script=True)
    norm = F.translate(F.lower("form"), "ё", "е")
    latin = F.translate(norm, "абвгдезийклмнопрстуфыэьъ", "abvgdeziiklmnoprstufye")
    for cyrillic, letters in (("ж", "zh"), ("х", "h"), ("ц", "ts"), ("ч", "c"), ("ш", "s"), ("щ", "s"), ("ю", "iu"), ("я", "ia")):
        latin = F.replace(latin, F.lit(cyrillic), F.lit(letters))
    return formed.select("token_id", "query_id", "look", "form", norm.alias("norm_form"), latin.alias("skeleton_form"))


def _kept(spark: SparkSession, *batches: DataFrame) -> Components:
    """The component table after the batches were added one after the other, saved and opened again each time."""
    path = Scratch(spark, "components").root
    for batch in batches:
        kept_splits(batch, "frame_id", ["group_key", "shooter"], path)
    return Components.open(spark, path)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame that is tied to a frame of smaller id, with the smallest of all frames tied to it; by the kept table."""
    members = _kept(spark, table(spark, sf_dir, "frames")).members
    return members.where("component < record").select(F.col("component").alias("lead_frame_id"), F.col("record").alias("frame_id"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with its component and its new split."""
    return split_of_records(_kept(spark, table(spark, sf_dir, "frames")), "frame_id")


def p5_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames' splits if those taken up to the middle of 2025 come first and the others are added to the kept tables."""
    frames = table(spark, sf_dir, "frames")
    early = F.coalesce(F.col("taken_at") < F.lit("2025-07-01").cast("timestamp_ntz"), F.lit(False))
    return split_of_records(_kept(spark, frames.where(early), frames.where(~early)), "frame_id")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that isn't blank with the entry it names (-1: none), its canonical form and norm, and how near they are."""
    entries = table(spark, sf_dir, "lex_entries")
    matched = match_names(table(spark, sf_dir, "text_lines"), "line_id", "text", entries)
    return matched.join(entries.select("entry_id", "canonical", "norm"), "entry_id", "left")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that isn't blank with the entry it names, or -1."""
    return match_names(table(spark, sf_dir, "text_lines"), "line_id", "text", table(spark, sf_dir, "lex_entries")).select("line_id", "entry_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the items."""
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each evaluation item that leaked: its split and the number of documents that hold it."""
    found = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return found.join(table(spark, sf_dir, "eval_items").select("item_id", "split_name", "lang"), "item_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document, with their sentences and their share of the sentences on any subject."""
    return assign_subjects(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "doc_subjects"), "doc_id", "subject_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that take up at least a fifth of a document's sentences on any."""
    return p10_shares(spark, sf_dir).select("doc_id", "subject_id")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents of each source are about: documents and their weight by subject."""
    return composition(table(spark, sf_dir, "documents"), p10_shares(spark, sf_dir), "doc_id", "subject_id", "source")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_neighbours": p3_neighbours, "p5_found": p5_found, "p5_splits": p5_splits, "p5_added": p5_added, "p4_found": p4_found, "p4_forms": p4_forms, "p7_found": p7_found, "p7_matches": p7_matches, "p8_ids": p8_ids, "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found, "p10_shares": p10_shares, "p10_composition": p10_composition}
_FRAMES = """known as (select frame_id as id, query_id, source, case when trim(lower(set_name), ' ') in ('train', 'training', 'trn') then 'train' when trim(lower(set_name), ' ') in ('validation', 'valid', 'val', 'dev') then 'validation'
  when trim(lower(set_name), ' ') in ('test', 'holdout') then 'test' end as split, nullif(regexp_replace(regexp_replace(lower(slug), '[\\s_-]+', '-', 'g'), '^-|-$', '', 'g'), '') as slug,
  case when regexp_full_match(lower(trim(dhash, ' ')), '[0-9a-f]{16}') then ('0x' || lower(trim(dhash, ' ')))::ubigint end as hash from frames),
digests as (select distinct query_id, d from (select query_id, regexp_replace(regexp_replace(lower(image_sha256), '^\\s*(sha-?256\\s*[:=]\\s*|0x)', ''), '[\\s:_-]', '', 'g') as d from predictions) where regexp_full_match(d, '[0-9a-f]{64}')),
f as (select id, split, d from known join digests using (query_id)),
pairs as (select a.id as t, b.id as e, true as same from f a join f b using (d) where a.split = 'train' and b.split <> 'train' union all
  select a.id, b.id, false from known a join known b using (slug) where a.split = 'train' and b.split <> 'train' and bit_count(xor(a.hash, b.hash)) <= 6)"""
_TIED = """k as (select frame_id as id, 'g' || key as key from (select frame_id, regexp_replace(lower(group_key), '[\\s_-]+', '', 'g') as key from frames) where key not in ('', 'unknown', 'нет', 'n/a') union all
  select frame_id, 's' || key from (select frame_id, regexp_replace(lower(shooter), '[\\s_-]+', '', 'g') as key from frames) where key not in ('', 'unknown', 'нет', 'n/a')),
hub as (select k.id, h.id as lead from k join (select key, min(id) as id from k group by 1) h using (key)), edge as (select id as a, lead as b from hub union select lead, id from hub),
reach(a, b) as (select a, a from edge union select reach.a, edge.b from reach join edge on edge.a = reach.b)"""
_UNIT = """v as (select vec_id, list_transform(vec, lambda x: x::double / sqrt(list_inner_product(vec::double[], vec::double[]))) as u from index_vectors where list_inner_product(vec::double[], vec::double[]) > 0),
n as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id qualify row_number() over (partition by a.vec_id order by round(list_inner_product(a.u, b.u), 12) desc, b.vec_id) <= 10)"""
SQL = {
    "p2_found": f"with {_FRAMES} select distinct least(t, e) as frame_id_a, greatest(t, e) as frame_id_b from pairs",
    "p2_counts": f"with {_FRAMES} select split, source, count(*) as n_pairs, count(*) filter (same) as n_same_file, count(distinct e) as n_records from (select t, e, bool_or(same) as same from pairs group by 1, 2) join known on known.id = e group by 1, 2",
    "p3_found": f"with {_UNIT} select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from n",
    "p3_neighbours": f"with {_UNIT.replace('b.vec_id as b from', 'b.vec_id as b, list_inner_product(a.u, b.u) as score, row_number() over (partition by a.vec_id order by round(list_inner_product(a.u, b.u), 12) desc, b.vec_id) as rank from')} select a as vec_id, b as other_vec_id, round(score, 6) as score, rank::int as rank from n",
    "p5_found": f"with recursive {_TIED} select min(b) as lead_frame_id, a as frame_id from reach group by a having min(b) < a",
}
