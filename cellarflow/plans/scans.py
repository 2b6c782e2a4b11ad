"""Queries of sources and sinks: tables are written in each format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.operators import rules as R
from cellarflow.operators.text import by_distinct
from cellarflow.session import Scratch
from cellarflow.sources import files as S
from cellarflow.sources.tables import table


def _path(spark, name):
    return f"{Scratch(spark, 'files').root}/{name}"


def io01_jsonl(spark, d):
    path = _path(spark, "events")
    events = table(spark, d, "events")
    events.select(F.concat(F.to_json(F.struct("event_id", "event_type", "value")), F.when(F.col("event_id") % 7 == 0, "\n\n").otherwise("")).alias("value")).write.text(path)
    return S.read_jsonl(spark, path, "event_id long, event_type string, value double")


def io02_tsv(spark, d):
    path = _path(spark, "part")
    short = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws("\t", "p_partkey", "p_name")).otherwise(F.concat_ws("\t", "p_partkey", "p_name", "p_brand"))
    body = table(spark, d, "part").select(short.alias("value"))
    header = spark.createDataFrame([("p_partkey\tp_name\tp_brand",)], "value string")
    header.unionByName(body).coalesce(1).write.text(path)
    return S.read_table_file(spark, path, ["p_partkey", "p_name", "p_brand"])


def io03_first_wins(spark, d):
    return S.first_per_key(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_linenumber")


def io04_photo_map(spark, d):
    base = table(spark, d, "strapi_output0709").groupBy("slug").agg(F.min("nazvanie_foto").alias("photo"))
    return S.resolve_map(base, base.where("photo like '%7.webp'").withColumn("photo", F.concat(F.lit("fixed-"), "photo")), "slug", "photo")


def io05_manifest(spark, d):
    rows = table(spark, d, "frames").select("query_id", F.concat(F.lit("images/"), "query_id", F.lit(".jpg")).alias("path"))
    return S.checked_manifest(rows, "query_id", "path")


def io06_ground_truth(spark, d):
    return S.unique(table(spark, d, "frames").select("query_id", "slug"), "query_id")


def io07_problems(spark, d):
    path = _path(spark, "predictions")
    rows = table(spark, d, "predictions").select(F.when(F.col("margin") > 0.3, F.lit("{broken")).when(F.col("predicted_slug").isNull(), F.to_json(F.struct("latency_ms"))).otherwise(F.to_json(F.struct("query_id", "latency_ms"))).alias("value"))
    rows.coalesce(1).write.text(path)
    good, problems = S.read_jsonl_with_problems(spark, path, "query_id string, latency_ms long", "query_id")
    return problems.groupBy("problem").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("good").alias("problem"), F.count("*").alias("n")))


def io08_annotations(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id"), F.from_json("props", "k int").alias("p"))
    return S.unique(rows.select("event_id", F.col("p.k").alias("k")), "event_id")


def io09_built_index(spark, d):
    """An index row for each position and view of the catalogue from its stored vectors: mean of the view's vectors."""
    rows = table(spark, d, "index_vectors").where("vec is not null and slug is not null").select("slug", "view_name", F.posexplode("vec").alias("i", "x"))
    means = rows.groupBy("slug", "view_name", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("slug", "view_name").agg(F.count("*").alias("dim"), F.round(F.sum("x"), 5).alias("total"))


def io10_index(spark, d):
    path = _path(spark, "index")
    S.save_index(table(spark, d, "embeddings").select(F.col("label").cast("string").alias("slug"), (F.col("vec_id") % 3).alias("view"), F.lit(True).alias("is_base"), F.col("embedding").alias("vec")), path, "toy-64")
    return S.load_index(spark, path, "toy-64").groupBy("slug", "view").agg(F.count("*").alias("n"))


def io11_dictionary(spark, d):
    path = _path(spark, "lexicon")
    rows = table(spark, d, "lex_entries").select("entry_id", "lex_field", "canonical", "slugs")
    rows.write.json(path)
    return S.read_jsonl(spark, path, rows.schema).select("entry_id", "lex_field", "canonical", F.size("slugs").alias("n_slugs"))


def io12_model(spark, d):
    model = S.model_from_json(S.model_to_json([{"name": "l_tax", "coef": 2.0, "mean": 0.04, "scale": 0.02}], 3), 3)
    from cellarflow.operators.ranking import linear_score

    return table(spark, d, "lineitem").agg(F.round(F.sum(linear_score(model["weights"])), 2).alias("total"))


def io13_cache(spark, d):
    lines = table(spark, d, "text_lines").select("line_id", F.sha2(F.concat_ws("|", "reader", "text"), 256).alias("key"), F.when(F.col("conf") < 0.6, "timeout").alias("failure"), "text")
    cache = S.cacheable(lines.where("line_id % 2 = 0").select("key", "failure", F.length("text").alias("n")), "key", "failure").select("key", "n")
    hit, miss = S.cached_readings(lines.select("line_id", "key"), cache, "key")
    return hit.agg(F.lit("hit").alias("state"), F.count("*").alias("n")).unionByName(miss.agg(F.lit("miss").alias("state"), F.count("*").alias("n")))


def io14_append_log(spark, d):
    path = _path(spark, "log")
    kinds = [r.event_type for r in table(spark, d, "events").select("event_type").distinct().collect()]
    for kind in kinds:
        table(spark, d, "events").where(F.col("event_type").eqNullSafe(F.lit(kind))).select("event_id", "event_type").write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def io15_sealed(spark, d):
    path = _path(spark, "splits")
    split = F.when(F.lower(F.trim("set_name")).isin("test", "holdout"), "test").otherwise("dev")
    S.write_by_split(table(spark, d, "frames").select("frame_id", "source", split.alias("split")), path)
    return spark.read.parquet(f"{path}/open").groupBy("split").agg(F.count("*").alias("n"))


def io16_merge_patch(spark, d):
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("props").alias("p"), F.lit('{"k": null, "z": 1}').alias("q"))).alias("both"))
    apply = lambda x: S.merge_patch_text(__import__("json").loads(x)["p"], __import__("json").loads(x)["q"])
    return by_distinct(rows, "both", "state", apply, T.StringType()).select("event_id", "state")


def io17_sitemap(spark, d):
    pages = table(spark, d, "catalog_positions").groupBy("category").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("slug")), lambda s: F.concat(F.lit("<loc>https://x.test/wine/"), s, F.lit("</loc>")))).alias("xml"))
    return S.sitemap_slugs(pages, "xml", "/wine/([a-z0-9-]+)</loc>")


def io19_layered_rules(spark, d):
    base = table(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("double").alias("weight"), F.col("p_name").alias("text"))
    over = base.where("weight > 40").select("id", F.lit(1.0).alias("weight"), F.lit("over").alias("text"))
    patch = base.where("text like 'red%'").select("id", F.lit(None).cast("double").alias("weight"), F.lit("patched").alias("text"))
    added = spark.createDataFrame([("n1", 5.0, "new")], "id string, weight double, text string")
    return R.layered_rules(base, over, patch, ["r1", "r2"], added)


def io20_strict(spark, d):
    rows = table(spark, d, "lex_entries").select("entry_id", "lex_field", "canonical", F.lit("lex_entries").alias("source"))
    return S.strict(rows, {"field": F.col("lex_field").isin("producer", "cuvee", "grape"), "canonical": F.col("canonical") != ""})


def io21_same_hash(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    a, b = S.table_hash(rows), S.table_hash(rows.orderBy(F.col("p_partkey").desc()))
    return a.join(b.select(F.col("n").alias("m"), F.col("digest").alias("other"))).select("n", (F.col("digest") == F.col("other")).alias("same"))


def io22_query_sets(spark, d):
    """The sets of queries by name: pairs as they are and distorted, read from a JSON file, and the frames as the public set."""
    path = _path(spark, "pairs")
    ranked = table(spark, d, "wine_cards").select(F.col("listing_id").cast("string").alias("wine_id"), F.col("slug").alias("portal_slug"), F.col("listing_id").alias("place"))
    ranked.write.json(path)
    pairs = S.read_jsonl(spark, path, "wine_id string, portal_slug string, place long")
    made = lambda name, number: S.query_set(pairs, name, "wine_id", "portal_slug", "pairs", ".webp", number, needs_slug=True)
    sets = {"pairs": made("pairs", None), "pairs_phone": made("pairs_phone", "place"), "public": S.query_set(table(spark, d, "frames"), "public", "query_id", "slug", "images", ".jpg")}
    result = None
    for name in sets:
        part = S.load_queries(name, sets).select(F.col("meta")["set"].alias("name"), "query_id", "image_path", "slug", F.col("meta")["seed"].alias("seed"))
        result = part if result is None else result.unionByName(part)
    return result


def pf18_context(spark, d):
    """Contexts made of the documents, checked: the text as intent, the language as wanted move, the slug shown some times."""
    shown = F.array_repeat(F.coalesce("slug", F.lit("none")), F.pmod(F.coalesce("n_chars", F.lit(0)), F.lit(16)).cast("int"))
    made = F.when(F.pmod(F.col("doc_id"), F.lit(7)) == 0, F.lit("{broken")).when(F.pmod(F.col("doc_id"), F.lit(7)) == 1, F.to_json(F.struct(F.col("doc_id").alias("dish")))).otherwise(F.to_json(F.struct(F.col("text").alias("intent"), F.col("lang").alias("want"), shown.alias("shown"))))
    rows = table(spark, d, "documents").select("doc_id", S.checked_context(made, {"want": ["ru", "en"]}).alias("c"))
    return rows.select("doc_id", "c.problem", F.col("c.context.want").alias("want"), F.size("c.context.shown").alias("n_shown"))


def ma23_flattened(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("f")).select("event_id", F.col("f.k").alias("f_k"))


def ma24_days(spark, d):
    return table(spark, d, "events").groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def ma22_boxes(spark, d):
    inside = F.greatest(F.least("box.x1", F.lit(0.8)) - F.greatest("box.x0", F.lit(0.2)), F.lit(0.0)) * F.greatest(F.least("box.y1", F.lit(0.6)) - F.greatest("box.y0", F.lit(0.1)), F.lit(0.0))
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    return table(spark, d, "text_lines").where("box is not null").select("line_id", F.round(inside / F.nullif(area, F.lit(0.0)), 6).alias("share"))


def so14_target_box(spark, d):
    """Of each photo the line box of largest area times closeness to the centre squared."""
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    score = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")) * (1 - F.sqrt((x - 0.5) ** 2 + (y - 0.5) ** 2)) ** 2
    rows = table(spark, d, "text_lines").where("box is not null").withColumn("score", F.round(score, 9))
    return rows.groupBy("query_id").agg(F.max_by("line_id", F.struct("score", -F.col("line_id"))).alias("line_id"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("io", "pf", "ma", "so") and n[2:4].isdigit()}
SQL = {
    "io22_query_sets": """select 'pairs' as name, listing_id::varchar as query_id, 'pairs/' || listing_id || '.webp' as image_path, trim(slug, ' ') as slug, null::varchar as seed from wine_cards union all select 'pairs_phone', listing_id::varchar, 'pairs/' || listing_id || '.webp', trim(slug, ' '), listing_id::varchar from wine_cards
      union all select 'public', trim(query_id, ' '), 'images/' || trim(query_id, ' ') || '.jpg', nullif(trim(slug, ' '), ''), null from frames""",
    "pf18_context": """with c as (select doc_id, text, lang, coalesce(n_chars, 0) % 16 as n, case doc_id % 7 when 0 then 'no JSON' when 1 then 'dish: no string' else case when length(text) > 200 then 'intent: too long' when coalesce(n_chars, 0) % 16 > 12 or (coalesce(n_chars, 0) % 16 > 0 and length(slug) > 200) then 'shown: too long' end end as problem from documents)
      select doc_id, problem, case when problem is null and lang in ('ru', 'en') then lang end as want, case when problem is null then least(n, 1)::int end as n_shown from c""",
    "io01_jsonl": "select event_id, event_type, value from events",
    "io02_tsv": "select p_partkey::varchar as p_partkey, p_name, case when p_partkey % 5 = 0 then '' else p_brand end as p_brand from part",
    "io03_first_wins": "select l_orderkey, l_partkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1",
    "io04_photo_map": "select slug, case when min(nazvanie_foto) like '%7.webp' then 'fixed-' || min(nazvanie_foto) else min(nazvanie_foto) end as photo from strapi_output0709 group by 1",
    "io05_manifest": "select query_id, 'images/' || query_id || '.jpg' as path from frames",
    "io06_ground_truth": "select query_id, slug from frames",
    "io08_annotations": "select event_id, (props::json->>'k')::int as k from events",
    "io10_index": "select label::varchar as slug, vec_id % 3 as view, count(*) as n from embeddings group by 1, 2",
    "io11_dictionary": "select entry_id, lex_field, canonical, len(slugs)::int as n_slugs from lex_entries",
    "io12_model": "select round(sum(2.0 * (l_tax - 0.04) / 0.02), 2) as total from lineitem",
    "io14_append_log": "select event_type, count(*) as n, max(event_id) as last from events group by 1",
    "io15_sealed": "select 'dev' as split, count(*) as n from frames where coalesce(lower(trim(set_name, ' ')) not in ('test', 'holdout'), true)",
    "io16_merge_patch": """select event_id, '{"z": 1}' as state from events""",
    "io17_sitemap": "select distinct slug from catalog_positions",
    "io19_layered_rules": "select 'r' || p_partkey as id, case when p_size > 40 then 1.0 else p_size end::double as weight, case when p_name like 'red%' then 'patched' when p_size > 40 then 'over' else p_name end as text from part where p_partkey not in (1, 2) or p_size > 40 union all select 'n1', 5.0, 'new'",
    "io20_strict": "select entry_id, lex_field, canonical, 'lex_entries' as source from lex_entries",
    "io21_same_hash": "select count(*) as n, true as same from part",
    "ma23_flattened": "select event_id, (props::json->>'k')::int as f_k from events",
    "ma24_days": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n from events group by 1",
    "ma22_boxes": "select line_id, round(greatest(least(box.x1, 0.8) - greatest(box.x0, 0.2), 0) * greatest(least(box.y1, 0.6) - greatest(box.y0, 0.1), 0) / nullif((box.x1 - box.x0) * (box.y1 - box.y0), 0), 6) as share from text_lines where box is not null",
    "so14_target_box": "with s as (select query_id, line_id, round((box.x1 - box.x0) * (box.y1 - box.y0) * (1 - sqrt(((box.x0 + box.x1) / 2 - 0.5) ** 2 + ((box.y0 + box.y1) / 2 - 0.5) ** 2)) ** 2, 9) as score from text_lines where box is not null) select query_id, line_id from s qualify row_number() over (partition by query_id order by score desc, line_id) = 1",
    "io07_problems": """with l as (select query_id, margin > 0.3 as broken, predicted_slug is null as keyless from predictions), k as (select count(*) as n, count(distinct query_id) as d from l where not coalesce(broken, false) and not keyless)
      select * from (select 'not JSON' as problem, count(*) as n from l where broken union all select 'no key', count(*) from l where not coalesce(broken, false) and keyless union all select 'repeated', n - d from k union all select 'good', d from k) where n > 0""",
    "io09_built_index": """with m as (select slug, view_name, p, avg(vec[p]) as x from index_vectors, range(1, 65) r(p) where vec is not null and slug is not null group by all) select slug, view_name, count(*) as dim, round(sum(x), 5) as total from m group by 1, 2""",
    "io13_cache": """with l as (select line_id, sha256(concat_ws('|', reader, text)) as key, conf < 0.6 as failed from text_lines), c as (select distinct key from l where line_id % 2 = 0 and not coalesce(failed, false)) select case when c.key is null then 'miss' else 'hit' end as state, count(*) as n from l left join c using (key) group by 1""",
}
