"""Queries of entity groups, joins by key, set operations, splits and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellarflow.operators import entities as E
from cellarflow.operators import phrases as P
from cellarflow.operators.text import form_pairs, words_of
from cellarflow.plans.words import _NORMAL, _WORDS, document_words
from cellarflow.sources.tables import table


def st07_components(spark, d):
    """Positions tied by cluster or visual group, through others too: the smallest node of each tie as its lead."""
    rows = table(spark, d, "catalog_positions")
    hubs = F.array_compact(F.array(F.concat(F.lit("~c"), F.col("cluster_b").cast("string")), F.when(F.size("visual_group") > 0, F.concat(F.lit("~v"), F.array_join("visual_group", "-")))))
    found = E.components(rows.select(F.col("slug").alias("a"), F.explode(hubs).alias("b")))
    return found.where("not startswith(node, '~')")


def st08_keys(spark, d):
    rows = table(spark, d, "catalog_positions")
    return rows.select("slug", E.first_known(("group", F.when(F.size("visual_group") > 0, F.array_join("visual_group", "-"))), ("cluster", F.col("cluster_b")), ("slug", F.col("slug"))).alias("key"))


def st06_elected(spark, d):
    rows = table(spark, d, "catalog_positions").withColumn("g", F.coalesce(F.col("cluster_b").cast("string"), "slug"))
    return E.elect(rows, "g", "slug", [F.col("name").isNotNull(), F.col("vintage").isNotNull()])


def ma13_split(spark, d):
    return table(spark, d, "documents").select("doc_id", E.hash_split(F.coalesce("slug", F.col("doc_id").cast("string"))).alias("split"))


def ma14_folds(spark, d):
    rows = table(spark, d, "frames").withColumn("g", F.nullif(F.lower(F.trim("slug")), F.lit("")))
    return E.group_folds(rows, "g", 5)


def ma15_half_split(spark, d):
    folds = E.group_folds(table(spark, d, "frames").withColumn("g", F.nullif(F.lower(F.trim("slug")), F.lit(""))), "g", 2)
    return folds.groupBy("fold").agg(F.sum("n").alias("n"))


def jn01_attributes(spark, d):
    parts = table(spark, d, "part").where("p_size <= 25").select("p_partkey", "p_brand")
    return table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy(F.coalesce("p_brand", F.lit("unknown")).alias("brand")).agg(F.count("*").alias("n"))


def jn02_cards(spark, d):
    orders, customers, nations = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    cards = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return cards.select("o_orderkey", "c_name", "n_name")


def jn04_series(spark, d):
    """Each order's lines spread to every line of the parts' brand in the order's top part: the best price of the series."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    series = lines.groupBy("l_orderkey", "p_brand").agg(F.max("l_extendedprice").alias("best"), F.count("*").alias("members"))
    return lines.select("l_orderkey", "l_linenumber", "p_brand").distinct().join(series, ["l_orderkey", "p_brand"]).select("l_orderkey", "l_linenumber", "best", "members")


def jn12_unlisted(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def jn15_alignment(spark, d):
    frames = table(spark, d, "frames").select("query_id", "frame_id", F.lower(F.trim("set_name")).alias("set_name"))
    lines = table(spark, d, "text_lines").groupBy("query_id").agg(F.countDistinct("reading_key").alias("readings"))
    images = table(spark, d, "predictions").groupBy("query_id").agg(F.countDistinct("image_path").alias("images"))
    return frames.join(lines, "query_id").join(images, "query_id", "left").select("frame_id", "set_name", "readings", F.coalesce(F.col("images") <= 1, F.lit(True)).alias("one_image"))


def jn16_broken_links(spark, d):
    lines = table(spark, d, "token_spans").select("line_id").distinct()
    return lines.join(table(spark, d, "text_lines").select("line_id"), "line_id", "left_anti").agg(F.count("*").alias("n"))


def jn17_duplicates(spark, d):
    rows = table(spark, d, "catalog_positions").where("cluster_b is not null").select("slug", "cluster_b")
    base = rows.where("slug < 'n'").select("cluster_b").distinct()
    return rows.where("slug >= 'n'").join(base, "cluster_b", "left_semi").select("slug")


def jn18_cross_split_twins(spark, d):
    stem = F.regexp_replace(F.regexp_replace("slug", "[-_ ]+", "-"), "-[0-9]+$", "")
    rows = table(spark, d, "frames").where("slug is not null").select("frame_id", F.lower(F.trim(stem)).alias("stem"), "group_key", F.lower(F.trim("set_name")).alias("s"))
    side = F.when(F.col("s").isin("train", "training", "trn"), "train").when(F.col("s").isin("test", "holdout"), "test")
    sided = rows.withColumn("side", side)
    counts = sided.where("side is not null").groupBy("stem").agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test"), F.countDistinct("group_key").alias("groups"))
    return counts.where("n_train > 0 and n_test > 0 and groups > 1")


def jn19_twins(spark, d):
    rows = table(spark, d, "catalog_positions").where("cluster_b is not null").select("slug", "cluster_b", "name", "category", "sugar_class", F.col("vintage").cast("string").alias("vintage"))
    return E.twin_pairs(rows, "cluster_b", "slug", ["name", "vintage", "sugar_class", "category"])


def jn20_fixed(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("value"))
    fixes = rows.where("p_partkey % 100 = 0").select("p_partkey", F.col("value").alias("old"), F.lit("FIXED").alias("new"))
    return E.apply_fixes(rows, fixes, ["p_partkey"])


def jn21_lineage(spark, d):
    steps = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("string").alias("target"), F.col("r_regionkey").cast("string").alias("source"), F.when(F.col("r_regionkey") == 1, "live").alias("flag"))
    return E.lineage(steps, "5", "0", ["live"])


def jn22_topics(spark, d):
    triggers = spark.createDataFrame([("serving", "пода", True, False, False), ("serving", "бокал", False, False, False), ("law", "суды", True, True, True), ("law", "марк", False, True, True), ("travel", "турист", True, False, True), ("travel", "hotel", True, False, True)], "topic string, stem string, is_trigger boolean, needs_context boolean, narrow boolean")
    words = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    return E.topic_of(words, triggers, "doc_id", "w")


NEGATIONS = ["без", "не", "without", "not", "no"]


def jn23_dishes(spark, d):
    """Which name of the lexicon a document's text has: whole phrases, the longer before the shorter; negated ones out."""
    phrases = table(spark, d, "lex_entries").where("not is_part").select("entry_id", words_of(F.lower("norm")).alias("words"))
    words = document_words(spark, d)
    hits = P.without_negated(P.rule_hits(words, "doc_id", "pos", "w", P.phrase_table(phrases, "entry_id", "words")), words, "doc_id", "pos", "w", NEGATIONS)
    length = phrases.select(F.col("entry_id").alias("rule"), F.length(F.array_join("words", " ")).alias("n"))
    return hits.join(length, "rule").groupBy("doc_id").agg(F.max_by("rule", F.struct("n", -F.col("rule"))).alias("entry_id"))


def st02_union_first(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")).withColumn("pool", F.lit(1))
    b = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")).withColumn("pool", F.lit(2))
    both = a.unionByName(b).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("pool")))
    return both.where("n = 1").select("o_custkey", "pool", "price")


def st04_covered(spark, d):
    """The words of each line that are forms of a word of the lexicon."""
    asked = table(spark, d, "text_lines").where("text is not null").select("line_id", F.explode(F.array_distinct(words_of(F.lower("text")))).alias("x"))
    known = table(spark, d, "lex_entries").select(F.explode(words_of(F.lower("norm"))).alias("y")).distinct()
    covered = form_pairs(asked.select("x").distinct(), known).select("x").distinct()
    return asked.join(covered, "x").groupBy("line_id").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("covered"))


def st05_symmetric(spark, d):
    a, b = table(spark, d, "frames").select("query_id"), table(spark, d, "predictions").select("query_id")
    only = lambda x, y, side: x.subtract(y).select("query_id", F.lit(side).alias("side"))
    return only(a, b, "frames").unionByName(only(b, a, "predictions"))


def st09_merged(spark, d):
    base, live = table(spark, d, "catalog_positions").select("slug", F.lit("base").alias("origin")), table(spark, d, "wine_cards").select("slug", F.lit("live").alias("origin"))
    return base.unionByName(live.join(base, "slug", "left_anti")).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("slug").alias("slugs"))


def st10_merged_readers(spark, d):
    rows = table(spark, d, "text_lines").select("query_id", F.concat_ws("|", "reader", F.lpad("line_no", 3, "0"), "line_id").alias("o"), F.when(F.col("text").isNotNull(), F.array("text")).alias("texts"), "angle")
    merged = E.merged_readers(rows, "query_id", "o", ["texts"], ["angle"])
    return merged.select("query_id", F.size("texts").alias("n_texts"), "angle")


def st11_vocabulary(spark, d):
    words = table(spark, d, "catalog_positions").where("winery is not null").select(F.explode(F.split(F.lower("winery"), " ")).alias("w")).distinct()
    taken = table(spark, d, "lex_entries").where("lex_field = 'cuvee'").select(F.explode(F.split("norm", " ")).alias("w"))
    return words.where("length(w) >= 4 and not w rlike '[0-9]' and not w rlike '(ый|ий|ой)$'").join(taken, "w", "left_anti")


def st12_families(spark, d):
    return E.prefix_families(table(spark, d, "catalog_positions").where("name is not null"), "name")


def ag38_portraits(spark, d):
    rows = table(spark, d, "catalog_positions").select("slug", "category", F.explode("grapes").alias("grape"))
    counts = rows.groupBy("grape", "category").agg(F.count("*").alias("n"))
    top = counts.where("category is not null").withColumn("k", F.row_number().over(Window.partitionBy("grape").orderBy(F.col("n").desc(), "category"))).where("k <= 3")
    named = top.groupBy("grape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "category"))), lambda x: x["category"]), ",").alias("top"))
    return rows.groupBy("grape").agg(F.count("*").alias("n")).join(named, "grape", "left")


def ag39_quality(spark, d):
    frames, lines, cards = table(spark, d, "frames"), table(spark, d, "text_lines"), table(spark, d, "wine_cards")
    checks = [
        ("frame without slug", frames.where("slug is null").select(F.col("frame_id").cast("string").alias("key"))),
        ("probability out of range", frames.where("p_top1 < 0 or p_top1 > 1").select(F.col("frame_id").cast("string").alias("key"))),
        ("line without photo", lines.join(frames, "query_id", "left_anti").select(F.col("line_id").cast("string").alias("key"))),
        ("blank line", lines.where("trim(text) = ''").select(F.col("line_id").cast("string").alias("key"))),
        ("card without winery", cards.where("winery is null").select(F.col("slug").alias("key"))),
    ]
    result = None
    for name, rows in checks:
        part = rows.select(F.lit(name).alias("violation"), "key")
        result = part if result is None else result.unionByName(part)
    return result.groupBy("violation").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def ag40_brands(spark, d):
    rows = table(spark, d, "catalog_positions").where("winery is not null and name is not null").select("slug", "winery", F.split(F.lower("name"), " ").alias("w"))
    return E.brands(rows, "winery", "slug", "w")


def ag41_flags(spark, d):
    rows = table(spark, d, "catalog_positions").select(F.explode("noise_flags").alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("st", "so", "ma", "jn", "ag") and n[2:4].isdigit()}
_DEALT = lambda folds: f"""with recursive g as (select g, n, row_number() over (order by n desc, sha256(g), g) as i from (select nullif(lower(trim(slug, ' ')), '') as g, count(*) as n from frames group by 1) where g is not null),
  r(i, g, n, fold, loads) as (select 0::bigint, null::varchar, 0::bigint, 0::bigint, list_transform(range({folds}), lambda x: 0::bigint) union all select g.i, g.g, g.n, list_position(r.loads, list_min(r.loads)) - 1, list_transform(range(1, {folds + 1}), lambda k: r.loads[k] + case when k = list_position(r.loads, list_min(r.loads)) then g.n else 0 end) from r join g on g.i = r.i + 1)"""  # noqa: E731
SQL = {
    "ma14_folds": f"{_DEALT(5)} select g, n, fold::int as fold from r where i > 0",
    "ma15_half_split": f"{_DEALT(2)} select fold::int as fold, sum(n)::bigint as n from r where i > 0 group by 1",
    "jn22_topics": """with w as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as w from documents where text is not null), k(topic, stem, is_trigger, needs_context, narrow) as (values ('serving', 'пода', true, false, false), ('serving', 'бокал', false, false, false), ('law', 'суды', true, true, true),
      ('law', 'марк', false, true, true), ('travel', 'турист', true, false, true), ('travel', 'hotel', true, false, true)), h as (select distinct doc_id, k.* from w join k on starts_with(w.w, k.stem)),
      s as (select doc_id, topic, sum(case when is_trigger then 2 else 1 end)::bigint as score, bool_or(narrow) as narrow from h group by 1, 2 having bool_or(is_trigger) and (bool_or(not is_trigger) or not bool_or(needs_context)))
      select doc_id, topic, score from s qualify row_number() over (partition by doc_id order by score desc, narrow desc, topic) = 1""",
    "jn23_dishes": f"""with d as (select doc_id, {_NORMAL} as t from documents where text is not null), e as (select entry_id, array_to_string({_WORDS.format('lower(norm)')}, ' ') as p from lex_entries where not is_part and norm is not null),
      h as (select doc_id, entry_id, p, t from d join e on length(p) > 0 and contains(t, ' ' || p || ' ')), k as (select * from h where contains(regexp_replace(t, ' (?:без|не|without|not|no) ' || p || ' ', ' | ', 'g'), ' ' || p || ' '))
      select doc_id, entry_id from k qualify row_number() over (partition by doc_id order by length(p) desc, entry_id) = 1""",
    "st04_covered": f"""with l as (select distinct line_id, unnest({_WORDS.format('lower(text)')}) as x from text_lines where text is not null), k as (select distinct unnest({_WORDS.format('lower(norm)')}) as y from lex_entries where norm is not null), x as (select distinct x from l),
      c as (select distinct x from x join k on x = y or (least(length(x), length(y)) >= 4 and abs(length(x) - length(y)) <= 3 and left(x, least(5, greatest(least(length(x), length(y)) - 1, 3))) = left(y, least(5, greatest(least(length(x), length(y)) - 1, 3)))))
      select line_id, string_agg(x, ' ' order by x) as covered from l join c using (x) group by 1""",
    "st07_components": """with recursive e as (select slug as a, '~c' || cluster_b as b from catalog_positions where cluster_b is not null union all select slug, '~v' || array_to_string(visual_group, '-') from catalog_positions where len(visual_group) > 0),
      s as (select a, b from e union select b, a from e), reach(a, b) as (select a, a from s union select reach.a, s.b from reach join s on s.a = reach.b) select a as node, min(b) as component from reach where not starts_with(a, '~') group by 1""",
    "st08_keys": "select slug, coalesce('group:' || case when len(visual_group) > 0 then array_to_string(visual_group, '-') end, 'cluster:' || cluster_b, 'slug:' || slug) as key from catalog_positions",
    "st06_elected": "select coalesce(cluster_b::varchar, slug) as g, arg_min(slug, struct_pack(a := name is null, b := vintage is null, c := slug)) as slug, count(*) as n from catalog_positions group by 1",
    "ma13_split": "select doc_id, case when ('0x' || substr(sha256(coalesce(slug, doc_id::varchar)), 1, 16))::ubigint::double / 18446744073709551616.0::double < 0.4 then 'dev' else 'test' end as split from documents",
    "jn01_attributes": "select coalesce(p_brand, 'unknown') as brand, count(*) as n from lineitem left join (select * from part where p_size <= 25) on l_partkey = p_partkey group by 1",
    "jn02_cards": "select o_orderkey, c_name, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey",
    "jn04_series": "with l as (select l_orderkey, l_linenumber, p_brand, l_extendedprice from lineitem join part on l_partkey = p_partkey), s as (select l_orderkey, p_brand, max(l_extendedprice) as best, count(*) as members from l group by 1, 2) select l_orderkey, l_linenumber, best, members from (select distinct l_orderkey, l_linenumber, p_brand from l) join s using (l_orderkey, p_brand)",
    "jn12_unlisted": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "jn15_alignment": "select frame_id, lower(trim(set_name, ' ')) as set_name, readings, coalesce(images <= 1, true) as one_image from frames join (select query_id, count(distinct reading_key) as readings from text_lines group by 1) using (query_id) left join (select query_id, count(distinct image_path) as images from predictions group by 1) using (query_id)",
    "jn16_broken_links": "select count(*) as n from (select distinct line_id from token_spans where line_id not in (select line_id from text_lines))",
    "jn17_duplicates": "select slug from catalog_positions where slug >= 'n' and cluster_b in (select cluster_b from catalog_positions where slug < 'n' and cluster_b is not null)",
    "jn18_cross_split_twins": """with r as (select lower(trim(regexp_replace(regexp_replace(slug, '[-_ ]+', '-', 'g'), '-[0-9]+$', ''), ' ')) as stem, group_key, lower(trim(set_name, ' ')) as s from frames where slug is not null)
      select stem, count(*) filter (s in ('train', 'training', 'trn')) as n_train, count(*) filter (s in ('test', 'holdout')) as n_test, count(distinct group_key) filter (s in ('train', 'training', 'trn', 'test', 'holdout')) as groups from r group by 1 having n_train > 0 and n_test > 0 and groups > 1""",
    "jn19_twins": "select a.slug as slug_a, b.slug as slug_b, case when a.name <> b.name then 'name' when a.vintage <> b.vintage then 'vintage' when a.sugar_class <> b.sugar_class then 'sugar_class' when a.category <> b.category then 'category' end as differs from catalog_positions a join catalog_positions b on a.cluster_b = b.cluster_b and a.slug < b.slug",
    "jn20_fixed": "select p_partkey, case when p_partkey % 100 = 0 then 'FIXED' else p_type end as value from part",
    "jn21_lineage": "select (6 - t)::int as depth, (t - 1)::varchar as source, t::varchar as target from range(1, 6) r(t)",
    "st02_union_first": "with b as (select o_custkey, 1 as pool, max(o_totalprice) as price from orders where o_orderstatus = 'P' group by 1 union all select o_custkey, 2, max(o_totalprice) from orders where o_orderpriority = '1-URGENT' group by 1) select o_custkey, pool, price from b qualify row_number() over (partition by o_custkey order by pool) = 1",
    "st05_symmetric": "select query_id, 'frames' as side from (select query_id from frames except select query_id from predictions) union all select query_id, 'predictions' from (select query_id from predictions except select query_id from frames)",
    "st09_merged": "select 'base' as origin, count(*) as n, count(distinct slug) as slugs from catalog_positions union all select 'live', count(*), count(distinct slug) from wine_cards where slug not in (select slug from catalog_positions)",
    "st10_merged_readers": "select query_id, count(text)::int as n_texts, arg_min(angle, concat_ws('|', reader, lpad(line_no::varchar, 3, '0'), line_id)) filter (angle is not null) as angle from text_lines group by 1",
    "st11_vocabulary": "select distinct w from (select unnest(string_split(lower(winery), ' ')) as w from catalog_positions where winery is not null) where length(w) >= 4 and not regexp_matches(w, '[0-9]') and not regexp_matches(w, '(ый|ий|ой)$') and w not in (select unnest(string_split(norm, ' ')) from lex_entries where lex_field = 'cuvee')",
    "st12_families": "with n as (select distinct name from catalog_positions where name is not null) select a.name, coalesce((select arg_min(b.name, length(b.name)) from n b where starts_with(a.name, b.name || ' ')), a.name) as family from n a",
    "ag38_portraits": """with r as (select slug, category, unnest(grapes) as grape from catalog_positions), t as (select grape, category, count(*) as n from r where category is not null group by 1, 2 qualify row_number() over (partition by grape order by n desc, category) <= 3)
      select grape, n, (select string_agg(category, ',' order by t.n desc, category) from t where t.grape = g.grape) as top from (select grape, count(*) as n from r group by 1) g""",
    "ag39_quality": """with v as (select 'frame without slug' as violation, frame_id::varchar as key from frames where slug is null union all select 'probability out of range', frame_id::varchar from frames where p_top1 < 0 or p_top1 > 1 union all select 'line without photo', line_id::varchar from text_lines where query_id not in (select query_id from frames) or query_id is null
      union all select 'blank line', line_id::varchar from text_lines where trim(text, ' ') = '' union all select 'card without winery', slug from wine_cards where winery is null) select violation, count(*) as n, min(key) as first from v group by 1""",
    "ag40_brands": """with r as (select slug, winery, string_split(lower(name), ' ') as w from catalog_positions where winery is not null and name is not null), s as (select winery, count(*) as size from r group by 1 having size >= 4),
      g as (select winery, slug, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) as gram from r), c as (select winery, gram, count(distinct slug) as n, any_value(size) as size from g join s using (winery) group by 1, 2 having n >= 0.25 * any_value(size))
      select winery, gram, n from c where not exists (select 1 from c p where p.winery = c.winery and contains(p.gram, ' ') and list_contains(string_split(p.gram, ' '), c.gram))""",
    "ag41_flags": "select flag, count(*) as n from (select unnest(noise_flags) as flag from catalog_positions) group by 1",
}
