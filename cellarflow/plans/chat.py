"""Queries of the guests' questions (documents stand for them, their source for the conversation) and what is left."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellarflow.functions import registry as G
from cellarflow.operators import chat as H
from cellarflow.operators import text as X
from cellarflow.operators.order import numbered, tiles
from cellarflow.plans.facets import _PROFILE as _FACETS_PROFILE
from cellarflow.plans.facets import _STEP as _FACETS_STEP
from cellarflow.plans.facets import _WITH as _FACETS
from cellarflow.plans.facets import _near, _profile, _rows
from cellarflow.plans.words import _WORDS, _bounded
from cellarflow.plans.retrieval import _ALIGNED, _SIMS, _index, _queries, _slugs
from cellarflow.operators import facets as C
from cellarflow.operators import vectors as V
from cellarflow.sources.tables import table


def _turns(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "published_at", "text")


def tx30_routes(spark, d):
    rows = H.routed(_turns(spark, d).where("source is not null"), "source", ["published_at", "doc_id"], "text")
    return rows.groupBy("route").agg(F.count("*").alias("n"))


def tx31_smalltalk(spark, d):
    rows = table(spark, d, "text_lines").select("line_id", H.smalltalk("text").alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def tx32_label_fields(spark, d):
    """Sugar, colour and a serial number of each reading: what most of its lines say, of equally frequent values the first by name."""
    lines = table(spark, d, "text_lines").where("text is not null")
    serial = F.nullif(F.regexp_extract(F.lower("text"), r"(?:no\.?|№) ?(\d+)", 1), F.lit(""))
    said = {"sugar": X.first_class("text", X.SUGAR_PHRASES), "colour": X.first_class("text", X.COLOUR_PHRASES), "serial": serial}
    rows = lines.select("reading_key", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in said.items()])).alias("x")).select("reading_key", "x.*")
    votes = rows.groupBy("reading_key", "field", "value").agg(F.count("*").alias("n"))
    chosen = lambda name: F.min_by(F.when(F.col("field") == name, F.col("value")), F.when((F.col("field") == name) & F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias(name)
    return votes.groupBy("reading_key").agg(*[chosen(n) for n in said])


def tx38_near_words(spark, d):
    words = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.words_of(F.lower("text"))).alias("pos", "w"))
    return H.near_words(words, ["doc_id"], "pos", "w", ["употребление", "drink"], ["здоровью", "responsibly", "вредит"], 3)


def tx18_forms(spark, d):
    words = table(spark, d, "lex_entries").where("norm rlike '(ый|ий)$' and lex_field <> 'cuvee'").select(F.element_at(F.split("norm", " "), -1).alias("w")).where("w rlike '(ый|ий)$'").distinct()
    return words.select("w", F.array_join(H.adjective_forms(F.expr("substring(w, 1, length(w) - 2)"), F.col("w").endswith("ий")), ",").alias("forms"))


def pf02_facts(spark, d):
    """Facts of a raw card: sugar from the name, else from the slug, and the cluster of its catalogue position."""
    rows = table(spark, d, "catalog_positions")
    by_slug = F.try_element_at(F.regexp_extract_all("slug", F.lit("(ekstra-bryut|bryut|polusukhoe|polusladkoe|sukhoe|sladkoe)"), F.lit(1)), F.lit(-1))
    return rows.select("slug", F.coalesce(X.first_class("name", X.SUGAR_PHRASES), by_slug).alias("sugar"), "cluster_b", F.coalesce(F.array_contains("noise_flags", "wrong_photo"), F.lit(False)).alias("wrong_photo"))


def pf19_voice(spark, d):
    rows = H.routed(_turns(spark, d).where("source is not null"), "source", ["published_at", "doc_id"], "text")
    return rows.groupBy((F.col("route").isin("dish", "grape", "serve", "fact") & (F.length("text") < 1000)).alias("voice")).agg(F.count("*").alias("n"))


def pf21_rule_sugar(spark, d):
    rows = table(spark, d, "wine_cards")
    return rows.select("listing_id", F.coalesce("sugar_class", F.when(F.lower("name").rlike("десерт|портвейн|dolce|sweet"), F.lit("sladkoe"))).alias("sugar"))


def ma07_moves(spark, d):
    body = _profile(spark, d).select("slug", "body")
    pairs = _near(spark, d).join(body, "slug").join(body.select(F.col("slug").alias("a_slug"), F.col("body").alias("a_body")), "a_slug")
    facts = ((F.col("strength"), F.col("a_strength")), (F.col("body"), F.col("a_body")), (C.sugar_step("sugar_class"), C.sugar_step("a_sugar_class")))
    return pairs.groupBy("a_slug").agg(*[F.count_if(H.reason_move(w, *facts)).alias(w) for w in ("lighter", "fuller", "drier", "sweeter")])


WANTS = ("lighter", "fuller", "drier", "sweeter")


def _moved(spark, d):
    """Of every position and move: the others that go that way from it."""
    body = _profile(spark, d).select("slug", "body")
    pairs = _near(spark, d).join(body, "slug").join(body.select(F.col("slug").alias("a_slug"), F.col("body").alias("a_body")), "a_slug")
    facts = ((F.col("strength"), F.col("a_strength")), (F.col("body"), F.col("a_body")), (C.sugar_step("sugar_class"), C.sugar_step("a_sugar_class")))
    wants = F.filter(F.array(*[F.when(H.reason_move(w, *facts), F.lit(w)) for w in WANTS]), lambda x: x.isNotNull())
    return pairs.withColumn("want", F.explode(wants))


def so18_directions(spark, d):
    """The answer to each wish about each position: the three nearest that go that way."""
    order = Window.partitionBy("a_slug", "want").orderBy(F.col("alike").desc(), "sugar_gap", "strength_gap", "slug")
    return _moved(spark, d).withColumn("place", F.row_number().over(order)).where("place <= 3").select("a_slug", "want", "slug", "place")


def so18_outcomes(spark, d):
    """How each wish is answered: by so many positions, by none that goes that way, or not at all as the position's facts are unknown."""
    own = _profile(spark, d).select(F.col("slug").alias("a_slug"), "body", "sweet").join(_rows(spark, d).select(F.col("slug").alias("a_slug"), "strength"), "a_slug")
    asked = own.select("a_slug", F.explode(F.array(*[F.struct(F.lit(w).alias("want"), (F.coalesce("strength", "body") if w in ("lighter", "fuller") else F.col("sweet")).isNotNull().alias("known")) for w in WANTS])).alias("x")).select("a_slug", "x.*")
    n = _moved(spark, d).groupBy("a_slug", "want").agg(F.count("*").alias("n"))
    rows = asked.join(n, ["a_slug", "want"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("a_slug", "want", F.when(F.col("n") > 0, "found").when(~F.col("known"), "unknown").otherwise("empty").alias("outcome"), "n")


def so18_facts(spark, d):
    """What a card says in words: strength, sugar and how long to keep, the last by style and body."""
    rows = _rows(spark, d).join(_profile(spark, d).select("slug", "body", "source"), "slug")
    strength = F.coalesce(F.concat(F.lit("strength "), F.format_number("strength", 1), F.lit(" %")), F.lit("strength not given"))
    sugar = F.coalesce(F.concat(F.lit("class "), "sugar_class"), F.lit("sugar not given"))
    keep = F.when(F.lower("category").contains("игрист"), "sparkling").when((F.col("category") == "Красное") & (F.col("body") >= 3.5), "red_full").when(F.col("category") == "Красное", "red").when(F.col("category").isNotNull(), "light").otherwise("unknown")
    return rows.select("slug", F.inline(F.array(*[F.struct(F.lit(n).alias("fact"), c.alias("answer")) for n, c in (("alcohol", strength), ("sugar", sugar), ("storage", keep))])))


def ma16_grid(spark, d):
    """Accuracy of a one-feature rule over a grid of thresholds: a small selection loop."""
    rows = table(spark, d, "frames").join(table(spark, d, "predictions").select("query_id", "margin", "latency_ms"), "query_id").where("p_top1 is not null and margin is not null")
    grid = spark.createDataFrame([(t / 10,) for t in range(1, 10)], "threshold double")
    judged = rows.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.round(F.avg(((F.col("p_top1") >= F.col("threshold")) == (F.col("margin") >= 0.05)).cast("int")), 6).alias("accuracy"))
    return judged.withColumn("place", F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "threshold")))


def wn13_bins(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return numbered(rows, ["p_retailprice", "p_partkey"]).select("p_partkey", tiles(F.col("number"), F.lit(rows.count()), 7).alias("bin"))


def vr09_best_view(spark, d):
    return _slugs(spark, d, "max").select("query", "slug", "view")


def ux01_lines(spark, d):
    rows = G.read_lines(table(spark, d, "documents").select("doc_id", "text"), "text", "lines")
    return rows.select("doc_id", F.size("lines").alias("n_lines"))


def ux02_vectors(spark, d):
    rows = G.embed(_rows(spark, d).where("name is not null").select("slug", "name"), "name", "letters")
    return rows.select("slug", F.round(V.dot("vec", "vec"), 6).alias("length"))


def ux05_aggregations(spark, d):
    """The three ways to aggregate, side by side: the first entity of each query."""
    result = None
    for how in V.AGGREGATIONS:
        part = V.search(_index(spark, d), _queries(spark, d), 1, how, skip_self=True).select(F.lit(how).alias("how"), "query", "slug")
        result = part if result is None else result.unionByName(part)
    return result


def _first_of(how: str, score: str, source: str, total: str) -> str:
    return f"select '{how}' as how, query, slug from (select query, slug, {total}(best) as score from (select query, row_id, slug, max({score}) as best from {source} group by all) group by all) join firsts using (slug) qualify row_number() over (partition by query order by round(score, 12) desc, first) = 1"


def _rules(rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in rules) + " end"


def _case(rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when regexp_matches(lower(text), '{_bounded(p)}') then '{n}'" for n, p in rules) + " end"


_MOVES = f"""x as (select n.*, a_strength - n.strength as ds, a.body - r.body as db, {_FACETS_STEP.format('a_sugar_class')} - {_FACETS_STEP.format('n.sugar_class')} as dg from near n join prof r on r.slug = n.slug join prof a on a.slug = n.a_slug),
  v as (select *, case want when 'lighter' then coalesce(case when ds <> 0 then ds >= 0.5 end, db >= 0.5, false) when 'fuller' then coalesce(case when ds <> 0 then -ds >= 0.5 end, -db >= 0.5, false) when 'drier' then coalesce(dg >= 1, false) else coalesce(-dg >= 1, false) end as ok
  from x, (values ('lighter'), ('fuller'), ('drier'), ('sweeter')) w(want))"""
_ROUTED = f"""t as (select doc_id, source, published_at, text, {_rules(H.REFUSALS)} as refusal, {_rules(H.INTENTS)} as intent, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') as plain from documents where source is not null),
  r as (select doc_id, text, coalesce(first_value(case when refusal in ('pregnancy', 'age') then refusal end ignore nulls) over (partition by source order by published_at nulls first, doc_id rows between unbounded preceding and 1 preceding),
  case when plain in ('привет', 'здравствуйте', 'hello', 'hi') then 'hello' when plain in ('спасибо', 'thanks', 'thank you') then 'thanks' when plain in ('пока', 'до свидания', 'bye') then 'bye' end, refusal, intent, 'unknown') as route from t)"""

QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("tx", "pf", "ma", "wn", "vr", "ux", "so") and n[2:4].isdigit()}
SQL = {
    "pf21_rule_sugar": "select listing_id, coalesce(sugar_class, case when regexp_matches(lower(name), 'десерт|портвейн|dolce|sweet') then 'sladkoe' end) as sugar from wine_cards",
    "wn13_bins": "select p_partkey, ntile(7) over (order by p_retailprice, p_partkey)::int as bin from part",
    "tx18_forms": "select w, array_to_string(list_transform(case when w like '%ий' then ['ий', 'яя', 'ее', 'ие', 'его'] else ['ый', 'ая', 'ое', 'ые', 'ого'] end, lambda e: left(w, length(w) - 2) || e), ',') as forms from (select distinct split_part(norm, ' ', -1) as w from lex_entries where lex_field <> 'cuvee' and regexp_matches(norm, '(ый|ий)$'))",
    "ux02_vectors": "select slug, 1.0::double as length from catalog_positions where length(name) > 1",
    "ma16_grid": "with r as (select t.threshold / 10.0::double as threshold, round(avg(((p_top1 >= t.threshold / 10.0::double) = (margin >= 0.05))::int), 6) as accuracy from frames join predictions using (query_id), range(1, 10) t(threshold) where p_top1 is not null and margin is not null group by 1) select *, row_number() over (order by accuracy desc, threshold)::int as place from r",
    "vr09_best_view": """with s as (select q.vec_id // 100 as query, i.vec_id as row_id, i.label as slug, i.vec_id % 3 as view, list_inner_product(i.embedding::double[], q.embedding::double[]) as sim from embeddings i, embeddings q where i.vec_id <> q.vec_id and q.vec_id % 20 = 0)
      select query, slug, arg_max(view, struct_pack(b := best, r := -row_id)) as view from (select query, row_id, slug, view, max(sim) as best from s group by all) group by query, slug""",
    "ux05_aggregations": f"""with {_SIMS}, {_ALIGNED.format(base='is_base')}, firsts as (select label as slug, min(vec_id) as first from embeddings group by 1)
      {_first_of('max', 'sim', 'sims', 'max')} union all {_first_of('mean', 'sim', 'sims', 'avg')} union all {_first_of('zmax', 'aligned', 'aligned', 'max')}""",
    "so18_directions": f"{_FACETS}, {_FACETS_PROFILE}, {_MOVES} select a_slug, want, slug, row_number() over (partition by a_slug, want order by alike desc, sugar_gap, strength_gap, slug)::int as place from v where ok qualify place <= 3",
    "so18_outcomes": f"""{_FACETS}, {_FACETS_PROFILE}, {_MOVES}, k as (select a_slug, want, count(*) as n from v where ok group by 1, 2), q as (select p.slug as a_slug, w.want, case when w.want in ('lighter', 'fuller') then coalesce(r.strength, p.body) else p.sweet end is not null as known from prof p join rows r on r.slug = p.slug, (values ('lighter'), ('fuller'), ('drier'), ('sweeter')) w(want))
      select a_slug, want, case when n > 0 then 'found' when not known then 'unknown' else 'empty' end as outcome, coalesce(n, 0) as n from q left join k using (a_slug, want)""",
    "so18_facts": f"""with {_FACETS_PROFILE} select slug, 'alcohol' as fact, coalesce('strength ' || printf('%.1f', abv[1]) || ' %', 'strength not given') as answer from catalog_positions union all select slug, 'sugar', coalesce('class ' || sugar_class, 'sugar not given') from catalog_positions union all
      select c.slug, 'storage', case when contains(lower(c.category), 'игрист') then 'sparkling' when c.category = 'Красное' and body >= 3.5 then 'red_full' when c.category = 'Красное' then 'red' when c.category is not null then 'light' else 'unknown' end from catalog_positions c join prof p on p.slug = c.slug""",
    "tx32_label_fields": f"""with f as (select reading_key, {_case(X.SUGAR_PHRASES)} as sugar, {_case(X.COLOUR_PHRASES)} as colour, nullif(regexp_extract(lower(text), '(?:no\\.?|№) ?([0-9]+)', 1), '') as serial from text_lines where text is not null)
      select reading_key, (select sugar from f g where g.reading_key = k.reading_key and sugar is not null group by sugar order by count(*) desc, sugar limit 1) as sugar, (select colour from f g where g.reading_key = k.reading_key and colour is not null group by colour order by count(*) desc, colour limit 1) as colour,
        (select serial from f g where g.reading_key = k.reading_key and serial is not null group by serial order by count(*) desc, serial limit 1) as serial from (select distinct reading_key from f) k""",
    "tx30_routes": f"with {_ROUTED} select route, count(*) as n from r group by 1",
    "pf19_voice": f"with {_ROUTED} select route in ('dish', 'grape', 'serve', 'fact') and length(text) < 1000 as voice, count(*) as n from r group by 1",
    "tx38_near_words": f"""with w as (select doc_id, p as pos, ws[p] as w from (select doc_id, {_WORDS.format('lower(text)')} as ws from documents where text is not null), range(1, 100000) r(p) where p <= len(ws))
      select distinct a.doc_id from w a join w b on a.doc_id = b.doc_id and abs(a.pos - b.pos) <= 3 where a.w in ('употребление', 'drink') and b.w in ('здоровью', 'responsibly', 'вредит')""",
    "ux01_lines": "select doc_id, len(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda s: regexp_matches(s, '[^\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}]')))::int as n_lines from documents where text is not null union all select doc_id, null from documents where text is null",
    "tx31_smalltalk": """with t as (select trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') as t from text_lines) select case when t in ('привет', 'здравствуйте', 'hello', 'hi') then 'hello' when t in ('спасибо', 'thanks', 'thank you') then 'thanks' when t in ('пока', 'до свидания', 'bye') then 'bye' end as kind, count(*) as n from t group by 1""",
    "pf02_facts": """select slug, coalesce(case when regexp_matches(lower(name), 'экстра[ -]брют|extra[ -]brut') then 'extra_brut' when regexp_matches(lower(name), 'полусух|semi-?dry|off-dry') then 'polusuhoe' when regexp_matches(lower(name), 'полуслад|semi-?sweet') then 'polusladkoe' when regexp_matches(lower(name), 'брют|(^|[^a-z])brut($|[^a-z])') then 'brut'
      when regexp_matches(lower(name), 'сух(ое|ой|ая)|(^|[^a-z])dry($|[^a-z])') then 'suhoe' when regexp_matches(lower(name), 'сладк(ое|ий|ая)|(^|[^a-z])sweet($|[^a-z])') then 'sladkoe' end, regexp_extract_all(slug, '(ekstra-bryut|bryut|polusukhoe|polusladkoe|sukhoe|sladkoe)', 1)[-1]) as sugar, cluster_b, coalesce(list_contains(noise_flags, 'wrong_photo'), false) as wrong_photo from catalog_positions""",
    "ma07_moves": f"""{_FACETS}, {_FACETS_PROFILE}, x as (select n.*, r.body, a.body as a_body from near n join prof r on r.slug = n.slug join prof a on a.slug = n.a_slug), m as (select a_slug, a_strength - strength as ds, a_body - body as db, {_FACETS_STEP.format('a_sugar_class')} - {_FACETS_STEP.format('sugar_class')} as dg from x)
      select a_slug, count(*) filter (coalesce(case when ds <> 0 then ds >= 0.5 end, db >= 0.5, false)) as lighter, count(*) filter (coalesce(case when ds <> 0 then -ds >= 0.5 end, -db >= 0.5, false)) as fuller, count(*) filter (coalesce(dg >= 1, false)) as drier, count(*) filter (coalesce(-dg >= 1, false)) as sweeter from m group by 1""",
}
