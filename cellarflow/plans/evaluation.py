"""Queries that judge runs: frames are the truth, predictions the answers (the last one sent of each query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellarflow.operators import metrics as M
from cellarflow.sources.tables import table


def slug_of(column: str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(column)), "[ _]+", "-"), F.lit(""))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frames").select("frame_id", "query_id", slug_of("slug").alias("slug"), "acceptable", "source", F.lower(F.trim("set_name")).alias("set_name"), "p_top1", "failure")


def answers(spark: SparkSession, d: str) -> DataFrame:
    last = Window.partitionBy("query_id").orderBy(F.col("logged_at").desc_nulls_last(), F.col("latency_ms").asc_nulls_last(), F.col("margin").asc_nulls_last(), F.col("predicted_slug").asc_nulls_last(), F.col("image_path").asc_nulls_last())
    rows = table(spark, d, "predictions").withColumn("n", F.row_number().over(last)).where("n = 1")
    return rows.select("query_id", slug_of("predicted_slug").alias("predicted"), "latency_ms", "candidates", "margin", "model")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("query_id", F.inline("candidates")).select("query_id", slug_of("slug").alias("slug"), "score", "view_name", F.col("rank_no").alias("rank"))


def accepted(spark: SparkSession, d: str) -> DataFrame:
    """A row for each answer that counts: the slug and what is acceptable instead."""
    rows = truth(spark, d).where("slug is not null")
    return rows.select("query_id", F.explode(F.array_union(F.array("slug"), F.coalesce(F.transform("acceptable", lambda x: F.regexp_replace(F.lower(F.trim(x)), "[ _]+", "-")), F.array()))).alias("slug")).distinct()


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return M.truth_ranks(candidates(spark, d), accepted(spark, d)).join(truth(spark, d).drop("slug"), "query_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """query_id, source, set_name, p_top1, margin, model, latency_ms, ok: the answer is the slug itself."""
    return truth(spark, d).join(answers(spark, d), "query_id").withColumn("ok", F.coalesce(F.col("slug") == F.col("predicted"), F.lit(False)))


def ag01_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def ag02_share(spark, d):
    return _judged(spark, d).groupBy("source").agg(F.round(M.share(F.count_if(F.col("ok") & F.col("failure").isNull()), F.count_if(F.col("failure").isNull())), 6).alias("share"))


def ag03_rate(spark, d):
    return _judged(spark, d).groupBy("model").agg(F.round(M.rate(F.count_if("ok"), F.count_if(F.col("margin") > 0.2)), 3).alias("rate"))


def ag04_percentiles(spark, d):
    return M.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95})


def ag05_percentiles_ceil(spark, d):
    return M.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95}, ceil_rule=True)


def ag06_latency(spark, d):
    return M.nearest_rank(answers(spark, d), ["model"], "latency_ms", {"p50": 0.5, "p95": 0.95})


def ag07_margins(spark, d):
    return M.nearest_rank(_judged(spark, d), ["ok"], "margin", {"p10": 0.1, "median": 0.5})


LEVELS = [["category", "sugar_class"], ["category"], []]


def _strengths(spark, d):
    rows = table(spark, d, "catalog_positions")
    return rows.select("slug", "category", "sugar_class", F.try_element_at("abv", F.lit(1)).alias("strength"), F.col("vintage").cast("double").alias("year"))


def ag08_level_medians(spark, d):
    return M.level_medians(_strengths(spark, d), LEVELS, ["strength", "year"])


def ag09_fallback(spark, d):
    rows = _strengths(spark, d)
    return M.with_fallback(rows.select("slug", "category", "sugar_class"), M.level_medians(rows, LEVELS, ["strength", "year"]), LEVELS, ["strength", "year"], least=60)


def ag10_most_frequent(spark, d):
    return M.most_frequent(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey").select("o_custkey", "o_orderpriority", "n")


def ag18_cer(spark, d):
    from cellarflow.operators.lexicon import best_cer

    lines = table(spark, d, "text_lines").where("text is not null").join(truth(spark, d).select("query_id", "slug"), "query_id")
    words = lines.where("slug is not null").select("line_id", F.lower(F.element_at(F.split("slug", "-"), 1)).alias("token"), F.lower("text").alias("text"))
    return best_cer(words, "token", "text").select("line_id", F.round("cer", 6).alias("cer"))


def ag19_cer_table(spark, d):
    from cellarflow.operators.lexicon import best_cer

    lines = table(spark, d, "text_lines").where("text is not null").join(truth(spark, d).select("query_id", "slug"), "query_id")
    words = lines.where("slug is not null").select("reader", F.lower(F.element_at(F.split("slug", "-"), 1)).alias("token"), F.lower("text").alias("text"))
    scored = best_cer(words, "token", "text").where("cer is not null")
    return scored.groupBy("reader").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean_cer"), F.round(M.share(F.count_if(F.col("cer") <= 0.2), F.count("*")), 6).alias("hits"))


def ag20_field_accuracy(spark, d):
    rows = truth(spark, d).where("slug is not null").join(answers(spark, d), "query_id", "left")
    part = lambda c: F.element_at(F.split(c, "-"), -2)
    rows = rows.select(part("slug").alias("want"), part("predicted").alias("got"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("want") == F.col("got")).alias("correct"), F.count_if(F.col("want") != F.col("got")).alias("wrong"), F.count_if(F.col("got").isNull()).alias("abstain"))


def ag21_topk(spark, d):
    shares = M.top_share(_ranked(spark, d), ["source"], "rank", [1, 5])
    return shares.select("source", "n", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


def ag22_tie_fair(spark, d):
    rows = candidates(spark, d).withColumn("score", F.round(F.col("score").cast("double"), 1)).join(truth(spark, d).select("query_id", F.col("slug").alias("want")), "query_id")
    scored = rows.select("query_id", "score", F.coalesce(F.col("slug") == F.col("want"), F.lit(False)).alias("is_truth"))
    return M.tie_fair_top1(scored).select("query_id", F.round("credit", 6).alias("credit"))


def ag23_rank_table(spark, d):
    shares = M.top_share(_ranked(spark, d), ["set_name"], "rank", [1, 3, 5, 10])
    return shares.select("set_name", "n", *[F.round(f"top{k}", 6).alias(f"top{k}") for k in (1, 3, 5, 10)])


def ag24_pool_sizes(spark, d):
    rows = table(spark, d, "catalog_positions").where("cluster_b is not null")
    sizes = rows.join(rows.groupBy("cluster_b").agg(F.count("*").alias("size")), "cluster_b")
    return sizes.agg(F.median("size").alias("median"), F.max("size").alias("largest"), F.round(F.avg("size"), 6).alias("mean"))


def ag25_twins(spark, d):
    group = table(spark, d, "catalog_positions").select(F.col("slug").alias("s"), "cluster_b", "winery")
    rows = _judged(spark, d).join(group.select(F.col("s").alias("slug"), F.col("cluster_b").alias("want_group"), F.col("winery").alias("want_winery")), "slug", "left")
    rows = rows.join(group.select(F.col("s").alias("predicted"), F.col("cluster_b").alias("got_group"), F.col("winery").alias("got_winery")), "predicted", "left")
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("right"), F.count_if(~F.col("ok") & (F.col("want_group") == F.col("got_group"))).alias("twin"),
        F.count_if(~F.col("ok") & (F.col("want_winery") == F.col("got_winery"))).alias("same_winery"), F.count_if(F.col("slug").isNotNull() & F.col("want_winery").isNull()).alias("out_of_catalogue"), F.count_if(F.col("predicted").isNull()).alias("silent"),
    )


def _two_runs(spark, d):
    rows = _judged(spark, d)
    second = candidates(spark, d).where("rank = 2").select("query_id", F.col("slug").alias("other"))
    both = rows.join(second, "query_id").select("query_id", "ok", F.coalesce((F.col("other") == F.col("slug")) & (F.col("margin") < 0.05) | F.col("ok") & (F.col("margin") >= 0.02), F.lit(False)).alias("after"))
    return both.select("query_id", "ok"), both.select("query_id", F.col("after").alias("ok"))


def ag26_fix_break(spark, d):
    return M.fix_break(*_two_runs(spark, d))


def ag27_calibration(spark, d):
    rows = M.calibration(_judged(spark, d), "p_top1", "ok", 10, ["query_id"])
    return rows.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("p_mean", "accuracy", "gap")])


def ag27_calibration_error(spark, d):
    return M.calibration_error(_judged(spark, d), "p_top1", "ok", 10, ["query_id"]).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


def ag28_outside_scores(spark, d):
    known = table(spark, d, "catalog_positions").select("slug", F.lit(True).alias("known"))
    best = candidates(spark, d).where("rank = 1").select("query_id", F.col("score").cast("double").alias("score"))
    rows = truth(spark, d).join(known, "slug", "left").join(best, "query_id").select(F.coalesce("known", F.lit(False)).alias("in_catalogue"), "score")
    return M.nearest_rank(rows, ["in_catalogue"], "score", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def ag29_delta(spark, d):
    before, after = _two_runs(spark, d)
    points = lambda df: df.agg((100 * F.avg(F.col("ok").cast("double"))).alias("x"))
    both = points(before).withColumnRenamed("x", "before").crossJoin(points(after).withColumnRenamed("x", "after"))
    return both.select(F.round("before", 4).alias("before_pp"), F.round("after", 4).alias("after_pp"), F.round(F.col("after") - F.col("before"), 4).alias("delta_pp"))


def ag30_bootstrap(spark, d):
    return M.grouped_bootstrap(_judged(spark, d).withColumn("g", F.coalesce("slug", "query_id")), "g", "ok")


def ag31_sign_test(spark, d):
    counts = M.fix_break(*_two_runs(spark, d))
    pairs = counts.select("fixes", "breaks").unionByName(spark.createDataFrame([(18, 3), (0, 0), (5, 5), (40, 22)], "fixes long, breaks long"))
    return pairs.select("fixes", "breaks", F.round(M.sign_test(F.col("fixes"), F.col("breaks")), 8).alias("p"))


def ag33_judge(spark, d):
    rows = M.judge(truth(spark, d).select(F.col("query_id").alias("id"), "slug"), answers(spark, d).select(F.col("query_id").alias("id"), F.col("predicted").alias("slug")))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def ag34_coverage(spark, d):
    rows = table(spark, d, "catalog_positions")
    filled = lambda c: F.count_if(F.size(c) > 0)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("winery").alias("wineries"), filled("grapes").alias("grapes"), F.count("sugar_class").alias("sugar"), F.count("vintage").alias("vintage"), filled("abv").alias("abv"), F.count("cluster_b").alias("clustered"))


def ag36_f1(spark, d):
    known = table(spark, d, "catalog_positions").select("slug", F.lit(True).alias("known"))
    base = truth(spark, d).join(known, "slug", "left").select("query_id", F.coalesce("known", F.lit(False)).alias("in_catalogue"))
    rows = base.join(answers(spark, d).select("query_id", "predicted"), "query_id", "left").join(M.truth_ranks(candidates(spark, d), accepted(spark, d)), "query_id", "left")
    scores = M.f1_at(rows.select("in_catalogue", F.col("predicted").isNotNull().alias("answered"), F.when(F.col("in_catalogue"), F.col("rank")).alias("rank")), [1, 5])
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


def ag37_macro_micro(spark, d):
    rows = _judged(spark, d).groupBy("source").agg(F.avg(F.col("ok").cast("double")).alias("a"), F.count("*").alias("n"), F.count_if("ok").alias("r"))
    return rows.agg(F.round(F.avg("a"), 6).alias("macro"), F.round(F.sum("r") / F.sum("n"), 6).alias("micro"))


def ag42_all_metrics(spark, d):
    rows = _ranked(spark, d).join(answers(spark, d).select("query_id", "margin", "latency_ms"), "query_id", "left")
    grouped = rows.groupBy("set_name", "source").agg(F.count("*").alias("n"), F.round(M.share(F.count_if(F.col("rank") == 1), F.count("*")), 6).alias("top1"), F.round(F.avg("margin"), 6).alias("margin"), F.max("latency_ms").alias("slowest"), F.count_if(F.col("failure").isNotNull()).alias("failures"))
    return grouped


def ag43_set_stats(spark, d):
    rows = _judged(spark, d).groupBy("set_name").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))
    kept = rows.withColumn("share", F.round(F.col("right") / F.col("n"), 4))
    return kept.withColumn("agrees", F.abs(F.col("share") * F.col("n") - F.col("right")) < 0.5)


def ag46_truth_rank(spark, d):
    known = table(spark, d, "catalog_positions").select("slug", F.lit(True).alias("known"))
    rows = truth(spark, d).where("slug is not null").join(known, "slug", "left").join(M.truth_ranks(candidates(spark, d), accepted(spark, d)), "query_id", "left")
    return rows.groupBy(M.rank_label("rank", F.coalesce("known", F.lit(False))).alias("rank")).agg(F.count("*").alias("n"))


def ma17_thresholds(spark, d):
    rows = _judged(spark, d).where("margin is not null").select(F.pmod(F.length("query_id") + F.expr("cast(substr(query_id, 3) as bigint)"), F.lit(4)).alias("fold"), "margin", "ok")
    return M.threshold_out_of_fold(rows, "fold", "margin", "ok").select("fold", "threshold", F.round("accuracy", 6).alias("accuracy"))


def jn14_outer(spark, d):
    both = truth(spark, d).select("query_id", F.col("slug").alias("want")).join(answers(spark, d).select("query_id", F.col("predicted").alias("got")), "query_id", "full_outer")
    return both.select("query_id", "want", "got", F.when(F.col("want").isNull() & F.col("got").isNull(), "empty").when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("got"), "right").otherwise("wrong").alias("state"))


_SLUG = "nullif(regexp_replace(lower(trim({0}, ' ')), '[ _]+', '-', 'g'), '')"
TRUTH = f"truth as (select frame_id, query_id, {_SLUG.format('slug')} as slug, acceptable, source, lower(trim(set_name, ' ')) as set_name, p_top1, failure from frames)"
ANSWERS = f"""answers as (select query_id, {_SLUG.format('predicted_slug')} as predicted, latency_ms, candidates, margin, model from predictions
  qualify row_number() over (partition by query_id order by logged_at desc nulls last, latency_ms nulls last, margin nulls last, predicted_slug nulls last, image_path nulls last) = 1)"""
CANDIDATES = f"cands as (select query_id, {_SLUG.format('c.slug')} as slug, c.score as score, c.rank_no as rank from (select query_id, unnest(candidates) as c from answers))"
ACCEPTED = """accepted as (select distinct query_id, slug from (select query_id, slug from truth where slug is not null union all
  select query_id, regexp_replace(lower(trim(unnest(acceptable), ' ')), '[ _]+', '-', 'g') from truth where slug is not null))"""
RANKS = "ranks as (select a.query_id, min(c.rank) as rank from accepted a left join cands c using (query_id, slug) group by 1)"
JUDGED = "judged as (select t.*, a.* exclude (query_id), coalesce(t.slug = a.predicted, false) as ok from truth t join answers a using (query_id))"
_WITH = f"with {TRUTH}, {ANSWERS}, {CANDIDATES}, {ACCEPTED}, {RANKS}, {JUDGED}"
_TWO = """, runs as (select j.query_id, j.ok, coalesce((c.slug = j.slug and j.margin < 0.05) or (j.ok and j.margin >= 0.02), false) as after from judged j join cands c on c.query_id = j.query_id and c.rank = 2)"""


def _nearest(source: str, by: str, value: str, quantiles: dict[str, float], ceil_rule: bool = False) -> str:
    at = lambda q: f"greatest(ceil({q} * n), 1)" if ceil_rule else f"round_even({q} * (n - 1), 0) + 1"
    picks = ", ".join(f"max(case when pos = {at(q)} then {value} end) as {name}" for name, q in quantiles.items())
    return f"select {by}, any_value(n) as n, {picks} from (select {by}, {value}, count(*) over (partition by {by}) as n, row_number() over (partition by {by} order by {value}) as pos from {source} where {value} is not null) group by {by}"


_STRENGTHS = "strengths as (select slug, category, sugar_class, abv[1] as strength, vintage::double as year from catalog_positions)"
_LEVELS = """levels as (select 0 as level, category, sugar_class, count(*) as n, round(median(strength), 2) as strength, round(median(year), 2) as year from strengths where category is not null and sugar_class is not null group by category, sugar_class
  union all select 1, category, null, count(*), round(median(strength), 2), round(median(year), 2) from strengths where category is not null group by category
  union all select 2, null, null, count(*), round(median(strength), 2), round(median(year), 2) from strengths)"""
QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[:4] in {"ag01"} | {f"ag{n:02d}" for n in range(50)} | {"ma17", "jn14"}}
_CER = f"""{TRUTH}, w as (select line_id, reader, lower(string_split(slug, '-')[1]) as token, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '') as ws from text_lines join truth using (query_id) where text is not null and slug is not null),
r as (select line_id, reader, token, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as runs from w),
cers as (select line_id, reader, list_min(list_transform(runs, lambda x: levenshtein(token, regexp_replace(x, '[^\\x00-\\x7f]', chr(1), 'g')))) / length(token)::double as cer from r)"""
SQL = {
    "ag18_cer": f"with {_CER} select line_id, round(cer, 6) as cer from cers",
    "ag19_cer_table": f"with {_CER} select reader, count(*) as n, round(avg(cer), 6) as mean_cer, round(count(*) filter (cer <= 0.2) / count(*)::double, 6) as hits from cers where cer is not null group by 1",
    "ag01_counts": "select event_type, count(*) as n from events group by 1",
    "ag02_share": f"{_WITH} select source, round(count(*) filter (ok and failure is null) / nullif(count(*) filter (failure is null), 0)::double, 6) as share from judged group by 1",
    "ag03_rate": f"{_WITH} select model, round(count(*) filter (ok) / greatest(count(*) filter (margin > 0.2), 1)::double, 3) as rate from judged group by 1",
    "ag04_percentiles": _nearest("lineitem", "l_returnflag", "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95}),
    "ag05_percentiles_ceil": _nearest("lineitem", "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95}, True),
    "ag06_latency": f"with {ANSWERS} " + _nearest("answers", "model", "latency_ms", {"p50": 0.5, "p95": 0.95}),
    "ag07_margins": f"{_WITH} " + _nearest("judged", "ok", "margin", {"p10": 0.1, "median": 0.5}),
    "ag08_level_medians": f"with {_STRENGTHS}, {_LEVELS} select * from levels",
    "ag09_fallback": f"""with {_STRENGTHS}, {_LEVELS} select s.slug, s.category, s.sugar_class, coalesce(a.level, b.level, c.level) as level,
      case when a.level is not null then a.strength when b.level is not null then b.strength else c.strength end as strength, case when a.level is not null then a.year when b.level is not null then b.year else c.year end as year
      from strengths s left join levels a on a.level = 0 and a.n >= 60 and a.category = s.category and a.sugar_class = s.sugar_class left join levels b on b.level = 1 and b.n >= 60 and b.category = s.category left join levels c on c.level = 2 and c.n >= 60""",
    "ag10_most_frequent": "select o_custkey, o_orderpriority, n from (select o_custkey, o_orderpriority, count(*) as n, min(o_orderkey) as f from orders group by 1, 2) qualify row_number() over (partition by o_custkey order by n desc, f) = 1",
    "ag20_field_accuracy": f"{_WITH} select count(*) as n, count(*) filter (want = got) as correct, count(*) filter (want <> got) as wrong, count(*) filter (got is null) as abstain from (select split_part(slug, '-', -2) as want, split_part(predicted, '-', -2) as got from truth left join answers using (query_id) where slug is not null)",
    "ag21_topk": f"{_WITH} select source, count(*) as n, round(count(*) filter (rank <= 1) / count(*)::double, 6) as top1, round(count(*) filter (rank <= 5) / count(*)::double, 6) as top5 from ranks join truth using (query_id) group by 1",
    "ag22_tie_fair": f"""{_WITH}, s as (select c.query_id, round(c.score::double, 1) as score, coalesce(c.slug = t.slug, false) as is_truth from cands c join truth t using (query_id)), b as (select * from s qualify score >= max(score) over (partition by query_id) - 1e-9)
      select query_id, round(max(is_truth::int) / count(*)::double, 6) as credit from b group by 1""",
    "ag23_rank_table": f"{_WITH} select set_name, count(*) as n, " + ", ".join(f"round(count(*) filter (rank <= {k}) / count(*)::double, 6) as top{k}" for k in (1, 3, 5, 10)) + " from ranks join truth using (query_id) group by 1",
    "ag24_pool_sizes": "select median(size) as median, max(size) as largest, round(avg(size), 6) as mean from (select count(*) over (partition by cluster_b) as size from catalog_positions where cluster_b is not null)",
    "ag25_twins": f"""{_WITH} select model, count(*) as n, count(*) filter (ok) as "right", count(*) filter (not ok and w.cluster_b = g.cluster_b) as twin, count(*) filter (not ok and w.winery = g.winery) as same_winery,
      count(*) filter (j.slug is not null and w.winery is null) as out_of_catalogue, count(*) filter (predicted is null) as silent from judged j left join catalog_positions w on w.slug = j.slug left join catalog_positions g on g.slug = j.predicted group by 1""",
    "ag26_fix_break": f"{_WITH}{_TWO} select count(*) as n, count(*) filter (not ok and after) as fixes, count(*) filter (ok and not after) as breaks, count(*) filter (ok and after) as both_right from runs",
    "ag27_calibration": f"{_WITH} select bin, count(*) as n, round(avg(p_top1), 6) as p_mean, round(avg(ok::int), 6) as accuracy, round(abs(avg(p_top1) - avg(ok::int)), 6) as gap from (select *, ntile(10) over (order by p_top1, query_id)::int as bin from judged where p_top1 is not null) group by bin",
    "ag27_calibration_error": f"{_WITH}, b as (select *, ntile(10) over (order by p_top1, query_id) as bin from judged where p_top1 is not null) select (select round(sum(n * gap) / sum(n), 6) from (select count(*) as n, abs(avg(p_top1) - avg(ok::int)) as gap from b group by bin)) as ece, (select round(avg((p_top1 - ok::int) ** 2), 6) from b) as brier",
    "ag28_outside_scores": f"{_WITH}, s as (select k.slug is not null as in_catalogue, c.score::double as score from truth t left join catalog_positions k on k.slug = t.slug join cands c on c.query_id = t.query_id and c.rank = 1) " + _nearest("s", "in_catalogue", "score", {"p10": 0.1, "p50": 0.5, "p90": 0.9}),
    "ag29_delta": f"{_WITH}{_TWO} select round(100 * avg(ok::int), 4) as before_pp, round(100 * avg(after::int), 4) as after_pp, round(100 * avg(after::int) - 100 * avg(ok::int), 4) as delta_pp from runs",
    "ag31_sign_test": f"""{_WITH}{_TWO}, f as (select count(*) filter (not ok and after) as fixes, count(*) filter (ok and not after) as breaks from runs union all select * from (values (18, 3), (0, 0), (5, 5), (40, 22)) v(a, b))
      select fixes, breaks, round(case when fixes + breaks = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(fixes, breaks) + 1), lambda i: exp(lgamma(fixes + breaks + 1) - lgamma(i + 1) - lgamma(fixes + breaks - i + 1) - (fixes + breaks) * ln(2))))) end, 8) as p from f""",
    "ag33_judge": f"""{_WITH} select count(*) filter (t) as n_truth, count(*) filter (t and a is null) as n_missing, count(*) filter (t is null) as n_extra, count(*) filter (t and got is not null) as n_answered, count(*) filter (t and a and want is not distinct from got) as n_right,
      round(count(*) filter (t and a and want is not distinct from got) / nullif(count(*) filter (t), 0)::double, 6) as accuracy from (select query_id, slug as want, true as t from truth) full join (select query_id, predicted as got, true as a from answers) using (query_id)""",
    "ag34_coverage": "select count(*) as n, count(distinct winery) as wineries, count(*) filter (len(grapes) > 0) as grapes, count(sugar_class) as sugar, count(vintage) as vintage, count(*) filter (len(abv) > 0) as abv, count(cluster_b) as clustered from catalog_positions",
    "ag36_f1": f"""{_WITH}, r as (select k.slug is not null as in_catalogue, a.predicted is not null as answered, case when k.slug is not null then ranks.rank end as rank from truth t left join catalog_positions k on k.slug = t.slug left join answers a on a.query_id = t.query_id left join ranks on ranks.query_id = t.query_id),
      s as (select count(*) filter (rank <= 1) / count(*) filter (answered)::double as p1, count(*) filter (rank <= 1) / count(*) filter (in_catalogue)::double as r1, count(*) filter (rank <= 5) / count(*) filter (answered)::double as p5, count(*) filter (rank <= 5) / count(*) filter (in_catalogue)::double as r5 from r)
      select round(p1, 6) as p1, round(r1, 6) as r1, round(2 * p1 * r1 / (p1 + r1), 6) as f1, round(p5, 6) as p5, round(r5, 6) as r5, round(2 * p5 * r5 / (p5 + r5), 6) as f5 from s""",
    "ag37_macro_micro": f"{_WITH} select round(avg(a), 6) as macro, round(sum(r) / sum(n)::double, 6) as micro from (select avg(ok::int) as a, count(*) as n, count(*) filter (ok) as r from judged group by source)",
    "ag42_all_metrics": f"{_WITH} select set_name, source, count(*) as n, round(count(*) filter (rank = 1) / count(*)::double, 6) as top1, round(avg(margin), 6) as margin, max(latency_ms) as slowest, count(*) filter (failure is not null) as failures from ranks join truth using (query_id) left join answers using (query_id) group by 1, 2",
    "ag43_set_stats": f"""{_WITH} select set_name, n, r as "right", round(r / n::double, 4) as share, abs(round(r / n::double, 4) * n - r) < 0.5 as agrees from (select set_name, count(*) as n, count(*) filter (ok) as r from judged group by 1)""",
    "ag46_truth_rank": f"{_WITH} select case when k.slug is null then 'out' when rank <= 5 then rank::varchar else '>5' end as rank, count(*) as n from truth t left join catalog_positions k on k.slug = t.slug left join ranks using (query_id) where t.slug is not null group by 1",
    "jn14_outer": f"""{_WITH} select query_id, want, got, case when want is null and got is null then 'empty' when got is null then 'missing' when want is null then 'extra' when want = got then 'right' else 'wrong' end as state
      from (select query_id, slug as want from truth) full join (select query_id, predicted as got from answers) using (query_id)""",
    "ma17_thresholds": f"""{_WITH}, r as (select (length(query_id) + substr(query_id, 3)::bigint) % 4 as fold, margin, ok from judged where margin is not null), o as (select h.fold as held, r.* from r, (select distinct fold from r) h where r.fold <> h.fold),
      c as (select held, margin, count(*) filter (ok) over (partition by held order by margin desc range unbounded preceding) + count(*) filter (not ok) over (partition by held) - count(*) filter (not ok) over (partition by held order by margin desc range unbounded preceding) as good from o),
      b as (select held, arg_max(margin, struct_pack(g := good, m := -margin)) as threshold from c group by 1) select fold, any_value(threshold) as threshold, round(avg(((margin >= threshold) = ok)::int), 6) as accuracy from r join b on r.fold = b.held group by fold""",
}
