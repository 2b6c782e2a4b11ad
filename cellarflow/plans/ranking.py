"""Queries of ranking: an order's lines are the candidates of a query, the largest price its truth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellarflow.operators import ranking as R
from cellarflow.sources.tables import table

# A fixed model of three features, so that SQL can repeat it.
MODEL = [{"name": "l_quantity", "coef": 0.8, "mean": 25.0, "scale": 14.0}, {"name": "l_discount", "coef": -0.5, "mean": 0.05, "scale": 0.03}, {"name": "l_tax", "coef": 0.3, "mean": 0.04, "scale": 0.025}]
GROUPS = {"l_quantity": "size", "l_discount": "money", "l_tax": "money"}


def _lines(spark, d):
    rows = table(spark, d, "lineitem").withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    return rows


def _round(df, *columns):
    return df.select(*[F.round(c[1:], 6).alias(c[1:]) if c[0] == "~" else F.col(c) for c in columns])


def wn01_block_features(spark, d):
    made = R.block_features(_lines(spark, d), "l_orderkey", "l_extendedprice", "line", "l_tax")
    return _round(made, "l_orderkey", "line", "rank", "~inv_rank", "~gap", "~z", "~minmax", "is_top1", "~margin_top1")


def wn02_group_mates(spark, d):
    made = R.group_mates(R.block_features(_lines(spark, d), "l_orderkey", "l_extendedprice", "line"), "l_orderkey", "rank", "l_returnflag")
    return _round(made, "l_orderkey", "line", "top_mate", "~log_size")


def wn03_relative_count(spark, d):
    return _round(R.relative_count(_lines(spark, d), "l_orderkey", "l_quantity"), "l_orderkey", "line", "~relative")


def wn04_softmax(spark, d):
    return _round(R.softmax(_lines(spark, d), "l_orderkey", "l_quantity", 5.0), "l_orderkey", "line", "~p")


def wn05_argmax(spark, d):
    return R.argmax(_lines(spark, d), "l_orderkey", "l_quantity", "line").select("l_orderkey", "line", "l_quantity")


def wn06_top_probability(spark, d):
    rows = R.softmax(_lines(spark, d), "l_orderkey", "l_quantity", 5.0).groupBy("l_orderkey").agg(F.max("p").alias("p"))
    return _round(rows, "l_orderkey", "~p")


def ma08_hand_score(spark, d):
    rules = [(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", 0.3, -0.45), (F.col("l_discount") <= 0.02, F.col("l_discount") >= 0.08, 0.12, -0.2), (F.col("l_linestatus") == "O", F.lit(None).cast("boolean"), 0.06, -0.08)]
    rows = _lines(spark, d).withColumn("score", R.hand_score(rules, F.col("l_quantity") / 50))
    return _round(rows, "l_orderkey", "line", "~score")


def ma09_linear_score(spark, d):
    return _round(_lines(spark, d).withColumn("score", R.linear_score(MODEL)), "l_orderkey", "line", "~score")


def ma10_fitted(spark, d):
    rows = R.block_features(_lines(spark, d), "l_orderkey", "l_quantity", "line")
    rows = rows.withColumn("y", F.col("l_extendedprice") == F.max("l_extendedprice").over(Window.partitionBy("l_orderkey")))
    fitted = R.fit_listwise(rows, "l_orderkey", ["minmax", "inv_rank", "l_discount"], "y", {"minmax": 1, "inv_rank": 1}, rounds=8)
    return spark.createDataFrame([(w["name"], w["coef"], w["mean"], w["scale"]) for w in fitted], "name string, coef double, mean double, scale double")


def ma11_temperature(spark, d):
    rows = _lines(spark, d).withColumn("y", F.col("l_extendedprice") == F.max("l_extendedprice").over(Window.partitionBy("l_orderkey")))
    return spark.createDataFrame([(R.fit_temperature(rows, "l_orderkey", "l_quantity", "y"),)], "temperature double")


def ma12_features(spark, d):
    made = R.group_mates(R.block_features(_lines(spark, d), "l_orderkey", "l_extendedprice", "line", "l_tax"), "l_orderkey", "rank", "l_returnflag")
    made = R.relative_count(made, "l_orderkey", "l_quantity").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    made = made.withColumn("size_match", F.when(F.col("p_size").isNull(), 0.0).when(F.abs(F.col("p_size") - F.col("l_quantity")) <= 5, 1.0).otherwise(-1.0))
    return _round(made, "l_orderkey", "line", "~z", "~minmax", "top_mate", "~relative", "~size_match")


def ag35_contributions(spark, d):
    rows = R.argmax(_lines(spark, d), "l_orderkey", "l_quantity", "line")
    return _round(R.contributions(rows, "l_orderkey", MODEL, GROUPS, 3), "l_orderkey", "group", "~contribution", "place")


def ag44_contrasts(spark, d):
    raw = spark.createDataFrame([("sugar", "match", 0.8), ("sugar", "conflict", -1.1), ("grape", "match", 2.1), ("grape", "conflict", -1.9)], "feature string, state string, weight double")
    return raw.groupBy("feature").pivot("state", ["match", "conflict"]).agg(F.first("weight")).withColumn("contrast", F.round(F.col("match") - F.col("conflict"), 6))


def _first(spark, d, skip=frozenset()):
    return R.argmax(_lines(spark, d).withColumn("score", R.linear_score(MODEL, skip)), "l_orderkey", "score", "line").select("l_orderkey", "line")


def wn18_without_feature(spark, d):
    return _first(spark, d, {"l_tax"})


def so06_order(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus").desc(), F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(order)).where("place <= 5").select("o_custkey", "o_orderkey", "place")


def so12_not_contradicted(spark, d):
    """Candidates without a contradiction, all of a query if every one has it; first by score without one feature."""
    rows = _lines(spark, d).withColumn("score", R.linear_score(MODEL, {"l_tax"})).withColumn("bad", F.col("l_returnflag") == "R")
    whole = Window.partitionBy("l_orderkey")
    kept = rows.withColumn("all_bad", F.min(F.col("bad").cast("int")).over(whole) == 1).where(~F.col("bad") | F.col("all_bad"))
    return R.argmax(kept, "l_orderkey", "score", "line").select("l_orderkey", "line")


def so13_flip_guard(spark, d):
    """The first by full score, unless it differs from the one without a feature and contradicts: then that one."""
    full, less = _first(spark, d), _first(spark, d, {"l_tax"}).withColumnRenamed("line", "other")
    bad = _lines(spark, d).select("l_orderkey", "line", (F.col("l_returnflag") == "R").alias("bad"))
    both = full.join(less, "l_orderkey").join(bad, ["l_orderkey", "line"])
    return both.select("l_orderkey", F.when((F.col("line") != F.col("other")) & F.col("bad"), F.col("other")).otherwise(F.col("line")).alias("line"))


def ma26_replica(spark, d):
    """Queries where the window form and the aggregate form of the decision differ: none."""
    scored = _lines(spark, d).withColumn("score", R.linear_score(MODEL))
    other = scored.groupBy("l_orderkey").agg(F.max_by("line", F.struct("score", -F.col("line"))).alias("line"))
    return _first(spark, d).exceptAll(other).agg(F.count("*").alias("n_different"))


def ma27_cross_validated(spark, d):
    fold = F.pmod(F.col("l_orderkey"), F.lit(5)).alias("fold")
    rows = _lines(spark, d).withColumn("score", R.linear_score(MODEL)).withColumn("y", F.col("l_extendedprice") == F.max("l_extendedprice").over(Window.partitionBy("l_orderkey")))
    return R.argmax(rows, "l_orderkey", "score", "line").groupBy(fold).agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").cast("int")), 6).alias("accuracy"))


_LINES = 'lines as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as line from lineitem)'
_SCORE = "0.8 * (l_quantity - 25) / 14 - 0.5 * (l_discount - 0.05) / 0.03"
_FULL = _SCORE + " + 0.3 * (l_tax - 0.04) / 0.025"
_BLOCK = f"""{_LINES}, blocks as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, line)::int as rank, max(l_extendedprice) over w as hi, min(l_extendedprice) over w as lo, avg(l_extendedprice) over w as m, stddev_pop(l_extendedprice) over w as sd from lines window w as (partition by l_orderkey)),
f as (select *, 1 / rank::double as inv_rank, hi - l_extendedprice as gap, case when sd > 1e-12 then (l_extendedprice - m) / sd else 0 end as z, case when hi > lo then (l_extendedprice - lo) / (hi - lo) else 1 end as minmax, (rank = 1)::int as is_top1 from blocks)"""
_MATES = "coalesce(l_returnflag = first(l_returnflag) over (partition by l_orderkey order by rank), false)::int as top_mate, round(ln(count(*) over (partition by l_orderkey, l_returnflag)), 6) as log_size"
QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and n[:2] in ("wn", "ma", "ag", "so") and n[2:4].isdigit()}
SQL = {
    "wn01_block_features": f"with {_BLOCK} select l_orderkey, line, rank, round(inv_rank, 6) as inv_rank, round(gap, 6) as gap, round(z, 6) as z, round(minmax, 6) as minmax, is_top1, round(l_tax * is_top1, 6) as margin_top1 from f",
    "wn02_group_mates": f"with {_BLOCK} select l_orderkey, line, {_MATES} from f",
    "wn03_relative_count": f"with {_LINES} select l_orderkey, line, round(greatest(l_quantity - max(l_quantity) over (partition by l_orderkey), -3) / 3, 6) as relative from lines",
    "wn04_softmax": f"with {_LINES}, e as (select l_orderkey, line, exp((l_quantity - max(l_quantity) over (partition by l_orderkey)) / 5) as e from lines) select l_orderkey, line, round(e / sum(e) over (partition by l_orderkey), 6) as p from e",
    "wn05_argmax": f"with {_LINES} select l_orderkey, line, l_quantity from lines qualify row_number() over (partition by l_orderkey order by l_quantity desc, line) = 1",
    "wn06_top_probability": f"with {_LINES}, e as (select l_orderkey, exp((l_quantity - max(l_quantity) over (partition by l_orderkey)) / 5) as e from lines) select l_orderkey, round(max(e) / sum(e), 6) as p from e group by 1",
    "ma08_hand_score": f"with {_LINES} select l_orderkey, line, round(l_quantity / 50 + case l_returnflag when 'R' then 0.3 when 'A' then -0.45 else 0 end + case when l_discount <= 0.02 then 0.12 when l_discount >= 0.08 then -0.2 else 0 end + case l_linestatus when 'O' then 0.06 else 0 end, 6) as score from lines",
    "ma09_linear_score": f"with {_LINES} select l_orderkey, line, round({_FULL}, 6) as score from lines",
    "ma12_features": f"with {_BLOCK} select l_orderkey, line, round(z, 6) as z, round(minmax, 6) as minmax, coalesce(l_returnflag = first(l_returnflag) over (partition by l_orderkey order by rank), false)::int as top_mate, round(greatest(l_quantity - max(l_quantity) over (partition by l_orderkey), -3) / 3, 6) as relative, case when p_size is null then 0.0 when abs(p_size - l_quantity) <= 5 then 1.0 else -1.0 end::double as size_match from f left join part on p_partkey = l_partkey",
    "ag35_contributions": f"""with {_LINES}, b as (select * from lines qualify row_number() over (partition by l_orderkey order by l_quantity desc, line) = 1), c as (select l_orderkey, 'size' as g, 0.8 * (l_quantity - 25) / 14 as c from b union all select l_orderkey, 'money', -0.5 * (l_discount - 0.05) / 0.03 + 0.3 * (l_tax - 0.04) / 0.025 from b)
      select l_orderkey, g as "group", round(c, 6) as contribution, row_number() over (partition by l_orderkey order by abs(c) desc, g)::int as place from c""",
    "ag44_contrasts": "select * from (values ('sugar', 0.8::double, -1.1::double, 1.9::double), ('grape', 2.1, -1.9, 4.0)) v(feature, \"match\", conflict, contrast)",
    "wn18_without_feature": f"with {_LINES} select l_orderkey, line from lines qualify row_number() over (partition by l_orderkey order by {_SCORE} desc, line) = 1",
    "so06_order": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderstatus desc, o_totalprice desc, o_orderdate desc, o_orderkey)::int as place from orders qualify place <= 5",
    "so12_not_contradicted": f"with {_LINES}, k as (select * from lines qualify l_returnflag <> 'R' or min((l_returnflag = 'R')::int) over (partition by l_orderkey) = 1) select l_orderkey, line from k qualify row_number() over (partition by l_orderkey order by {_SCORE} desc, line) = 1",
    "so13_flip_guard": f"with {_LINES}, a as (select l_orderkey, line, l_returnflag from lines qualify row_number() over (partition by l_orderkey order by {_FULL} desc, line) = 1), b as (select l_orderkey, line as other from lines qualify row_number() over (partition by l_orderkey order by {_SCORE} desc, line) = 1) select l_orderkey, case when line <> other and l_returnflag = 'R' then other else line end as line from a join b using (l_orderkey)",
    "ma26_replica": "select 0::bigint as n_different",
    "ma27_cross_validated": f"with {_LINES}, y as (select *, l_extendedprice = max(l_extendedprice) over (partition by l_orderkey) as y from lines), b as (select * from y qualify row_number() over (partition by l_orderkey order by {_FULL} desc, line) = 1) select l_orderkey % 5 as fold, count(*) as n, round(avg(y::int), 6) as accuracy from b group by 1",
}
