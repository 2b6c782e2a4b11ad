"""Dictionaries of names: building them, and joining them with free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.operators.skew import salted_join
from cellarflow.operators.text import edit_budget, weighted_edits, words_of


def idf(documents: Column | str, total: Column | str) -> Column:
    """ln((1 + N) / (1 + df)) + 1."""
    df, n = (F.col(c) if isinstance(c, str) else c for c in (documents, total))
    return F.log((1 + n) / (1 + df)) + 1


def document_frequencies(df: DataFrame, key: str, words: str) -> DataFrame:
    """(word, df, idf): in how many documents each word is, and its smoothed inverse frequency to four digits."""
    n = df.select(key).distinct().agg(F.count("*").alias("n"))
    counts = df.select(key, F.explode(words).alias("word")).groupBy("word").agg(F.countDistinct(key).alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("word", "df", F.round(idf("df", "n"), 4).alias("idf"))


def elect_canonical(spellings: DataFrame, key: str, spelling: str, owner: str, least_share: float = 0.8) -> DataFrame:
    """``key``, canonical, n, share: of each key the spelling that most of its owners use.

    A spelling of at least ``least_share`` wins outright; otherwise the most used, of equal ones the largest text.
    Owners count once for each spelling.
    """
    counts = spellings.groupBy(key, spelling).agg(F.countDistinct(owner).alias("n"))
    whole = Window.partitionBy(key)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("k", F.row_number().over(whole.orderBy((F.col("share") >= least_share).desc(), F.col("n").desc(), F.col(spelling).desc())))
    return ranked.where("k = 1").select(key, F.col(spelling).alias("canonical"), "n", "share")


def inverted_index(df: DataFrame, key: str, words: str) -> DataFrame:
    """(word, keys): the sorted keys whose word sets have the word."""
    return df.select(key, F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.array_sort(F.collect_set(key)).alias("keys"))


def exact_hits(tokens: DataFrame, lexicon: DataFrame, norm: str = "norm", skeleton: str = "skeleton") -> DataFrame:
    """Tokens with the entries of the same norm (cost 0), else of the same skeleton of more than three signs (cost 0.2)."""
    by_norm = tokens.join(lexicon.drop(skeleton), norm).withColumn("cost", F.lit(0.0))
    sound = tokens.where(F.length(skeleton) > 3).join(lexicon.withColumnRenamed(norm, "__norm"), skeleton).where(F.coalesce(F.col(norm) != F.col("__norm"), F.lit(True))).withColumn("cost", F.lit(0.2))
    columns = [*tokens.columns, *[c for c in lexicon.columns if c not in (norm, skeleton)], "cost"]
    return by_norm.select(*columns).unionByName(sound.select(*columns))


def fuzzy_hits(words: DataFrame, entries: DataFrame, most: int = 2, weighted: bool = False) -> DataFrame:
    """(word, norm, edits): distinct words and the entries within the edits their length allows.

    With ``weighted`` the plain edits, at most ``most``, only choose candidates; the weighted distance, in which letters
    drawn alike or often misread cost less, then has to keep to the entry's budget, and comes along as ``cost``.

    Blocked by length: a word meets the entries whose length differs by at most ``most``, and of those only such that
    share one of ``most`` + 1 equal parts of the entry at nearly the same place, so there is no cross join. Words and
    entries are single strings; nulls meet nothing.
    """
    parts = most + 1
    cut = F.floor(F.length("norm") / parts)
    piece = lambda i: F.struct(F.lit(i).alias("part"), F.length("norm").alias("size"), F.substring("norm", (cut * i + 1).cast("int"), (cut if i < parts - 1 else F.length("norm") - cut * i).cast("int")).alias("piece"))
    pieces = entries.where(F.length("norm") >= parts).select("norm", F.explode(F.array(*[piece(i) for i in range(parts)])).alias("p")).select("norm", "p.*")
    # every place of a word where a piece of an entry of that size could stand
    sizes = F.sequence(F.greatest(F.length("word") - most, F.lit(parts)), F.length("word") + most)
    spread = words.select("word").distinct().where(F.length("word") >= max(1, parts - most)).select("word", F.explode(sizes).alias("size")).select("word", "size", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    start = F.floor(F.col("size") / parts) * F.col("part") + 1
    length = F.when(F.col("part") < parts - 1, F.floor(F.col("size") / parts)).otherwise(F.col("size") - F.floor(F.col("size") / parts) * (parts - 1))
    placed = spread.select("word", "size", "part", F.explode(F.sequence(F.greatest(start - most, F.lit(1)), start + most)).alias("at"), length.alias("n")).where(F.col("at") + F.col("n") - 1 <= F.length("word"))
    placed = placed.select("word", "size", "part", F.expr("substring(word, cast(at as int), cast(n as int))").alias("piece")).distinct()
    near = placed.join(pieces, ["size", "part", "piece"]).select("word", "norm").distinct()
    edits = near.withColumn("edits", F.levenshtein("word", "norm", most)).where("edits >= 0")
    if weighted:
        return edits.withColumn("cost", weighted_edits("word", "norm", float(most))).where(F.col("cost") <= edit_budget(F.length("norm")))
    return edits.where(F.col("edits") <= edit_budget(F.length("norm")))


def best_hits(hits: DataFrame, span: list[str], k: int = 3) -> DataFrame:
    """The k best hits of each span: smallest cost, largest idf, field order (as text), canonical."""
    order = Window.partitionBy(*span).orderBy("cost", F.col("idf").desc(), "lex_field", "canonical", "entry_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def phrase_hits(tokens: DataFrame, phrases: DataFrame, key: str, position: str, word: str, service: list[str], skip_cost: float = 0.3) -> DataFrame:
    """(key, entry_id, start, end, cost): phrases of two words that stand in order, at most one service word between.

    ``phrases`` has (entry_id, words). Joined on the first word, then by position on the second: no window over texts.
    """
    two = phrases.where(F.size("words") == 2).select("entry_id", F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2"))
    t = tokens.select(key, F.col(position).alias("p"), F.col(word).alias("w"))
    begun = t.join(two, t.w == two.w1).select(key, F.col("p").alias("start"), "w2", "entry_id")
    following = begun.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("step")).withColumn("p", F.col("start") + F.col("step"))
    ended = following.join(t, [key, "p"]).where(F.col("w") == F.col("w2"))
    between = t.where(F.col("w").isin(service)).select(key, (F.col("p") + 1).alias("p"), F.lit(True).alias("skipped"))
    checked = ended.join(between, [key, "p"], "left").where((F.col("step") == 1) | F.col("skipped"))
    rows = checked.select(key, "entry_id", "start", F.col("p").alias("end"), F.when(F.col("step") == 2, skip_cost).otherwise(0.0).alias("cost"))
    return rows.groupBy(key, "entry_id", "start").agg(F.min_by("end", "cost").alias("end"), F.min("cost").alias("cost"))


def best_cer(df: DataFrame, token: str, text: str) -> DataFrame:
    """``df`` with ``cer``: least edits of the token against a run of as many words of the text, one fewer or one more.

    Over the token's length; null if the text has no words or a side is null. Runs join words by single spaces.
    """
    n = F.size(F.split(token, " "))
    run = lambda size: F.when((size >= 1) & (size <= F.size("__w")), F.transform(F.sequence(F.lit(1), F.size("__w") - size + 1), lambda i: F.array_join(F.slice("__w", i, size), " "))).otherwise(F.array())
    runs = F.concat(run(n - 1), run(n), run(n + 1))
    # levenshtein inside a lambda, so the runs of a text are never exploded
    least = F.array_min(F.transform(runs, lambda x: F.levenshtein(F.col(token), x)))
    return df.withColumn("__w", words_of(text)).withColumn("cer", least / F.length(token)).drop("__w")


def fuse_support(spans: DataFrame, group: str, reading: str, norm: str) -> DataFrame:
    """(group, norm, support, reading): how many readings of a group have a span or one within one edit.

    The first reading that has it speaks for it. With one edit the first or the last half of a span stays whole, at the
    beginning or at the end: joined on the group, the span's length and a half, so every such pair meets.
    """
    base = spans.where(F.col(norm).isNotNull()).select(F.col(group).alias("g"), F.col(reading).alias("r"), F.col(norm).alias("s")).distinct()
    own = base.groupBy("g", "s").agg(F.collect_set("r").alias("rs")).withColumn("n", F.length("s"))
    halves = lambda n: F.array(F.concat(F.lit("<"), F.substring("s", F.lit(1), F.floor(n / 2).cast("int"))), F.concat(F.lit(">"), F.right("s", F.ceil(n / 2).cast("int"))))
    keyed = own.select("g", "s", "rs", "n", F.explode(halves(F.col("n"))).alias("k"))
    other = own.select("g", "s", "rs", F.explode(F.sequence(F.greatest(F.col("n") - 1, F.lit(0)), F.col("n") + 1)).alias("n"))
    other = other.select("g", "n", F.explode(halves(F.col("n"))).alias("k"), F.col("s").alias("o"), F.col("rs").alias("ors"))
    near = salted_join(keyed.withColumn("key", F.struct("g", "n", "k")).select("key", "g", "s"), other.select(F.struct("g", "n", "k").alias("key"), "o", "ors"), "key", "s").where(F.levenshtein("s", "o", 1) >= 0)
    fused = near.select("g", "s", F.explode("ors").alias("r")).groupBy("g", "s").agg(F.countDistinct("r").cast("int").alias("support"), F.min("r").alias("first"))
    return fused.select(F.col("g").alias(group), F.col("s").alias(norm), "support", F.col("first").alias(reading))


def unmatched(tokens: DataFrame, hits: DataFrame, keys: list[str], word: str, stop: list[str], least: int = 4) -> DataFrame:
    """Tokens that no hit covers: alphabetic, long enough, no stop words."""
    real = tokens.where(F.col(word).rlike(r"^\p{L}+$") & (F.length(word) >= least) & ~F.col(word).isin(stop))
    return real.join(hits.select(*keys).distinct(), keys, "left_anti")
