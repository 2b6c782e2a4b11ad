"""Questions of guests: intents by ordered rules, refusals that stick, small talk, predicates over word positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.operators.text import ascii_norm

# Whole phrases of small talk, stems of refusals (the first two stick), stems of intents by precedence.
SMALLTALK = {"hello": ["привет", "здравствуйте", "hello", "hi"], "thanks": ["спасибо", "thanks", "thank you"], "bye": ["пока", "до свидания", "bye"]}
REFUSALS = [("pregnancy", r"беремен|pregnan"), ("age", r"\b(1[0-7]) (лет|years)|школьник|minor"), ("driving", r"за рул|drive"), ("health", r"лечи|здоров|health"), ("price", r"сколько стоит|price|цен[аы]")]
STICKY = ("pregnancy", "age")
INTENTS = [("direction", r"полегче|посуше|слаще|lighter|drier|sweeter"), ("dish", r"к рыбе|с сыром|with fish|стейк|steak|сыр"), ("serve", r"температур|бокал|подава|serve|glass"), ("grape", r"сорт|grape"), ("replace", r"замен|вместо|instead"), ("fact", r"год|регион|крепость|vintage|region")]


def smalltalk(column: Column | str) -> Column:
    """The kind of small talk if the whole question is one of its phrases."""
    text, kind = ascii_norm(column), F.lit(None).cast("string")
    for name, phrases in SMALLTALK.items():
        kind = F.when(text.isin(phrases), name).otherwise(kind)
    return kind


def first_rule(column: Column | str, rules: list[tuple[str, str]]) -> Column:
    text = F.lower(column)
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules])


def routed(turns: DataFrame, key: str, order: list[str], question: str) -> DataFrame:
    """``turns`` with route: a sticky refusal of an earlier turn, else small talk, a refusal, an intent, or unknown."""
    refusal = first_rule(question, REFUSALS)
    sticky = F.first(F.when(refusal.isin(*STICKY), refusal), ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("route", F.coalesce(sticky, smalltalk(question), refusal, first_rule(question, INTENTS), F.lit("unknown")))


def near_words(words: DataFrame, keys: list[str], position: str, word: str, left: list[str], right: list[str], reach: int) -> DataFrame:
    """Keys in whose words one of ``left`` stands at most ``reach`` places from one of ``right``, in any order."""
    around = Window.partitionBy(*keys).orderBy(position).rowsBetween(-reach, reach)
    marked = words.withColumn("__r", F.coalesce(F.bool_or(F.col(word).isin(right)).over(around), F.lit(False)))
    return marked.where(F.col(word).isin(left) & F.col("__r")).select(*keys).distinct()


def adjective_forms(stem: Column | str, soft: Column) -> Column:
    """Forms of a Russian adjective from its stem: masculine, feminine, neuter, plural and the genitive."""
    hard_ends, soft_ends = ["ый", "ая", "ое", "ые", "ого"], ["ий", "яя", "ее", "ие", "его"]
    forms = lambda ends: F.array(*[F.concat(stem, F.lit(e)) for e in ends])
    return F.when(soft, forms(soft_ends)).otherwise(forms(hard_ends))


def reason_move(want: str, strength: tuple[Column, Column], body: tuple[Column, Column], sugar: tuple[Column, Column], step: float = 0.5) -> Column:
    """Whether a row moves from its anchor in a wanted way (lighter, fuller, drier, sweeter): value before profile."""
    (s, a_s), (b, a_b), (g, a_g) = strength, body, sugar
    by_fact = {"lighter": a_s - s, "fuller": s - a_s, "drier": a_g - g, "sweeter": g - a_g}[want]
    by_body = {"lighter": a_b - b, "fuller": b - a_b}.get(want)
    fact = F.when(by_fact.isNotNull() & (by_fact != 0), by_fact >= (step if want in ("lighter", "fuller") else 1))
    return F.coalesce(fact, *([by_body >= step] if by_body is not None else []), F.lit(False))
