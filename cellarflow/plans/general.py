"""Queries of the general operators that a training-data pipeline needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarflow.operators.packed import explode_packed
from cellarflow.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grape packed in the raw export's and the cards' fields: (table_name, row_key, pos_no, grape)."""
    raw = explode_packed(table(spark, sf_dir, "strapi_output0709"), ["row_id"], "sort_vinograda", value="grape")
    cards = explode_packed(table(spark, sf_dir, "wine_cards"), ["listing_id"], "grapes", value="grape")
    named = lambda df, name, key: df.select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "pos_no", "grape")
    return named(raw, "strapi_output0709", "row_id").unionByName(named(cards, "wine_cards", "listing_id"))


QUERIES = {"p6_found": p6_found}
# the rule said once more by patterns: quoted and bracketed stretches, words and single signs; delimiters and a lone `и` part values
_SIGNS = "\\p{L}\\p{N}_'’‐‑-".replace("'", "''")
_TOKEN = f'(?s)"(?:[^"]|"")*"|\\([^()]*\\)|\\[[^\\[\\]]*\\]|«[^«»]*»|[„“][^“”]*[“”]|[{_SIGNS}]*[0-9],[0-9][{_SIGNS}]*|[{_SIGNS}]+|.'
_SPACE = "[\\s\\x0B\\x1c-\\x1f\\x{85}\\p{Z}\\x{200B}\\x{FEFF}]+"
_PARTS = lambda c: f"string_split(array_to_string(list_transform(regexp_extract_all({c}, '{_TOKEN}'), lambda t: case when regexp_full_match(t, '[,;/|\\n\\r\\t+&•·иИ]') then chr(1) else t end), ''), chr(1))"
_TRIM = lambda c: f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"
_BARE = f"""{_TRIM("case when regexp_full_match(x, '(?s)\"(?:[^\"]|\"\")*\"') then replace(substr(x, 2, length(x) - 2), '\"\"', '\"') when length(x) >= 2 and (left(x, 1) || right(x, 1)) in ('«»', '“”', '„“', '„”') then substr(x, 2, length(x) - 2) else x end")}"""
SQL: dict[str, str] = {
    "p6_found": f"""with f as (select 'strapi_output0709' as table_name, row_id as row_key, row_number() over () as r, {_PARTS('sort_vinograda')} as p from strapi_output0709 where sort_vinograda is not null union all
        select 'wine_cards', listing_id, row_number() over (), flatten(list_transform(list_filter(grapes, lambda g: g is not null), lambda g: {_PARTS('g')})) from wine_cards where grapes is not null),
      v as (select table_name, row_key, list_filter(list_transform(list_transform(p, lambda y: {_TRIM('y')}), lambda x: {_BARE}), lambda z: z <> '') as p from f)
      select table_name, row_key, i::int as pos_no, p[i] as grape from v, range(1, 1000) n(i) where i <= len(p)""",
}
