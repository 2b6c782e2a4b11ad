import random
import unicodedata

import pyarrow as pa
from pyspark.sql import types as T

from cellarflow.llm.looks import ALIKE_CYRILLIC, ALIKE_GREEK, HYPHENS, INVISIBLE, fold, look_column, same_look_pairs, with_looks

GROUPS = {x: g[0] for g in (ALIKE_CYRILLIC + " " + ALIKE_GREEK).split() for x in g}


def plain_look(text):
    """Sign by sign, by the Unicode tables: decomposed, folded, without composing."""
    out = []
    for sign in text:
        point = ord(sign)
        if point in INVISIBLE or unicodedata.category(sign) == "Cf":
            continue
        if point in HYPHENS:
            sign = "-"
        if unicodedata.category(sign)[0] == "Z" or sign in "\t\n":
            sign = " "
        if unicodedata.decomposition(sign).startswith(("<wide>", "<narrow>")) or 0x2160 <= point <= 0x217F:
            sign = unicodedata.normalize("NFKC", sign)
        for part in unicodedata.normalize("NFD", sign):
            out.append(GROUPS.get(part, part))
    return unicodedata.normalize("NFD", "".join(out)).strip(" ")


def test_against_sign_by_sign():
    rng = random.Random(3)
    signs = list("abcАВСабсхуΟοёййї12IХ-–‑  ​\xad﻿ＡＢ１Ⅻⅳéèñüậ") + ["́", "̈", "̆", "̣"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    got = look_column(pa.array(texts)).to_pylist()
    assert ["".join(GROUPS.get(y, y) for y in unicodedata.normalize("NFD", x)) for x in got] == [plain_look(t) for t in texts]


def test_cases():
    assert fold("шaтo") == fold("шато") and fold("Ⅻ") == "XII" and fold("ＣＵＶÉＥ") == fold("CUVÉE")
    assert fold("cuvée") != fold("cuvee") and fold("Мерло") != fold("мерло") and fold("0OO") != fold("OOO")
    assert look_column(pa.array([None, "", "​", "я" * 300_000])).to_pylist() == [None, "", "", "я" * 300_000]
    readable = look_column(pa.array(["шaтo", "зелёный", "ΟΟΟ", "Мерлo b"]), script=True).to_pylist()
    assert readable == ["шато", "зелёный", "OOO", fold("Мерлo b")]


def test_pairs(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("q", T.StringType()), T.StructField("t", T.StringType()), T.StructField("look", T.StringType())])
    rows = [(1, "a", "шато", "x"), (2, "a", "шaто", "x"), (3, "a", "шато", "x"), (4, "b", "шато", "x"), (5, None, "шaто", "x"), (6, "a", None, "x"), (7, "a", "Шато", None), (8, "b", "", None), (9, "b", "​", None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, same_look_pairs(df, "id", "q", "t").collect())) == [(1, 2), (2, 3), (8, 9)]
    assert same_look_pairs(df.limit(0), "id", "q", "t").count() == 0
    assert with_looks(df, {"t": "look"}).columns == ["id", "q", "t", "look"]
    assert {r.id: r.look for r in with_looks(df, {"t": "look"}).collect()}[6] is None
