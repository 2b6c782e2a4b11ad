import random

import pyarrow as pa
from pyspark.sql import types as T

from cellarflow.operators.packed import explode_packed, split_packed

SPACE = " \t\n\xa0"
PAIRS = {"«": "»", "(": ")", "[": "]"}


def plain_split(text):
    """One sign at a time; quotes and brackets are balanced in these texts."""
    values, piece, quoted, depth = [], "", False, 0
    for i, sign in enumerate(text):
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        if sign == '"':
            quoted = not quoted
        elif not quoted:
            depth += (sign in PAIRS) - (sign in PAIRS.values())
        cut = sign in ",;/|\n\t+&•" and not (sign == "," and before.isdigit() and after.isdigit())
        word = lambda x: x.isalnum() or x in "-_'"
        cut |= sign in "иИ" and not (before and word(before)) and not (after and word(after))
        if cut and not quoted and not depth:
            values.append(piece)
            piece = ""
        else:
            piece += sign
    clean = []
    for value in [*values, piece]:
        value = value.strip(SPACE)
        if len(value) > 1 and value[0] == value[-1] == '"' and value[1:-1].replace('""', "").count('"') == 0:
            value = value[1:-1].replace('""', '"')
        elif len(value) > 1 and value[0] == "«" and value[-1] == "»":
            value = value[1:-1]
        if value.strip(SPACE):
            clean.append(value.strip(SPACE))
    return clean


def rows_of(texts):
    parent, place, value = split_packed(pa.array(texts, pa.string()))
    return list(zip(parent.tolist(), place.tolist(), value.to_pylist()))


def test_against_one_sign_at_a_time():
    rng = random.Random(5)
    words = ["Мерло", "Пино-Нуар", "12,5 %", '"a, b"', '"a ""b"", c"', "«Сира / x»", "(клон 1, 2)", "[юг/север]", "и", "Иа", "", "Ко и"]
    texts = ["".join(rng.choice(words) + rng.choice([",", " ; ", "/", " и ", "\n", " | ", " ", "\t", "&", " • "]) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    texts = [t for t in texts if '""' not in t.replace('""b""', "")]
    assert rows_of(texts) == [(i, k + 1, v) for i, t in enumerate(texts) for k, v in enumerate(plain_split(t))]


def test_given_cases():
    assert rows_of([None, "", " \xa0", ",;"]) == []
    assert rows_of(['"","a"', '"" "x"', "x (a, b", '"a, b']) == [(0, 1, "a"), (1, 1, '"" "x"'), (2, 1, "x (a"), (2, 2, "b"), (3, 1, '"a'), (3, 2, "b")]
    assert rows_of(["Каберне Фран 12,5 % , "]) == [(0, 1, "Каберне Фран 12,5 %")]
    long = "a, " * 200_000
    assert len(rows_of([long])) == 200_000


def test_frames(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("value", T.StringType()), T.StructField("g", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(1, "x", ["a, b", None, "", "c"]), (1, "x", ["a, b", None, "", "c"]), (2, None, None), (3, "", [])], schema)
    got = sorted(map(tuple, explode_packed(df, ["k"], "g").collect()))
    assert got == sorted([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")] * 2)
    assert explode_packed(df.limit(0), ["k"], "g").count() == 0
    assert [tuple(r) for r in explode_packed(df, ["k"], "value", value="value").collect()] == [(1, 1, "x")] * 2
