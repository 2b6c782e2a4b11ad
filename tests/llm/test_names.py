import random

from pyspark.sql import functions as F

from cellarflow.llm.names import entry_spellings, match_names, run_lengths, runs_of, similar_sets, sounds

ENTRIES = [(1, "producer", "Хутор Дризестай", False), (2, "producer", "Товавин", False), (3, "cuvee", "Ладосистам Резерв", False), (4, "grape", "Каберне Совиньон", False), (5, "grape", "Каберне Фран", False), (6, "grape", "каберне", True), (7, "cuvee", "Damoneman", False)]
ENTRIES += [(10 + i, "producer", f"Хутор {n}", False) for i, n in enumerate(["Переботар", "Тедремим", "Кобиралой", "Сталерилай"])]
ENTRIES += [(20 + i, "cuvee", f"{n} Резерв", False) for i, n in enumerate(["Бесемодат", "Зегилей", "Вакешебас", "Белизасам"])]


def test_lines(spark):
    entries = spark.createDataFrame(ENTRIES, "entry_id long, lex_field string, canonical string, is_part boolean")
    cases = {
        "ХУТОР ДРИЗЕСТАЙ": 1, "ООО «Дризестай Хутор» 2019": 1, "Khutor Drizestay": 1, "Хутoр Дpизecтaй": 1, "хутор дризетсай": 1, "ХуторДризестай": 1, "хут. дри​зестай": 1,
        "Dризе стай вино": 1, "Хутор Нездешний": -1, "Резерв": -1, "Lad. Rezerv": 3, "Ладосистам Рез.": 3, "rezerw ladosistam": 3, "каберне": -1, "Cabernet Franc": 5, "Фран Каберне": 5,
        "КАБЕРНЕ СОВИНЬОH 2020": 4, "sauvignon cabernet": 4, "T0вавин": 2, "ТОВАВИΗ": 2, "wine of the South": -1, "100% 2019": -1, "Дамонеман": 7, "cuvée DAMONEMAN": 7, "п" * 5000: -1,
    }
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(900, None, "x"), (901, " ​\t", "x"), (902, "Товавин", "x"), (902, "Товавин", "x")]
    lines = spark.createDataFrame(rows, "line_id long, text string, entry_id string")
    got = [(r.line_id, r.entry_id) for r in match_names(lines, "line_id", "text", entries).select("line_id", "entry_id").collect()]
    assert sorted(got) == sorted([*[(i, e) for i, e in enumerate(cases.values())], (902, 2), (902, 2)])
    assert {r.entry_id for r in match_names(lines, "line_id", "text", entries.limit(0)).collect()} == {-1}
    assert match_names(lines.limit(0), "line_id", "text", entries).count() == 0


def test_set_join_against_all_pairs(spark):
    rng = random.Random(12)
    sets = lambda n: [(f"s{i}", rng.sample("abcdefghijklmnopqrst", rng.choice([0, 1, 3, 5, 8]))) for i in range(n)]
    a, b = sets(120), sets(90)
    left, right = spark.createDataFrame(a, "l string, tokens array<string>"), spark.createDataFrame(b, "r string, tokens array<string>")
    for least in (0.3, 0.5, 0.8):
        rows = similar_sets(left, right, least).collect()
        want = {(x, y) for x, s in a for y, t in b if s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= least - 1e-12}
        assert {(r.l, r.r) for r in rows} == want and len(rows) == len(want)
    assert similar_sets(left.where(F.lit(False)), right).count() == 0


def test_sounds():
    assert sounds("Saperavi") == ["saperavi"] and sounds("2019") == [] and len(sounds("COCEP")) == 2
    spelled, common = entry_spellings([(e, f, c) for e, f, c, p in ENTRIES if not p])
    assert (3, "ladrezerv", 0, 2) in spelled and "hutor" in common
    assert ("drizestai", 1) in runs_of("Xyтop Дpизecтaй", run_lengths(spelled))


def test_names_of_many_words_and_letters(spark):
    long = "Верхнедолинопогребновиноградниковский Замечательноразмеренносозревающий"
    entries = spark.createDataFrame([(1, "cuvee", "Белый Конь Среди Синих Ночных Полей", False), (2, "producer", long, False)], "entry_id long, lex_field string, canonical string, is_part boolean")
    cases = ["белый конь среди синих ночных полей", "Белый Конь Среди Си них Ночных Полей 2019", "белый конь", long.upper(), long.replace("размер", "разнер"), "Полей"]
    lines = spark.createDataFrame(list(enumerate(cases)), "line_id long, text string")
    assert {r.line_id: r.entry_id for r in match_names(lines, "line_id", "text", entries).collect()} == {0: 1, 1: 1, 2: -1, 3: 2, 4: 2, 5: -1}


def test_sized_join_against_all_pairs(spark):
    rng = random.Random(3)
    made = lambda side, n: [(f"{side}{i}", rng.sample("abcdefghijk", rng.choice([2, 4, 6])), rng.randrange(4, 12)) for i in range(n)]
    a, b = made("l", 90), made("r", 70)
    left = spark.createDataFrame(a, "l string, tokens array<string>, size int")
    right = spark.createDataFrame([(r, t, n - 2, n + 2) for r, t, n in b], "r string, tokens array<string>, lo int, hi int")
    rows = similar_sets(left, right, 0.4).collect()
    want = {(x, y) for x, s, n in a for y, t, m in b if abs(n - m) <= 2 and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.4 - 1e-12}
    assert {(r.l, r.r) for r in rows} == want and len(rows) == len(want)
