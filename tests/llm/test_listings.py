import random

from cellarflow.llm import listings
from cellarflow.llm.listings import Reader, _find_phrases, _one_slip, mined_words, product_groups, product_pairs, settled

from cellarflow.session import Scratch

COLUMNS = "listing_id long, name string, winery string, sugar string, sugar_class string, category string, brand string, group_id string"


def test_reader():
    read = Reader().read
    a = read('Вино "ПАШИДРОКИР" | кр. | 0,75л | 12,5% vol | урожай 2014 | Sale -15% | экстра-брют', "ООО «Хутор Востоба»", None, None, None)
    assert a[0] == ["vostoba"] and a[2] == ["pasidrokir"] and a[3:] == ("red", "extra_brut", 2014, 750)
    b = read("Wine Pashidrokir Cabernet Sauvignon & Muscat Blanc '14 75 cl п/сух. 100% оригинал", None, None, None, "Белое")
    assert b[3:] == ("white", "off_dry", 2014, 750) and "pasidrokir" in b[1]
    assert read(None, None, None, None, None) == ([], [], [], None, None, None, None)
    assert read("x 1.5 L", None, "semi-sweet", "brut", None)[4:] == ("brut", None, 1500)
    assert _one_slip("huotr", "hutor") and _one_slip("abc", "abxc") and not _one_slip("abcd", "badc")


def test_groups(spark, monkeypatch):
    rng = random.Random(13)
    makers = [("Востоба", "Vostoba"), ("Драшамадран", "Drashamadran"), ("Зиданет", "Zidanet"), ("Корадрот", "Koradrot"), ("Лепованом", "Lepovanom"), ("Мапетост", "Mapetost"), ("Кигогин", "Kigogin")]
    syllables = [("ва", "va"), ("ши", "shi"), ("до", "do"), ("ре", "re"), ("га", "ga"), ("бу", "bu"), ("ни", "ni"), ("ко", "ko"), ("ле", "le"), ("тро", "tro")]
    names = []  # of each maker, its own
    while len(names) < 5 * len(makers):
        parts = [rng.choice(syllables) for _ in range(4)]
        names.append((("".join(a for a, _ in parts) + "р").capitalize(), ("".join(b for _, b in parts) + "r").capitalize()))
    colours, sugars = {"r": ["красное", "red", "кр."], "w": ["бел.", "blanc"]}, {"d": ["сухое", "dry"], "s": ["сладкое", "dolce"]}
    rows, truth = [], {}
    for k in range(600):
        maker = rng.randrange(len(makers))
        name = 5 * maker + rng.randrange(5)
        second, colour, sugar, year, size = rng.choice(["", "", " Резерв"]), rng.choice("rw"), rng.choice("ds"), rng.choice([None, 2015]), rng.choice([750, 1500])
        wine = (maker, name, second, colour, sugar, year, size)
        said = rng.choice(names[name]) + second
        if rng.random() < 0.04:
            at = rng.randrange(2, 6)
            said = said[:at] + said[at + 1 :]
        said = rng.choice([said, said.upper(), f"«{said}»", f'"{said}"'])
        maker_said = rng.choice(["{}", "Винодельня {}", "{} Winery", "ООО «{}»"]).format(rng.choice(makers[maker]))
        in_column = rng.random() < 0.8
        parts = [said, rng.choice(colours[colour]), {750: rng.choice(["0,75 л", "75 cl"]), 1500: "1.5L"}[size], *rng.sample(["хит продаж", "premium", "12,5%", "Мерло", "с доставкой"], 2)]
        parts += [str(year)] if year else []
        parts += [] if in_column else [maker_said]
        sugar_column = rng.random() < 0.5
        parts += [] if sugar_column else [rng.choice(sugars[sugar])]
        rng.shuffle(parts)
        rows.append((k, rng.choice([" | ", " / ", ", "]).join(parts), maker_said if in_column else None, rng.choice(sugars[sugar]) if sugar_column else None, None, None, "x", None))
        truth[k] = wine
    df = spark.createDataFrame([*rows, rows[0], (1000, None, None, None, None, None, "x", None), (1001, "", None, None, None, None, None, None), (None, "x", None, None, None, None, None, None)], COLUMNS)
    groups = product_groups(df)
    got = {r.listing_id: r.group_id for r in groups.collect()}
    assert len(got) == 602 and got[1000] == 1000 and got[1001] == 1001
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    found = {(r[0], r[1]) for r in product_pairs(groups).collect()}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.02 * len(found)
    assert product_groups(df.limit(0)).count() == 0
    # the dictionary in many blocks and the listings in many chunks: the same groups
    monkeypatch.setattr(listings, "BLOCK_PHRASES", 7)
    monkeypatch.setattr(listings, "CHUNK_LISTINGS", 90)
    assert {r.listing_id: r.group_id for r in product_groups(df).collect()} == got


def test_mined_words(spark):
    rng = random.Random(4)
    names = [f"name{i}" for i in range(30)]
    rows = [([rng.choice(["old", "reserve"]), n] if rng.random() < 0.6 else [n], 3) for n in names for _ in range(4)] + [(["hot", x], 40) for x in ("old", "reserve", "estate")]
    assert mined_words(spark.createDataFrame(rows, "words array<string>, n long")) == ["old", "reserve"]
    assert mined_words(spark.createDataFrame([], "words array<string>, n long")) == []


def test_phrases_in_blocks(spark, monkeypatch):
    entries = spark.createDataFrame([("ab", "ma"), ("ab", "mama"), ("cd", "ma"), ("ef", "zu")], "brand string, model string")
    rows = [(1, "ab", ["x", "ma", "ma"]), (2, None, ["ma", "c", "d"]), (3, None, ["ma"]), (4, None, ["zu"]), (5, None, ["ef", "ma"]), (6, "ef", ["ma"]), (7, None, None), (8, None, ["xma"]), (9, None, ["cd", "ma", "ma"])]
    want = {(1, "ab", "mama"), (2, "cd", "ma"), (3, None, "ma"), (4, "ef", "zu"), (5, "ef", None), (6, "ef", None), (9, "cd", "ma")}
    for size in (1, 100):
        monkeypatch.setattr(listings, "BLOCK_PHRASES", size)
        got = _find_phrases(spark.createDataFrame(rows, "listing_id long, brand string, words array<string>"), entries).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_slips_of_slips(spark):
    chain = [("b", f"p{i}", f"p{i + 1}") for i in range(9)] + [("c", "p3", "q")]
    ends = settled(spark.createDataFrame(chain, "brand string, model string, best string"), "brand", "model", Scratch(spark, "t"), "s")
    assert {tuple(r) for r in ends.select("brand", "model", "best").collect()} == {*[("b", f"p{i}", "p9") for i in range(9)], ("c", "p3", "q")}
