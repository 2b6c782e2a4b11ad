"""Free spellings of names mapped to a canonical list, by a prefix-filtered set-similarity join.

Every text gives the runs of its words, each in one phonetic Latin spelling; an entry gives its distinctive words, and a
few known other writings. Both sides are sets of letter pairs. The pairs are ordered by global rarity; only the rare
prefixes are joined, within the lengths that an entry's edits allow, position bounds drop what can't reach the
similarity, Jaccard is computed exactly, and of the candidates within the edits that a name of its length may have the
most similar is kept. Runs are as long, in words and in letters, as any entry allows: the bounds follow from the list.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.llm.looks import ALIKE_CYRILLIC, look_column
from cellarflow.operators.skew import salted_join
from cellarflow.session import Scratch

JACCARD = 0.4
MOST_ENTRIES = 200_000  # of a reference list, which is read on the driver; a longer one is an error
COMMON = 5  # entries that share a word which then doesn't tell them apart

# Grape names in their own language, by the usual Russian name.
GRAPES = {
    "каберне совиньон": "cabernet sauvignon", "мерло": "merlot", "пино нуар": "pinot noir", "сира": "syrah", "мальбек": "malbec",
    "совиньон блан": "sauvignon blanc", "шардоне": "chardonnay", "рислинг": "riesling", "алиготе": "aligoté", "пино гриджио": "pinot grigio",
    "вионье": "viognier", "гевюрцтраминер": "gewürztraminer", "саперави": "saperavi", "ркацители": "rkatsiteli", "красностоп": "krasnostop",
    "цимлянский черный": "tsimlyansky cherny", "кокур белый": "kokur belyi", "сибирьковый": "sibirkovy", "бастардо": "bastardo",
    "темпранильо": "tempranillo", "гренаш": "grenache", "мурведр": "mourvèdre", "каберне фран": "cabernet franc", "пти вердо": "petit verdot",
    "марселан": "marselan", "зинфандель": "zinfandel", "санджовезе": "sangiovese", "неббиоло": "nebbiolo", "глера": "glera",
    "мускат белый": "muscat blanc", "траминер розовый": "traminer rose", "вердельо": "verdelho", "семильон": "sémillon", "альбариньо": "albariño",
    "вельтлинер зеленый": "grüner veltliner", "кефессия": "kefessiya", "шираз": "shiraz", "каберне": "cabernet",
}
# Cyrillic letters and Latin groups in the common phonetic spelling.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґё", ["a", "b", "v", "g", "d", "e", "z", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "q", "s", "s", "", "i", "", "e", "iu", "ia", "i", "i", "e", "g", "e"]))
LATIN = [("shch", "s"), ("sch", "s"), ("sh", "s"), ("zh", "z"), ("kh", "h"), ("tch", "q"), ("ch", "q"), ("ck", "k"), ("ph", "f"), ("ts", "C"), ("tz", "C"), ("c", "k"), ("C", "c"), ("w", "v"), ("x", "ks"), ("y", "i"), ("j", "i")]
DIGITS = str.maketrans("0135689", "oizsbbg")

# Words on labels that are no part of a name, as general words and legal forms.
GENERAL = """wine wines vin vino вино вина винное winery domaine grape grapes variety сорт виноград виноградный серия series коллекция collection
cuvée хозяйство винзавод ооо ао тм vol алк alc объём урожай vintage год партия гост сделано содержит сульфиты выдержка месяцев хранить ручной сбор made by hand
столовое россии россия крым экстра класс of the south north юга in и для the""".split()
# letters of a look that Russian and Latin words share
_OWN = {g[0]: g[1] for g in ALIKE_CYRILLIC.split() if g[1].lower() in CYRILLIC and g[1].lower() not in "ії"}
_SHARED = set(_OWN)
_WORDS = re.compile(r"[^\W_]+")


def _strip(text: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", text) if not unicodedata.combining(x))


def _squeeze(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1", text)


def latin_sound(word: str) -> str:
    for letters, sound in LATIN:
        word = word.replace(letters, sound)
    return _squeeze(word)


def sounds(word: str) -> list[str]:
    """Phonetic spellings of one word in its look: one, or two if all its letters are drawn alike in both scripts."""
    if any(x.isdigit() for x in word):
        if sum(x.isdigit() for x in word) * 2 >= len(word):
            return []
        word = word.translate(DIGITS)
    word = _strip(word)
    cyrillic = sum(x.lower() in CYRILLIC and x not in _SHARED for x in word)
    latin = sum(x.isascii() and x.isalpha() and x not in _SHARED for x in word)

    def read(as_cyrillic: bool) -> str:
        out = []
        for x in word:
            x = _OWN.get(x, x) if as_cyrillic else x
            out.append(CYRILLIC.get(x.lower(), x.lower()))
        return latin_sound("".join(out)) if not as_cyrillic or latin else _squeeze("".join(out))

    if cyrillic and cyrillic >= latin:
        return [read(True)]
    if latin:
        return [read(False)]
    return list(dict.fromkeys([read(True), read(False)]))


def _general() -> set[str]:
    return {s for w in look_column(pa.array([x for g in GENERAL for x in (g, g.upper(), g.title())])).to_pylist() for s in sounds(w)}


def run_lengths(spellings: list[tuple[int, str, int, int]]) -> list[set[int]]:
    """At k - 1: the lengths that a run of k words may have to be one of the spellings (entry, spelling, edits, words).

    A letter too few or too many is an edit, and so is each word that a run has beyond those of the spelling.
    """
    allowed: list[set[int]] = []
    for _, spelling, edits, own in spellings:
        for words in range(1, own + edits + 1):
            allowed += [set() for _ in range(words - len(allowed))]
            left = edits - max(0, words - own)
            allowed[words - 1].update(range(max(1, len(spelling) - left), len(spelling) + left + 1))
    return allowed


def runs_of(look: str, allowed: list[set[int]], glued: tuple[str, ...] = (), general: frozenset[str] | set[str] = frozenset()) -> list[tuple[str, int]]:
    """Runs of words of a text, each as one phonetic spelling without spaces, and how many words.

    ``allowed`` has the lengths of interest by the number of words; ``glued``: common words that are also cut off where
    they stand at an end of a word; a run of only ``general`` words is left out.
    """
    words = []
    for word in _WORDS.findall(look):
        read = sounds(word)
        for sound in list(read):
            for common in glued:
                if len(sound) >= len(common) + 4:
                    read += [sound[len(common) :]] if sound.startswith(common) else [sound[: -len(common)]] if sound.endswith(common) else []
        if read:
            words.append(read)
    runs: dict[str, int] = {}
    for size in range(min(len(allowed), len(words)), 0, -1):
        lengths = allowed[size - 1]
        for a in range(len(words) - size + 1):
            if all(any(x in general for x in w) for w in words[a : a + size]):
                continue
            for variant in range(max(len(w) for w in words[a : a + size])):
                run = _squeeze("".join(w[min(variant, len(w) - 1)] for w in words[a : a + size]))
                if len(run) in lengths:
                    runs[run] = size  # the fewest words that give it come last
    return list(runs.items())


def budget(length: int) -> int:
    """Edits by which a name of so many sounds may be misread."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 11 else 3


def entry_spellings(entries: list[tuple[int, str, str]]) -> tuple[list[tuple[int, str, int, int]], list[str]]:
    """(entry, spelling, edits, words) of each (entry, field, canonical), and the common words' sounds.

    Words that COMMON entries share don't tell names apart; grapes need all their words. A name with one word
    abbreviated counts where no other entry has the same short form.
    """
    looks = look_column(pa.array([c for _, _, c in entries], pa.string())).to_pylist()
    # a word whose letters could be of either alphabet is read in the one that the list writes it in
    script = [0 if any("\u0400" <= x < "\u0500" for x in c) else -1 for _, _, c in entries]
    spelled = [(e, f, [s[k] for s in map(sounds, _WORDS.findall(x)) if s], c) for (e, f, c), x, k in zip(entries, looks, script)]
    count = Counter(w for _, _, words, _ in spelled for w in set(words))
    common = {w for w, n in count.items() if n >= COMMON}
    rows: dict[tuple[int, str], tuple[int, int]] = {}
    short: dict[str, set[int]] = {}
    for entry, field, words, canonical in spelled:
        core = [w for w in words if w not in common] if field != "grape" else words
        core = core or words
        allowed = budget(len("".join(core)))
        for form in (core, words, core[::-1], words[::-1]):
            rows[entry, _squeeze("".join(form))] = (allowed, len(form))
        for at in range(len(words)) if len(words) > 1 else ():
            for size in (2, 3) if words[at] not in common else ():
                short.setdefault(_squeeze("".join([*words[:at], words[at][:size], *words[at + 1 :]])), set()).add(entry)
        own = GRAPES.get(_strip(canonical.lower()).replace("й", "й")) or GRAPES.get(canonical.lower().replace("ё", "е"))
        if field == "grape" and own:
            latin = [latin_sound(_strip(w)) for w in own.split()]
            for form in (latin, latin[::-1]):
                rows.setdefault((entry, _squeeze("".join(form))), (budget(len("".join(latin))), len(form)))
    for spelling, owners in short.items():
        if len(owners) == 1 and len(spelling) >= 6:
            rows.setdefault((next(iter(owners)), spelling), (0, 2))
    return [(e, s, *a) for (e, s), a in rows.items() if s], sorted(w for w in common if len(w) >= 4)


def letter_pairs(spelling: Column | str) -> Column:
    """The set of neighbouring letters of a spelling, its two ends included."""
    padded = F.concat(F.lit("^"), spelling, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2)))


def similar_sets(left: DataFrame, right: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """(l, r, jaccard): pairs of a row of ``left`` (l, tokens) and of ``right`` (r, tokens) with sets so similar.

    Tokens are ordered by how many sets of both sides have them, rarest first. What is joined on them has no more than
    the sets' sizes and signatures; pairs that pass the bounds get their sets then, each once. Keys are unique; empty sets
    and null pair with nothing. Tokens are compared by 64-bit hashes. If ``left``
    has a number ``size`` and ``right`` bounds ``lo`` and ``hi``, only pairs with a size within the bounds are meant:
    the size is then part of what is joined. A hot token is cut into parts.
    """
    scratch = Scratch(left.sparkSession, "sets")
    hashed = lambda df: df.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))
    left, right = hashed(left), hashed(right)
    order = left.select(F.explode("tokens").alias("t")).unionByName(right.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))
    order = scratch.save(order, "order")

    sized = "size" in left.columns

    def prefixed(df: DataFrame, key: str, extra: list[str]) -> DataFrame:
        ranked = df.select(key, *extra, F.explode("tokens").alias("t")).join(order, "t").groupBy(key, *extra).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
        size = F.size("x")
        prefix = size - F.ceil(jaccard * size - 1e-9) + 1
        # a set's signature has a bit for each token's hash
        bits = F.aggregate("x", F.lit(0).cast("long"), lambda s, y: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(y["t"], F.lit(64)).cast("int"))))
        rows = ranked.select(key, *extra, size.alias(f"n_{key}"), bits.alias(f"bits_{key}"), F.posexplode(F.slice(F.col("x.t"), F.lit(1), prefix.cast("int"))).alias(f"at_{key}", "t"))
        if sized:
            rows = rows.withColumn("size", F.col("size") if key == "l" else F.explode(F.sequence("lo", "hi"))).withColumn("t", F.xxhash64("t", F.col("size").cast("int")))
        return scratch.save(rows.select(key, f"n_{key}", f"bits_{key}", f"at_{key}", "t"), f"prefix-{key}")

    met = salted_join(prefixed(left, "l", ["size"] if sized else []), prefixed(right, "r", ["lo", "hi"] if sized else []), "t", "l")
    a, b = F.col("n_l"), F.col("n_r")
    need = F.ceil((a + b) * (jaccard / (1 + jaccard)) - 1e-9)
    near = met.where((b >= jaccard * a) & (a >= jaccard * b) & (F.least(a - F.col("at_l"), b - F.col("at_r")) >= need))
    # tokens whose bit the other side lacks can't be common
    lacking = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    near = near.where(F.least(a - lacking("bits_l", "bits_r"), b - lacking("bits_r", "bits_l")) >= need)
    # only the pairs that are left get their sets
    pairs = near.select("l", "r").distinct()
    whole = pairs.join(left.select("l", F.col("tokens").alias("all_l")), "l").join(right.select("r", F.col("tokens").alias("all_r")), "r")
    common, a, b = F.size(F.array_intersect("all_l", "all_r")), F.size("all_l"), F.size("all_r")
    return whole.withColumn("jaccard", common / (a + b - common)).where(F.col("jaccard") >= jaccard).select("l", "r", "jaccard")


def match_names(lines: DataFrame, key: str, text: str, entries: DataFrame, entry: str = "entry_id", field: str = "lex_field", canonical: str = "canonical", part: str = "is_part") -> DataFrame:
    """(key, entry, jaccard, edits): for each line that isn't null or blank the entry that it names, or -1.

    Case, look-alike letters, the alphabet, added general words and numbers, joined, split and swapped words, an
    abbreviated first word and a few misread letters don't matter. Entries that are parts are never named. Of several
    within their edits the one of the largest Jaccard, then the fewest edits, the longest spelling, the smaller id. Null
    and blank texts give no row, repeated rows one each; an empty list of entries gives -1 for all. The list of entries is
    read on the driver (a reference list; ValueError beyond MOST_ENTRIES); texts are worked out once each, however often
    they occur.
    """
    spark = lines.sparkSession
    scratch = Scratch(spark, "names")
    meant = entries.where(F.col(canonical).isNotNull() & ~F.coalesce(part, F.lit(False))).select(F.col(entry).cast("long"), field, canonical).limit(MOST_ENTRIES + 1)
    listed = [(r[0], r[1], r[2]) for r in meant.collect()]
    if len(listed) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries: cut the reference list into lists and take the best of their matches")
    spellings, common = entry_spellings(listed) if listed else ([], [])
    source = lines.where(F.col(text).isNotNull() & (F.regexp_replace(text, r"[\s\p{Z}\p{Cc}\p{Cf}]+", "") != ""))
    glued, general, allowed = tuple(common), _general(), run_lengths(spellings)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [runs_of(x, allowed, glued, general) for x in look_column(batch.column(0)).to_pylist()]
            row = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array([x for r in runs for x, _ in r], pa.string()), pa.array([n for r in runs for _, n in r], pa.int32())], ["text", "l", "words"])

    texts = scratch.save(source.select(F.col(text).alias("text")).distinct().mapInArrow(spell, "text string, l string, words int"), "runs")
    aliases = spark.createDataFrame(spellings, "entry long, r string, edits int, own int")
    bounds = [(F.length("r") - F.max("edits")).alias("lo"), (F.length("r") + F.max("edits")).alias("hi")]
    pairs = similar_sets(texts.select("l").distinct().withColumn("tokens", letter_pairs("l")).withColumn("size", F.length("l")), aliases.groupBy("r").agg(*bounds).withColumn("tokens", letter_pairs("r")))
    off = F.levenshtein("l", "r", 4)
    # two letters that changed places are two edits, but leave the same letters
    counted = lambda side, i: F.length(side) - F.length(F.replace(side, F.char(i)))
    letters = F.aggregate(F.sequence(F.lit(97), F.lit(122)), F.lit(0), lambda total, i: total + F.abs(counted(F.col("l"), i) - counted(F.col("r"), i)))
    close = pairs.join(aliases, "r").withColumn("off", off).where((F.col("off") >= 0) & (F.col("off") <= F.col("edits") + 1))
    checked = close.withColumn("off", F.when((F.col("off") >= 2) & (letters <= F.col("off") - 2), F.col("off") - 1).otherwise(F.col("off"))).where(F.col("off") <= F.col("edits"))
    rank = Window.partitionBy("text").orderBy(F.col("jaccard").desc(), "off", F.length("r").desc(), "entry")
    # a name that is split into more words than it has is misread as often again
    split = F.col("off") + F.greatest(F.col("words") - F.col("own"), F.lit(0))
    best = texts.join(checked, "l").withColumn("off", split).where(F.col("off") <= F.col("edits")).withColumn("n", F.row_number().over(rank)).where("n = 1").select("text", "entry", "jaccard", "off")
    kept = source.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    return kept.join(best, "text", "left").select(F.col("__key").alias(key), F.coalesce("entry", F.lit(-1)).cast("long").alias(entry), "jaccard", F.col("off").alias("edits"))
