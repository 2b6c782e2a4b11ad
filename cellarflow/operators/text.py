"""Text functions on columns: normal forms, tokens and their kinds, finders, filters and guards."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Costs of confusions in reading (symmetric), letters and pairs that readers mix up.
LOOKALIKE = dict(zip("аеорсухвнкмтіѕ", "aeopcyxbhkmtis"))
CONFUSED = {("0", "o"): 0.3, ("1", "l"): 0.3, ("1", "i"): 0.3, ("5", "s"): 0.3, ("8", "b"): 0.3, ("и", "н"): 0.4, ("п", "л"): 0.5, ("ш", "щ"): 0.3, ("е", "ё"): 0.0, ("и", "й"): 0.3, ("ь", "ъ"): 0.3, ("c", "e"): 0.5, ("u", "v"): 0.4}
SWAPS = {("rn", "m"): 0.4, ("vv", "w"): 0.4, ("cl", "d"): 0.5, ("ii", "u"): 0.5, ("ьi", "ы"): 0.3}
SPACE_COST = 0.3
ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
ROMAN_PATTERN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
SUGAR_PHRASES = [("extra_brut", r"экстра[ -]брют|extra[ -]brut"), ("polusuhoe", r"полусух|semi-?dry|off-dry"), ("polusladkoe", r"полуслад|semi-?sweet"), ("brut", r"брют|\bbrut\b"), ("suhoe", r"сух(ое|ой|ая)|\bdry\b"), ("sladkoe", r"сладк(ое|ий|ая)|\bsweet\b")]
COLOUR_PHRASES = [("rose", r"розов|\bros[eé]\b"), ("orange", r"оранж|\borange\b"), ("white", r"бел(ое|ый|ая)|\bwhite\b|\bblanc\b"), ("red", r"красн|\bred\b|\brouge\b")]
VIOLATIONS = [("benefit", r"полез|лечит|healthy|cures"), ("promo", r"скидк|акци|купит|sale|buy now"), ("price", r"\d+ ?(руб|₽|\$|€)|цена"), ("driving", r"за рул|drive|driving"), ("dose", r"безопасн\w* доз|safe dose")]


def ascii_norm(column: Column | str) -> Column:
    """Small letters, everything but letters and digits to single spaces, trimmed: the whole rule on plain text."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "))


def words_of(column: Column | str) -> Column:
    """The words of a text in its own spelling, punctuation left out; an empty array for none, null for null."""
    return F.filter(F.split(F.trim(F.regexp_replace(column, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def label_norm_text(text: str | None) -> str | None:
    """Label norm of one string: NFKC, small letters, no accents but й ё ї kept and ё as е, final ъ dropped.

    Punctuation becomes a space except a percent sign and joiners between digits; n / m becomes n/m.
    """
    if text is None:
        return None
    kept = {"й": "", "ї": ""}
    text = unicodedata.normalize("NFKC", text).lower().replace("ё", "е")
    for letter, mark in kept.items():
        text = text.replace(letter, mark)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    for letter, mark in kept.items():
        text = text.replace(mark, letter)
    text = re.sub(r"ъ(?!\w)", "", text)
    text = re.sub(r"(?<=\d)\s*/\s*(?=\d)", "/", text)
    text = re.sub(r"(?<=\d)([.,/:-])(?=\d)", lambda m: {".": "", ",": "", "/": "", ":": "", "-": ""}[m[1]], text)
    text = re.sub(r"[^\w%-]|_", " ", text)
    return re.sub(r"\s+", " ", text.translate({0xE003: ".", 0xE004: ",", 0xE005: "/", 0xE006: ":", 0xE007: "-"})).strip()


def by_distinct(df: DataFrame, column: str, name: str, function, kind: T.DataType) -> DataFrame:
    """``df`` with ``name``: a Python function of a string, called by Arrow batches once for each distinct value in one."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        known = {v: function(v) for v in values.unique()}
        return values.map(known.get) if len(values) else values

    return df.withColumn(name, apply(F.col(column)))


def clean_question(column: Column | str) -> Column:
    """A question without control and format signs, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"[\p{Cc}\p{Cf}]+", " "), r"\s+", " "))


def fold_homoglyphs_text(token: str | None) -> str | None:
    """Letters drawn alike in the script that most letters of the token have; Cyrillic if there are as many of both."""
    if token is None:
        return None
    to_latin = LOOKALIKE | {k.upper(): v.upper() for k, v in LOOKALIKE.items()}
    to_cyrillic = {v: k for k, v in to_latin.items()}
    sure = [c for c in token if c.isalpha() and c not in to_latin and c not in to_cyrillic]
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in (sure or token))
    latin = sum(c.isascii() and c.isalpha() for c in (sure or token))
    table = to_cyrillic if cyrillic >= latin and cyrillic else to_latin
    return "".join(table.get(c, c) for c in token)


_LATIN_LIKE = "".join(v + v.upper() for v in LOOKALIKE.values())
_CYRILLIC_LIKE = "".join(k + k.upper() for k in LOOKALIKE)


def fold_homoglyphs(column: Column | str) -> Column:
    """The column form of ``fold_homoglyphs_text``, without Python."""
    column = F.col(column) if isinstance(column, str) else column
    alike = "[" + _LATIN_LIKE + _CYRILLIC_LIKE + "]"
    sure = F.regexp_replace(F.regexp_replace(column, alike, ""), r"[^\p{L}]", "")
    seen = F.when(sure != "", sure).otherwise(column)
    count = lambda letters: F.length(F.regexp_replace(seen, f"[^{letters}]", ""))
    cyrillic, latin = count("Ѐ-ӿ"), count("A-Za-z")
    return F.when((cyrillic >= latin) & (cyrillic > 0), F.translate(column, _LATIN_LIKE, _CYRILLIC_LIKE)).otherwise(F.translate(column, _CYRILLIC_LIKE, _LATIN_LIKE))


def roman_value(column: Column | str) -> Column:
    """The value of a valid Roman numeral in capitals; null for anything else."""
    column = F.col(column) if isinstance(column, str) else column
    values = F.transform(F.split(column, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair]), c), F.lit(0)))
    folded = F.aggregate(F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, v: F.struct(F.when(v < s["last"], s["sum"] - v).otherwise(s["sum"] + v).alias("sum"), F.greatest(v, s["last"]).alias("last")))
    return F.when((F.length(column) > 0) & column.rlike(ROMAN_PATTERN), folded["sum"])


def tokens_of(column: Column | str) -> Column:
    """Chunks of a line: numbers with inner separators, words with inner hyphens and apostrophes."""
    return F.regexp_extract_all(column, F.lit(r"([0-9]+(?:[.,/:][0-9]+)*|[\p{L}]+(?:[-'’][\p{L}]+)*)"), F.lit(1))


def token_kind(token: Column | str) -> Column:
    """year, ratio, abv, number, roman (capitals only) or word."""
    token = F.col(token) if isinstance(token, str) else token
    number = F.regexp_replace(token, ",", ".").try_cast("double")
    a, b = (F.regexp_extract(token, r"^(\d{1,3})/(\d{1,3})$", i).try_cast("int") for i in (1, 2))
    return (
        F.when(token.rlike(r"^(19|20)\d\d$"), "year").when(token.rlike(r"^\d{1,3}/\d{1,3}$") & (a + b == 100), "ratio").when(token.rlike(r"^\d{1,2}[.,]\d$") & number.between(3, 25), "abv")
        .when(token.rlike(r"^\d"), "number").when((F.length(token) > 0) & token.rlike(ROMAN_PATTERN), "roman").otherwise("word")
    )


def merge_spaced(column: Column | str) -> Column:
    """Spaced years, ratios and units put together: ``2 0 1 9``, ``30 / 70``, ``13 %``."""
    text = F.regexp_replace(column, r"\b([12]) ([09]) (\d) (\d)\b", "$1$2$3$4")
    text = F.regexp_replace(text, r"(\d) ?/ ?(\d)", "$1/$2")
    return F.regexp_replace(text, r"(\d) (%|л\b|мл\b|ml\b|cl\b)", "$1$2")


# A Latin spelling of Cyrillic letters, and back (longest groups first).
ROMANISED = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
TRANSCRIBED = [("shch", "щ"), ("sch", "ш"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ya", "я"), ("yu", "ю"), ("yo", "ё"), ("ii", "ий"), ("ck", "к"), ("ph", "ф"), ("qu", "кв")]
TRANSCRIBED += list(zip("abcdefghijklmnopqrstuvwxyz", ["а", "б", "к", "д", "е", "ф", "г", "х", "и", "й", "к", "л", "м", "н", "о", "п", "к", "р", "с", "т", "у", "в", "в", "кс", "и", "з"]))


def romanise(column: Column | str) -> Column:
    """Cyrillic in Latin letters, the rest as it is, in small letters."""
    text = F.lower(column)
    for letter, latin in ROMANISED.items():
        text = F.replace(text, F.lit(letter), F.lit(latin))
    return text


def transcribe_text(token: str | None) -> str | None:
    """A Latin token in Cyrillic letters, longest groups first; other signs stay."""
    if token is None:
        return None
    token, out = token.lower(), []
    while token:
        group, letters = next(((g, c) for g, c in TRANSCRIBED if token.startswith(g)), (token[0], token[0]))
        out.append(letters)
        token = token[len(group) :]
    return "".join(out)


def transcribe(column: Column | str) -> Column:
    """The column form of ``transcribe_text``, without Python."""
    groups = F.regexp_extract_all(F.lower(column), F.lit("(?s)(" + "|".join([g for g, _ in TRANSCRIBED]) + "|.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in TRANSCRIBED for x in pair])
    return F.array_join(F.transform(groups, lambda g: F.coalesce(F.try_element_at(table, g), g)), "")


def skeleton(column: Column | str) -> Column:
    """A phonetic key: romanised, letter groups of one sound folded, vowels of one sound folded, doubles dropped."""
    text = romanise(column)
    for pattern, sound in ((r"[^a-z]+", ""), ("shch|sch|sh", "s"), ("zh", "z"), ("kh", "h"), ("ch", "c"), ("ts|tz", "c"), ("ck|q", "k"), ("ph", "f"), ("w", "v"), ("x", "ks"), ("[yj]", "i"), ("(.)\\1+", "$1")):
        text = F.regexp_replace(text, pattern, sound)
    return text


def edit_budget(length: Column | str) -> Column:
    """Edits that a name of this length allows: 0 up to 3 signs, 0.5 up to 5, 1 up to 8, 1.5 up to 12, else 2."""
    length = F.col(length) if isinstance(length, str) else length
    return F.when(length <= 3, 0.0).when(length <= 5, 0.5).when(length <= 8, 1.0).when(length <= 12, 1.5).otherwise(2.0)


def bounded_edits(a: Column | str, b: Column | str, most: int) -> Column:
    """Edit distance up to ``most``, ``most`` + 1 beyond."""
    raw = F.levenshtein(a, b, most)
    return F.when(raw < 0, most + 1).otherwise(raw)


def weighted_edits_text(a: str, b: str, cutoff: float) -> float:
    """Edit distance with cheap confusions; infinity once no path stays within the cutoff."""
    cost = {p: c for (x, y), c in CONFUSED.items() for p in ((x, y), (y, x))} | {p: 0.0 for x, y in LOOKALIKE.items() for p in ((x, y), (y, x))}
    swaps = {p: c for (x, y), c in SWAPS.items() for p in ((x, y), (y, x))}
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                continue
            best = float("inf")
            if i:
                best = min(best, rows[i - 1][j] + (SPACE_COST if a[i - 1] == " " else 1.0))
            if j:
                best = min(best, rows[i][j - 1] + (SPACE_COST if b[j - 1] == " " else 1.0))
            if i and j:
                best = min(best, rows[i - 1][j - 1] + (0.0 if a[i - 1] == b[j - 1] else cost.get((a[i - 1], b[j - 1]), 1.0)))
            for (x, y), c in swaps.items():
                if i >= len(x) and j >= len(y) and a[i - len(x) : i] == x and b[j - len(y) : j] == y:
                    best = min(best, rows[i - len(x)][j - len(y)] + c)
            rows[i][j] = best
        if i and min(rows[i]) > cutoff and (i < 2 or min(rows[i - 1]) > cutoff):
            return float("inf")
    return rows[-1][-1] if rows[-1][-1] <= cutoff else float("inf")


def weighted_edits_arrays(left: list[str], right: list[str], cutoff: float, block: int = 2_000) -> np.ndarray:
    """``weighted_edits_text`` of many pairs at once: the table of one pair is filled cell by cell for a block of pairs.

    Pairs of like lengths go together. A pair whose lengths alone cost more than the cutoff isn't worked out.
    """
    out = np.full(len(left), np.inf)
    sizes = np.array([[len(x), len(y)] for x, y in zip(left, right)], np.int64).reshape(-1, 2)
    # the cheapest way to lose a sign is a space or a pair that reads as one
    order = np.lexsort((sizes.min(1), sizes.max(1))) if len(sizes) else np.zeros(0, np.int64)
    order = order[np.abs(sizes[order, 0] - sizes[order, 1]) * SPACE_COST <= cutoff]
    signs = {c: k for k, c in enumerate(sorted(set("".join(left) + "".join(right)) | {c for pair in [*CONFUSED, *LOOKALIKE.items()] for c in pair} | set("".join(x + y for x, y in SWAPS))), 1)}
    cost = 1.0 - np.eye(len(signs) + 1)
    for (x, y), c in [*CONFUSED.items(), *[(pair, 0.0) for pair in LOOKALIKE.items()]]:
        cost[signs[x], signs[y]] = cost[signs[y], signs[x]] = c
    gap = np.ones(len(signs) + 1)
    if " " in signs:
        gap[signs[" "]] = SPACE_COST
    swaps = [([signs[c] for c in x], [signs[c] for c in y], c) for pair, c in SWAPS.items() for x, y in (pair, pair[::-1])]
    for at in range(0, len(order), block):
        pick = order[at : at + block]
        la, lb = sizes[pick, 0], sizes[pick, 1]
        a, b = np.zeros((la.max(), len(pick)), np.int64), np.zeros((lb.max(), len(pick)), np.int64)
        for k, i in enumerate(pick):
            a[: la[k], k] = [signs[c] for c in left[i]]
            b[: lb[k], k] = [signs[c] for c in right[i]]
        made = np.full(len(pick), np.inf)
        rows: list[list[np.ndarray]] = []  # the last three
        for i in range(len(a) + 1):
            row: list[np.ndarray] = []
            for j in range(len(b) + 1):
                best = np.zeros(len(pick)) if not i and not j else np.full(len(pick), np.inf)
                if i:
                    best = np.minimum(best, rows[-1][j] + gap[a[i - 1]])
                if j:
                    best = np.minimum(best, row[j - 1] + gap[b[j - 1]])
                if i and j:
                    best = np.minimum(best, rows[-1][j - 1] + cost[a[i - 1], b[j - 1]])
                for x, y, c in swaps:
                    if i >= len(x) and j >= len(y):
                        here = np.logical_and.reduce([a[i - len(x) + k] == v for k, v in enumerate(x)] + [b[j - len(y) + k] == v for k, v in enumerate(y)])
                        if here.any():
                            best = np.where(here, np.minimum(best, rows[-len(x)][j - len(y)] + c), best)
                row.append(best)
                done = (la == i) & (lb == j)
                made[done] = best[done]
            rows = [*rows[-2:], row]
        out[pick] = np.where(made <= cutoff + 1e-12, made, np.inf)
    return out


def weighted_edits(a: Column | str, b: Column | str, cutoff: float = 2.0) -> Column:
    """Column form of the weighted edit distance, over whole Arrow batches; null for null, infinity beyond the cutoff."""

    @F.pandas_udf("double")
    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        known = left.notna() & right.notna()
        made = pd.Series(pd.array([None] * len(left), "Float64"), index=left.index)
        made[known] = weighted_edits_arrays(left[known].tolist(), right[known].tolist(), cutoff)
        return made

    return apply(a, b)


def words_match(a: Column | str, b: Column | str) -> Column:
    """Whether two words may be forms of one: a common start of five signs (or the shorter word less one), short tails."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    shorter = F.least(F.length(a), F.length(b))
    stem = F.least(F.lit(5), F.greatest(shorter - 1, F.lit(3)))
    return (a == b) | ((shorter >= 4) & (F.substring(a, F.lit(1), stem) == F.substring(b, F.lit(1), stem)) & (F.abs(F.length(a) - F.length(b)) <= 3))


def form_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y): words of ``left`` (x) and of ``right`` (y) for which ``words_match`` holds; both have distinct words.

    The shorter word's length tells how many letters must be equal; the longer one meets each length that its own allows,
    so all such pairs meet and no others are looked at than those with a common beginning.
    """
    stem = lambda n: F.least(F.lit(5), F.greatest(n - 1, F.lit(3)))
    n = lambda c: F.length(c)
    sizes = lambda c: F.when(n(c) < 4, F.array(n(c))).otherwise(F.sequence(F.greatest(n(c) - 3, F.lit(4)), n(c)))
    part = lambda c: F.when(F.col("size") < 4, F.col(c)).otherwise(F.substring(c, F.lit(1), stem(F.col("size"))))
    keyed = lambda df, c: df.where(F.col(c).isNotNull()).select(c, F.explode(sizes(F.col(c))).alias("size")).withColumn("k", part(c))
    met = keyed(left, "x").join(keyed(right, "y"), ["size", "k"]).where(F.col("size") == F.least(n("x"), n("y")))
    return met.select("x", "y").where(words_match("x", "y"))


def has_word(bag: Column | str, word: Column | str, fuzzy: bool = False) -> Column:
    """Whether a bag of words has a word, or with ``fuzzy`` one within an edit."""
    word = F.col(word) if isinstance(word, str) else word
    return F.exists(bag, lambda x: F.levenshtein(x, word, 1) >= 0) if fuzzy else F.array_contains(bag, word)


def first_class(column: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern the text in small letters has; null for none."""
    text, found = F.lower(column), F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def all_classes(column: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The names of all rules whose pattern the text has, in the order of the rules."""
    text = F.lower(column)
    return F.filter(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]), lambda x: x.isNotNull())


def sentences(column: Column | str) -> Column:
    """Sentences: cut after . ! ? before white space and at line ends; blank ones left out."""
    return F.filter(F.transform(F.split(column, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def sanitise(column: Column | str, rules: list[tuple[str, str]] = VIOLATIONS) -> Column:
    """The text without the sentences that a rule forbids."""
    pattern = "|".join(f"({p})" for _, p in rules)
    return F.array_join(F.filter(sentences(column), lambda s: ~F.lower(s).rlike(pattern)), " ")


def invented_numbers(text: Column | str, trusted: Column | str) -> Column:
    """Numbers of a text that the trusted text lacks."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.array_except(numbers(text), numbers(trusted))


def first_failing(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that is true; null if none is."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks])


def clean_lines(column: Column | str) -> Column:
    """Lines trimmed, blank ones and later repetitions (whatever their case) left out."""
    lines = F.filter(F.transform(F.split(column, r"\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(lines, lambda s, i: ~F.array_contains(F.transform(F.slice(lines, 1, i), lambda x: F.lower(x)), F.lower(s)))


def looks_looped(column: Column | str, most: int = 3) -> Column:
    """Whether a line comes more than ``most`` times, or one word more than ``most`` times in a row."""
    lines = F.filter(F.split(F.lower(column), r"\s*\n\s*"), lambda s: s != "")
    repeated = F.exists(F.array_distinct(lines), lambda s: F.size(F.filter(lines, lambda x: x == s)) > most)
    return repeated | F.lower(column).rlike(r"(?:^|\s)(\S+)(?:\s+\1){" + str(most) + r"}(?:\s|$)")


def plural(count: Column | str, one: str, few: str, many: str) -> Column:
    """The Russian form of a noun beside a count."""
    count = F.col(count) if isinstance(count, str) else count
    tens, ones = F.pmod(count, F.lit(100)), F.pmod(count, F.lit(10))
    return F.when(tens.between(11, 14), many).when(ones == 1, one).when(ones.between(2, 4), few).otherwise(many)


def ngrams(df: DataFrame, keys: list[str], position: str, word: str, longest: int = 4) -> DataFrame:
    """keys, start, size, gram: runs of up to ``longest`` tokens inside each segment given by ``keys``."""
    order = Window.partitionBy(*keys).orderBy(position)
    ahead = [F.col(word), *[F.lead(word, i).over(order) for i in range(1, longest)]]
    spans = F.array(*[F.struct(F.lit(n).alias("size"), F.concat(ahead[0], *[part for a in ahead[1:n] for part in (F.lit(" "), a)]).alias("gram")) for n in range(1, longest + 1)])
    rows = df.select(*keys, F.col(position).alias("start"), spans.alias("__s"))
    return rows.select(*keys, "start", F.inline("__s")).where("gram is not null")


def segment_number(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "segment") -> DataFrame:
    """Numbers segments from 0 in each partition: a new one begins where ``breaks`` (of the row and the one before) is true."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(window))


def outermost(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans that lie strictly inside no other of the same keys; equal spans stay."""
    order = Window.partitionBy(*keys).orderBy(start, F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    # everything before begins no later: it covers the span if it reaches as far and isn't equal
    reach = F.max(F.struct(F.col(end).alias("e"), (-F.col(start)).alias("s"))).over(order)
    return spans.withColumn("__r", reach).where(F.col("__r").isNull() | (F.col("__r.e") < F.col(end)) | ((F.col("__r.e") == F.col(end)) & (-F.col("__r.s") == F.col(start)))).drop("__r")


def greedy_phrases(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases chosen greedily without overlap: longer spans, more exact words, longer phrases, earlier starts first.

    ``spans`` has keys, start, end (inclusive), exact, text. The spans of one text are folded in a single expression.
    """
    entry = F.struct((F.col("start") - F.col("end")).alias("a"), (-F.col("exact")).alias("b"), (-F.length("text")).alias("c"), "start", "end", "text")
    zero = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")
    grouped = spans.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long"), "exact": F.col("exact").cast("int")}).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    take = lambda chosen, x: F.when(F.exists(chosen, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"])), chosen).otherwise(F.array_append(chosen, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))))
    return grouped.select(*keys, F.inline(F.aggregate("s", zero, take)))


def cluster_unmatched(df: DataFrame, group: str, order: str, word: str) -> DataFrame:
    """(group, order, word, lead): each word with the first earlier lead within one edit, else itself; in order of rows.

    A group is the unmatched words of one photo; they are folded in a single expression.
    """
    grouped = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, word))).alias("w"))
    zero = F.array().cast(f"array<struct<{order}:{df.schema[order].dataType.simpleString()},{word}:string,lead:string>>")
    near = lambda done, x: F.coalesce(F.try_element_at(F.transform(F.filter(done, lambda y: (y["lead"] == y[word]) & (F.levenshtein(y["lead"], x[word], 1) >= 0)), lambda y: y["lead"]), F.lit(1)), x[word])
    folded = F.aggregate("w", zero, lambda done, x: F.array_append(done, F.struct(x[order].alias(order), x[word].alias(word), near(done, x).alias("lead"))))
    return grouped.select(group, F.inline(folded))


def reading_order(df: DataFrame, group: str, key: str, box: str) -> DataFrame:
    """(group, key, row, place): boxed lines by rows, then from left to right; lines without a box last, by key.

    A line belongs to the row before if its centre is within half the median height of the row's running mean centre.
    The lines of one reading are handed to one Arrow batch function.
    """
    fields = T.StructType([df.schema[group], df.schema[key], T.StructField("row", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def arrange(frame: pd.DataFrame) -> pd.DataFrame:
        boxed = frame.dropna(subset=["y0", "y1"]).assign(c=lambda f: (f.y0 + f.y1) / 2, h=lambda f: f.y1 - f.y0).sort_values(["c", "x0", key])
        half = boxed.h.median() / 2 if len(boxed) else 0.0
        rows, mean, n = [], 0.0, 0
        for c in boxed.c:
            if n and abs(c - mean) <= half:
                n += 1
                mean += (c - mean) / n
                rows.append(rows[-1])
            else:
                rows.append(rows[-1] + 1 if rows else 0)
                mean, n = c, 1
        boxed = boxed.assign(row=rows).sort_values(["row", "x0", key])
        rest = frame[~frame.index.isin(boxed.index)].sort_values(key).assign(row=-1)
        out = pd.concat([boxed, rest])
        return out.assign(place=range(len(out)))[[group, key, "row", "place"]]

    flat = df.where(F.col(group).isNotNull()).select(group, key, F.col(f"{box}.x0").alias("x0"), F.col(f"{box}.y0").alias("y0"), F.col(f"{box}.y1").alias("y1"))
    return flat.groupBy(group).applyInPandas(arrange, fields)

