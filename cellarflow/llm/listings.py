"""Listings of different sellers that describe one product, grouped by a dictionary mined from trusted listings.

A listing is trusted if its producer column is filled and its name quotes the product. Their brand and model phrases,
in one phonetic spelling, make the dictionary; an Aho-Corasick automaton finds the phrases in every name, and of the
matches the longest that agrees with the known brand counts. Rare spellings near a frequent one of the same brand are
slips of it. Listings with one brand, model and equal variant attributes (colour, sugar, vintage, size) are one group.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellarflow.llm.looks import look_column
from cellarflow.llm.names import GRAPES, letter_pairs, similar_sets, sounds
from cellarflow.operators.skew import salted_join, salted_lookup
from cellarflow.session import Scratch

BLOCK_PHRASES = 200_000  # dictionary entries in one automaton
CHUNK_LISTINGS = 10_000  # listings that one automaton is built for
LEAST_PARTNERS = 7  # words beside which a word stands time and again if it is a general part of names,
PARTNER_SHARE = 0.002  # each in so large a share of its rows, and in two of them;
WORD_SHARE = 0.001  # it has to be in so large a share of all rows, so there are at most (words of a name / WORD_SHARE) such words
GENERAL_BRANDS = 0.03  # a word that stands outside quotes beside so large a share of the brands is a general one
PHRASE_JACCARD = 0.35

# The same attribute in the words of different sellers.
COLOURS = {
    "red": "красное красн кр red rouge rosso", "white": "белое бел white blanc bianco", "rose": "розовое роз rose rosé rosato", "orange": "оранжевое оранж orange amber",
}
SUGARS = {
    "extra_brut": "экстра брют|экстрабрют|extra brut|brut nature", "brut": "брют|brut", "off_dry": "полусухое|полусух|п сух|п сухое|semi dry|off dry|demi sec|polusuhoe",
    "semi_sweet": "полусладкое|полуслад|п сл|п слад|п сладкое|semi sweet|polusladkoe", "dry": "сухое вино|сухое|сух|dry|secco|sec|suhoe", "sweet": "сладкое|слад|sweet|dolce|doux|sladkoe",
}
SUGAR_CODES = {"extra_brut": "extra_brut", "brut": "brut", "polusuhoe": "off_dry", "polusladkoe": "semi_sweet", "suhoe": "dry", "sladkoe": "sweet"}
# General nouns and legal forms; what else is general in producers and names is mined.
ESTATE_WORDS = "винодельня winery дом хутор усадьба погреба шато château поместье ооо ао зао тм domaine домен estate cellars вина wines"
GENERAL_WORDS = "вино wine vin vino игристое тихое sparkling bottle бутылка г год урожай vintage алк алкоголь vol alc abv сорт grape"

_QUOTED = re.compile(r"«([^«»]+)»|\"([^\"]+)\"|“([^“”]+)”")
_VOLUME = re.compile(r"(?<![\d.,])(\d+(?:[.,]\d+)?)\s*(мл|ml|сл|cl|л|l)(?![^\W_])", re.I)
_PERCENT = re.compile(r"-?\d+(?:[.,]\d+)?\s*%")
_YEAR = re.compile(r"(?<![\d.,])((?:19|20)\d\d)(?![\d%])")
_SHORT_YEAR = re.compile(r"(?<![^\W_])['’](\d\d)(?!\d)")
_WORDS = re.compile(r"[^\W_]+")
_SIZES = {"мл": 1, "ml": 1, "сл": 10, "cl": 10, "л": 1000, "l": 1000}


class _Sounds(dict):
    """Phonetic spellings of words as they are written, each worked out once."""

    def __missing__(self, word: str) -> str:
        read = sounds(look_column(pa.array([word])).to_pylist()[0])
        cyrillic = any("Ѐ" <= x < "Ԁ" for x in word)
        self[word] = sound = (read[0] if cyrillic else read[-1]) if read else ""
        return sound


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter is wrong, missing or too many, or two neighbours changed places."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return a == b
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class Reader:
    """Takes listings apart: attributes by patterns and word lists, the other words in phonetic spelling."""

    def __init__(self, estate: Iterable[str] = ()) -> None:
        self.sound = _Sounds()
        said = lambda text: tuple(s for s in (self.sound[w] for w in _WORDS.findall(text)) if s)
        self.colours = {said(w): c for c, ws in COLOURS.items() for w in ws.split()}
        self.sugars = {said(w): c for c, ws in SUGARS.items() for w in ws.split("|")}
        self.grapes = {said(x) for pair in GRAPES.items() for x in pair}
        self.estate = {self.sound[w] for w in ESTATE_WORDS.split()} | set(estate)
        self.longest = max(map(len, [*self.sugars, *self.grapes]))

    def words(self, text: str | None) -> list[str]:
        return [s for s in (self.sound[w] for w in _WORDS.findall(unicodedata.normalize("NFKC", text or ""))) if s]

    def cut(self, words: list[str]) -> tuple[list[str], str | None, str | None]:
        """The words without grapes, colours and sugars, which are returned beside them; longest phrases first."""
        rest, colour, sugar, i = [], None, None, 0
        while i < len(words):
            for size in range(min(self.longest, len(words) - i), 0, -1):
                phrase = tuple(words[i : i + size])
                if phrase in self.grapes or phrase in self.sugars or phrase in self.colours:
                    sugar, colour = sugar or self.sugars.get(phrase), colour or self.colours.get(phrase)
                    i += size
                    break
            else:
                rest.append(words[i])
                i += 1
        return rest, colour, sugar

    def read(self, name: str | None, winery: str | None, sugar: str | None, sugar_class: str | None, category: str | None) -> tuple:
        name = unicodedata.normalize("NFKC", name or "")
        volumes = {round(float(n.replace(",", ".")) * _SIZES[u.lower()]) for n, u in _VOLUME.findall(name)}
        bare = _PERCENT.sub(" ", _VOLUME.sub(" ", name))
        years = [int(y) for y in _YEAR.findall(bare)] or [2000 + int(y) for y in _SHORT_YEAR.findall(bare)]
        bare = _SHORT_YEAR.sub(" ", _YEAR.sub(" ", bare))
        brand = [w for w in self.words(winery) if w not in self.estate]
        if len(brand) > 1:
            brand = [w for w in brand if len(w) < 3 or not any(_one_slip(w, e) for e in self.estate if len(e) > 2)] or brand
        quoted: list[str] = []
        for groups in _QUOTED.findall(bare):  # a producer may be quoted too
            phrase = [w for w in self.words("".join(groups)) if w not in self.estate]
            if phrase and phrase != brand and not quoted:
                quoted = phrase
        rest, colour, own_sugar = self.cut(self.words(bare))
        sweet = SUGAR_CODES.get((sugar_class or "").strip().lower()) or self.cut(self.words(sugar))[2] or own_sugar
        return brand, rest, quoted, self.cut(self.words(category))[1] or colour, sweet, years[0] if years else None, min(volumes) if volumes else None


_READ = "brand array<string>, words array<string>, quoted array<string>, colour string, sugar string, vintage int, volume int"


def mined_words(rows: DataFrame) -> list[str]:
    """Words that stand beside many others in (words array<string>, n): general parts of names such as Old or Reserve.

    A name proper has few partners that recur, however often it occurs itself and however its partners are misspelt.
    """
    words = rows.select(F.array_distinct("words").alias("ws"), "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    single = words.select(F.explode("ws").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("of")).where(F.col("of") >= WORD_SHARE * total)
    pairs = words.where(F.size("ws") > 1).select(F.explode("ws").alias("w"), "ws", "n").select("w", F.explode("ws").alias("beside"), "n").where("w <> beside").groupBy("w", "beside").agg(F.sum("n").alias("both"))
    often = pairs.join(single, "w").where((F.col("both") >= 2) & (F.col("both") >= PARTNER_SHARE * F.col("of")))
    return sorted(r.w for r in often.groupBy("w").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_PARTNERS).select("w").collect())


def estate_words(df: DataFrame) -> list[str]:
    """The mined general words of producers."""
    producers = df.where("winery is not null").groupBy("winery").agg(F.count("*").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader.words(w) for w in batch.column(0).to_pylist()], pa.list_(pa.string())), batch.column(1)], ["words", "n"])

    return mined_words(producers.mapInArrow(read, "words array<string>, n long"))


def read_listings(df: DataFrame, estate: Iterable[str] = ()) -> DataFrame:
    """(listing_id, brand, words, quoted, colour, sugar, vintage, volume) of each listing with an id."""
    columns = ["name", "winery", "sugar", "sugar_class", "category"]
    source = df.where("listing_id is not null").select(F.col("listing_id").cast("long").alias("listing_id"), *[F.col(c).cast("string").alias(c) for c in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(estate)
        texts = pa.list_(pa.string())
        kinds = [texts, texts, texts, pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            rows = [reader.read(*row) for row in zip(*[batch.column(i + 1).to_pylist() for i in range(len(columns))])]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["listing_id", *[c.split()[0] for c in _READ.split(", ")]])

    return source.mapInArrow(read, f"listing_id long, {_READ}")


def _near(a: Column, b: Column) -> Column:
    """Whether one spelling is a slip of the other."""
    allowed = F.when(F.greatest(F.length(a), F.length(b)) < 8, 1).otherwise(2)
    counted = lambda side, i: F.length(side) - F.length(F.replace(side, F.char(i)))
    letters = F.aggregate(F.sequence(F.lit(97), F.lit(122)), F.lit(0), lambda total, i: total + F.abs(counted(a, i) - counted(b, i)))
    off = F.levenshtein(a, b)
    return (off <= allowed) | ((off == allowed + 1) & (letters <= allowed - 1))


def spelled_alike(counts: DataFrame, group: str, phrase: str) -> DataFrame:
    """(group, phrase, best): rare phrases of a group with the frequent one nearby that they are a slip of.

    ``counts`` has (group, phrase, n). A phrase is a slip of one that more listings have (or as many, and that comes
    first) and that is within a slip for five to seven letters, two for more; two letters that changed places are one.
    Only slips are returned.
    """
    tokens = F.transform(letter_pairs(phrase), lambda t: F.concat(F.col(group), F.lit("\t"), t))
    named = F.concat(F.col(group), F.lit("\t"), F.col(phrase))
    rows = counts.where(F.length(phrase) >= 5).select(named.alias("l"), named.alias("r"), tokens.alias("tokens"))
    near = similar_sets(rows.select("l", "tokens"), rows.select("r", "tokens"), PHRASE_JACCARD).where("l <> r")
    part = lambda c, i: F.split_part(c, F.lit("\t"), F.lit(i))
    near = near.select(part(F.col("l"), 1).alias(group), part(F.col("l"), 2).alias(phrase), part(F.col("r"), 2).alias("best"))
    close = near.where(_near(F.col(phrase), F.col("best")))
    n = counts.select(group, F.col(phrase), "n")
    more = close.join(n, [group, phrase]).join(n.select(group, F.col(phrase).alias("best"), F.col("n").alias("m")), [group, "best"]).where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("best") < F.col(phrase))))
    first = Window.partitionBy(group, phrase).orderBy(F.col("m").desc(), "best")
    return more.withColumn("k", F.row_number().over(first)).where("k = 1").select(group, phrase, "best")


def settled(slips: DataFrame, group: str, phrase: str, scratch: Scratch, name: str) -> DataFrame:
    """``slips`` with the end of each chain: a slip of a slip of a phrase is one of the phrase itself.

    Chains have no circles, as each step goes to a more frequent phrase or to one that comes first; each round halves
    them, until none is left.
    """
    step = 0
    slips = scratch.save(slips, f"{name}-0")
    while True:
        beyond = slips.select(group, F.col(phrase).alias("best"), F.col("best").alias("end"))
        if slips.join(beyond, [group, "best"], "left_semi").isEmpty():
            return slips
        step += 1
        slips = scratch.save(slips.join(beyond, [group, "best"], "left").select(group, phrase, F.coalesce("end", "best").alias("best")), f"{name}-{step}")


def _corrected(df: DataFrame, slips: DataFrame, group: str, phrase: str) -> DataFrame:
    """``phrase`` of each row replaced by what it is a slip of."""
    return salted_lookup(df.withColumn("__k", F.struct(group, phrase)), slips.select(F.struct(group, phrase).alias("__k"), "best"), "__k", "listing_id").withColumn(phrase, F.coalesce("best", phrase)).drop("best", "__k")


def _find_phrases(listings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(listing_id, found_brand, found_model) of listings in whose words phrases of the dictionary (brand, model) stand.

    Of several the longest that agrees with the listing's brand, or with a brand that is found in its words; without
    either the longest of all, and its brand if it has only one. The dictionary is cut by the hash of the brand into
    blocks of about BLOCK_PHRASES entries; a listing of known brand only meets its block, others meet all, and what the
    blocks found is put together by listing, so the result doesn't depend on the blocks. Listings go in chunks, each with
    the block's dictionary; nothing of either passes through the driver.
    """
    blocks = max(1, math.ceil(dictionary.count() / BLOCK_PHRASES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    rows = listings.select("listing_id", "brand", "words", F.explode(F.when(F.col("brand").isNotNull(), F.array(block("brand"))).otherwise(F.sequence(F.lit(0), F.lit(blocks - 1)))).alias("block"))
    cuts = rows.groupBy("block").agg(F.ceil(F.count("*") / CHUNK_LISTINGS).cast("int").alias("n"))
    entries = dictionary.withColumn("block", block("brand")).join(cuts, "block").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("brand", "model", "block", "cut")
    cuts = cuts.select(F.col("block").alias("__block"), "n")
    rows = rows.join(cuts, F.col("block") == F.col("__block")).select("listing_id", "brand", "words", F.col("block").alias("in_block"), F.pmod(F.xxhash64("listing_id"), F.col("n")).cast("int").alias("in_cut"))
    names = ["listing_id", "brand", "pair_model", "pair_brand", "model", "n_owners", "owner"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    longest = lambda found: max(found, key=lambda x: (len(x), x), default=None)

    def find(listings: pa.Table, dictionary: pa.Table) -> pa.Table:
        automaton, owners = ahocorasick.Automaton(), {}
        for brand, model in zip(dictionary.column("brand").to_pylist(), dictionary.column("model").to_pylist()):
            owners.setdefault(model, set()).add(brand)
        models, brands = set(owners), {b for own in owners.values() for b in own if b}
        for phrase in models | brands:
            automaton.add_word(phrase, phrase)
        out = []
        if owners:
            automaton.make_automaton()
            for listing, brand, words in zip(*[listings.column(c).to_pylist() for c in ("listing_id", "brand", "words")]):
                # phrases are written without spaces, and stand where words begin and end
                ends = set(accumulate(map(len, words or []), initial=0))
                hits = {hit for end, hit in automaton.iter("".join(words or [])) if end + 1 in ends and end + 1 - len(hit) in ends}
                own = {brand} if brand else hits & brands
                pairs = max(((len(m), m, len(b), b) for m in hits & models for b in owners[m] & own), default=None)
                model = longest(hits & models) if not brand else None
                if pairs or own or model:
                    out.append((listing, longest(own), pairs[1] if pairs else None, pairs[3] if pairs else None, model, len(owners[model]) if model else None, min(owners[model]) if model else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    found = rows.groupBy("in_block", "in_cut").cogroup(entries.groupBy("block", "cut")).applyInArrow(find, "listing_id long, brand string, pair_model string, pair_brand string, model string, n_owners int, owner string")
    by_length = lambda *cs: F.max(F.when(F.col(cs[0]).isNotNull(), F.struct(*[x for i, c in enumerate(cs) for x in (F.length(c).alias(f"n{i}"), F.col(c).alias(c))])))
    models = F.filter(F.collect_list(F.struct("model", "n_owners", "owner")), lambda x: x["model"].isNotNull())
    whole = found.groupBy("listing_id").agg(by_length("brand").alias("b"), by_length("pair_model", "pair_brand").alias("p"), by_length("model").alias("m"), models.alias("all"))
    owned = F.filter("all", lambda x: x["model"] == F.col("m.model"))
    sole = F.when(F.aggregate(owned, F.lit(0), lambda t, x: t + x["n_owners"]) == 1, F.nullif(owned[0]["owner"], F.lit("")))
    brand = F.when(F.col("p").isNotNull(), F.col("p.pair_brand")).when(F.col("b").isNotNull(), F.col("b.brand")).otherwise(sole)
    return whole.select("listing_id", brand.alias("found_brand"), F.when(F.col("b").isNotNull(), F.col("p.pair_model")).otherwise(F.col("m.model")).alias("found_model"))


def product_groups(df: DataFrame) -> DataFrame:
    """(listing_id, group_id, brand, model, colour, sugar, vintage, volume): each listing with its group's smallest id.

    A listing sent again under another id is a listing of its own; repeated rows of one id count once. What a listing
    says nowhere is null and equals only null, except that a listing without brand and model is in a group of its
    own. Null names and empty tables are fine; columns other than those read are dropped.
    """
    scratch = Scratch(df.sparkSession, "listings")
    estate = estate_words(df)
    reader = Reader(estate)
    read = scratch.save(read_listings(df, estate).dropDuplicates(["listing_id"]), "read")
    # second words: they follow many names inside quotes
    seconds = set(mined_words(read.select(F.col("quoted").alias("words"), F.lit(1).alias("n")))) - reader.estate
    # brands: spellings of the producer column, slips put right
    branded = read.withColumn("brand", F.nullif(F.array_join("brand", ""), F.lit(""))).withColumn("all", F.lit("-"))
    brands = branded.where("brand is not null").groupBy("all", "brand").agg(F.count("*").alias("n"))
    branded = scratch.save(_corrected(branded, settled(spelled_alike(scratch.save(brands, "brands"), "all", "brand"), "all", "brand", scratch, "brand-slips"), "all", "brand").drop("all"), "branded")
    # general words: outside quotes beside many brands
    n_brands = branded.select("brand").distinct().count()
    general = branded.where("brand is not null").select("brand", F.explode(F.array_except("words", F.coalesce("quoted", F.array()))).alias("w")).distinct().groupBy("w").agg(F.count("*").alias("n"))
    general = general.where((F.col("n") >= max(6, GENERAL_BRANDS * n_brands)) & ~F.col("w").isin(*sorted(seconds)))
    general_words = sorted({r.w for r in general.collect()} | {reader.sound[w] for w in GENERAL_WORDS.split()} | reader.estate)
    dropped = F.array(*[F.lit(w) for w in general_words])

    # the core of a phrase and its second word; a second word may be misspelt
    near = lambda w: F.coalesce(F.lit(None).cast("string"), *[F.when(F.levenshtein(w, F.lit(s)) <= (1 if len(s) < 6 else 2), F.lit(s)) for s in sorted(seconds)])
    plain = F.filter("words", lambda w: ~F.array_contains(dropped, w) & (F.col("brand").isNull() | ~_near(w, F.col("brand"))))
    second_of = lambda words: F.try_element_at(F.filter(F.transform(words, near), lambda w: w.isNotNull()), F.lit(1))
    core_of = lambda words: F.array_join(F.filter(words, lambda w: near(w).isNull()), "")
    quoted = F.filter("quoted", lambda w: ~F.array_contains(dropped, w))
    # a producer that only the name has, slips included
    unknown = branded.where("brand is null").select("listing_id", F.explode(F.array_distinct(F.filter("words", lambda w: ~F.array_contains(dropped, w)))).alias("l")).where(F.length("l") >= 4)
    known = branded.where("brand is not null").groupBy(F.col("brand").alias("r")).agg(F.count("*").alias("n"))
    pairs = similar_sets(unknown.select("l").distinct().withColumn("tokens", letter_pairs("l")), known.select("r").withColumn("tokens", letter_pairs("r")), PHRASE_JACCARD)
    named = unknown.join(pairs.where((F.col("l") == F.col("r")) | ((F.length("l") > 4) & _near(F.col("l"), F.col("r")))), "l").join(known, "r")
    first = Window.partitionBy("listing_id").orderBy(F.levenshtein("l", "r"), F.col("n").desc(), "r")
    named = named.withColumn("k", F.row_number().over(first)).where("k = 1").select("listing_id", F.col("r").alias("in_name"))
    branded = scratch.save(branded.join(named, "listing_id", "left").withColumn("brand", F.coalesce("brand", "in_name")).drop("in_name"), "found")
    worded = branded.select("listing_id", "brand", "words", "colour", "sugar", "vintage", "volume", quoted.alias("quoted"), plain.alias("plain")).withColumn("is_quoted", core_of("quoted") != "")
    worded = scratch.save(worded.withColumn("core", F.nullif(F.when(F.col("is_quoted"), core_of("quoted")).otherwise(core_of("plain")), F.lit(""))).withColumn("second", F.coalesce(second_of("words"), F.lit(""))), "worded")
    # a quoted producer is no product
    trusted = worded.where("brand is not null and is_quoted").where(~_near(F.col("core"), F.col("brand"))).groupBy("brand", F.col("core").alias("model")).agg(F.count("*").alias("n"))
    trusted = scratch.save(trusted, "trusted")
    # the dictionary has slips too; what is found by one is put right at the end, with all other slips
    found = _find_phrases(worded.select("listing_id", "brand", "words"), trusted.select("brand", "model"))
    joined = worded.join(found, "listing_id", "left").withColumn("model", F.coalesce("found_model", "core")).withColumn("brand", F.coalesce("brand", "found_brand"))
    # without the brand's words where the brand was only found in the name
    left_over = F.filter("plain", lambda w: ~_near(w, F.col("brand")))
    joined = joined.withColumn("model", F.when(F.col("found_model").isNull() & ~F.col("is_quoted") & F.col("found_brand").isNotNull(), F.nullif(core_of(left_over), F.lit(""))).otherwise(F.col("model")))
    named = scratch.save(joined.select("listing_id", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("model", F.lit("")).alias("model"), "second", "colour", "sugar", "vintage", "volume"), "named")
    counts = scratch.save(named.where("model <> ''").groupBy("brand", "model").agg(F.count("*").alias("n")), "counts")
    final = _corrected(named, settled(spelled_alike(counts, "brand", "model"), "brand", "model", scratch, "final-slips"), "brand", "model")
    alone = F.when((F.col("brand") == "") & (F.col("model") == ""), F.col("listing_id"))
    key = F.struct("brand", "model", "second", "colour", "sugar", "vintage", "volume", alone.alias("alone"))
    keyed = scratch.save(final.withColumn("key", F.sha2(F.to_json(key), 256)), "keyed")
    leads = keyed.groupBy("key").agg(F.min("listing_id").alias("group_id"))
    model = F.concat_ws(" ", F.nullif("model", F.lit("")), F.nullif("second", F.lit("")))
    return keyed.join(leads, "key").select("listing_id", "group_id", "brand", model.alias("model"), "colour", "sugar", "vintage", "volume")


def product_pairs(groups: DataFrame) -> DataFrame:
    """(listing_id_a, listing_id_b): the pairs of listings within each group, hot groups cut into parts."""
    a = groups.select("group_id", F.col("listing_id").alias("listing_id_a"))
    b = groups.select("group_id", F.col("listing_id").alias("listing_id_b"))
    return salted_join(a, b, "group_id", "listing_id_a").where("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
