"""Queries of text functions and dictionary joins, on tokens, lines, documents and the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.operators import lexicon as L
from cellarflow.operators import phrases as R
from cellarflow.operators import text as X
from cellarflow.sources.tables import table


def _tokens(spark, d):
    return table(spark, d, "token_spans").select("token_id", "line_id", "pos_no", "query_id", "reading_key", "text", "norm", "skeleton", "kind", "conf")


def _entries(spark, d):
    return table(spark, d, "lex_entries")


def ag11_idf(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.split(X.ascii_norm("lang"), " ").alias("w"))
    return L.document_frequencies(docs, "doc_id", "w")


def ag12_word_frequency(spark, d):
    rows = table(spark, d, "catalog_positions").where("winery is not null").select("winery", F.split(F.lower("winery"), " ").alias("w"))
    return L.document_frequencies(rows, "winery", "w").select("word", "df")


def ag13_canonical(spark, d):
    rows = _tokens(spark, d).where("skeleton is not null and norm is not null").select("skeleton", "norm", "line_id")
    return L.elect_canonical(rows, "skeleton", "norm", "line_id").select("skeleton", "canonical", "n", F.round("share", 6).alias("share"))


def ag14_inverted_index(spark, d):
    rows = table(spark, d, "catalog_positions").where("winery is not null").select("slug", F.split(F.lower("winery"), " ").alias("w"))
    return L.inverted_index(rows, "slug", "w").select("word", F.size("keys").alias("n"), F.array_join("keys", ",").alias("slugs"))


def ag15_votes(spark, d):
    hits = _tokens(spark, d).where("norm is not null").join(_entries(spark, d).where("not is_part").select("norm", "lex_field", "entry_id"), "norm")
    return hits.groupBy("query_id", "lex_field", "entry_id").agg(F.countDistinct("reading_key").alias("support"), F.min("pos_no").alias("first_pos"), F.max("conf").alias("conf"), F.bool_or(F.col("kind") == "word").alias("strong"))


def ag16_single_value(spark, d):
    years = _tokens(spark, d).where("kind = 'year'").select("query_id", "reading_key", F.col("text").alias("value")).where("value rlike '^[0-9]{4}$'").distinct()
    reading = years.groupBy("query_id", "reading_key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    from pyspark.sql import Window

    first = Window.partitionBy("query_id").orderBy("reading_key")
    kept = reading.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.select("query_id", F.when(F.col("n") == 1, F.col("value")).alias("value"))


def ag17_support(spark, d):
    return L.fuse_support(_tokens(spark, d).where("kind = 'word'"), "query_id", "reading_key", "norm")


def jn03_inverted_join(spark, d):
    index = table(spark, d, "catalog_positions").where("winery is not null").select("slug", F.explode(F.array_distinct(F.split(F.lower("winery"), " "))).alias("norm"))
    return _tokens(spark, d).where("norm is not null").join(index, "norm").groupBy("token_id").agg(F.count("*").alias("n"), F.min("slug").alias("first_slug"))


def jn05_exact_join(spark, d):
    return _tokens(spark, d).join(_entries(spark, d).select("entry_id", "lex_field", "norm"), "norm").select("token_id", "entry_id", "lex_field")


def jn06_skeleton_join(spark, d):
    hits = L.exact_hits(_tokens(spark, d).select("token_id", "norm", "skeleton"), _entries(spark, d).select("entry_id", "norm", "skeleton"))
    return hits.select("token_id", "entry_id", "cost")


def jn07_fuzzy_join(spark, d):
    words = _tokens(spark, d).where("norm is not null and kind = 'word'").select(F.col("norm").alias("word"))
    return L.fuzzy_hits(words, _entries(spark, d).select("norm").distinct())


def jn07_weighted_join(spark, d):
    """The fuzzy join by weighted edits: plain edits choose candidates, the weighted budget decides."""
    words = _tokens(spark, d).where("norm is not null and kind = 'word'").select(F.col("norm").alias("word"))
    return L.fuzzy_hits(words, _entries(spark, d).select("norm").distinct(), weighted=True).withColumn("cost", F.round("cost", 6))


def jn08_phrases(spark, d):
    phrases = _entries(spark, d).where("not is_part").select("entry_id", F.split("norm", " ").alias("words"))
    return L.phrase_hits(_tokens(spark, d).where("norm is not null"), phrases, "line_id", "pos_no", "norm", ["и", "de", "du", "the", "вино", "wine"])


def so09_best_hits(spark, d):
    hits = L.exact_hits(_tokens(spark, d).select("token_id", "norm", "skeleton"), _entries(spark, d).select("entry_id", "lex_field", "canonical", "idf", "norm", "skeleton"))
    return L.best_hits(hits, ["token_id"]).select("token_id", "entry_id", "cost", "rank")


def st03_unmatched(spark, d):
    tokens = _tokens(spark, d).where("norm is not null")
    hits = tokens.join(_entries(spark, d).select("norm").distinct(), "norm", "left_semi")
    return L.unmatched(tokens, hits, ["token_id"], "norm", ["вино", "wine", "урожай"]).select("token_id", "norm")


def wn09_ngrams(spark, d):
    return X.ngrams(_tokens(spark, d), ["line_id"], "pos_no", "norm")


def wn10_segments(spark, d):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("gap", (F.col("event_type") != kind) | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > 3_600_000_000))
    return X.segment_number(rows, ["user_id"], ["ts", "event_id"], F.col("gap")).select("event_id", "user_id", "segment")


def wn11_anchor(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("line_id").orderBy("pos_no")
    number = lambda c: c.isin("year", "number", "abv", "ratio")
    anchor = lambda w: F.when(w.isin("урожай", "vintage", "год", "г"), "vintage").when(w.isin("гост", "партия", "no"), "not")
    left = [(anchor(F.lag("norm", i).over(order)), number(F.lag("kind", i).over(order))) for i in (1, 2, 3)]
    right = [(anchor(F.lead("norm", i).over(order)), number(F.lead("kind", i).over(order))) for i in (1, 2)]

    def nearest(side):
        found, open_ = F.lit(None).cast("string"), F.lit(True)
        for name, stop in side:
            found = F.when(found.isNull() & open_ & name.isNotNull(), name).otherwise(found)
            open_ = open_ & ~F.coalesce(stop, F.lit(False))
        return found

    a, b = nearest(left), nearest(right)
    rows = _tokens(spark, d).withColumn("anchor", F.when((a == "not") | (b == "not"), "not").otherwise(F.coalesce(a, b)))
    return rows.where("kind = 'year'").select("token_id", "anchor")


def wn12_negation(spark, d):
    """Of every word how often it is negated: by one of the two words before it, or refused within four words after it; clauses bound both."""
    # all of a clause is in one row: nothing is shuffled but the counts of words
    clauses = F.flatten(F.transform(X.sentences("text"), lambda s: F.split(s, "[,.;:!?—]+")))
    rows = table(spark, d, "documents").where("text is not null").select(F.explode(clauses).alias("s")).select(X.words_of(F.lower("s")).alias("ws"))
    refused = lambda w, i: w.isin("нет", "нету", "кончился", "кончилась", "закончился") | ((w == "не") & F.coalesce(F.try_element_at("ws", (i + 2).cast("int")) == "будет", F.lit(False)))
    rows = rows.select("ws", F.transform("ws", lambda w: w.isin("не", "без", "no", "not", "without")).alias("before"), F.transform("ws", refused).alias("after"))
    near = lambda i: F.exists(F.slice("before", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), lambda x: x) | F.exists(F.slice("after", i + 2, F.lit(4)), lambda x: x)
    words = rows.select(F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("w"), near(i).alias("negated")))).alias("x")).select("x.*")
    return words.groupBy("w").agg(F.count("*").alias("n"), F.count_if("negated").alias("negated"))


def wn15_outermost(spark, d):
    grams = X.ngrams(_tokens(spark, d), ["line_id"], "pos_no", "norm", 3)
    hits = grams.join(_entries(spark, d).select(F.col("norm").alias("gram")).distinct(), "gram").select("line_id", "start", (F.col("start") + F.col("size") - 1).alias("end"), "gram")
    return X.outermost(hits, ["line_id"])


def wn16_greedy_phrases(spark, d):
    grams = X.ngrams(_tokens(spark, d), ["line_id"], "pos_no", "norm", 3)
    hits = grams.join(_entries(spark, d).select(F.col("norm").alias("gram")).distinct(), "gram").select("line_id", "start", (F.col("start") + F.col("size") - 1).alias("end"), F.col("size").alias("exact"), F.col("gram").alias("text"))
    return X.greedy_phrases(hits, ["line_id"])


def wn17_clusters(spark, d):
    tokens = _tokens(spark, d).where("norm is not null and kind = 'word'")
    rest = L.unmatched(tokens, tokens.join(_entries(spark, d).select("norm").distinct(), "norm", "left_semi"), ["token_id"], "norm", [])
    return X.cluster_unmatched(rest, "query_id", "token_id", "norm")


def so10_reading_order(spark, d):
    lines = table(spark, d, "text_lines").select("reading_key", "line_id", "box").dropDuplicates(["line_id"])
    return X.reading_order(lines, "reading_key", "line_id", "box")


def tx01_label_norm(spark, d):
    return X.by_distinct(table(spark, d, "text_lines").select("line_id", "text"), "text", "norm", X.label_norm_text, T.StringType()).select("line_id", "norm")


def tx02_metric_norm(spark, d):
    return table(spark, d, "catalog_positions").select("slug", X.ascii_norm("slug").alias("norm"))


def tx03_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.clean_question("text")).alias("n"))


def tx04_homoglyphs(spark, d):
    return _tokens(spark, d).select("token_id", X.fold_homoglyphs("text").alias("folded"))


def tx05_roman(spark, d):
    return _tokens(spark, d).select("token_id", "text", X.roman_value("text").alias("value")).where("value is not null")


def tx06_tokens(spark, d):
    return table(spark, d, "catalog_positions").select("slug", F.posexplode(X.tokens_of(F.regexp_replace("slug", "_", "-"))).alias("pos", "token"))


def tx07_merged(spark, d):
    return table(spark, d, "text_lines").select("line_id", X.merge_spaced("text").alias("text"))


def tx08_kinds(spark, d):
    rows = table(spark, d, "text_lines").where("text is not null").select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''")
    return rows.groupBy(X.token_kind("token").alias("kind")).agg(F.count("*").alias("n"))


def tx09_transcribed(spark, d):
    return _tokens(spark, d).where("text rlike '^[A-Za-z]+$'").select("token_id", X.transcribe("text").alias("cyrillic"))


def tx10_romanised(spark, d):
    return _tokens(spark, d).select("token_id", X.romanise("norm").alias("latin"))


def tx11_skeleton(spark, d):
    return _entries(spark, d).select("entry_id", X.skeleton("norm").alias("key"))


def tx12_edits(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.lit("small ring").alias("other"))
    return rows.select("p_partkey", F.levenshtein("p_name", "other").alias("edits"), X.bounded_edits("p_name", "other", 4).alias("bounded"))


def tx13_weighted(spark, d):
    pairs = jn07_fuzzy_join(spark, d)
    return pairs.select("word", "norm", X.weighted_edits("word", "norm").alias("cost")).where("cost <= 2")


def tx14_budget(spark, d):
    return _entries(spark, d).select("entry_id", X.edit_budget(F.length("norm")).alias("budget"))


def tx15_forms(spark, d):
    words = table(spark, d, "documents").where("text is not null").select(F.explode(F.array_distinct(X.words_of(F.lower("text")))).alias("w")).where("length(w) >= 4").distinct()
    return X.form_pairs(words.select(F.col("w").alias("x")), words.select(F.col("w").alias("y"))).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def tx16_bag(spark, d):
    bags = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("bag"))
    return bags.select("p_partkey", X.has_word("bag", F.lit("ring")).alias("exact"), X.has_word("bag", F.lit("rings"), fuzzy=True).alias("fuzzy"))


def tx17_finders(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.array_join(X.all_classes("text", X.SUGAR_PHRASES), ",").alias("sugars"), F.array_join(X.all_classes("text", X.COLOUR_PHRASES), ",").alias("colours"))


def tx19_sugar(spark, d):
    rows = table(spark, d, "catalog_positions")
    last = F.try_element_at(F.regexp_extract_all("slug", F.lit("(ekstra-bryut|bryut|polusukhoe|polusladkoe|sukhoe|sladkoe)"), F.lit(1)), F.lit(-1))
    return rows.select("slug", X.first_class("name", X.SUGAR_PHRASES).alias("by_name"), last.alias("by_slug"))


def tx20_flags(spark, d):
    rows = table(spark, d, "wine_cards")
    name = F.lower("name")
    return rows.select("listing_id", F.coalesce(name.rlike("игрист|sparkling|brut|брют"), F.lit(False)).alias("sparkling"), F.coalesce(name.rlike("слад|sweet|dolce"), F.lit(False)).alias("sweet_name"))


def tx21_filter(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.array_join(X.all_classes("text", X.VIOLATIONS), ",").alias("classes"), F.length(X.sanitise("text")).alias("left_over"))


BARRIER = [
    ("health", 1, "здоров*", False), ("health", 1, "health", False), ("drink", 2, "употребл* ..2 вред*", False), ("drink", 2, "drink responsibly", False), ("label", 3, "этикет*", False),
    ("label", 3, "label", False), ("label", 3, "на этикетке", True), ("label", 3, "the label reads", True), ("health", 1, "чрезмерное употребление ..1 здоровью", True),
]


def document_words(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.words_of(F.lower("text"))).alias("pos", "w"))


def tx22_barrier(spark, d):
    """The refusal of each document: stems, phrases and gapped phrases by rank, less what an excuse covers."""
    hits = R.rule_hits(document_words(spark, d), "doc_id", "pos", "w", R.rule_table(spark, BARRIER))
    return R.barred(hits, "doc_id").withColumnRenamed("topic", "refusal")


def tx23_invented(spark, d):
    rows = table(spark, d, "wine_cards").select("listing_id", X.invented_numbers(F.coalesce("name", F.lit("")), F.coalesce("slug", F.lit(""))).alias("x"))
    return rows.select("listing_id", F.array_join("x", ",").alias("numbers"))


def tx24_guards(spark, d):
    text = F.coalesce(F.trim("text"), F.lit(""))
    checks = [("empty", text == ""), ("length", F.length(text) > 2000), ("numbers", F.lower(text).rlike(r"\d{5,}")), ("markup", text.rlike("<p>")), ("preamble", F.lower(text).rlike(r"^(##|digest|дайджест|заметка)"))]
    return table(spark, d, "documents").select("doc_id", X.first_failing(checks).alias("code"))


def tx25_locked(spark, d):
    known = _entries(spark, d).select(F.explode(F.split("norm", " ")).alias("w")).distinct()
    rows = _tokens(spark, d).where("norm rlike '^[а-яa-z]{5,}$'").select("token_id", F.col("norm").alias("w"))
    return rows.join(known, "w", "left_anti").groupBy("w").agg(F.count("*").alias("n"))


def tx26_lines(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    junk = F.regexp_count("text", F.lit(r"[^0-9A-Za-zА-Яа-яЁё\s.,!?:;«»()\"'-]"))
    return rows.select("doc_id", F.size(X.clean_lines("text")).alias("n_lines"), X.looks_looped("text").alias("looped"), (junk > 0.05 * F.length("text")).alias("garbage"))


def tx27_plurals(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", F.concat_ws(" ", "n", X.plural("n", "вино", "вина", "вин")).alias("said"))


def tx28_template(spark, d):
    rows = table(spark, d, "catalog_positions")
    return rows.select("slug", F.concat_ws("; ", "name", F.concat(F.lit("producer "), F.col("winery")), F.when(F.size("grapes") > 0, F.concat(F.lit("grapes "), F.array_join("grapes", ", "))), F.concat(F.lit("vintage "), F.col("vintage"))).alias("note"))


def tx29_winery(spark, d):
    names = _entries(spark, d).where("lex_field = 'producer' and not is_part").select("entry_id", "norm", F.element_at(F.split("norm", " "), -1).alias("house"))
    words = table(spark, d, "wine_cards").where("winery is not null").select("listing_id", X.ascii_norm("winery").alias("said"))
    by_name = words.join(names, words.said == names.norm).groupBy("listing_id").agg(F.min("entry_id").alias("exact"))
    by_house = words.withColumn("h", F.element_at(F.split("said", " "), -1)).join(names, F.col("h") == F.col("house")).groupBy("listing_id").agg(F.min("entry_id").alias("house_id"))
    return words.join(by_name, "listing_id", "left").join(by_house, "listing_id", "left").select("listing_id", F.coalesce("exact", "house_id").alias("entry_id"), F.when(F.col("exact").isNotNull(), "name").when(F.col("house_id").isNotNull(), "house").alias("how"))


def tx34_name_words(spark, d):
    grape_words = _entries(spark, d).where("lex_field = 'grape'").select(F.explode(F.split("norm", " ")).alias("w")).distinct().agg(F.array_sort(F.collect_list("w")).alias("g"))
    rows = table(spark, d, "catalog_positions").where("name is not null").crossJoin(F.broadcast(grape_words))
    left = F.array_except(F.array_except(F.split(F.translate(F.lower("name"), "ё", "е"), " "), "g"), F.array(*[F.lit(w) for w in ("красное", "белое", "розовое", "оранжевое", "сухое", "полусухое", "сладкое", "полусладкое", "брют", "экстра")]))
    return rows.select("slug", F.array_join(left, " ").alias("words"))


def tx35_read_bag(spark, d):
    rows = _tokens(spark, d).select("token_id", F.when(F.trim("text") != "", F.lower("text")).otherwise(F.col("norm")).alias("w"))
    return rows.where("w is not null").groupBy("w").agg(F.count("*").alias("n"))


def tx36_photo_kind(spark, d):
    rows = table(spark, d, "predictions").where("image_path is not null")
    kind = F.when(F.lower("image_path").rlike("^scan"), "scan").when(F.lower("image_path").rlike("^(img|photo|dsc)"), "photo").otherwise("other")
    return rows.groupBy(kind.alias("kind"), F.lower(F.regexp_extract("image_path", r"\.(\w+)$", 1)).alias("suffix")).agg(F.count("*").alias("n"))


HOUSE = "винодельня|хутор|усадьба|поместье|погреба|дом|шато|domaine|château|winery|estate"


def tx37_house_lines(spark, d):
    """House names in lines: what follows or precedes a word for a house, or the line after one that is only such a word."""
    from pyspark.sql import Window

    order = Window.partitionBy("reading_key").orderBy("line_no", "line_id")
    rows = table(spark, d, "text_lines").withColumn("before", F.lag("text").over(order)).where("text is not null")
    line = F.trim(F.regexp_replace("text", r"[«»\"“”,;|/\s]+", " "))
    after = F.regexp_extract(line, f"(?iu)^(?:{HOUSE}) (\\S.*)$", 1)
    ahead = F.regexp_extract(line, r"(?i)^(\S.*) (?:winery|estate)$", 1)
    only = F.lower(F.trim(F.regexp_replace("before", r"\s+", " "))).rlike(f"^({HOUSE})$")
    house = F.coalesce(F.nullif(after, F.lit("")), F.nullif(ahead, F.lit("")), F.when(only, F.nullif(line, F.lit(""))))
    return rows.select("line_id", house.alias("house")).where("house is not null")


def ma18_hashes(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1(F.encode("text", "utf-8")).alias("sha1"))


def ma19_vintage(spark, d):
    anchored = wn11_anchor(spark, d).join(_tokens(spark, d).select("token_id", "line_id", "text"), "token_id").where("text rlike '^[0-9]{4}$'")
    year = F.col("text").cast("int")
    sound = year.between(1950, 2026) & (F.col("anchor").eqNullSafe("vintage") | (F.col("anchor").isNull() & (year >= 1990)))
    return anchored.where(sound).select("token_id", year.alias("vintage"))


def ma20_strength(spark, d):
    found = F.regexp_extract("text", r"(\d{1,2}(?:[.,]\d)?) ?% ?(?:vol|об)|(?:алк\.?|vol) ?(\d{1,2}(?:[.,]\d)?) ?%", 0)
    value = F.regexp_replace(F.regexp_extract(found, r"(\d{1,2}(?:[.,]\d)?)", 1), ",", ".").try_cast("double")
    rows = table(spark, d, "text_lines").select("line_id", value.alias("abv"))
    return rows.where("abv between 4 and 22")


def ma21_fields(spark, d):
    """Per photo: the names, years and strengths read, one word giving one field (longest phrase first)."""
    lines = table(spark, d, "text_lines").select("line_id", "query_id", "reading_key")
    phrases = wn16_greedy_phrases(spark, d).join(_entries(spark, d).where("not is_part").select(F.col("norm").alias("text"), "lex_field", "canonical"), "text").join(lines, "line_id")
    named = phrases.groupBy("query_id", "lex_field").agg(F.mode("canonical", True).alias("value"), F.countDistinct("reading_key").alias("support"))
    years = ma19_vintage(spark, d).join(_tokens(spark, d).select("token_id", "query_id", "reading_key"), "token_id").groupBy("query_id").agg(F.mode(F.col("vintage").cast("string"), True).alias("value"), F.countDistinct("reading_key").alias("support")).withColumn("lex_field", F.lit("year"))
    strength = ma20_strength(spark, d).join(lines, "line_id").groupBy("query_id").agg(F.mode(F.col("abv").cast("string"), True).alias("value"), F.countDistinct("reading_key").alias("support")).withColumn("lex_field", F.lit("abv"))
    return named.unionByName(years).unionByName(strength)


def tx33_name_parts(spark, d):
    """A card's name taken apart in order: year, volume, colour, sugar; what is left is the cuvée."""
    name = F.regexp_replace(F.coalesce("name", F.lit("")), "[|/,«»\"]", " ")
    year = F.regexp_extract(name, r"\b((?:19|20)\d\d)\b", 1)
    volume = F.regexp_extract(F.lower(name), r"(\d+(?:[.,]\d+)? ?(?:мл|ml|cl|л|l))(?: |$)", 1)
    rest = F.regexp_replace(F.regexp_replace(name, r"\b(?:19|20)\d\d\b", " "), r"(?iu)\d+(?:[.,]\d+)? ?(?:мл|ml|cl|л|l)(?= |$)", " ")
    rest = F.regexp_replace(rest, r"(?iu)(^| )(вино|wine|красное|белое|розовое|оранжевое|red|white|rose|orange|кр\.|бел\.|роз\.|оранж\.)(?= |$)", " ")
    return table(spark, d, "wine_cards").select("listing_id", F.nullif(year, F.lit("")).alias("year"), F.nullif(F.replace(volume, F.lit(" "), F.lit("")), F.lit("")).alias("volume"), X.first_class("name", X.COLOUR_PHRASES).alias("colour"), X.first_class("name", X.SUGAR_PHRASES).alias("sugar"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("rest"))


_TX = {f"tx{n:02d}" for n in range(60)} | {"ag11", "ag12", "ag13", "ag14", "ag15", "ag16", "ag17", "jn03", "jn05", "jn06", "jn07", "jn08", "so09", "so10", "st03", "wn09", "wn10", "wn11", "wn12", "wn15", "wn16", "wn17", "ma18", "ma19", "ma20", "ma21"}
QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name[:4] in _TX}
_GRAMS = """g as (select line_id, pos_no as start, 1 as size, norm as gram from token_spans where norm is not null union all
  select line_id, start, size, gram from (select line_id, pos_no as start, n as size, norm as first, case n when 2 then norm || ' ' || l1 when 3 then norm || ' ' || l1 || ' ' || l2 else norm || ' ' || l1 || ' ' || l2 || ' ' || l3 end as gram
  from (select *, lead(norm, 1) over w as l1, lead(norm, 2) over w as l2, lead(norm, 3) over w as l3 from token_spans window w as (partition by line_id order by pos_no)), (values (2), (3), (4)) s(n)) where gram is not null)"""


_NORMAL = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') || ' '"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
_WORDS = "list_filter(string_split(trim(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"
# for DuckDB, whose edit distance counts bytes: each letter of two bytes that entries have as one sign that no norm has, any other as one more
_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяёéèêëàâäöüôûîïçñáíóú"
_ONE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$&()*+,-./:;<=>?@[]^_{}|~"
_BYTES = lambda c: f"regexp_replace(translate({c}, '{_LETTERS}', '{_ONE[: len(_LETTERS)]}'), '[^\\x00-\\x7f]', chr(1), 'g')"
_ONE_EDIT = """(s = o or (length(s) = length(o) and len(list_filter(range(length(s)), lambda i: left(s, i::int) = left(o, i::int) and substr(s, i::int + 2) = substr(o, i::int + 2))) > 0)
  or (length(o) = length(s) + 1 and len(list_filter(range(length(o)), lambda i: left(s, i::int) = left(o, i::int) and substr(s, i::int + 1) = substr(o, i::int + 2))) > 0)
  or (length(s) = length(o) + 1 and len(list_filter(range(length(s)), lambda i: left(o, i::int) = left(s, i::int) and substr(o, i::int + 1) = substr(s, i::int + 2))) > 0))"""
_NEGATED = f"""c as (select doc_id, row_number() over () as clause, s from (select doc_id, unnest(flatten(list_transform({_SENTENCES}, lambda s: regexp_split_to_array(s, '[,.;:!?—]+')))) as s from documents where text is not null)),
  w as (select clause, p as pos, ws[p] as w from (select clause, {_WORDS.format('lower(s)')} as ws from c), range(1, 100000) r(p) where p <= len(ws)),
  m as (select *, w in ('не', 'без', 'no', 'not', 'without') as neg, w in ('нет', 'нету', 'кончился', 'кончилась', 'закончился') or (w = 'не' and coalesce(lead(w) over (partition by clause order by pos) = 'будет', false)) as refusal from w)"""


_FOUND = lambda rules: "concat_ws(',', " + ", ".join(f"case when regexp_matches(lower(text), '{_bounded(p)}') then '{n}' end" for n, p in rules) + ")"
_chain = lambda text, pairs: __import__("functools").reduce(lambda s, p: f"regexp_replace({s}, '{p[0]}', '{p[1]}', 'g')", pairs, text)


def _bounded(pattern: str) -> str:
    """Word ends written out, as RE2 knows them for ASCII only: before the first sign of a word and after its last."""
    out, start = [], True
    for part in pattern.split("\\b"):
        out.append(part)
        out.append("(?:^|[^\\p{L}\\p{N}_])" if start else "(?:$|[^\\p{L}\\p{N}_])")
        start = not start
    # a boundary opens before text and closes after it; alternatives begin anew
    return "".join(out[:-1])


def _class(rules: list[tuple[str, str]], column: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({column}), '{_bounded(p)}') then '{n}'" for n, p in rules) + " end"


_GREEDY = f"""{_GRAMS}, h as (select line_id, start, start + size - 1 as e, size, gram as text, row_number() over (partition by line_id order by size desc, length(gram) desc, start, gram) as i from g where size <= 3 and gram in (select norm from lex_entries)),
  rc(line_id, i, chosen) as (select line_id, 0::bigint, []::struct(s bigint, e bigint, t varchar)[] from (select distinct line_id from h) union all
    select h.line_id, h.i, case when len(list_filter(rc.chosen, lambda y: y.s <= h.e and h.start <= y.e)) > 0 then rc.chosen else list_append(rc.chosen, struct_pack(s := h.start::bigint, e := h.e::bigint, t := h.text)) end from rc join h on h.line_id = rc.line_id and h.i = rc.i + 1),
  greedy as (select line_id, c.s as start, c.e as "end", c.t as text from (select line_id, unnest(arg_max(chosen, i)) as c from rc group by 1))"""
_SKELETON = _chain(__import__("functools").reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", X.ROMANISED.items(), "lower(norm)"), [("[^a-z]+", ""), ("shch|sch|sh", "s"), ("zh", "z"), ("kh", "h"), ("ch", "c"), ("ts|tz", "c"), ("ck|q", "k"), ("ph", "f"), ("w", "v"), ("x", "ks"), ("[yj]", "i"), *[(f"{c}{c}+", c) for c in "abcdefghijklmnopqrstuvwxyz"]])
_ALIKE = "[" + X._LATIN_LIKE + X._CYRILLIC_LIKE + "]"

SQL = {
    "tx04_homoglyphs": f"""with s as (select token_id, text, regexp_replace(regexp_replace(text, '{_ALIKE}', '', 'g'), '[^\\p{{L}}]', '', 'g') as sure from token_spans), b as (select *, case when sure <> '' then sure else text end as seen from s),
      c as (select *, length(regexp_replace(seen, '[^Ѐ-ӿ]', '', 'g')) as cy, length(regexp_replace(seen, '[^A-Za-z]', '', 'g')) as la from b)
      select token_id, case when cy >= la and cy > 0 then translate(text, '{X._LATIN_LIKE}', '{X._CYRILLIC_LIKE}') else translate(text, '{X._CYRILLIC_LIKE}', '{X._LATIN_LIKE}') end as folded from c""",
    "tx09_transcribed": "with t as (select token_id, regexp_extract_all(lower(text), '(" + "|".join(g for g, _ in X.TRANSCRIBED) + "|.)', 1) as g from token_spans where regexp_full_match(text, '[A-Za-z]+')) select token_id, array_to_string(list_transform(g, lambda x: coalesce(map {"
      + ", ".join(f"'{g}': '{c}'" for g, c in X.TRANSCRIBED) + "}[x], x)), '') as cyrillic from t",
    "tx07_merged": "select line_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\\p{L}\\p{N}_])([12]) ([09]) ([0-9]) ([0-9])($|[^\\p{L}\\p{N}_])', '\\1\\2\\3\\4\\5\\6', 'g'), '([0-9]) ?/ ?([0-9])', '\\1/\\2', 'g'), '([0-9]) (%|(?:л|мл|ml|cl)(?:$|[^\\p{L}\\p{N}_]))', '\\1\\2', 'g') as text from text_lines",
    "tx11_skeleton": f"select entry_id, {_SKELETON} as key from lex_entries",
    "tx15_forms": f"""with w as (select distinct unnest({_WORDS.format('lower(text)')}) as w from documents where text is not null), v as (select w, length(w) as n from w where length(w) >= 4)
      select x.w as a, y.w as b from v x join v y on left(x.w, 3) = left(y.w, 3) and x.w < y.w where abs(x.n - y.n) <= 3 and left(x.w, least(5, greatest(least(x.n, y.n) - 1, 3))::int) = left(y.w, least(5, greatest(least(x.n, y.n) - 1, 3))::int)""",
    "wn16_greedy_phrases": f"with recursive {_GREEDY} select * from greedy",
    "wn17_clusters": f"""with recursive t as (select query_id, token_id, norm, row_number() over (partition by query_id order by token_id, norm) as i from token_spans where kind = 'word' and regexp_full_match(norm, '\\p{{L}}+') and length(norm) >= 4 and norm not in (select norm from lex_entries)),
      r(query_id, i, token_id, norm, lead, leads) as (select query_id, 0::bigint, null::bigint, null::varchar, null::varchar, []::varchar[] from (select distinct query_id from t) union all
        select t.query_id, t.i, t.token_id, t.norm, coalesce(list_filter(r.leads, lambda y: levenshtein({_BYTES('y')}, {_BYTES('t.norm')}) <= 1)[1], t.norm), case when len(list_filter(r.leads, lambda y: levenshtein({_BYTES('y')}, {_BYTES('t.norm')}) <= 1)) > 0 then r.leads else list_append(r.leads, t.norm) end from r join t on t.query_id = r.query_id and t.i = r.i + 1)
      select query_id, token_id, norm, lead from r where i > 0""",
    "tx33_name_parts": f"""with n as (select listing_id, name, regexp_replace(coalesce(name, ''), '[|/,«»"]', ' ', 'g') as n from wine_cards), y as (select *, regexp_replace(regexp_replace(n, '(^|[^\\p{{L}}\\p{{N}}_])(?:19|20)[0-9][0-9]($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])(?:19|20)[0-9][0-9]($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g') as r from n),
      v as (select *, replace(regexp_replace(r, '(?i)[0-9]+(?:[.,][0-9]+)? ?(?:мл|ml|cl|л|l)( |$)', ' \\1', 'g'), ' ', '  ') as q from y)
      select listing_id, nullif(regexp_extract(n, '(?:^|[^\\p{{L}}\\p{{N}}_])((?:19|20)[0-9][0-9])(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') as year, nullif(replace(regexp_extract(lower(n), '([0-9]+(?:[.,][0-9]+)? ?(?:мл|ml|cl|л|l))(?: |$)', 1), ' ', ''), '') as volume, {_class(X.COLOUR_PHRASES, 'name')} as colour, {_class(X.SUGAR_PHRASES, 'name')} as sugar,
        trim(regexp_replace(regexp_replace(q, '(?i)(^| )(?:вино|wine|красное|белое|розовое|оранжевое|red|white|rose|orange|кр\\.|бел\\.|роз\\.|оранж\\.)( |$)', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as rest from v""",
    "tx17_finders": f"select doc_id, {_FOUND(X.SUGAR_PHRASES)} as sugars, {_FOUND(X.COLOUR_PHRASES)} as colours from documents where text is not null",
    "tx26_lines": """with t as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') as l, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]*\\n[ \\t\\n\\x0B\\f\\r]*'), lambda s: s <> '') as k, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda s: s <> '') as w from documents where text is not null)
      select doc_id, len(list_distinct(list_transform(l, lambda s: lower(s))))::int as n_lines, len(list_filter(list_distinct(k), lambda s: len(list_filter(k, lambda x: x = s)) > 3)) > 0 or len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] and w[i] = w[i + 2] and w[i] = w[i + 3])) > 0 as looped,
        length(regexp_replace(text, '[0-9A-Za-zА-Яа-яЁё \\t\\n\\x0B\\f\\r.,!?:;«»()"''-]', '', 'g')) > 0.05 * length(text) as garbage from t""",
    "ag17_support": f"""with b as (select distinct query_id as g, reading_key as r, norm as s from token_spans where kind = 'word' and norm is not null), o as (select g, r, s as o from b), n as (select b.g, b.s, o.r from (select distinct g, s from b) b join o using (g) where {_ONE_EDIT})
      select g as query_id, s as norm, count(distinct r)::int as support, min(r) as reading_key from n group by 1, 2""",
    "jn07_fuzzy_join": f"""with w as (select distinct norm as word from token_spans where norm is not null and kind = 'word'), e as (select distinct norm from lex_entries where norm is not null),
      x as (select word, norm, levenshtein({_BYTES('word')}, {_BYTES('norm')})::int as edits from w, e where abs(length(word) - length(norm)) <= 2)
      select * from x where edits <= 2 and length(norm) >= 3 and edits <= case when length(norm) <= 3 then 0 when length(norm) <= 5 then 0.5 when length(norm) <= 8 then 1 when length(norm) <= 12 then 1.5 else 2 end""",
    "wn12_negation": f"""with {_NEGATED}, n as (select w, coalesce(bool_or(neg) over (partition by clause order by pos rows between 2 preceding and 1 preceding), false) or coalesce(bool_or(refusal) over (partition by clause order by pos rows between 1 following and 4 following), false) as negated from m)
      select w, count(*) as n, count(*) filter (negated) as negated from n group by 1""",
    "tx08_kinds": f"""with t as (select unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) as token from text_lines where text is not null)
      select case when regexp_full_match(token, '(19|20)[0-9][0-9]') then 'year' when regexp_full_match(token, '[0-9]{{1,3}}/[0-9]{{1,3}}') and split_part(token, '/', 1)::int + split_part(token, '/', 2)::int = 100 then 'ratio'
        when regexp_full_match(token, '[0-9]{{1,2}}[.,][0-9]') and replace(token, ',', '.')::double between 3 and 25 then 'abv' when regexp_matches(token, '^[0-9]') then 'number' when regexp_matches(token, '{X.ROMAN_PATTERN}') then 'roman' else 'word' end as kind, count(*) as n from t where token <> '' group by 1""",
    "tx21_filter": "with t as (select doc_id, lower(text) as t, " + _SENTENCES + " as s from documents where text is not null) select doc_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in X.VIOLATIONS)
      + ") as classes, length(array_to_string(list_filter(s, lambda x: not regexp_matches(lower(x), '" + "|".join(f"({p})" for _, p in X.VIOLATIONS) + "')), ' '))::int as left_over from t",
    "tx29_winery": """with n as (select entry_id, norm, string_split(norm, ' ')[-1] as house from lex_entries where lex_field = 'producer' and not is_part), w as (select listing_id, trim(regexp_replace(lower(winery), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') as said from wine_cards where winery is not null),
      x as (select listing_id, (select min(entry_id) from n where n.norm = w.said) as exact, (select min(entry_id) from n where n.house = string_split(w.said, ' ')[-1]) as h from w) select listing_id, coalesce(exact, h) as entry_id, case when exact is not null then 'name' when h is not null then 'house' end as how from x""",
    "tx37_house_lines": f"""with l as (select line_id, text, trim(regexp_replace(text, '[«»"“”,;|/ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as line, lower(trim(regexp_replace(lag(text) over (partition by reading_key order by line_no, line_id), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) as b from text_lines),
      h as (select line_id, coalesce(nullif(regexp_extract(line, '(?i)^(?:{HOUSE}) (\\S.*)$', 1), ''), nullif(regexp_extract(line, '(?i)^(\\S.*) (?:winery|estate)$', 1), ''), case when regexp_full_match(b, '{HOUSE}') then nullif(line, '') end) as house from l where text is not null) select * from h where house is not null""",
    "ma20_strength": "with f as (select line_id, regexp_extract(text, '([0-9]{1,2}(?:[.,][0-9])?) ?% ?(?:vol|об)|(?:алк\\.?|vol) ?([0-9]{1,2}(?:[.,][0-9])?) ?%', 0) as x from text_lines), v as (select line_id, try_cast(replace(regexp_extract(x, '([0-9]{1,2}(?:[.,][0-9])?)', 1), ',', '.') as double) as abv from f) select * from v where abv between 4 and 22",
    "ag11_idf": "with n as (select count(distinct doc_id) as n from documents where text is not null), w as (select doc_id, unnest(string_split(trim(regexp_replace(lower(lang), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), ' ')) as word from documents where text is not null) select word, count(distinct doc_id) as df, round(ln((1 + any_value(n)) / (1 + count(distinct doc_id))::double) + 1, 4) as idf from w, n group by word",
    "ag12_word_frequency": "select word, count(distinct winery) as df from (select winery, unnest(string_split(lower(winery), ' ')) as word from catalog_positions where winery is not null) group by 1",
    "ag13_canonical": "with c as (select skeleton, norm, count(distinct line_id) as n from token_spans where skeleton is not null and norm is not null group by 1, 2), s as (select *, n / sum(n) over (partition by skeleton)::double as share from c) select skeleton, norm as canonical, n, round(share, 6) as share from s qualify row_number() over (partition by skeleton order by (share >= 0.8) desc, n desc, norm desc) = 1",
    "ag14_inverted_index": "select word, count(distinct slug)::int as n, string_agg(distinct slug, ',' order by slug) as slugs from (select slug, unnest(string_split(lower(winery), ' ')) as word from catalog_positions where winery is not null) group by 1",
    "ag15_votes": "select query_id, lex_field, entry_id, count(distinct reading_key) as support, min(pos_no) as first_pos, max(conf) as conf, bool_or(kind = 'word') as strong from token_spans join lex_entries using (norm) where not is_part group by 1, 2, 3",
    "ag16_single_value": "with y as (select distinct query_id, reading_key, text as value from token_spans where kind = 'year' and regexp_full_match(text, '[0-9]{4}')), r as (select query_id, reading_key, count(*) as n, min(value) as value from y group by 1, 2) select query_id, case when n = 1 then value end as value from r qualify row_number() over (partition by query_id order by reading_key nulls first) = 1",
    "jn03_inverted_join": "with i as (select distinct slug, unnest(string_split(lower(winery), ' ')) as norm from catalog_positions where winery is not null) select token_id, count(*) as n, min(i.slug) as first_slug from token_spans join i using (norm) group by 1",
    "jn05_exact_join": "select token_id, entry_id, lex_field from token_spans join lex_entries using (norm)",
    "jn06_skeleton_join": "select token_id, entry_id, 0.0::double as cost from token_spans t join lex_entries e using (norm) union all select token_id, entry_id, 0.2 from token_spans t join lex_entries e using (skeleton) where length(skeleton) > 3 and coalesce(t.norm <> e.norm, true)",
    "jn08_phrases": """with p as (select entry_id, string_split(norm, ' ') as w from lex_entries where not is_part and len(string_split(norm, ' ')) = 2), t as (select line_id, pos_no, norm from token_spans where norm is not null),
      h as (select a.line_id, entry_id, a.pos_no as start, b.pos_no as "end", case when b.pos_no - a.pos_no = 2 then 0.3 else 0.0 end::double as cost from t a join p on a.norm = p.w[1] join t b on b.line_id = a.line_id and b.norm = p.w[2] and b.pos_no - a.pos_no in (1, 2)
      where b.pos_no - a.pos_no = 1 or exists (select 1 from t m where m.line_id = a.line_id and m.pos_no = a.pos_no + 1 and m.norm in ('и', 'de', 'du', 'the', 'вино', 'wine'))) select line_id, entry_id, start, arg_min("end", cost) as "end", min(cost) as cost from h group by 1, 2, 3""",
    "so09_best_hits": "with h as (select token_id, entry_id, lex_field, canonical, idf, 0.0::double as cost from token_spans t join lex_entries e using (norm) union all select token_id, entry_id, lex_field, canonical, idf, 0.2 from token_spans t join lex_entries e using (skeleton) where length(skeleton) > 3 and coalesce(t.norm <> e.norm, true)) select token_id, entry_id, cost, (row_number() over (partition by token_id order by cost, idf desc, lex_field, canonical, entry_id))::int as rank from h qualify rank <= 3",
    "st03_unmatched": "select token_id, norm from token_spans where regexp_full_match(norm, '\\p{L}+') and length(norm) >= 4 and norm not in ('вино', 'wine', 'урожай') and norm not in (select norm from lex_entries)",
    "wn09_ngrams": f"with {_GRAMS} select line_id, start, size::int as size, gram from g where gram is not null",
    "wn10_segments": "select event_id, user_id, sum(coalesce(gap, false)::int) over (partition by user_id order by ts, event_id)::bigint as segment from (select *, event_type <> lag(event_type) over w or ts - lag(ts) over w > interval 1 hour as gap from events window w as (partition by user_id order by ts, event_id))",
    "wn15_outermost": f"""with {_GRAMS}, h as (select line_id, start, start + size - 1 as "end", gram from g where size <= 3 and gram in (select norm from lex_entries)) select * from h a where not exists (select 1 from h b where a.line_id = b.line_id and b.start <= a.start and b."end" >= a."end" and (b.start < a.start or b."end" > a."end"))""",
    "tx02_metric_norm": "select slug, trim(regexp_replace(lower(slug), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') as norm from catalog_positions",
    "tx05_roman": "with r(text, value) as (values " + ", ".join(f"('{''.join(s for s in parts)}', {v})" for v, parts in ((n, [("", "M", "MM", "MMM")[n // 1000], ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")[n // 100 % 10], ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")[n // 10 % 10], ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")[n % 10]]) for n in range(1, 4000))) + ") select token_id, text, value from token_spans join r using (text)",
    "tx06_tokens": "with t as (select slug, regexp_extract_all(replace(slug, '_', '-'), '([0-9]+(?:[.,/:][0-9]+)*|[\\p{L}]+(?:[-''’][\\p{L}]+)*)', 1) as t from catalog_positions) select slug, (p - 1)::int as pos, t[p] as token from t, range(1, 40) r(p) where p <= len(t)",
    "tx10_romanised": "select token_id, " + __import__("functools").reduce(lambda s, p: f"replace({s}, '{p[0]}', '{p[1]}')", X.ROMANISED.items(), "lower(norm)") + " as latin from token_spans",
    "tx14_budget": "select entry_id, case when length(norm) <= 3 then 0 when length(norm) <= 5 then 0.5 when length(norm) <= 8 then 1 when length(norm) <= 12 then 1.5 else 2 end::double as budget from lex_entries",
    "tx12_edits": "select p_partkey, levenshtein(p_name, 'small ring')::int as edits, least(levenshtein(p_name, 'small ring'), 5)::int as bounded from part",
    "tx16_bag": "select p_partkey, list_contains(b, 'ring') as exact, len(list_filter(b, lambda x: levenshtein(x, 'rings') <= 1)) > 0 as fuzzy from (select p_partkey, string_split(p_name, ' ') as b from part)",
    "tx20_flags": "select listing_id, coalesce(regexp_matches(lower(name), 'игрист|sparkling|brut|брют'), false) as sparkling, coalesce(regexp_matches(lower(name), 'слад|sweet|dolce'), false) as sweet_name from wine_cards",
    "tx25_locked": "select norm as w, count(*) as n from token_spans where regexp_full_match(norm, '[а-яa-z]{5,}') and norm not in (select unnest(string_split(norm, ' ')) from lex_entries) group by 1",
    "tx27_plurals": "select p_brand, n || ' ' || case when n % 100 between 11 and 14 then 'вин' when n % 10 = 1 then 'вино' when n % 10 between 2 and 4 then 'вина' else 'вин' end as said from (select p_brand, count(*) as n from part group by 1)",
    "tx28_template": "select slug, concat_ws('; ', name, 'producer ' || winery, case when len(grapes) > 0 then 'grapes ' || array_to_string(grapes, ', ') end, 'vintage ' || vintage) as note from catalog_positions",
    "tx35_read_bag": "select w, count(*) as n from (select case when trim(text, ' ') <> '' then lower(text) else norm end as w from token_spans) where w is not null group by 1",
    "tx36_photo_kind": "select case when regexp_matches(lower(image_path), '^scan') then 'scan' when regexp_matches(lower(image_path), '^(img|photo|dsc)') then 'photo' else 'other' end as kind, lower(regexp_extract(image_path, '\\.(\\w+)$', 1)) as suffix, count(*) as n from predictions where image_path is not null group by 1, 2",
    "ma18_hashes": "select doc_id, sha1(text) as sha1 from documents where text is not null",
    "tx03_clean": "select doc_id, length(trim(regexp_replace(regexp_replace(text, '[\\p{Cc}\\p{Cf}]+', ' ', 'g'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), ' '))::int as n from documents",
    "tx22_barrier": f"""with t as (select doc_id, {_NORMAL} as t from documents where text is not null), e as (select doc_id, t, replace(replace(t, ' на этикетке ', ' | '), ' the label reads ', ' | ') as l,
      regexp_replace(t, ' чрезмерное употребление (\\S+ )?здоровью ', ' | ', 'g') as h from t)
      select * from (select doc_id, case when regexp_matches(h, ' здоров| health ') then 'health' when regexp_matches(t, ' употребл\\S* (\\S+ ){{0,2}}вред| drink responsibly ') then 'drink' when regexp_matches(l, ' этикет| label ') then 'label' end as refusal from e) where refusal is not null""",
    "tx24_guards": "select doc_id, case when t = '' then 'empty' when length(t) > 2000 then 'length' when regexp_matches(lower(t), '[0-9]{5,}') then 'numbers' when contains(t, '<p>') then 'markup' when regexp_matches(lower(t), '^(##|digest|дайджест|заметка)') then 'preamble' end as code from (select doc_id, coalesce(trim(text, ' '), '') as t from documents)",
    "tx19_sugar": """select slug, case when regexp_matches(lower(name), 'экстра[ -]брют|extra[ -]brut') then 'extra_brut' when regexp_matches(lower(name), 'полусух|semi-?dry|off-dry') then 'polusuhoe' when regexp_matches(lower(name), 'полуслад|semi-?sweet') then 'polusladkoe' when regexp_matches(lower(name), 'брют|(^|[^a-z])brut($|[^a-z])') then 'brut'
      when regexp_matches(lower(name), 'сух(ое|ой|ая)|(^|[^a-z])dry($|[^a-z])') then 'suhoe' when regexp_matches(lower(name), 'сладк(ое|ий|ая)|(^|[^a-z])sweet($|[^a-z])') then 'sladkoe' end as by_name, regexp_extract_all(slug, '(ekstra-bryut|bryut|polusukhoe|polusladkoe|sukhoe|sladkoe)', 1)[-1] as by_slug from catalog_positions""",
    "ma19_vintage": """with t as (select *, case when norm in ('урожай', 'vintage', 'год', 'г') then 'vintage' when norm in ('гост', 'партия', 'no') then 'not' end as a, coalesce(kind in ('year', 'number', 'abv', 'ratio'), false) as stop from token_spans),
      w as (select token_id, text, kind, lag(a, 1) over w as l1, lag(a, 2) over w as l2, lag(a, 3) over w as l3, coalesce(lag(stop, 1) over w, false) as s1, coalesce(lag(stop, 2) over w, false) as s2, lead(a, 1) over w as r1, lead(a, 2) over w as r2, coalesce(lead(stop, 1) over w, false) as q1 from t window w as (partition by line_id order by pos_no)),
      n as (select token_id, text, coalesce(l1, case when not s1 then coalesce(l2, case when not s2 then l3 end) end) as l, coalesce(r1, case when not q1 then r2 end) as r from w where kind = 'year'),
      c as (select token_id, text, case when l = 'not' or r = 'not' then 'not' else coalesce(l, r) end as anchor from n where regexp_full_match(text, '[0-9]{4}'))
      select token_id, text::int as vintage from c where text::int between 1950 and 2026 and (anchor is not distinct from 'vintage' or (anchor is null and text::int >= 1990))""",
    "tx23_invented": """with t as (select listing_id, regexp_extract_all(coalesce(name, ''), '(\\d+(?:[.,]\\d+)?)', 1) as a, regexp_extract_all(coalesce(slug, ''), '(\\d+(?:[.,]\\d+)?)', 1) as b from wine_cards),
      u as (select listing_id, x, min(p) as p from (select listing_id, a[p] as x, p from t, range(1, 60) r(p) where p <= len(a) and not list_contains(b, a[p])) group by 1, 2) select t.listing_id, coalesce((select string_agg(x, ',' order by p) from u where u.listing_id = t.listing_id), '') as numbers from t""",
    "tx34_name_words": """with g as (select distinct unnest(string_split(norm, ' ')) as w from lex_entries where lex_field = 'grape'), w as (select slug, string_split(replace(lower(name), 'ё', 'е'), ' ') as a from catalog_positions where name is not null),
      e as (select slug, a[p] as x, min(p) as p from w, range(1, 30) r(p) where p <= len(a) group by 1, 2), k as (select * from e where x not in (select w from g) and x not in ('красное', 'белое', 'розовое', 'оранжевое', 'сухое', 'полусухое', 'сладкое', 'полусладкое', 'брют', 'экстра'))
      select slug, coalesce((select string_agg(x, ' ' order by p) from k where k.slug = w.slug), '') as words from w""",
    "wn11_anchor": """with t as (select *, case when norm in ('урожай', 'vintage', 'год', 'г') then 'vintage' when norm in ('гост', 'партия', 'no') then 'not' end as a, coalesce(kind in ('year', 'number', 'abv', 'ratio'), false) as stop from token_spans),
      w as (select token_id, kind, lag(a, 1) over w as l1, lag(a, 2) over w as l2, lag(a, 3) over w as l3, coalesce(lag(stop, 1) over w, false) as s1, coalesce(lag(stop, 2) over w, false) as s2, lead(a, 1) over w as r1, lead(a, 2) over w as r2, coalesce(lead(stop, 1) over w, false) as q1 from t window w as (partition by line_id order by pos_no)),
      n as (select token_id, coalesce(l1, case when not s1 then coalesce(l2, case when not s2 then l3 end) end) as l, coalesce(r1, case when not q1 then r2 end) as r from w where kind = 'year')
      select token_id, case when l = 'not' or r = 'not' then 'not' else coalesce(l, r) end as anchor from n""",
}
SQL["ma21_fields"] = f"""with recursive {_GREEDY}, f as (select query_id, lex_field, canonical as value, reading_key from greedy join lex_entries e on e.norm = greedy.text and not e.is_part join text_lines using (line_id)
    union all select query_id, 'year', vintage::varchar, reading_key from ({SQL['ma19_vintage']}) join token_spans using (token_id) union all select query_id, 'abv', abv::varchar, reading_key from ({SQL['ma20_strength']}) join text_lines using (line_id)),
  c as (select query_id, lex_field, value, count(*) as n from f where value is not null group by 1, 2, 3), s as (select query_id, lex_field, count(distinct reading_key) as support from f group by 1, 2)
  select s.query_id, s.lex_field, value, support from s left join (select * from c qualify row_number() over (partition by query_id, lex_field order by n desc, value) = 1) m on m.query_id is not distinct from s.query_id and m.lex_field = s.lex_field"""
