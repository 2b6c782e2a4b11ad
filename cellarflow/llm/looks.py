"""One consistent form for text that looks the same but is written with other characters.

A column is taken as one array of code points. A lookup table gives each code point its expansion (invisible signs
expand to nothing, full-width forms and one-sign Roman numerals to plain letters, composed letters to a base and its
marks, look-alike letters to one of them); the expansions are gathered by offsets, marks are put in canonical order
and composed again by table lookups. No step calls a function per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.functions.codepoints import from_codepoints, ranges, to_codepoints

# Letters drawn alike. Each string starts with the Latin letter (or the one sign) that stands for all.
ALIKE_CYRILLIC = "AА BВ EЕ KК MМ HН OО PР CС TТ XХ IІ SЅ JЈ YУ aа eе oо pр cс yу xх iі sѕ jј hһ dԁ qԛ wԝ GԌ IӀ"
ALIKE_GREEK = "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ oο vν pρ cϲ jϳ кκ"
# Letters that only one script has are what decides the script of a word; these are the Cyrillic sides of the above.
TO_CYRILLIC = dict(pair for pair in ALIKE_CYRILLIC.split() if pair[1] not in "ԌӀ")
HYPHENS = [*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D]
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]
KEPT_KINDS = ("<wide>", "<narrow>", "<noBreak>")

_SIZE = 0x110000


def _expand(point: int) -> list[int]:
    """What one code point is written as: zero or more code points, decomposed and folded."""
    if 0xD800 <= point < 0xE000:
        return [point]
    sign = chr(point)
    if point in INVISIBLE or (unicodedata.category(sign) == "Cf" and point not in range(0x600, 0x606)):
        return []
    if point in HYPHENS:
        return [0x2D]
    if unicodedata.category(sign) in ("Zs", "Zl", "Zp") or sign in "\t\n\r\x0b\x0c\x85":
        return [0x20]
    parts = unicodedata.decomposition(sign).split()
    if parts and 0xAC00 <= point <= 0xD7A3:
        parts = []
    if parts and parts[0].startswith("<"):
        parts = parts[1:] if parts[0] in KEPT_KINDS or 0x2160 <= point <= 0x217F else []
    if parts:
        return [x for part in parts for x in _expand(int(part, 16))]
    return [_alike().get(point, point)]


@cache
def _alike() -> dict[int, int]:
    return {ord(x): ord(group[0]) for group in (ALIKE_CYRILLIC + " " + ALIKE_GREEK).split() for x in group[1:]}


class _Tables:
    """Lookup tables by code point, filled in as code points turn up."""

    def __init__(self) -> None:
        self.length = np.full(_SIZE, -1, np.int8)
        self.start = np.zeros(_SIZE, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.marks = np.zeros(_SIZE, np.uint8)
        self.script = np.zeros(_SIZE, np.uint8)  # 1: letter of Cyrillic only, 2: of Latin only
        for point in range(0x300, 0x3100):
            self.marks[point] = unicodedata.combining(chr(point))
        self.cyrillic = np.arange(_SIZE, dtype=np.uint32)
        for latin, own in TO_CYRILLIC.items():
            self.cyrillic[ord(latin)] = ord(own)
        shared = {ord(x) for group in (ALIKE_CYRILLIC + " " + ALIKE_GREEK).split() for x in group}
        pairs = {}
        for point in [*range(0xC0, 0x3400), *range(0xF900, 0xFB50)]:
            parts = unicodedata.decomposition(chr(point)).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(point)) == chr(point):
                base, mark = (int(x, 16) for x in parts)
                pairs.setdefault(base << 21 | mark, point)
        for key, point in pairs.items():  # composed letters of both scripts, as the diaeresis on e
            own = pairs.get(ord(TO_CYRILLIC.get(chr(key >> 21), "\0")) << 21 | key & 0x1FFFFF)
            if own is not None:
                self.cyrillic[point] = own
                shared |= {point, own}
        for point in [*range(0x41, 0x250), *range(0x400, 0x530)]:
            if chr(point).isalpha() and point not in shared:
                self.script[point] = 1 if point >= 0x400 else 2
        # a folded base stands for several letters; composing it must not depend on which one was written
        for key, point in list(pairs.items()):
            base = _alike().get(key >> 21)
            if base is not None and (other := base << 21 | key & 0x1FFFFF) not in pairs:
                pairs[other] = point
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)

    def learn(self, points: np.ndarray) -> None:
        new = np.unique(points[self.length[points] < 0])
        if len(new):
            grown = [_expand(int(p)) for p in new]
            self.start[new] = len(self.pool) + np.cumsum([0, *map(len, grown)])[:-1]
            self.length[new] = [len(x) for x in grown]
            self.pool = np.concatenate([self.pool, np.array([x for g in grown for x in g], np.uint32)])


@cache
def _tables() -> _Tables:
    return _Tables()


def _offsets_of(keep: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(keep)])[offsets]


def look(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form that all texts of the same look share: code points and row offsets in, the same out."""
    t = _tables()
    t.learn(points)
    size = t.length[points].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])[offsets]
    points = t.pool[ranges(t.start[points], size)]
    if len(points) == 0:
        return points, offsets
    # marks in canonical order: a stable sort by class within each run that starts with a base
    cls = t.marks[points]
    if cls.any():
        first = np.zeros(len(points), bool)
        first[offsets[:-1][offsets[:-1] < len(points)]] = True
        run = np.cumsum((cls == 0) | first)
        order = np.lexsort((cls, run))
        points, cls = points[order], cls[order]
        points, offsets = _compose(points, cls, run, offsets)
    # white space at both ends can't be seen
    solid = np.flatnonzero(points != 0x20)
    begin = np.append(solid, len(points))[np.searchsorted(solid, offsets[:-1])]
    end = np.concatenate([[-1], solid])[np.searchsorted(solid, offsets[1:])] + 1
    begin = np.minimum(begin, offsets[1:])
    length = np.maximum(end - begin, 0)
    return points[ranges(begin, length)], np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


def _compose(points: np.ndarray, cls: np.ndarray, run: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins each base with the marks behind it, the k-th mark of all bases at a time."""
    t = _tables()
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(begins, len(points)))
    keep = np.ones(len(points), bool)
    points = points.copy()
    blocked = np.zeros(len(begins), np.int16)  # class of the last mark that stayed
    open_ = np.flatnonzero((sizes > 1) & (cls[begins] == 0))
    for k in range(1, int(sizes.max())):
        open_ = open_[sizes[open_] > k]
        if not len(open_):
            break
        base, mark = begins[open_], begins[open_] + k
        key = points[base].astype(np.int64) << 21 | points[mark]
        i = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        joins = (t.pair_keys[i] == key) & (cls[mark] > blocked[open_])
        points[base[joins]] = t.pair_values[i[joins]]
        keep[mark[joins]] = False
        blocked[open_[~joins]] = cls[mark[~joins]]
    return points[keep], _offsets_of(keep, offsets)


def readable(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of a look: the same code points with shared letters in Cyrillic where the row has only Cyrillic letters of its own."""
    t = _tables()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    script = t.script[points]
    has_cyrillic = np.bincount(row[script == 1], minlength=len(offsets) - 1) > 0
    has_latin = np.bincount(row[script == 2], minlength=len(offsets) - 1) > 0
    return np.where((has_cyrillic & ~has_latin)[row], t.cyrillic[points], points).astype(np.uint32)


def look_column(column: pa.Array, script: bool = False) -> pa.Array:
    """A string column in its look; with ``script`` in the readable spelling of it. Null stays null, empty empty."""
    points, offsets = look(*to_codepoints(column))
    made = from_codepoints(readable(points, offsets) if script else points, offsets)
    if column.null_count:
        made = pc.if_else(column.is_valid(), made, pa.scalar(None, made.type))
    return made.cast(pa.string())


def fold(text: str) -> str:
    """The look of one string, for dictionaries of distinct words."""
    return look_column(pa.array([text])).to_pylist()[0]


def with_looks(df: DataFrame, columns: dict[str, str], script: bool = False) -> DataFrame:
    """Adds, for each ``column: name``, the consistent form of a string column under ``name``.

    Invisible signs go; kinds of spaces, hyphens and widths, composed and separate accents, one-sign Roman numerals
    and letters drawn alike become one; white space at the ends goes. Letter case, accents, digits and ligatures
    stay. With ``script``, letters drawn alike are written in the script of the rest of the text.
    Null gives null, empty or only invisible text the empty string; texts of any length are taken whole; repeated
    rows stay; an added name replaces a column that has it. No shuffle: one Arrow pass.
    """
    sources = list(columns)
    base = df.select("*", *[F.col(c).alias(f"__look_{i}") for i, c in enumerate(sources)]).drop(*[n for n in columns.values() if n in df.columns])
    kept = [f for f in base.schema.fields if not f.name.startswith("__look_")]
    schema = T.StructType([*kept, *[T.StructField(columns[c], T.StringType()) for c in sources]])

    def fold_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [look_column(batch.column(len(kept) + i), script) for i in range(len(sources))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *made], schema.names)

    return base.select(*[f.name for f in kept], *[f"__look_{i}" for i in range(len(sources))]).mapInArrow(fold_all, schema)


def same_look_pairs(df: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """Pairs (``key``_a < ``key``_b) of rows of one ``group`` whose ``text`` looks the same but is another string.

    Null groups and texts take part in no pair, rows with one string in none between them, an empty table gives
    none. Groups of one look with a single string are dropped before the join, by an aggregation that is combined
    before its shuffle; a large group that is left is split by adaptive skew handling of the sort-merge join.
    """
    forms = with_looks(df.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(text).alias("t")), {"t": "look"})
    mixed = forms.groupBy("g", "look").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("g", "look")
    live = forms.join(mixed.hint("shuffle_merge"), ["g", "look"], "left_semi")
    a, b = live.alias("a"), live.alias("b")
    joined = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.look") == F.col("b.look")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.t") != F.col("b.t")))
    return joined.select(F.col("a.k").alias(f"{key}_a"), F.col("b.k").alias(f"{key}_b"))
