"""Evaluation texts that leaked into a corpus, found by spaced-seed hashing.

A seed is a fixed mask over word positions: seven words in a row, or seven of eight with one inner word ignored. All
seeds of the evaluation texts and of the documents are hashed and joined; any mask may meet any other, so an ignored
word stands for another word (masks alike) or for a missing one (a mask with a gap against one without). Around the
hits a substitution-tolerant alignment decides.

With at most one word in eight wrong, a passage of 15 words or more always holds such a seed: of the clean runs
between the errors, either one has seven words or two neighbours together have.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.functions.codepoints import ranges
from cellarflow.llm.pieces import WordReader, slices

WEIGHT = 7  # words a seed compares
LEAST_WORDS = 15  # words in a row of the item
ONE_ERROR_IN = 8
SIZES = (LEAST_WORDS, 2 * ONE_ERROR_IN, 3 * ONE_ERROR_IN, 4 * ONE_ERROR_IN)  # windows tried; a longer passage within the bound holds one
SHIFT = SIZES[-1] // ONE_ERROR_IN  # most places by which missing or added words may move the alignment inside one window
INSTRUCTION_SHARE = 0.01  # of the items of different texts, and at least two of them, that have an instruction sentence
MOST_HITS = 2_000_000  # seed hits that are held at once
BLOCK_CHARS = 4_000_000  # evaluation text that is sent to the executors at once; more goes in several passes
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")


def seed_hashes(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each mask: where in ``words`` it fits inside one row, and the hashes of the words it selects there."""
    n = len(words)
    ends = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # words from here to the row's end
    padded = np.concatenate([words, np.zeros(WEIGHT + 1, np.uint64)])
    runs = [np.zeros(n + WEIGHT + 1, np.uint64)]
    for i in range(WEIGHT):
        following = padded[i:]
        runs.append(runs[-1] * _BASE + np.concatenate([following, np.zeros(i, np.uint64)]))
    for first in range(1, WEIGHT + 1):  # words before the gap; all of them: no gap
        span = WEIGHT + (first < WEIGHT)
        at = np.flatnonzero(ends >= span)
        made = runs[first][at]
        if first < WEIGHT:
            rest = WEIGHT - first
            made = made * np.uint64(pow(int(_BASE), rest, 1 << 64)) + runs[rest][at + first + 1]
        made ^= made >> np.uint64(29)
        yield at, made * np.uint64(0xBF58476D1CE4E5B9)


class EvalIndex:
    """Seeds of a bounded set of evaluation passages: ``words`` of passage i lie at offsets[i] : offsets[i + 1]."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, self.offsets = words, offsets
        parts = list(seed_hashes(words, offsets))
        hashes = np.concatenate([h for _, h in parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], np.concatenate([a for a, _ in parts])[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.hashes >> np.uint64(64 - _BITS)] = True
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``words`` and in the evaluation words where a seed of both begins, about MOST_HITS at a time."""
        for at, made in seed_hashes(words, offsets):
            passed = self.seen[made >> np.uint64(64 - _BITS)]
            at, made = at[passed], made[passed]
            low = np.searchsorted(self.hashes, made)
            size = np.searchsorted(self.hashes, made, "right") - low
            at, low, size = at[size > 0], low[size > 0], size[size > 0]
            part = np.cumsum(size) // MOST_HITS
            for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                if len(rows):
                    yield np.repeat(at[rows], size[rows]), self.at[ranges(low[rows], size[rows])]

    def matches(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``words`` and passages that share at least LEAST_WORDS words in a row, errors within the bound."""
        found = [self._around(words, offsets, *self._one_a_diagonal(offsets, j, k)) for j, k in self._gathered(words, offsets)]
        pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        return pairs[0], pairs[1]

    def _gathered(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The hits of all masks, put together as long as they are few."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for hit in self.hits(words, offsets):
            held.append(hit)
            if sum(len(j) for j, _ in held) >= MOST_HITS:
                yield tuple(map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def _one_a_diagonal(self, offsets: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hits close together on one diagonal one is enough; with the row of each."""
        doc = np.searchsorted(offsets, j, "right") - 1
        diagonal = j - k
        order = np.lexsort((j // WEIGHT, diagonal, self.row[k], doc))
        j, k, doc, diagonal = j[order], k[order], doc[order], diagonal[order]
        new = np.ones(len(j), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (diagonal[1:] != diagonal[:-1]) | (j[1:] // WEIGHT != j[:-1] // WEIGHT) | (self.row[k[1:]] != self.row[k[:-1]])
        return j[new], k[new], doc[new]

    def _around(self, words: np.ndarray, offsets: np.ndarray, j: np.ndarray, k: np.ndarray, doc: np.ndarray) -> np.ndarray:
        found = np.zeros(len(j), bool)
        for begin in range(0, len(j), 20_000):
            part = slice(begin, begin + 20_000)
            found[part] = self._verify(words, offsets, j[part], k[part], doc[part])
        return np.stack([doc[found], self.row[k[found]]])

    def _verify(self, words: np.ndarray, offsets: np.ndarray, j: np.ndarray, k: np.ndarray, doc: np.ndarray) -> np.ndarray:
        longest = SIZES[-1]
        back = longest - 1
        t = np.arange(-back, longest + WEIGHT + 1)
        at = k[:, None] + t
        lo, hi = self.offsets[self.row[k]][:, None], self.offsets[self.row[k] + 1][:, None]
        inside = (at >= lo) & (at < hi)
        item = np.where(inside, self.words[np.clip(at, 0, len(self.words) - 1)], np.uint64(0))
        # doc words around the hit; places outside the document equal nothing
        u = np.arange(-back - SHIFT, longest + WEIGHT + 1 + SHIFT)
        where = j[:, None] + u
        own = (where >= offsets[doc][:, None]) & (where < offsets[doc + 1][:, None])
        text = np.where(own, words[np.clip(where, 0, len(words) - 1)], np.uint64(1))
        equal = np.stack([item == text[:, s : s + len(t)] for s in range(2 * SHIFT + 1)])
        equal &= inside & np.stack([own[:, s : s + len(t)] for s in range(2 * SHIFT + 1)])
        # a necessary condition of each size first: enough words of a window found at any shift
        some = np.cumsum(np.pad(equal.any(0), ((0, 0), (1, 0))), axis=1)
        enough = [((some[:, size:] - some[:, :-size]) >= size - size // ONE_ERROR_IN).any(1) for size in SIZES]
        likely = np.flatnonzero(np.logical_or.reduce(enough))
        result = np.zeros(len(j), bool)
        if not len(likely):
            return result
        equal, inside = equal[:, likely], inside[likely]
        for size in SIZES:
            result[likely] |= self._aligned(equal, inside, size)
        return result

    @staticmethod
    def _aligned(equal: np.ndarray, inside: np.ndarray, size: int) -> np.ndarray:
        """Whether a window of ``size`` item words aligns with at most size / ONE_ERROR_IN errors; all windows at once.

        A passage begins and ends with a word that is there, so its first and last word have to match."""
        windows = inside.shape[1] - size + 1
        whole = np.cumsum(np.pad(inside, ((0, 0), (1, 0))), axis=1)
        whole = (whole[:, size:] - whole[:, :-size]) == size
        errors = np.zeros((2 * SHIFT + 1, *whole.shape), np.int8)
        for t in range(size):
            here = equal[:, :, t : t + windows]
            step = np.where(here, errors, 100 if t in (0, size - 1) else errors + 1)
            if t in (0, size - 1):
                errors = np.minimum(step, 100).astype(np.int8)
                continue
            step[:-1] = np.minimum(step[:-1], errors[1:] + 1)  # the item's word is missing in the document
            for s in range(1, 2 * SHIFT + 1):  # the document has a word more
                step[s] = np.minimum(step[s], step[s - 1] + 1)
            errors = np.minimum(step, 100).astype(np.int8)
        return ((errors.min(0) <= size // ONE_ERROR_IN) & whole).any(1)


def passages(items: DataFrame, key: str, text: str) -> DataFrame:
    """(key, parts): the sentences of each item in order, each with whether it is an instruction, and its words.

    An instruction is a sentence that at least two items of different texts have, and at least INSTRUCTION_SHARE of
    all texts; it ends a run of sentences and belongs to none. A passage that a few of many items quote is none.
    """
    source = items.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["key"], T.StructField("body", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("sentence", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        for batch in batches:
            for part in slices(batch, 1):
                sentences = [SENTENCE_END.split(t) for t in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
                words, offsets = reader.read([s for one in sentences for s in one])
                bodies = [0] * len(sentences)
                hashes = []
                for i, o in enumerate(owner):
                    own = words[offsets[i] : offsets[i + 1]]
                    hashes.append(_fold(own))
                    bodies[o] = (bodies[o] * 1_000_003 + hashes[-1]) & 0x7FFFFFFFFFFFFFFF
                place = np.concatenate([np.arange(len(s)) for s in sentences]) if sentences else np.zeros(0)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array([bodies[o] for o in owner], pa.int64()), pa.array(place, pa.int32()), pa.array(hashes, pa.int64()), lists], schema.names)

    sentences = source.mapInArrow(cut, schema)
    bodies = sentences.select("sentence", "body").distinct()
    least = max(2, math.ceil(INSTRUCTION_SHARE * source.select("text").distinct().count()))
    shared = bodies.groupBy("sentence").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("sentence", F.lit(True).alias("shared"))
    marked = sentences.join(shared, "sentence", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("shared", F.lit(False)).alias("shared"), "words"))).alias("parts"))
    return marked


def _fold(words: np.ndarray) -> int:
    value = 0
    for word in words.tolist():
        value = (value * 1_000_003 + word + 1) & 0x7FFFFFFFFFFFFFFF
    return value


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The items' passages in blocks of bounded size: keys of the passages, words, offsets."""
    chars = items.agg(F.sum(F.length(text))).first()[0] or 0
    count = max(1, math.ceil(chars / BLOCK_CHARS))
    marked = passages(items, key, text)
    if count > 1:
        marked = marked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(count))).persist()
    for block in range(count):
        keys, words, sizes = [], [], []
        for row in (marked.where(F.col("block") == block) if count > 1 else marked).toLocalIterator():
            run: list[int] = []
            for part in [*row.parts, None]:
                if part is not None and not part.shared:
                    run += part.words
                elif len(run) >= LEAST_WORDS:
                    keys.append(row.key)
                    words += run
                    sizes.append(len(run))
                    run = []
                else:
                    run = []
        yield keys, np.array(words, np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if count > 1:
        marked.unpersist()


_INDEX: dict[str, EvalIndex] = {}


def leaked_items(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key): documents that hold at least 15 words in a row of an item, up to one word in eight wrong.

    Case, punctuation, white space, markup, accents and letters drawn alike don't matter. Sentences that
    many items share are left out. Null and empty texts give no rows, very long ones are read whole, a repeated document gives its rows
    once for each repetition, empty tables an empty result; other columns are dropped. The evaluation texts go to the
    executors in blocks of at most BLOCK_CHARS characters, one pass over the documents for each; no shuffle of the
    documents.
    """
    spark = docs.sparkSession
    source = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("__doc"), F.col(doc_text).alias("__text"))
    item_type = items.schema[item_key].dataType
    schema = T.StructType([T.StructField(doc_key, source.schema["__doc"].dataType), T.StructField(item_key, item_type)])
    result = None
    for keys, words, offsets in _blocks(items, item_key, item_text):
        names = list(dict.fromkeys(keys))
        number = {key: i for i, key in enumerate(names)}
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, names, np.array([number[key] for key in keys], np.int64), words, offsets))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            token, names, item_of, words, offsets = sent.value
            if not names:
                return
            if token not in _INDEX:  # one index a worker, not one a task
                _INDEX.clear()
                _INDEX[token] = EvalIndex(words, offsets)
            index, reader = _INDEX[token], WordReader()
            owner = pa.array(names)
            for batch in batches:
                for part in slices(batch, 1):
                    texts, at = reader.read(part.column(1).to_pylist())
                    doc, passage = index.matches(texts, at)
                    pairs = np.unique(np.stack([doc, item_of[passage]]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pairs[0])), owner.take(pa.array(pairs[1]))], schema.names)

        part = source.mapInArrow(find, schema)
        result = part if result is None else result.unionByName(part)
    return result
