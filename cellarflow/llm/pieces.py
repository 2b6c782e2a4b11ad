"""Texts as arrays of numbers: each distinct white-space piece is worked out once per worker and then looked up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from cellarflow.functions.codepoints import ranges
from cellarflow.llm.looks import ALIKE_CYRILLIC, ALIKE_GREEK, look_column

SLICE_BYTES = 8 << 20
MOST_HELD, MOST_BYTES = 400_000, 64 << 20  # pieces, and their characters, that a worker remembers before it starts anew; no effect on results

TAG = re.compile(r"</?[a-z][^<>]*>|<\|[^<>|]*\|>")
SPACED_TAG = re.compile(r"<[/a-zA-Z][^<>\s]*\s[^<>]*>")
WORD = re.compile(r"[^\W_]+")
_MARKS = dict.fromkeys(range(0x300, 0x370))
# letters drawn alike in capitals count as alike in small letters too, so that case can be dropped
_CASELESS = {ord(x.lower()): g[0].lower() for g in (ALIKE_CYRILLIC + " " + ALIKE_GREEK).split() for x in g[1:]}


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have at most about ``most`` bytes, or one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def plain(texts: list[str]) -> list[str]:
    """Texts without case, accents and other writings of letters drawn alike."""
    import unicodedata

    folded = look_column(pa.array(texts, pa.string())).to_pylist()
    out = []
    for text in folded:
        text = text.lower()
        if not text.isascii():
            text = unicodedata.normalize("NFD", text).translate(_MARKS).translate(_CASELESS)
        else:
            text = text.translate(_CASELESS)
        out.append(text)
    return out


def piece_words(pieces: list[str]) -> list[list[str]]:
    """Words of each piece: plain, without markup and punctuation."""
    return [WORD.findall(TAG.sub(" ", p) if "<" in p else p) for p in plain(pieces)]


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []
        self.held = 0  # characters of all keys

    def __missing__(self, key) -> int:
        self.fresh.append(key)
        self[key] = number = len(self)
        return number

    def taken(self) -> list:
        fresh, self.fresh = self.fresh, []
        self.held += sum(map(len, fresh))
        return fresh

    def full(self) -> bool:
        return len(self) > MOST_HELD or self.held > MOST_BYTES


class Lists:
    """Lists of numbers end to end, by list number."""

    def __init__(self, dtype) -> None:
        self.dtype = dtype
        self.values, self.sizes, self.starts = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        starts = len(self.values) + np.cumsum(sizes) - sizes
        self.values = np.concatenate([self.values, values.astype(self.dtype)])
        self.sizes, self.starts = np.concatenate([self.sizes, sizes]), np.concatenate([self.starts, starts])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        return self.values[ranges(self.starts[numbers], sizes)], sizes


class WordReader:
    """Texts as arrays of word values; ``value`` gives the values of the distinct pieces that are new."""

    def __init__(self, dtype=np.uint64, value: Callable[[list[str]], list[list[int]]] | None = None):
        self.dtype = dtype
        self.value = value or (lambda pieces: [[word_hash(w) for w in words] for words in piece_words(pieces)])
        self.reset()

    def reset(self) -> None:
        self.pieces, self.lists = Numbered(), Lists(self.dtype)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts end to end, and the offsets of the texts."""
        if self.pieces.full():
            self.reset()
        numbers, counts = [], []
        look_up = self.pieces.__getitem__
        for text in texts:
            if "<" in text:
                text = SPACED_TAG.sub(" ", text)
            parts = text.split()
            numbers.extend(map(look_up, parts))
            counts.append(len(parts))
        fresh = self.pieces.taken()
        if fresh:
            lists = self.value(fresh)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.lists.append(np.array([x for one in lists for x in one], self.dtype), sizes)
        values, sizes = self.lists.take(np.array(numbers, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return values, ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
