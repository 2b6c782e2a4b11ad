"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut at the places where white space follows other signs; each distinct piece is encoded once per worker and
looked up from then on. The words of a batch that are new are merged together: a linked list of tokens over all of
them, one bucket of list positions per merge rank, and a hierarchical bitmap over the buckets whose first set bit is
the next rank. A bucket is merged at once with numpy; entries whose pair has changed meanwhile are skipped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.llm.pieces import Lists, Numbered, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: Unicode White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
# Fixed value: the vocabulary's own split of text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", SPACE))
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SPACE_BEFORE_SPACE = re.compile(f"[{SPACE}] ")


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> dict[str, np.ndarray]:
    """Arrays of a byte-level vocabulary file: ids of the 256 bytes; left, right and new id of each merge by rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    # printable bytes stand for themselves, the others for the code points from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return {
        "bytes": np.array([vocab[sign[b]] for b in range(256)], np.int64),
        "left": np.array([vocab[a] for a, _ in pairs], np.int64),
        "right": np.array([vocab[b] for _, b in pairs], np.int64),
        "new": np.array([vocab[a + b] for a, b in pairs], np.int64),
    }


class RankBitmap:
    """A set of ranks in three levels of 64-bit words, whose smallest member is found by three find-first-set."""

    def __init__(self, size: int):
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> int:
        """Removes and returns the smallest rank, -1 if there is none."""
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        j = i << 6 | (self.mid[i] & -self.mid[i]).bit_length() - 1
        rank = j << 6 | (self.low[j] & -self.low[j]).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        return rank


class Encoder:
    """Encodes lists of texts; remembers the ids of pieces and words between calls."""

    def __init__(self, vocabulary: dict[str, np.ndarray]):
        self.v = vocabulary
        self.none = len(vocabulary["new"])
        keys = vocabulary["left"] << 32 | vocabulary["right"]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.reset()

    def reset(self) -> None:
        self.pieces, self.words = Numbered(), Numbered()
        self.piece_ids, self.word_ids = Lists(np.int32), Lists(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[i] == key, self.ranks[i], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.v["bytes"][np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        if n == 0:
            return tok, sizes
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends[sizes > 0] - 1] = n  # n: no neighbour in the word
        before[(ends - sizes)[sizes > 0]] = -1
        tok = np.append(tok, -1)
        held = np.full(n, self.none)  # of each live position, the rank of its pair
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(self.none)

        def push(positions: np.ndarray) -> None:
            ranks = self.rank(tok[positions], tok[after[positions]])
            held[positions] = ranks
            positions, ranks = positions[ranks < self.none], ranks[ranks < self.none]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            for rank, a, b in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)]):
                if rank in buckets:
                    buckets[rank].append(positions[a:b])
                else:
                    buckets[rank] = [positions[a:b]]
                    bitmap.add(rank)

        push(np.flatnonzero(after < n))
        while (rank := bitmap.pop()) >= 0:
            parts = buckets.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[held[at] == rank]  # the others are stale
            if not len(at):
                continue
            if self.v["left"][rank] == self.v["right"][rank]:  # in a run of equal tokens every other pair merges
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            tok[at] = self.v["new"][rank]
            held[gone] = self.none
            tok[gone] = -1
            held[at] = self.none
            after[at] = beyond
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            lefts = before[at]
            changed = np.unique(np.concatenate([at[inner], lefts[lefts >= 0]]))
            if len(changed):
                push(changed)
        live = tok[:n] >= 0
        return tok[:n][live], np.bincount(word[live], minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if self.pieces.full() or self.words.full():
            self.reset()
        numbers, counts = [], []
        look_up = self.pieces.__getitem__
        for text in texts:
            if SPACE_BEFORE_SPACE.search(text):
                parts = PIECES.findall(text)
            else:
                parts = text.split(" ")
                first = parts.pop(0)
                parts = [" " + p for p in parts]
                if first:
                    parts.insert(0, first)
            numbers.extend(map(look_up, parts))
            counts.append(len(parts))
        self._learn()
        ids, sizes = self.piece_ids.take(np.array(numbers, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return ids, np.diff(ends)

    def _learn(self) -> None:
        """Encodes the pieces, and of those the words, that turned up since the last call."""
        fresh = self.pieces.taken()
        if not fresh:
            return
        numbers, counts = [], []
        for piece in fresh:
            parts = WORDS.findall(piece)
            numbers.extend(map(self.words.__getitem__, parts))
            counts.append(len(parts))
        new_words = self.words.taken()
        if new_words:
            self.word_ids.append(*self.merge([w.encode("utf-8", "surrogatepass") for w in new_words]))
        ids, sizes = self.word_ids.take(np.array(numbers, np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        self.piece_ids.append(ids, np.diff(ends))


_ENCODERS: dict[str, Encoder] = {}


def encode_corpus(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY, ids: str = "ids") -> DataFrame:
    """``key`` and the list of token ids of ``text``, without special tokens: their spellings are plain text.

    One row per row of ``df``, repeated rows included. Null and empty texts give the empty list; white space is text;
    texts of any length are encoded whole. Other columns are dropped. No shuffle: one Arrow pass with the vocabulary
    (its size is that of the file, about 1 MB) sent to the executors once.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    source = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField(key, source.schema["__key"].dataType), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(vocabulary.value)
        encoder = _ENCODERS[path]
        for whole in batches:
            for batch in slices(whole, 1):
                flat, sizes = encoder.encode(pc.fill_null(batch.column(1), "").to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, ids])

    return source.mapInArrow(encode, schema)
