"""Extension points: readers (text to lines) and embedders (texts to unit vectors) by name, as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Reader = Callable[[str], list[str]]
Embedder = Callable[[list[str]], np.ndarray]

READERS: dict[str, Reader] = {}
EMBEDDERS: dict[str, Embedder] = {}


def register_reader(name: str, reader: Reader) -> None:
    """Adds a reader; a taken name is an error."""
    if name in READERS:
        raise ValueError(f"reader twice: {name}")
    READERS[name] = reader


def register_embedder(name: str, embedder: Embedder) -> None:
    """Adds an embedder; a taken name is an error."""
    if name in EMBEDDERS:
        raise ValueError(f"embedder twice: {name}")
    EMBEDDERS[name] = embedder


def read_lines(df: DataFrame, column: str, reader: str, name: str = "lines") -> DataFrame:
    """``df`` with the lines that a reader makes of a column; null stays null, a failure of the reader fails the task."""
    read = READERS[reader]

    @F.pandas_udf("array<string>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else read(x))

    return df.withColumn(name, apply(F.col(column)))


def embed(df: DataFrame, column: str, embedder: str, name: str = "vec") -> DataFrame:
    """``df`` with a unit vector of each value of a column, a batch at a time; null stays null."""
    model = EMBEDDERS[embedder]

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna().to_numpy()
            if not known.any():
                yield pd.Series([None] * len(batch), dtype=object)
                continue
            made = np.asarray(model(batch[known].tolist()), np.float64)
            made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
            rows = iter(made.tolist())
            yield pd.Series([next(rows) if k else None for k in known])

    return df.withColumn(name, apply(F.col(column)))


def split_lines(text: str) -> list[str]:
    return [line.strip() for line in text.splitlines() if line.strip()]


def letter_counts(texts: list[str]) -> np.ndarray:
    """A deterministic embedder for tests and examples: hashed letter pairs in 32 places."""
    out = np.zeros((len(texts), 32))
    for i, text in enumerate(texts):
        for a, b in zip(text, text[1:]):
            out[i, (ord(a) * 31 + ord(b)) % 32] += 1
    return out


register_reader("lines", split_lines)
register_embedder("letters", letter_counts)
