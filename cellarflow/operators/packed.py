"""Several values packed in one field: one row per value, its position kept.

The columns are scanned as code-point arrays: quote parity and bracket depth come from cumulative sums, delimiters
from a lookup table and masks, and the child offsets and parent ordinals from the positions that remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.functions.codepoints import from_codepoints, ranges, to_codepoints

# What may part two values, white space, and paired signs that hold a value together.
DELIMITERS = ",;/|\n\r\t+&•·"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
QUOTE = '"'
OPENING = "«“„(["
CLOSING = "»””)]"
OUTER_QUOTES = ('""', "«»", "“”", "„“", "„”")
AND_WORD = "и"
WORD_SIGNS = "_-'’‐‑"

_DELIMITER, _SPACE, _OPEN, _CLOSE, _DIGIT, _WORD = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for signs, flag in ((DELIMITERS, _DELIMITER), (SPACES, _SPACE), (OPENING, _OPEN), (CLOSING, _CLOSE)):
        for sign in signs:
            table[ord(sign)] |= flag
    for point in range(0x10000):
        if not 0xD800 <= point < 0xE000:
            sign = chr(point)
            table[point] |= _DIGIT * sign.isdecimal() | _WORD * (sign.isalnum() or sign in WORD_SIGNS)
    return table


_CLASSES = _classes()


def _row_sums(values: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Inclusive cumulative sums that begin anew at each row; row_start: of each point, where its row begins."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[1:] - total[row_start]


def split_packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Values of all rows: the parent's ordinal, the position from 1 within the parent, and the value.

    Null, empty and blank rows have no values. A quote or bracket that is never closed is an ordinary sign.
    """
    points, offsets = to_codepoints(column)
    lengths = np.diff(offsets)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.large_string())
    row = np.repeat(np.arange(len(lengths)), lengths)
    start, end = offsets[:-1][row], offsets[1:][row]
    kind = _CLASSES[np.minimum(points, 0xFFFF)]
    at = np.arange(n)

    # a quote in an odd place opens, the next closes; the last one of an odd number in a row is an ordinary sign
    quote = points == ord(QUOTE)
    seen = _row_sums(quote, start)
    odd = np.zeros(len(lengths), np.int64)
    np.maximum.at(odd, row[quote], seen[quote])
    quote &= ~((odd[row] % 2 == 1) & (seen == odd[row]))
    quoted = _row_sums(quote, start) % 2 == 1

    # an opening sign counts if the depth after it is left again, a closing one if it doesn't go below zero
    opened = ((kind & _OPEN) > 0) & ~quoted
    closed = ((kind & _CLOSE) > 0) & ~quoted
    inside = np.zeros(n, bool)
    if opened.any() and closed.any():
        depth = _row_sums(opened.astype(np.int64) - closed, start)
        last = np.zeros(len(lengths), np.int64)
        np.add.at(last, row[opened], 1)
        np.subtract.at(last, row[closed], 1)
        lowest = np.zeros(len(lengths), np.int64)
        np.minimum.at(lowest, row, depth)
        sound = (last == 0) & (lowest == 0)
        inside = (depth > 0) & sound[row]
        for r in np.flatnonzero(~sound & (np.bincount(row[opened], minlength=len(lengths)) > 0)):
            inside[offsets[r] : offsets[r + 1]] = _matched_inside(opened[offsets[r] : offsets[r + 1]], closed[offsets[r] : offsets[r + 1]])

    free = ~quoted & ~inside
    cut = ((kind & _DELIMITER) > 0) & free
    before = np.where(at > start, np.roll(kind, 1), 0)
    after = np.where(at + 1 < end, np.roll(kind, -1), 0)
    cut &= ~((points == ord(",")) & ((before & _DIGIT) > 0) & ((after & _DIGIT) > 0))
    alone = ((before & _WORD) == 0) & ((after & _WORD) == 0)
    cut |= ((points == ord(AND_WORD)) | (points == ord(AND_WORD.upper()))) & free & alone

    # pieces lie between the row's start, the cuts and the row's end
    where = np.flatnonzero(cut)
    piece_row = np.concatenate([np.arange(len(lengths)), row[where]])
    piece_start = np.concatenate([offsets[:-1], where + 1])
    order = np.lexsort((piece_start, piece_row))
    piece_row, piece_start = piece_row[order], piece_start[order]
    following = np.concatenate([piece_start[1:] - 1, [offsets[-1]]])
    is_last = np.concatenate([piece_row[1:] != piece_row[:-1], [True]])
    piece_end = np.where(is_last, offsets[1:][piece_row], following)

    piece_start, piece_end = _trim(kind, piece_start, piece_end)
    unquoted = np.zeros(len(piece_row), bool)
    full = piece_end - piece_start >= 2
    first = np.where(full, points[np.minimum(piece_start, n - 1)], 0)
    final = np.where(full, points[np.maximum(piece_end - 1, 0)], 0)
    closes_first = _first_close(row, quote, piece_start)
    for pair in OUTER_QUOTES:
        hit = full & (first == ord(pair[0])) & (final == ord(pair[1]))
        if pair == QUOTE * 2:  # the first quote's partner has to be the last sign; doubled quotes between are text
            hit &= closes_first == piece_end - 1
            unquoted |= hit
        piece_start, piece_end = piece_start + hit, piece_end - hit
        first, final = np.where(hit, 0, first), np.where(hit, 0, final)
    piece_start, piece_end = _trim(kind, piece_start, piece_end)

    keep = piece_end > piece_start
    piece_row, piece_start, piece_end, unquoted = piece_row[keep], piece_start[keep], piece_end[keep], unquoted[keep]
    size = piece_end - piece_start
    take = ranges(piece_start, size)
    # of a doubled quote inside quotes the second is dropped
    owner = np.repeat(np.arange(len(size)), size)
    is_quote = (points[take] == ord(QUOTE)) & unquoted[owner]
    inner = _row_sums(is_quote, np.repeat(np.cumsum(size) - size, size))
    drop = is_quote & (inner % 2 == 0)
    size = size - np.bincount(owner[drop], minlength=len(size)).astype(np.int64) if drop.any() else size
    values = from_codepoints(points[take[~drop]], np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    new_row = np.concatenate([[True], piece_row[1:] != piece_row[:-1]])[: len(piece_row)]
    ordinal = np.arange(len(piece_row)) - np.maximum.accumulate(np.where(new_row, np.arange(len(piece_row)), 0)) + 1
    return piece_row, ordinal.astype(np.int32), values


def _trim(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves both ends inwards past white space."""
    n = len(kind)
    solid = np.flatnonzero((kind & _SPACE) == 0)
    solid_after = np.append(solid, n)
    next_solid = solid_after[np.searchsorted(solid, start)]
    last_solid = np.concatenate([[-1], solid])[np.searchsorted(solid, end)] + 1
    start = np.minimum(next_solid, end)
    return start, np.maximum(np.minimum(end, last_solid), start)


def _first_close(row: np.ndarray, quote: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where the quote that opens at ``start`` is closed: the next single quote, doubled ones passed over."""
    where = np.flatnonzero(quote)
    if not len(where):
        return np.full(len(start), -1)
    k = np.arange(len(where))
    # runs of adjacent quotes: in a run after the opening one, pairs are text and an odd one closes
    new = np.concatenate([[True], (np.diff(where) > 1) | (np.diff(row[where]) > 0)])
    run = np.cumsum(new) - 1
    run_start = k[new]
    run_size = np.diff(np.append(run_start, len(where)))
    i = np.minimum(np.searchsorted(where, start), len(where) - 1)
    in_run = run[i]
    left = run_start[in_run] + run_size[in_run] - i  # quotes of this run from the opening one on
    closing_here = left % 2 == 0  # opening one, text pairs, closing one
    odd_run = np.where(run_size % 2 == 1, np.arange(len(run_size)), len(run_size))
    next_odd = np.append(np.minimum.accumulate(odd_run[::-1])[::-1], len(run_size))[np.minimum(in_run + 1, len(run_size))]
    ends = np.append(where[run_start + run_size - 1], -1)
    return np.where(closing_here, ends[in_run], ends[np.minimum(next_odd, len(run_size))])


def _matched_inside(opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """Of one row with unmatched signs: what lies inside matched ones."""
    stack, inside = [], np.zeros(len(opened), bool)
    for i in np.flatnonzero(opened | closed):
        if opened[i]:
            stack.append(i)
        elif stack:
            inside[stack.pop() : i + 1] = True
    return inside


def explode_packed(df: DataFrame, keys: list[str], column: str, position: str = "pos_no", value: str = "value") -> DataFrame:
    """``keys`` of each row with every value packed in ``column``, a string or an array of strings.

    Rows: one per value, ``position`` (int from 1, running on through the elements of an array) in reading order.
    Null, empty and blank fields, null elements and an empty table give no rows; repeated rows are split each on
    its own; columns not named in ``keys`` are dropped, so their names can't clash. No shuffle.
    """
    packed = df.select(*keys, F.col(column).alias("__packed"))
    is_array = isinstance(packed.schema["__packed"].dataType, T.ArrayType)
    fields = [packed.schema[k] for k in keys] + [T.StructField(position, T.IntegerType()), T.StructField(value, T.StringType())]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(len(keys))
            if is_array:
                parents = cell.value_parent_indices().to_numpy(zero_copy_only=False)
                row, _, values = split_packed(cell.flatten())
                row = parents[row] if len(row) else row
            else:
                row, _, values = split_packed(cell)
            new = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
            place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) + 1 if len(row) else row
            index = pa.array(row, pa.int64())
            columns = [batch.column(i).take(index) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.int32()), values.cast(pa.string())], [*keys, position, value])

    return packed.mapInArrow(split, T.StructType(fields))
