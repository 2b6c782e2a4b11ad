"""The nearest good rows of each bad one for many groups that judge the same rows, without moving the pairs of rows and groups."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD, GOOD = 1, 2
_AT_ONCE = 100_000  # rows that are scanned together, if a block isn't larger, and pairs of a batch
_INF = int(np.array(np.inf).view(np.int64))  # distances are compared by their bits: infinite ones, then NaN, null, and none at all
_NONE = _INF + 3


class _Rows(NamedTuple):
    """Rows by block; within one by price and key, behind them those whose price can't be compared, by what it is and key."""

    block: np.ndarray
    level: np.ndarray  # counts the prices of all blocks
    price: np.ndarray
    rank: np.ndarray  # the key, null last
    odd: np.ndarray | None  # the distance to a price that can't be compared, 0 to others; None if there are no such prices
    orders: dict[int, tuple[np.ndarray, np.ndarray]]  # rows of such a price, and all rows by their distance from it
    close: bool  # whether distances to different prices may be rounded to the same


def _nearest(r: _Rows, verdict: np.ndarray) -> list[np.ndarray] | None:
    """Bad row, good row and place from 1 of the two nearest of each bad one, equally near ones by key."""
    bad, good = np.flatnonzero(verdict == BAD), np.flatnonzero(verdict == GOOD)
    if not len(bad) or not len(good):
        return None
    plain = bad if r.odd is None else bad[r.odd[bad] == 0]
    levels, last = r.level[good], len(good) - 1
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], levels[1:] != levels[:-1]]), np.arange(len(good)), 0))
    of, at = r.block[plain], r.price[plain]

    def met(k):
        """The k-th good row of each bad one and its distance."""
        row = good[np.clip(k, 0, last)]
        far = np.abs(at - r.price[row]).view(np.int64)
        if r.odd is not None:
            far = np.where(r.odd[row] > 0, r.odd[row], far)
        return row, np.where((k >= 0) & (k <= last) & (r.block[row] == of), far, _NONE)

    def nearer(a, b):
        less = (a[1] < b[1]) | ((a[1] == b[1]) & (r.rank[a[0]] <= r.rank[b[0]]))
        return less, [np.where(less, x, y) for x, y in zip(a, b)]

    before = lambda k: np.where(k > 0, begin[np.maximum(k - 1, 0)], -1)  # noqa: E731  # of the price before, the lowest key
    up = np.searchsorted(levels, r.level[plain], "right")
    low = before(up)
    two = (low >= 0) & (low + 1 < up)
    low_2 = np.where(two, low + 1, before(low))
    below, below_2, above, above_2 = met(low), met(low_2), met(up), met(up + 1)
    down, first = nearer(below, above)
    second = [np.where(down, x, y) for x, y in zip(nearer(below_2, above)[1], nearer(below, above_2)[1])]
    if r.close:  # the lowest keys may stand at prices further off
        further = met(before(np.where(two, low, low_2))), met(np.searchsorted(levels, levels[np.clip(up + 1, 0, last)], "right"))
        same = [(a[1] == b[1]) & (a[1] < _INF) & (r.level[a[0]] != r.level[b[0]]) for a, b in ((below, below_2), (below_2, further[0]), (above, above_2), (above_2, further[1]))]
        for i in np.flatnonzero(np.logical_or.reduce(same)):
            rows = good[slice(*np.searchsorted(r.block[good], [of[i], of[i] + 1]))]
            rows = rows if r.odd is None else rows[r.odd[rows] == 0]
            first[0][i], second[0][i] = rows[np.lexsort((r.rank[rows], np.abs(at[i] - r.price[rows])))[:2]]
    found = [(plain, *first, 1), (plain, *second, 2)]
    for mine, order in r.orders.values():
        rest = mine[verdict[mine] == BAD]
        rows = order[verdict[order] == GOOD]
        start = np.searchsorted(r.block[rows], r.block[rest])
        for place in (1, 2):
            row = rows[np.minimum(start + place - 1, last)]
            found.append((rest, row, np.where((start + place - 1 <= last) & (r.block[row] == r.block[rest]), 0, _NONE), place))
    kept = [(a[there], b[there], np.full(there.sum(), place, np.int32)) for a, b, far, place in found for there in [far < _NONE]]
    return [np.concatenate(x) for x in zip(*kept)]


def _rows(t: pa.Table) -> _Rows:
    new, odd = t["new"].to_numpy(), t["odd"].to_numpy()
    price = pc.fill_null(t["price"], np.nan).to_numpy()
    rank = pc.fill_null(t["key"], np.iinfo(np.int64).max).to_numpy()
    block, known = np.cumsum(new), odd == 0
    step = np.diff(np.where(known, price, 0))
    alike = ~new[1:] & known[1:] & known[:-1]
    level = np.concatenate([[0], np.cumsum(~alike | (step != 0))])
    close = bool((alike & (step > 0) & (step <= 4 * np.spacing(np.abs(price[known]).max(initial=0)))).any())
    if known.all():
        return _Rows(block, level, price, rank, None, {}, close)
    orders = {}
    kinds = np.where((odd == 1) & (price < 0), 4, odd)  # 1 and 4 the infinite prices, 2 NaN, 3 null
    for k in np.unique(kinds[~known]):
        far = np.zeros(len(odd)) if k == 3 else kinds == 3 if k == 2 else np.where(kinds == 3, 2, (kinds == 2) | (kinds == k))
        orders[int(k)] = np.flatnonzero(kinds == k), np.lexsort((rank, far, block))
    return _Rows(block, level, price, rank, np.where(known, 0, _INF - 1 + odd.astype(np.int64)), orders, close)


def _scan(t: pa.Table, groups: dict[str, np.ndarray], verdicts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of whole blocks of one share of the groups."""
    rows, key, code = _rows(t), t["key"].combine_chunks(), t["code"].to_numpy()
    value = pc.fill_null(t["value"], np.nan).to_numpy()
    held, n = [], 0
    for g in range(t["share"][0].as_py(), len(groups["number"]), t["shares"][0].as_py()):
        fits = (value >= groups["first"][g]) & (value <= groups["last"][g])
        found = _nearest(rows, verdicts[groups["code"][g]][fits.view(np.int8), code])
        if found:
            held.append((np.full(len(found[0]), groups["number"][g]), *found))
            n += len(found[0])
        if n and (n >= _AT_ONCE or g + t["shares"][0].as_py() >= len(groups["number"])):
            number, asked, near, place = (np.concatenate(x) for x in zip(*held))
            for i in range(0, n, _AT_ONCE):
                part = slice(i, i + _AT_ONCE)
                yield pa.RecordBatch.from_arrays([pa.array(number[part]), key.take(pa.array(asked[part])), key.take(pa.array(near[part])), pa.array(place[part])], names=["number", "asked", "near", "place"])
            held, n = [], 0


def two_nearest(rows: DataFrame, groups: dict[str, np.ndarray], verdicts: np.ndarray, tasks: int) -> DataFrame:
    """(number, asked, near, place): for each group, the nearest two good rows of each bad row of the same block.

    ``rows`` has block, key, price, value and code; the nearest are those with the least distance of price, then the least
    key, null last; a missing distance comes last. ``groups`` has arrays number, code, first and last; ``verdicts``, by a
    group's code, whether value lies between its first and last, and a row's code, says what a row is: BAD, GOOD or 0.

    Rows are sorted by block, and a task goes through its groups; no pair is shuffled. A block of more rows than a task's
    part is sent to several, and each goes through a share of the groups.
    """
    shares = F.ceil(F.col("n") * tasks / F.lit(max(rows.count(), 1))).cast("int")
    large = rows.groupBy("block").agg(F.count("*").alias("n")).where(shares > 1).select("block", shares.alias("shares"))  # at most as many as tasks
    rows = rows.join(F.broadcast(large), "block", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    price = F.col("price")
    odd = F.when(price.isNull(), 3).when(F.isnan(price), 2).when(F.abs(price) == float("inf"), 1).otherwise(0)
    order = ["block", "share", "odd", F.when(F.col("odd") == 0, price), F.col("key").asc_nulls_last()]
    rows = rows.withColumn("odd", odd).repartitionByRange(2 * tasks, "block", "share").sortWithinPartitions(*order)

    def scan(batches):
        held, n, most = [], 0, _AT_ONCE
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                *whole, rest = _blocks(held)
                for t in whole:
                    yield from _scan(t, groups, verdicts)
                held = rest.drop_columns("new").to_batches()
                n = rest.num_rows
                most = max(_AT_ONCE, 2 * n)  # of a block larger than that, not again for each batch
        for t in _blocks(held) if n else ():
            yield from _scan(t, groups, verdicts)

    return rows.select("block", "share", "shares", "key", "price", "value", "code", "odd").mapInArrow(scan, "number long, asked long, near long, place int")


def _blocks(batches: list[pa.RecordBatch]) -> list[pa.Table]:
    """Tables of whole blocks that look at the same groups; the last one has the last block, which may go on."""
    t = pa.Table.from_batches(batches).combine_chunks()
    changed = lambda *names: np.logical_or.reduce([np.concatenate([[True], pc.not_equal(t[c][1:], t[c][:-1]).to_numpy()]) for c in names])
    new = changed("block", "share")
    cuts = sorted({*np.flatnonzero(changed("share", "shares")).tolist(), int(np.flatnonzero(new)[-1]), t.num_rows})
    t = t.append_column("new", pa.array(new))
    return [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
