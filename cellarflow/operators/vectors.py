"""Vector retrieval: similarities, alignment of view blocks, best score per entity, top-k with margin, linear maps.

Query windows go to the executors in blocks of bounded size; each block is multiplied with pieces of the index, and what
the caller wants of the products (moments, row bests, the best entities) is taken at once, so the matrix of all scores
only leaves a task where it is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.session import Scratch

QUERY_BLOCK = 4_096  # query windows that are sent to the executors at once
PIECE = 1_024  # index rows that are multiplied at once
FLAT = 1e-6  # a block whose scores spread less than this is left as it is


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of numbers in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column | str) -> Column:
    """The vector scaled to length 1, as doubles; a zero vector stays, null stays null."""
    length = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(1.0))


@dataclass
class Block:
    """Query windows of one dimension, those of a query side by side."""

    matrix: np.ndarray
    windows: list
    queries: list
    starts: np.ndarray  # first window of each of ``queries``
    number: int = 0
    scale: dict | None = None  # of a view: factor and offset of each window
    flat: np.ndarray | None = None  # windows of queries that keep their scores


def _blocks(queries: DataFrame) -> list[Block]:
    held: dict[int, list] = {}
    blocks: list[Block] = []

    def close(dim: int) -> None:
        rows = held.pop(dim)
        names = [r.query for r in rows]
        starts = [i for i in range(len(rows)) if i == 0 or names[i] != names[i - 1]]
        blocks.append(Block(np.array([r.vec for r in rows], np.float64), [r.window for r in rows], [names[i] for i in starts], np.array(starts)))

    for row in queries.where("vec is not null and size(vec) > 0 and query is not null").select("query", "window", "vec").orderBy("query", "window").toLocalIterator():
        held.setdefault(len(row.vec), []).append(row)
        if len(held[len(row.vec)]) == QUERY_BLOCK:
            close(len(row.vec))
    for dim in list(held):
        close(dim)
    return blocks


def _scanned(index: DataFrame, blocks: list[Block], work: Callable, schema: str | T.StructType, skip_self: bool) -> DataFrame:
    """The union over blocks of ``work(pieces, block)``; a piece is a batch (row_id, slug, view, is_base) and its scores.

    Rows of another length than the block's windows are passed over; with ``skip_self`` a window's own row scores NaN.
    """
    spark = index.sparkSession
    rows = index.where("vec is not null").select("row_id", "slug", "view", "is_base", "vec")
    result = None
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            windows = np.array(block.windows)

            def pieces() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
                for batch in batches:
                    fits = np.flatnonzero(batch.column(4).value_lengths().to_numpy(zero_copy_only=False) == block.matrix.shape[1])
                    for a in range(0, len(fits), PIECE):
                        part = batch.take(pa.array(fits[a : a + PIECE]))
                        scores = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1) @ block.matrix.T
                        if skip_self:
                            scores[part.column(0).to_numpy(zero_copy_only=False)[:, None] == windows] = np.nan
                        yield part, scores

            yield from work(pieces(), block)

        part = rows.mapInArrow(scan, schema)
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], schema) if result is None else result


def _fields(index: DataFrame, queries: DataFrame, *names: str) -> list[T.StructField]:
    known = {f.name: f for f in [*index.schema.fields, *queries.schema.fields]}
    return [T.StructField(n, known[n].dataType) for n in names]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _cells(part: pa.RecordBatch, block: Block, at: np.ndarray, columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """Rows (query, window, row_id, slug, view, is_base, ...) of the cells ``at`` of a matrix rows x windows."""
    row, window = np.divmod(at, len(block.windows))
    query = np.searchsorted(block.starts, window, "right") - 1
    take = lambda values, i, kind: pa.array(values, kind).take(pa.array(i))
    made = [take(block.queries, query, schema.field(0).type), take(block.windows, window, schema.field(1).type), *[part.column(i).take(pa.array(row)) for i in range(4)], *columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)


def similarities(index: DataFrame, queries: DataFrame, skip_self: bool = False, align: bool = False) -> DataFrame:
    """(query, window, row_id, slug, view, is_base, sim): every index row against every query window.

    ``index`` has (row_id, slug, view, is_base, vec), ``queries`` (query, window, vec). The queries are read to the
    driver in blocks of QUERY_BLOCK windows, so what is sent at once is bounded; the index is never collected or shuffled.
    Null vectors, queries without a name and pairs of unequal length are left out; with ``skip_self`` so are pairs of a
    window and the row of the same id. ``align`` adds ``aligned``, as in the function of that name, without a shuffle.
    """
    blocks = _blocks(queries)
    if align:
        _fit_scale(index, queries, blocks, skip_self)
    schema = T.StructType([*_fields(index, queries, "query", "window", "row_id", "slug", "view", "is_base"), *[T.StructField(n, T.DoubleType()) for n in (["sim", "aligned"] if align else ["sim"])]])
    arrow = _arrow(schema)

    def work(pieces: Iterator, block: Block) -> Iterator[pa.RecordBatch]:
        for part, scores in pieces:
            at = np.flatnonzero(~np.isnan(scores.ravel()))
            columns = [pa.array(scores.ravel()[at])]
            if align:
                moved = _moved(part, scores, block).ravel()[at]
                columns.append(pa.array(moved, mask=np.isnan(moved)))
            yield _cells(part, block, at, columns, arrow)

    return _scanned(index, blocks, work, schema, skip_self)


def _fit_scale(index: DataFrame, queries: DataFrame, blocks: list[Block], skip_self: bool) -> None:
    """Sets each block's ``scale`` from sums of the scores by window and view, which each task adds up for itself.

    Only the sums leave the tasks, and of a block's windows only the factors by view come to the driver.
    """
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("at", T.IntegerType()), *_fields(index, queries, "query", "view"), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("ss", T.DoubleType())])
    arrow = _arrow(schema)

    def work(pieces: Iterator, block: Block) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for part, scores in pieces:
            base = part.column(3).fill_null(True).to_numpy(zero_copy_only=False)
            for view, rows in _by_view(part):
                x = scores[rows[base[rows]]]
                made = [(~np.isnan(x)).sum(0), np.nansum(x, 0), np.nansum(x * x, 0)]
                sums[view] = [a + b for a, b in zip(sums[view], made)] if view in sums else made
        number, width = block.number, len(block.windows)
        for view, (n, s, ss) in sums.items():
            query = pa.array(block.queries, arrow.field(2).type).take(pa.array(np.searchsorted(block.starts, np.arange(width), "right") - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width, number, np.int32)), pa.array(np.arange(width, dtype=np.int32)), query, pa.array([view] * width, arrow.field(3).type), pa.array(n), pa.array(s), pa.array(ss)], schema=arrow)

    for k, block in enumerate(blocks):
        block.number = k
    sums = _scanned(index, blocks, work, schema, skip_self)
    add = [F.sum(c).alias(c) for c in ("n", "s", "ss")]
    sums = Scratch(index.sparkSession, "moments").save(sums.groupBy("block", "at", "query", "view").agg(*add).where("n > 0"), "sums")
    mean, spread = F.col("s") / F.col("n"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)))
    whole = sums.groupBy("query").agg(*add).select("query", mean.alias("m"), spread.alias("d"))
    factors = sums.select("block", "at", "query", "view", mean.alias("bm"), spread.alias("bd")).join(whole, "query")
    for k, block in enumerate(blocks):
        # a query that is flat altogether keeps the scores of all its views, those without base rows included
        block.scale, flat = {}, np.zeros(len(block.windows), bool)
        for r in factors.where(F.col("block") == k).collect():  # at most QUERY_BLOCK windows times the views
            a, b = block.scale.setdefault(r.view, (np.full(len(block.windows), np.nan), np.full(len(block.windows), np.nan)))
            factor = 1.0 if r.d < FLAT or r.bd < FLAT else r.d / r.bd
            a[r["at"]], b[r["at"]] = factor, 0.0 if r.d < FLAT or r.bd < FLAT else r.m - factor * r.bm
            flat[r["at"]] |= r.d < FLAT
        block.flat = flat


def _by_view(part: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    views = part.column(2).dictionary_encode(null_encoding="encode")
    codes = views.indices.to_numpy(zero_copy_only=False)
    for code, view in enumerate(views.dictionary.to_pylist()):
        yield view, np.flatnonzero(codes == code)


def _moved(part: pa.RecordBatch, scores: np.ndarray, block: Block) -> np.ndarray:
    out = np.empty_like(scores)
    missing = (np.where(block.flat, 1.0, np.nan), np.where(block.flat, 0.0, np.nan))
    for view, rows in _by_view(part):
        a, b = block.scale.get(view, missing)
        out[rows] = scores[rows] * np.where(block.flat, 1.0, a) + np.where(block.flat, 0.0, b)
    return out


def aligned(sims: DataFrame, score: str = "sim") -> DataFrame:
    """``sims`` with ``aligned``: each block (query, window, view) brought to the mean and spread of the whole query.

    Means and population deviations are taken over base rows only, all rows are aligned. A block that is flat keeps
    its scores, and so does a query that is flat altogether. For scores that are there already; ``similarities`` and
    ``search`` align while they multiply.
    """
    base = F.when(F.coalesce("is_base", F.lit(True)), F.col(score))
    blocks = sims.groupBy("query", "window", "view").agg(F.avg(base).alias("block_mean"), F.stddev_pop(base).alias("block_sd"))
    wholes = sims.groupBy("query").agg(F.avg(base).alias("mean"), F.stddev_pop(base).alias("sd"))
    moved = F.col("mean") + F.col("sd") * (F.col(score) - F.col("block_mean")) / F.col("block_sd")
    joined = sims.join(blocks, ["query", "window", "view"]).join(wholes, "query")
    return joined.withColumn("aligned", F.when((F.col("sd") < FLAT) | (F.col("block_sd") < FLAT), F.col(score)).otherwise(moved)).drop("block_mean", "block_sd", "mean", "sd")


def _row_bests(scores: np.ndarray, block: Block) -> np.ndarray:
    """The best window of each query for each row, -inf where there is none."""
    return np.maximum.reduceat(np.where(np.isnan(scores), -np.inf, scores), block.starts, axis=1)


def best_window(index: DataFrame, queries: DataFrame, skip_self: bool = False) -> DataFrame:
    """(query, row_id, slug, view, best): the best window of each query for each index row."""
    blocks = _blocks(queries)
    schema = T.StructType([*_fields(index, queries, "query", "row_id", "slug", "view"), T.StructField("best", T.DoubleType())])
    arrow = _arrow(schema)

    def work(pieces: Iterator, block: Block) -> Iterator[pa.RecordBatch]:
        for part, scores in pieces:
            best = _row_bests(scores, block).ravel()
            at = np.flatnonzero(best > -np.inf)
            row, query = np.divmod(at, len(block.queries))
            made = [pa.array(block.queries, arrow.field(0).type).take(pa.array(query)), *[part.column(i).take(pa.array(row)) for i in range(3)], pa.array(best[at])]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    found = _scanned(index, blocks, work, schema, skip_self)
    return found if len(blocks) < 2 else found.groupBy("query", "row_id", "slug", "view").agg(F.max("best").alias("best"))


AGGREGATIONS = ("max", "mean", "zmax")


def per_slug(index: DataFrame, queries: DataFrame, how: str = "max", k: int | None = None, skip_self: bool = False) -> DataFrame:
    """(query, slug, score, view, first): the score of an entity over its rows and the view that gave the best one.

    ``how``: max, mean, or zmax (max of aligned scores); of equal scores the smaller row gives the view, and ``first``
    is the entity's smallest row. Row ids are numbers; rows without a slug belong to no entity. With ``k`` (max and
    zmax) all entities among the k best of a query are there, but not all others: the best row of such an entity is
    among the k best entities of its piece, and a task never gives less than the k-th best score it has seen.
    """
    blocks = _blocks(queries)
    index = index.where("slug is not null")
    if how == "zmax":
        _fit_scale(index, queries, blocks, skip_self)
    schema = T.StructType([*_fields(index, queries, "query", "slug", "view", "row_id"), T.StructField("best", T.DoubleType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    arrow = _arrow(schema)

    def work(pieces: Iterator, block: Block) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(block.queries), -np.inf)
        for part, scores in pieces:
            best = _row_bests(_moved(part, scores, block) if how == "zmax" else scores, block)
            slugs = part.column(1).dictionary_encode()
            code = slugs.indices.to_numpy(zero_copy_only=False)
            order = np.lexsort((part.column(0).to_numpy(zero_copy_only=False), code))
            best, code = best[order], code[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            top = np.maximum.reduceat(best, first, axis=0)
            lengths = np.diff(first, append=len(code))
            row = np.minimum.reduceat(np.where(best == np.repeat(top, lengths, axis=0), np.arange(len(code))[:, None], len(code)), first, axis=0)
            known = best > -np.inf
            total, n = np.add.reduceat(np.where(known, best, 0.0), first, axis=0), np.add.reduceat(known.astype(np.int64), first, axis=0)
            if k is not None and how != "mean":
                if len(first) >= k:
                    floor = np.maximum(floor, np.partition(top, len(first) - k, axis=0)[len(first) - k])
                keep = (top >= floor) & (n > 0)
            else:
                keep = n > 0
            at = np.flatnonzero(keep.ravel())
            group, query = np.divmod(at, len(block.queries))
            source = pa.array(order[row.ravel()[at]])
            made = [pa.array(block.queries, arrow.field(0).type).take(pa.array(query)), *[part.column(i).take(source) for i in (1, 2, 0)], *[pa.array(x.ravel()[at]) for x in (top, total, n)]]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    found = _scanned(index, blocks, work, schema, skip_self)
    view = F.max_by("view", F.struct("best", (-F.col("row_id")).alias("first")))
    score = F.sum("total") / F.sum("n") if how == "mean" else F.max("best")
    if how == "mean" and len(blocks) > 1:  # a query's windows may lie in two blocks: its row bests come first
        rows = best_window(index, queries, skip_self)
        scored = rows.groupBy("query", "slug").agg(F.avg("best").alias("score"), F.max_by("view", F.struct("best", (-F.col("row_id")).alias("first"))).alias("view"))
    else:
        scored = found.groupBy("query", "slug").agg(score.alias("score"), view.alias("view"))
    return scored.join(index.where("vec is not null").groupBy("slug").agg(F.min("row_id").alias("first")), "slug").select("query", "slug", "score", "view", "first")


def top_entities(scored: DataFrame, k: int, clip: bool) -> DataFrame:
    """(query, slug, score, view, rank, margin): the k best of each query.

    Of equal scores the one with the smaller ``first`` row comes first, by slug if there is no such column; scores
    are compared to twelve digits. The margin is that of the two best of all, 0 if there is one; ranks come from the
    unclipped score, the score that is reported is cut to [0, 1] with ``clip``, else only below 0.
    """
    order = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "first" if "first" in scored.columns else "slug")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 2))
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score"))).over(Window.partitionBy("query"))
    ranked = ranked.withColumn("margin", F.coalesce(F.greatest(at(1) - at(2), F.lit(0.0)), F.lit(0.0)))
    shown = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) if clip else F.greatest("score", F.lit(0.0))
    return ranked.where(F.col("rank") <= k).withColumn("score", shown).select("query", "slug", "score", "view", "rank", "margin")


def search(index: DataFrame, queries: DataFrame, k: int = 20, how: str = "zmax", skip_self: bool = False) -> DataFrame:
    """The k best entities of each query: similarities, alignment (zmax), best window, best row, margin."""
    return top_entities(per_slug(index, queries, how, max(k, 2), skip_self), k, clip=how != "zmax")


def nearest_rows(index: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(window, row_id, slug, sim, rank): the k rows of highest score for each window, equal ones by the smaller row id.

    Scores are compared to twelve digits. A task only gives what is among the k best of a piece.
    """
    schema = T.StructType([*_fields(index, queries, "window", "row_id", "slug"), T.StructField("sim", T.DoubleType())])
    arrow = _arrow(schema)

    def work(pieces: Iterator, block: Block) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(block.windows), -np.inf)
        for part, scores in pieces:
            scores = np.round(np.where(np.isnan(scores), -np.inf, scores), 12)
            if part.num_rows >= k:
                floor = np.maximum(floor, np.partition(scores, part.num_rows - k, axis=0)[part.num_rows - k])
            at = np.flatnonzero(((scores >= floor) & (scores > -np.inf)).ravel())
            row, window = np.divmod(at, len(block.windows))
            made = [pa.array(block.windows, arrow.field(0).type).take(pa.array(window)), *[part.column(i).take(pa.array(row)) for i in (0, 1)], pa.array(scores.ravel()[at])]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    found = _scanned(index, _blocks(queries), work, schema, skip_self)
    order = Window.partitionBy("window").orderBy(F.col("sim").desc(), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_vote(items: DataFrame, anchors: DataFrame, neighbours: int = 5, near: float = 0.75, least_share: float = 0.55, skip_self: bool = False) -> DataFrame:
    """(row_id, label, share): the label that the nearest anchors of an item vote for, each with its score above ``near``.

    ``items`` (row_id, vec) are the queries; ``anchors`` (row_id, label, vec) are scanned and never collected. Null if
    no anchor is near enough or the winner's share of the votes is too small.
    """
    index = anchors.select("row_id", F.col("label").alias("slug"), F.lit(0).alias("view"), F.lit(True).alias("is_base"), "vec")
    asked = items.select(F.col("row_id").alias("query"), F.col("row_id").alias("window"), "vec")
    votes = nearest_rows(index, asked, neighbours, skip_self)
    weights = votes.groupBy("window", F.col("slug").alias("label")).agg(F.sum(F.greatest(F.col("sim") - near, F.lit(0.0))).alias("weight"))
    whole = Window.partitionBy("window")
    ranked = weights.withColumn("total", F.sum("weight").over(whole)).withColumn("n", F.row_number().over(whole.orderBy(F.col("weight").desc(), "label"))).where("n = 1")
    share = F.try_divide("weight", "total")
    kept = share >= least_share
    return ranked.select(F.col("window").alias("row_id"), F.when(kept, F.col("label")).alias("label"), F.when(kept, share).alias("share"))


def apply_linear(df: DataFrame, vector: str, mean: np.ndarray, matrix: np.ndarray, name: str = "mapped") -> DataFrame:
    """Adds norm((vector - mean) @ matrix) as an array of doubles; null stays null. One Arrow pass, no shuffle."""
    source = df.select("*", F.col(vector).cast("array<double>").alias(name)) if name not in df.columns else df.withColumn(name, F.col(vector).cast("array<double>"))
    names = source.columns
    at = names.index(name)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            rows = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(int(valid.sum()), -1) if valid.any() else np.zeros((0, len(mean)))
            made = (rows - mean) @ matrix
            made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
            out = iter(made.tolist())
            lists = pa.array([next(out) if ok else None for ok in valid], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists if i == at else batch.column(i) for i in range(batch.num_columns)], names)

    return source.mapInArrow(transform, source.schema)


def moments(df: DataFrame, left: str, right: str | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums of both vectors and the sum of their outer products; partial sums come from each partition.

    The driver only sees matrices of dim x dim.
    """
    right = right or left
    source = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).alias("a"), F.col(right).alias("b"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, None
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for i in (0, 1))
                made = [a.sum(0), b.sum(0), a.T @ b]
                parts = made if parts is None else [x + y for x, y in zip(parts, made)]
                n += batch.num_rows
        if parts is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["n", "sa", "sb", "ab"])

    rows = source.mapInArrow(add, "n long, sa binary, sb binary, ab binary").collect()
    total = sum(r.n for r in rows)
    sa, sb, ab = (sum(np.frombuffer(r[i], np.float64) for r in rows) for i in ("sa", "sb", "ab"))
    return total, sa, sb, ab.reshape(len(sa), -1)


def pca_whitening(df: DataFrame, vector: str, alpha: float = 0.5, shrink: float = 0.1, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix of a whitening: eigenvectors of the shrunk population covariance over eigenvalue ** alpha."""
    n, total, _, product = moments(df, vector)
    mean = total / n
    covariance = product / n - np.outer(mean, mean)
    covariance = (1 - shrink) * covariance + shrink * np.trace(covariance) / len(mean) * np.eye(len(mean))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[: dims or len(mean)]
    return mean, vectors[:, order] / np.maximum(values[order], 1e-12) ** alpha


def learned_whitening(pairs: DataFrame, left: str, right: str, shrink: float = 0.1, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix that whiten the differences of matched pairs, then keep the directions of most spread."""
    n, sa, sb, ab = moments(pairs, left, right)
    _, _, _, aa = moments(pairs, left)
    _, _, _, bb = moments(pairs, right)
    mean = (sa + sb) / (2 * n)
    within = (aa + bb - ab - ab.T) / n
    within = (1 - shrink) * within + shrink * np.trace(within) / len(mean) * np.eye(len(mean))
    values, vectors = np.linalg.eigh(within)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-12))
    spread = whiten.T @ ((aa + bb) / (2 * n) - np.outer(mean, mean)) @ whiten
    values, rotation = np.linalg.eigh(spread)
    return mean, whiten @ rotation[:, np.argsort(-values)[: dims or len(mean)]]


def text_top_slugs(hits: DataFrame, k: int) -> DataFrame:
    """(query, slug, score, rank): each named entity votes once with its best idf / (1 + cost) for all its slugs.

    ``hits`` has (query, field, canonical, idf, cost, slugs); equal sums by slug.
    """
    votes = hits.groupBy("query", "field", "canonical").agg(F.max(F.col("idf") / (1 + F.col("cost"))).alias("vote"), F.first("slugs").alias("slugs"))
    sums = votes.select("query", "vote", F.explode("slugs").alias("slug")).groupBy("query", "slug").agg(F.sum("vote").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "slug")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
