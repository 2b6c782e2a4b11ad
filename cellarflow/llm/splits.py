"""Train, validation and test splits that keep records together which share an author, source or entity.

Records and their keys form components. Their table is kept: a new batch only links its records to components that
have one of its keys, the components that meet are merged by hooking and pointer jumping on the (small) graph of
merges, a component keeps its split, new ones fill the deficits of the splits, and a merge of components of different
splits is put into quarantine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.operators.skew import salted_lookup
from cellarflow.session import Scratch

# What stands for "not known" in a key, written without separators.
PLACEHOLDERS = ["", "unknown", "нет", "n/a", "na", "none", "null", "nan", "неизвестно", "неизв.", "?", ".", "б/н"]
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
JUMPS = 3
TASK_EDGES = 500_000  # edges (16 bytes each) that one task may take on
SLICES = 4096  # of the components by hash, when they fill deficits


def plain_key(column: Column | str) -> Column:
    """A key without case, padding and separators (space, hyphen, underscore); null if it isn't known."""
    plain = F.regexp_replace(F.lower(column), r"[\s\p{Pd}_﻿]+", "")
    return F.when(~plain.isin(PLACEHOLDERS), plain)


def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is connected with: hooking and pointer jumping over arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = lo < hi
        if not live.any():
            return nodes, nodes[root]
        a, b = a[live], b[live]
        np.minimum.at(root, hi[live], lo[live])
        while (root[root] != root).any():
            root = root[root]


def connected(edges: DataFrame, scratch: Scratch, name: str = "merge", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): of each node that an edge (a, b) has, the smallest node it is connected with.

    Each round hooks every root to its smallest smaller neighbour, shortens the chains by pointer jumping and draws
    the edges anew between roots; edges within one root go. Rounds and tables shrink fast, long chains included. Once
    no more than ``task_edges`` edges are left, counted first, one task does the remaining rounds in the same way. Rows
    of a hot root are cut into parts.
    """
    start = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    nodes = start.select(F.col("a").alias("node")).union(start.select("b")).distinct()
    parents = scratch.save(nodes.select("node", F.col("node").alias("root")), f"{name}-roots-0") if start.count() > task_edges else None
    moved = lambda df, column, hooks, spread: salted_lookup(df, hooks.select(F.col("node").alias(column), F.col("up").alias(f"{column}_up")), column, spread).withColumn(column, F.coalesce(f"{column}_up", column)).drop(f"{column}_up")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _solve(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))], ["node", "up"])

    live, step = start, 0
    while parents is not None and live.count() > task_edges:
        step += 1
        hooks = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        for _ in range(JUMPS):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            hooks = salted_lookup(hooks, above, "up", "node").select("node", F.coalesce("higher", "up").alias("up"))
        hooks = scratch.save(hooks, f"{name}-hooks-{step}")
        drawn = moved(moved(live, "a", hooks, "b"), "b", hooks, "a").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = scratch.save(drawn, f"{name}-edges-{step}")
        parents = scratch.save(moved(parents, "root", hooks, "node"), f"{name}-roots-{step}")
        for old in (f"{name}-edges-{step - 1}", f"{name}-roots-{step - 1}", f"{name}-hooks-{step - 1}"):
            scratch.drop(old)
    last = scratch.save(live.select("a", "b").coalesce(1).mapInArrow(finish, "node long, up long"), f"{name}-last")
    if parents is None:
        return last.select("node", F.col("up").alias("root"))
    return scratch.save(moved(parents, "root", last, "node"), f"{name}-roots")


_TABLES = {"members": "record long, component long", "keys": "key string, component long", "splits": "component long, split string, n_records long"}
MARK = "_WHOLE"


@dataclass
class Components:
    """The kept tables: members (record, component), keys (key, component), splits (component, split, n_records)."""

    members: DataFrame
    keys: DataFrame
    splits: DataFrame

    def save(self, path: str) -> Components:
        """Writes the tables as the next version under ``path`` and gives them back as kept.

        A version counts once its mark is there, which is made last and at once: readers, and whoever follows a job that
        broke off, see the version before or a whole one. Older versions stay until they are removed by hand, as the
        tables of this object may still read them. Of two writers of one version the second fails.
        """
        spark = self.members.sparkSession
        fs, made = _versions(spark, path)
        version = f"{path}/v{1 + max(made, default=0):06d}"
        for name in _TABLES:
            getattr(self, name).write.mode("errorifexists").parquet(f"{version}/{name}")
        fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{version}/{MARK}"), False).close()
        return Components.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Components | None:
        """The latest whole version under ``path``; None if there is none."""
        fs, made = _versions(spark, path)
        whole = [v for v in made if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v:06d}/{MARK}"))]
        if not whole:
            return None
        return Components(*[spark.read.schema(columns).parquet(f"{path}/v{max(whole):06d}/{name}") for name, columns in _TABLES.items()])


def _versions(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path`` and the numbers of the versions there, whole or not."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()]


def _empty(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], columns)


def records_with_keys(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """(record, key): a row for each known key of a record, named by its column; a record without any has a null key."""
    known = [F.when(plain_key(k).isNotNull(), F.concat(F.lit(f"{k}:"), plain_key(k))) for k in keys]
    return df.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("record"), F.explode(F.array_append(F.array_compact(F.array(*known)), F.lit(None).cast("string"))).alias("key"))


def add_batch(linked: DataFrame, kept: Components | None, scratch: Scratch, shares: dict[str, float] = SPLITS) -> Components:
    """The kept tables after the records of ``linked`` (record, key) are added; ``kept`` is None at first.

    The component of records is the smallest record in it. Null keys tie nothing. A key that many records share ties
    each of them to the smallest one, so it gives as many links as records. A record that is sent again keeps its
    component and may add keys to it.
    """
    linked = scratch.save(linked.distinct(), "linked")
    if kept is None:
        kept = Components(_empty(linked, "record long, component long"), _empty(linked, "key string, component long"), _empty(linked, "component long, split string, n_records long"))
    records = linked.select("record").distinct()
    # what stands for a record or key so far: its component if it has one
    at = records.join(kept.members, "record", "left").select("record", F.coalesce("component", "record").alias("node"))
    known = linked.where("key is not null").join(at, "record")
    by_key = known.groupBy("key").agg(F.min("node").alias("least")).join(kept.keys.withColumnRenamed("component", "old"), "key", "left").select("key", F.coalesce("old", "least").alias("hub"), "least")
    by_key = scratch.save(by_key, "by_key")
    links = salted_lookup(known, by_key, "key", "record").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    roots = connected(links, scratch)
    # components that were merged and nodes that are new, by their root
    renamed = lambda df, column: salted_lookup(df, roots.withColumnRenamed("node", column), column, df.columns[0]).select(*[F.coalesce("root", column).alias(column) if c == column else c for c in df.columns])
    fresh = at.join(kept.members.select("record", F.lit(True).alias("old")), "record", "left").where("old is null").select("record", F.col("node").alias("component"))
    members = scratch.save(renamed(kept.members.unionByName(fresh), "component"), "members")
    fresh_keys = by_key.join(kept.keys.select("key", F.lit(True).alias("old")), "key", "left").where("old is null").select("key", F.col("hub").alias("component"))
    keys = scratch.save(renamed(kept.keys.unionByName(fresh_keys), "component"), "keys")
    sizes = members.groupBy("component").agg(F.count("*").alias("n_records"))
    before = renamed(kept.splits.select("component", "split"), "component").groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    held = scratch.save(sizes.join(before, "component", "left").select("component", "n_records", F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), QUARANTINE).alias("split")), "held")
    new = fill_deficits(held.where("split is null").select("component", "n_records"), _totals(held), shares)
    splits = scratch.save(held.where("split is not null").select("component", "split", "n_records").unionByName(new), "splits")
    return Components(members, keys, splits)


def _totals(held: DataFrame) -> dict[str | None, int]:
    return {r["split"]: r["n"] for r in held.groupBy("split").agg(F.sum("n_records").alias("n")).collect()}


def fill_deficits(new: DataFrame, totals: dict[str | None, int], shares: dict[str, float] = SPLITS) -> DataFrame:
    """(component, split, n_records): splits of new components such that the records come as near to ``shares`` as can be.

    ``totals`` has the records by split so far, those without one under None. Components of more than 1 / 1,000 of
    all records, at most 1,000 of them, go one by one, the largest first, to the split that lacks most; the rest is
    cut into SLICES by a hash of the component, and the slices, in order, fill up what the splits still lack.
    """
    everything = sum(n for s, n in totals.items() if s != QUARANTINE)
    lacking = {s: share * everything - totals.get(s, 0) for s, share in shares.items()}
    large = new.where(F.col("n_records") > everything / 1000).orderBy(F.col("n_records").desc(), "component").collect()
    chosen = []
    for row in large:
        split = max(lacking, key=lambda s: lacking[s])
        lacking[split] -= row.n_records
        chosen.append((row.component, split, row.n_records))
    placed = new.sparkSession.createDataFrame(chosen, "component long, split string, n_records long")
    small = new.where(F.col("n_records") <= everything / 1000).withColumn("slice", F.pmod(F.xxhash64("component"), F.lit(SLICES)).cast("int"))
    counts = {r.slice: r.n for r in small.groupBy("slice").agg(F.sum("n_records").alias("n")).collect()}
    lacking = {s: max(0.0, x) for s, x in lacking.items()}
    scale = sum(counts.values()) / max(1e-9, sum(lacking.values()))
    ends, end = [], 0.0
    for s in shares:
        end += lacking[s] * scale
        ends.append((end, s))
    of_slice, filled = [], 0
    for k in range(SLICES):
        middle = filled + counts.get(k, 0) / 2
        filled += counts.get(k, 0)
        of_slice.append(next((s for e, s in ends if middle <= e), ends[-1][1]))
    split = F.element_at(F.array(*[F.lit(s) for s in of_slice]), F.col("slice") + 1) if counts else F.lit(next(iter(shares)))
    return small.select("component", split.alias("split"), "n_records").unionByName(placed)


def kept_splits(df: DataFrame, record: str, keys: list[str], path: str, shares: dict[str, float] = SPLITS) -> Components:
    """``grouped_splits`` added to what is kept under ``path``, and kept there: each call is one increment."""
    return grouped_splits(df, record, keys, Components.open(df.sparkSession, path), shares).save(path)


def grouped_splits(df: DataFrame, record: str, keys: list[str], kept: Components | None = None, shares: dict[str, float] = SPLITS) -> Components:
    """Components and splits of the records of ``df`` tied by any of the columns ``keys``, added to ``kept``.

    Keys compare without case, padding and separators; placeholders, blanks and nulls tie nothing, so a record without
    a known key is a component of its own. Records with a null id are left out, repeated ones count once. An empty
    table leaves the tables as they were. Columns other than these are not read, so their names can't clash.
    """
    return add_batch(records_with_keys(df, record, keys), kept, Scratch(df.sparkSession, "splits"), shares)


def split_of_records(components: Components, record: str = "record", type_: T.DataType | None = None) -> DataFrame:
    """(record, component, split) of every record in the kept tables."""
    rows = components.members.join(components.splits.select("component", "split"), "component")
    return rows.select(F.col("record").cast(type_ or T.LongType()).alias(record), "component", "split")
