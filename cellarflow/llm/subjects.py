"""Subjects of documents: term weighting, truncated SVD and cosine to seed centroids that are refined iteratively.

The texts are read once into a table of term numbers with sentence ends. Document frequencies, the SVD (subspace
iteration on the term side) and the centroids are then computed over all documents, each as one Arrow pass whose
partial results are summed in the cluster; the driver only sees matrices of the vocabulary's size. The vocabulary has
the terms of at least a share MIN_SHARE of the documents, so with t distinct terms a document it has at most
t / MIN_SHARE terms, however many documents there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarflow.llm.pieces import WordReader, plain, slices
from cellarflow.session import Scratch

MIN_SHARE = 0.001  # of the documents that have a term of the vocabulary
RANK = 32  # dimensions that are kept
LABEL_BOUND = 20_000  # labelled documents that the term weights and first centroids are fitted on
ROUNDS = 2  # refinements of the centroids, over all sentences
LEAST_SHARE = 0.2  # of a document's sentences on any subject
LEAST_COSINE = 0.5
LEAST_EVIDENCE = 0.35  # of the usual weight of a sentence on a subject
SLICE = 1 << 17  # numbers of a matrix that one task sums over all partitions

END, MARK = -1, "\ue000"  # a private-use sign for a line or block end
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|h\d|tr|td|table|blockquote|section)\b[^<>]*>")
_TAG = re.compile(r"</?[a-z][^<>]*>|<\|[^<>|]*\|>")
_TOKEN = re.compile(r"[^\W_]+|\ue000|[.!?…]+(?=[\W_]*(?:$|\ue000))")


def _number(term: str) -> int:
    """30 bits of a hash, and above them whether the term has letters that no Latin one is drawn like."""
    return xxhash.xxh32_intdigest(term) & 0x3FFFFFFF | (not term.isascii()) << 30


def _terms(pieces: list[str]) -> list[list[int]]:
    """Term numbers of pieces, END where a sentence ends; numbers are no terms."""
    out = []
    for piece in plain(pieces):
        if "<" in piece:
            piece = _TAG.sub(" ", _BLOCK_TAG.sub(MARK, piece))
        out.append([_number(t) if t[0].isalpha() else END for t in _TOKEN.findall(piece) if not t[0].isdigit()])
    return out


def read_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): the term numbers of each document that isn't null, END between sentences."""
    source = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["key"], T.StructField("terms", T.ArrayType(T.IntegerType(), False))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(np.int32, _terms)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t.replace("\n", f" {MARK} ") for t in part.column(1).to_pylist()]
                values, offsets = reader.read(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))], ["key", "terms"])

    return source.mapInArrow(read, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a list column."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return column.value_parent_indices().to_numpy(zero_copy_only=False), values


def document_frequencies(terms: DataFrame, least_share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted vocabulary, in how many documents each term is, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, held, docs = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            row, value = _flat(batch.column(0))
            docs += batch.num_rows
            held.append(np.unique(row << 32 | value.astype(np.int64))[:] & 0xFFFFFFFF if len(value) else np.zeros(0, np.int64))
            if sum(map(len, held)) > 2_000_000:
                known, counts = _merge(known, counts, held)
                held = []
        known, counts = _merge(known, counts, held)
        known, counts = np.append(known, -2), np.append(counts, docs)
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(counts, pa.int64())], ["term", "df"])

    parts = terms.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    n = terms.count()
    least = max(2, int(np.ceil(least_share * n)))
    rows = parts.where((F.col("df") >= least) & (F.col("term") >= 0) & (F.col("term") < 0x80000000)).collect()
    found = sorted((r.term, r.df) for r in rows)
    return np.array([t for t, _ in found], np.int64), np.array([c for _, c in found], np.float64), n


def _merge(known: np.ndarray, counts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    fresh, sizes = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    both, at = np.unique(np.concatenate([known, fresh]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([counts, sizes]), len(both)).astype(np.int64)


def sum_matrices(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all partitions of the matrix that ``make`` gives for a partition.

    Each partition's matrix is cut into slices of SLICE numbers, and each slice is summed over all partitions by one
    task: the work of adding is spread evenly, and the driver gets every number once, however many partitions there are.
    """
    cuts = max(1, -(-int(np.prod(shape)) // SLICE))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(batches).astype(np.float64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(cuts), pa.int32()), pa.array([made[k * SLICE : (k + 1) * SLICE].tobytes() for k in range(cuts)], pa.binary())], ["g", "m"])

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for table in tables:
            for g, m in zip(table.column(0).to_pylist(), table.column(1)):
                value = np.frombuffer(m.as_buffer(), np.float64)
                if g in total:
                    total[g] += value
                else:
                    total[g] = value.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["g", "m"])

    rows = df.mapInArrow(part, "g int, m binary").repartition(min(cuts, 64), "g").mapInArrow(add, "g int, m binary").collect()
    parts = {r.g: np.frombuffer(r.m, np.float64) for r in rows}
    return np.concatenate([parts[k] for k in range(cuts)]).reshape(shape) if parts else np.zeros(shape)


def _indexed(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: row, vocabulary index (-1: none) and value of each element."""
    row, value = _flat(column)
    i = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
    return row, np.where(vocabulary[i] == value, i, -1), value


def truncated_svd(terms: DataFrame, vocabulary: np.ndarray, weights: np.ndarray, rank: int, passes: int = 2) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the matrix of all documents, tf x weight, rows of length 1."""
    rank = min(rank, len(vocabulary))
    wide = min(rank + 8, len(vocabulary))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(vocabulary), wide)) * (weights[:, None] > 0))[0]
    for _ in range(passes):
        sent = terms.sparkSession.sparkContext.broadcast((vocabulary, weights, basis.astype(np.float32)))

        def gram(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray:
            vocabulary, weights, basis = sent.value
            total = np.zeros(basis.shape)
            size = max(1, (1 << 21) // len(vocabulary))
            for batch in batches:
                row, i, _ = _indexed(batch.column(0), vocabulary)
                row, i = row[i >= 0], i[i >= 0]
                cuts = np.searchsorted(row, np.arange(0, batch.num_rows + size, size))
                for begin, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a == b:
                        continue
                    block = np.bincount((row[a:b] - begin * size) * len(vocabulary) + i[a:b], minlength=size * len(vocabulary)).astype(np.float32).reshape(size, -1)
                    block *= weights.astype(np.float32)
                    block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
                    total += block.T @ (block @ basis)
            return total

        product = sum_matrices(terms.select("terms"), gram, basis.shape)
        values, vectors = np.linalg.eigh(basis.T @ product)
        order = np.argsort(-values)[:rank]
        result = basis @ vectors[:, order]
        basis = np.linalg.qr(product)[0]
    return result


class Model:
    """What assigns sentences: the embedding of each term and the subjects' centroids."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, vectors: np.ndarray, centroids: np.ndarray, usual: float):
        self.vocabulary, self.weights, self.usual = vocabulary, weights, usual
        self.embedding = (weights[:, None] * vectors).astype(np.float32)
        self.centroids = centroids.astype(np.float32)

    def sentences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch: the row, the embedding and the evidence (sum of weights) of each sentence."""
        row, i, value = _indexed(column, self.vocabulary)
        sentence = np.cumsum((value == END) | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
        keep = i >= 0
        row, i, sentence = row[keep], i[keep], sentence[keep]
        if not len(i):
            return np.zeros(0, np.int64), np.zeros((0, self.embedding.shape[1]), np.float32), np.zeros(0)
        starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        ends = np.append(starts[1:], len(i))
        sums = np.empty((len(starts), self.embedding.shape[1]), np.float32)
        for a in range(0, len(starts), 20_000):  # gathered in parts, to stay in cache
            b = min(a + 20_000, len(starts))
            sums[a:b] = np.add.reduceat(self.embedding[i[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0)
        return row[starts], sums, np.add.reduceat(self.weights[i], starts)

    def assign(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the sentences on a subject: row, centroid (twice the subject's number, or one more) and embedding of length 1.

        Last, of each row the cosine of its whole embedding with each centroid.
        """
        row, sums, evidence = self.sentences(column)
        unit = _unit(sums)
        cosine = unit @ self.centroids.T
        seed = cosine.argmax(1) if len(cosine) else np.zeros(0, np.int64)
        on = (evidence >= LEAST_EVIDENCE * self.usual) & (cosine[np.arange(len(seed)), seed] >= LEAST_COSINE)
        whole = np.zeros((len(column), self.embedding.shape[1]), np.float32)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            whole[row[first]] = np.add.reduceat(sums, first, axis=0)
        return row[on], seed[on], unit[on], _unit(whole) @ self.centroids.T


def _label_counts(labelled: DataFrame, vocabulary: np.ndarray, subjects: list) -> np.ndarray:
    """(vocabulary + 1) x subjects: in how many documents of one label each term is; last row: how many documents."""
    sent = labelled.sparkSession.sparkContext.broadcast((vocabulary, {s: k for k, s in enumerate(subjects)}))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        vocabulary, number = sent.value
        total = np.zeros((len(vocabulary) + 1, len(number)))
        for batch in batches:
            of_row = np.array([number[s] for s in batch.column(1).to_pylist()], np.int64)
            row, i, _ = _indexed(batch.column(0), vocabulary)
            pairs = np.unique(row[i >= 0] * len(vocabulary) + i[i >= 0])
            np.add.at(total, (pairs % len(vocabulary), of_row[pairs // len(vocabulary)]), 1)
            np.add.at(total, (len(vocabulary), of_row), 1)
        return total

    return sum_matrices(labelled.select("terms", "subject"), count, (len(vocabulary) + 1, len(subjects)))


def _centroid_sums(terms: DataFrame, model: Model) -> np.ndarray:
    sent = terms.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        model = sent.value
        total = np.zeros(model.centroids.shape)
        for batch in batches:
            _, subject, unit, _ = model.assign(batch.column(0))
            for s in range(len(total)):
                total[s] += unit[subject == s].sum(0)
        return total

    return sum_matrices(terms.select("terms"), add, model.centroids.shape)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(terms: DataFrame, labels: DataFrame, key: str, subject: str) -> tuple[Model, list] | None:
    """The model of a corpus and its subjects in order; None if there are no labelled documents with known terms.

    ``labels`` has (key, subject). Documents with one label, at most LABEL_BOUND of them by the hash of their key,
    give the terms' weights and the first centroids; everything else is computed over all documents.
    """
    vocabulary, df, n = document_frequencies(terms, MIN_SHARE)
    single = labels.where(F.col(key).isNotNull() & F.col(subject).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(subject).alias("subject"), F.max(subject).alias("other")).where("subject = other").drop("other")
    single = single.orderBy(F.xxhash64("key"), "key").limit(LABEL_BOUND)
    subjects = sorted(r[0] for r in single.select("subject").distinct().collect())
    if not len(vocabulary) or not subjects:
        return None
    counts = _label_counts(terms.join(single, "key"), vocabulary, subjects)
    per_term, per_subject = counts[:-1], np.maximum(counts[-1], 1)
    rate = per_term / per_subject  # share of each subject's documents with the term
    smooth = 2.0 / max(1.0, per_subject.mean())
    purity = ((rate.max(1) + smooth / len(subjects)) / (rate.sum(1) + smooth) - 1 / len(subjects)) / max(1e-9, 1 - 1 / len(subjects)) if len(subjects) > 1 else np.ones(len(vocabulary))
    # terms that any subject uses weigh nothing
    weights = np.log((1 + n) / (1 + df)) * np.clip((purity - 0.25) / 0.5, 0, 1)
    vectors = truncated_svd(terms, vocabulary, weights, RANK)
    # two seeds a subject, from the terms in Latin letters and from the others: texts in two alphabets share no terms
    share = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12) * (df * weights**2)[:, None]
    other = (vocabulary >> 30 > 0)[:, None]
    first = _unit(np.stack([(share * ~other).T @ vectors, (share * other).T @ vectors], 1).reshape(2 * len(subjects), -1))
    usual = _usual_evidence(terms, Model(vocabulary, weights, vectors, first, 0.0))
    model = Model(vocabulary, weights, vectors, first, usual)
    for _ in range(ROUNDS):
        sums = _centroid_sums(terms, model)
        refined = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), model.centroids)
        model = Model(vocabulary, weights, vectors, refined, usual)
    return model, subjects


def _usual_evidence(terms: DataFrame, model: Model) -> float:
    """Mean evidence of the sentences that have any, over all documents."""
    sent = terms.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2)
        for batch in batches:
            row, i, value = _indexed(batch.column(0), sent.value.vocabulary)
            sentence = np.cumsum((value == END) | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
            evidence = np.bincount(sentence[i >= 0], sent.value.weights[i[i >= 0]]) if (i >= 0).any() else np.zeros(0)
            total += [evidence.sum(), (evidence > 0).sum()]
        return total

    total = sum_matrices(terms.select("terms"), add, (2,))
    return float(total[0] / max(1.0, total[1]))


def assign_subjects(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, subject: str) -> DataFrame:
    """(key, subject, n_sentences, share, cosine): the subjects that take up at least a fifth of a document's sentences on any.

    ``cosine`` is that of the embedding of the whole document with the subject's nearer centroid. A sentence is on the subject of the nearest centroid if its weighted terms and its cosine suffice, else on none;
    a single sentence is no subject beside one of two or more. Null, empty and blank texts, texts without a sentence
    on a subject and an empty table give no rows; long texts are read whole; rows with one key are one document each
    and give equal rows only if their texts do; wrong and repeated labels are outvoted. No shuffle of documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "subjects")
    terms = scratch.save(read_terms(docs, key, text), "terms")
    fitted = fit(terms, labels, label_key, subject)
    key_field, subject_field = T.StructField(key, docs.schema[key].dataType), T.StructField(subject, labels.schema[subject].dataType)
    schema = T.StructType([key_field, subject_field, T.StructField("n_sentences", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("cosine", T.DoubleType())])
    if fitted is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, subjects = sent.value
        names = pa.array(subjects).cast(_arrow_type(subject_field.dataType))
        for batch in batches:
            row, number, _, cosine = model.assign(batch.column(1))
            cosine = cosine.reshape(batch.num_rows, -1, 2).max(2)
            counts = np.bincount(row * len(subjects) + number // 2, minlength=batch.num_rows * len(subjects)).reshape(batch.num_rows, -1)
            total = counts.sum(1, keepdims=True)
            kept = (counts >= LEAST_SHARE * total) & (counts > 0) & ((counts > 1) | (counts.max(1, keepdims=True) < 2))
            r, s = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(r)), names.take(pa.array(s)), pa.array(counts[r, s], pa.int32()), pa.array(counts[r, s] / total[r, 0]), pa.array(cosine[r, s].astype(np.float64))], schema.names
            )

    return terms.mapInArrow(assign, schema)


def composition(docs: DataFrame, shares: DataFrame, key: str, subject: str, source: str) -> DataFrame:
    """(source, subject, n_documents, weight, share_of_source): what the documents of each source are about.

    ``weight`` adds up the documents' shares of their subjects, a document counting as one; documents without a subject,
    null and blank ones included, stand under the subject null. Keys are unique. A null source is a source of its own.
    """
    parts = shares.groupBy(key).agg(F.sum("share").alias("whole"), F.collect_list(F.struct(F.col(subject), F.col("share"))).alias("on"))
    spread = docs.select(key, source).join(parts, key, "left").select(source, "whole", F.explode_outer("on").alias("x"))
    counted = spread.groupBy(source, F.col(f"x.{subject}").alias(subject)).agg(F.count("*").alias("n_documents"), F.sum(F.coalesce(F.col("x.share") / F.col("whole"), F.lit(1.0))).alias("weight"))
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("__n"))
    joined = counted.join(sizes, F.col(source).eqNullSafe(F.col("__source")))
    return joined.select(source, subject, "n_documents", F.round("weight", 6).alias("weight"), F.round(F.col("weight") / F.col("__n"), 6).alias("share_of_source"))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
