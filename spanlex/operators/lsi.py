"""Latent semantic indexing: truncated singular value decomposition of the tf-idf matrix, and cosine ranking.

With A = U S V' (terms x documents), a document is V S, a query q is folded in as q' U S^-1, both of unit
length. U is never built: U'q = S^-1 V' (A'q), and A'q are plain tf-idf sums of the query's terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlex.functions import scoring as S
from spanlex.operators.index import Index, vocabulary, with_statistics
from spanlex.operators.krylov import decompose
from spanlex.operators.retrieve import CELLS, Batch, batch_of, hits_of, top_k
from spanlex.operators.vectors import nearest
from spanlex.session import durable, forget

@dataclass
class Model:
    """``doc_vectors(doc_id, v)`` are the rows of V; ``sigma`` the singular values, descending."""

    doc_vectors: DataFrame
    sigma: list[float]

    @property
    def k(self) -> int:
        return len(self.sigma)


def cells(index: Index, ids: DataFrame) -> DataFrame:
    """``(term, term_id, doc_id, w)``: the tf-idf weighted matrix, with the numbers of terms of ``ids(term, term_id)``, null for others."""
    stats = index.term_stats.select("term", "df").join(ids, "term", "left")
    rows = with_statistics(index.postings, stats).crossJoin(F.broadcast(index.corpus_stats))  # one row
    return rows.select("term", "term_id", "doc_id", S.tfidf(F.col("tf"), S.idf(F.col("n"), F.col("df"))).alias("w"))


def rank_of(terms: int, docs: int, k: int | None) -> int:
    """The number of dimensions: as asked, at most one less than either side; by default half, 100 at most."""
    if k is None:
        k = max(1, min(100, min(terms, docs) // 2))
    return max(1, min(k, terms - 1, docs - 1))


def build(index: Index, k: int | None = None) -> Model:
    """Decompose the matrix of an index, whatever its size. Documents without terms have no vector."""
    docs, terms = index.doc_stats.count(), index.term_stats.count()
    if not docs:
        return Model(index.postings.sparkSession.createDataFrame([], "doc_id bigint, v array<double>"), [])
    ids = durable(vocabulary(index.term_stats.where("df > 1")), "lsi-terms")  # terms of one document need no column, see krylov
    shared = F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("term_id", "w"))).alias("x")
    alone = F.coalesce(F.sum(F.when(F.col("term_id").isNull(), F.col("w") * F.col("w"))), F.lit(0.0)).alias("d")
    coded = cells(index, ids).groupBy("doc_id").agg(shared, alone)
    rows = durable(coded.select("doc_id", F.col("x.term_id").cast("array<int>").alias("t"), F.col("x.w").alias("w"), "d"), "lsi-rows")
    found = decompose(rows, ids.count(), rank_of(terms, docs, k))
    forget(rows)
    return Model(found.vectors, found.sigma)


def unit_documents(model: Model) -> DataFrame:
    """``(doc_id, vec)``: V S with length one; documents the dimensions don't reach are left out."""
    sigma = F.array(*map(F.lit, model.sigma))
    scaled = model.doc_vectors.select("doc_id", F.zip_with("v", sigma, lambda v, s: v * s).alias("x"))
    return _unit(scaled, "doc_id")


def _unit(rows: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).where("norm > 1e-12").select(
        key, F.transform("x", lambda x: x / F.col("norm")).alias("vec")
    )


def _term_sums(rows: DataFrame, idf: np.ndarray, first: int, number: int, k: int) -> np.ndarray:
    """Of ``rows(t, tf, v)`` the vectors v summed up by term with tf-idf weights, for a range of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((number, k))
        for batch in batches:
            t, tf, v = (batch.column(i).flatten().to_numpy() for i in (0, 1, 2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            inside = (t >= first) & (t < first + number)
            t, tf, row = t[inside], tf[inside], row[inside]
            weight = S.weights_of("tfidf", tf.astype(float), idf[t], tf, 1.0)
            start, v = np.searchsorted(row, np.arange(batch.num_rows + 1)), v.reshape(batch.num_rows, k)
            for j in np.flatnonzero(start[1:] > start[:-1]):
                some = slice(start[j], start[j + 1])
                total[t[some] - first] += weight[some, None] * v[j]  # a term is once in a document
        there = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(list(total[there]), pa.list_(pa.float64()))], names=["t", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, k)):
                total[t] = total.get(t, 0.0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["t", "x"])

    sums = rows.mapInArrow(run, "t int, x array<double>").repartition("t").mapInArrow(add, "t int, x array<double>").toArrow()  # at most CELLS numbers
    out = np.zeros((number, k))
    if sums.num_rows:
        out[sums.column(0).to_numpy()] = np.concatenate([c.flatten().to_numpy().reshape(len(c), k) for c in sums.column(1).chunks if len(c)])
    return out


def fold(index: Index, model: Model, queries: Batch) -> np.ndarray:
    """Queries in the space of the model, of length one, repeated terms damped as in documents; zeros for those without any.

    The sums over documents are built for terms, not for queries; what is shuffled is a vector per term and task.
    """
    hits, df = hits_of(index, queries)
    n_docs = max(1, index.corpus_stats.first()["n"])
    idf = np.where(df > 0, np.log(n_docs / np.maximum(df, 1)), 0.0)
    asked = idf[queries.place] * (1.0 + np.log(queries.times))
    rows = hits.join(model.doc_vectors, "doc_id").select(F.col("x.t").alias("t"), F.col("x.tf").alias("tf"), "v")
    k, number, out = model.k, len(queries.qids), np.zeros((len(queries.qids), model.k))
    owner, most = np.repeat(np.arange(number), np.diff(queries.start)), max(1, CELLS // max(1, model.k))
    for first in range(0, len(queries.terms), most):
        sums = _term_sums(rows, idf, first, min(most, len(queries.terms) - first), k)
        inside = np.flatnonzero((queries.place >= first) & (queries.place < first + most))
        for at in range(0, len(inside), most):
            some = inside[at : at + most]
            starts = np.flatnonzero(np.append(True, owner[some][1:] != owner[some][:-1]))
            out[owner[some][starts]] += np.add.reduceat(asked[some, None] * sums[queries.place[some] - first], starts, axis=0)
    out /= np.square(model.sigma)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-12, out / np.maximum(norm, 1e-300), 0.0)


def retrieve(index: Index, model: Model, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top k documents of every query by cosine; negative ones count. Queries without known terms have none."""
    if k < 1:
        raise ValueError("k must be at least 1")
    batch = batch_of(queries, index)
    if batch is None:  # two halves, each with its own pass
        half = F.pmod(F.xxhash64("qid"), F.lit(2))
        return retrieve(index, model, queries.where(half == 0), k).unionByName(retrieve(index, model, queries.where(half == 1), k))
    if not model.sigma:
        return index.names.select(F.lit("").alias("qid"), F.lit(0).alias("rank"), "doc_id", "doc_name", F.lit(0.0).alias("score")).limit(0)
    docs = durable(unit_documents(model).join(index.names, "doc_id").select("doc_id", "doc_name", "vec"), "lsi-documents")
    most = max(1, CELLS // max(1, model.k))
    out = None
    for at in range(0, max(1, len(batch.qids)), most):
        some = batch.some(at, at + most)
        vectors = fold(index, model, some)
        there = np.flatnonzero(vectors.any(axis=1))
        rows = nearest(docs, [some.qids[i] for i in there], vectors[there], k)
        out = rows if out is None else out.unionByName(rows)
    ranked = top_k(out, k)
    return ranked.select("qid", "rank", "doc_id", "doc_name", F.round("score", 6).alias("score"))
