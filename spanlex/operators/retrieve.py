"""Ranked retrieval: TF-IDF, BM25 and BM25 under WAND's admission rule, for whole batches of queries.

Only the postings of the batch's terms are used: a semi join with them comes first. They are gathered by
document, and every task scores its documents in blocks against all queries, keeping the k best of each. What is
shuffled is k rows per query and task, not a row per query and matching document. A query is skipped in a
block if the sum of the block's largest weights of its terms is below the k-th score found so far.

Scores are compared rounded to nine digits, so that the order in which a sum is built cannot decide a
tie; ties go by ``doc_name``, descending as a string. Emitted scores have six digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.functions import scoring as S
from spanlex.operators.index import Index, with_statistics
from spanlex.session import durable

#: Terms of all queries of a batch that is scored block by block; a larger batch is scored by joins.
QUERY_ROWS = 2_000_000
#: Pieces of a term in those joins.
SALTS = 64
#: Numbers in the weights of a block, and documents in it at most.
CELLS, DOCUMENTS = 8_000_000, 2048
#: Rows a task holds before they are cut to the best.
HELD = 1_000_000


def clean_queries(queries: DataFrame) -> DataFrame:
    """One text per qid: exact repetitions are dropped, of different texts the greatest string counts."""
    return queries.where("qid is not null").groupBy("qid").agg(F.max("text").alias("text"))


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """Terms of every query with their multiplicity, by the index's own analyzer."""
    return index.analyzer.counts(queries, ["qid"]).withColumnRenamed("tf", "qtf")


def scored(index: Index, queries: DataFrame, method: str = "bm25", k1: float = 1.6, b: float = 0.75) -> DataFrame:
    """``(qid, doc_id, score)`` of every document that holds a term of the query (OR semantics), by joins.

    A repeated query term counts as often as it is repeated; unknown terms count nothing.
    """
    if method not in ("bm25", "tfidf"):
        raise ValueError(f"unknown method {method!r}")
    asked = query_terms(queries, index)
    found = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    stats = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = with_statistics(found, stats).crossJoin(F.broadcast(index.corpus_stats))  # one row
    idf = S.idf(F.col("n"), F.col("df"))
    if method == "bm25":
        weight = S.bm25(F.col("tf"), idf, F.col("dl"), F.col("avdl"), k1, b)
        found = found.join(index.doc_stats, "doc_id")
    else:
        weight = S.tfidf(F.col("tf"), idf)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    weighted = found.select("term", "doc_id", spread.alias("salt"), weight.alias("w"))
    each = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    total = F.round(F.sum(F.col("qtf") * F.col("w")), 9)
    return weighted.join(each, ["term", "salt"]).groupBy("qid", "doc_id").agg(total.alias("score"))


@dataclass
class Batch:
    """The terms of all queries: those of query i are at ``start[i]`` to ``start[i + 1]``, as places in ``terms``."""

    qids: list[str]
    start: np.ndarray
    place: np.ndarray
    times: np.ndarray
    terms: list[str]

    def some(self, first: int, last: int) -> Batch:
        """The queries from ``first`` up to ``last``."""
        a, b = self.start[first], self.start[min(last, len(self.qids))]
        return Batch(self.qids[first:last], self.start[first : min(last, len(self.qids)) + 1] - a, self.place[a:b], self.times[a:b], self.terms)


def batch_of(queries: DataFrame, index: Index) -> Batch | None:
    """The queries as arrays; None if they hold more than ``QUERY_ROWS`` terms."""
    rows = query_terms(queries, index).select("qid", "term", "qtf").limit(QUERY_ROWS + 1).toArrow()
    if rows.num_rows > QUERY_ROWS:
        return None
    rows = rows.sort_by([("qid", "ascending"), ("term", "ascending")])
    qid, term = (rows.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
    if isinstance(qid, pa.ChunkedArray):
        qid, term = qid.combine_chunks(), term.combine_chunks()
    qids = qid.dictionary.to_pylist()
    start = np.searchsorted(qid.indices.to_numpy(), np.arange(len(qids) + 1))
    return Batch(qids, start, term.indices.to_numpy(), rows.column(2).to_numpy().astype(float), term.dictionary.to_pylist())


def hits_of(index: Index, queries: Batch) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, x)`` of documents with terms of the queries, x being (place t, tf) of each; and the documents of each term."""
    terms = index.postings.sparkSession.createDataFrame(list(enumerate(queries.terms)), "t int, term string")  # at most QUERY_ROWS
    hits = durable(index.postings.join(F.broadcast(terms), "term").select("t", "doc_id", "tf"), "hits")
    df = np.zeros(len(queries.terms), dtype=np.int64)
    for r in hits.groupBy("t").count().collect():  # at most as many as terms
        df[r["t"]] = r["count"]
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("t", "tf")).alias("x")), df  # lists of at most as many as terms


def best(index: Index, queries: Batch, method: str, k: int, k1: float = 1.6, b: float = 0.75, by_id: bool = False) -> DataFrame:
    """``(qid, doc_id, doc_name, score)``: of every task the documents that may be among the k best of a query.

    ``by_id`` keeps, beside the k best by score and name, the first k by id of those at the k-th score.
    """
    if method not in ("bm25", "tfidf"):
        raise ValueError(f"unknown method {method!r}")
    hits, df = hits_of(index, queries)
    lengths = durable(index.doc_stats, "lengths")
    whole = lengths.where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("avdl")).first()
    n_docs, avdl = max(1, whole["n"]), whole["avdl"] or 1.0
    idf = np.where(df > 0, np.log(n_docs / np.maximum(df, 1)), 0.0)
    rows = hits.join(lengths, "doc_id").join(index.names, "doc_id")
    rows = rows.select("doc_id", "doc_name", "dl", F.col("x.t").alias("t"), F.col("x.tf").alias("tf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(queries, k, by_id)
        size = max(16, min(DOCUMENTS, CELLS // max(1, len(queries.terms))))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                block = batch.slice(at, size)
                t, tf = (block.column(i).flatten().to_numpy() for i in (3, 4))
                sizes = np.diff(block.column(3).offsets.to_numpy())
                names = block.column(1)
                order = pc.array_sort_indices(names, order="descending").to_numpy()
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                place = np.repeat(rank, sizes)
                dl = np.repeat(block.column(2).to_numpy(), sizes)
                weight = np.zeros((len(queries.terms), len(order)))
                weight[t, place] = S.weights_of(method, tf.astype(float), idf[t], dl, avdl, k1, b)
                present = np.zeros(weight.shape, dtype=bool)
                present[t, place] = True
                task.score(weight, present, block.column(0).to_numpy()[order], names.take(pa.array(order)))
                if task.held > HELD:
                    task.cut()
        yield from task.rows()

    return rows.mapInArrow(run, "qid string, doc_id bigint, doc_name string, score double")


def _runs(flags: np.ndarray, owner: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags set before each owner's first row, and the rows of each owner."""
    sizes = np.bincount(owner, minlength=number)
    first = np.append(0, np.cumsum(sizes))[:-1]
    return np.append(0, np.cumsum(flags))[first], sizes


class _Task:
    """What a task has found so far."""

    def __init__(self, queries: Batch, k: int, by_id: bool, floor: float = 0.0):
        self.queries, self.k, self.by_id = queries, k, by_id
        self.least = np.full(len(queries.qids), floor)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]] = []
        self.held = 0

    def score(self, weight: np.ndarray, present: np.ndarray, ids: np.ndarray, names: pa.Array) -> None:
        """Score a block of documents, in the order of ties, against all queries."""
        q, k, most = self.queries, self.k, weight.max(axis=1, initial=0.0)
        bounds = np.add.reduceat(np.append(q.times * most[q.place], 0.0), q.start[:-1]) if len(q.qids) else np.empty(0)
        owner, chosen, scores = [], [], []
        for i in np.flatnonzero(bounds + 1e-6 >= self.least):
            some = q.place[q.start[i] : q.start[i + 1]]
            s = np.round(q.times[q.start[i] : q.start[i + 1]] @ weight[some], 9)
            kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else 0.0
            if kth > 0:
                self.least[i] = max(self.least[i], kth)
                above, at = np.flatnonzero(s > kth), np.flatnonzero(s == kth)
                more = at[: k - len(above)]
                if self.by_id:
                    more = np.union1d(more, at[np.argsort(ids[at], kind="stable")[:k]])
                found = np.concatenate([above, more])
            else:
                found = np.flatnonzero(s > 0)
                if not self.by_id and len(found) < k:  # documents whose terms weigh nothing
                    none = np.flatnonzero((s <= 0) & present[some].any(axis=0))
                    found = np.concatenate([found, none[: k - len(found)]])
            owner.append(np.full(len(found), i))
            chosen.append(found)
            scores.append(s[found])
        if chosen:
            at = np.concatenate(chosen)
            self.parts.append((np.concatenate(owner), ids[at], names.take(pa.array(at)), np.concatenate(scores)))
            self.held += len(at)

    def take(self, scores: np.ndarray, ids: np.ndarray, names: pa.Array, rows: np.ndarray) -> None:
        """Keep the k best of every row of scores, of whatever sign, of documents in the order of ties. ``rows`` are the queries' places."""
        n = scores.shape[1]
        if n > self.k:
            kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
        else:
            kth = np.full(len(scores), -np.inf)
        q, at = np.nonzero(scores >= np.maximum(kth, self.least[rows])[:, None])
        # rows are in order, and documents in the order of ties inside a row
        above = scores[q, at] > kth[q]
        ties = np.cumsum(~above) - np.repeat(*_runs(~above, q, len(scores)))
        room = self.k - np.bincount(q[above], minlength=len(scores))
        keep = above | (ties <= room[q])
        q, at = q[keep], at[keep]
        if n > self.k:
            self.least[rows] = np.maximum(self.least[rows], kth)
        self.parts.append((rows[q], ids[at], names.take(pa.array(at)), scores[q, at]))
        self.held += len(q)

    def joined(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        q, ids, names, scores = zip(*self.parts)
        return np.concatenate(q), np.concatenate(ids), pa.concat_arrays(names), np.concatenate(scores)

    def cut(self) -> None:
        """Keep what may be among the k best."""
        q, ids, names, scores = self.joined()
        place = np.empty(len(q), dtype=np.int64)
        place[pc.array_sort_indices(names, order="descending").to_numpy()] = np.arange(len(q))
        keep = np.zeros(len(q), dtype=bool)
        order = np.lexsort((place, -scores, q))
        first = np.searchsorted(q[order], np.arange(len(self.queries.qids)))
        keep[order[np.arange(len(q)) - first[q[order]] < self.k]] = True
        least = np.full(len(self.queries.qids), np.inf)
        np.minimum.at(least, q[keep], scores[keep])
        if self.by_id:
            at = np.flatnonzero(scores == least[q])
            at = at[np.lexsort((ids[at], q[at]))]
            first = np.searchsorted(q[at], np.arange(len(self.queries.qids)))
            keep[at[np.arange(len(at)) - first[q[at]] < self.k]] = True
        full = np.bincount(q, minlength=len(least)) >= self.k
        self.least = np.where(full & np.isfinite(least), np.maximum(self.least, least), self.least)
        self.parts = [(q[keep], ids[keep], names.filter(pa.array(keep)), scores[keep])]
        self.held = int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        if len(self.parts) > 1:
            self.cut()
        q, ids, names, scores = self.joined()
        qids = pa.DictionaryArray.from_arrays(pa.array(q.astype(np.int32)), pa.array(self.queries.qids, pa.string()))
        for at in range(0, len(q), 50_000):
            some = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [qids[some].cast(pa.string()), pa.array(ids[some]), names[some], pa.array(scores[some])], names=["qid", "doc_id", "doc_name", "score"]
            )


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_name").desc()]


def top_k(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k first of every qid by score, then doc_name, both descending, with their rank.

    ``row_number() <= k`` is pruned before the shuffle as well, so a query with very many candidates
    sends k rows per task.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    w = W.partitionBy("qid").orderBy(*_order())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def named(scores: DataFrame, index: Index) -> DataFrame:
    return scores.join(index.names, "doc_id")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("qid", "rank", "doc_id", "doc_name", F.round("score", 6).alias("score"))


def retrieve(
    index: Index, queries: DataFrame, method: str = "bm25", k: int = 10, k1: float = 1.6, b: float = 0.75
) -> DataFrame:
    """Top k of every query by ``tfidf``, ``bm25`` or ``bm25_wand``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    wand = method == "bm25_wand"
    method = "bm25" if wand else method
    batch = batch_of(queries, index)
    if batch is None:
        rows = named(scored(index, queries, method, k1, b), index)
    else:
        rows = best(index, batch, method, k, k1, b, wand)
    return _shown(top_k(admit(rows, k) if wand else rows, k))


def admit(scores: DataFrame, k: int) -> DataFrame:
    """What a document-at-a-time WAND pass keeps of exhaustive scores ``(qid, doc_id, doc_name, score)``.

    Only positive scores count. All documents above the k-th score are in. One at the k-th score is
    admitted only if fewer than k documents of at least that score come before it by id; the remaining
    places go to admitted ones by name, descending.
    """
    positive = scores.where("score > 0")
    last = F.min("score")
    theta = top_k(positive, k).groupBy("qid").agg(last.alias("theta"), F.count(F.lit(1)).alias("kept"))
    near = positive.join(theta, "qid").where("score >= theta")
    before = F.count(F.lit(1)).over(
        W.partitionBy("qid").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    )
    fits = (F.col("score") > F.col("theta")) | (F.col("before") < k) | (F.col("kept") < k)
    return near.withColumn("before", before).where(fits).drop("before", "theta", "kept")


def upper_bounds(index: Index, k1: float = 1.6, b: float = 0.75) -> DataFrame:
    """The score bound of every term."""
    rows = index.term_stats.crossJoin(F.broadcast(index.corpus_stats))
    bound = S.bm25_bound(F.col("max_tf"), S.idf(F.col("n"), F.col("df")), F.col("min_dl"), F.col("avdl"), k1, b)
    return rows.select("term", F.round(bound, 6).alias("bound"))


def weights(index: Index, method: str = "bm25", k1: float = 1.6, b: float = 0.75) -> DataFrame:
    """The weight of every posting."""
    rows = with_statistics(index.postings, index.term_stats.select("term", "df"))
    rows = rows.crossJoin(F.broadcast(index.corpus_stats)).withColumn("idf", S.idf(F.col("n"), F.col("df")))
    if method == "tfidf":
        weight = S.tfidf(F.col("tf"), F.col("idf"))
    else:
        rows = rows.join(index.doc_stats, "doc_id")
        weight = S.bm25(F.col("tf"), F.col("idf"), F.col("dl"), F.col("avdl"), k1, b)
    return rows.select("term", "doc_id", F.round(weight, 6).alias("weight"))


def latest_scores(results: DataFrame) -> DataFrame:
    """Usable rows of delivered rankings: a finite score, the latest of each (qid, doc_id)."""
    usable = results.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return usable.groupBy("qid", "doc_id").agg(
        F.max(F.struct("scored_at", "score", "doc_name")).alias("m")
    ).select("qid", "doc_id", F.col("m.doc_name").alias("doc_name"), F.col("m.score").alias("score"))
