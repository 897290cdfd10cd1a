"""Effectiveness of whole batches of queries, measured where the documents are ranked.

Deep rankings of many queries are far more rows than anything else here, and all that is wanted of them is a few numbers
per query. Queries are divided into groups; a task has all documents for one group, keeps the k best of each of its queries
in bounded memory, and evaluates the rankings itself. The rankings are those of ``retrieve`` and of ``lsi.retrieve``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlex.functions import scoring as S
from spanlex.operators.evaluate import METRICS, clean_qrels, values_of
from spanlex.operators.index import Index, vocabulary
from spanlex.operators.krylov import load, save, uri_of
from spanlex.operators.lsi import Model, fold, unit_documents
from spanlex.operators.retrieve import CELLS, Batch, batch_of, hits_of
from spanlex.session import discard, durable, fresh_path

#: Rows a task keeps for its group of queries, postings of a block of documents, and judgments that are sent to all tasks.
ROWS, HITS, JUDGED = 4_000_000, 2_000_000, 2_000_000
#: Documents whose vectors a task holds at a time, and numbers of a block of their cosines.
VECTORS, COSINES = 16_384, 1_000_000
SCHEMA = "method string, qid string, " + ", ".join(f"{m} double" for m in METRICS)

#: Scores, places of names, and ids of the documents kept of a query.
Kept = tuple[np.ndarray, np.ndarray, np.ndarray]


def cut(kept: Kept, k: int, by_id: bool) -> Kept:
    """The k best by score and name; with ``by_id`` also the first k by id of those at the k-th score."""
    score, name, ids = kept
    if len(score) <= k:
        return kept
    kth = np.partition(score, len(score) - k)[len(score) - k]
    above, at = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
    need = k - len(above)
    keep = at[np.argpartition(-name[at], need - 1)[:need]] if need < len(at) else at
    if by_id:
        keep = np.union1d(keep, at[np.argpartition(ids[at], k - 1)[:k]] if k < len(at) else at)
    keep = np.concatenate([above, keep])
    return score[keep], name[keep], ids[keep]


def joined(a: Kept | None, b: Kept, k: int, by_id: bool) -> Kept:
    return cut(b if a is None else tuple(np.concatenate(x) for x in zip(a, b)), k, by_id)


def ranked(kept: Kept, k: int) -> np.ndarray:
    """Ids of the k best, by score and name, both descending."""
    score, name, ids = kept
    return ids[np.lexsort((-name, -score))[:k]]


def admitted(kept: Kept, k: int) -> np.ndarray:
    """Ids of the k best under WAND's rule of admission, see ``retrieve.admit``."""
    positive = kept[0] > 0
    score, name, ids = (x[positive] for x in kept)
    if len(score) > k:
        theta = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= theta)
        near = near[np.argsort(ids[near], kind="stable")]
        near = near[(score[near] > theta) | (np.arange(len(near)) < k)]
        score, name, ids = score[near], name[near], ids[near]
    return ranked((score, name, ids), k)


class Judgments:
    """Relevance by query and document."""

    def __init__(self, rows: pa.Table, qids: list[str]):
        place = {q: i for i, q in enumerate(qids)}
        q = np.array([place.get(x, -1) for x in rows.column("qid").to_pylist()], dtype=np.int64)
        ids, rel = rows.column("doc_id").to_numpy(), rows.column("rel").to_numpy().astype(float)
        order = np.lexsort((ids, q))
        self.ids, self.rel = ids[order], rel[order]
        self.start = np.searchsorted(q[order], np.arange(len(qids) + 1))

    def of(self, q: int, ids: np.ndarray) -> np.ndarray:
        some = slice(self.start[q], self.start[q + 1])
        known, rel, out = self.ids[some], self.rel[some], np.zeros(len(ids))
        if len(known):
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            out = np.where(known[at] == ids, rel[at], 0.0)
        return out


def rows_of(method: str, found: Iterator[tuple[int, np.ndarray]], qids: list[str], judgments: Judgments, first: int) -> pa.RecordBatch:
    """The metrics of rankings ``(query, ids)``; queries without any are left out."""
    names, values = [], []
    for i, ids in found:
        if len(ids):
            names.append(qids[i])
            values.append(values_of(judgments.of(first + i, ids)))
    columns = [pa.array([v[m] for v in values], pa.float64()) for m in range(len(METRICS))]
    return pa.RecordBatch.from_arrays([pa.array([method] * len(names), pa.string()), pa.array(names, pa.string()), *columns], names=["method", "qid", *METRICS])


def judgments_of(qrels: DataFrame, qids: list[str]) -> Judgments | None:
    rows = clean_qrels(qrels).where("rel <> 0").limit(JUDGED + 1).toArrow()
    return None if rows.num_rows > JUDGED else Judgments(rows, qids)


def by_groups(rows: DataFrame, number: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Run with ``g`` in front of all rows, a task per group; as many groups at a time as there are cores, for each needs all rows."""
    wave, out = width_of(rows), None
    for at in range(0, number, wave):
        some = min(wave, number - at)
        each = rows.select(F.explode(F.sequence(F.lit(at), F.lit(at + some - 1))).alias("g"), "*")
        found = durable(each.repartitionById(some, F.col("g") - at).mapInArrow(run, SCHEMA), "measured")
        out = found if out is None else out.unionByName(found)
    return out


def width_of(rows: DataFrame) -> int:
    return max(1, rows.sparkSession.sparkContext.defaultParallelism)


def groups_of(queries: int, k: int, width: int) -> int:
    """Queries of a group: enough groups for all tasks, and none with more rows than a task may keep."""
    return max(1, min(math.ceil(queries / max(1, width)), ROWS // k))


def with_places(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the place of the document's name among all, so that names need not travel; null names come first."""
    ids = vocabulary(names.select(F.col("doc_name").alias("term"))).withColumnsRenamed({"term": "doc_name", "term_id": "place"})
    return rows.join(names.join(ids, "doc_name", "left").select("doc_id", F.coalesce("place", F.lit(-1)).alias("place")), "doc_id")


class _Group:
    """The best documents of a group of queries so far, by tf-idf and by BM25."""

    def __init__(self, queries: Batch, kinds: list[str], idf: np.ndarray, avdl: float, k: int, by_id: bool, k1: float, b: float):
        self.queries, self.kinds, self.idf, self.avdl, self.k, self.by_id, self.k1, self.b = queries, kinds, idf, avdl, k, by_id, k1, b
        self.kept: dict[str, list[Kept | None]] = {m: [None] * len(queries.qids) for m in kinds}

    def score(self, ids: np.ndarray, place: np.ndarray, dl: np.ndarray, doc: np.ndarray, t: np.ndarray, tf: np.ndarray) -> None:
        q, n = self.queries, len(ids)
        order = np.argsort(t, kind="stable")
        doc, t, tf = doc[order], t[order].astype(np.int64), tf[order].astype(float)
        start = np.searchsorted(t, np.arange(len(q.terms) + 1))
        weight = {m: S.weights_of(m, tf, self.idf[t], dl[doc], self.avdl, self.k1, self.b) for m in self.kinds}
        for i in range(len(q.qids)):
            some = range(q.start[i], q.start[i + 1])
            lists = [(slice(start[p], start[p + 1]), q.times[j]) for j in some if start[p := q.place[j]] < start[p + 1]]
            if not lists:
                continue
            docs = np.concatenate([doc[s] for s, _ in lists])
            if len(lists) > 1:
                mark = np.zeros(n, dtype=bool)
                mark[docs] = True
                found = np.flatnonzero(mark)
            else:
                found = docs
            for m in self.kinds:
                values = np.concatenate([times * weight[m][s] for s, times in lists])
                total = np.round(np.bincount(docs, values, minlength=n)[found] if len(lists) > 1 else values, 9)
                kept = self.kept[m][i]
                some = found
                if len(total) > self.k:
                    good = total >= np.partition(total, len(total) - self.k)[len(total) - self.k]
                    total, some = total[good], found[good]
                self.kept[m][i] = joined(kept, (total, place[some], ids[some]), self.k, self.by_id and m == "bm25")


def measured(index: Index, queries: DataFrame, qrels: DataFrame, methods: tuple[str, ...], k: int, k1: float = 1.6, b: float = 0.75) -> DataFrame | None:
    """``(method, qid, RBP, DCG, NDCG, AP)`` of the rankings of ``tfidf``, ``bm25`` and ``bm25_wand``; None for too large a batch."""
    if k < 1:
        raise ValueError("k must be at least 1")
    batch = batch_of(queries, index)
    judgments = judgments_of(qrels, batch.qids) if batch else None
    if not judgments or ROWS < k:
        return None
    hits, df = hits_of(index, batch)
    lengths = durable(index.doc_stats, "lengths")
    whole = lengths.where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dl").cast("double")).alias("avdl")).first()
    n_docs, avdl = max(1, whole["n"]), whole["avdl"] or 1.0
    idf = np.where(df > 0, np.log(n_docs / np.maximum(df, 1)), 0.0)
    rows = with_places(hits.join(lengths, "doc_id"), index.names)
    short = "array<smallint>" if len(batch.terms) < 1 << 15 else "array<int>"
    rows = durable(rows.select("doc_id", "place", "dl", F.col("x.t").cast(short).alias("t"), F.col("x.tf").cast("array<int>").alias("tf")), "matches")
    size = groups_of(len(batch.qids), k, width_of(rows))
    number = max(1, math.ceil(len(batch.qids) / size))
    kinds, by_id = sorted({"bm25" if m == "bm25_wand" else m for m in methods}), "bm25_wand" in methods

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, held, number_of = None, 0, [], 0

        def score() -> None:
            sizes = np.concatenate([np.diff(x.column(4).offsets.to_numpy()) for x in held])
            doc = np.repeat(np.arange(len(sizes)), sizes)
            ids, place, dl = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (1, 2, 3))
            t, tf = (np.concatenate([x.column(c).flatten().to_numpy() for x in held]) for c in (4, 5))
            group.score(ids, place, dl, doc, t, tf)
            held.clear()

        for part in batches:
            if not part.num_rows:
                continue
            if group is None:
                first = part.column(0)[0].as_py() * size
                group = _Group(batch.some(first, first + size), kinds, idf, avdl, k, by_id, k1, b)
            held.append(part)
            number_of += len(part.column(4).flatten())
            if number_of > HITS:
                score()
                number_of = 0
        if group is None:
            return
        if held:
            score()
        for m in methods:
            kept = enumerate(group.kept["bm25" if m == "bm25_wand" else m])
            choose = admitted if m == "bm25_wand" else ranked
            yield rows_of(m, ((i, choose(x, k)) for i, x in kept if x is not None), group.queries.qids, judgments, first)

    return by_groups(rows, number, run)


def measured_lsi(index: Index, model: Model, queries: DataFrame, qrels: DataFrame, k: int) -> DataFrame | None:
    """``(method, qid, RBP, DCG, NDCG, AP)`` of the rankings of ``lsi.retrieve``; None for too large a batch.

    The vectors of documents are written once, as files that the task of every group of queries reads one after the other.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    batch = batch_of(queries, index)
    judgments = judgments_of(qrels, batch.qids) if batch else None
    spark = index.postings.sparkSession
    if not judgments or ROWS < k:
        return None
    if not model.sigma or not batch.qids:
        return spark.createDataFrame([], SCHEMA)
    folder = uri_of(fresh_path(spark, "vectors"))
    files = _vector_files(with_places(unit_documents(model), index.names).select("doc_id", "place", "vec"), folder)
    most, out = max(1, CELLS // model.k), None
    for at in range(0, len(batch.qids), most):
        some = batch.some(at, at + most)
        vectors = fold(index, model, some)
        size = groups_of(len(some.qids), k, width_of(index.postings))
        number = math.ceil(len(some.qids) / size)
        for g in range(number):
            save(f"{folder}/queries/{g}.npz", x=vectors[g * size : (g + 1) * size])
        found = durable(spark.range(0, number, 1, number).mapInArrow(_lsi_groups(folder, files, some.qids, judgments, at, size, k), SCHEMA), "measured")
        out = found if out is None else out.unionByName(found)
    discard(spark, folder)
    return out


def _vector_files(docs: DataFrame, folder: str) -> list[str]:
    """Ids, places of names and vectors as files below the folder; their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def write() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            vec = np.concatenate([b.column(2).flatten().to_numpy().reshape(b.num_rows, -1) for b in held])
            save(f"{folder}/{name}.npz", ids=np.concatenate([b.column(0).to_numpy() for b in held]), place=np.concatenate([b.column(1).to_numpy() for b in held]), vec=vec)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                held.append(batch.slice(at, VECTORS))
                number += held[-1].num_rows
                if number >= VECTORS:
                    yield write()
                    number = 0
        if held:
            yield write()

    return sorted(r["name"] for r in docs.mapInArrow(run, "name string").collect())  # a row per file


def _lsi_groups(folder: str, files: list[str], qids: list[str], judgments: Judgments, first: int, size: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Evaluates the rankings of groups of queries by the cosines of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in (g for batch in batches for g in batch.column(0).to_pylist()):
            asked = load(f"{folder}/queries/{g}.npz")["x"]
            there = np.flatnonzero(asked.any(axis=1))
            kept: list[Kept | None] = [None] * len(asked)
            least = np.full(len(asked), -np.inf)
            for name in files:
                docs = load(f"{folder}/{name}.npz")
                ids, place, vec = docs["ids"], docs["place"], docs["vec"]
                step = max(1, COSINES // len(ids))
                for at in range(0, len(there), step):
                    rows = there[at : at + step]
                    scores = asked[rows] @ vec.T
                    for i, own in zip(rows, scores):
                        found = np.flatnonzero(own >= least[i] - 1e-9)  # others are below the k-th score, rounded or not
                        if not len(found):
                            continue
                        kept[i] = joined(kept[i], (np.round(own[found], 9), place[found], ids[found]), k, False)
                        if len(kept[i][0]) == k:
                            least[i] = kept[i][0].min()
            rankings = ((i, ranked(kept[i], k)) for i in there if kept[i] is not None)
            yield rows_of("lsi", rankings, qids[g * size : (g + 1) * size], judgments, first + g * size)

    return run


def means(values: DataFrame) -> DataFrame:
    """``(method, metric, value)``: the mean of every metric over the queries of a method."""
    rows = values.groupBy("method").agg(*(F.avg(m).alias(m) for m in METRICS))
    return rows.select("method", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m in METRICS))).alias("x")).select("method", "x.*")
