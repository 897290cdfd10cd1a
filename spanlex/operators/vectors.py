"""Inner-product top-k of a bounded set of query vectors against all document vectors, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spanlex.operators.retrieve import CELLS, DOCUMENTS, HELD, Batch, _Task


def nearest(docs: DataFrame, qids: list[str], vectors: np.ndarray, k: int) -> DataFrame:
    """``(qid, doc_id, doc_name, score)``: of every task the k best documents of each query, for a final ranking.

    ``docs(doc_id, doc_name, vec)`` are compared where they lie, in blocks; a task sends on k rows per query.
    The query vectors go to all tasks, so they have to be bounded by the caller. Scores are rounded to nine
    digits, and ties go by name, descending.
    """
    none = np.empty(0, dtype=np.int64)
    asked = Batch(qids, none, none, none, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(asked, k, False, -np.inf)
        size = max(16, min(DOCUMENTS, CELLS // max(1, len(qids))))
        for batch in batches:
            for at in range(0, batch.num_rows if qids else 0, size):
                block = batch.slice(at, size)
                order = pc.array_sort_indices(block.column(1), order="descending").to_numpy()
                rows = block.column(2).flatten().to_numpy().reshape(block.num_rows, -1)[order]
                scores = vectors @ rows.T
                some = np.flatnonzero(scores.max(axis=1) >= task.least - 1e-9)  # others can't reach their k-th score, rounded or not
                task.take(np.round(scores[some], 9), block.column(0).to_numpy()[order], block.column(1).take(pa.array(order)), some)
                if task.held > HELD:
                    task.cut()
        yield from task.rows()

    return docs.select("doc_id", "doc_name", "vec").mapInArrow(run, "qid string, doc_id bigint, doc_name string, score double")
