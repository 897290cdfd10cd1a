"""Partial postings as index runs deliver them: cleaning, and per-term results under skew.

Input is ``postings(doc_id, seg, term, tf, loaded_at)`` with null, blank and differently spelled terms,
unusable frequencies, repeated and corrected rows. Defined results:

* rows with a null or blank term, a null or non-positive tf or a null doc_id are left out;
* terms are lower-cased and trimmed of spaces;
* of the rows of one (doc_id, seg, term) the latest ``loaded_at`` counts; a null ``loaded_at`` is the
  earliest, a null ``seg`` is a passage of its own; rows equal in ``loaded_at`` count once, the larger tf;
* an empty table gives an empty result; further columns are ignored.

How it runs, a two-stage salted aggregation:

1. One pass finds the heavy terms with a frequent-items sketch of bounded size. A term is heavy if it holds
   more than one in ``SHARE * tasks`` of all rows, so there are at most ``SHARE * tasks`` of them, whatever
   the data, and that bound is what makes them fit for a broadcast.
2. Rows of a heavy term get one of as many salts as it takes to bring each under that share; other terms
   have salt 0. The salt is a pseudo-random number drawn from the document id: a retried task draws the same,
   and the rows of one (term, document), whose corrections have to be resolved, stay together. Rows are shuffled
   by (term, salt), so no task gets a large part of a frequent term, nor of a document that holds many rows.
3. Inside a task one sort serves all further steps, which stream: nothing but the sorter grows with the
   data, and it spills. Partial results per (term, salt) are merged by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlex.session import shuffle_width

#: Bytes of (compressed) input per task of the sorted pass.
TASK_BYTES = 6 << 20
#: Spark reports no less than this for frames whose size it doesn't know.
UNKNOWN_BYTES = 1 << 55
#: A term is heavy if it holds more than one in this many times the tasks of all rows.
SHARE = 4
#: Terms a sketch keeps at most, whatever the number of tasks.
TRACKED = 1_000_000
#: Frequencies and ids below these limits are compared as one number.
ID_BITS, TF_BITS = 40, 23


def clean_term(term: Column) -> Column:
    """Lower case, no surrounding spaces."""
    return F.lower(F.trim(term))


def usable(postings: DataFrame) -> DataFrame:
    """Rows that count, terms cleaned, before corrected rows are resolved."""
    return (
        postings.where("term is not null and tf >= 1 and doc_id is not null")
        .select("doc_id", "seg", clean_term(F.col("term")).alias("term"), "tf", "loaded_at")
        .where("term <> ''")
    )


def current(postings: DataFrame) -> DataFrame:
    """``(doc_id, seg, term, tf)`` after cleaning, the latest row of each (doc_id, seg, term)."""
    newest = F.max(F.struct("loaded_at", "tf")).alias("m")
    return usable(postings).groupBy("doc_id", "seg", "term").agg(newest).select("doc_id", "seg", "term", "m.tf")


def task_count(df: DataFrame) -> int:
    """Tasks of a sorted pass: the configured number, or more for a larger input of known size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_BYTES:
        return shuffle_width(df.sparkSession)
    return max(shuffle_width(df.sparkSession), min(100_000, -(-size // TASK_BYTES)))


def heavy_terms(rows: DataFrame, most: int) -> DataFrame:
    """``(term, salts)`` of the terms that hold more than one in ``most`` of the rows: at most ``most`` of them.

    The sketch overstates a count by less than 1 / (3 * most) of the rows, and misses no such term.
    """
    tracked = min(TRACKED, max(1024, 8 * most))
    sketch = rows.agg(F.expr(f"approx_top_k(term, {min(most, tracked)}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = sketch.select(F.explode("top").alias("t"), "n").where(F.col("t.count") * most > F.col("n"))
    heavy = found.select(F.col("t.item").alias("term"), F.ceil(F.col("t.count") * most / F.col("n")).cast("int").alias("salts"))
    return rows.sparkSession.createDataFrame(heavy.collect(), heavy.schema)  # at most ``most`` rows


def salted(postings: DataFrame, most: int | None = None) -> DataFrame:
    """Usable rows with their ``salt``, partitioned by (term, salt)."""
    tasks = task_count(postings)
    rows = usable(postings)
    heavy = heavy_terms(rows, most or SHARE * tasks)
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")
    marked = rows.join(F.broadcast(heavy), "term", "left").withColumn("salt", salt).drop("salts")
    return marked.repartition(tasks, "term", "salt")


def ordered(postings: DataFrame, most: int | None = None) -> DataFrame:
    """Usable rows by term, salt, document and passage, seen with the row before and the row behind.

    Columns ``h, term, salt, doc_id, tf``, ``counts`` on the row of a passage that counts, and ``last_record``: the
    document of the row before of the same term and salt, null for the first. The hash in front of the term
    lets the sorter compare numbers before strings.
    """
    w = W.partitionBy("h", "term", "salt").orderBy("doc_id", "seg", "loaded_at", "tf")
    seen = (
        salted(postings, most)
        .withColumn("h", F.xxhash64("term"))
        .withColumn("last_record", F.lag("doc_id").over(w))
        .withColumn("next_record", F.lead("doc_id").over(w))
        .withColumn("next_seg", F.lead("seg").over(w))
    )
    ends = F.col("next_record").isNull() | (F.col("next_record") != F.col("doc_id"))
    return seen.select(
        "h", "term", "salt", "doc_id", "tf", (ends | ~F.col("next_seg").eqNullSafe(F.col("seg"))).alias("counts"), "last_record"
    )


def document_totals(postings: DataFrame, most: int | None = None) -> DataFrame:
    """``(term, salt, doc_id, tf)``: current frequencies summed over passages.

    Rows arrive sorted by (h, term, salt, doc_id), so the aggregation streams over them; the maximum of a
    string is there to make the planner keep to the sorted form, which needs no hash table.
    """
    rows = ordered(postings, most).where("counts")
    sums = rows.groupBy("h", "term", "salt", "doc_id").agg(F.sum("tf").alias("tf"), F.max("term").alias("same"))
    return sums.where("same is not null").select("term", "salt", "doc_id", "tf")


def top_document(postings: DataFrame, most: int | None = None) -> DataFrame:
    """``(term, doc_id, tf)``: the document where each term is most frequent, the smallest id among equals.

    Partials per (term, salt), then their merge by term. Both keep one
    comparable number per term: the frequency in front of the reversed id. Values too large for that
    are compared as a wide decimal instead, so the result is exact for any input.
    """
    top_id = (1 << ID_BITS) - 1
    small = F.col("doc_id").between(0, top_id) & (F.col("tf") < (1 << TF_BITS))
    packed = F.when(small, F.shiftleft("tf", ID_BITS) + (F.lit(top_id) - F.col("doc_id")))
    # tf * 2^64 - doc_id: orders by tf, then by smaller id, for all 64-bit ids
    wide = F.when(~small, F.expr(f"cast(tf as decimal(19,0)) * {1 << 62}BD * 4BD - doc_id"))
    best = (
        document_totals(postings, most)
        .select("term", "salt", packed.alias("packed"), wide.cast("decimal(38,0)").alias("wide"))
        .groupBy("term", "salt")
        .agg(F.max("packed").alias("packed"), F.max("wide").alias("wide"))
        .groupBy("term")
        .agg(F.max("packed").alias("packed"), F.max("wide").alias("wide"))
    )
    tf_p, id_p = F.expr(f"shiftright(packed, {ID_BITS})"), F.lit(top_id) - F.col("packed").bitwiseAND(F.lit(top_id))
    # tf = round(wide / 2^64) as |doc_id| <= 2^63; ids at the very edge round the right way by the shift of a half
    tf_w = F.expr(f"cast(ceil((wide - {1 << 63}BD) / ({1 << 62}BD * 4BD)) as bigint)")
    id_w = F.expr(f"cast(tf_w * ({1 << 62}BD * 4BD) - wide as bigint)")
    rows = best.select("term", tf_p.alias("tf_p"), id_p.alias("id_p"), "wide", tf_w.alias("tf_w"))
    rows = rows.withColumn("id_w", F.when(F.col("wide").isNotNull(), id_w))
    use_w = F.col("wide").isNotNull() & (
        F.col("tf_p").isNull()
        | (F.col("tf_w") > F.col("tf_p"))
        | ((F.col("tf_w") == F.col("tf_p")) & (F.col("id_w") < F.col("id_p")))
    )
    return rows.select(
        "term",
        F.when(use_w, F.col("id_w")).otherwise(F.col("id_p")).alias("doc_id"),
        F.when(use_w, F.col("tf_w")).otherwise(F.col("tf_p")).alias("tf"),
    )


def term_totals(postings: DataFrame, most: int | None = None) -> DataFrame:
    """``(term, df, cf, max_tf)`` of every term, by the same two stages."""
    partial = document_totals(postings, most).groupBy("term", "salt").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")
    )
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))
