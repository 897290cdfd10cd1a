"""Queries and SQL of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlex.llm import near_duplicates, packing, personal_data, similar_vectors, term_frequency, text_quality, tokenizer, top_n
from spanlex.session import durable, table


#: Words of a reference list at most; they become literals of the statistics.
COMMON_WORDS = 10_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten first documents of every query."""
    return top_n.top_n(table(spark, d, "results"), 10).select("qid", "doc_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly lists, tables or junk."""
    return text_quality.not_running(table(spark, d, "documents")).select("doc_id")


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics of every document."""
    rows = table(spark, d, "common_words").where("word is not null").limit(COMMON_WORDS + 1).collect()
    if len(rows) > COMMON_WORDS:
        raise ValueError(f"more than {COMMON_WORDS} common words")
    words = [r["word"] for r in rows]
    stats = text_quality.statistics(table(spark, d, "documents"), words)
    shares = [c for c, kind in stats.dtypes if kind == "double"]
    return stats.withColumns({c: F.round(c, 6) for c in shares})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    rows = term_frequency.term_frequencies(table(spark, d, "postings"))
    return rows.where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every term."""
    return term_frequency.term_frequencies(table(spark, d, "postings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents of which one is among the ten most similar of the other."""
    return similar_vectors.similar_pairs(table(spark, d, "lsi_docs"))


#: Tables, buckets asked in each, and how many times more with a second hash.
LISTS = {"tables": 6, "number": 8, "more": 16}


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar documents of every document whose id is divisible by 50, against all."""
    near = similar_vectors.neighbours(table(spark, d, "lsi_docs"), asks="doc_id % 50 = 0", **LISTS)
    return near.withColumn("similarity", F.round("similarity", 6))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Lists of ``p4_neighbours`` that were asked for, and whether they hold nine tenths of the exact ones."""
    one = similar_vectors.recall(table(spark, d, "lsi_docs"), "doc_id % 50 = 0", **LISTS)
    return one.select("asked", (F.col("recall") >= 0.9).alias("enough"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of texts that share at least four fifths of their words."""
    pairs = near_duplicates.near_duplicate_pairs(table(spark, d, "documents"))
    return pairs.select("doc_id_a", "doc_id_b")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with copies or near-duplicates: their class, its size and the number of classes it is linked to."""
    return near_duplicates.classes(table(spark, d, "documents"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_documents(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of each of its pieces if it is longer than one."""
    sizes = tokenizer.count_tokens(table(spark, d, "documents"))
    packed = packing.pack(sizes.select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size")))
    return packed.withColumnsRenamed({"id": "doc_id", "n": "n_tokens"})


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the containers: the documents in them, none overfull, only long ones split, and hardly more than the least possible number."""
    packed = durable(p8_containers(spark, d), "containers")
    one = packing.fill(packed.withColumnRenamed("n_tokens", "n"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("size"))
    split = docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.bool_and(F.expr("pieces = ceil(size / 2048)")), F.lit(True)).alias("only_long_split"))
    return one.crossJoin(F.broadcast(split)).select(  # two single rows
        "documents", "only_long_split", (F.col("largest") <= 2048).alias("none_overfull"), (F.col("containers") <= 1 + 1.01 * F.ceil(F.col("used") / 2048)).alias("well_filled")
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information found in the texts."""
    return personal_data.find(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders in place of personal information."""
    return personal_data.redact(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_statistics": p2_statistics,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

RANKED = """
with usable as (
  select qid, doc_id, doc_name, score + 0.0 as score, scored_at from results
  where score is not null and not isnan(score)),
latest as (
  select * from usable
  qualify row_number() over (partition by qid, doc_id
    order by scored_at desc nulls last, score desc, doc_name desc nulls last) = 1)
select qid, doc_id from latest
qualify row_number() over (partition by qid order by score desc, doc_name desc nulls last, doc_id desc nulls last) <= 10
"""

TERMS = """
with usable as (
  select doc_id, seg, lower(trim(term)) as term, tf, loaded_at from postings
  where term is not null and trim(term) <> '' and tf >= 1 and doc_id is not null),
current as (
  select doc_id, seg, term, tf from usable
  qualify row_number() over (partition by doc_id, seg, term order by loaded_at desc nulls last, tf desc) = 1),
counts as (
  select term, cast(sum(tf) as bigint) as occurrences, count(distinct doc_id) as records from current group by term),
marked as (
  select term, occurrences, records,
    case when records <= 2 then 'rare'
         when records > 0.5 * (select count(distinct doc_id) from current) then 'common' end as mark
  from counts)
"""

_USABLE = """
with usable as (
  select doc_id, vec, built_at from lsi_docs
  where doc_id is not null and vec is not null and len(vec) = 64
    and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
latest as (select doc_id, vec from usable qualify row_number() over (partition by doc_id order by built_at desc nulls last, vec desc) = 1)
"""

SIMILAR = _USABLE + """, pairs as (
  select a.doc_id as a, b.doc_id as b, list_cosine_similarity(a.vec, b.vec) as s from latest a, latest b where a.doc_id <> b.doc_id),
near as (select a, b, s from pairs qualify row_number() over (partition by a order by round(s, 12) desc, b) <= 10)
select distinct least(a, b) as doc_id_a, greatest(a, b) as doc_id_b from near where s >= 0.9
"""

_BAGS = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from documents where text is not null and doc_id is not null),
bags as (select doc_id, w, count(*) as n from words group by doc_id, w),
sizes as (select doc_id, sum(n) as size from bags group by doc_id having sum(n) >= 20),
overlap as (
  select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as shared
  from bags a join bags b on a.w = b.w and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
pairs as (
  select a as doc_id_a, b as doc_id_b from overlap join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where shared >= 0.8 * (x.size + y.size - shared) - 1e-9)
"""

NEAR_DUPLICATES = _BAGS + "select doc_id_a, doc_id_b from pairs"

CLASSES = _BAGS + """,
written as (select doc_id, string_agg(w || ' ' || n, ',' order by w) as s from bags where doc_id in (select doc_id from sizes) group by doc_id),
kinds as (select doc_id, min(doc_id) over (partition by s) as class_id, count(*) over (partition by s) as copies from written),
ends as (select doc_id_a as x, doc_id_b as y from pairs union all select doc_id_b, doc_id_a from pairs),
links as (
  select k.class_id, count(distinct o.class_id) as links from ends join kinds k on k.doc_id = x join kinds o on o.doc_id = y
  where k.class_id <> o.class_id group by k.class_id)
select doc_id, class_id, copies, coalesce(links, 0) as links from kinds left join links using (class_id) where copies > 1 or links > 0
"""

_SHARE = text_quality.LINE_SHARE
STATISTICS = rf"""
with common as (select list(word) as given from common_words where word is not null),
base as (
  select doc_id, text, given, regexp_replace(text, '[\s\x0b\x85\xa0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g') as solid,
    list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda l: regexp_matches(l, '\S')) as lines,
    list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '') as words,
    flatten(list_transform(regexp_split_to_array(lower(text), '\r\n|\r|\n'), lambda l: case when length(l) > {text_quality.LONG_LINE}
      then string_split(regexp_replace(l, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) else [l] end)) as parts
  from documents, common),
short as (
  select *, list_sort(list_filter(words, lambda w: length(w) <= {text_quality.SHORT} and not regexp_matches(w, '[0-9_]'))) as short from base),
own as (
  select *, list_distinct(list_filter(short, lambda w, i: i > 1 and w = short[i - 1])) as own,
    list_transform(parts, lambda p: {{'p': p, 'n': length(replace(p, ' ', '')), 'w': list_filter(regexp_split_to_array(p, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')}}) as cut
  from short),
judged as (
  select *, list_transform(cut, lambda x: {{'n': x.n, 'words': len(x.w),
    'hits': len(list_filter(x.w, lambda w, i: list_contains(({list(dict.fromkeys(text_quality.FUNCTION_WORDS))!r}), w) and (i > 1 or length(w) > 1))),
    'own': len(list_filter(x.w, lambda w: list_contains(own, w))), 'kinds': len(list_distinct(list_filter(x.w, lambda w: list_contains(own, w)))),
    'letters': length(regexp_replace(x.p, '[^\p{{L}}]+', '', 'g'))}}) as j from own),
counted as (
  select doc_id, text, length(solid) as n_chars, len(words) as n_words, len(lines) as n_lines, len(list_distinct(words)) as n_distinct,
    length(regexp_replace(solid, '[^\p{{L}}\p{{N}}_]+', '', 'g')) as word_chars, len(short) - len(list_distinct(short)) as repeated,
    coalesce(list_sum(list_transform(j, lambda x: x.n)), 0) as part_chars, coalesce(list_sum(list_transform(j, lambda x: x.hits)), 0) as hits,
    coalesce(list_sum(list_transform(list_filter(j, lambda x: x.words >= 3 and x.hits >= {_SHARE} * x.words), lambda x: x.n)), 0) as running_chars,
    coalesce(list_sum(list_transform(list_filter(j, lambda x: (x.words >= 3 and x.hits >= {_SHARE} * x.words)
      or (x.words >= 5 and x.kinds >= 2 and x.own >= {_SHARE} * x.words and x.letters >= {text_quality.LETTERS} * x.n)), lambda x: x.n)), 0) as echo_chars,
    length(regexp_replace(solid, '[^\p{{N}}]+', '', 'g')) as digits, length(regexp_replace(solid, '[^\p{{L}}]+', '', 'g')) as letters,
    len(list_filter(lines, lambda l: regexp_matches(l, '[.!?:;]\s*$'))) as ended,
    len(list_filter(words, lambda w: list_contains(given, w))) as common
  from judged)
select doc_id, n_chars, n_words, n_lines, round(word_chars / nullif(n_words, 0), 6) as mean_word, round(common / nullif(n_words, 0), 6) as common_share,
  round(hits / nullif(n_words, 0), 6) as function_share, round(running_chars / nullif(part_chars, 0), 6) as running,
  round(echo_chars / nullif(part_chars, 0), 6) as echoing, round(repeated / nullif(n_words, 0), 6) as repeated_short,
  round(digits / nullif(n_chars, 0), 6) as digit_ratio, round(letters / nullif(n_chars, 0), 6) as letter_ratio,
  round((n_chars - digits - letters) / nullif(n_chars, 0), 6) as symbol_ratio, round(ended / nullif(n_lines, 0), 6) as punct_lines,
  round(n_words / nullif(n_lines, 0), 6) as words_per_line, round(n_distinct / nullif(n_words, 0), 6) as distinct_share,
  round(n_chars / nullif(n_words, 0), 6) as mean_gap
from counted
"""

ORACLE = {
    "p8_fill": "select count(distinct doc_id) as documents, true as only_long_split, true as none_overfull, true as well_filled from documents where length(text) > 0",
    "p2_statistics": STATISTICS,
    "p2_found": f"""with s as ({STATISTICS}), f as (select doc_id, n_chars, {", ".join(f"coalesce({c}, 0) as {c}" for c in text_quality.FEATURES)} from s)
select doc_id from f where n_chars >= 80 and {text_quality.case_expression(text_quality.load_rules()).replace("D ", "e0 ")} > 0""",
    "p4_found": SIMILAR,
    "p4_recall": _USABLE + "select count(*) as asked, true as enough from latest where doc_id % 50 = 0",
    "p5_found": NEAR_DUPLICATES,
    "p5_classes": CLASSES,
    "p1_found": RANKED,
    "p3_found": TERMS + "select term, mark from marked where mark is not null",
    "p3_terms": TERMS + "select * from marked",
}
