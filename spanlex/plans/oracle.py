"""The registry's results in SQL, built from shared common table expressions."""

from __future__ import annotations

from spanlex.functions.codec import BLOCK
from spanlex.functions.stemmer import examples
from spanlex.functions.stopwords import ENGLISH
from spanlex.operators.index import PART

K1, B = "1.6", "0.75"

TOKENS = r"""
tokens as (
  select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term
  from documents where text is not null and doc_id is not null),
post as (select doc_id, term, count(*) as tf from tokens group by doc_id, term)"""

STOP = "(" + ", ".join(f"'{w}'" for w in ENGLISH) + ")"

STATS = """,
tstat as (select term, count(*) as df, max(tf) as max_tf, cast(sum(tf) as bigint) as cf from post group by term),
dstat as (select doc_id, cast(sum(tf) as bigint) as dl from post group by doc_id),
corpus as (select count(*) as n, avg(cast(dl as double)) as avdl, coalesce(min(dl), 1) as min_dl from dstat)"""

IDF = "ln(cast(n as double) / cast(df as double))"
TFIDF = f"({IDF}) * (1.0e0 + ln(cast(tf as double)))"


def bm25(tf: str, dl: str) -> str:
    k1, b = f"cast({K1} as double)", f"cast({B} as double)"
    return f"({IDF}) * (({k1} + 1) * {tf}) / ({k1} * ((1 - {b}) + {b} * ({dl} / avdl)) + {tf})"


QTERMS = r""",
qtext as (select qid, max(text) as text from queries where qid is not null group by qid),
qterm as (
  select qid, term, count(*) as qtf
  from (select qid, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from qtext where text is not null)
  group by qid, term)"""


def scores(method: str, source: str = "qterm") -> str:
    weight = TFIDF if method == "tfidf" else bm25("tf", "dl")
    return f""",
scored as (
  select qid, p.doc_id, any_value(doc_name) as doc_name, round(sum(qtf * {weight}), 9) as score
  from {source} q join post p using (term) join tstat using (term) join dstat using (doc_id)
    join (select doc_id, doc_name from documents) d on d.doc_id = p.doc_id, corpus
  group by qid, p.doc_id)"""


def ranked(source: str = "scored", k: int = 10, name: str = "ranked") -> str:
    return f""",
{name} as (
  select qid, row_number() over (partition by qid order by score desc, doc_name desc) as rank, doc_id, doc_name, score
  from {source}
  qualify row_number() over (partition by qid order by score desc, doc_name desc) <= {k})"""


def wand(k: int) -> str:
    return f""",
positive as (select * from scored where score > 0){ranked('positive', k, 'firstk')},
theta as (select qid, min(score) as theta, count(*) as kept from firstk group by qid),
near as (
  select p.*, theta, kept,
    count(*) over (partition by p.qid order by doc_id rows between unbounded preceding and 1 preceding) as before
  from positive p join theta t on p.qid = t.qid where score >= theta),
admitted as (select * from near where score > theta or before < {k} or kept < {k})"""


SHOW = " select qid, rank, doc_id, doc_name, round(score, 6) as score from ranked"

VB = "(1 + " + " + ".join(f"(case when {{v}} >= {1 << 7 * g} then 1 else 0 end)" for g in range(1, 9)) + ")"


def vb(v: str) -> str:
    return VB.replace("{v}", v)


def bits(v: str) -> str:
    return f"(case when {v} <= 0 then 0 else length(bin({v})) end)"


GAPS = """,
gaps as (
  select term, doc_id, tf, doc_id - lag(doc_id, 1, 0) over (partition by term order by doc_id) as gap,
    row_number() over (partition by term order by doc_id) as pos
  from post)"""


def pfor(value: str, name: str) -> str:
    wide = f"{bits(value)} > b"
    return f""",
{name}_ranked as (
  select term, (pos - 1) // {BLOCK} as block, {value},
    count(*) over (partition by term, (pos - 1) // {BLOCK}) as n,
    row_number() over (partition by term, (pos - 1) // {BLOCK} order by {value}) - 1 as r
  from gaps),
{name}_width as (
  select term, block, max(n) as n, max(case when r = (9 * (n - 1)) // 10 then {bits(value)} end) as b
  from {name}_ranked group by term, block),
{name}_size as (
  select term, cast(4 + sum(7 + slots + patches) as bigint) as bytes
  from (
    select r.term, r.block, ceil(max(w.n) * max(b) / 8.0) as slots,
      sum(case when {wide} then {vb(value)} + 1 else 0 end) as patches
    from {name}_ranked r join {name}_width w on r.term = w.term and r.block = w.block
    group by r.term, r.block)
  group by term)"""


SIZES = {
    "standard": "select term, 8 * count(*) as postings_bytes, 8 * count(*) as tfs_bytes from post group by term",
    "vbe": f"select term, cast(sum({vb('gap')}) as bigint) as postings_bytes, cast(sum({vb('tf')}) as bigint) as tfs_bytes from gaps group by term",
    "optpfordelta": "select i.term, i.bytes as postings_bytes, t.bytes as tfs_bytes from ids_size i join tfs_size t on i.term = t.term",
}

PARTIAL = """
with usable as (
  select doc_id, seg, lower(trim(term)) as term, tf, loaded_at from postings
  where term is not null and trim(term) <> '' and tf >= 1 and doc_id is not null),
current as (
  select doc_id, seg, term, tf from usable
  qualify row_number() over (partition by doc_id, seg, term order by loaded_at desc nulls last, tf desc) = 1),
totals as (select term, doc_id, cast(sum(tf) as bigint) as tf from current group by term, doc_id)
"""

JUDGED = """
with usable as (select * from results where score is not null and not isnan(score)),
latest as (
  select * from usable
  qualify row_number() over (partition by qid, doc_id order by scored_at desc nulls last, score desc, doc_name desc nulls last) = 1),
ranking as (
  select qid, doc_id, row_number() over (partition by qid order by score desc, doc_name desc) as rank from latest
  qualify row_number() over (partition by qid order by score desc, doc_name desc) <= 1000),
rels as (select qid, doc_id, max(coalesce(rel, 0)) as rel from qrels where qid is not null and doc_id is not null group by qid, doc_id),
judged as (select r.qid, r.rank, coalesce(rel, 0) as rel from ranking r left join rels on r.qid = rels.qid and r.doc_id = rels.doc_id)
"""

METRICS = {
    "RBP": "select qid, cast(0.2 as double) * sum(rel * pow(cast(0.8 as double), rank - 1)) as value from {j} group by qid",
    "DCG": "select qid, sum(rel / log2(rank + 1)) as value from {j} group by qid",
    "NDCG": """select qid, case when sum(rel) = 0 then null else sum(rel / log2(rank + 1)) / sum(rel / log2(best + 1)) end as value
      from (select *, row_number() over (partition by qid order by rel desc, rank) as best from {j}) group by qid""",
    "AP": """select qid, sum(precision * rel) / count(*) as value
      from (select *, avg(cast(rel as double)) over (partition by qid order by rank rows between unbounded preceding and current row) as precision from {j})
      group by qid""",
}


def metric(name: str, judged: str = "judged") -> str:
    return METRICS[name].replace("{j}", judged)


def mean_of_methods() -> str:
    """Three rankings of the same collection, judged and averaged."""
    parts, selects = ["with" + TOKENS + STATS + QTERMS], []
    parts.append(", rels as (select qid, doc_id, max(coalesce(rel, 0)) as rel from qrels where qid is not null and doc_id is not null group by qid, doc_id)")
    for method in ("tfidf", "bm25", "bm25_wand"):
        block = scores("tfidf" if method == "tfidf" else "bm25")
        block += wand(1000) + ranked("admitted", 1000) if method == "bm25_wand" else ranked("scored", 1000)
        for name in ("scored", "positive", "firstk", "theta_t", "near", "admitted", "ranked"):
            block = _renamed(block, name, f"{method}_{name}")
        block = block.replace("theta as (", f"{method}_th as (").replace("join theta t", f"join {method}_th t")
        judged = f"{method}_judged"
        block += f""",
{judged} as (select r.qid, r.rank, coalesce(rel, 0) as rel from {method}_ranked r left join rels on r.qid = rels.qid and r.doc_id = rels.doc_id)"""
        parts.append(block)
        selects += [
            f"select '{method}' as method, '{name}' as metric, round(avg(value), 6) as value from ({metric(name, judged)})"
            for name in METRICS
        ]
    return "".join(parts) + " " + " union all ".join(selects)


def _renamed(sql: str, name: str, new: str) -> str:
    import re

    return re.sub(rf"\b{name}\b", new, sql)


INLINE = """,
qterm as (
  select qid, term, count(*) as qtf
  from (select qid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term
    from (values ('q1', 'patients patients zzzunknown'), ('q2', 'zzzunknown'), ('q3', 'The serum, the SERUM and the kidney')) v(qid, text))
  group by qid, term)"""

_W = "with" + TOKENS
_S = _W + STATS
_Q = _S + QTERMS

_ASKED = "with qtext as (select qid, max(text) as text from queries where qid is not null group by qid)"

ORACLE = {
    "collection_scan": r"""
select doc_id, block, cast(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as bigint) as n_tokens from documents where text is not null and doc_id is not null""",
    "keyed_query_file": _ASKED + r" select qid, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as text from qtext",
    "plain_query_file": _ASKED
    + r""", lines as (select row_number() over (order by qid) as n, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as text from qtext)
select cast(n as varchar) as qid, text from lines where text <> ''""",
    "judgment_file": "select distinct qid, doc_id, 1 as rel from qrels where qid is not null and doc_id is not null",
    "stem_examples": "select * from (values " + ", ".join(f"('{w}', '{x}')" for w, x in examples()) + ") t(word, stem)",
    "tokenize_counts": r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents where doc_id is not null)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_tokens, cast(coalesce(len(list_distinct(w)), 0) as bigint) as n_distinct from w""",
    "stopword_filtered_counts": rf"""
with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: x not in {STOP}) as w
  from documents where doc_id is not null)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_tokens, cast(coalesce(len(list_distinct(w)), 0) as bigint) as n_distinct from w""",
    "postings_tf": _W + " select doc_id, term, tf from post",
    "term_stats": _S + " select term, df, max_tf, cf from tstat",
    "doc_length": _W + f" select doc_id, cast(sum(tf) as bigint) as dl from post where term not in {STOP} group by doc_id",
    "corpus_stats": _S + " select n, round(avdl, 6) as avdl, min_dl from corpus",
    "id_map": _S + " select term, row_number() over (order by term) - 1 as term_id from tstat",
    "point_lookup": _Q + " select term, doc_id, tf from post where term in (select term from qterm)",
    "bsbi_block_merge": _S + " select term, df, max_tf, cf from tstat",
    "postings_merge_sum": PARTIAL + "select term, doc_id, tf from totals",
    "partial_term_totals": PARTIAL
    + "select term, count(*) as df, cast(sum(tf) as bigint) as cf, max(tf) as max_tf from totals group by term",
    "p6_found": PARTIAL
    + "select term, doc_id from totals qualify row_number() over (partition by term order by tf desc, doc_id) = 1",
    "postings_list": _W
    + """ select term, string_agg(cast(doc_id as varchar), ',' order by doc_id) as doc_ids,
  string_agg(cast(tf as varchar), ',' order by doc_id) as tfs from post group by term""",
    "vbe_gaps": _W + GAPS + " select term, doc_id, gap from gaps",
    "standard_bytes_per_term": _W + " " + SIZES["standard"],
    "vbe_bytes_per_term": _W + GAPS + " " + SIZES["vbe"],
    "optpfor_bytes_per_term": _W + GAPS + pfor("gap", "ids") + pfor("tf", "tfs") + " " + SIZES["optpfordelta"],
    "codec_bytes_per_term": _W
    + GAPS
    + pfor("gap", "ids")
    + pfor("tf", "tfs")
    + " "
    + " union all ".join(f"select term, '{c}' as codec, postings_bytes, tfs_bytes from ({sql})" for c, sql in SIZES.items()),
    "store_roundtrip": _S + " select term, df, max_tf, cf from tstat",
    "stored_lookup": _W + " select term, doc_id, tf from post where term in ('the', 'serum', 'kidney')",
    "stored_topk": _Q + scores("bm25") + ranked() + SHOW,
    "sequential_scan": _W
    + f""", placed as (select *, row_number() over (partition by term order by doc_id) - 1 as pos from post)
select term, cast(pos // {PART} as int) as part, cast(count(*) as int) as n, min(doc_id) as first_id, max(doc_id) as last_id from placed group by 1, 2""",
    "lsi_invariants": _Q
    + f""", kept as (select * from post where term not in {STOP}), n as (select count(distinct doc_id) as n from kept),
useful as (select term from kept group by term having count(*) < (select n from n))
select qid, (select least(10, n) from n) as n, true as dense, true as falling, true as cosines from qterm where term in (select term from useful) group by qid""",
    "merge_two_runs": _W + " select term, doc_id, cast(tf * (case when doc_id % 2 = 0 then 2 else 1 end) as bigint) as tf from post",
    "codec_roundtrip": _W
    + " select codec, term, doc_id, tf from post, (values ('standard'), ('vbe'), ('optpfordelta')) c(codec)",
    "idf": _S + f" select term, round({IDF}, 6) as idf from tstat, corpus",
    "tfidf_weights": _S + f" select term, doc_id, round({TFIDF}, 6) as weight from post join tstat using (term), corpus",
    "bm25_weights": _S
    + f" select term, doc_id, round({bm25('tf', 'dl')}, 6) as weight from post join tstat using (term) join dstat using (doc_id), corpus",
    "bm25_upper_bound": _S + f" select term, round({bm25('max_tf', 'min_dl')}, 6) as bound from tstat, corpus",
    "tfidf_topk": _Q + scores("tfidf") + ranked() + SHOW,
    "bm25_topk": _Q + scores("bm25") + ranked() + SHOW,
    "bm25_wand_topk": _Q + scores("bm25") + wand(10) + ranked("admitted") + SHOW,
    "oov_and_repeated_query_terms": _S + INLINE + scores("bm25") + ranked() + SHOW,
    "wand_vs_exhaustive_diff": _Q
    + scores("bm25")
    + ranked("scored", 10, "full_rank")
    + wand(10)
    + ranked("admitted", 10, "wand_rank")
    + """ select coalesce(a.qid, b.qid) as qid,
  cast(sum(case when b.qid is null then 1 else 0 end) as bigint) as only_exhaustive,
  cast(sum(case when a.qid is null then 1 else 0 end) as bigint) as only_wand
from full_rank a full join wand_rank b on a.qid = b.qid and a.doc_id = b.doc_id group by 1""",
    "eval_mean": mean_of_methods(),
} | {
    f"eval_{name.lower()}": JUDGED + f"select qid, round(value, 6) as value from ({metric(name)})" for name in METRICS
}
