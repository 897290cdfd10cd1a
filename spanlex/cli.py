"""Command line: build an index, search it, evaluate it.

    python -m spanlex.cli build --data_dir collection --output_dir index [--method spimi|bsbi]
        [--compression standard|vbe|optpfordelta] [--lsi] [--lsi_k 100] [--memory_threshold 10]
    python -m spanlex.cli search "words" [-k 10] [-m tfidf|bm25|bm25_wand|lsi] [--output_dir index] [--data_dir collection]
    python -m spanlex.cli search --file queries.txt ...
    python -m spanlex.cli evaluate --metric RBP --scoring bm25 --queries queries.txt --qrels qrels.txt
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlex.functions.codec import CODECS
from spanlex.operators import evaluate, lsi, retrieve
from spanlex.operators.index import FULL, Index, build
from spanlex.session import ship
from spanlex.sources import collection, store

METHODS = ("tfidf", "bm25", "bm25_wand", "lsi")


def ranked(spark: SparkSession, index: Index, path: str, queries: DataFrame, method: str, k: int) -> DataFrame:
    if method == "lsi":
        return lsi.retrieve(index, store.load_or_build_lsi(spark, index, path), queries, k)
    return retrieve.retrieve(index, queries, method, k)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanlex")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("--method", choices=["bsbi", "spimi"], default="spimi")
    b.add_argument("--compression", choices=CODECS, default="vbe")
    b.add_argument("--lsi", action="store_true")
    b.add_argument("--lsi_k", type=int, default=100)
    b.add_argument("--data_dir", default="collection")
    b.add_argument("--output_dir", default="index")
    b.add_argument("--memory_threshold", type=float, help="MB after which counts are spilled; the session's memory settings decide that here")
    s = commands.add_parser("search")
    which = s.add_mutually_exclusive_group(required=True)
    which.add_argument("query", nargs="?")
    which.add_argument("--file", "-f")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--method", "-m", choices=METHODS, default="tfidf")
    s.add_argument("--output_dir", default="index")
    s.add_argument("--data_dir", help="folder of the collection; the beginning of each document found is shown")
    e = commands.add_parser("evaluate")
    e.add_argument("--metric", choices=evaluate.METRICS, default="RBP", type=str.upper)
    e.add_argument("--scoring", choices=METHODS, default="tfidf", type=str.lower)
    e.add_argument("--queries", default="queries.txt")
    e.add_argument("--qrels", default="qrels.txt")
    e.add_argument("-k", type=int, default=1000)
    e.add_argument("--output_dir", default="index")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanlex").getOrCreate()
    ship(spark)
    if args.command == "build":
        index = build(collection.text_collection(spark, args.data_dir), FULL, args.method)
        store.save(index, args.output_dir, args.compression)
        if args.lsi:
            store.save_lsi(lsi.build(store.load(spark, args.output_dir), args.lsi_k), args.output_dir)
        print("Indexing finished.")
        return 0
    index = store.load(spark, args.output_dir)
    if args.command == "search":
        if args.file and not Path(args.file).exists():
            print(f"Error: file {args.file!r} not found.")
            return 1
        queries = collection.plain_queries(spark, args.file) if args.file else spark.createDataFrame([("1", args.query)], "qid string, text string")
        ranking = ranked(spark, index, args.output_dir, queries, args.method, args.k)
        if args.data_dir:
            texts = collection.text_collection(spark, args.data_dir).select("doc_name", F.substring(F.trim("text"), 1, 60).alias("start"))
            ranking = ranking.join(texts, "doc_name", "left")
        show(queries, ranking, args.method)
        return 0
    queries = collection.keyed_queries(spark, args.queries)
    judgments = collection.qrels(spark, args.qrels)
    unjudged = queries.join(judgments, "qid", "left_anti").count()
    if unjudged == queries.count():
        print(f"Error: {args.qrels!r} has no judgment of any query of {args.queries!r}.")
        return 1
    if unjudged:
        print(f"Note: {unjudged} queries have no judgment.")
    ranking = ranked(spark, index, args.output_dir, queries, args.scoring, args.k)
    numbered = ranking.withColumn("doc_id", evaluate.doc_number())
    value = evaluate.mean(evaluate.judge(numbered, judgments), args.metric).first()["value"]
    print(f"Mean {args.metric} of {args.scoring} over {queries.count()} queries = {value}")
    return 0


def show(queries: DataFrame, ranking: DataFrame, method: str) -> None:
    """Print a table of rankings: k rows per query, in the order of the queries."""
    lists: dict[str, list] = {}
    for row in ranking.orderBy("qid", "rank").collect():
        lists.setdefault(row["qid"], []).append(row.asDict())
    for qid, text in queries.orderBy(F.length("qid"), "qid").select("qid", "text").collect():
        print(f"[{method}] {text}")
        for row in lists.get(qid, [{}]):
            if not row:
                print("    No results found.")
                continue
            start = " ".join((row.get("start") or "").split())
            print(f"{row['rank']:>5}. {row['score']:9.4f}  {row['doc_name']}" + (f"  {start}" if start else ""))


if __name__ == "__main__":
    sys.exit(main())
