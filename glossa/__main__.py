"""Scores and reports of annotation folders: python -m glossa COMMAND ...

official FORMAT SUBTRACK GOLD SYSTEM...   scores by the official definitions
relaxed FORMAT GOLD SYSTEM...             scores of exact matches and inclusions
tags FORMAT GOLD SYSTEM...                scores by tag, with leaks
errors FORMAT GOLD SYSTEM...              a report a document
compare FORMAT GOLD RUN1 RUN2             both runs' scores by tag, and the differences
chunks GOLD PREDICTED                     chunk scores of folders of BIO files
logs FOLDER                               failed replies by model and prompt
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import STOP_WORDS, read_stop_words
from glossa.operators import analysis, bio
from glossa.plans import evaluate
from glossa.session import tuned
from glossa.sources import readers
from glossa.sources.writers import quarantine

FORMATS = ("xml", "brat")


def sound(spans: DataFrame, path: str, folder: str | None) -> DataFrame:
    """Rows without an error; the number of the others is printed, and with a folder they are kept there."""
    if folder:
        good, bad, _, n = quarantine(spans, folder)
    else:
        good, bad = spans.where("error is null"), spans.where("error is not null")
        n = bad.count()
    if n:
        print(f"{path}: {n} damaged rows left out" + (f", kept in {folder}" if folder else ""))
    return good.drop("error")


def read(spark: SparkSession, path: str, form: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Spans (system, doc_id, ord, category, type, tag, start, end, text) and texts (doc_id, text) of a folder."""
    if form == "xml":
        texts = readers.xml_documents(spark, path)
        spans = sound(readers.official_spans(spark, path), path, folder).withColumn("tag", F.coalesce("type", F.lit("UNKNOWN"))).drop("text")
    else:
        texts = readers.whole_files(spark, path, "*.txt").withColumnRenamed("content", "text")
        spans = sound(readers.brat_spans(spark, path), path, folder).withColumn("category", F.col("tag")).withColumn("type", F.col("tag")).drop("text")
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sliced = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    spans = spans.join(texts, "doc_id", "left").withColumn("text", F.coalesce(sliced, F.lit("")))
    return spans.select("system", "doc_id", "ord", "category", "type", "tag", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text"), texts


def compared(gold: DataFrame, systems: DataFrame, texts: DataFrame, names: list[str]) -> DataFrame:
    """tag, and precision, recall, f1 of both runs with second minus first."""
    tags, _ = evaluate.analysed(gold, systems, texts)
    runs = [tags.where(F.col("system") == n) for n in names]
    return analysis.compare_runs(*runs, ["precision", "recall", "f1"])


def chunk_scores(spark: SparkSession, gold: str, predicted: str) -> DataFrame:
    """Chunk scores of files with as many lines as their gold files; the others are printed."""
    pairs, failed = bio.paired_lines(readers.bio_tokens(spark, gold), readers.bio_tokens(spark, predicted))
    for r in failed.orderBy("doc_id").toLocalIterator():
        print(f"{r.doc_id}: {r.error}")
    return bio.chunk_scores(pairs)


def scores(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.command == "chunks":
        return chunk_scores(spark, args.gold, args.predicted)
    if args.command == "logs":
        return analysis.failure_stats(readers.log_blocks(spark, args.folder))
    # folders may have one name: the place in the command tells them apart
    kept = [args.quarantine and f"{args.quarantine}/{i}-{os.path.basename(os.path.normpath(x))}" for i, x in enumerate([args.gold, *args.systems])]
    gold, texts = read(spark, args.gold, args.format, kept[0])
    gold = gold.drop("system")
    systems = read(spark, args.systems[0], args.format, kept[1])[0]
    for path, folder in zip(args.systems[1:], kept[2:], strict=True):
        systems = systems.unionByName(read(spark, path, args.format, folder)[0])
    if args.command == "official":
        sentences = readers.sentence_counts(spark, args.sentences) if args.sentences else None
        by_document = evaluate.official(gold, systems, args.subtrack, texts, sentences)
        return by_document if args.verbose else evaluate.official_micro(by_document)
    if args.command == "tags":
        return evaluate.analysed(gold, systems, texts)[0]
    if args.command == "errors":
        return evaluate.error_report(gold, systems, texts, args.ignore_tags)
    if args.command == "compare":
        names = [os.path.basename(os.path.normpath(x)) for x in args.systems]
        if len(set(names)) != 2:
            raise SystemExit("two runs with different folder names are compared")
        return compared(gold, systems, texts, names)
    words = read_stop_words(args.stop_words) if args.stop_words else STOP_WORDS
    by_document = evaluate.relaxed(gold, systems, texts, args.ignore_tags, words)
    return by_document if args.verbose else evaluate.official_micro(by_document)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glossa")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("official", "relaxed", "tags", "errors", "compare"):
        p = commands.add_parser(name)
        p.add_argument("format", choices=FORMATS)
        if name == "official":
            p.add_argument("subtrack", choices=evaluate.SUBTRACKS)
            p.add_argument("--sentences", help="folder with a file a document, one line a sentence")
        elif name in ("relaxed", "errors"):
            p.add_argument("--ignore-tags", action="store_true")
            if name == "relaxed":
                p.add_argument("--stop-words", help="file with one word a line")
        p.add_argument("gold")
        p.add_argument("systems", nargs="+")
        p.add_argument("--quarantine", help="folder for what could not be read")
        if name in ("official", "relaxed"):
            p.add_argument("-v", "--verbose", action="store_true", help="a row a document")
    p = commands.add_parser("chunks")
    p.add_argument("gold")
    p.add_argument("predicted")
    commands.add_parser("logs").add_argument("folder")
    return top


def main() -> None:
    args = parser().parse_args()
    spark = tuned(SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate())
    out = scores(spark, args)
    if args.command == "errors":
        for r in out.orderBy("system", "doc_id").toLocalIterator():
            print(r.value)
        return
    out.orderBy(*(c for c in ("system", "doc_id", "tag", "type", "model", "prompt") if c in out.columns)).show(1 << 20, False)


if __name__ == "__main__":
    main()
