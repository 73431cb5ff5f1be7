"""Writers: span XML, BIO, replies, metric tables, text reports.  One text file row a document."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from glossa.functions.categories import category_of
from glossa.operators.sweep import by_document, kinds


def with_categories(spans: DataFrame) -> DataFrame:
    """category of the type, from tag; WARNING where it is unknown."""
    return spans.withColumn("type", F.col("tag")).withColumn("category", category_of(F.col("tag")))


def span_xml(texts: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, xml: a document's text and its spans (category, type, start, end, text) as span XML, ids in span order."""
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "category", "type", "text"))).alias("spans"))
    rows = texts.select(key, F.col("text").alias("body")).join(listed, key, "left")
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for body, items in zip(f["body"], f["spans"], strict=True):
                tags = "".join(f'\n    <{s["category"]} id="T{i}" start="{s["start"]}" end="{s["end"]}" text={quoteattr(s["text"] or "")} TYPE={quoteattr(s["type"] or "")} comment=""/>' for i, s in enumerate([] if items is None else items, 1))
                out.append(f'<?xml version="1.0" encoding="UTF-8"?>\n<MEDDOCAN>\n  <TEXT>{escape(body or "")}</TEXT>\n  <TAGS>{tags}\n  </TAGS>\n</MEDDOCAN>\n')
            yield pd.DataFrame({key: f[key], "xml": out})

    return rows.mapInPandas(run, f"`{key}` {kind}, xml string")


def write_texts(df: DataFrame, path: str, column: str, key: str = "doc_id") -> None:
    """One folder a document (key=value), each with the document's text."""
    df.select(key, F.col(column).alias("value")).write.partitionBy(key).option("lineSep", "").text(path)


def bio_text(tokens: DataFrame, label: str = "label", key: str = "doc_id") -> DataFrame:
    """key, value: `token label` lines in token order.  A document's lines cross the shuffle as one compressed row."""
    rows = tokens.select(key, "pos", F.concat_ws(" ", "token", label).alias("line"))

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        order = pc.sort_indices(table.append_column("_", pa.array(document)), [("_", "ascending"), ("pos", "ascending"), ("line", "ascending")], null_placement="at_start")
        first = np.flatnonzero(np.diff(document, prepend=-1))
        lines = pa.ListArray.from_arrays(pa.array(np.append(first, len(document)), pa.int32()), table.column("line").take(order).combine_chunks())
        text = pc.binary_join_element_wise(pc.binary_join(lines, "\n"), "", "\n")
        yield pa.table([table.column(key).take(pa.array(first)), text], names=[key, "value"])

    return by_document(rows, [key], work, f"{kinds(rows, [key])[0]}, value string", together=True)


def reply_json(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.to_json(F.struct("tagged_text", "entities"), {"pretty": "true"}).alias("value"))


def score_report(scores: DataFrame, key: str = "doc_id", more: list[str] | None = None) -> DataFrame:
    """more, key, value: a document's counts and scores as text."""
    line = F.format_string("Report (%s):\ntp: %d  fp: %d  fn: %d\nPrecision: %.4f\nRecall: %.4f\nF1: %.4f\n", F.col(key).cast("string"), "tp", "fp", "fn", "precision", "recall", "f1")
    return scores.select(*(more or []), key, line.alias("value"))


def metrics_report(totals: DataFrame, histogram: DataFrame, n_documents: int, by: str = "system", documents: DataFrame | None = None, ignore_tags: bool | None = None) -> DataFrame:
    """by, value: a system's totals (with scores) and how much of each missed span is covered (by, bin, n, share) as text.

    ignore_tags: the way of matching, stated in a line of its own; documents: by, doc_id and
    scores of each, listed at the end in their order.
    """
    line = F.format_string("%8s: %4d (%5.1f%%)", "bin", "n", "share")
    # the bin 0% first, then by the first number
    place = F.when(F.col("bin") == "0%", F.lit(-1)).otherwise(F.split("bin", "-")[0].try_cast("int"))
    listed = lambda order, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("place"), line.alias("line")))), lambda x: x["line"]), "\n")
    bins = histogram.groupBy(by).agg(listed(place, line).alias("bins"))
    mode = "" if ignore_tags is None else f"Mode: {'tags ignored' if ignore_tags else 'tags considered'}\n"
    head = F.format_string(f"Metrics (%s), {n_documents} documents:\n{mode}Precision: %.4f\nRecall:    %.4f\nF1-score:  %.4f\nTP: %d\nFP: %d\nFN: %d\n", F.col(by).cast("string"), "precision", "recall", "f1", "tp", "fp", "fn")
    out = totals.join(bins, by, "left")
    body = F.concat(head, F.coalesce("bins", F.lit("no missed spans")), F.lit("\n"))
    if documents is None:
        return out.select(by, body.alias("value"))
    own = F.format_string("%-30s P=%.3f R=%.3f F1=%.3f", F.col("doc_id").cast("string"), "precision", "recall", "f1")
    lines = documents.groupBy(by).agg(listed(F.col("doc_id").cast("string"), own).alias("lines"))
    return out.join(lines, by, "left").select(by, F.concat(body, F.lit("\nBy document:\n"), F.coalesce("lines", F.lit("none")), F.lit("\n")).alias("value"))


def quarantine(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Good and damaged rows (those with an error) as two tables below path, written in one pass; and how many of each."""
    seen = Observation()
    split = rows.withColumn("damaged", F.col("error").isNotNull()).observe(seen, F.count_if(~F.col("damaged")).alias("good"), F.count_if("damaged").alias("bad"))
    split.write.mode("overwrite").partitionBy("damaged").parquet(path)
    spark, n = rows.sparkSession, seen.get

    def table(damaged: bool, n: int) -> DataFrame:
        return spark.read.schema(rows.schema).parquet(f"{path}/damaged={str(damaged).lower()}") if n else spark.createDataFrame([], rows.schema)

    return table(False, n["good"]), table(True, n["bad"]), n["good"], n["bad"]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
