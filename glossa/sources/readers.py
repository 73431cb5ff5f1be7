"""Readers of annotation formats.  The document is a file's stem, the system its folder.

Files of one document are read whole, one row a file, so documents keep their order and a
damaged file spoils nothing but its own row: such rows have an `error` and no spans.  Logs
and column files, which can be large, are read in splits (see lines.py).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.categories import ELEMENTS
from glossa.functions.inline import json_kind_column, parse_reply, rows_from
from glossa.functions.text import last_part
from glossa.sources.lines import SPLIT, bare, file_lines, numbered

_PATH = "_metadata.file_path"
SPANS = "system string, doc_id string, ord int, category string, type string, start int, end int, start_raw string, end_raw string, text string, comment string, error string"


def stem(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+?)(?:\.[^./]*)?$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+)/[^/]+$", 1)


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """system, doc_id, content of the files of a folder."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(folder(F.col(_PATH)).alias("system"), stem(F.col(_PATH)).alias("doc_id"), F.col("value").alias("content"))


def _xml_rows(content: str, base: int) -> tuple[str | None, list[tuple]]:
    root = ET.fromstring(content)
    text = root.findtext(".//TEXT")
    tags = root.find(".//TAGS")
    if tags is None:
        raise ValueError("no TAGS")
    rows = []
    for i, tag in enumerate(tags, 1):
        a, b = tag.get("start"), tag.get("end")
        start, end = int(a) - base, int(b) - base
        rows.append((i, tag.tag, tag.get("TYPE"), start, end, a, b, None if text is None else text[start:end], tag.get("comment")))
    return text, rows


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """system, doc_id, text of span XML files; a missing text is null."""
    files = whole_files(spark, path, "*.xml")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for content in f["content"]:
                try:
                    texts.append(ET.fromstring(content).findtext(".//TEXT"))
                except ET.ParseError:
                    texts.append(None)
            yield f[["system", "doc_id"]].assign(text=texts)

    return files.mapInPandas(run, "system string, doc_id string, text string")


def xml_spans(spark: SparkSession, path: str, base: int = 0, elements: tuple[str, ...] | None = None) -> DataFrame:
    """Spans of span XML files in document order; base 1 for corpora that count from 1.

    elements: only these, for instance ELEMENTS of official scoring.  Files that cannot
    be read give one row with `error`.
    """
    files = whole_files(spark, path, "*.xml")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for system, doc, content in f[["system", "doc_id", "content"]].itertuples(index=False, name=None):
                try:
                    out += [(system, doc, *r, None) for r in _xml_rows(content, base)[1] if elements is None or r[1] in elements]
                except (ET.ParseError, ValueError, TypeError) as e:
                    out.append((system, doc, *[None] * 9, str(e)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SPANS.split(", ")])

    return files.mapInPandas(run, SPANS)


def official_spans(spark: SparkSession, path: str) -> DataFrame:
    return xml_spans(spark, path, elements=ELEMENTS)


def brat_spans(spark: SparkSession, path: str) -> DataFrame:
    """system, doc_id, ord, tag, start, end, text from `T` lines.

    Lines of other kinds and with too few fields are skipped; lines whose offsets are no
    whole numbers (discontinuous spans) have an `error` instead of offsets.
    """
    lines = whole_files(spark, path, "*.ann").select("system", "doc_id", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    fields = F.split("line", "\t")
    parts = F.split(F.trim(F.element_at(fields, 2)), r"\s+")
    rows = lines.where(F.startswith("line", F.lit("T")) & (F.size(fields) > 1)).withColumn("parts", parts).where(F.size("parts") > 2)
    start, end = (F.element_at("parts", i).try_cast("int") for i in (2, 3))
    rows = rows.select("system", "doc_id", (F.col("line_no") + 1).alias("ord"), F.element_at("parts", 1).alias("tag"), start.alias("start"), end.alias("end"), F.try_element_at(fields, F.lit(3)).alias("text"), "line")
    return rows.withColumn("error", F.when(F.col("start").isNull() | F.col("end").isNull(), F.col("line"))).drop("line")


def sentence_counts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_sentences: lines of each file, 0 of an empty one."""
    read = spark.read.option("pathGlobFilter", "*.ann").text(path)
    # scans skip files without content; the driver's listing, which every scan needs, has their names
    names = spark.createDataFrame([(name,) for name in read.inputFiles()], "path string")
    lines = read.select(stem(F.col(_PATH)).alias("doc_id"), F.lit(1).alias("n"))
    return lines.union(names.select(stem(F.col("path")), F.lit(0))).groupBy("doc_id").agg(F.sum("n").alias("n_sentences"))


def conll_tokens(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_no, pos, token, pos_tag, label of column files of any size; a blank line or -DOCSTART- ends a document."""
    lines = file_lines(spark, path).withColumn("line", bare(F.col("line")))
    ends = (F.trim("line") == "") | F.startswith("line", F.lit("-DOCSTART-"))
    fields = F.split(F.trim("line"), r"\s+")
    rows = numbered(lines, ends, ~ends & (F.size(fields) > 2)).where(~ends).withColumn("f", fields).where(F.size("f") > 2)
    return rows.select(stem(F.col("path")).alias("file"), F.col("group_no").alias("doc_no"), "pos", F.element_at("f", 1).alias("token"), F.element_at("f", 2).alias("pos_tag"), F.element_at("f", 3).alias("label"))


def array_tokens(df: DataFrame, split: str = "test") -> DataFrame:
    """doc_id, pos, token, label from columns split, tokens, ner_tags; the longer array is cut to the shorter."""
    if not {"tokens", "ner_tags"} <= set(df.columns):
        raise ValueError("tokens and ner_tags are needed")
    rows = df.where(F.col("split") == split).withColumn("doc_id", F.monotonically_increasing_id())
    n = F.least(F.size("tokens"), F.size("ner_tags"))
    return rows.select("doc_id", F.posexplode(F.slice(F.arrays_zip("tokens", "ner_tags"), F.lit(1), n)).alias("pos", "t")).select("doc_id", "pos", F.col("t.tokens").alias("token"), F.col("t.ner_tags").alias("label"))


def bio_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, pos, token, label of files, of any size, with two fields a line; another number of fields raises an error."""
    lines = file_lines(spark, path, "*.bio").withColumn("line", bare(F.col("line")))
    there = F.trim("line") != ""
    f = F.split(F.trim("line"), r"\s+")
    checked = F.when(F.size(f) == 2, f).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), F.col("line"))).cast("array<string>"))
    rows = numbered(lines, valid=there).where(there).withColumn("f", checked)
    return rows.select(stem(F.col("path")).alias("doc_id"), "pos", F.element_at("f", 1).alias("token"), F.element_at("f", 2).alias("label"))


def replies(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tagged_text, entities of stored replies, JSON or Python literals; missing keys are empty, files with neither key are left out."""

    def make(content: str) -> list[tuple]:
        found = parse_reply(content) or {}
        tagged, entities = found.get("tagged_text"), found.get("entities")
        if tagged is None and entities is None:
            return []
        lists = {str(k): [str(x) for x in (v if isinstance(v, list | tuple | set) else [v])] for k, v in entities.items() if v is not None} if isinstance(entities, dict) else {}
        return [("" if tagged is None else str(tagged), lists)]

    return rows_from(whole_files(spark, path, "*.txt").select("system", "doc_id", "content"), ["content"], ["system", "doc_id"], make, "tagged_text string, entities map<string,array<string>>")


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of .txt files and of the TEXT of .xml files; null texts are empty."""
    txt = whole_files(spark, path, "*.txt").select("system", "doc_id", F.col("content").alias("text"))
    return txt.unionByName(xml_documents(spark, path)).select("system", "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def entity_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tag, value, n: the listed values of entities maps and how often each is listed."""
    rows = df.select(*keys, F.explode("entities").alias("tag", "values")).select(*keys, "tag", F.explode("values").alias("value"))
    return rows.groupBy(*keys, "tag", "value").agg(F.count(F.lit(1)).alias("n"))


#: What log lines and blocks begin with.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}"
BLOCK = STAMP + r" - INFO - Procesando archivo:"


def is_log_line(line: Column) -> Column:
    return F.rlike(line, F.lit(f"^{STAMP} - "))


def log_fields(line: Column) -> list[Column]:
    """ts, level and message of a log line; milliseconds follow a comma."""
    part = lambda i: F.regexp_extract(line, rf"^({STAMP}) - (\w+) - (.*)$", i)
    return [F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"), part(2).alias("level"), part(3).alias("message")]


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """run, line_no, ts, level, message of logs of any size."""
    line = F.col("line")
    rows = numbered(file_lines(spark, path).withColumn("line", bare(line))).where(is_log_line(line))
    return rows.select(stem(F.col("path")).alias("run"), "line_no", *log_fields(line))


#: The names of a block without a prompt's folder, and without a file.
NO_PROMPT, NO_FILE = "prompt_desconocido", "asffd"


def _read_blocks(parts: DataFrame) -> DataFrame:
    """What blocks (run, pos, block) say."""
    find = lambda pattern: F.nullif(F.regexp_extract("block", pattern, 1), F.lit(""))
    reply = F.coalesce(find(rf"(?s)Respuesta cruda del modelo:\s*\n(.*?)(?=\n{STAMP} - INFO - Resumen final de entidades encontradas:|\z)"), F.lit(""))
    rows = parts.where("pos > 0 and trim(block) <> ''").select(
        "run", "pos", find(r"Modelo:\s(\S+)").alias("model"), F.coalesce(last_part(find(r"Directorio de salida:\s(\S+)")), F.lit(NO_PROMPT)).alias("prompt"),
        F.coalesce(F.trim(find(r"(?m)^(.*?\.xml)")), F.lit(NO_FILE)).alias("file"), F.trim(reply).alias("reply"), F.contains("block", F.lit("Error parseando JSON")).alias("has_error"),
    )
    return rows.withColumn("error_kind", F.when(F.col("has_error"), json_kind_column(F.col("reply"))))


def blocks_of(logs: DataFrame) -> DataFrame:
    """run, pos, model, prompt, file, reply, has_error, error_kind of the blocks of logs with run and content."""
    return _read_blocks(logs.select("run", F.posexplode(F.split("content", BLOCK)).alias("pos", "block")))


def log_blocks(spark: SparkSession, path: str) -> DataFrame:
    """blocks_of for logs of any size: a log may lie in many splits, and only a block's own lines meet in one task."""
    # what follows a block's beginning, wherever it stands in a line, belongs to it
    pieces = file_lines(spark, path).select(*SPLIT, F.posexplode(F.split("line", BLOCK)).alias("at", "line"))
    rows = numbered(pieces, F.col("at") > 0).where("part > 0")
    # pieces of one line are parts of different blocks, so only whole lines are joined
    blocks = rows.groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("block"))
    return _read_blocks(blocks.select(stem(F.col("path")).alias("run"), F.col("part").cast("int").alias("pos"), "block"))


def report_numbers(text: Column) -> Column:
    """precision, recall, f1 and a map of overlap bins (the 0% one included) from a printed report."""
    number = lambda name: F.regexp_extract(text, rf"(?i){name}[^\d\n]*([\d.]+(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    pairs = F.regexp_extract_all(text, F.lit(r"((?:\d+-\d+|0)%):\s*(\d+)"), F.lit(0))
    bins = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split(p, ":")[0], F.trim(F.split(p, ":")[1]).cast("long"))))
    return F.struct(number("precision").alias("precision"), number("recall").alias("recall"), number("f1").alias("f1"), bins.alias("bins"))


def margin_reports(spark: SparkSession, path: str, glob: str = "metrics_*.txt") -> DataFrame:
    """mode, margin, system, precision, recall, f1, bins of printed reports in folders mode/margin_X_YY, in order of mode and margin."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    part = lambda i: F.regexp_extract(F.col(_PATH), r"([^/]+)/margin_([0-9]+(?:[_.][0-9]+)?)/[^/]+$", i)
    margin = F.replace(part(2), F.lit("_"), F.lit(".")).try_cast("double")
    out = rows.select(part(1).alias("mode"), margin.alias("margin"), F.regexp_replace(stem(F.col(_PATH)), "^metrics_", "").alias("system"), report_numbers(F.col("value")).alias("n"))
    return out.where("margin is not null").select("mode", "margin", "system", "n.*").orderBy("mode", "margin", "system")
