"""Whole evaluations of one or many systems against a gold set, as tables.

Frames have `system` and `doc_id`; the gold set has `doc_id` alone and is matched with
every system in one plan, so many systems or runs are one query.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import STOP_WORDS, sentence_marks, significant
from glossa.operators import matching, metrics
from glossa.operators.official import SUBTRACKS, official_counts
from glossa.sources.writers import score_report


def _per_system(gold: DataFrame, systems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gold spans beside each system, and both sides restricted to common documents."""
    docs = systems.select("system", "doc_id").distinct()
    g = gold.join(docs, "doc_id")
    return g, systems.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")


def official(gold: DataFrame, systems: DataFrame, subtrack: str, texts: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """system, doc_id, tp, fp, fn, precision, recall, f1 and, with sentences, leak.

    subtrack: ner (category, start, end, type), spans (start, end), merged (needs texts).
    """
    out = metrics.with_scores(official_counts(gold, systems, (subtrack,), texts).drop("subtrack"))
    if sentences is not None:
        out = out.join(sentences, "doc_id", "left").withColumn("leak", metrics.leak(F.col("fn"), F.col("n_sentences")))
    return out


def official_micro(scores: DataFrame) -> DataFrame:
    """system and the micro scores of official(); leak, if there, is null once a document lacks its sentences."""
    out = metrics.micro(scores, ["system"])
    return out.join(metrics.micro_leak(scores, ["system"]), "system") if "leak" in scores.columns else out


def relaxed(gold: DataFrame, systems: DataFrame, texts: DataFrame, ignore_tags: bool = False, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The two-phase evaluation a system and document: tp, fp, fn and scores.

    stop_words: words that say nothing beside a gold span; a longer list than the own one
    can be read from a file (read_stop_words).
    """
    g, s = _per_system(gold, systems)
    counts, _ = matching.two_phase(g, s, texts, partial(significant, stop_words=stop_words), not ignore_tags, ["system", "doc_id"])
    return metrics.with_scores(counts)


def grid(gold: DataFrame, configs: DataFrame, fallback: DataFrame, texts: DataFrame, subtracks: tuple[str, ...] = SUBTRACKS) -> DataFrame:
    """system, config, subtrack and micro scores of many configurations.

    configs has system, config and span columns.  Where a configuration lacks a gold
    document, the spans of `fallback` (no system, no config) stand in; documents
    that are not in the gold set are left out.  One pass over each document serves all
    configurations and subtracks.
    """
    by = ["system", "config", "subtrack"]
    return metrics.micro(official_counts(gold, configs, subtracks, texts, ("system", "config"), fallback), by)


def error_report(gold: DataFrame, systems: DataFrame, texts: DataFrame, ignore_tags: bool = False) -> DataFrame:
    """system, doc_id, value: a document's scores, exact matches, inclusions, and errors, as text.

    Sections without lines are left out; lines stand in the order of the spans.
    """
    keys = ["system", "doc_id"]
    g, s = _per_system(gold, systems)
    on = ["start", "end", "text"] + ([] if ignore_tags else ["tag"])
    docs = matching.document_matches(g, s, keys, on, not ignore_tags, lists=True)
    span = lambda x: F.format_string("[%d-%d] '%s' (%s)", x["start"], x["end"], F.coalesce(x["text"], F.lit("")), F.coalesce(x["tag"], F.lit("")))
    share = lambda x: F.when(x["percent"] > 0, F.format_string(" - %.1f%% covered", x["percent"])).otherwise(F.lit(" - not covered"))
    lines = {
        "Exact matches": ("exact", span),
        "Inclusions": ("held", lambda x: F.format_string("[%d-%d] '%s' holds %d", x["sys_start"], x["sys_end"], x["sys_text"], x["n_gold"])),
        "False positives": ("surplus", span),
        "False negatives": ("lost", lambda x: F.concat(span(x), share(x))),
    }

    def section(title: str, column: str, line) -> Column:
        """The lines of a list in the order of its spans; null without one."""
        # structs are in order by their first field, which is the span's own number
        body = F.array_join(F.transform(F.array_sort(column), lambda x: F.concat(F.lit("  "), line(x))), "\n")
        return F.when(F.size(column) > 0, F.concat(F.lit(title + " ("), F.size(column).cast("string"), F.lit("):\n"), body))

    # one pass: the counts and all lines are in a document's row
    parts = F.concat_ws("\n", *(section(title, *how) for title, how in lines.items())).alias("body")
    counted = matching.phase_counts(docs.select("*", parts), [*keys, "body"], significant)
    return score_report(metrics.with_scores(counted), more=["system", "body"]).select(*keys, F.concat("value", "body").alias("value"))


def both_tag_modes(gold: DataFrame, systems: DataFrame, texts: DataFrame) -> DataFrame:
    """relaxed() with and without tags, from one pass over each document: ignore_tags tells which."""
    g, s = _per_system(gold, systems)
    counts, _ = matching.two_phase(g, s, texts, significant, None, ["system", "doc_id"])
    return metrics.with_scores(counts)


def missed(gold: DataFrame, systems: DataFrame, ignore_tags: bool = False) -> DataFrame:
    """Gold spans that neither phase matches, with the largest share that a system span covers."""
    keys = ["system", "doc_id"]
    on = ["start", "end", "text"] + ([] if ignore_tags else ["tag"])
    g, s = _per_system(gold, systems)
    return matching.lost_spans(g, s, on, not ignore_tags, keys=keys).select(*keys, "ord", "percent", "sys_ord")


def analysed(gold: DataFrame, systems: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores by system and tag (with both leak denominators), and the confusion counts.

    leak_legacy adds a document's sentence marks once for each gold span of the tag,
    leak once for each document that has the tag.
    """
    keys = ["system", "doc_id"]
    g, s = _per_system(gold, systems)
    tags = metrics.by_tag(matching.analyzer(g, s, keys), ["system"])
    marks = g.select("system", "doc_id", "tag").join(texts.select("doc_id", sentence_marks(F.col("text")).alias("n")), "doc_id")
    by_span = marks.groupBy("system", "tag").agg(F.sum("n").alias("per_span"))
    by_doc = marks.distinct().groupBy("system", "tag").agg(F.sum("n").alias("per_doc"))
    tags = tags.join(by_span, ["system", "tag"], "left").join(by_doc, ["system", "tag"], "left")
    for name, n in (("leak_legacy", "per_span"), ("leak", "per_doc")):
        tags = tags.withColumn(name, F.round(metrics.ratio(F.col("fn"), F.coalesce(n, F.lit(0))), 4))
    pairs = matching.best_overlap(g, s, keys)
    return tags.drop("per_span", "per_doc"), pairs.groupBy("system", "gold_tag", "pred_tag", "kind").agg(F.count(F.lit(1)).alias("n"))
