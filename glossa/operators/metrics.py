"""Scores from counts; ratios are 0 where their denominator is, and unknown values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    """(1 + b^2) p r / (b^2 p + r)."""
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def with_scores(counts: DataFrame, digits: int | None = None, beta: float = 1.0) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; f1 is of the unrounded two."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = precision(tp, fp), recall(tp, fn)
    cut = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    return counts.select("*", cut(p).alias("precision"), cut(r).alias("recall"), cut(f_beta(p, r, beta)).alias("f1"))


def micro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of tp, fp, fn, then the scores."""
    return with_scores(counts.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))


def leak(fn: Column, sentences: Column) -> Column:
    """Missed spans a sentence: null where the number of sentences is not known, 0 where it is 0."""
    return F.when(sentences.isNotNull(), ratio(fn, sentences))


def micro_leak(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """fn and n_sentences summed; one unknown document makes the whole unknown."""
    whole = F.when(F.count_if(F.col("n_sentences").isNull()) == 0, ratio(F.sum("fn"), F.sum("n_sentences")))
    return counts.groupBy(*(by or [])).agg(whole.alias("leak"))


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted means of precision, recall and f1."""
    return scores.groupBy(*(by or [])).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")))


def by_tag(events: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Rows with tag and kind (tp, fp, fn) to counts and rounded scores a tag; `mark` carries a star without gold spans."""
    counts = events.groupBy(*(by or []), "tag").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")))
    return with_scores(counts, digits).withColumn("mark", F.when(F.col("tp") + F.col("fn") == 0, F.concat("tag", F.lit(" *"))).otherwise(F.col("tag")))


#: Labels of a dense confusion table at most: it has a row for each two of them.
MOST_LABELS = 1000


def confusion(pairs: DataFrame) -> DataFrame:
    """gold_tag, pred_tag, n of all pairs of labels that occur on either side, zeros included; more than MOST_LABELS labels are an error."""
    counts = pairs.groupBy("gold_tag", "pred_tag").agg(F.count(F.lit(1)).alias("n"))
    # structs, so that a null label stays
    labels = counts.select(F.explode(F.array("gold_tag", "pred_tag")).alias("x")).distinct().agg(F.collect_list(F.struct("x")).alias("l"))
    known = F.when(F.size("l") > MOST_LABELS, F.raise_error(F.lit(f"more than {MOST_LABELS} labels")).cast(labels.schema["l"].dataType)).otherwise(F.col("l"))
    grid = labels.select(known.alias("l")).select(F.explode("l").alias("g"), "l").select(F.col("g.x").alias("gold_tag"), F.explode("l").alias("p")).select("gold_tag", F.col("p.x").alias("pred_tag"))
    return grid.join(counts, ["gold_tag", "pred_tag"], "left").na.fill(0, ["n"])


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row a gold label, one column a predicted one."""
    return pairs.groupBy("gold_tag").pivot("pred_tag", labels).count().na.fill(0)


BIN_NAMES = ["0%"] + [f"{10 * i}-{10 * i + 10}%" for i in range(10)]


def overlap_bin(percent: Column) -> Column:
    """Eleven bins: exactly 0, then tens, the last one closed."""
    k = F.least(F.floor(percent / 10), F.lit(9)).cast("int")
    return F.when(percent == 0, F.lit("0%")).otherwise(F.concat((k * 10).cast("string"), F.lit("-"), (k * 10 + 10).cast("string"), F.lit("%")))


def overlap_histogram(rows: DataFrame) -> DataFrame:
    """bin, n, share (percent of all rows) for all eleven bins."""
    counts = rows.groupBy(overlap_bin(F.col("percent")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(b,) for b in BIN_NAMES], "bin string")
    full = names.join(counts, "bin", "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())  # eleven rows
    return full.select("bin", "n", F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)).alias("share"))


def tag_counts(spans: DataFrame) -> DataFrame:
    """Counts by category and type, by each, and of all, in one pass; `level` is the grouping id."""
    spans = spans.select("category", F.coalesce("type", F.lit("SIN_TIPO")).alias("type"))
    rows = spans.sparkSession.sql("SELECT category, type, grouping_id(category, type) AS level, count(*) AS n FROM {spans} GROUP BY GROUPING SETS ((category, type), (category), (type), ())", spans=spans)
    total = F.max(F.when(F.col("level") == 3, F.col("n"))).over(Window.partitionBy())  # one row a label
    return rows.select("category", "type", "level", "n", ratio(100.0 * F.col("n"), total).alias("percent"))
