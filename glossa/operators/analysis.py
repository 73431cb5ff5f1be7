"""Comparisons of runs, error mining, log statistics, tag-syntax compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.metrics import ratio

#: Documents of a timed run.
TIMED_DOCUMENTS = 235


def natural_key(name: Column) -> Column:
    """The first whole number of a name; names without one come last."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.coalesce(F.when(digits != "", digits.cast("decimal(38,0)")), F.lit(2147483647).cast("decimal(38,0)"))


def compare_runs(a: DataFrame, b: DataFrame, metrics: list[str], on: str = "tag") -> DataFrame:
    """Both runs' metrics beside each other, 0 where a run lacks the tag, and second minus first."""
    x = a.select(on, *(F.col(m).alias(f"{m}_1") for m in metrics))
    y = b.select(on, *(F.col(m).alias(f"{m}_2") for m in metrics))
    out = x.join(y, on, "full_outer")
    for m in metrics:
        one, two = (F.coalesce(F.col(f"{m}_{i}").cast("double"), F.lit(0.0)) for i in (1, 2))
        out = out.withColumn(f"{m}_1", one).withColumn(f"{m}_2", two).withColumn(f"{m}_diff", F.col(f"{m}_2") - F.col(f"{m}_1"))
    return out


def text_length(text: Column) -> Column:
    """Code points after line ends are made one character."""
    return F.length(F.regexp_replace(text, "\r\n?", "\n"))


def compare_lengths(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """on (doc_id without), length_1, length_2, diff of texts that both runs have."""
    on = list(on or ("doc_id",))
    x = a.select(*on, text_length(F.col("text")).alias("length_1"))
    y = b.select(*on, text_length(F.col("text")).alias("length_2"))
    return x.join(y, on).withColumn("diff", F.col("length_1") - F.col("length_2"))


def length_summary(lengths: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    counts = {"longer_1": F.count_if(F.col("diff") > 0), "longer_2": F.count_if(F.col("diff") < 0), "equal": F.count_if(F.col("diff") == 0)}
    return lengths.agg(n.alias("n"), *(c.alias(k) for k, c in counts.items()), *(ratio(100.0 * c, n).alias(f"{k}_pct") for k, c in counts.items()), F.avg("diff").alias("mean_diff"))


def top_differences(lengths: DataFrame, k: int = 5, *on: str) -> DataFrame:
    return lengths.orderBy(F.desc(F.abs("diff")), *(on or ("doc_id",))).limit(k)


def frequent_errors(errors: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent texts of errors; ties by text.  errors: norm."""
    return errors.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "norm").limit(k)


def tag_shares(errors: DataFrame) -> DataFrame:
    """tag, n, percent of all errors."""
    counts = errors.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a tag


def failure_stats(blocks: DataFrame) -> DataFrame:
    """blocks: model, prompt, file, has_error, error_kind.  Counts and the failure rate by model and prompt."""
    named = blocks.where("model is not null and model <> 'desconocido'")
    kinds = ("no_delimiters", "delimiters", "malformed")
    out = named.groupBy("model", "prompt").agg(F.count(F.lit(1)).alias("total"), F.count_if("has_error").alias("failed"), *(F.count_if(F.col("has_error") & (F.col("error_kind") == k)).alias(k) for k in kinds))
    return out.withColumn("rate", ratio(100.0 * F.col("failed"), F.col("total")))


def failure_pivot(stats: DataFrame, value: str, prompts: list[str]) -> DataFrame:
    """One row a model, one column a prompt; null where a pair does not occur."""
    return stats.groupBy("model").pivot("prompt", prompts).agg(F.first(value))


def failed_files(blocks: DataFrame) -> DataFrame:
    """The files that failed, by model and prompt, in log order."""
    named = blocks.where("model is not null and model <> 'desconocido' and has_error")
    return named.groupBy("model", "prompt").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x["file"]).alias("files"))


def common_failures(blocks: DataFrame) -> DataFrame:
    """Files that failed more than once over all models and prompts."""
    return blocks.where("has_error").groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def periods(marks: DataFrame, documents: int = TIMED_DOCUMENTS) -> DataFrame:
    """marks: run, name, ts, line_no.  Mean seconds a document from each name's first mark to the next mark; null if not positive."""
    w = Window.partitionBy("run").orderBy("line_no")
    rows = marks.withColumn("next", F.lead(F.col("ts").cast("timestamp")).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("run", "name").orderBy("line_no")))
    seconds = (F.unix_micros("next") - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6) / F.lit(documents)
    return rows.where("nth = 1").select("run", "name", F.when(seconds > 0, seconds).alias("seconds"))


def tag_quality(correct: Column, wrong: Column) -> Column:
    """c / (c + w / 2); 1 where there are no tags at all."""
    return F.coalesce(F.try_divide(correct.cast("double"), correct + wrong / 2), F.lit(1.0))


def fill_missing(config: DataFrame, expected: DataFrame, fallback: DataFrame, on: str = "doc_id") -> DataFrame:
    """The expected documents of a configuration; those that it lacks come from the fallback."""
    wanted = config.join(expected.select(on).distinct(), on, "left_semi")
    missing = expected.select(on).distinct().join(config.select(on).distinct(), on, "left_anti")
    return wanted.unionByName(fallback.join(missing, on, "left_semi"))


def mean_by_run(scores: DataFrame, metrics: list[str], run: str = "run") -> DataFrame:
    """Unweighted means over a run's tags."""
    return scores.groupBy(run).agg(*(F.avg(m).alias(m) for m in metrics))


def metric_pivot(scores: DataFrame, metric: str, runs: list[str], run: str = "run") -> DataFrame:
    """One row a tag, one column a run; null where a run lacks the tag.  A tag that a run has twice raises an error."""
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a tag stands twice in a run")).cast("double")).otherwise(F.max(F.col(metric).cast("double")))
    cells = scores.groupBy("tag", run).agg(once.alias("v"))
    return cells.groupBy("tag").pivot(run, runs).agg(F.first("v"))


def bin_pivot(rows: DataFrame, index: str, bins: list[str], value: str, how: str = "avg", scaled: bool = False) -> DataFrame:
    """One row an index value, one column a bin: means or sums of a value, 0 where there is none, on a logarithmic scale if asked."""
    agg = {"avg": F.avg, "sum": F.sum}[how](value)
    out = rows.groupBy(index).pivot("bin", bins).agg(F.log1p(agg) if scaled else agg)
    return out.na.fill(0)


def positive(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value is above zero: what a logarithmic chart can show."""
    return rows.where(F.col(value) > 0)


def listed(counts: DataFrame, name: str, k: int | None = None, n: str = "n") -> DataFrame:
    """Counts in descending order, equal ones by name; the first k if asked."""
    out = counts.orderBy(F.desc(n), name)
    return out.limit(k) if k else out


def raw_labels(tokens: DataFrame, labels: list[str], outside: str = "O") -> DataFrame:
    """Labels without marks made chunks of one token: B- before all but the outside label, which becomes O."""
    new = {c: F.when(F.col(c) == outside, F.lit("O")).otherwise(F.concat(F.lit("B-"), F.col(c))) for c in labels}
    return tokens.withColumns(new)
