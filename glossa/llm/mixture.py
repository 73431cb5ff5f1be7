"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash.  The tokens of each source are summed by hash bucket;
the bucket in which a source's budget runs out is divided again, twelve bits at a time,
until one hash is left.  A document is in the mix if its hash lies below its source's
threshold, so nothing is sorted, larger budgets hold all that smaller ones hold, and
reruns agree.  Texts are read once: what follows works on a written table of one short
row a document.

Defined cases: a null text has size 0; a null source is a source of its own, the last;
rows alike in id and text have one hash and are taken or left together; a source
without words takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm.shared import table, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
HASH_BITS, STEP_BITS = 60, 12
#: Sources whose table is sent to every task; more are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words between white space) and h (60 bits of an MD5 over id and text)."""
    return docs.select(*_sizes(docs))


def _sizes(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    ]


def _ranked(by_source: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point, null last: sources are sorted over all tasks, and each task's are counted, so no task has them all."""
    order = F.col("source").isNull(), F.encode("source", "utf-8")
    own = written(by_source.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    before, rows = 0, []
    for r in own.groupBy(part).count().orderBy("_part").collect():  # one row a task
        rows.append((r["_part"], before))
        before += r["count"]
    first = F.broadcast(own.sparkSession.createDataFrame(rows, "_part long, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return own.select("*", part).join(first, "_part").withColumn("rank", place).drop("_part", "_at", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight and target, one row a source.

    Sources are numbered by code point, null last, and the weights repeat over them.
    The budget (share of all sizes) is dealt by weight; what exceeds a source's most is
    dealt again among the others, round by round, until no target is above its most.
    """
    by_source = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    state = written(by_source.select("source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full, w = state.agg(F.sum(F.when(F.col("full"), F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        left = share * total - repeats * (full or 0)
        most = F.lit(float(repeats)) * F.col("source_size")
        dealt = F.col("weight") * F.lit(float(left)) / F.lit(float(w or 1))
        target = F.when(F.col("full"), most).otherwise(dealt)
        above = ~F.col("full") & (target > most)
        if not state.where(above).limit(1).count():
            return state.select("source", "source_size", "weight", F.when(F.lit(total == 0), F.lit(0.0)).otherwise(target).alias("target"))
        state = written(state.withColumn("full", F.col("full") | above), "sources")


def _beside(rows: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    small = by_source.withColumnRenamed("source", "_source")
    small = F.broadcast(small) if n_sources <= MAX_BROADCAST_SOURCES else small
    return rows.join(small, rows.source.eqNullSafe(small["_source"])).drop("_source")


def thresholds(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """source and the budget's `cut`: the hash in which it runs out; `before`: words below it; `at`: words of it.

    budgets: source and need (words to take once).  Without a need, or with all words
    needed, cut is null.
    """
    state = budgets.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("at"))
    for left in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = _beside(rows.select("source", "size", "h"), state.where("need > 0"), n_sources)
        bucket = F.shiftright("h", left)
        histogram = inside.where(F.shiftright("h", left + STEP_BITS) == F.col("prefix")).groupBy("source", "need", "before", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        through = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        first = histogram.withColumn("through", through).where("through >= need").groupBy("source", "need").agg(F.min_by(F.struct("bucket", "through", "words"), "bucket").alias("b"))
        state = written(first.select("source", "need", F.col("b.bucket").alias("prefix"), (F.col("b.through") - F.col("b.words")).alias("before"), F.col("b.words").alias("at")), "histogram")
    return state.select("source", "need", F.col("prefix").alias("cut"), "before", "at")


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> tuple[DataFrame, int]:
    """What each source takes (source_size, target, whole copies, need, cut, before, at), and the number of sources."""
    by_source = written(targets(rows, weights, share, repeats), "targets")
    n_sources = by_source.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = by_source.select("source", "source_size", "target", whole.alias("whole")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = thresholds(rows, budgets.select("source", "need"), n_sources).withColumnRenamed("source", "_source")
    return budgets.join(cut.drop("need"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), n_sources


def _taken() -> Column:
    nearer = 2 * (F.col("need") - F.col("before")) > F.col("at")
    once_more = F.col("cut").isNotNull() & ((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & nearer))
    return (F.col("size") * (F.col("whole") + F.when(once_more, 1).otherwise(0))).alias("taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target of its source, taken (words, repeats counted).

    A source whose target is k times its size and a rest takes every document k times and
    those below the rest's threshold once more; the document in which the rest runs out
    is taken if that comes nearer to it.
    """
    rows = written(sized(docs), "sizes")
    return _beside(rows, *_plan(rows, weights, share, repeats)).select("doc_id", "size", "source_size", "target", _taken())


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, with all their columns as they were, and size, source_size, target and taken; a name of these that a document's column has gets a _ more."""
    own_names = {c.lower() for c in docs.columns}
    new = {}
    for c in ("size", "source_size", "target", "taken"):
        new[c] = c
        while new[c] in own_names:
            new[c] += "_"
    plan = _plan(written(sized(docs), "sizes"), weights, share, repeats)
    own = F.struct(*(docs[c] for c in docs.columns)).alias("_row")
    rows = _beside(docs.select(own, *_sizes(docs)[1:]), *plan)
    rows = rows.select("_row", "size", "source_size", "target", _taken()).where("taken > 0")
    return rows.select("_row.*", *(F.col(c).alias(n) for c, n in new.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 15) AS BIGINT) AS h
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight
  FROM rows_ GROUP BY source
), rounds AS (
  SELECT 0 AS k, source, source_size, weight, false AS full_ FROM src
  UNION ALL
  SELECT k + 1, source, source_size, weight, full_ OR above FROM (
    SELECT *, count(*) FILTER (WHERE above) OVER () AS n FROM (
      SELECT *, NOT full_ AND weight * (1.5e0 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) FILTER (WHERE full_) OVER (), 0)) / CAST(sum(weight) FILTER (WHERE NOT full_) OVER () AS DOUBLE) > 2.0 * source_size AS above
      FROM rounds))
  WHERE n > 0
), last_ AS (SELECT * FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
tgt AS (
  SELECT source, source_size, CASE WHEN sum(source_size) OVER () = 0 THEN 0e0 WHEN full_ THEN CAST(2 * source_size AS DOUBLE)
    ELSE weight * CAST(1.5e0 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) FILTER (WHERE full_) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT full_) OVER () AS DOUBLE) END AS target
  FROM last_
), bud AS (
  SELECT *, target - whole * source_size AS need FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM tgt)
), run AS (
  SELECT source, h, sum(size) AS at_, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS through FROM rows_ GROUP BY source, h
), cut AS (
  SELECT bud.source, min(h) AS cut, arg_min(through - at_, h) AS before_, arg_min(at_, h) AS at_
  FROM bud JOIN run ON bud.source IS NOT DISTINCT FROM run.source WHERE need > 0 AND through >= need GROUP BY bud.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN cut IS NOT NULL AND (h < cut OR h = cut AND 2 * (need - before_) > at_) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows_ JOIN bud ON rows_.source IS NOT DISTINCT FROM bud.source LEFT JOIN cut ON rows_.source IS NOT DISTINCT FROM cut.source
"""
