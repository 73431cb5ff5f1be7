"""How five filters interact: all 120 orders of them replayed over all documents.

Each document gets a mask of the filters that it fails.  The masks are crossed with the
120 orders, which are broadcast (their number is fixed), and each pair is exploded into
five steps.  The first step whose filter is in the mask removes the document; counts are
conditional sums by part, order and step, combined on the map side, so what is shuffled
is 600 rows a part and task at most, however hot a part is.

Filters: A few words, B few different words, C many capitals, D odd symbols, E a text
that a smaller doc_id has.  For E equal texts meet as digests (SHA-256) with their least
doc_id; those that a large part of all rows share are joined where they stand.

Defined cases: a null text is empty (and equal to an empty one), a null source is the
empty string; a document with a null doc_id never fails E, has no labels, and is never the
smaller one; rows alike in doc_id do not fail E for each other; a document with several
label rows counts as good or toxic if one of them says so, null labels say nothing; an
empty table gives an empty result; columns of other names are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table, written
from glossa.llm.skew import join_skewed
from glossa.llm.spans import once

FILTERS = "ABCDE"
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS = 200
#: Percent: different words at least, capitals at most.
LEAST_DIFFERENT, MOST_CAPITALS = 50, 2
SYMBOLS = r"[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _own_mask(text: F.Column) -> F.Column:
    """The filters that a text fails by itself: A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sizes = once(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("different")))

    def judged(n: F.Column) -> F.Column:
        fails = {
            "A": n["all"] < LEAST_WORDS,
            "B": 100 * n["different"] < LEAST_DIFFERENT * n["all"],
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
            "D": text.rlike(SYMBOLS),
        }
        mask = F.lit(0)
        for name, failed in fails.items():
            mask = mask + F.when(failed, BITS[name]).otherwise(0)
        return mask

    return once(sizes, judged)


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = written(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _own_mask(F.col("text")).alias("mask")), "flags")
    # only texts of several documents are looked up
    least = own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return join_skewed(own, least, ["digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(later, BITS["E"]).otherwise(0)).alias("mask"))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    known = known.where("quality or toxic").select("doc_id", F.col("quality").alias("good"), "toxic")
    flags = written(flags, "flagged")
    none = F.lit(False)
    out = join_skewed(flags.where("doc_id is not null"), known, ["doc_id"], "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    return out.unionByName(flags.where("doc_id is null").withColumns({"good": none, "toxic": none}))


def orders(spark: SparkSession) -> DataFrame:
    """number, filter_order and bits (an array of five) of the 120 orders."""
    rows = [(i, "".join(p), [BITS[x] for x in p]) for i, p in enumerate(permutations(FILTERS))]
    return spark.createDataFrame(rows, "number int, filter_order string, bits array<int>")


def replay(flags: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts; flags: part, mask, good, toxic of each document."""
    every = orders(flags.sparkSession)
    crossed = flags.select("part", "mask", "good", "toxic").join(F.broadcast(every.select("number", "bits")))
    first = F.coalesce(*(F.when(F.col("mask").bitwiseAND(F.col("bits")[i]) != 0, i + 1) for i in range(len(FILTERS))), F.lit(len(FILTERS) + 1))
    steps = crossed.select("part", "number", "mask", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    gone = F.col("first") == F.col("step")
    met = {
        "kept": F.col("first") > F.col("step"),
        "removed": gone,
        "redundant": (F.col("first") < F.col("step")) & (F.col("mask").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": gone & F.col("good"),
        "toxic_lost": gone & F.col("toxic"),
    }
    counts = steps.groupBy("part", "number", "step").agg(*(F.count_if(met[c]).alias(c) for c in COUNTS))
    named = counts.join(F.broadcast(every.select("number", "filter_order")), "number")
    return named.select("part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """replay() of all documents, with shapley: what a step's filter removes within its part in all orders, at any step."""
    counts = written(replay(labelled(flagged(docs), labels)), "replayed")
    # 600 rows a part: the sums are five a part
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    counts = counts.withColumn("filter", letter)
    shares = counts.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counts.join(shares, ["part", "filter"]).drop("filter")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), same AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT d.*, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text),
    regexp_matches(w.text, '[#$%&*|]'),
    coalesce(w.doc_id > least, false)] AS fails
  FROM w JOIN same ON same.text = w.text LEFT JOIN said ON said.doc_id = w.doc_id
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS i
  FROM letter a JOIN letter b ON b.x <> a.x JOIN letter c ON c.x NOT IN (a.x, b.x) JOIN letter d ON d.x NOT IN (a.x, b.x, c.x) JOIN letter e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), r AS (
  SELECT part, filter_order, good, toxic, fails, i, CASE WHEN fails[i[1]] THEN 1 WHEN fails[i[2]] THEN 2 WHEN fails[i[3]] THEN 3 WHEN fails[i[4]] THEN 4 WHEN fails[i[5]] THEN 5 ELSE 6 END AS first,
    len(list_filter(fails, lambda x: x)) AS failed
  FROM f CROSS JOIN o
), s AS (
  SELECT r.*, CAST(n.i AS INTEGER) AS step, r.fails[r.i[n.i]] AS own FROM r CROSS JOIN letter n
), t AS (
  SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (own AND first < step) AS redundant,
    count(*) FILTER (own AND failed = 1) AS unique_fails, count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT t.*, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM t"""
