"""Queries over the driver's tables, one or more for each operator, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import inline, text
from glossa.functions.categories import category_of, entity_type_of
from glossa.operators import analysis, bio, matching, metrics
from glossa.operators.context import errors_in_context
from glossa.operators.intervals import merged_spans
from glossa.plans import derived
from glossa.plans.annotate import pending
from glossa.plans.derived import gold, sides, system, table, tokens
from glossa.plans.registry import QUERIES, SQL, query  # noqa: F401


def _six(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


_SCORES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
_STRICT = """WITH f AS (
  SELECT doc_id, s, e, tag, max(g) AS g, max(y) AS y FROM (SELECT doc_id, s, e, tag, 1 AS g, 0 AS y FROM gold UNION ALL SELECT doc_id, s, e, tag, 0, 1 FROM sys) GROUP BY ALL
)"""
_COUNTS = "count(*) FILTER (WHERE g = 1 AND y = 1) AS tp, count(*) FILTER (WHERE g = 0) AS fp, count(*) FILTER (WHERE y = 0) AS fn"


def _strict(spark: SparkSession, sf_dir: str, on: tuple[str, ...] = ("start", "end", "tag")) -> DataFrame:
    return matching.strict_sides(sides(spark, sf_dir, list(on)), list(on))


@query(f"{_STRICT}, c AS (SELECT doc_id, {_COUNTS} FROM f GROUP BY doc_id) SELECT *, {_SCORES} FROM c")
def ner_strict_by_doc(spark, sf_dir):
    return metrics.with_scores(_strict(spark, sf_dir).groupBy("doc_id").agg(*matching.flag_counts()), 6)


@query(f"{_STRICT}, c AS (SELECT tag, {_COUNTS} FROM f GROUP BY tag) SELECT *, {_SCORES} FROM c")
def ner_strict_by_tag(spark, sf_dir):
    return metrics.with_scores(_strict(spark, sf_dir).groupBy("tag").agg(*matching.flag_counts()), 6)


@query(f"{_STRICT}, c AS (SELECT {_COUNTS} FROM f) SELECT *, {_SCORES} FROM c")
def ner_micro(spark, sf_dir):
    return metrics.with_scores(_strict(spark, sf_dir).agg(*matching.flag_counts()), 6)


@query(f"{_STRICT}, c AS (SELECT doc_id, {_COUNTS} FROM f GROUP BY doc_id), m AS (SELECT {_SCORES} FROM c) SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM m")
def ner_macro(spark, sf_dir):
    return metrics.macro(ner_strict_by_doc(spark, sf_dir)).select(*_six("precision", "recall", "f1"))


@query(f"{_STRICT.replace(', tag', '')}, c AS (SELECT {_COUNTS} FROM f) SELECT *, {_SCORES} FROM c")
def span_strict(spark, sf_dir):
    return metrics.with_scores(_strict(spark, sf_dir, ("start", "end")).agg(*matching.flag_counts()), 6)


def _merge_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT DISTINCT doc_id, s, e FROM {source}),
{name}1 AS (SELECT x.*, d.text, lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) AS p FROM {name}0 x JOIN documents d USING (doc_id)),
{name}2 AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN regexp_matches(substring(text, p + 1, greatest(0, s - p)), '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {name}1),
{name} AS (SELECT doc_id, min(s) AS s, arg_max(e, struct_pack(a := s, b := e)) AS e FROM {name}2 GROUP BY doc_id, i)"""


@query(f'WITH {_merge_sql("gm", "gold")} SELECT doc_id, s AS "start", e AS "end" FROM gm')
def span_merged_spans(spark, sf_dir):
    return merged_spans(gold(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(f"""WITH {_merge_sql("gm", "gold")}, {_merge_sql("ym", "sys")},
i AS ((SELECT doc_id, s, e FROM gold INTERSECT SELECT doc_id, s, e FROM sys) UNION (SELECT * FROM gm INTERSECT SELECT * FROM ym)),
fp AS (SELECT doc_id, s, e FROM sys EXCEPT SELECT doc_id, s, e FROM gold), fn AS (SELECT doc_id, s, e FROM gold EXCEPT SELECT doc_id, s, e FROM sys),
k AS (SELECT doc_id, 'tp' AS kind FROM i
  UNION ALL SELECT doc_id, 'fp' FROM fp x WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = x.doc_id AND i.s <= x.s AND x.e <= i.e)
  UNION ALL SELECT doc_id, 'fn' FROM fn x WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = x.doc_id AND i.s <= x.s AND x.e <= i.e)),
c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn FROM k GROUP BY doc_id)
SELECT *, {_SCORES} FROM c""")
def span_merged_eval(spark, sf_dir):
    rows = matching.merged(gold(spark, sf_dir), system(spark, sf_dir), table(spark, sf_dir, "documents"))
    return metrics.with_scores(rows.groupBy("doc_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn"))), 6)


_SENTENCES = "SELECT doc_id, nullif(length(text) - length(replace(text, '.', '')), 0) AS n FROM documents"


def _leaks(spark, sf_dir) -> DataFrame:
    counts = _strict(spark, sf_dir).groupBy("doc_id").agg(*matching.flag_counts())
    stops = F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))
    return counts.join(table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif(stops, F.lit(0)).alias("n_sentences")), "doc_id")


@query(f"{_STRICT}, c AS (SELECT doc_id, {_COUNTS} FROM f GROUP BY doc_id) SELECT doc_id, fn, round(fn / n, 6) AS leak FROM c JOIN ({_SENTENCES}) USING (doc_id)")
def leak_by_doc(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "fn", F.round(metrics.leak(F.col("fn"), F.col("n_sentences")), 6).alias("leak"))


@query(f"{_STRICT}, c AS (SELECT doc_id, {_COUNTS} FROM f GROUP BY doc_id) SELECT lang, CASE WHEN count(*) FILTER (WHERE n IS NULL) = 0 THEN round(sum(fn) / sum(n), 6) END AS leak FROM c JOIN ({_SENTENCES}) USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")
def leak_micro(spark, sf_dir):
    return metrics.micro_leak(_leaks(spark, sf_dir), ["lang"]).select("lang", F.round("leak", 6).alias("leak"))


_DOUBLED = "SELECT * FROM gold UNION ALL SELECT doc_id, ord + 1000000, s, e, tag, text FROM gold WHERE ord % 3 = 0"


@query(f"""WITH gd AS ({_DOUBLED}), sd AS (SELECT * FROM sys UNION ALL SELECT doc_id, ord + 1000000, s, e, tag, text FROM sys WHERE ord % 5 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, text, tag ORDER BY ord) AS k FROM gd), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, text, tag ORDER BY ord) AS k FROM sd)
SELECT doc_id, s AS "start", e AS "end", text, tag, CAST(g.ord AS BIGINT) AS gold_ord, CAST(y.ord AS BIGINT) AS sys_ord FROM g JOIN y USING (doc_id, s, e, text, tag, k)""")
def exact_multiset_match(spark, sf_dir):
    def doubled(df: DataFrame, every: int) -> DataFrame:
        df = df.withColumn("ord", F.col("ord").cast("long"))
        return df.unionByName(df.where(F.col("ord") % every == 0).withColumn("ord", F.col("ord") + 1_000_000))

    return matching.exact_pairs(doubled(gold(spark, sf_dir), 3), doubled(system(spark, sf_dir), 5), ["start", "end", "text", "tag"])


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _two_phase_sql(by_tag: bool) -> str:
    same, tag = ("AND y.tag = g.tag", ", tag") if by_tag else ("", "")
    return f"""WITH b AS (SELECT g.doc_id, g.ord AS gord, y.ord AS yord FROM gold g JOIN sys y ON g.doc_id = y.doc_id AND g.s = y.s AND g.e = y.e AND g.text = y.text {same}),
g1 AS (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = g.doc_id AND b.gord = g.ord)),
y1 AS (SELECT * FROM sys y WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = y.doc_id AND b.yord = y.ord)),
p AS (SELECT y.doc_id, y.ord AS sys_ord, y.s, y.e, y.tag, y.text, g.ord AS gold_ord, g.s - y.s AS gs, g.e - y.s AS ge FROM y1 y JOIN g1 g ON y.doc_id = g.doc_id AND y.s <= g.s AND g.e <= y.e {same}),
q AS (SELECT *, max(ge) OVER (PARTITION BY doc_id, sys_ord ORDER BY gs, ge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
u AS (SELECT doc_id, sys_ord, s, e, tag, text, coalesce(before, 0) AS us, gs AS ue FROM q WHERE gs > coalesce(before, 0)
  UNION ALL SELECT doc_id, sys_ord, s, e, tag, text, max(ge), e - s FROM p GROUP BY doc_id, sys_ord, s, e, tag, text HAVING max(ge) < e - s),
x AS (SELECT doc_id, sys_ord, bool_or(len(list_filter(regexp_split_to_array(regexp_replace(substring(text, us + 1, ue - us), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) > 0) AS extra,
  string_agg(us || '-' || ue, ',' ORDER BY us) AS uncovered FROM u GROUP BY doc_id, sys_ord),
h AS (SELECT doc_id, sys_ord, s, e, tag, count(*) AS n_gold FROM p GROUP BY ALL)"""


def _two_phase(spark, sf_dir, by_tag: bool):
    return matching.two_phase(gold(spark, sf_dir), system(spark, sf_dir), table(spark, sf_dir, "documents"), text.significant, by_tag)


@query(_two_phase_sql(False) + """ SELECT doc_id, CAST(h.sys_ord AS INTEGER) AS sys_ord, s AS sys_start, e AS sys_end, tag AS sys_tag, n_gold, coalesce(uncovered, '') AS uncovered, coalesce(extra, false) AS extra FROM h LEFT JOIN x USING (doc_id, sys_ord)""")
def inclusion_groupings(spark, sf_dir):
    held = _two_phase(spark, sf_dir, False)[1]
    parts = F.array_join(F.transform("uncovered", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return held.withColumn("uncovered", parts)


def _two_phase_counts_sql(by_tag: bool) -> str:
    return _two_phase_sql(by_tag) + f""", n AS (
  SELECT doc_id, (SELECT count(*) FROM gold g WHERE g.doc_id = d.doc_id) AS g, (SELECT count(*) FROM sys y WHERE y.doc_id = d.doc_id) AS y, (SELECT count(*) FROM b WHERE b.doc_id = d.doc_id) AS b,
    (SELECT count(DISTINCT gold_ord) FROM p WHERE p.doc_id = d.doc_id) AS hg, (SELECT count(*) FROM h WHERE h.doc_id = d.doc_id) AS hy, (SELECT count(*) FROM x WHERE x.doc_id = d.doc_id AND extra) AS x
  FROM (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM gold UNION ALL SELECT doc_id FROM sys)) d),
c AS (SELECT doc_id, b + hg AS tp, y - b - hy + x AS fp, g - b - hg AS fn FROM n) SELECT *, {_SCORES} FROM c"""


@query(_two_phase_counts_sql(True))
def twophase_counts(spark, sf_dir):
    return metrics.with_scores(_two_phase(spark, sf_dir, True)[0], 6)


@query(_two_phase_counts_sql(False))
def twophase_relaxed(spark, sf_dir):
    return metrics.with_scores(_two_phase(spark, sf_dir, False)[0], 6)


_MISSED = """WITH m AS MATERIALIZED (SELECT * FROM gold g WHERE NOT EXISTS (SELECT 1 FROM sys y WHERE y.doc_id = g.doc_id AND y.s = g.s AND y.e = g.e AND y.tag = g.tag)),
mb AS MATERIALIZED (SELECT doc_id, ord, s, e, unnest(range(s // 256, e // 256 + 1)) AS bin FROM m), yb AS MATERIALIZED (SELECT doc_id, ord, s, e, unnest(range(s // 256, e // 256 + 1)) AS bin FROM sys),
o AS (SELECT m.doc_id, m.ord, y.ord AS sys_ord, 100.0e0 * (least(m.e, y.e) - greatest(m.s, y.s)) / (m.e - m.s) AS percent FROM mb m JOIN yb y ON m.doc_id = y.doc_id AND m.bin = y.bin
  WHERE greatest(m.s, y.s) < least(m.e, y.e) AND m.bin = greatest(m.s, y.s) // 256)"""
_BEST_MISSED = _MISSED + """,
z AS (SELECT m.doc_id, m.ord, coalesce(max(percent), 0) AS percent, arg_max(o.sys_ord, struct_pack(a := percent, b := -o.sys_ord)) AS sys_ord FROM m LEFT JOIN o ON m.doc_id = o.doc_id AND m.ord = o.ord GROUP BY m.doc_id, m.ord)"""
#: Missed: without a system span of equal place and tag; any system span may overlap them.
_MISS = {"on": ["start", "end", "tag"], "by_tag": False, "inclusion": False}


@query(_MISSED + " SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(sys_ord AS INTEGER) AS sys_ord, round(percent, 6) AS percent FROM o")
def fn_overlap_pairs(spark, sf_dir):
    return matching.lost_overlaps(gold(spark, sf_dir), system(spark, sf_dir), **_MISS).withColumn("percent", F.round("percent", 6))


@query(_BEST_MISSED + " SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(sys_ord AS INTEGER) AS sys_ord, round(percent, 6) AS percent FROM z")
def fn_best_overlap(spark, sf_dir):
    return matching.lost_spans(gold(spark, sf_dir), system(spark, sf_dir), **_MISS).select("doc_id", "ord", "sys_ord", F.round("percent", 6).alias("percent"))


@query(_BEST_MISSED + """, n AS (SELECT CASE WHEN percent = 0 THEN '0%' ELSE (CAST(least(floor(percent / 10), 9) AS INTEGER) * 10) || '-' || (CAST(least(floor(percent / 10), 9) AS INTEGER) * 10 + 10) || '%' END AS bin, count(*) AS n FROM z GROUP BY 1),
k AS (SELECT '0%' AS bin UNION ALL SELECT (10 * i) || '-' || (10 * i + 10) || '%' FROM range(10) r(i))
SELECT bin, coalesce(n, 0) AS n, round(coalesce(100.0e0 * coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (), 0), 0), 6) AS share FROM k LEFT JOIN n USING (bin)""")
def fn_overlap_hist(spark, sf_dir):
    rows = matching.lost_spans(gold(spark, sf_dir), system(spark, sf_dir), **_MISS)
    return metrics.overlap_histogram(rows).withColumn("share", F.round("share", 6))


_ANALYZER = """WITH a AS (
  SELECT doc_id, tag, s, e, CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = y.doc_id AND g.s = y.s AND g.e = y.e AND g.tag IS NOT DISTINCT FROM y.tag) THEN 'tp' ELSE 'fp' END AS kind FROM sys y
  UNION ALL SELECT doc_id, tag, s, e, 'fn' FROM gold g WHERE NOT EXISTS (SELECT 1 FROM sys y WHERE g.doc_id = y.doc_id AND g.s = y.s AND g.e = y.e AND g.tag IS NOT DISTINCT FROM y.tag)
)"""


@query(_ANALYZER + f""", c AS (SELECT tag, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn FROM a GROUP BY tag)
SELECT *, {_SCORES.replace(", 6)", ", 4)")}, CASE WHEN tp + fn = 0 THEN tag || ' *' ELSE tag END AS mark FROM c""")
def analyzer_tag_metrics(spark, sf_dir):
    return metrics.by_tag(matching.analyzer_sides(sides(spark, sf_dir, ["start", "end", "tag"])))


@query(_ANALYZER + """ SELECT a.doc_id, tag, kind, s AS "start", e AS "end", '...' || substring(text, greatest(0, s - 30) + 1, s - greatest(0, s - 30)) || '>>>' || substring(text, s + 1, e - s) || '<<<' || substring(text, e + 1, 30) || '...' AS context
FROM a JOIN documents USING (doc_id) WHERE kind <> 'tp'""")
def analyzer_errors(spark, sf_dir):
    return errors_in_context(sides(spark, sf_dir, ["start", "end", "tag"]), table(spark, sf_dir, "documents"))


_BEST = """WITH p AS (SELECT g.doc_id, g.ord, g.tag AS gold_tag, y.tag AS pred_tag, g.s = y.s AND g.e = y.e AND g.tag = y.tag AS exact, greatest(g.s, y.s) < least(g.e, y.e) AS touch, greatest(0, least(g.e, y.e) - greatest(g.s, y.s)) AS len, y.ord AS yo
  FROM gold g JOIN sys y ON g.doc_id = y.doc_id AND (greatest(g.s, y.s) < least(g.e, y.e) OR g.s = y.s OR g.s = y.e OR g.e = y.s OR g.e = y.e)),
b AS (SELECT *, CASE WHEN exact THEN 'TP' ELSE 'CONFUSION' END AS kind FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY exact DESC, touch DESC, len DESC, yo) = 1)"""


@query(_BEST + " SELECT gold_tag, pred_tag, kind, count(*) AS n FROM b GROUP BY ALL")
def confusion_long(spark, sf_dir):
    rows = matching.best_overlap(gold(spark, sf_dir), system(spark, sf_dir))
    return rows.groupBy("gold_tag", "pred_tag", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(_BEST + ", l AS (SELECT gold_tag AS t FROM b UNION SELECT pred_tag FROM b) SELECT x.t AS gold_tag, y.t AS pred_tag, (SELECT count(*) FROM b WHERE b.gold_tag = x.t AND b.pred_tag = y.t) AS n FROM l x, l y")
def confusion_dense(spark, sf_dir):
    return metrics.confusion(matching.best_overlap(gold(spark, sf_dir), system(spark, sf_dir)))


@query(_BEST + " SELECT gold_tag, " + ", ".join(f"count(*) FILTER (WHERE pred_tag = '{t}') AS {t}" for t in ("LOC", "MISC", "ORG", "PER")) + " FROM b GROUP BY gold_tag")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(matching.best_overlap(gold(spark, sf_dir), system(spark, sf_dir)), ["LOC", "MISC", "ORG", "PER"])


@query("""WITH c AS (SELECT tag AS category, CASE WHEN ord % 2 = 0 THEN tag || '_EVEN' ELSE 'SIN_TIPO' END AS type FROM sys), k AS (SELECT category, type, grouping_id(category, type) AS level, count(*) AS n FROM c GROUP BY GROUPING SETS ((category, type), (category), (type), ()))
SELECT category, type, CAST(level AS BIGINT) AS level, n, round(100.0e0 * n / max(CASE WHEN level = 3 THEN n END) OVER (), 6) AS percent FROM k""")
def tag_counts_grouping_sets(spark, sf_dir):
    spans = system(spark, sf_dir).select(F.col("tag").alias("category"), F.when(F.col("ord") % 2 == 0, F.concat("tag", F.lit("_EVEN"))).alias("type"))
    return metrics.tag_counts(spans).withColumn("percent", F.round("percent", 6))


@query(f"""{_STRICT}, c AS (SELECT tag, {_COUNTS} FROM f GROUP BY tag), a AS (SELECT tag, {_SCORES} FROM c),
f2 AS (SELECT doc_id, s, e, tag, max(g) AS g, max(y) AS y FROM (SELECT doc_id, s, e, tag, 1 AS g, 0 AS y FROM gold UNION ALL SELECT doc_id, s, e, tag, 0, 1 FROM sys WHERE ord % 3 <> 0 AND tag <> 'MISC') GROUP BY ALL),
c2 AS (SELECT tag, {_COUNTS} FROM f2 GROUP BY tag), b AS (SELECT tag, {_SCORES} FROM c2)
SELECT tag, {", ".join(f"coalesce(a.{m}, 0) AS {m}_1, coalesce(b.{m}, 0) AS {m}_2, round(coalesce(b.{m}, 0) - coalesce(a.{m}, 0), 6) AS {m}_diff" for m in ("precision", "recall", "f1"))} FROM a FULL JOIN b USING (tag)""")
def compare_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    one, two = (runs.where(F.col("run") == run).drop("run") for run in ("run1", "run2"))
    out = analysis.compare_runs(one, two, ["precision", "recall", "f1"])
    return out.select("tag", *(c if not c.endswith("_diff") else F.round(c, 6).alias(c) for c in out.columns if c != "tag"))


_TURNS = """WITH x AS (SELECT conv_id, turn, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS length_1 FROM conversations WHERE turn % 2 = 0), y AS (SELECT conv_id, turn - 1 AS turn, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS length_2 FROM conversations WHERE turn % 2 = 1),
l AS (SELECT *, length_1 - length_2 AS diff FROM x JOIN y USING (conv_id, turn))"""


def _turn_lengths(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return analysis.compare_lengths(turns.where("turn % 2 = 0"), turns.where("turn % 2 = 1").withColumn("turn", F.col("turn") - 1), "conv_id", "turn")


@query(_TURNS + """ SELECT count(*) AS n, count(*) FILTER (WHERE diff > 0) AS longer_1, count(*) FILTER (WHERE diff < 0) AS longer_2, count(*) FILTER (WHERE diff = 0) AS equal,
  round(100.0e0 * count(*) FILTER (WHERE diff > 0) / count(*), 6) AS longer_1_pct, round(100.0e0 * count(*) FILTER (WHERE diff < 0) / count(*), 6) AS longer_2_pct, round(100.0e0 * count(*) FILTER (WHERE diff = 0) / count(*), 6) AS equal_pct, round(avg(diff), 6) AS mean_diff FROM l""", spans=False)
def length_compare(spark, sf_dir):
    return analysis.length_summary(_turn_lengths(spark, sf_dir)).select("n", "longer_1", "longer_2", "equal", *_six("longer_1_pct", "longer_2_pct", "equal_pct", "mean_diff"))


@query(_TURNS + " SELECT conv_id, turn, CAST(length_1 AS INTEGER) AS length_1, CAST(length_2 AS INTEGER) AS length_2, CAST(diff AS INTEGER) AS diff FROM l ORDER BY abs(diff) DESC, conv_id, turn LIMIT 5", spans=False)
def top5_length_diff(spark, sf_dir):
    return analysis.top_differences(_turn_lengths(spark, sf_dir), 5, "conv_id", "turn")


_FP = """WITH e AS (SELECT tag, trim(replace(strip_accents(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g')), 'ß', '')) AS norm FROM sys y WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = y.doc_id AND g.s = y.s AND g.e = y.e AND g.tag = y.tag))"""


def _false_positives(spark, sf_dir) -> DataFrame:
    g, s = gold(spark, sf_dir), system(spark, sf_dir)
    return s.join(g.select("doc_id", "start", "end", "tag"), ["doc_id", "start", "end", "tag"], "left_anti")


@query(_FP + " SELECT norm, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, norm LIMIT 15")
def fp_top15(spark, sf_dir):
    errors = _false_positives(spark, sf_dir).groupBy("text").agg(F.count(F.lit(1)).alias("k"))  # each text is folded once
    folded = errors.select(text.error_text(F.col("text")).alias("norm"), "k").groupBy("norm").agg(F.sum("k").alias("n"))
    return folded.orderBy(F.desc("n"), "norm").limit(15)


@query(_FP + " SELECT tag, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM e GROUP BY tag")
def fp_tag_share(spark, sf_dir):
    return analysis.tag_shares(_false_positives(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


_BIO = """WITH h AS (SELECT t.doc_id, t.pos, t.token, t.s, min(struct_pack(s := y.s, e := y.e, tag := y.tag)) AS y FROM tok t LEFT JOIN sys y ON t.doc_id = y.doc_id AND y.s <= t.s AND t.e <= y.e GROUP BY ALL),
b AS (SELECT doc_id, pos, token, CASE WHEN y.s IS NULL THEN 'O' WHEN y.s = s THEN 'B-' || y.tag ELSE 'I-' || y.tag END AS label, s FROM h),
g0 AS (SELECT t.doc_id, t.pos, t.token, t.s, CASE WHEN t.pos % 7 = 0 OR t.pos % 7 = 1 THEN 'B-' || t.tag ELSE 'O' END AS label FROM tok t)"""


def _bio(spark, sf_dir, spans: DataFrame) -> DataFrame:
    return bio.labels_of(tokens(spark, sf_dir).select("doc_id", "pos", "token", "start", "end"), spans)


@query(_BIO + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, label FROM b")
def bio_from_spans(spark, sf_dir):
    return _bio(spark, sf_dir, system(spark, sf_dir)).select("doc_id", "pos", "token", "label")


@query(_BIO + """, o AS (SELECT *, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st,
  sum(CASE WHEN label LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM b),
k AS (SELECT *, sum(CASE WHEN label = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY pos) AS stops FROM o WHERE i > 0)
SELECT doc_id, min(st) AS "start", max(st + length(token)) AS "end", arg_min(substring(label, 3), pos) AS tag, string_agg(token, ' ' ORDER BY pos) AS text FROM k WHERE stops = 0 GROUP BY doc_id, i""")
def bio_to_spans(spark, sf_dir):
    return bio.spans_of(bio_from_spans(spark, sf_dir))


#: For B, I and O alone: a chunk starts with B, and with an I after O or another type.
_CHUNK = """, l AS (SELECT b.doc_id, b.pos, g0.label AS gold, b.label AS pred FROM b JOIN g0 USING (doc_id, pos)),
v AS (SELECT doc_id, pos, 'g' AS side, gold AS x FROM l UNION ALL SELECT doc_id, pos, 'p', pred FROM l),
v1 AS (SELECT *, lag(x, 1, 'O') OVER (PARTITION BY doc_id, side ORDER BY pos) AS px FROM v),
v2 AS (SELECT *, sum(CASE WHEN x LIKE 'B%' OR (x LIKE 'I%' AND (px = 'O' OR substring(px, 3) <> substring(x, 3))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, side ORDER BY pos) AS i FROM v1),
v3 AS (SELECT *, sum(CASE WHEN x = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, side, i ORDER BY pos) AS stops FROM v2 WHERE i > 0),
c AS (SELECT doc_id, side, min(pos) AS a, max(pos) AS z, arg_min(substring(x, 3), pos) AS type FROM v3 WHERE stops = 0 GROUP BY doc_id, side, i)"""


def _labels(spark, sf_dir) -> DataFrame:
    gold_label = F.when(F.col("pos") % 7 < 2, F.concat(F.lit("B-"), derived._tag())).otherwise(F.lit("O"))
    rows = tokens(spark, sf_dir).select("doc_id", "pos", "start", "end", gold_label.alias("gold"))
    return bio.labels_of(rows, system(spark, sf_dir)).select("doc_id", "pos", "gold", F.col("label").alias("pred"))


@query(_BIO + _CHUNK + """ SELECT doc_id, CAST(a AS INTEGER) AS "first", CAST(z AS INTEGER) AS "last", type FROM c WHERE side = 'p'""")
def conll_chunks(spark, sf_dir):
    return bio.chunks(_labels(spark, sf_dir), "pred")


@query(_BIO + _CHUNK + """, m AS (SELECT type, max((side = 'g')::INT) AS g, max((side = 'p')::INT) AS p FROM c GROUP BY doc_id, a, z, type),
n AS (SELECT type, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(p) AS BIGINT) AS n_found, CAST(sum(g * p) AS BIGINT) AS n_correct FROM m GROUP BY ROLLUP (type))
SELECT *, round(CASE WHEN n_found > 0 THEN 100.0e0 * n_correct / n_found ELSE 0 END, 2) AS precision, round(CASE WHEN n_gold > 0 THEN 100.0e0 * n_correct / n_gold ELSE 0 END, 2) AS recall, round(CASE WHEN n_gold + n_found > 0 THEN 200.0e0 * n_correct / (n_gold + n_found) ELSE 0 END, 2) AS f1 FROM n""")
def conll_scores(spark, sf_dir):
    return bio.chunk_scores(_labels(spark, sf_dir))


@query(_BIO + """, a AS (SELECT doc_id, CASE WHEN pos % 11 = 5 THEN 'O' ELSE g0.label END AS gold, CASE WHEN pos % 11 = 5 THEN 'O' ELSE b.label END AS pred FROM b JOIN g0 USING (doc_id, pos))
SELECT doc_id, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0e0 ELSE 0 END), 6) AS accuracy FROM a GROUP BY doc_id""")
def aligned_accuracy(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("doc_id", "pos", "token", F.when(F.col("pos") % 7 < 2, F.concat(F.lit("B-"), derived._tag())).otherwise(F.lit("O")).alias("label"))
    # every eleventh token differs
    other = bio_from_spans(spark, sf_dir).withColumn("token", F.when(F.col("pos") % 11 == 5, F.concat("token", F.lit("x"))).otherwise(F.col("token")))
    return bio.aligned_accuracy(bio.aligned_pairs(rows, other), ["doc_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n FROM documents", spans=False)
def value_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_count("text", F.lit("the")), F.lit(0)).cast("long").alias("n"))


@query(r"""WITH f AS (SELECT doc_id, text, regexp_replace(lower(strip_accents(text)), '(there|the|el)', chr(1) || '\1' || chr(1), 'g') AS m FROM documents),
p AS (SELECT doc_id, text, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM f),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ord, CAST(e - length(piece) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CASE piece WHEN 'the' THEN 'SHORT' WHEN 'there' THEN 'LONG' ELSE 'ACCENT' END AS tag,
  substring(text, CAST(e - length(piece) + 1 AS BIGINT), length(piece)) AS text FROM s WHERE i % 2 = 0""", spans=False)
def overlap_free_longest(spark, sf_dir):
    """Occurrences of a few words, whatever case and accents, without overlaps; sequential by nature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("the").alias("a"), F.lit("there").alias("b"), F.lit("él").alias("c"))
    return inline.loose_spans(docs, ["doc_id"], {"a": "SHORT", "b": "LONG", "c": "ACCENT"})


#: Pieces of texts between and within the marked words: those with an even number are words.
_VERBS = r"""WITH f AS (SELECT doc_id, text, regexp_replace(text, '([A-Za-z]{6,}ing)\b', chr(1) || '\1' || chr(1), 'g') AS m FROM documents),
p AS (SELECT doc_id, text, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM f)"""


@query(_VERBS + """, s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
SELECT doc_id, CAST(i // 2 AS INTEGER) AS ord, CAST(e - length(piece) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", 'VERB' AS tag, piece AS text FROM s WHERE i % 2 = 0""", spans=False)
def inline_alignment(spark, sf_dir):
    """Tags put around words, taken off again, and placed in the original text."""
    marked = F.regexp_replace("text", r"([A-Za-z]{6,}ing)\b", "<VERB>$1</VERB>")
    docs = table(spark, sf_dir, "documents").withColumn("tagged_text", marked)
    return inline.aligned_spans(docs, ["doc_id"])


@query(_VERBS + r""", t AS (SELECT doc_id, i, unnest(string_split_regex(piece, '\s+')) AS token, generate_subscripts(string_split_regex(piece, '\s+'), 1) AS j FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos, token, CASE i % 2 WHEN 0 THEN 'B-VERB' ELSE 'O' END AS label FROM t WHERE token <> ''""", spans=False)
def inline_bio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("tagged_text", F.regexp_replace("text", r"([A-Za-z]{6,}ing)\b", "<VERB>$1</VERB>"))
    return inline.bio_tokens(docs, ["doc_id"])


@query()
def html_tag_quality(spark, sf_dir):
    """Well-formed upper-case tags and stray brackets of pages (needs back-references)."""
    correct, wrong = inline.tag_counts_of(F.coalesce("html", F.lit("")), 2)
    rows = table(spark, sf_dir, "pages").select("page_id", correct.alias("correct"), wrong.alias("wrong"))
    return rows.select("page_id", "correct", "wrong", F.round(analysis.tag_quality(F.col("correct"), F.col("wrong")), 6).alias("quality"))


_WRAPPED = "CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || props || '```' WHEN 2 THEN props WHEN 3 THEN 'text ' || props ELSE substring(props, 2) END"


@query(f"""WITH r AS (SELECT event_id, {_WRAPPED} AS r FROM events), x AS (SELECT *, regexp_matches(r, '(?s)```json\\s*(.*?)\\s*```') AS f, regexp_matches(r, '(?s)```\\s*(.*?)\\s*```') AS p FROM r)
SELECT event_id, CASE WHEN f AND coalesce(json_valid(regexp_extract(r, '(?s)```json\\s*(.*?)\\s*```', 1)), false) THEN 'delimiters' WHEN NOT f AND p AND coalesce(json_valid(regexp_extract(r, '(?s)```\\s*(.*?)\\s*```', 1)), false) THEN 'no_delimiters'
  WHEN coalesce(json_valid(trim(r)), false) THEN 'raw' ELSE 'malformed' END AS kind FROM x""", spans=False)
def json_kind(spark, sf_dir):
    wrapped = F.expr(_WRAPPED.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "events").select("event_id", inline.json_kind_column(wrapped).alias("kind"))


@query(r"""WITH RECURSIVE l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM l0 WHERE NOT regexp_matches(line, '^\s*$')),
r AS (SELECT doc_id, i, 0 AS part, n AS size FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.size + 1 + l.n < 1843 THEN part ELSE part + 1 END, CASE WHEN r.size + 1 + l.n < 1843 THEN r.size + 1 + l.n ELSE l.n END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
c AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY i) AS chunk FROM r JOIN l USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, CAST(part AS INTEGER) AS part, chunk, length(chunk) >= 1843 AS oversize FROM c""", spans=False)
def chunk_documents(spark, sf_dir):
    """Lines packed to a budget of 1843 characters."""
    return inline.chunked(table(spark, sf_dir, "documents"), ["doc_id"], inline.safe_limit(2048))


_BLOCKS = "SELECT 'm' || (user_id % 4) AS model, 'prompt' || (event_id % 6) AS prompt, 'f' || (user_id % 50) AS file, event_type IN ('error', 'purchase') AS has_error, CASE event_id % 3 WHEN 0 THEN 'malformed' WHEN 1 THEN 'delimiters' ELSE 'no_delimiters' END AS error_kind, event_id AS pos FROM events"


def _blocks(spark, sf_dir) -> DataFrame:
    return spark.sql(_BLOCKS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@query(f"""WITH b AS ({_BLOCKS}) SELECT model, prompt, count(*) AS total, count(*) FILTER (WHERE has_error) AS failed, {", ".join(f"count(*) FILTER (WHERE has_error AND error_kind = '{k}') AS {k}" for k in ("no_delimiters", "delimiters", "malformed"))},
  round(100.0e0 * count(*) FILTER (WHERE has_error) / count(*), 6) AS rate FROM b GROUP BY model, prompt""", spans=False)
def log_failures(spark, sf_dir):
    return analysis.failure_stats(_blocks(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@query(f"""WITH b AS ({_BLOCKS}) SELECT model, {", ".join(f"round(100.0e0 * count(*) FILTER (WHERE has_error AND prompt = 'prompt{i}') / nullif(count(*) FILTER (WHERE prompt = 'prompt{i}'), 0), 6) AS prompt{i}" for i in range(6))} FROM b GROUP BY model""", spans=False)
def log_failure_pivot(spark, sf_dir):
    return analysis.failure_pivot(log_failures(spark, sf_dir), "rate", [f"prompt{i}" for i in range(6)])


@query(f"WITH b AS ({_BLOCKS}) SELECT model, prompt, string_agg(file, ',' ORDER BY pos) AS files FROM b WHERE has_error GROUP BY model, prompt", spans=False)
def log_failed_files(spark, sf_dir):
    return analysis.failed_files(_blocks(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


@query(f"WITH b AS ({_BLOCKS}) SELECT file, count(*) AS n FROM b WHERE has_error GROUP BY file HAVING count(*) > 1", spans=False)
def log_common_failures(spark, sf_dir):
    return analysis.common_failures(_blocks(spark, sf_dir))


_MARKS = "SELECT CAST(user_id AS VARCHAR) AS run, event_type AS name, ts, event_id AS line_no FROM events"


@query(f"""WITH m AS (SELECT *, lead(ts) OVER (PARTITION BY run ORDER BY line_no) AS nx, row_number() OVER (PARTITION BY run, name ORDER BY line_no) AS k FROM ({_MARKS})),
s AS (SELECT run, name, (epoch_us(nx) - epoch_us(ts)) / 1000000.0e0 / 235 AS seconds FROM m WHERE k = 1) SELECT run, name, round(CASE WHEN seconds > 0 THEN seconds END, 6) AS seconds FROM s""", spans=False)
def period_seconds(spark, sf_dir):
    marks = spark.sql(_MARKS.replace("VARCHAR", "STRING").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return analysis.periods(marks).withColumn("seconds", F.round("seconds", 6))


@query("SELECT CAST(quality AS VARCHAR) AS gold_tag, CAST(toxic AS VARCHAR) AS pred_tag, count(*) AS n FROM labels GROUP BY ALL", spans=False)
def quality_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("gold_tag"), F.col("toxic").cast("string").alias("pred_tag"))
    return metrics.confusion(rows)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id", spans=False)
def resume_pending(spark, sf_dir):
    return pending(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'PROFESSION' WHEN 2 THEN 'NAME' ELSE 'WARNING' END AS category, CASE WHEN upper(lang) IN ('PER', 'LOC', 'ORG', 'MISC') THEN upper(lang) ELSE 'OTROS' END AS entity_type,
  translate(text, 'áéíóúÁÉÍÓÚ', 'aeiouAEIOU') AS plain FROM documents""", spans=False)
def category_map(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("HOSPITAL", "PROFESIÓN", "NOMBRE_SUJETO_ASISTENCIA", "XYZ"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", category_of(kinds).alias("category"), entity_type_of(F.upper("lang")).alias("entity_type"), text.without_accents(F.col("text")).alias("plain"))


@query("""WITH a AS (SELECT lang, source FROM documents), b AS (SELECT lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT 'both' AS kind, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', * FROM (SELECT * FROM a UNION SELECT * FROM b)""", spans=False)
def set_operations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a, b = (df.select("lang", "source") for df in (docs, docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "either": a.union(b).distinct()}
    out = [df.select(F.lit(k).alias("kind"), "lang", "source") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("""WITH n AS (SELECT source, count(*) AS n, CASE WHEN regexp_matches(source, '\\d') THEN CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) ELSE 2147483647 END AS k FROM documents GROUP BY source)
SELECT source, n, row_number() OVER (ORDER BY k, source) AS place FROM n""", spans=False)
def natural_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source", "n", F.row_number().over(Window.orderBy(analysis.natural_key(F.col("source")), "source")).cast("long").alias("place"))


@query("""SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars_, CAST(length(text) - length(replace(replace(text, '.', ''), chr(10), '')) AS INTEGER) AS marks, NOT regexp_matches(text, '[\\p{L}\\p{N}]') AS bare FROM documents""", spans=False)
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", analysis.text_length(F.col("text")).alias("n_chars_"), text.sentence_marks(F.col("text")).alias("marks"), text.no_alphanumeric(F.col("text")).alias("bare"))


@query("SELECT lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 2 = 0 UNION ALL SELECT 'fallback', source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id % 2 <> 0", spans=False)
def filled_configuration(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return analysis.fill_missing(docs.where("doc_id % 2 = 0"), table(spark, sf_dir, "labels"), docs.withColumn("lang", F.lit("fallback"))).select("lang", "source")


_RUNS = f"""{_STRICT}, c AS (SELECT tag, 'run1' AS run, {_COUNTS} FROM f GROUP BY tag), a AS (SELECT tag, run, {_SCORES} FROM c),
f2 AS (SELECT doc_id, s, e, tag, max(g) AS g, max(y) AS y FROM (SELECT doc_id, s, e, tag, 1 AS g, 0 AS y FROM gold UNION ALL SELECT doc_id, s, e, tag, 0, 1 FROM sys WHERE ord % 3 <> 0 AND tag <> 'MISC') GROUP BY ALL),
c2 AS (SELECT tag, 'run2' AS run, {_COUNTS} FROM f2 GROUP BY tag), r AS (SELECT * FROM a UNION ALL SELECT tag, run, {_SCORES} FROM c2)"""


def _runs(spark, sf_dir) -> DataFrame:
    """Scores by tag of the system (run1) and of a part of it (run2), both from one pass."""
    part = F.when(F.expr("ord % 3 <> 0 AND tag <> 'MISC'"), F.col("s")).otherwise(0)
    rows = sides(spark, sf_dir, ["ord", "start", "end", "tag"]).withColumn("part", part).drop("ord")
    sets = matching.strict_runs(rows, ["start", "end", "tag"], {"run1": "s", "run2": "part"})
    return metrics.with_scores(sets.groupBy("run", "tag").agg(*matching.flag_counts()), 6)


@query(_RUNS + " SELECT run, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM r GROUP BY run")
def mean_by_run(spark, sf_dir):
    return analysis.mean_by_run(_runs(spark, sf_dir), ["precision", "recall", "f1"]).select("run", *_six("precision", "recall", "f1"))


@query(_RUNS + " SELECT tag, max(CASE WHEN run = 'run1' THEN f1 END) AS run1, max(CASE WHEN run = 'run2' THEN f1 END) AS run2 FROM r GROUP BY tag")
def f1_pivot(spark, sf_dir):
    return analysis.metric_pivot(_runs(spark, sf_dir), "f1", ["run1", "run2"])


@query("SELECT event_type, " + ", ".join(f"round(coalesce(avg(CASE WHEN user_id % 3 = {i} THEN value END), 0), 6) AS b{i}" for i in range(3)) + " FROM events GROUP BY event_type", spans=False)
def bin_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("bin", F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")))
    return analysis.bin_pivot(rows, "event_type", ["b0", "b1", "b2"], "value").select("event_type", *_six("b0", "b1", "b2"))


@query(_BIO + _CHUNK.replace("g0.label AS gold, b.label AS pred", "CASE WHEN g0.label = 'O' THEN 'O' ELSE 'B-' || substring(g0.label, 3) END AS gold, CASE WHEN b.label = 'O' THEN 'O' ELSE 'B-' || substring(b.label, 3) END AS pred") + """, m AS (SELECT type, max((side = 'g')::INT) AS g, max((side = 'p')::INT) AS p FROM c GROUP BY doc_id, a, z, type)
SELECT type, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(p) AS BIGINT) AS n_found, CAST(sum(g * p) AS BIGINT) AS n_correct FROM m GROUP BY ROLLUP (type)""")
def conll_raw_tags(spark, sf_dir):
    bare = lambda c: F.when(F.col(c) == "O", F.col(c)).otherwise(F.substring(c, 3, 100)).alias(c)
    rows = _labels(spark, sf_dir).select("doc_id", "pos", bare("gold"), bare("pred"))
    return bio.chunk_scores(analysis.raw_labels(rows, ["gold", "pred"])).select("type", "n_gold", "n_found", "n_correct")


from glossa.plans import surface  # noqa: E402, F401  (registers the queries that build on these)
