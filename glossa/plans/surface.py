"""Queries of the operators that `catalogue` leaves: parsers, prompts, replies, logs, reports, grids; with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import inline, text
from glossa.functions.categories import CATEGORIES, valid_span
from glossa.operators import analysis, bio, matching
from glossa.plans import catalogue, derived, evaluate
from glossa.plans.annotate import SLOT, merge_parts, name_spans, reply_spans
from glossa.plans.derived import gold, system, table, tokens
from glossa.plans.registry import query
from glossa.sources import readers, writers


@query(r"""SELECT page_id, coalesce(string_split(trim(url), '/')[-1], '') AS last, replace(trim(regexp_replace(url, '^/+|/+$', '', 'g')), '/', '_') AS file_name FROM pages""", spans=False)
def url_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.last_part(F.col("url")).alias("last"), text.file_name_of(F.col("url")).alias("file_name"))


#: A type for three tokens in four, numbers for places in a part of them.
_KIND = "CASE pos % 4 WHEN 0 THEN 'FECHAS' WHEN 1 THEN 'HOSPITAL' WHEN 2 THEN 'URL_WEB' ELSE token END"
_CATEGORY = "CASE pos % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'LOCATION' ELSE 'CONTACT' END"
_IN = " OR ".join(f"""(category = '{c}' AND kind IN ({", ".join(f"'{t}'" for t in types)}))""" for c, types in CATEGORIES.items())


@query(f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, is_int, is_int AND ({_IN}) AS valid FROM (SELECT doc_id, pos, token, regexp_matches(token, '^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$') AS is_int, {_CATEGORY} AS category, {_KIND} AS kind FROM tok)""")
def valid_tags(spark, sf_dir):
    """Every token as the place of a span of some type and category."""
    token = F.col("token")
    valid = valid_span(F.expr(_CATEGORY), F.expr(_KIND), token, F.col("start").cast("string"))
    return tokens(spark, sf_dir).select("doc_id", "pos", text.is_int(token).alias("is_int"), valid.alias("valid"))


@query("SELECT event_id, CASE event_id % 13 WHEN 8 THEN 2 WHEN 11 THEN 2 WHEN 9 THEN 3 WHEN 10 THEN 4 ELSE 1 END AS pattern FROM events", spans=False)
def prompt_patterns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", inline.pattern_of(F.col("event_id") % 13).alias("pattern"))


@query("SELECT event_type, count(*) AS n, round(avg(value - 10), 6) AS mean FROM events WHERE value - 10 > 0 GROUP BY event_type", spans=False)
def positive_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.col("value") - 10)
    return analysis.positive(rows, "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT source || '/' || lang AS name, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, name", spans=False)
def listed_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.concat("source", F.lit("/"), "lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return analysis.listed(counts, "name")


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)
SELECT conv_id, turn, CAST(i AS INTEGER) AS line_no, rtrim(regexp_replace(trim(regexp_replace('Dra. ' || line || ' NCol Servicio de ' || turn, '(Dr\.?|Dra\.?|NCol|NºCol:.*|Servicio.*|\d+.*|\s+$)', '', 'g')), '\.$', '')) AS name FROM l""", spans=False)
def cleaned_answers(spark, sf_dir):
    """Every line of every turn as a name that a model gave, with a title and a department."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    answer = F.concat(F.lit("Dra. "), "line", F.lit(" NCol Servicio de "), F.col("turn").cast("string"))
    return lines.select("conv_id", "turn", "line_no", text.clean_answer(answer).alias("name"))


@query(r"""SELECT conv_id, turn, trim(string_split(text, chr(10))[-1]) AS doctor, trim('Anota: ' || text || '.') AS task, 'Eres ' || role || '. Tarea: Anota: ' || text || '.' AS prompt FROM conversations""", spans=False)
def labelled_replies(spark, sf_dir):
    """Prompts around whole turns, their tasks, and the last of the labelled lines of a reply."""
    prompt = F.replace(F.concat(F.lit("Eres "), "role", F.lit(f". Tarea: Anota: {SLOT}.")), F.lit(SLOT), F.col("text"))
    reply = F.concat(F.lit(" MEDICO: "), F.replace(F.col("text"), F.lit("\n"), F.lit("\nMEDICO: ")), F.lit("\nOTRO: x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.labelled_line(reply, "MEDICO").alias("doctor"), text.task_of(prompt).alias("task"), prompt.alias("prompt"))


@query("SELECT (SELECT count(*) FROM gold WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_gold, (SELECT count(*) FROM sys WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM gold)) AS n_sys")
def common_documents(spark, sf_dir):
    """The system has labelled documents alone; both sides keep what they have in common."""
    labelled = system(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    g, s = matching.common(gold(spark, sf_dir), labelled)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(g, "n_gold").crossJoin(count(s, "n_sys"))  # one row each


_LINES = """WITH n AS (SELECT doc_id, count(*) AS n, max(pos) AS z FROM tok GROUP BY doc_id), p AS (SELECT t.* FROM tok t JOIN n USING (doc_id) WHERE NOT (doc_id % 5 = 0 AND pos = z)),
g AS (SELECT * FROM tok WHERE doc_id IN (SELECT doc_id FROM labels)), gn AS (SELECT doc_id, count(*) AS n_gold FROM g GROUP BY doc_id), pn AS (SELECT doc_id, count(*) AS n_pred FROM p GROUP BY doc_id)"""


def _lines(spark, sf_dir):
    """Gold lines of labelled documents; predictions for all, each fifth document without its last line."""
    rows = tokens(spark, sf_dir, following=True).select("doc_id", "pos", "token", derived._tag().alias("label"), F.col("n_token").isNull().alias("last"))
    pred = rows.where("not (doc_id % 5 = 0 and last)")
    return bio.paired_lines(rows.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), pred)


@query(_LINES + """ SELECT doc_id, n_pred, n_gold, CASE WHEN n_gold IS NULL THEN 'no gold' ELSE 'line count' END AS error FROM pn LEFT JOIN gn USING (doc_id) WHERE n_gold IS NULL OR n_gold <> n_pred""")
def failed_lines(spark, sf_dir):
    return _lines(spark, sf_dir)[1]


@query(_LINES + """ SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, token, tag AS gold, tag AS pred FROM g JOIN gn USING (doc_id) JOIN pn USING (doc_id) WHERE n_gold = n_pred""")
def paired_lines(spark, sf_dir):
    return _lines(spark, sf_dir)[0]


@query(catalogue._ANALYZER + r""", c AS (SELECT tag, count(*) FILTER (WHERE kind = 'fn') AS fn FROM a GROUP BY tag),
m AS (SELECT g.doc_id, g.tag, length(d.text) - length(replace(replace(d.text, '.', ''), chr(10), '')) AS n FROM gold g JOIN documents d USING (doc_id)),
k AS (SELECT tag, sum(n) AS per_span FROM m GROUP BY tag), q AS (SELECT tag, sum(n) AS per_doc FROM (SELECT DISTINCT doc_id, tag, n FROM m) GROUP BY tag)
SELECT tag, fn, round(coalesce(fn / nullif(per_span, 0), 0), 4) AS leak_legacy, round(coalesce(fn / nullif(per_doc, 0), 0), 4) AS leak FROM c LEFT JOIN k USING (tag) LEFT JOIN q USING (tag)""")
def leaks_by_tag(spark, sf_dir):
    """Missed spans a sentence, with both denominators."""
    tags, _ = evaluate.analysed(gold(spark, sf_dir), system(spark, sf_dir).withColumn("system", F.lit("sys")), table(spark, sf_dir, "documents"))
    return tags.select("tag", "fn", "leak_legacy", "leak")


@query("SELECT doc_id, tag, text AS value, count(*) AS n FROM gold GROUP BY ALL")
def listed_values(spark, sf_dir):
    """How often each value stands in the maps of replies."""
    lists = gold(spark, sf_dir).groupBy("doc_id", "tag").agg(F.collect_list("text").alias("values"))
    maps = lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("entities"))
    return readers.entity_values(maps, ["doc_id"])


@query("""WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS tagged_text FROM conversations GROUP BY conv_id),
v AS (SELECT DISTINCT conv_id, role, w FROM (SELECT conv_id, role, unnest(string_split(text, ' ')) AS w FROM conversations)), s AS (SELECT conv_id, role, string_agg(w, ' ' ORDER BY w) AS w FROM v GROUP BY ALL)
SELECT conv_id, tagged_text, (SELECT string_agg(role || '=' || w, '|' ORDER BY role) FROM s WHERE s.conv_id = t.conv_id) AS entities FROM t""", spans=False)
def merged_parts(spark, sf_dir):
    """Turns as parts of one reply: texts joined in order, distinct words by role."""
    words = F.create_map("role", F.split("text", " "))
    parts = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("part"), F.col("text").alias("tagged_text"), words.alias("entities"))
    out = merge_parts(parts, ["conv_id"])
    listed = F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], " ")))
    return out.select("conv_id", "tagged_text", F.array_join(listed, "|").alias("entities"))


def _systems(spark, sf_dir):
    """The system, and the gold spans as one more."""
    typed = lambda df: df.withColumn("category", F.col("tag")).withColumn("type", F.col("tag"))
    g, s = typed(gold(spark, sf_dir)), typed(system(spark, sf_dir))
    return g, s.withColumn("system", F.lit("sys")).unionByName(g.withColumn("system", F.lit("gold")))


@query(catalogue._STRICT + f""", c AS (SELECT 'sys' AS system, {catalogue._COUNTS} FROM f UNION ALL SELECT 'gold', count(*), 0, 0 FROM (SELECT DISTINCT doc_id, s, e, tag FROM gold WHERE doc_id IN (SELECT doc_id FROM gold)))
SELECT system, tp, fp, fn, {catalogue._SCORES} FROM c""")
def official_systems(spark, sf_dir):
    """Two systems against one gold set in one plan."""
    g, s = _systems(spark, sf_dir)
    return evaluate.official_micro(evaluate.official(g, s, "ner")).select("system", "tp", "fp", "fn", *catalogue._six("precision", "recall", "f1"))


def _grid_counts(columns: str) -> str:
    return f"""SELECT config, count(*) FILTER (WHERE g = 1 AND y = 1) AS tp, count(*) FILTER (WHERE g = 0) AS fp, count(*) FILTER (WHERE y = 0) AS fn FROM (
  SELECT config, doc_id, {columns}, max(g) AS g, max(y) AS y FROM (SELECT config, doc_id, {columns}, 1 AS g, 0 AS y FROM gold JOIN gd USING (doc_id), k UNION ALL SELECT config, doc_id, {columns}, 0, 1 FROM r) GROUP BY ALL) GROUP BY config"""


@query(f"""WITH k AS (SELECT unnest(['prompt1', 'prompt2']) AS config), gd AS (SELECT DISTINCT doc_id FROM gold),
c0 AS (SELECT 'prompt1' AS config, doc_id, s, e, tag FROM sys UNION ALL SELECT 'prompt2', doc_id, s, e, tag FROM sys WHERE doc_id IN (SELECT doc_id FROM labels)),
r0 AS (SELECT * FROM c0 UNION ALL SELECT config, doc_id, s, e, 'MISC' FROM gold, k WHERE NOT EXISTS (SELECT 1 FROM c0 WHERE c0.config = k.config AND c0.doc_id = gold.doc_id)), r AS (SELECT r0.* FROM r0 JOIN gd USING (doc_id)),
n AS (SELECT 'ner' AS subtrack, * FROM ({_grid_counts("s, e, tag")}) UNION ALL SELECT 'spans', * FROM ({_grid_counts("s, e")}))
SELECT 'sys' AS system, config, subtrack, tp, fp, fn, {catalogue._SCORES} FROM n""")
def configuration_grid(spark, sf_dir):
    """Two configurations, one with labelled documents alone, filled from a fallback whose tags are wrong."""
    typed = lambda df: df.withColumn("category", F.col("tag")).withColumn("type", F.col("tag"))
    s = typed(system(spark, sf_dir)).withColumn("system", F.lit("sys"))
    part = s.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    configs = s.withColumn("config", F.lit("prompt1")).unionByName(part.withColumn("config", F.lit("prompt2")))
    fallback = typed(gold(spark, sf_dir).withColumn("tag", F.lit("MISC")))
    out = evaluate.grid(typed(gold(spark, sf_dir)), configs, fallback, table(spark, sf_dir, "documents"), ("ner", "spans"))
    return out.select("system", "config", "subtrack", "tp", "fp", "fn", *catalogue._six("precision", "recall", "f1"))


@query(r"""WITH h AS (SELECT page_id, replace(replace(html, '<p>', '<P>'), '</p>', '</P>') AS h FROM pages),
n AS (SELECT page_id, len(regexp_extract_all(h, '(?s)<P>.*?</P>')) AS correct, len(regexp_extract_all(regexp_replace(h, '(?s)<P>.*?</P>', ' ', 'g'), '<+')) AS wrong FROM h)
SELECT *, round(CASE WHEN correct + wrong = 0 THEN 1 ELSE correct / (correct + wrong / 2) END, 6) AS quality FROM n""", spans=False)
def paragraph_tag_quality(spark, sf_dir):
    """Paragraphs as the only well-formed tags of whole pages."""
    html = F.replace(F.replace("html", F.lit("<p>"), F.lit("<P>")), F.lit("</p>"), F.lit("</P>"))
    correct, wrong = inline.tag_counts_of(F.coalesce(html, F.lit("")), 2)
    rows = table(spark, sf_dir, "pages").select("page_id", correct.alias("correct"), wrong.alias("wrong"))
    return rows.select("*", F.round(analysis.tag_quality(F.col("correct"), F.col("wrong")), 6).alias("quality"))


@query(r"""WITH p AS (SELECT page_id, unnest(string_split(html, '<')) AS piece, generate_subscripts(string_split(html, '<'), 1) AS i FROM pages),
l AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, lead(piece, 1, '') OVER (PARTITION BY page_id ORDER BY i) AS nx, max(i) OVER (PARTITION BY page_id) AS z FROM p)
SELECT page_id, CAST(i AS INTEGER) AS ord, CAST(k - 1 AS BIGINT) AS start, replace(substring(html, CAST(greatest(k - 20, 1) AS BIGINT), CAST(least(k - 1, 20) AS BIGINT)) || substring(html, CAST(k AS BIGINT), 21), chr(10), ' ') AS context FROM l JOIN pages USING (page_id) WHERE i < z""", spans=False)
def stray_brackets(spark, sf_dir):
    """Every opening bracket of pages, with 20 characters around it: none is part of a tag in triple brackets."""
    make = lambda html: [(i, a, c) for i, (a, c) in enumerate(inline.compliance(html, 1)[1], 1)]
    return inline.rows_from(table(spark, sf_dir, "pages"), ["html"], ["page_id"], make, "ord int, start long, context string")


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain, CAST(len(regexp_extract_all(html, '<[^>]*>')) AS INTEGER) AS n_tags FROM pages", spans=False)
def pages_untagged(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", inline.without_tags(html).alias("plain"), F.regexp_count(html, F.lit(inline._TAG.pattern)).alias("n_tags"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents", spans=False)
def texts_without_marks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.without_marks("text").alias("plain"))


_EVENT_BLOCK = "'2024-05-01 10:00:00,000 - INFO - Procesando archivo: f' || user_id || '.xml' || chr(10) || 'Modelo: m' || (user_id % 4) || chr(10) || 'Directorio de salida: out/prompt' || (event_id % 6) || chr(10) || 'Respuesta cruda del modelo: ' || chr(10) || props || chr(10) || '2024-05-01 10:00:01,000 - INFO - Resumen final de entidades encontradas:' || chr(10) || CASE WHEN event_type = 'error' THEN 'Error parseando JSON' ELSE '' END || chr(10)"


@query("""SELECT CAST(user_id AS VARCHAR) AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS pos, 'm' || (user_id % 4) AS model, 'prompt' || (event_id % 6) AS prompt, 'f' || user_id || '.xml' AS file, trim(props) AS reply,
  event_type = 'error' AS has_error, CASE WHEN event_type = 'error' THEN CASE WHEN json_valid(trim(props)) THEN 'raw' ELSE 'malformed' END END AS error_kind FROM events""", spans=False)
def log_blocks(spark, sf_dir):
    """Events written as a log a user, and read back block by block."""
    block = F.expr(_EVENT_BLOCK.replace("chr(10)", "'\\n'"))
    blocks = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), "event_id", block.alias("block"))
    logs = blocks.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "block"))), lambda x: x["block"]), "").alias("content"))
    return readers.blocks_of(logs)


@query(r"""SELECT event_id, value AS precision, value / 2 AS recall, value / 4 AS f1, '0%=' || user_id || ' 0-10%=' || (event_id % 7) AS bins FROM events""", spans=False)
def report_numbers(spark, sf_dir):
    """Numbers printed in reports and read back."""
    number = lambda n: (F.col("value") / n).cast("string")
    report = F.concat(F.lit("Precision: "), number(1), F.lit("\nRecall:    "), number(2), F.lit("\nF1-score: "), number(4), F.lit("\n      0%:   "), F.col("user_id").cast("string"), F.lit(" (1.0%)\n   0-10%:    "), (F.col("event_id") % 7).cast("string"), F.lit(" (2.0%)\n"))
    read = table(spark, sf_dir, "events").select("event_id", readers.report_numbers(report).alias("r")).select("event_id", "r.*")
    listed = F.transform(F.map_entries("bins"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return read.withColumn("bins", F.array_join(listed, " "))


@query("""SELECT doc_id, string_agg(token || ' ' || CASE WHEN pos % 7 IN (0, 1) THEN 'B-' || tag ELSE 'O' END, chr(10) ORDER BY pos) || chr(10) AS value FROM tok GROUP BY doc_id""")
def bio_files(spark, sf_dir):
    """A text a document, as its BIO file holds it."""
    label = F.when(F.col("pos") % 7 < 2, F.concat(F.lit("B-"), derived._tag())).otherwise(F.lit("O"))
    return writers.bio_text(tokens(spark, sf_dir).withColumn("label", label))


@query("""WITH v AS (SELECT doc_id, tag, text, count(*) AS k, min(ord) AS o FROM gold WHERE tag = 'PER' GROUP BY ALL), d AS (SELECT v.*, string_split(documents.text, v.text) AS p FROM v JOIN documents USING (doc_id)),
n AS (SELECT doc_id, text, k, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS z FROM d),
c AS (SELECT doc_id, text, k, i, z, sum(length(piece)) OVER (PARTITION BY doc_id, text ORDER BY i) + (i - 1) * length(text) AS s FROM n)
SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(s + length(text) AS BIGINT) AS "end", text FROM c WHERE i < z AND i <= k""")
def placed_values(spark, sf_dir):
    """Listed values of replies at their first occurrences, as many as they are listed."""
    per = gold(spark, sf_dir).where("tag = 'PER'")
    lists = per.groupBy("doc_id").agg(F.create_map(F.lit("PER"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])).alias("entities"))
    replies = lists.select(F.lit("sys").alias("system"), "doc_id", F.lit("").alias("tagged_text"), "entities")
    return reply_spans(replies, table(spark, sf_dir, "documents")).where("mode = 'entities'").select("doc_id", "start", "end", "text")


@query(r"""WITH f AS (SELECT doc_id, text, regexp_replace(lower(strip_accents(text)), 'the', chr(1) || 'the' || chr(1), 'g') AS m FROM documents),
p AS (SELECT doc_id, text, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM f),
s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ord, CAST(e - 3 AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", 'NOMBRE_PERSONAL_SANITARIO' AS tag, substring(text, CAST(e - 2 AS BIGINT), 3) AS text FROM s WHERE i % 2 = 0""", spans=False)
def named_spans(spark, sf_dir):
    """A name reply of three lines placed in whole texts: two lines are empty once cleaned."""
    reply = F.lit("NOMBRE_PACIENTE: None\nAPELLIDOS_PACIENTE: 12\nMEDICO: Dr. the.")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace(reply, "None", "").alias("reply"))
    return name_spans(docs, ["doc_id"])


@query(r"""WITH f AS (SELECT doc_id, translate(text, '<>', '()') AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split(text, 'the')) AS piece, generate_subscripts(string_split(text, 'the'), 1) AS i, len(string_split(text, 'the')) AS z FROM f),
s AS (SELECT *, sum(length(piece) + 3) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS ord, CAST(e - 3 AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", 'THE' AS tag, 'the' AS text FROM s WHERE i < z""", spans=False)
def tagged_spans(spark, sf_dir):
    """Inline tags of stored replies placed in the whole original texts: each at its own place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "<>", "()").alias("text"))
    none = F.create_map().cast("map<string,array<string>>").alias("entities")
    replies = docs.select(F.lit("sys").alias("system"), "doc_id", F.replace("text", F.lit("the"), F.lit("<THE>the</THE>")).alias("tagged_text"), none)
    return reply_spans(replies, docs).where("mode = 'tagged'").select("doc_id", "ord", "start", "end", "tag", "text")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN false ELSE json_valid(props) END AS parsed, CASE WHEN event_id % 4 < 3 AND json_valid(props) THEN CAST(len(json_keys(props)) AS INTEGER) END AS n_names FROM events""", spans=False)
def salvaged_replies(spark, sf_dir):
    """Objects of replies: as they are, amid other text, behind a fence, and cut off."""
    props = F.col("props")
    reply = F.when(F.col("event_id") % 4 == 0, props).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here: "), props, F.lit(" Bye."))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(F.substring(props, 2, 1 << 20))
    make = lambda text: [(found is not None, None if found is None else len(found)) for found in [inline.parse_reply(text)]]
    return inline.rows_from(table(spark, sf_dir, "events").select("event_id", reply.alias("reply")), ["reply"], ["event_id"], make, "parsed boolean, n_names int")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp, upper(event_type) AS level, 'user ' || user_id AS message FROM events", spans=False)
def log_stamps(spark, sf_dir):
    """Events written as log lines, and read back."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    line = F.concat(stamp, F.lit(" - "), F.upper("event_type"), F.lit(" - user "), F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line")).where(readers.is_log_line(F.col("line")))
    read = rows.select("event_id", *readers.log_fields(F.col("line")))
    return read.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"), "level", "message")
