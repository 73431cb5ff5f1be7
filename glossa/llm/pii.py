"""Information-theoretic sanitisation of personal data, with SQL functions alone.

Personal data (e-mail and IP addresses, card and phone numbers) are the protected
entities.  Over the whole corpus it is counted in how many different contexts (the words
within REACH words of an entity, in its line) a term (a run of letters and digits, of two or more) stands beside an entity, c(t, e),
and in how many contexts the term occurs at all, c(t).  What remains unknown of e once t
is read is IC(e) - PMI(t; e) = log2(c(t) / c(t, e)) bits.  Terms that leave at most
REMOVE_BITS are removed, terms that leave at most GENERALISE_BITS are generalised,
wherever they occur: they would lead back to an entity that is masked.  Contexts that are
copies of each other count once, for c(t, e) and c(t) alike, and a term needs
LEAST_CONTEXTS of them.  A line in which a term stands beside no entity is a context of its
own, whatever the document, and counts once however often it is repeated; so repeating
every document changes nothing.

A generalised term is replaced by a broader one: of the terms that stand in at least
BROADER of the term's different lines, and in more lines than it, the one with the fewest
(of equals the first in order); by [TERM] where there is none that may be shown.

The terms met beside entities in enough contexts, and those found to disclose, are sent
to every task while they are at most MAX_BROADCAST_TERMS; more are joined by shuffles.

Defined cases: a null text is empty and has no spans; repeated rows are returned each and
count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table, written
from glossa.llm.spans import apart, counted, hits, listed, replaced, tagged

KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[REMOVED]", "[TERM]")
REACH = 12
LEAST_CONTEXTS = 2
REMOVE_BITS, GENERALISE_BITS = 1.0, 2.0
MAX_BROADCAST_TERMS = 20_000
BROADER = 0.8
#: One line in so many is enough to tell that a common term discloses nothing.
SLICES = 64

#: Terms: runs of two letters or digits and more; a single one cannot tell whom a text is about.
_TERM = r"[\p{L}\p{N}]{2,}+"


def base_hits(text: Column) -> list[Column]:
    """The valid matches of each of the first four kinds."""

    def digits(x: Column) -> Column:
        return F.regexp_replace(x["found"], r"[^0-9]", "")

    email = hits(text, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", F.contains(text, F.lit("@")))
    ip = hits(text, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")))
    small = lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3) & (F.regexp_replace(part, "^0+(?=[0-9])", "").substr(1, 3).cast("int") <= 255)
    ip = F.filter(ip, lambda x: F.forall(F.split(x["found"], r"\."), small))
    card = hits(text, r"[0-9](?:[\x20-]?[0-9])++", F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")))
    card = F.filter(card, lambda x: F.length(digits(x)).between(12, 19) & F.call_function("luhn_check", digits(x)))
    phone = hits(text, r"\+[0-9][\x20().0-9-]+[0-9]", F.rlike(text, F.lit(r"\+[0-9]")))
    phone = F.filter(phone, lambda x: F.length(digits(x)).between(9, 15))
    return [email, ip, card, phone]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(_TERM), F.lit(0))


def _entities(text: Column) -> Column:
    """Each entity in a text with its place."""

    def keyed(kind: str, matches: Column) -> Column:
        same = F.lower if kind in ("email", "ip") else lambda x: F.regexp_replace(x, "[^0-9]", "")
        return F.transform(matches, lambda m: F.struct(F.concat(F.lit(kind + ":"), same(m["found"])).alias("entity"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*(keyed(kind, x) for kind, x in zip(KINDS, base_hits(text), strict=False)))


def _beside(docs: DataFrame) -> DataFrame:
    """A row for each entity of each document: the line (its hash), the place in it, the terms beside and the context."""
    spans = _rows(docs).select("text", F.explode(_entities(F.col("text"))).alias("m")).select("text", "m.*")
    before = F.substring_index(F.substring("text", 1, F.col("start")), "\n", -1)
    after = F.substring_index(F.col("text").substr(F.col("end") + 1, F.length("text")), "\n", 1)
    left = F.reverse(F.slice(F.reverse(_words(F.substring_index(before, " ", -2 * REACH))), 1, REACH))
    right = F.slice(_words(F.substring_index(after, " ", 2 * REACH)), 1, REACH)
    line = F.xxhash64(F.concat(before, F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")), after))
    beside = spans.select("entity", line.alias("line"), F.length(before).alias("place"), left.alias("left"), right.alias("right"))
    return beside.select("entity", "line", "place", F.array_distinct(F.concat("left", "right")).alias("terms"), F.xxhash64("left", "right").alias("context"))


def contexts(docs: DataFrame) -> DataFrame:
    """entity and term of each different context: one row each."""
    return _contexts(_beside(docs))


def _contexts(beside: DataFrame) -> DataFrame:
    return beside.select("entity", "context", F.explode("terms").alias("term")).distinct()


def _join_terms(rows: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    return rows.join(F.broadcast(terms) if n_terms <= MAX_BROADCAST_TERMS else terms, "term")


def _lines(docs: DataFrame, slices: int = 1) -> DataFrame:
    """Each line of the texts that has a term, and its hash; of `slices` parts of all different lines one."""
    lines = _rows(docs).select(F.explode(F.split("text", "\n")).alias("text")).select("text", F.xxhash64("text").alias("line"))
    return lines.where(F.pmod("line", F.lit(slices)) == 0) if slices > 1 else lines


def _totals(docs: DataFrame, beside: DataFrame, terms: DataFrame, n_terms: int, slices: int = 1) -> DataFrame:
    """term and total: c(t), or what one of `slices` parts of all lines holds of it."""
    words = _lines(docs, slices).select("line", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    words = _join_terms(words, terms, n_terms).select("term", "line")
    # a term beside several entities of a line belongs to the context of the first
    first = F.struct("place", "entity", "context")
    beside = beside.select("line", first.alias("first"), F.explode("terms").alias("term")).where(F.pmod("line", F.lit(slices)) == 0)
    beside = _join_terms(beside, terms, n_terms).select("term", "line", "first")
    both = words.withColumn("first", F.lit(None).cast(beside.schema["first"].dataType)).unionByName(beside)
    units = both.groupBy("term", "line").agg(F.min("first").alias("first"))
    unit = F.when(F.col("first").isNotNull(), F.xxhash64("first.entity", "first.context")).otherwise(F.col("line"))
    return units.select("term", unit.alias("unit")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("total"))


def disclosing_terms(docs: DataFrame, least: int = LEAST_CONTEXTS, remove: float = REMOVE_BITS, generalise: float = GENERALISE_BITS) -> DataFrame:
    """term and bits: the least that any entity keeps to itself once the term is read."""
    own = written(_beside(docs), "beside")
    beside = _contexts(own).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least)
    near = written(beside.groupBy("term").agg(F.max("together").alias("together")), "terms")
    n = near.count()
    if not n:  # no term stands beside any entity often enough
        return near.select("term", F.lit(0.0).alias("bits"))
    bits = F.greatest(F.lit(0.0), F.log2(F.col("total") / F.col("together")))
    # a part of the lines bounds c(t) from below, and leaves few terms for all of them
    some = _totals(docs, own, near.select("term"), n, SLICES)
    near = written(near.join(some, "term", "left").withColumn("total", F.coalesce("total", F.lit(1))).where(bits <= generalise).select("term", "together"), "rare")
    n = near.count()
    if not n:
        return near.select("term", F.lit(0.0).alias("bits"))
    return _join_terms(near, _totals(docs, own, near.select("term"), n), n).select("term", bits.alias("bits")).where(F.col("bits") <= generalise)


def broader_terms(docs: DataFrame, terms: DataFrame, share: float = BROADER) -> DataFrame:
    """term and broader, of the disclosing terms that have one that does not disclose."""
    n = terms.count()
    lines = _lines(docs).select("line", F.array_distinct(_words(F.col("text"))).alias("words"))
    own = lines.select("line", "words", F.explode("words").alias("term"))
    own = written(_join_terms(own, terms.select("term"), n).groupBy("term", "line").agg(F.first("words").alias("words")), "lines")
    size = own.groupBy("term").agg(F.count(F.lit(1)).alias("size"))
    beside = own.select("term", F.explode("words").alias("broader")).groupBy("term", "broader").agg(F.count(F.lit(1)).alias("together"))
    met = beside.join(size, "term").where(F.col("together") >= share * F.col("size"))
    met = written(met.join(terms.select(F.col("term").alias("broader")), "broader", "left_anti").select("term", "broader", "size"), "met")
    known = met.select(F.col("broader").alias("term")).distinct()
    each = lines.select("line", F.explode("words").alias("term"))
    lines_of = _join_terms(each, known, known.count()).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("lines")).withColumnRenamed("term", "broader")
    found = met.join(lines_of, "broader").where(F.col("lines") > F.col("size"))
    return found.groupBy("term").agg(F.min(F.struct("lines", "broader")).alias("b")).select("term", F.col("b.broader").alias("broader"))


def find(docs: DataFrame, remove: float = REMOVE_BITS, most_in_plan: int = MAX_BROADCAST_TERMS, terms: DataFrame | None = None, **limits) -> DataFrame:
    """doc_id, text, base and spans: sorted arrays of struct<start, kind, end>, kind counting KINDS; names: broader terms, by term.

    terms: what to look for (term, bits, broader), if it is known.
    """
    terms = written(disclosing_terms(docs, remove=remove, **limits), "disclosing") if terms is None else terms
    if "broader" not in terms.columns:
        terms = terms.withColumn("broader", F.lit(None).cast("string"))
    n = terms.count()
    rows = _rows(docs)
    none, unnamed = F.array().cast("array<string>"), F.array().cast("array<struct<term:string,broader:string>>")
    surface = F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)))
    if not n:
        rows = rows.select("*", none.alias("gone"), none.alias("vague"), unnamed.alias("names"))
    elif n <= most_in_plan:
        small = terms.collect()  # at most MAX_BROADCAST_TERMS, looked up in hash sets
        gone = [t.term for t in small if t.bits <= remove]
        rows = rows.withColumn("here", F.filter(surface, lambda w: F.lower(w).isin([t.term for t in small])))
        rows = rows.withColumn("gone", F.filter("here", lambda w: F.lower(w).isin(gone)) if gone else none)
        named = [F.struct(F.lit(t.term).alias("term"), F.lit(t.broader).alias("broader")) for t in small if t.broader]
        names = F.array(*named) if named else unnamed
        rows = rows.select("doc_id", "text", "gone", F.array_except("here", "gone").alias("vague"), names.alias("names"))
    else:
        key = F.struct("doc_id", F.sha2("text", 256))
        met = rows.select(key.alias("key"), F.explode(surface).alias("word")).withColumn("term", F.lower("word")).join(terms, "term")
        sets = [F.collect_set(F.when(pick, F.col("word"))).alias(c) for c, pick in (("gone", F.col("bits") <= remove), ("vague", F.col("bits") > remove))]
        met = met.groupBy("key").agg(*sets, F.collect_set(F.when(F.col("broader").isNotNull(), F.struct("term", "broader"))).alias("names"))
        rows = rows.withColumn("key", key).join(met, "key", "left").select("doc_id", "text", *(F.coalesce(c, e).alias(c) for c, e in (("gone", none), ("vague", none), ("names", unnamed))))
    text = F.col("text")
    base = F.array_sort(F.concat(*(tagged(k, x) for k, x in enumerate(base_hits(text)))))
    rows = rows.withColumn("base", base)
    for k, name in ((4, "gone"), (5, "vague")):
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(name), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        rows = rows.withColumn(name, apart(tagged(k, hits(text, pattern, F.size(name) > 0)), F.col("base")) if n else F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", "gone", "vague")).alias("spans"), "names")


def sanitise(docs: DataFrame, share: float = BROADER, **limits) -> DataFrame:
    """doc_id and the text with personal data masked, disclosing terms removed or replaced by broader ones."""
    terms = written(disclosing_terms(docs, **{k: v for k, v in limits.items() if k != "most_in_plan"}), "disclosing")
    if terms.limit(1).count():
        terms = written(terms.join(broader_terms(docs, terms, share), "term", "left"), "broader")
    found = find(docs, terms=terms, **limits)

    def mark(x: Column) -> Column:
        word = F.lower(F.col("text").substr(x["start"] + 1, x["end"] - x["start"]))
        name = F.element_at(F.filter("names", lambda y: y["term"] == word), 1)["broader"]
        fixed = F.element_at(F.array(*map(F.lit, MARKS)), x["kind"] + 1)
        return F.when((x["kind"] == 5) & name.isNotNull(), F.concat(F.lit("["), name, F.lit("]"))).otherwise(fixed)

    return found.select("doc_id", replaced(F.col("text"), F.col("spans"), mark).alias("text"))


def report(docs: DataFrame, **limits) -> DataFrame:
    """One row a document: spans of each base kind, a digest of those, and all spans."""
    counts = [counted(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return find(docs, **limits).select("doc_id", *counts, F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: RE2 has no look-around for the terms' places; the tests hold the spans against brute force.
SQL = None
