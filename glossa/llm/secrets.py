"""Secret scans with SQL functions alone: patterns, and entropy in sliding windows.

Candidate strings are runs of at least WINDOW characters of a key alphabet.  A window of WINDOW characters slides over each;
the counts of its characters, one for each different character of the candidate, are kept
as it moves (one leaves, one enters), and with them the sum of c * log2(c), so
H = log2(WINDOW) - sum / WINDOW.  A candidate is a secret if a window reaches the
threshold of its character class and nothing on the allow list fits the whole of it.
Candidates of letters of one case (but for the first) may be long words.  They are secrets only
if their letters also are rarer than those of words: SURPRISE bits a letter and more, by a
fixed table of how often letters are used.  Runs of capitals and marks alone are no
secrets.  Every document is judged alone: there is no shuffle.

Defined cases: a null text is empty and has no spans; repeated rows are returned each;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.shared import table
from glossa.llm.spans import apart, counted, hits, listed, once, replaced, tagged

KINDS = ("assign", "access", "hex", "entropy")
MARKS = tuple(f"[{k.upper()}]" for k in KINDS)
WINDOW = 16
#: Character class: what a candidate of it looks like, and the bits a character from which a window is random.
ONE_CASE = r"^([A-Z]?[a-z]+|[A-Z]+)$"
CLASSES = (
    ("letters of one case", ONE_CASE, 3.1),
    ("hex", r"^[0-9a-fA-F]+$", 2.9),
    ("letters", r"^[A-Za-z]+$", 3.6),
    ("letters and digits", r"^[0-9A-Za-z]+$", 3.5),
    ("base64", r"^[0-9A-Za-z+/=_-]+$", 3.6),
)
#: Candidates that are no secrets, each to fit as a whole: numbers, UUIDs, words and short numbers joined by marks or by
#: capitals, and alphabets in order or samples with no more than a few other characters.
ALLOWED = (
    r"^[0-9=+/_-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]{0,15}([-_/+=][A-Za-z]{1,15}|[-_/+=][0-9]{1,4})+$",
    r"^[A-Z]?[a-z]+([A-Z][a-z]{2,})*[A-Z]?[0-9]{0,4}$",
    r"(?i)^.{0,4}(0123456789|abcdefgh|qwertyui).{0,12}$",
    r"(?i)^.{0,8}(example|sample|placeholder|x{6}).{0,12}$",
)
#: Of these, what letters of one case may fit.
SAMPLES = "|".join(ALLOWED[-2:]).replace("|(?i)", "|")
# Half bits of surprise of the letters a to z, rounded, by the shares of letters in English prose.
SURPRISES = "7CA96BB88FE9B87BF887ADBFBF"
#: Bits of surprise a letter, in the mean, from which letters of one case are no word.
SURPRISE = 4.6
_KEY = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"


def base_hits(text: Column) -> list[Column]:
    """The valid matches of each of the first three kinds."""
    value = r"[A-Za-z0-9+/_.=-]"
    assign = hits(text, rf"""(?:{_KEY})["']?\x20*+[:=]\x20*+["']?{value}++""", F.rlike(text, F.lit(_KEY)))
    assign = F.filter(assign, lambda x: F.length(F.regexp_extract(x["found"], rf"""^(?:{_KEY})["']?\x20*[:=]\x20*["']?({value}+)$""", 1)) >= 6)
    access = hits(text, r"AKIA[A-Z0-9]++", F.contains(text, F.lit("AKIA")))
    access = F.filter(access, lambda x: F.length(x["found"]) >= 20)
    hexes = hits(text, r"(?<![0-9a-f])[0-9a-f]{24,}+", F.rlike(text, F.lit(r"[0-9a-f]{24}")))
    return [assign, access, hexes]


def most_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of an ASCII string; null if it is shorter than one."""

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def slide(x: Column) -> Column:
        codes, kinds = x["codes"], x["kinds"]

        def step(state: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))

            def state_after(m: Column) -> Column:
                entering = F.element_at(state["counts"], m["new"])
                leaving = F.when(m["old"] > 0, F.element_at(state["counts"], F.greatest(m["old"], F.lit(1)))).otherwise(F.lit(0))
                change = term(entering + 1) - term(entering) - F.when(m["old"] > 0, term(leaving) - term(leaving - 1)).otherwise(0.0)
                total = F.when(m["new"] == m["old"], state["total"]).otherwise(state["total"] + change)
                bits = F.when(i >= window, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(-1.0))
                counts = F.transform(state["counts"], lambda c, j: c + F.when(j + 1 == m["new"], 1).otherwise(0) - F.when(j + 1 == m["old"], 1).otherwise(0))
                return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(state["best"], bits).alias("best"))

            return once(F.struct(new.alias("new"), old.alias("old")), state_after)

        start = F.struct(F.array_repeat(F.lit(0), kinds).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step)["best"]

    def numbered(chars: Column) -> Column:
        """Each character as its number among the different ones."""
        return once(F.array_distinct(chars), lambda own: F.struct(F.transform(chars, lambda c: F.array_position(own, c).cast("int")).alias("codes"), F.size(own).alias("kinds")))

    return F.when(F.length(s) >= window, F.round(once(once(F.split(s, ""), numbered), slide), 9))


def surprise(s: Column) -> Column:
    """Mean bits of surprise of the letters of a string of letters."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    half_bits = F.filter(F.split(F.translate(F.lower(s), alphabet, SURPRISES), ""), lambda c: c != "")
    total = F.aggregate(half_bits, F.lit(0).cast("bigint"), lambda done, c: done + F.conv(c, 16, 10).cast("bigint"))
    return total / 2.0 / F.length(s)


def entropy_hits(text: Column, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> Column:
    run = r"[A-Za-z0-9+/_=-]"
    begin = rf"(?<!{run})"
    found = hits(text, rf"{begin}{run}{{{window},}}+", F.rlike(text, F.lit(rf"{begin}{run}{{{window}}}")))

    def secret(x: Column) -> Column:
        s = x["found"]
        needed = F.coalesce(*(F.when(F.rlike(s, F.lit(p)), F.lit(bits)) for _, p, bits in classes))
        one_case = F.rlike(s, F.lit(ONE_CASE))
        fine = ~F.rlike(s, F.lit("[0-9a-z]"))
        for p in allowed:
            fine = fine | F.rlike(s, F.lit(p))
        fine = F.when(one_case, F.rlike(s, F.lit(SAMPLES)) | (surprise(s) < SURPRISE)).otherwise(fine)
        return F.when(fine, F.lit(False)).otherwise(most_entropy(s, window) >= needed)

    return F.filter(found, secret)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans: sorted arrays of struct<start, kind, end>, kind counting KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    text = F.col("text")
    rows = rows.withColumn("base", F.array_sort(F.concat(*(tagged(k, x) for k, x in enumerate(base_hits(text))))))
    return rows.withColumn("spans", F.array_sort(F.concat("base", apart(tagged(3, entropy_hits(text)), F.col("base")))))


def mask(docs: DataFrame) -> DataFrame:
    """doc_id and the text with secrets masked."""
    return find(docs).select("doc_id", replaced(F.col("text"), F.col("spans"), lambda x: F.element_at(F.array(*map(F.lit, MARKS)), x["kind"] + 1)).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: spans of each base kind, a digest of those, and all spans."""
    counts = [counted(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return find(docs).select("doc_id", *counts, F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.col("spans"), KINDS).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: Entropy in windows has no practical SQL; the tests hold the spans against brute force.
SQL = None
