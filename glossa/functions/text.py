"""Normalisation and small text functions, as columns where SQL has them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Spanish vowels with acute accents, and the same without.
ACCENTED, PLAIN = "áéíóúÁÉÍÓÚ", "aeiouAEIOU"

#: Spanish function words that carry no content.
STOP_WORDS = (
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo",
    "como", "más", "pero", "sus", "le", "ya", "o", "este", "sí", "porque", "esta", "entre", "cuando", "muy", "sin", "sobre",
    "también", "me", "hasta", "hay", "donde", "quien", "desde", "todo", "nos", "durante", "todos", "uno", "les", "ni",
    "contra", "otros", "ese", "eso", "ante", "ellos", "e", "esto", "mí", "antes", "algunos", "qué", "unos", "yo", "otro",
)


def without_accents(text: Column) -> Column:
    """Ten accented vowels replaced; ñ and ü stay."""
    return F.translate(text, ACCENTED, PLAIN)


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks (SQL has no normal forms)."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def _ascii_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def error_text(text: Column) -> Column:
    """Lower case, punctuation removed, folded to ASCII, trimmed."""
    return F.trim(_ascii_fold(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")))


def content_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two characters or more that are no stop words (as written: case counts)."""
    words = F.split(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def significant(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Does anything remain once stop words and marks are gone?"""
    return F.size(content_tokens(text, stop_words)) > 0


def read_stop_words(path: str) -> tuple[str, ...]:
    """The stop words of a list with one a line; what follows a # is no part of it."""
    with open(path, encoding="utf-8") as lines:
        return tuple(dict.fromkeys(w for w in (x.partition("#")[0].strip() for x in lines) if w))


def no_alphanumeric(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"[\p{L}\p{N}]"))


def is_int(text: Column) -> Column:
    """Would Python's int() take it?  White space around, a sign, and single underscores between digits are fine."""
    return F.rlike(text, F.lit(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"))


def last_part(path: Column) -> Column:
    return F.element_at(F.split(F.trim(path), "/"), -1)


def file_name_of(path: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(path, "^/+|/+$", "")), F.lit("/"), F.lit("_"))


def context(text: Column, start: Column, end: Column, reach: int = 30) -> Column:
    """`...before>>>span<<<after...`, clipped to the text."""
    left = F.greatest(F.lit(0), start - reach)
    return F.concat(F.lit("..."), text.substr(left + 1, start - left), F.lit(">>>"), text.substr(start + 1, end - start), F.lit("<<<"), text.substr(end + 1, F.lit(reach)), F.lit("..."))


def sentence_marks(text: Column) -> Column:
    """Full stops and line breaks."""
    return F.length(text) - F.length(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit("\n"), F.lit("")))


#: Fixed value: titles, licence numbers, departments and all from a number on, wherever they stand (inside words too).
NOT_A_NAME = r"(Dr\.?|Dra\.?|NCol|NºCol:.*|Servicio.*|\d+.*|\s+$)"


def clean_answer(text: Column) -> Column:
    """A name as a model gave it, without what is no name and without a final stop; 'None' and null are empty."""
    name = F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(text, NOT_A_NAME, "")), r"\.$", ""))
    return F.when(text.isNull() | (text == "None"), F.lit("")).otherwise(name)


def labelled_line(reply: Column, label: str) -> Column:
    """What follows `label:` on its last line that begins so; empty without."""
    lines = F.filter(F.split(reply, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit(label + ":")))
    return F.when(F.size(lines) > 0, F.trim(F.regexp_replace(F.element_at(lines, -1), "^\\s*" + re.escape(label) + ":", ""))).otherwise(F.lit(""))


def task_of(prompt: Column) -> Column:
    """A prompt from after its first `Tarea:`, or all of it."""
    at = F.locate("Tarea:", prompt)
    return F.trim(F.when(at > 0, F.substring(prompt, at + 6, 1 << 30)).otherwise(prompt))
