"""The table functions as UDTFs, and the text functions as UDFs, for use in SQL.

`SELECT * FROM documents, LATERAL tag_spans(text, tagged_text)`.  DataFrame code uses
`glossa.functions.inline`, which hands whole batches to the same functions.  Null
arguments are empty strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from glossa.functions import inline, text


def _udtf(make: Callable[..., list[tuple]], schema: str):
    class Rows:
        def eval(self, *args) -> Iterator[tuple]:
            yield from make(*("" if a is None else a for a in args))

    return F.udtf(Rows, returnType=schema)


def _reply_values(reply: str) -> list[tuple]:
    """Tag and value of each listed entity of a reply that parses, whole or from its first brace to its last."""
    named = (inline.parse_reply(reply) or {}).get("entidades")
    lists = named if isinstance(named, dict) else {}
    return [(str(tag), str(v)) for tag, values in lists.items() for v in (values if isinstance(values, list | tuple | set) else [values])]


def _span_elements(xml: str, base: int | str) -> list[tuple]:
    """Spans of a span XML document in its order; none of one that cannot be read."""
    import xml.etree.ElementTree as ET

    from glossa.sources.readers import _xml_rows

    try:
        rows = _xml_rows(xml, int(base or 0))[1]
    except (ET.ParseError, ValueError, TypeError):
        return []
    return [(i, category, kind, start, end, found) for i, category, kind, start, end, _, _, found, _ in rows]


TABLES = {
    "tag_spans": (lambda original, tagged: inline._numbered(inline.align(original, tagged)), inline.SPAN_ROWS),
    "tag_candidates": (lambda t: inline._numbered(inline.tag_candidates(t)), inline.SPAN_ROWS),
    "loose_matches": (lambda t, value: [(a, b, t[a:b]) for a, b in inline.loose_matches(t, value)], "start long, end long, text string"),
    "inline_bio": (lambda t: [(i, w, x) for i, (w, x) in enumerate(inline.inline_to_bio(t))], "pos int, token string, label string"),
    "legacy_bio": (lambda t: [(i, w, x) for i, (w, x) in enumerate(inline.legacy_bio(t))], "pos int, token string, label string"),
    "stray_openings": (lambda t, pattern: inline.compliance(t, pattern or 1)[1], "start long, context string"),
    "packed_lines": (lambda t, limit: [(i, c, over) for i, (c, over) in enumerate(inline.pack_lines(t, len, limit or 0))], "part int, chunk string, oversize boolean"),
    "reply_values": (_reply_values, "tag string, value string"),
    "span_elements": (_span_elements, "ord int, category string, type string, start int, end int, text string"),
}


@F.pandas_udf(StringType())
def _error_text(values: pd.Series) -> pd.Series:
    """text.error_text, value by value."""
    fold = lambda t: unicodedata.normalize("NFKD", re.sub(r"[^\w\s]", "", t.lower())).encode("ascii", "ignore").decode().strip(" ")
    return values.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(LongType())
def _token_count(values: pd.Series, path: pd.Series) -> pd.Series:
    """Tokens of a text by the tokenizer of a .json file, which each worker reads once."""
    from glossa.plans.annotate import token_length

    return pd.Series([None if t is None else token_length(p)(t) for t, p in zip(values, path, strict=True)], dtype="Int64")


#: Functions of one row by name.
FUNCTIONS = {"without_marks": text.without_marks, "error_text": _error_text, "token_count": _token_count}


def register(spark: SparkSession) -> list[str]:
    """Registers all of them in a session; returns their names."""
    for name, (make, schema) in TABLES.items():
        spark.udtf.register(name, _udtf(make, schema))
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return [*TABLES, *FUNCTIONS]
