import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source)."""

    def table(rows, extra=()):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *[None] * len(extra)) for r in rows]
        return spark.createDataFrame(full, SCHEMA + "".join(f", {c} string" for c in extra))

    return table
