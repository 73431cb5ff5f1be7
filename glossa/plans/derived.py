"""Gold and system spans made from `documents`, by the same rule in Spark and in SQL.

Tokens are what blanks part.  Gold spans are tokens whose place is 0 or 1 modulo 7.  The
system finds those and spurious ones (3 modulo 7), misses some (8 modulo 14), runs on to
the end of the next token for others (1 modulo 14), and mistakes some tags (7 modulo 14).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.sweep import pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Gold and system spans start at tokens whose place is one of these modulo CYCLE.
CYCLE = 14
GOLD = (0, 1, 7, 8)
SYSTEM = (0, 1, 3, 7, 10)


def _placed(batches: Iterator[pa.RecordBatch], places: tuple[int, ...] | None = None, following: bool = True) -> Iterator[pa.RecordBatch]:
    """The tokens of each text with their places; a text is one row, so nothing has to meet.

    Tokens take some ten times the room of their text, so few texts are cut up at once, and
    only the tokens at some places (modulo CYCLE), with the next ones if they follow, are given back.
    """
    for batch in (piece for whole in batches for piece in pieces(whole)):
        # lists of tokens, some of them empty, that single blanks part
        lists = pc.split_pattern(pc.fill_null(batch.column("text"), ""), " ")
        token, offsets = lists.flatten(), lists.offsets.to_numpy()
        size = pc.utf8_length(token).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 1)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        before = np.concatenate([[0], ends])[offsets[:-1]]
        start = ends - size - 1 - before[owner]
        pos = np.arange(len(token)) - offsets[owner]
        real = np.flatnonzero((size > 0) & pc.is_valid(batch.column("text")).to_numpy(zero_copy_only=False)[owner])
        at = real if places is None else real[np.isin(pos[real] % CYCLE, places)]
        names = ["doc_id", "pos", "token", "start", "end"]
        columns = [batch.column("doc_id").take(pa.array(owner[at])), pa.array(pos[at], pa.int32()), token.take(pa.array(at)), pa.array(start[at]), pa.array(start[at] + size[at])]
        if following:
            # the next token of the same text
            then = np.searchsorted(real, at) + 1
            after = np.append(real, 0)[then]
            last = (then == len(real)) | (owner[after] != owner[at]) if len(at) else np.zeros(0, bool)
            names += ["n_start", "n_end", "n_token"]
            columns += [pa.array(start[after], mask=last), pa.array(start[after] + size[after], mask=last), token.take(pa.array(after, mask=last))]
        yield pa.RecordBatch.from_arrays(columns, names)


def tokens(spark: SparkSession, sf_dir: str, places: tuple[int, ...] | None = None, following: bool = False) -> DataFrame:
    """doc_id, pos, token, start, end of all non-empty tokens, or of those at some places modulo CYCLE; following: with the next token's n_start, n_end, n_token."""
    more = ", n_start long, n_end long, n_token string" if following else ""
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(partial(_placed, places=places, following=following), f"doc_id long, pos int, token string, start long, end long{more}")


def _tag() -> F.Column:
    return F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG")), (F.length("token") % 3 + 1).cast("int"))


def _gold_columns() -> dict[str, F.Column]:
    return {"ord": F.col("pos"), "start": F.col("start"), "end": F.col("end"), "tag": _tag(), "text": F.col("token")}


def _system_columns() -> dict[str, F.Column]:
    longer = (F.col("pos") % 14 == 1) & F.col("n_end").isNotNull()
    text = F.concat("token", F.repeat(F.lit(" "), (F.col("n_start") - F.col("end")).cast("int")), F.col("n_token"))
    return {
        "ord": F.col("pos"), "start": F.col("start"), "end": F.when(longer, F.col("n_end")).otherwise(F.col("end")),
        "tag": F.when(F.col("pos") % 14 == 7, F.lit("MISC")).otherwise(_tag()), "text": F.when(longer, text).otherwise(F.col("token")),
    }


def _named(columns: dict[str, F.Column]) -> list[F.Column]:
    return [c.alias(name) for name, c in columns.items()]


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, start, end, tag, text."""
    return tokens(spark, sf_dir, GOLD).select("doc_id", *_named(_gold_columns()))


def system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir, SYSTEM, following=True).select("doc_id", *_named(_system_columns()))


def sides(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The rows of gold (g 1, s 0) and of system (g 0, s 1) from one pass over the texts: doc_id, columns, g, s."""
    rows = tokens(spark, sf_dir, tuple(sorted({*GOLD, *SYSTEM})), following=True).withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    ours, place = F.col("s") == 0, F.col("pos") % CYCLE
    own, other = _gold_columns(), _system_columns()
    mixed = {c: F.when(ours, own[c]).otherwise(other[c]) for c in columns}
    return rows.where((ours & place.isin(*GOLD)) | (~ours & place.isin(*SYSTEM))).select("doc_id", *_named(mixed), (1 - F.col("s")).alias("g"), "s")


SQL = """
WITH tok0 AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents
), tok1 AS (
  SELECT *, CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s0 FROM tok0
), tok AS (
  SELECT doc_id, pos, token, s0 AS s, s0 + length(token) AS e, CASE length(token) % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' ELSE 'ORG' END AS tag,
    lead(s0) OVER w AS ns, lead(s0 + length(token)) OVER w AS ne, lead(token) OVER w AS nt
  FROM tok1 WHERE token <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), gold AS (
  SELECT doc_id, pos AS ord, s, e, tag, token AS text FROM tok WHERE pos % 7 IN (0, 1)
), sys AS (
  SELECT doc_id, pos AS ord, s, CASE WHEN pos % 14 = 1 AND ne IS NOT NULL THEN ne ELSE e END AS e, CASE WHEN pos % 14 = 7 THEN 'MISC' ELSE tag END AS tag,
    CASE WHEN pos % 14 = 1 AND ne IS NOT NULL THEN token || repeat(' ', CAST(ns - e AS INTEGER)) || nt ELSE token END AS text
  FROM tok WHERE pos % 7 IN (0, 1, 3) AND pos % 14 <> 8
)"""
