"""Joins whose keys may be shared by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import written

#: A key with more than one in so many rows is hot: there are fewer hot keys than this.
MOST_HOT = 1000


def join_skewed(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = MOST_HOT) -> DataFrame:
    """big joined to small, whose keys are unique and not null in big; how: inner or left.

    Rows of hot keys stay where they are: their partners, fewer than `most` rows, are sent
    to every task.  All other rows meet by a shuffle, in which no key has more than one in
    `most` of them.  big is read three times, so it should be a written table.
    """
    n = big.count()
    hot = written(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * most > n).select(*keys), "hot")
    if not hot.limit(1).count():
        return big.join(small, keys, how)
    hot = F.broadcast(hot)
    few = F.broadcast(small.join(hot, keys, "left_semi"))
    return big.join(hot, keys, "left_semi").join(few, keys, how).unionByName(big.join(hot, keys, "left_anti").join(small, keys, how))
