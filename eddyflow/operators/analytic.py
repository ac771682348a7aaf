"""Ranking, top-k and sliding statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows: a partial top k in each task, merged; nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "row_number", name: str = "rn") -> DataFrame:
    """The rows of rank k or less in each group; groups are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, RANKS[rank]().over(w)).filter(F.col(name) <= k)


def sliding_moment(df: DataFrame, kind: str, y: str, x: str, order: list[Column], rows: int, name: str, partition: list[str] | None = None) -> DataFrame:
    """CORR, COVAR_SAMP or COVAR_POP of the pairs in the last ``rows`` + 1 rows; null pairs are skipped.

    CORR is null for under two pairs and where either side does not vary.
    """
    w = Window.partitionBy(*partition) if partition else Window
    w = w.orderBy(*order).rowsBetween(-rows, 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(y).cast("double")), F.when(both, F.col(x).cast("double"))
    if kind == "corr":
        varies = (F.min(a).over(w) < F.max(a).over(w)) & (F.min(b).over(w) < F.max(b).over(w))
        spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
        value = F.when(varies, F.covar_pop(a, b).over(w) / F.when(spread != 0, spread))
    elif kind == "covar_pop":
        value = F.covar_pop(a, b).over(w)
    else:
        value = F.when(F.count(a).over(w) > 1, F.covar_samp(a, b).over(w))
    return df.withColumn(name, value)
