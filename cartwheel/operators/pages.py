"""Counting reports: rows per dimension value (most and least viewed pages)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.operators.conversion import Dim, named_dims


def count_report(df: DataFrame, dims: Sequence[Dim], *, name: str = "total_views",
                 ascending: bool = False) -> DataFrame:
    """``SELECT dims, COUNT(*) ... GROUP BY dims ORDER BY COUNT(*)``.

    A hot value costs nothing extra: the partial aggregation emits one row per value per task.
    Ties are broken by the dimensions so the order is deterministic.
    """
    cols, names = named_dims(dims)
    out = df.select(*cols).groupBy(*names).agg(F.count(F.lit(1)).alias(name))
    first = F.col(name).asc() if ascending else F.col(name).desc()
    return out.orderBy(first, *[F.col(n).asc() for n in names])
