"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this counts as hot; below it a shuffle partition copes.
HOT_ROWS = 200_000
#: Hot keys are broadcast, so there may be at most this many of them.
MOST_HOT = 1_000


def lookup_join(rows: DataFrame, table: DataFrame, key: str, n_rows: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once; ``n_rows`` is the size of ``rows``.

    A key with over ``max(HOT_ROWS, n_rows / MOST_HOT)`` rows is hot. There
    are fewer than ``MOST_HOT`` such keys whatever the input, so their part of
    ``table`` is broadcast; all other keys go through a shuffle join. Nothing
    is dropped: each row takes exactly one of the two ways. Rows with a null
    key find no partner (kept for ``left``, dropped for ``inner``).
    """
    if n_rows <= HOT_ROWS:
        return rows.join(table, key, how)
    limit = max(HOT_ROWS, n_rows // MOST_HOT)
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key)
    keys = [r[0] for r in hot.collect()]
    if not keys:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    heavy = rows.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(keys))), key, how)
    rest = rows.where(~is_hot).join(table.where(~F.col(key).isin(keys)), key, how)
    return heavy.unionByName(rest)
