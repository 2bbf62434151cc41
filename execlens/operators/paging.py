"""Top-k, keyset paging and ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import after_key


def keyset_page(df: DataFrame, columns: Sequence[str], after: Sequence[Column] | None, limit: int) -> DataFrame:
    """The page after a compound key, in its order (a distributed top-k, no global sort)."""
    d = df if after is None else df.where(after_key(columns, after))
    return d.orderBy(*columns).limit(limit)


def page_with_more(df: DataFrame, order: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The page and (has_more), by one row beyond it."""
    page = df.orderBy(*order).limit(limit + 1)
    return page.orderBy(*order).limit(limit), page.agg((F.count("*") > limit).alias("has_more"))


def fifo(df: DataFrame, due: Column, order: Sequence[str], n: int = 1) -> DataFrame:
    return df.where(due).orderBy(*order).limit(n)


def fair_batch(df: DataFrame, attempts: str, sequence: str, n: int) -> DataFrame:
    return df.orderBy(attempts, sequence).limit(n)


def newest(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
