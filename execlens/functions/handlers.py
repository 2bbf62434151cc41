"""User code over records: handlers as Arrow-batched maps, and per-batch sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def apply_handler(df: DataFrame, handler: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a handler over batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield handler(b)

    return df.mapInPandas(run, schema)
