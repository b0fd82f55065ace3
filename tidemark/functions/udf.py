"""The hook for a user's own model over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_with(df: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run `score` on each batch of rows; it returns a frame of `schema`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield score(pdf)

    return df.mapInPandas(run, schema)
