"""Caller's functions over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def per_item(df: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """``function(row) -> row`` for each row; it travels to the tasks, and rows move in batches."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([function(r) for r in b.to_dict("records")], columns=names)

    return df.mapInPandas(run, schema)


def with_model(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A model over batches of rows (U4): ``load`` runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)
