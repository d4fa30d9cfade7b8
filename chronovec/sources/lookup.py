"""Lookups in an outside service, a batch of keys at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def enrich(df: DataFrame, key: str, service: Callable[[list], dict], schema: str, size: int = 100) -> DataFrame:
    """``df`` with the columns that ``service(keys)`` returns for each key; unknown keys get nulls.

    The service is called from the tasks, once for each ``size`` distinct keys of a batch.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, found = list(b[key].drop_duplicates()), {}
            for lo in range(0, len(keys), size):
                found |= service(keys[lo : lo + size])
            yield b.assign(**{n: [found.get(k, {}).get(n) for k in b[key]] for n in names})

    return df.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), schema]))
