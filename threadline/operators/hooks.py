"""A user's scorer over batches of rows, whose failures become a column and not the end of a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def scored_by(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str) -> DataFrame:
    """(key, the scorer's columns, error): ``scorer`` gets a batch and returns one row for each of its rows, in order. A batch
    that it fails on, or returns another number of rows for, is tried again row by row; a row that fails has its error."""
    kind = rows.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(",")]

    def attempt(batch: pd.DataFrame) -> pd.DataFrame:
        out = scorer(batch)
        if len(out) != len(batch):
            raise ValueError(f"{len(out)} rows for {len(batch)}")
        made = out[names].reset_index(drop=True)
        made.insert(0, key, batch[key].to_numpy())
        return made.assign(error=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield attempt(batch)
            except Exception:  # noqa: BLE001
                for i in range(len(batch)):
                    one = batch.iloc[i : i + 1]
                    try:
                        yield attempt(one)
                    except Exception as failure:  # noqa: BLE001
                        yield pd.DataFrame({key: one[key].to_numpy(), **{n: [None] for n in names}, "error": [f"{type(failure).__name__}: {failure}"]})

    return rows.mapInPandas(run, f"`{key}` {kind}, {schema}, error string")
