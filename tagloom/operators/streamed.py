"""Grouped maps over many small groups without a data frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grouped_rows(df: DataFrame, key: str, order: list[str], function: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Applies `function` to the rows (tuples, without the key) of each group, ordered by `order`; it returns tuples of `schema`.

    Rows are partitioned and sorted by the key and stream through in Arrow batches; only the group at hand is
    held. Groups must be known to be small. Null keys form a group.
    """
    names = [c for c in df.columns if c != key]
    out_names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        held_key: object = None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            rows = list(zip(*(pdf[c].tolist() for c in names), strict=True))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(rows)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and keys[a] != held_key:
                    out += function(held)
                    held = []
                held_key = keys[a]
                held += rows[a:b]
            if out:
                yield _frame(out, out_names)
        out = function(held) if held else []
        if out:
            yield _frame(out, out_names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, zip(*rows, strict=True), strict=True)))
