"""Many groups through Python, without a Spark group for each: small ones whole, ordered folds with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def _starts(x: pd.DataFrame, keys: list[str]) -> list[int]:
    """Rows whose keys differ from those of the row before; nulls are equal."""
    k, before = x[keys], x[keys].shift()
    other = (k != before) & ~(k.isna() & before.isna())
    first = other.any(axis=1).to_numpy()
    first[:1] = True
    return first.nonzero()[0].tolist()


def by_group(df: DataFrame, keys: list[str], order: list[str | Column], fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """`fn` on the rows of each group, sorted by `order`; partitions are streamed and one group is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for x in batches:
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            if x.empty:
                continue
            new = _starts(x, keys)
            held = x.iloc[new[-1] :]
            done = [fn(x.iloc[a:b]) for a, b in zip(new[:-1], new[1:])]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and not held.empty:
            yield fn(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable, out: str, finish: Callable | None = None) -> DataFrame:
    """The rows of each group, in order, folded one by one; columns: `keys` and `out`.

    step(state, row) gives the next state and a list of rows for `out`; row is a tuple of the columns besides the keys.
    finish(state) gives a group's last rows. Batches are streamed and only the state goes on from row to row, so that a
    group of any size takes no more memory than its state.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + out
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], kinds).schema)
    rest = [c for c in df.columns if c not in keys]
    n = len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            rows: list[tuple] = []
            columns = [c.to_pylist() for c in b.columns]
            for k, row in zip(zip(*columns[:n]), zip(*columns[n:])):
                if k != key:
                    if key is not None and finish:
                        rows += [(*key, *r) for r in finish(state)]
                    key, state = k, start()
                state, got = step(state, row)
                rows += [(*k, *r) for r in got]
            if rows:
                yield batch(rows)
        if key is not None and finish and (rows := [(*key, *r) for r in finish(state)]):
            yield batch(rows)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)
