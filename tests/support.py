"""Panels for tests: several series, interleaved, in shuffled row order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quantframe import Layout

PLAIN = Layout(longest_series=100_000)
PIECES = Layout(chunk_hours=24 * 7, block_rows=16)
BOTH = pytest.mark.parametrize("layout", [PLAIN, PIECES], ids=["plain", "pieces"])
PANEL = "series_id string, ts timestamp_ntz, value double"


def dates(n: int, start: str = "2020-01-01", freq: str = "D") -> pd.DatetimeIndex:
    return pd.date_range(start, periods=n, freq=freq).astype("datetime64[us]")


def series(values, start: str = "2020-01-01", freq: str = "D") -> pd.Series:
    values = np.asarray(values, dtype=float)
    return pd.Series(values, index=dates(len(values), start, freq))


def frame(spark, schema: str, rows: pd.DataFrame):
    """A DataFrame of shuffled rows over several partitions; NaN stays NaN, None becomes NULL."""
    shuffled = rows.sample(frac=1, random_state=7).astype(object)
    records = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r)
               for r in shuffled.itertuples(index=False)]
    return spark.createDataFrame(records, schema).repartition(3)


def panel(spark, named: dict[str, pd.Series], column: str = "value"):
    rows = pd.concat([pd.DataFrame({"series_id": k, "ts": s.index, column: s.to_numpy(dtype=float)})
                      for k, s in named.items()])
    return frame(spark, PANEL.replace("value", column), rows)


def by_series(df, name: str, sort: str = "ts") -> dict[str, list]:
    """Values of a column per series in time order, NULL as nan."""
    pdf = df.toPandas().sort_values(["series_id", sort])
    return {k: g[name].astype(float).tolist() for k, g in pdf.groupby("series_id")}


def one(df) -> dict[str, dict]:
    """The single row of each series."""
    rows = [r.asDict() for r in df.collect()]
    assert len({r["series_id"] for r in rows}) == len(rows)
    return {r["series_id"]: r for r in rows}


def walk(n: int, seed: int = 42, start: float = 100.0, sd: float = 0.01) -> pd.Series:
    rng = np.random.RandomState(seed)
    return series(start * np.exp(np.cumsum(rng.normal(0, sd, n))))


def reverting(n: int, theta: float = 0.1, seed: int = 42, sd: float = 1.0) -> pd.Series:
    rng = np.random.RandomState(seed)
    values = np.zeros(n)
    for i in range(1, n):
        values[i] = values[i - 1] * (1 - theta) + rng.normal(0, sd)
    return series(values)
