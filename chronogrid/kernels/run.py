"""Running a kernel over all keys: the series of one key, some thousands of dates at most, is one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decimal_years(ts: pd.Series) -> np.ndarray:
    t = pd.to_datetime(ts)
    year = t.dt.year.to_numpy()
    days = np.where(t.dt.is_leap_year.to_numpy(), 366.0, 365.0)
    return year + ((t.dt.dayofyear.to_numpy() - 1) + (t - t.dt.normalize()).dt.total_seconds().to_numpy() / 86400) / days


def per_key(obs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[dict] | dict], schema: str, key: str = "px", value: str = "value") -> DataFrame:
    """`kernel(years, values)` of each key's valid dates in order; it returns a dict, or a list of them, of the columns of `schema`.

    Keys without a valid date are given empty arrays.  Columns that a dict lacks are NULL, as are NaN results.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        ok = np.isfinite(frame[value].to_numpy(dtype=float, na_value=np.nan))
        found = kernel(decimal_years(frame["ts"][ok]), frame[value].to_numpy(dtype=float, na_value=np.nan)[ok])
        rows = [found] if isinstance(found, dict) else found
        out = pd.DataFrame([{n: clean(r.get(n)) for n in names} for r in rows], columns=names)
        out.insert(0, key, frame[key].iloc[0])
        return out

    return obs.select(key, F.col("ts").cast("timestamp").alias("ts"), value).groupBy(key).applyInPandas(run, f"{key} long, {schema}")


def clean(x):
    if x is None:
        return None
    if isinstance(x, (float, np.floating)):
        return None if not np.isfinite(x) else float(x)
    return int(x) if isinstance(x, np.integer) else x


def per_key_bands(cube: DataFrame, bands: list[str], kernel: Callable[[np.ndarray, np.ndarray], list[dict] | dict], schema: str, key: str = "px") -> DataFrame:
    """`kernel(years, values)` with a column of values for each band, of dates at which all bands are valid."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        v = frame[bands].to_numpy(dtype=float, na_value=np.nan)
        ok = np.isfinite(v).all(axis=1)
        found = kernel(decimal_years(frame["ts"][ok]), v[ok])
        rows = [found] if isinstance(found, dict) else found
        out = pd.DataFrame([{n: clean(r.get(n)) for n in names} for r in rows], columns=names)
        out.insert(0, key, frame[key].iloc[0])
        return out

    return cube.select(key, F.col("ts").cast("timestamp").alias("ts"), *bands).groupBy(key).applyInPandas(run, f"{key} long, {schema}")


def per_row_bands(cube: DataFrame, bands: list[str], solve: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], schema: str, key: str = "px") -> DataFrame:
    """`solve(values)` of all rows of an Arrow batch at which all bands are valid, whatever their keys: year, rmse, fractions.

    `schema` names the columns in that order; NaN and infinities are NULL.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames):
        for frame in frames:
            v = frame[bands].to_numpy(dtype=float, na_value=np.nan)
            ok = np.isfinite(v).all(axis=1)
            fractions, rmse = solve(v[ok])
            found = np.column_stack([decimal_years(frame["ts"][ok]), rmse, fractions])
            out = pd.DataFrame(np.where(np.isfinite(found), found, np.nan), columns=names).astype(object)
            out = out.where(out.notna(), None)
            out.insert(0, key, frame[key][ok].to_numpy())
            yield out

    return cube.select(key, F.col("ts").cast("timestamp").alias("ts"), *bands).mapInPandas(run, f"{key} long, {schema}")
