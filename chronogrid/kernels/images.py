"""Algorithms on tiles of an image: superpixels and shifts.  A tile, some hundred cells wide, is one Arrow batch; tiles don't cross."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_tile(cells: DataFrame, bands: list[str], tile: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray] | list[dict]], schema: str) -> DataFrame:
    """`kernel(image)` of each tile of cells (x, y, bands), as an array of rows, columns and bands with NaN where there is none.

    It returns images by name, which become columns of the cells, or a list of dicts, which become rows of the tile.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(frame["tx"].iloc[0]), int(frame["ty"].iloc[0])
        x, y = (frame["x"] - tx * tile).to_numpy(int), (frame["y"] - ty * tile).to_numpy(int)
        image = np.full((tile, tile, len(bands)), np.nan)
        image[y, x] = frame[bands].to_numpy(float, na_value=np.nan)
        found = kernel(image)
        if isinstance(found, list):
            out = pd.DataFrame([{n: r.get(n) for n in names} for r in found], columns=names)
            out.insert(0, "ty", ty)
            out.insert(0, "tx", tx)
            return out
        out = pd.DataFrame({n: found[n][y, x] for n in names})
        out.insert(0, "y", frame["y"].to_numpy())
        out.insert(0, "x", frame["x"].to_numpy())
        out.insert(0, "ty", ty)
        out.insert(0, "tx", tx)
        return out

    place = lambda c: F.floor(F.col(c) / tile).cast("int")
    put = cells.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *bands).withColumn("tx", place("x")).withColumn("ty", place("y"))
    return put.groupBy("tx", "ty").applyInPandas(run, f"tx int, ty int, {schema}" if "by_tile" in kernel.__name__ else f"tx int, ty int, x int, y int, {schema}")


def superpixels(spacing: int, compactness: float = 0.1):
    """SNIC (Achanta and Susstrunk 2017): clusters grow from a grid of seeds by a queue ordered by distance in bands and place; numbers are 1 and up, 0 where there is no data."""

    def by_cell(image: np.ndarray) -> dict[str, np.ndarray]:
        h, w, n = image.shape
        ok = np.isfinite(image).all(axis=2)
        label = np.zeros((h, w), np.int64)
        seeds = [(y, x) for y in range(spacing // 2, h, spacing) for x in range(spacing // 2, w, spacing) if ok[y, x]]
        sums, places, count = np.zeros((len(seeds) + 1, n)), np.zeros((len(seeds) + 1, 2)), np.zeros(len(seeds) + 1)
        queue = [(0.0, k, y, x, k + 1) for k, (y, x) in enumerate(seeds)]
        heapq.heapify(queue)
        order = len(queue)
        while queue:
            _, _, y, x, k = heapq.heappop(queue)
            if label[y, x]:
                continue
            label[y, x] = k
            sums[k] += image[y, x]
            places[k] += (y, x)
            count[k] += 1
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                a, b = y + dy, x + dx
                if 0 <= a < h and 0 <= b < w and ok[a, b] and not label[a, b]:
                    d = float(((image[a, b] - sums[k] / count[k]) ** 2).sum()) / compactness**2
                    s = float(((np.array([a, b]) - places[k] / count[k]) ** 2).sum()) / spacing**2
                    heapq.heappush(queue, (math.sqrt(d + s), order, a, b, k))
                    order += 1
        return {"segment": label}

    return by_cell


def shift_by_tile(max_shift: int):
    """Whole-cell shift of the second band against the first by phase correlation, with the height of its peak."""

    def by_tile(image: np.ndarray) -> list[dict]:
        a, b = (np.nan_to_num(image[:, :, k] - np.nanmean(image[:, :, k]) if np.isfinite(image[:, :, k]).any() else image[:, :, k]) for k in (0, 1))
        window = np.outer(np.hanning(len(a)), np.hanning(a.shape[1]))
        cross = np.fft.fft2(a * window) * np.conj(np.fft.fft2(b * window))
        size = np.abs(cross)
        if size.max() == 0:
            return [{"dx": None, "dy": None, "peak": 0.0}]
        r = np.fft.ifft2(cross / np.maximum(size, 1e-12 * size.max())).real
        h, w = r.shape
        dy = (np.arange(h) + h // 2) % h - h // 2
        dx = (np.arange(w) + w // 2) % w - w // 2
        r = np.where((np.abs(dy)[:, None] <= max_shift) & (np.abs(dx)[None, :] <= max_shift), r, -np.inf)
        i, j = np.unravel_index(int(np.argmax(r)), r.shape)
        return [{"dx": float(-dx[j]), "dy": float(-dy[i]), "peak": float(r[i, j])}]

    return by_tile
