"""Nearest known cells of a raster by an exact distance transform in two passes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_tile(x: np.ndarray, y: np.ndarray, hole: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(holes, sources): row numbers of holes that have a known cell within the radius, and of that cell.

    x and y count from the corner of a tile of `size` cells with `radius` more around it. Of equally near cells the one of
    least x is taken, then of least y; of repeated ones the first row.
    """
    n = size + 2 * radius
    source = np.full((n, n), -1, np.int32)
    known = np.flatnonzero(~hole)[::-1]
    source[y[known], x[known]] = known
    # first pass: nearest known column of each row, the left one of two
    column, far = np.arange(n), 4 * n
    has = source >= 0
    left = np.maximum.accumulate(np.where(has, column, -far), axis=1)
    right = np.minimum.accumulate(np.where(has, column, far)[:, ::-1], axis=1)[:, ::-1]
    best_column = np.where(column - left <= right - column, left, right)
    # d2 * n + column orders by distance, then by x
    never = np.int64(n) ** 4
    away = best_column - column
    row_cost = np.where(np.abs(away) <= radius, np.int64(n) * away.astype(np.int64) ** 2 + best_column, never)
    # second pass: the column's rows, nearest first, as long as one can still be better
    holes = np.flatnonzero(hole)
    holes = holes[np.unique(y[holes] * n + x[holes], return_index=True)[1]]
    hx, hy = x[holes], y[holes]
    cost, row = row_cost[hy, hx], hy.copy()
    open_ = np.arange(len(holes))
    for d in range(1, radius + 1):
        step = np.int64(n) * d * d
        open_ = open_[cost[open_] > step]
        if not len(open_):
            break
        for s in (-d, d):
            new = row_cost[hy[open_] + s, hx[open_]] + step
            better = new < cost[open_]
            at = open_[better]
            cost[at], row[at] = new[better], hy[at] + s
    found = cost < n * (np.int64(radius) ** 2 + 1)
    return holes[found], source[row[found], best_column[row[found], hx[found]]]


def nearest_known(cells: DataFrame, value: str, radius: int, tile: int = 512) -> DataFrame:
    """x, y and v, the value of the nearest known cell, of each cell whose value is null and that has one within `radius`.

    Known cells also go to the tiles within the radius of them, at most four times as many rows as there are where tiles
    are not smaller than the radius; a task holds one tile with its border, whatever the raster's size. Time is
    linear in the cells and in how far the nearest known one is. Cells without x or y are left out; the raster may be sparse.
    """
    if radius < 0:
        raise ValueError("the radius is 0 or more")
    tile = max(tile, radius, 1)
    place = cells.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(value).alias("v")).dropna(subset=["x", "y"])
    own = lambda c: F.expr(f"({c} - pmod({c}, {tile})) DIV {tile}")
    near = lambda c: F.explode(F.when(F.col("v").isNull(), F.array(own(c))).otherwise(F.sequence(own(f"({c} - {radius})"), own(f"({c} + {radius})"))))
    dealt = place.withColumn("tx", near("x")).withColumn("ty", near("y"))

    def run(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in "xy")
        x0, y0 = (table.column(c)[0].as_py() * tile - radius for c in ("tx", "ty"))
        hole = table.column("v").is_null().to_numpy()
        holes, sources = nearest_in_tile(x - x0, y - y0, hole, tile, radius)
        return pa.table({"x": pa.array(x[holes]), "y": pa.array(y[holes]), "v": table.column("v").take(pa.array(sources))})

    kind = cells.schema[value].dataType.simpleString()
    return dealt.groupBy("tx", "ty").applyInArrow(run, f"x long, y long, v {kind}")
