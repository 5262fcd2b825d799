"""Raster images as tables of pixels, through Spark's image source (decoded in the JVM)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, x int, y int, r int, g int, b int"


def read_image(spark: SparkSession, path: str, flip: bool = True, skip: bool = False) -> DataFrame:
    """(path, x, y, r, g, b) of PNG or JPEG files; y counts from the bottom if flip.

    A file that can't be decoded is an error that names it, or left out if `skip`. One file's pixels leave its task in slices of rows, so a task holds one
    decoded image at a time.
    """
    images = spark.read.format("image").option("dropInvalid", skip).load(path)
    images = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        for batch in batches:
            for origin, h, w, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if h < 0:
                    raise ValueError(f"{origin} is not an image")
                bands = np.frombuffer(data, np.uint8).reshape(h, w, n)
                for top in range(0, h, 256):
                    part = bands[top : top + 256]
                    rows = part.shape[0]
                    y = np.repeat(np.arange(top, top + rows), w)
                    y = h - 1 - y if flip else y
                    x = np.tile(np.arange(w), rows)
                    flat = part.reshape(-1, n).astype(np.int32)
                    b, g, r = (flat[:, k] for k in (0, 1, 2)) if n >= 3 else (flat[:, 0],) * 3
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(x), pa.string()), *(pa.array(v.astype(np.int32)) for v in (x, y, r, g, b))], names=["path", "x", "y", "r", "g", "b"])

    return images.mapInArrow(run, SCHEMA)
