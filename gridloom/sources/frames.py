"""Frames, snapshots, series, reports and caches as partitioned Parquet and CSV."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.generic import has
from ..operators.layout import sort_by_cell
from ..operators.masks import verify_points

FRAME_NAME = r"^(frame_|f)(\d+)\.(h5|parquet)$"


def frame_path(folder: str, n: int) -> str:
    return f"{folder}/f{n:05d}.parquet"


def scan_frames(names: DataFrame, name: str = "name") -> DataFrame:
    """(n_frames, last_frame) of file names that look like frames; gaps don't matter to last_frame."""
    hit = names.filter(F.col(name).rlike(FRAME_NAME))
    return hit.agg(F.count("*").alias("n_frames"), F.max(F.regexp_extract(name, FRAME_NAME, 2).cast("int")).alias("last_frame"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) by the binaryFile source; contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def nearest_snapshot(names: DataFrame, wanted: int, pattern: str = r"(\d+)(?:\.[A-Za-z]\w*)?$", name: str = "name") -> DataFrame:
    """The snapshot whose number is nearest, the lower of two; number 0 is left out."""
    n = F.regexp_extract(name, pattern, 1)
    d = names.filter(n != "").withColumn("n", n.cast("int")).filter("n <> 0")
    return d.agg(F.min_by(F.struct(name, "n"), F.struct(F.abs(F.col("n") - wanted), "n")).alias("m")).select("m.*")


def write_frames(cells: DataFrame, folder: str, mode: str = "overwrite", values: Sequence[str] | None = None) -> None:
    """Cells partitioned by frame, a file for each 512 columns; statuses are stored as truncated bytes."""
    fractions = [c for c in ("crushed", "cracked", "tension", "shear", "crush") if c in cells.columns]
    cells = cells.withColumns({c: (F.col(c) * 255).cast("short") for c in fractions})
    if values:
        cells = cells.select("frame", "i", "j", *values)
    cells.repartition("frame", F.floor(F.col("i") / 512)).write.mode(mode).partitionBy("frame").option("compression", "zstd").parquet(folder)


def read_frames(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """Frames by partition filter, columns by selection; byte statuses are fractions again, absent columns are null."""
    d = spark.read.parquet(folder)
    if first is not None:
        d = d.filter(F.col("frame") >= first)
    if last is not None:
        d = d.filter(F.col("frame") <= last)
    known = [f.name for f in S.GRID_FRAME if not values or f.name in ("frame", "i", "j", *values)]
    out = []
    for c in known:
        if c not in d.columns:
            out.append(F.lit(None).cast(S.GRID_FRAME[c].dataType).alias(c))
        elif c in ("crushed", "cracked", "tension", "shear", "crush"):
            out.append((F.col(c) / 255.0).alias(c))
        else:
            out.append(F.col(c).cast(S.GRID_FRAME[c].dataType).alias(c))
    return d.select(*out)


def write_snapshot(points: DataFrame, folder: str, number: int, **attributes) -> None:
    """Points of one snapshot and a one-row table of attributes. Written again, a snapshot replaces the earlier one."""
    replace = {"partitionOverwriteMode": "dynamic", "compression": "zstd"}
    points.withColumn("snapshot", F.lit(number)).write.mode("overwrite").options(**replace).partitionBy("snapshot").parquet(f"{folder}/points")
    spark = points.sparkSession
    written = spark.read.parquet(f"{folder}/points").filter(F.col("snapshot") == number)  # counted from the files, so that points are made once
    row = {"number": number, "n_points": written.count()} | attributes
    spark.createDataFrame([tuple(row.values())], list(row)).withColumn("snapshot", F.lit(number)).write.mode("overwrite").options(**replace).partitionBy("snapshot").parquet(f"{folder}/attributes")


def read_snapshot(spark: SparkSession, folder: str, number: int, columns: Sequence[str] | None = None, capacity: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Enabled points of one snapshot; missing columns are an error, and more points than `capacity`.

    With the grid's `size` the points are verified (see `verify_points`) and sorted by cell.
    """
    d = spark.read.parquet(f"{folder}/points").filter(F.col("snapshot") == number)
    missing = {f.name for f in S.POINTS} - set(d.columns)
    if missing:
        raise ValueError(f"the snapshot lacks {sorted(missing)}")
    if capacity is not None and (n := snapshot_attributes(spark, folder, number).first()["n_points"]) > capacity:
        raise ValueError(f"the snapshot holds {n} points, there is room for {capacity}")
    d = d.filter(~has(F.col("flags"), S.DISABLED))
    if size:
        d = sort_by_cell(verify_points(d, *size), size[1])
    return d.select(*(columns or [f.name for f in S.POINTS]))


def snapshot_attributes(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/attributes").filter(F.col("snapshot") == number)


def flag_counts(points: DataFrame) -> DataFrame:
    """(n, cracked, tension, shear, crush, disabled): points, and those with each status bit."""
    bits = {"cracked": S.CRACKED, "tension": S.TENSION, "shear": S.SHEAR, "crush": S.CRUSH, "disabled": S.DISABLED}
    return points.agg(F.count("*").alias("n"), *[F.count_if(has(F.col("flags"), b)).alias(c) for c, b in bits.items()])


def write_cloud(points: DataFrame, folder: str, **attributes) -> None:
    """A generated point cloud and what it was made with, for `read_cloud`."""
    write_grid(points, folder, **attributes)


def read_cloud(spark: SparkSession, folder: str, **attributes) -> DataFrame | None:
    """The cached cloud if it was made with these attributes, else None."""
    try:
        made = spark.read.parquet(f"{folder}/attributes").first().asDict()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(f"{folder}/grid") if made == attributes else None


def frame_of_step(step: int, steps_a_frame: int) -> int:
    return step // steps_a_frame


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """A temperature series in the order of its times."""
    return spark.read.csv(path, schema=S.SERIES, header=True).orderBy("epoch_unix")


def write_series(df: DataFrame, path: str) -> None:
    df.select(*[f.name for f in S.SERIES]).write.mode("overwrite").csv(path, header=True)


def write_site_series(series: DataFrame, folder: str, by: str) -> None:
    """Series of many sites (see `nearest.site_series`) as CSV with a header, a folder for each value of `by`."""
    series.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).csv(folder, header=True)


def read_site_series(spark: SparkSession, folder: str, keys: str) -> DataFrame:
    """Series written by `write_site_series`; keys are the columns before the series' own, with their types."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.SERIES)
    return spark.read.csv(folder, schema=f"{keys}, {own}", header=True, enforceSchema=False)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=S.DIAGNOSTICS, header=True)


def write_report(df: DataFrame, path: str) -> None:
    df.select(*[f.name for f in S.DIAGNOSTICS]).write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log; Spark writes a header into each part, so it is there from the first."""
    df.write.mode("append").csv(path, header=True)


def write_grid(cells: DataFrame, folder: str, **attributes) -> None:
    cells.write.mode("overwrite").parquet(f"{folder}/grid")
    cells.sparkSession.createDataFrame([tuple(attributes.values())], list(attributes)).write.mode("overwrite").parquet(f"{folder}/attributes")


def read_grid(spark: SparkSession, folder: str, size_x: int, size_y: int) -> DataFrame:
    """Grid cells; fails if the stored size differs."""
    a = spark.read.parquet(f"{folder}/attributes").first()
    if (a["size_x"], a["size_y"]) != (size_x, size_y):
        raise ValueError(f"the grid is {a['size_x']} x {a['size_y']}, not {size_x} x {size_y}")
    return spark.read.parquet(f"{folder}/grid")


class FrameCache:
    """Materialised re-gridded frames: absent is a miss, another size or number of frames is an error.

    A frame is a partition that is written as a whole, and named in `done` afterwards. A fill that was broken off is
    repeated: frames named there are kept, one that was under way is replaced, so no frame is ever doubled. Only a complete
    cache is read.
    """

    def __init__(self, spark: SparkSession, folder: str, size_x: int, size_y: int, frames: int):
        self.spark, self.folder, self.want = spark, folder, (size_x, size_y, frames)

    def probe(self) -> DataFrame | None:
        try:
            a = self.spark.read.parquet(f"{self.folder}/attributes").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        if (a["size_x"], a["size_y"], a["frames"]) != self.want:
            raise ValueError(f"the cache holds {(a['size_x'], a['size_y'], a['frames'])}, {self.want} is needed")
        return self.spark.read.parquet(f"{self.folder}/data")

    def finished(self) -> set[int]:
        """Frames that earlier fills have written, one number a frame; fails if they were of another size."""
        try:
            done = self.spark.read.parquet(f"{self.folder}/done").distinct().collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return set()
            raise
        if other := {tuple(r[k] for k in ("size_x", "size_y", "frames")) for r in done} - {self.want}:
            raise ValueError(f"the cache was begun for {sorted(other)}, {self.want} is needed")
        return {r["frame"] for r in done}

    def fill(self, frames: Iterable[int], make: Callable[[int], DataFrame], progress: Callable[[int], bool] = lambda _: True) -> bool:
        """Write the frames that are not there yet; progress may stop it by returning False, and the cache stays incomplete."""
        done, schema = self.finished(), "frame int, size_x int, size_y int, frames int"
        for n in frames:
            if n not in done:
                make(n).withColumn("frame", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame").parquet(f"{self.folder}/data")
                self.spark.createDataFrame([(n, *self.want)], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
            if not progress(n):
                return False
        self.spark.createDataFrame([self.want], "size_x int, size_y int, frames int").write.mode("overwrite").parquet(f"{self.folder}/attributes")
        return True

    def frame(self, n: int) -> DataFrame | None:
        d = self.probe()
        return None if d is None else d.filter(F.col("frame") == n)
