"""Time-series operators: as-of brackets, nearest frames, spans, gradients, moving averages, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def asof_bracket(probes: DataFrame, frames: DataFrame, t: str, ts: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Floor and next frame of each probe, clamped blend weight and blended values.

    Adds t0, t1, alpha and each of `values` blended linearly. Before the first frame the first two frames bracket with alpha 0,
    after the last the last two with alpha 1; a single frame holds everywhere. Union and two
    windows over (by, time), so it needs one shuffle and no range join. `by` should split the data: without
    it one task orders all rows, which `asof_bracket_chunked` avoids.
    """
    by = list(by)
    f = frames.select(*by, F.col(ts).cast("long").alias("_t"), F.struct(F.col(ts).cast("long").alias("_ts"), *values).alias("_f"))
    order = Window.partitionBy(*by).orderBy("_t")
    f = f.withColumn("_before", F.lag("_f").over(order)).withColumn("_after", F.lead("_f").over(order))
    f = f.select(*by, "_t", F.lit(0).alias("_probe"), F.struct("_f", "_before", "_after").alias("_frame"))
    p = probes.select(*by, F.col(t).cast("long").alias("_t"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"))
    both = f.unionByName(p, allowMissingColumns=True)
    seen = Window.partitionBy(*by).orderBy("_t", "_probe")
    both = both.withColumn("_floor", F.last("_frame", ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    # only asked for before the first frame, where it is the first one; a frame that ends at the last row would be folded anew for each row
    both = both.withColumn("_ceil", F.min_by("_frame", F.when(F.col("_probe") == 0, F.col("_t"))).over(Window.partitionBy(*by)))
    out = both.filter("_probe = 1")
    has = F.col("_floor").isNotNull()
    low = F.when(has & F.col("_floor._after").isNull(), F.coalesce("_floor._before", "_floor._f")).when(has, F.col("_floor._f")).otherwise(F.col("_ceil._f"))
    high = F.when(has, F.coalesce("_floor._after", "_floor._f")).otherwise(F.coalesce("_ceil._after", "_ceil._f"))
    out = out.withColumn("_lo", low).withColumn("_hi", high)
    span = F.col("_hi._ts") - F.col("_lo._ts")
    # greatest and least skip nulls, so a single frame's empty span is told apart first
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_t") - F.col("_lo._ts")) / F.nullif(span, F.lit(0))))
    alpha = F.when(span > 0, share).otherwise(F.lit(0.0))
    out = out.withColumn("alpha", F.when(F.col("_lo").isNotNull(), alpha))
    blended = [(F.col(f"_lo.{v}") * (1 - F.col("alpha")) + F.col(f"_hi.{v}") * F.col("alpha")).alias(v) for v in values]
    return out.select("_row.*", F.col("_lo._ts").alias("t0"), F.col("_hi._ts").alias("t1"), "alpha", *blended)


def asof_bracket_chunked(probes: DataFrame, frames: DataFrame, t: str, ts: str, values: Sequence[str], chunk: int) -> DataFrame:
    """`asof_bracket` for one long series: time is cut in chunks, which are ordered apart.

    Each chunk also gets the two frames before and the two after it. One task orders at most four frames
    and two marks a chunk, so `chunk` should leave some ten thousand chunks and each of a task's size.
    """
    part = lambda c: F.floor(F.col(c).cast("long") / chunk)
    f = frames.select(F.col(ts).cast("long").alias(ts), *values).withColumn("_chunk", part(ts))
    p = probes.withColumn("_chunk", part(t))
    own = Window.partitionBy("_chunk")
    ends = f.withColumn("_k", F.row_number().over(own.orderBy(F.col(ts)))).withColumn("_l", F.row_number().over(own.orderBy(F.col(ts).desc())))
    ends = ends.filter("_k <= 2 OR _l <= 2").select("_chunk", F.lit(1).alias("_kind"), ts, F.struct(ts, *values).alias("_f"))
    row = Window.orderBy("_chunk", ts)
    ends = ends.withColumn("_near", F.struct("_f", F.lag("_f").over(row).alias("_b"), F.lead("_f").over(row).alias("_a")))
    marks = p.select("_chunk").union(f.select("_chunk")).distinct().withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(2))))
    # both run down their order: a frame that ends at the last row would be folded anew for each row
    so_far = lambda *order: F.last("_near", True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before, after = so_far("_chunk", "_kind", ts), so_far(F.desc("_chunk"), F.desc("_kind"), F.desc(ts))
    marks = ends.select("_chunk", "_kind", ts, "_near").unionByName(marks, allowMissingColumns=True).withColumn("_before", before).withColumn("_after", after)
    two = F.when(F.col("_kind") == 0, F.array("_before._f", "_before._b")).otherwise(F.array("_after._f", "_after._a"))
    carried = marks.filter("_kind <> 1").select("_chunk", F.explode(two).alias("_f")).filter("_f IS NOT NULL").select("_chunk", "_f.*")
    return asof_bracket(p, f.unionByName(carried), t, ts, values, by=["_chunk"]).drop("_chunk")


def schedule(steps: DataFrame, t: str, first: str, second: str, n: int, by: Sequence[str] = (), periodic: bool = False) -> DataFrame:
    """What each time step loads: `changed` where the bracket (first, second) isn't the step before's, and `preload`,
    the frame to fetch next: at the series' end the first one again if periodic, else none."""
    w = Window.partitionBy(*by).orderBy(t)
    same = F.col(first).eqNullSafe(F.lag(first).over(w)) & F.col(second).eqNullSafe(F.lag(second).over(w))
    following = F.col(second) + 1
    ahead = following % n if periodic else F.when(following < n, following)
    return steps.withColumn("changed", ~same).withColumn("preload", ahead)


def sorted_union(*arrays: Column) -> Column:
    """All values of some arrays, each once, in order."""
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def covered(t: Column, first: Column, last: Column, value: Column) -> Column:
    """value inside the series' span, 0 outside."""
    return F.when(t.between(first, last), value).otherwise(F.lit(0.0))


def nearest_in_time(probes: DataFrame, frames: DataFrame, t: str, ts: str, keep: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The frame nearest to each probe; of two at one distance the earlier. Adds nearest_ts and `keep`.

    `by` should split the data: without it one task orders all rows, so give times only (see `ocean_frames`).
    """
    by = list(by)
    f = frames.select(*by, F.col(ts).cast("long").alias("_t"), F.lit(0).alias("_probe"), F.struct(F.col(ts).cast("long").alias("nearest_ts"), *keep).alias("_f"))
    p = probes.select(*by, F.col(t).cast("long").alias("_t"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"))
    seen = Window.partitionBy(*by).orderBy("_t", "_probe")
    both = f.unionByName(p, allowMissingColumns=True)
    both = both.withColumn("_lo", F.last("_f", True).over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_probe"))
    # at a probe's own time the frame before it is taken, so that frames at one time need no order here
    both = both.withColumn("_hi", F.last("_f", True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.filter("_probe = 1")
    pick = F.when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull(), F.col("_lo")).when(F.col("_t") - F.col("_lo.nearest_ts") <= F.col("_hi.nearest_ts") - F.col("_t"), F.col("_lo")).otherwise(F.col("_hi"))
    return both.withColumn("_n", pick).select("_row.*", "_n.*")


def frame_range(frames: DataFrame, ts: str, index: str, start: int, end: int) -> DataFrame:
    """(first_idx, last_idx); fails unless both ends are frame times."""
    inside = frames.filter(F.col(ts).between(start, end))
    out = inside.agg(F.min(index).alias("first_idx"), F.max(index).alias("last_idx"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    fits = F.coalesce((F.col("a") == start) & (F.col("b") == end), F.lit(False))
    bad = F.raise_error(F.lit(f"no frames at exactly {start} and {end}")).cast("int")
    return out.select(F.when(fits, F.col("first_idx")).otherwise(bad).alias("first_idx"), F.when(fits, F.col("last_idx")).otherwise(bad).alias("last_idx"))


def exact_time(frames: DataFrame, ts: str, index: str, wanted: int) -> DataFrame:
    """The rows of one frame index, usually one; fails if it is out of range."""
    row = frames.filter(F.col(index) == wanted).select(F.col(ts), F.lit(True).alias("_found"))
    found = frames.sparkSession.range(1).select().join(row, F.lit(True), "left")
    return found.select(F.when(F.col("_found"), F.col(ts)).otherwise(F.raise_error(F.lit(f"frame {wanted} is out of range")).cast("long")).alias(ts))


def check_files(paths: Sequence[str]) -> None:
    """Fails if a path occurs twice."""
    twice = sorted({p for p in paths if list(paths).count(p) > 1})
    if twice:
        raise ValueError(f"given more than once: {twice}")


def mesh_differences(files: Sequence[DataFrame], on: Sequence[str] = ("r", "c"), values: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """(file_seq, on): cells of each file's mesh that the first file lacks, has elsewhere, or that only it has."""
    body = F.struct(*values)
    first = files[0].select(*on, body.alias("_a")).distinct()
    out = []
    for k, d in enumerate(files[1:], 1):
        both = first.join(d.select(*on, body.alias("_b")).distinct(), list(on), "full")
        out.append(both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.lit(k).alias("file_seq"), *on).distinct())
    one = files[0].select(F.lit(0).alias("file_seq"), *on).limit(0)
    for d in out:
        one = one.union(d)
    return one


def one_mesh(files: Sequence[DataFrame], **how) -> Sequence[DataFrame]:
    """The files; fails unless all have the first one's mesh."""
    bad = [r["file_seq"] for r in mesh_differences(files, **how).select("file_seq").distinct().collect()]  # one row a file
    if bad:
        raise ValueError(f"files {sorted(bad)} have another mesh")
    return files


def timeline(files: Sequence[DataFrame], ts: str = "t") -> DataFrame:
    """Concatenation of files' frames in the order given: file_seq, local_idx, global_idx beside the columns.

    Order within and between files is kept, not sorted by time (`out_of_order` flags steps back).
    """
    parts = [d.withColumn("file_seq", F.lit(k)) for k, d in enumerate(files)]
    all_ = parts[0]
    for d in parts[1:]:
        all_ = all_.unionByName(d, allowMissingColumns=True)
    own = Window.partitionBy("file_seq").orderBy(ts)
    counts = all_.groupBy("file_seq").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = all_.withColumn("local_idx", F.row_number().over(own) - 1).join(F.broadcast(offsets), "file_seq")  # one row a file given
    return out.withColumn("global_idx", F.col("local_idx") + F.col("offset")).drop("offset")


def resolve_frame(offsets: DataFrame, wanted: Column) -> DataFrame:
    """offsets (file_seq, offset, n) -> the file and local index that hold a global frame."""
    return offsets.filter((wanted >= F.col("offset")) & (wanted < F.col("offset") + F.col("n"))).select("file_seq", (wanted - F.col("offset")).alias("local_idx"))


def gradient(df: DataFrame, t: str, y: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Derivative on uneven spacing: second order inside, one-sided at the ends, null for a single row."""
    w = Window.partitionBy(*by).orderBy(t)
    hs, hd = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    down, up = F.col(y) - F.lag(y).over(w), F.lead(y).over(w) - F.col(y)
    inside = (hs * hs * up + hd * hd * down) / (hs * hd * (hs + hd))
    return df.withColumn(out, F.when(hs.isNotNull() & hd.isNotNull(), inside).when(hd.isNotNull(), up / hd).otherwise(down / hs))


def moving_average(df: DataFrame, t: str, y: str, out: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Centred average of n rows that counts missing ones at the ends as zero; n is made odd."""
    n += 1 - n % 2
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(-(n // 2), n // 2)
    return df.withColumn(out, F.sum(y).over(w) / float(n))


def spacings(df: DataFrame, t: str, chunk_rows: int = 100_000) -> DataFrame:
    """d, the differences of consecutive times of one series, which is ordered in chunks of time of about `chunk_rows` rows.

    The step into a chunk is taken from the last time of the chunk before, so that one task orders only two
    values a chunk.
    """
    x = df.select(F.col(t).alias("t")).filter("t IS NOT NULL")
    span = x.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).first()
    if not span["n"]:
        return x.select(F.col("t").cast("double").alias("d"))
    width = (span["b"] - span["a"]) / max(1, span["n"] // chunk_rows) or 1
    x = x.withColumn("chunk", F.floor((F.col("t") - span["a"]) / width))
    inside = x.select((F.col("t") - F.lag("t").over(Window.partitionBy("chunk").orderBy("t"))).alias("d"))
    ends = x.groupBy("chunk").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    between = ends.select((F.col("a") - F.lag("b").over(Window.orderBy("chunk"))).alias("d"))
    return inside.unionByName(between).filter("d IS NOT NULL").select(F.col("d").cast("double").alias("d"))


def exact_median(df: DataFrame, value: str, buckets: int = 1024, few: int = 4096) -> float | None:
    """The median as a sorted list would give it (the mean of two middle values), without sorting.

    Counts by bucket show which bucket holds the middle; its own least and greatest values are the next round's bounds, until they
    agree or few different values are left. `buckets` rows a round reach the driver. Nulls and NaN don't count.
    """
    x = cut(df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"))
    all_ = x.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()

    def at(rank: int) -> float:
        low, high, below = all_["a"], all_["b"], 0
        while low < high:
            here = x.filter(F.col("v").between(low, high))
            bucket = F.least(F.floor((F.col("v") - low) / ((high - low) / buckets)), F.lit(buckets - 1))
            rows = here.groupBy(bucket.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"), F.approx_count_distinct("v").alias("u")).sort("k").collect()
            for r in rows:
                if below + r["n"] > rank:
                    break
                below += r["n"]
            low, high = r["a"], r["b"]
            if low < high and r["u"] <= few // 2:
                left = here.filter(F.col("v").between(low, high)).groupBy("v").count().sort("v").limit(few).collect()
                for v in left:
                    below += v["count"]
                    if below > rank:
                        return v["v"]
                low, below = left[-1]["v"], below - left[-1]["count"]  # more than was estimated: go on from the last
        return low

    if not all_["n"]:
        return None
    return (at((all_["n"] - 1) // 2) + at(all_["n"] // 2)) / 2 if all_["n"] % 2 == 0 else at(all_["n"] // 2)


def window_samples(df: DataFrame, t: str, seconds: float, chunk_rows: int = 100_000) -> int:
    """Rows in a window of so many seconds at the median spacing of one series, odd and at least 1."""
    step = exact_median(spacings(df, t, chunk_rows), "d")
    n = max(1, round(seconds / step)) if step else 1
    return n + 1 - n % 2


def transition_window(df: DataFrame, t: str, rate: str, by: Sequence[str] = (), share: float = 0.05, least: float = 0.05) -> DataFrame:
    """(by, start_t, end_t, peak_t): the steepest rise and where its rate falls to `share` of the peak's.

    The first of equal peaks counts. Where the rate never falls so far the series' ends are taken; a series
    whose peak is under `least` gives no row.
    """
    by = list(by)
    w = Window.partitionBy(*by)
    peak = df.withColumn("_p", F.max(F.struct(F.col(rate).alias("v"), (-F.col(t)).alias("nt"))).over(w)).withColumn("_pt", -F.col("_p.nt"))
    low = F.col(rate) <= F.col("_p.v") * share
    out = peak.groupBy(*by).agg(
        F.first("_p.v").alias("_v"),
        F.first("_pt").alias("peak_t"),
        F.coalesce(F.max(F.when((F.col(t) <= F.col("_pt")) & low, F.col(t))), F.min(t)).alias("start_t"),
        F.coalesce(F.min(F.when((F.col(t) >= F.col("_pt")) & low, F.col(t))), F.max(t)).alias("end_t"),
    )
    return out.filter(F.col("_v") >= least).drop("_v")


def transition_label(t: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull() | (t < start), F.lit("intact")).when(t <= end, F.lit("transition")).otherwise(F.lit("fragmented"))


def deltas(df: DataFrame, t: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """dt and rate of change against the previous row."""
    w = Window.partitionBy(*by).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    return df.withColumn("dt", dt).withColumn("rate", (F.col(y) - F.lag(y).over(w)) / F.nullif(dt, F.lit(0)))


def running_peak(df: DataFrame, t: str, y: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(out, F.max(y).over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))


def running_conditional_sum(df: DataFrame, t: str, y: str, when: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(out, F.sum(F.when(when, F.col(y)).otherwise(0.0)).over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))


def intervals(df: DataFrame, point: str, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive (low, high) of sorted distinct breakpoints."""
    w = Window.partitionBy(*by).orderBy(point)
    return df.select(*by, point).distinct().withColumn("high", F.lead(point).over(w)).filter("high IS NOT NULL").withColumnRenamed(point, "low")


def polygon_area(df: DataFrame, order: str, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Signed area of a ring of points, positive counter-clockwise."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in (x, y))
    return df.withColumn("_a", (F.col(x) * ny - nx * F.col(y)) / 2).groupBy(*by).agg(F.sum("_a").alias("area"))


def offset_curve(df: DataFrame, order: str, x: str, y: str, distance: float, by: Sequence[str] = ()) -> DataFrame:
    """Points moved along the left normal of the central tangent (one-sided at the ends)."""
    w = Window.partitionBy(*by).orderBy(order)
    dx = F.coalesce(F.lead(x).over(w), F.col(x)) - F.coalesce(F.lag(x).over(w), F.col(x))
    dy = F.coalesce(F.lead(y).over(w), F.col(y)) - F.coalesce(F.lag(y).over(w), F.col(y))
    size = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return df.withColumn("off_x", F.col(x) - dy / size * distance).withColumn("off_y", F.col(y) + dx / size * distance)


def intersect_intervals(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """[greatest low, least high), or [0, 0) if that is empty."""
    a, b = F.greatest(*low), F.least(*high)
    return F.struct(F.when(a < b, a).otherwise(F.lit(0).cast("long")).alias("low"), F.when(a < b, b).otherwise(F.lit(0).cast("long")).alias("high"))
