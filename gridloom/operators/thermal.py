"""Heat conduction through ice: sine-mode recurrence along ordered frames, and strength from it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import physics as P
from ..functions.generic import celsius, has
from ..params import KAPPA_ICE
from .masks import enabled
from .scatter import gather


def decay_time(thickness: Column, n: int) -> Column:
    return thickness * thickness / (KAPPA_ICE * math.pi**2 * n * n)


def mode_step(a: Column, rate: Column, dt: Column, thickness: Column, n: int) -> Column:
    """Mode n after a frame of length dt in which the surface warms at `rate`."""
    tau = decay_time(thickness, n)
    push = rate * tau * (2.0 / (n * math.pi))
    return (a + push) * F.exp(-dt / tau) - push


def initial_modes(modes: int = 3) -> list[Column]:
    return [F.lit(0.0) for _ in range(modes)]


def thermal_fold(series: DataFrame, t: str, surface: str, thickness: str, by: Sequence[str] = (), modes: int = 3) -> DataFrame:
    """(by, ts_last, a1..an) at the end of each key's series, starting from zero modes at the first frame.

    One fold over the key's sorted frames: for series that fit a row. Longer ones: `thermal_fold_chunked`.
    """
    by = list(by)
    packed = series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(surface).cast("double").alias("s")))).alias("_x"), F.max(F.col(thickness).cast("double")).alias("_h"))

    def merge(acc, x):
        dt = x["t"] - acc["t"]
        rate = (x["s"] - acc["s"]) / F.nullif(dt, F.lit(0.0))
        new = [F.when(dt > 0, mode_step(acc[f"a{n}"], rate, dt, acc["h"], n)).otherwise(acc[f"a{n}"]).alias(f"a{n}") for n in range(1, modes + 1)]
        return F.struct(x["t"].alias("t"), x["s"].alias("s"), acc["h"].alias("h"), *new)

    first = F.element_at("_x", 1)
    start = F.struct(first["t"].alias("t"), first["s"].alias("s"), F.col("_h").alias("h"), *[F.lit(0.0).alias(f"a{n}") for n in range(1, modes + 1)])
    out = packed.withColumn("_r", F.aggregate("_x", start, merge))
    return out.select(*by, F.col("_h").alias("thickness"), F.col("_r.s").alias("ts_last"), *[F.col(f"_r.a{n}").alias(f"a{n}") for n in range(1, modes + 1)])


def thermal_fold_chunked(series: DataFrame, t: str, surface: str, thickness: str, by: Sequence[str] = (), modes: int = 3, chunk: float = 30 * 86400.0) -> DataFrame:
    """The same for series of any length: a frame's step is affine in each mode (a -> p a + q), and affine maps
    compose, so each chunk of time is folded into one map by its own task and the maps are folded after."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(t)
    x = series.select(*by, F.col(t).cast("double").alias("t"), F.col(surface).cast("double").alias("s"), F.col(thickness).cast("double").alias("h"))
    x = x.withColumn("dt", F.col("t") - F.lag("t").over(w.orderBy("t"))).withColumn("ds", F.col("s") - F.lag("s").over(w.orderBy("t")))
    x = x.withColumn("chunk", F.floor(F.col("t") / chunk))
    step = [F.col("t")]
    for n in range(1, modes + 1):
        tau = decay_time(F.col("h"), n)
        moves = F.col("dt").isNotNull() & (F.col("dt") > 0)
        p = F.when(moves, F.exp(-F.col("dt") / tau)).otherwise(1.0)
        q = F.when(moves, F.col("ds") / F.col("dt") * tau * (2.0 / (n * math.pi)) * (p - 1)).otherwise(0.0)
        step += [p.alias(f"p{n}"), q.alias(f"q{n}")]
    unit = F.struct(*[c for n in range(1, modes + 1) for c in (F.lit(1.0).alias(f"p{n}"), F.lit(0.0).alias(f"q{n}"))])

    def after(f, g):  # g after f
        return F.struct(*[c for n in range(1, modes + 1) for c in ((g[f"p{n}"] * f[f"p{n}"]).alias(f"p{n}"), (g[f"p{n}"] * f[f"q{n}"] + g[f"q{n}"]).alias(f"q{n}"))])

    maps = x.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct(*step))).alias("_x"), F.max(F.struct("t", "s", "h")).alias("last"))
    maps = maps.select(*by, "last", F.struct("chunk", F.aggregate("_x", unit, after).alias("m")).alias("_c"))
    whole = maps.groupBy(*by).agg(F.array_sort(F.collect_list("_c")).alias("_x"), F.max("last").alias("last"))
    whole = whole.withColumn("_m", F.aggregate("_x", unit, lambda f, c: after(f, c["m"])))
    return whole.select(*by, F.col("last.h").alias("thickness"), F.col("last.s").alias("ts_last"), *[F.col(f"_m.q{n}").alias(f"a{n}") for n in range(1, modes + 1)])


def with_strength(state: DataFrame, salinity: float = 6.0, modes: int = 3, depths: int = 8) -> DataFrame:
    return state.withColumn("strength", P.strength(F.col("thickness"), F.col("ts_last"), [F.col(f"a{n}") for n in range(1, modes + 1)], salinity, depths))


def update_points(points: DataFrame, surface: DataFrame | Column, dt: float, salinity: float) -> DataFrame:
    """One thermal frame for points; modes, ts_old and xi are renewed. Disabled points too.

    surface: the new temperature in Celsius, as rows (point_id, ts_new) or as a column of the points, which needs no join.
    """
    if isinstance(surface, Column):
        x = points.withColumn("ts_new", surface)
    else:
        x = points.join(surface.select("point_id", "ts_new"), "point_id", "left")
    x = x.withColumn("ts_new", F.coalesce("ts_new", "ts_old"))
    rate = (F.col("ts_new") - F.col("ts_old")) / dt
    x = x.withColumns({f"a{n}": mode_step(F.col(f"a{n}"), rate, F.lit(float(dt)), F.col("thickness"), n) for n in (1, 2, 3)})
    x = x.withColumn("xi", P.strength(F.col("thickness"), F.col("ts_new"), [F.col(f"a{n}") for n in (1, 2, 3)], salinity))
    return x.withColumn("ts_old", F.col("ts_new")).select(*points.columns)


def strength_step(points: DataFrame, temperatures: DataFrame, alpha: float, dt: float, salinity: float, most: int | None = None) -> DataFrame:
    """Points after one thermal frame of `dt` seconds: modes, ts_old and xi renewed from the grid's temperature.

    temperatures: i, j and the two frames around the time, t0 and t1, in kelvin, blended by alpha. Each point gathers
    them from its 3 x 3 neighbourhood with the quadratic weights. Disabled points stay as they are. `most`: see `gathered`.
    """
    live = enabled(points)
    warm = gather(live, temperatures, ["t0", "t1"], "point_id", most=most).select("point_id", celsius(F.col("t0") * (1 - alpha) + F.col("t1") * alpha).alias("ts_new"))
    return update_points(live, warm, dt, salinity).unionByName(points.filter(has(F.col("flags"), S.DISABLED)))
