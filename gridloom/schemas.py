"""Fixed schemas: points, grid frames, rasters, masks, series and reports."""

from __future__ import annotations

from pyspark.sql import types as T


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


POINTS = T.StructType(
    [
        T.StructField("point_id", T.LongType()),
        T.StructField("cell_x", T.IntegerType()),
        T.StructField("cell_y", T.IntegerType()),
        T.StructField("flags", T.LongType()),
        *_doubles("posx", "posy", "velx", "vely", "thickness", "jp_inv", "m_squared", "a1", "a2", "a3", "ts_old", "xi"),
        *_doubles("fe00", "fe01", "fe10", "fe11", "bp00", "bp01", "bp10", "bp11", "stored_p", "stored_q", "gamma_p", "jp_inv_max"),
    ]
)
GRID_FRAME = T.StructType(
    [
        T.StructField("frame", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        *_doubles("mass", "vx", "vy", "strain_eqv", "strain_vm", "thickness", "p", "q", "jpinv", "ice_strength", "gamma_p"),
        *_doubles("crushed", "cracked", "tension", "shear", "crush"),
    ]
)
CURVILINEAR = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("t", T.LongType()),
        T.StructField("r", T.IntegerType()),
        T.StructField("c", T.IntegerType()),
        *_doubles("lat", "lon", "u10", "v10", "skt"),
    ]
)
REGULAR = T.StructType(
    [
        T.StructField("hours_1950", T.DoubleType()),
        T.StructField("lat_idx", T.IntegerType()),
        T.StructField("lon_idx", T.IntegerType()),
        *_doubles("uo", "vo", "utide", "vtide", "sithick"),
    ]
)
MASK = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "flags")])
SERIES = T.StructType([T.StructField("timestamp_utc", T.StringType()), T.StructField("epoch_unix", T.LongType()), T.StructField("temperature_C", T.DoubleType())])
MEASURES = ("ice_strength_mean", "ice_strength_max", "wind_speed_mean", "wind_speed_max", "current_speed_mean", "current_speed_max", "ice_speed_mean", "ice_speed_max", "fractured_fraction", "wind_drag_mean", "wind_drag_max", "current_drag_mean", "current_drag_max")
DIAGNOSTICS = T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("epoch_utc", T.LongType()), T.StructField("datetime_utc", T.StringType()), *_doubles(*MEASURES)])

# Status bits of a point's flags.
CRACKED = 0x20000
DISABLED = 0x40000
TENSION = 0x80000
SHEAR = 0x100000
CRUSH = 0x200000
# Mask bits and region codes.
WATER, ICE, MASK_CRUSHED, MASK_CRACKED, MASK_OPEN, MASK_ANALYSIS = 1, 2, 4, 8, 16, 32
REGION_LAND, REGION_OPEN, REGION_MODELLED = 0, 128, 255
