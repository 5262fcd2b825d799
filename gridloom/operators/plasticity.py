"""Plastic return mapping: branches on state, done on Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..params import Material

COLUMNS = ("flags", "stored_p", "stored_q", "jp_inv", "jp_inv_max", "gamma_p", "xi", "fe00", "fe01", "fe10", "fe11")
HARD_LIMIT = 100.0
LOOSE = 0.1


def rebuild(fe: np.ndarray, p: np.ndarray, q: np.ndarray, q_trial: np.ndarray, j_trial: np.ndarray, kappa: float):
    """Deformation gradient with the pressure p and shear q: singular vectors stay, squared singular values
    get the determinant of p and a deviator scaled by q / q_trial. Returns (fe, new determinant)."""
    a, b, c, d = fe
    half_sum, half_diff = np.arctan2(c - b, a + d), np.arctan2(c + b, a - d)
    turn_u, turn_v = (half_diff + half_sum) / 2, (half_diff - half_sum) / 2
    big, small = np.hypot((a + d) / 2, (c - b) / 2), np.hypot((a - d) / 2, (c + b) / 2)
    s0, s1 = big + small, big - small
    j_new = np.sqrt(np.maximum(1 - 2 * p / kappa, 0))
    ratio = np.divide(q, q_trial, out=np.zeros_like(q), where=q_trial > 1e-12)
    dev = ratio * (s0 * s0 - s1 * s1) / 2
    mean = np.sqrt(j_new * j_new + dev * dev)
    t0, t1 = np.sqrt(np.maximum(mean + dev, 1e-12)), np.sqrt(np.maximum(mean - dev, 1e-12))
    t1 = np.where(s1 < 0, -t1, t1)
    cu, su, cv, sv = np.cos(turn_u), np.sin(turn_u), np.cos(turn_v), np.sin(turn_v)
    out = np.stack([cu * t0 * cv + su * t1 * sv, cu * t0 * sv - su * t1 * cv, su * t0 * cv - cu * t1 * sv, su * t0 * sv + cu * t1 * cv])
    return out, j_new


def return_map(v: dict[str, np.ndarray], m: Material, dt: float) -> dict[str, np.ndarray]:
    """New values of COLUMNS for trial states; v is left as it is. Rows of any state may be mixed."""
    v = {k: np.array(x) for k, x in v.items()}
    p, q, flags = v["stored_p"], v["stored_q"], v["flags"]
    if m.live:
        shear, tensile, crush_at = v["xi"] * m.k_shear, -v["xi"] * m.k_tensile, v["xi"] * m.k_compressive
    else:
        shear, tensile, crush_at = (np.full(len(p), x) for x in (m.shear, -m.tensile, m.compressive))
    c = m.c_residual + (m.c_start - m.c_residual) * np.exp(-v["gamma_p"] / m.gamma_star)
    cap = (v["xi"] * m.k_compressive_yield if m.live else m.compressive) * c
    kink = (shear + m.fracture_tan * (shear + m.dp_tan * m.dp_threshold) / (m.dp_tan - m.fracture_tan)) * c

    def surface(x):
        steep = (x - m.dp_threshold) * m.dp_tan
        second = kink + m.yield_tan * (x - m.dp_threshold - kink / m.dp_tan)
        return np.where(x < m.dp_threshold, 0.0, np.minimum(steep, second))

    envelope = np.where(p <= 0, shear / np.where(tensile == 0, np.nan, -tensile) * (p - tensile), shear + m.fracture_tan * p)
    relax = m.relaxation(dt)
    live = (flags & S.DISABLED) == 0
    was = (flags & S.CRACKED) != 0
    breaks = live & ~was & ((p < tensile) | ~((q <= envelope) & (p <= crush_at)))
    how = np.where(p < np.maximum(tensile, 0), S.TENSION, np.where(p > crush_at, S.CRUSH, S.SHEAR))
    flags = np.where(breaks, flags | S.CRACKED | how, flags)
    broken = live & (was | breaks)
    pulled = broken & (p < m.dp_threshold)
    dispersed = v["jp_inv"] < v["jp_inv_max"]
    spread = broken & ~pulled & dispersed & (p > 0)
    over = broken & ~pulled & ~spread & (q > surface(p))
    loose = over & dispersed
    flow = over & ~dispersed
    capped = flow & (p > cap)
    modes = S.TENSION | S.SHEAR | S.CRUSH
    only = lambda where, bit: np.where(where, (flags & ~modes) | bit, flags)
    flags = only(pulled, S.TENSION)
    flags = only(spread, S.SHEAR)
    flags = np.where(loose, flags & ~S.CRUSH, flags)
    flags = only(capped, S.CRUSH)
    flags = only(flow & ~capped, S.SHEAR)
    p_new, q_new = np.zeros(len(p)), np.zeros(len(p))
    p_new[pulled & (v["jp_inv"] < LOOSE)] = p[pulled & (v["jp_inv"] < LOOSE)]
    q_new[pulled] = q[pulled] * relax
    p_new[flow] = np.where(capped, cap, p)[flow]
    reach = surface(p_new)
    q_new[flow] = np.minimum(reach + (q - reach) * relax, envelope)[flow]
    sheared = spread | loose | flow
    v["gamma_p"] = np.where(sheared, v["gamma_p"] + (q - q_new) / (2 * m.mu), v["gamma_p"])
    changed = pulled | sheared
    fe = np.stack([v[k] for k in ("fe00", "fe01", "fe10", "fe11")])
    j_trial = fe[0] * fe[3] - fe[1] * fe[2]
    new, j_new = rebuild(fe, p_new, q_new, q, j_trial, m.kappa)
    for k, x in zip(("fe00", "fe01", "fe10", "fe11"), new, strict=True):
        v[k] = np.where(changed, x, v[k])
    with np.errstate(divide="ignore", invalid="ignore"):
        v["jp_inv"] = np.where(changed, np.minimum(v["jp_inv"] * j_new / j_trial, HARD_LIMIT), v["jp_inv"])
    v["jp_inv_max"] = np.where(changed, np.maximum(v["jp_inv_max"], v["jp_inv"]), v["jp_inv_max"])
    v["flags"] = flags
    return v


def plastic_update(points: DataFrame, m: Material, dt: float) -> DataFrame:
    """Return mapping of points whose stored_p, stored_q hold the trial state. All other columns stay, in the JVM."""
    kinds = {c: points.schema[c].dataType for c in COLUMNS}

    @F.arrow_udf(T.StructType([T.StructField(c, t) for c, t in kinds.items()]))
    def mapped(state: pa.Array) -> pa.Array:
        old = dict(zip(COLUMNS, state.flatten()))
        v = {c: x.to_numpy(zero_copy_only=False) for c, x in old.items()}
        new = return_map(v, m, dt) if len(state) else v
        return pa.StructArray.from_arrays([pa.array(new[c], old[c].type) for c in COLUMNS], names=list(COLUMNS))

    out = points.withColumn("_new", mapped(F.struct(*COLUMNS)))
    return out.select(*[F.col(f"_new.{c}").alias(c) if c in COLUMNS else F.col(c) for c in points.columns])
