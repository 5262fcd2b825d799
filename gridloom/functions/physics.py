"""Constitutive, thermal and drag expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import T_BOTTOM, Material


def spline_weights(pos: Column) -> list[Column]:
    """Quadratic weights of the cells at -1, 0 and 1 for a position in [-0.5, 0.5]; they sum to 1."""
    return [(F.lit(0.5) - pos) * (F.lit(0.5) - pos) * 0.5, F.lit(0.75) - pos * pos, (pos + 0.5) * (pos + 0.5) * 0.5]


def determinant(f: list[Column]) -> Column:
    return f[0] * f[3] - f[1] * f[2]


def _left_cauchy(f: list[Column]) -> tuple[Column, Column, Column]:
    return f[0] * f[0] + f[1] * f[1], f[0] * f[2] + f[1] * f[3], f[2] * f[2] + f[3] * f[3]


def deviator(a: list[Column]) -> list[Column]:
    half = (a[0] + a[3]) / 2
    return [a[0] - half, a[1], a[2], a[3] - half]


def kirchhoff_stress(m: Material, f: list[Column]) -> list[Column]:
    """Stress times transposed deformation gradient, row by row."""
    j = determinant(f)
    xx, xy, yy = _left_cauchy(f)
    d = deviator([xx, xy, xy, yy])
    volume = (j * j - 1.0) * (m.kappa * 0.5)
    return [d[0] / j * m.mu + volume, d[1] / j * m.mu, d[2] / j * m.mu, d[3] / j * m.mu + volume]


def pressure(m: Material, f: list[Column]) -> Column:
    j = determinant(f)
    return (j * j - 1.0) * (-m.kappa / 2)


def shear_stress(m: Material, f: list[Column]) -> Column:
    xx, xy, yy = _left_cauchy(f)
    half = (xx - yy) / 2
    return F.sqrt(half * half * 2 + xy * xy * 2) / determinant(f) * (m.mu * math.sqrt(2))


def strain_energy(m: Material, f: list[Column]) -> Column:
    j = determinant(f)
    trace = f[0] * f[0] + f[1] * f[1] + f[2] * f[2] + f[3] * f[3]
    return ((trace / j - 2) * m.mu + ((j * j - 1) * 0.5 - F.ln(j)) * m.kappa) * 0.5


def green_lagrange(f: list[Column]) -> list[Column]:
    xx, xy, yy = f[0] * f[0] + f[2] * f[2], f[0] * f[1] + f[2] * f[3], f[1] * f[1] + f[3] * f[3]
    return [(xx - 1) / 2, xy / 2, xy / 2, (yy - 1) / 2]


def equivalent_strain(f: list[Column]) -> Column:
    return F.sqrt(sum((e * e for e in green_lagrange(f)), F.lit(0.0)))


def von_mises_strain(f: list[Column]) -> Column:
    return F.sqrt(sum((e * e for e in deviator(green_lagrange(f))), F.lit(0.0)) * (2.0 / 3.0))


def singular_values(f: list[Column]) -> tuple[Column, Column]:
    """Closed form for 2 x 2, larger first; the smaller has the determinant's sign."""
    e, g = (f[0] + f[3]) / 2, (f[0] - f[3]) / 2
    h, k = (f[2] + f[1]) / 2, (f[2] - f[1]) / 2
    q, r = F.sqrt(e * e + k * k), F.sqrt(g * g + h * h)
    return q + r, q - r


def softening(gamma: Column, m: Material) -> Column:
    return F.exp(-gamma / m.gamma_star) * (m.c_start - m.c_residual) + m.c_residual


def intact_envelope(p: Column, shear, neg_tensile, tan_fracture: float, cut: bool = False) -> Column:
    """Two legs; with cut, null below the tensile limit."""
    shear, neg_tensile = (x if isinstance(x, Column) else F.lit(x) for x in (shear, neg_tensile))
    q = F.when(p <= 0, shear / -neg_tensile * (p - neg_tensile)).otherwise(shear + p * tan_fracture)
    return F.when(p >= neg_tensile, q) if cut else q


def crossover(shear, m: Material, c: Column) -> Column:
    shear = shear if isinstance(shear, Column) else F.lit(shear)
    at = (shear + m.dp_tan * m.dp_threshold) / (m.dp_tan - m.fracture_tan)
    return (shear + at * m.fracture_tan) * c


def yield_surface(p: Column, q_crossover: Column, m: Material, cut: bool = False) -> Column:
    """The smaller of two lines; 0 (with cut: null) below the threshold."""
    steep = (p - m.dp_threshold) * m.dp_tan
    second = q_crossover + (p - (q_crossover / m.dp_tan + m.dp_threshold)) * m.yield_tan
    return F.when(p < m.dp_threshold, F.lit(None).cast("double") if cut else F.lit(0.0)).when(p.isNotNull(), F.least(steep, second))


def ellipse(p: Column, p_max: float, q_max: float, p_min: float = 0.0) -> Column:
    """q on an ellipse over [p_min, p_max]; null outside."""
    half = (p_max - p_min) / 2
    x = (p - (p_min + half)) / half
    return F.when(F.abs(x) <= 1, F.sqrt(F.lit(1.0) - x * x) * q_max)


def profile(z: Column, thickness: Column, surface: Column, modes: list[Column]) -> Column:
    """Temperature at depth z: linear between surface and bottom plus sine modes."""
    t = surface + (F.lit(T_BOTTOM) - surface) * (z / thickness)
    for n, a in enumerate(modes, 1):
        t = t + a * F.sin(z * (n * math.pi) / thickness)
    return t


def brine_linear(t: Column, salinity: float) -> Column:
    """Brine volume fraction, clipped to [0, 1]; warm ice saturates."""
    cold = F.greatest(-t, F.lit(1e-6))
    return F.when(t.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(49.185) / cold + 0.532) * (salinity * 1e-3))))


# Cubic coefficients of the phase functions F1, F2 on three temperature ranges.
F1_WARM, F2_WARM = (-0.041221, -18.407, 0.58402, 0.21454), (0.090312, -0.016111, 1.2291e-4, 1.3603e-4)
F1_MIDDLE, F2_MIDDLE = (-4.732, -22.45, -0.6397, -0.01074), (0.08903, -0.01763, -5.330e-4, -8.801e-6)
F1_COLD, F2_COLD = (9899.0, 1309.0, 55.27, 0.7160), (8.547, 1.089, 0.04518, 5.819e-4)


def brine_cubic(t: Column, salinity, air: float = 0.0) -> Column:
    """Brine volume fraction by piecewise cubics; null outside -30..0 degrees."""
    cubic = lambda c: t * t * t * c[3] + t * t * c[2] + t * c[1] + c[0]
    pick = lambda warm, middle, cold: F.when((t > -2) & (t <= 0), cubic(warm)).when((t <= -2) & (t >= -22.9), cubic(middle)).when((t < -22.9) & (t >= -30), cubic(cold))
    f1, f2 = pick(F1_WARM, F1_MIDDLE, F1_COLD), pick(F2_WARM, F2_MIDDLE, F2_COLD)
    ice = (F.lit(917.0) - t * 0.1403) / 1000.0 * salinity
    return ice * (1 - air) / (f1 - ice * f2)


def flexural_strength(brine: Column) -> Column:
    return F.exp(F.sqrt(brine) * -5.88) * 1.76e6


def strength(thickness: Column, surface: Column, modes: list[Column], salinity: float, depths: int = 8) -> Column:
    """Mean flexural strength over the midpoints of equal layers."""
    total = F.lit(0.0)
    for k in range(depths):
        total = total + flexural_strength(brine_linear(profile(thickness * ((k + 0.5) / depths), thickness, surface, modes), salinity))
    return total / depths


def drag(coefficient: float, rho: float, ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column]:
    """Quadratic traction on a body moving with v in a medium moving with u."""
    dx, dy = ux - vx, uy - vy
    size = F.sqrt(dx * dx + dy * dy)
    return size * dx * (coefficient * rho), size * dy * (coefficient * rho)


def stable_step(cell: float, density: float, thickness: Column, young: float) -> Column:
    return F.sqrt(thickness * (density / young)) * (0.8 * cell)
