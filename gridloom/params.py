"""Parameters as plain dataclasses; operators turn them into literals."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Projection:
    """Oblique spherical stereographic plane (scale 1 at the centre) and the affine pixel transform."""

    lat0: float
    lon0: float
    affine: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    resize: float = 1.0
    radius: float = 6_371_000.0

    @property
    def metres_per_pixel(self) -> float:
        return abs(self.affine[0]) * self.resize


@dataclass(frozen=True)
class Material:
    """Elastic and strength parameters; derived constants are properties."""

    young: float = 3.7e9
    poisson: float = 0.3
    density: float = 916.0
    c_residual: float = 0.5
    c_start: float = 0.4
    gamma_star: float = 0.02
    dp_threshold: float = -1e3
    dp_tan: float = 1.2
    fracture_tan: float = 0.3
    yield_tan: float = 0.2
    shear: float = 1e5
    tensile: float = 5e4
    compressive: float = 1e6
    live: bool = False
    k_shear: float = 1.0
    k_tensile: float = 0.5
    k_compressive: float = 10.0
    k_compressive_yield: float = 10.0
    tau_inv: float = 0.0
    friction: float = 0.3
    salinity: float = 6.0

    @property
    def mu(self) -> float:
        return self.young / (2 * (1 + self.poisson))

    @property
    def lam(self) -> float:
        return self.young * self.poisson / ((1 + self.poisson) * (1 - 2 * self.poisson))

    @property
    def kappa(self) -> float:
        return self.mu * 2 / 3 + self.lam

    def relaxation(self, dt: float) -> float:
        return math.exp(-dt * self.tau_inv) if self.tau_inv > 0 else 0.0


@dataclass(frozen=True)
class Grid:
    size_x: int
    size_y: int
    cell: float
    dt: float
    particle_area: float = 1.0
    water_drag: float = 0.0055
    wind_drag: float = 0.0015
    spin_up: float = 3600.0

    @property
    def d_inv(self) -> float:
        return 4.0 / (self.cell * self.cell)

    @property
    def v_max(self) -> float:
        return 0.25 * self.cell / self.dt


# Water and air density (kg/m3), thermal diffusivity (m2/s), bottom temperature (degrees C).
RHO_WATER = 1030.0
RHO_AIR = 1.2
KAPPA_ICE = 1.1e-6
T_BOTTOM = -1.8
