"""Scatter from points to cells, gather back, and one explicit time step built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import physics as P
from ..functions.generic import has
from ..params import RHO_AIR, RHO_WATER, Grid, Material
from .lineage import cut
from .plasticity import plastic_update
from .raster import densify


def fan_out(points: DataFrame) -> DataFrame:
    """Nine rows a point: cell (i, j), weight w and distances dx, dy (in cells) of its 3 x 3 neighbourhood.

    The offsets are an array literal, so nothing is joined or broadcast.
    """
    wx, wy = P.spline_weights(F.col("posx")), P.spline_weights(F.col("posy"))
    cells = [
        F.struct((F.col("cell_x") + a).alias("i"), (F.col("cell_y") + b).alias("j"), (wx[a + 1] * wy[b + 1]).alias("w"), (F.lit(float(a)) - F.col("posx")).alias("dx"), (F.lit(float(b)) - F.col("posy")).alias("dy"))
        for a in (-1, 0, 1)
        for b in (-1, 0, 1)
    ]
    return points.withColumn("_n", F.explode(F.array(*cells))).select("*", "_n.*").drop("_n")


def scatter(points: DataFrame, sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Weighted sums by (keys, i, j): sum(w * value). One partial and one final aggregation."""
    return fan_out(points).groupBy(*keys, "i", "j").agg(*[F.sum(F.col("w") * v).alias(n) for n, v in sums.items()])


def normalise(cells: DataFrame, mass: str, values: Sequence[str]) -> DataFrame:
    """Sums divided by mass; a cell without mass keeps its sums."""
    return cells.select(*[(F.coalesce(F.col(c) / F.nullif(F.col(mass), F.lit(0.0)), F.col(c))).alias(c) if c in values else F.col(c) for c in cells.columns])


def gather(points: DataFrame, cells: DataFrame, values: Sequence[str], key: str | Sequence[str], on: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """sum(w * value) over the neighbourhoods of each key's points; cells that are missing count as 0. `most`: see `gathered`."""
    by = [key] if isinstance(key, str) else list(key)
    at = gathered(points.select(*dict.fromkeys([*by, *on, "cell_x", "cell_y", "posx", "posy"])), cells, values, on, most=most).select(*by, *values)
    # dealt out first: most keys have one row, which a sum before the exchange would only hold in memory
    return at.repartition(*by).groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])


def neighbourhoods(cells: DataFrame, values: Sequence[str], on: Sequence[str] = (), tile: int = 16) -> DataFrame:
    """(on, tx, ty) and, of each of `values`, an array of a tile's cells with those around it, by rows of i; missing ones are 0.

    A cell at a tile's border is in the arrays of its neighbours too, so a point meets all its cells in one row.
    """
    size = tile + 2

    def owners(c: str) -> Column:
        own = F.floor(F.col(c) / tile).cast("int")
        inner = F.pmod(F.col(c), F.lit(tile))
        return F.when(inner == 0, F.array(own - 1, own)).when(inner == tile - 1, F.array(own, own + 1)).otherwise(F.array(own))

    dealt = cells.withColumn("tx", F.explode(owners("i"))).withColumn("ty", F.explode(owners("j")))
    place = (F.col("i") - F.col("tx") * tile + 1) * size + F.col("j") - F.col("ty") * tile + 1
    held = dealt.groupBy(*on, "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), F.struct(*values).alias("v")))).alias("_m"))  # size squared at most
    full = held.withColumn("_m", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at(F.col("_m"), k)))
    return full.select(*on, "tx", "ty", *[F.transform(F.col(f"_m.{v}"), lambda x: F.coalesce(x, F.lit(0.0))).alias(v) for v in values])


#: Values of a grid, over all its cells, that every executor may hold for a gather.
HELD_VALUES = 4_000_000


def gathered(points: DataFrame, cells: DataFrame, values: Sequence[str], on: Sequence[str] = (), tile: int = 16, most: int | None = None) -> DataFrame:
    """points with three columns for each v of `values`: v, v_dx and v_dy, the sums of w * v, w * v * dx and w * v * dy (dx, dy in
    cells) over their 3 x 3 neighbourhoods. One join by tile; no row is fanned out and none has to find back to its point.
    A grid of at most `most` cells (over all of `on`) that holds no more than HELD_VALUES is sent to the points, which then stay
    where they are; otherwise, or if that is not known, points are dealt out by tile.
    """
    size = tile + 2
    p = points.withColumn("tx", F.floor(F.col("cell_x") / tile).cast("int")).withColumn("ty", F.floor(F.col("cell_y") / tile).cast("int"))
    near = neighbourhoods(cells, values, on, tile).withColumnsRenamed({v: f"_at_{v}" for v in values})
    held = most is not None and most * len(values) <= HELD_VALUES
    p = p.join(F.broadcast(near) if held else near, [*on, "tx", "ty"], "left")
    at = (F.col("cell_x") - F.col("tx") * tile + 1) * size + F.col("cell_y") - F.col("ty") * tile + 1
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    p = p.withColumns({f"_{v}{k}": F.coalesce(F.get(F.col(f"_at_{v}"), (at + a * size + b).cast("int")), F.lit(0.0)) for v in values for k, (a, b) in enumerate(steps)})
    wx, wy = P.spline_weights(F.col("posx")), P.spline_weights(F.col("posy"))
    p = p.withColumns({f"_w{k}": wx[a + 1] * wy[b + 1] for k, (a, b) in enumerate(steps)})
    sums = {}
    for v in values:
        for name, side in ((v, None), (f"{v}_dx", 0), (f"{v}_dy", 1)):
            terms = [F.col(f"_w{k}") * F.col(f"_{v}{k}") * (1.0 if side is None else F.lit(float(step[side])) - F.col(("posx", "posy")[side])) for k, step in enumerate(steps)]
            total = terms[0]
            for x in terms[1:]:
                total = total + x
            sums[name] = total
    return p.select(*[points[c] for c in points.columns], *[c.alias(n) for n, c in sums.items()])


def _fe() -> list[Column]:
    return [F.col(c) for c in ("fe00", "fe01", "fe10", "fe11")]


def field(double_grid: bool = True) -> Column:
    return F.when(has(F.col("flags"), S.CRACKED), F.lit(1)).otherwise(F.lit(0)) if double_grid else F.lit(0)


def points_to_grid(points: DataFrame, m: Material, g: Grid, double_grid: bool = True) -> DataFrame:
    """(field, i, j, mass, px, py, thickness): mass, momentum and thickness times mass of enabled points."""
    mass = F.col("thickness") * (m.density * g.particle_area)
    stress = P.kirchhoff_stress(m, _fe())
    factor = F.col("jp_inv") * F.col("thickness") * (-g.dt * g.particle_area * g.d_inv)
    c = [s * factor + F.col(b) * mass for s, b in zip(stress, ("bp00", "bp01", "bp10", "bp11"), strict=True)]
    live = points.filter(~has(F.col("flags"), S.DISABLED)).withColumn("field", field(double_grid))
    dx, dy = F.col("dx") * g.cell, F.col("dy") * g.cell
    px = F.col("velx") * mass + c[0] * dx + c[1] * dy
    py = F.col("vely") * mass + c[2] * dx + c[3] * dy
    return scatter(live, {"mass": mass, "px": px, "py": py, "thickness": mass * F.col("thickness")}, ["field"])


def node_update(cells: DataFrame, forcing: DataFrame, m: Material, g: Grid, time: float) -> DataFrame:
    """Velocity of each node with mass: momentum over mass, water and wind drag with a ramp, land at rest.

    forcing: i, j, region, cx, cy (current) and wx, wy (wind), already blended in time.
    """
    ramp = min(1.0, time / g.spin_up) if g.spin_up > 0 else 1.0
    n = cells.filter("mass <> 0").join(forcing, ["i", "j"], "left")
    vx, vy = F.col("px") / F.col("mass"), F.col("py") / F.col("mass")
    n = n.withColumn("vx", vx).withColumn("vy", vy).withColumn("h", F.col("thickness") / F.col("mass"))

    def pull(u, v, coefficient, rho):
        ux, uy = F.coalesce(F.col(u), F.lit(0.0)) * ramp - F.col("vx"), F.coalesce(F.col(v), F.lit(0.0)) * ramp - F.col("vy")
        k = F.least(F.lit(0.5), F.sqrt(ux * ux + uy * uy) / F.col("h") * (coefficient * rho / m.density * g.dt))
        return k * ux, k * uy

    water, wind = pull("cx", "cy", g.water_drag, RHO_WATER), pull("wx", "wy", g.wind_drag, RHO_AIR)
    land = ~F.coalesce(F.col("region"), F.lit(S.REGION_LAND)).isin(S.REGION_MODELLED, S.REGION_OPEN)
    new = [F.when(land, F.lit(0.0)).otherwise(F.col(c) + water[k] + wind[k]) for k, c in enumerate(("vx", "vy"))]
    n = n.withColumn("nx", new[0]).withColumn("ny", new[1])
    fast = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") > g.v_max**2 * 0.5
    return n.select("field", "i", "j", "mass", F.when(fast, F.lit(0.0)).otherwise(F.col("nx")).alias("vx"), F.when(fast, F.lit(0.0)).otherwise(F.col("ny")).alias("vy"), F.col("h").alias("thickness"), "region")


def contact(m0: Column, m1: Column, gx: Column, gy: Column, v0: tuple[Column, Column], v1: tuple[Column, Column], friction: float) -> Column:
    """Velocities of both fields after contact: struct(v0x, v0y, v1x, v1y). gx, gy is the gradient of m0 - m1."""
    total = m0 + m1
    size = F.sqrt(gx * gx + gy * gy)
    n = (-gx / F.nullif(size, F.lit(0.0)), -gy / F.nullif(size, F.lit(0.0)))
    safe = F.nullif(total, F.lit(0.0))
    centre = tuple((m0 * a + m1 * b) / safe for a, b in zip(v0, v1, strict=True))
    d = tuple(a - c for a, c in zip(v0, centre, strict=True))
    normal = d[0] * n[0] + d[1] * n[1]
    side = tuple(d[k] - normal * n[k] for k in range(2))
    length = F.sqrt(side[0] * side[0] + side[1] * side[1])
    stick = length <= normal * friction
    new = [F.when(stick, centre[k]).otherwise(v0[k] - normal * n[k] - normal * friction * side[k] / F.nullif(length, F.lit(0.0))) for k in range(2)]
    meets = F.coalesce((m0 >= total * 1e-3) & (m1 >= total * 1e-3) & (size >= 1e-10) & (normal > 0), F.lit(False))
    out0 = [F.when(meets, new[k]).otherwise(v0[k]) for k in range(2)]
    out1 = [F.when(meets, v1[k] - m0 * (new[k] - v0[k]) / F.nullif(m1, F.lit(0.0))).otherwise(v1[k]) for k in range(2)]
    return F.struct(out0[0].alias("v0x"), out0[1].alias("v0y"), out1[0].alias("v1x"), out1[1].alias("v1y"))


def with_contact(df: DataFrame, m0: Column, m1: Column, gx: Column, gy: Column, v0: tuple[Column, Column], v1: tuple[Column, Column], friction: float) -> DataFrame:
    """df with the columns of `contact`, v0x, v0y, v1x, v1y, in steps that each use the last one's columns.

    One expression would repeat its parts some thousand times, more than generated code may hold.
    """
    c, keep = F.col, df.columns
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    df = df.withColumns({"_m0": m0, "_m1": m1, "_gx": gx, "_gy": gy, "_ax": v0[0], "_ay": v0[1], "_bx": v1[0], "_by": v1[1]})
    df = df.withColumns({"_m": c("_m0") + c("_m1"), "_g": F.sqrt(c("_gx") * c("_gx") + c("_gy") * c("_gy"))})
    df = df.withColumns({f"_n{k}": over(-c(f"_g{k}"), c("_g")) for k in "xy"} | {f"_c{k}": over(c("_m0") * c(f"_a{k}") + c("_m1") * c(f"_b{k}"), c("_m")) for k in "xy"})
    df = df.withColumn("_normal", (c("_ax") - c("_cx")) * c("_nx") + (c("_ay") - c("_cy")) * c("_ny"))
    df = df.withColumns({f"_s{k}": c(f"_a{k}") - c(f"_c{k}") - c("_normal") * c(f"_n{k}") for k in "xy"})
    df = df.withColumn("_length", F.sqrt(c("_sx") * c("_sx") + c("_sy") * c("_sy")))
    meets = (c("_m0") >= c("_m") * 1e-3) & (c("_m1") >= c("_m") * 1e-3) & (c("_g") >= 1e-10) & (c("_normal") > 0)
    slides = lambda k: c(f"_a{k}") - c("_normal") * c(f"_n{k}") - over(c("_normal") * friction * c(f"_s{k}"), c("_length"))
    df = df.withColumns({"_meets": F.coalesce(meets, F.lit(False))} | {f"_f{k}": F.when(c("_length") <= c("_normal") * friction, c(f"_c{k}")).otherwise(slides(k)) for k in "xy"})
    new = {f"v0{k}": F.when(c("_meets"), c(f"_f{k}")).otherwise(c(f"_a{k}")) for k in "xy"}
    new |= {f"v1{k}": F.when(c("_meets"), c(f"_b{k}") - over(c("_m0") * (c(f"_f{k}") - c(f"_a{k}")), c("_m1"))).otherwise(c(f"_b{k}")) for k in "xy"}
    return df.select(*keep, *[v.alias(n) for n, v in new.items()])


def contact_nodes(nodes: DataFrame, m: Material, g: Grid) -> DataFrame:
    """Contact at nodes where both fields have mass; gradients come from four equi-joins on sparse cells."""
    mass = nodes.groupBy("i", "j").agg(*[F.coalesce(F.max(F.when(F.col("field") == k, F.col(c))), F.lit(0.0)).alias(f"{c}{k}") for k in (0, 1) for c in ("mass", "vx", "vy")], F.max("region").alias("region"))
    diff = mass.select("i", "j", (F.col("mass0") - F.col("mass1")).alias("d"))
    shifted = diff.select(F.explode(F.array(*[F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), (F.col("d") * a).alias("gx"), (F.col("d") * b).alias("gy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")).select("s.*")
    grad = shifted.groupBy("i", "j").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    both = mass.join(grad, ["i", "j"], "left").fillna(0.0, ["gx", "gy"])
    edge = (F.col("i") <= 0) | (F.col("i") >= g.size_x - 1) | (F.col("j") <= 0) | (F.col("j") >= g.size_y - 1)
    land = ~F.coalesce(F.col("region"), F.lit(0)).isin(S.REGION_MODELLED, S.REGION_OPEN)
    gx, gy = (F.when(edge | land, F.lit(0.0)).otherwise(F.col(c)) for c in ("gx", "gy"))
    both = with_contact(both, F.col("mass0"), F.col("mass1"), gx, gy, (F.col("vx0"), F.col("vy0")), (F.col("vx1"), F.col("vy1")), m.friction)
    out = both.select("i", "j", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"mass{k}").alias("mass"), F.col(f"v{k}x").alias("vx"), F.col(f"v{k}y").alias("vy")) for k in (0, 1)])).alias("n")).select("i", "j", "n.*")
    return out.filter("mass <> 0")


def grid_to_points(points: DataFrame, nodes: DataFrame, regions: DataFrame, m: Material, g: Grid, double_grid: bool = True, fracture: bool = True) -> DataFrame:
    """Gather velocity and its gradient, advect, carry cells, disable at edges, update deformation and state."""
    points = points.withColumn("field", field(double_grid))
    off = has(F.col("flags"), S.DISABLED)
    live, idle = points.filter(~off), points.filter(off).drop("field")
    p = gathered(live.drop("velx", "vely", "bp00", "bp01", "bp10", "bp11"), nodes.select("field", "i", "j", "vx", "vy"), ["vx", "vy"], ["field"], most=(2 if double_grid else 1) * g.size_x * g.size_y)
    b = 4.0 / g.cell
    p = p.withColumns({n: F.col(c) * b for n, c in (("bp00", "vx_dx"), ("bp01", "vx_dy"), ("bp10", "vy_dx"), ("bp11", "vy_dy"))}).withColumnsRenamed({"vx": "velx", "vy": "vely"})
    x, y = F.col("posx") + F.col("velx") * (g.dt / g.cell), F.col("posy") + F.col("vely") * (g.dt / g.cell)
    carry = lambda v: F.when(v > 0.5, F.lit(1)).when(v < -0.5, F.lit(-1)).otherwise(F.lit(0))
    p = p.withColumn("_x", x).withColumn("_y", y).withColumn("_cx", carry(F.col("_x"))).withColumn("_cy", carry(F.col("_y")))
    p = p.withColumn("posx", F.col("_x") - F.col("_cx")).withColumn("posy", F.col("_y") - F.col("_cy")).withColumn("cell_x", F.col("cell_x") + F.col("_cx")).withColumn("cell_y", F.col("cell_y") + F.col("_cy"))
    p = p.join(regions.select(F.col("i").alias("cell_x"), F.col("j").alias("cell_y"), F.col("region").alias("_r")), ["cell_x", "cell_y"], "left")
    edge = (F.col("cell_x") <= 1) | (F.col("cell_x") >= g.size_x - 2) | (F.col("cell_y") <= 1) | (F.col("cell_y") >= g.size_y - 2)
    gone = ((F.col("_cx") != 0) | (F.col("_cy") != 0)) & (edge | (F.coalesce(F.col("_r"), F.lit(0)) == S.REGION_OPEN))
    p = p.withColumn("flags", F.when(gone, F.col("flags").bitwiseOR(F.lit(S.DISABLED).cast("long"))).otherwise(F.col("flags")))
    f, d = _fe(), [F.col(c) * g.dt for c in ("bp00", "bp01", "bp10", "bp11")]
    new = [f[0] + d[0] * f[0] + d[1] * f[2], f[1] + d[0] * f[1] + d[1] * f[3], f[2] + d[2] * f[0] + d[3] * f[2], f[3] + d[2] * f[1] + d[3] * f[3]]
    p = p.withColumns({"_f0": new[0], "_f1": new[1], "_f2": new[2], "_f3": new[3]})
    p = p.withColumns({c: F.col(f"_f{k}") for k, c in enumerate(("fe00", "fe01", "fe10", "fe11"))})
    p = p.withColumns({"stored_p": P.pressure(m, _fe()), "stored_q": P.shear_stress(m, _fe())})
    p = p.select(*idle.columns)
    if fracture:
        p = plastic_update(p, m, g.dt)
    return p.unionByName(idle)


def step(points: DataFrame, forcing: DataFrame, m: Material, g: Grid, time: float, double_grid: bool = True, fracture: bool = True) -> DataFrame:
    """One explicit step: points to grid, node update, contact, grid to points. Checkpoint the points every few steps.

    The nodes, at most two a grid cell, are checkpointed, as contact and gather read them several times.
    """
    nodes = cut(node_update(points_to_grid(points, m, g, double_grid), forcing, m, g, time))
    if double_grid:
        nodes = contact_nodes(nodes, m, g)
    return grid_to_points(points, nodes, forcing, m, g, double_grid, fracture)


def farthest_move(points: DataFrame, cell_x: str = "home_x", cell_y: str = "home_y") -> DataFrame:
    """(farthest): the most cells, along either axis, that an enabled point has moved from its home cell; 0 if none."""
    move = F.greatest(F.abs(F.col("cell_x") - F.col(cell_x)), F.abs(F.col("cell_y") - F.col(cell_y)))
    return points.agg(F.coalesce(F.max(F.when(~has(F.col("flags"), S.DISABLED), move)), F.lit(0)).alias("farthest"))


def render_frame(points: DataFrame, m: Material, g: Grid) -> DataFrame:
    """All visualised planes in one aggregation: mass-weighted means, density and status fractions by cell."""
    f = _fe()
    mass = F.col("thickness") * (m.density * g.particle_area)
    flag = lambda bit: has(F.col("flags"), bit).cast("double")
    means = {
        "vx": F.col("velx"), "vy": F.col("vely"), "thickness": F.col("thickness"), "jpinv": F.col("jp_inv"), "p": P.pressure(m, f), "q": P.shear_stress(m, f),
        "strain_eqv": P.equivalent_strain(f), "strain_vm": P.von_mises_strain(f), "ice_strength": F.col("xi"), "gamma_p": F.col("gamma_p"),
        "crushed": flag(S.CRUSH), "cracked": flag(S.CRACKED), "tension": flag(S.TENSION), "shear": flag(S.SHEAR), "crush": flag(S.CRUSH),
    }
    live = points.filter(~has(F.col("flags"), S.DISABLED)).withColumns({f"_{n}": v for n, v in means.items()}).withColumn("_m", mass)
    sums = {"mass": F.col("_m"), "pts_density": F.lit(1.0)} | {n: F.col("_m") * F.col(f"_{n}") for n in means}
    return normalise(scatter(live, sums), "mass", list(means)).withColumn("mass", F.col("mass") / (g.cell * g.cell))


def stencil_grid(cells: DataFrame, g: Grid, fill: dict[str, float]) -> DataFrame:
    return densify(cells, "i", "j", g.size_x, g.size_y, fill)
