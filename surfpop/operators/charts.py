"""UV charts: projection directions, islands and their place in the unit tile."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfpop.functions import geometry as g
from surfpop.operators import graph
from surfpop.operators import mesh as m
from surfpop.session import cut, shuffled, spread_join

MIN_AREA = 1e-12
MAX_NORMALS = 4096


def assign_charts(mesh: m.Mesh, angle: float = 66.0) -> tuple[DataFrame, DataFrame]:
    """Planar charts by face direction: charts(mesh_id, face_id, chart_id) and corner_uv.

    The largest face of a mesh seeds the first direction: the mean normal of the free
    faces within half the angle. The face worst covered by the directions so far seeds
    the next one, until all lie within the angle. In the end each face takes its best
    direction, the earlier one on a tie. All meshes advance together; a round adds one
    direction to every mesh that still needs one.
    """
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    n = g.triangle_normal(a, b, c)
    tri = m.triangles(mesh).select(
        "mesh_id", "face_id", (g.triangle_area2(a, b, c) / 2.0).alias("area"),
        *[v.alias(f"n{k}") for v, k in zip(n, "xyz")],
    )
    faces = cut(tri.filter(F.col("area") > MIN_AREA).select(
        "mesh_id", "face_id", "area", "nx", "ny", "nz", F.lit(False).alias("taken"),
        F.lit(-2.0).alias("score"), F.lit(0).cast("bigint").alias("chart_id"),
    ))
    half, full = math.cos(math.radians(angle) / 2), math.cos(math.radians(angle))
    normal = g.vec("n")
    seeds = cut(faces.groupBy("mesh_id").agg(
        F.max(F.struct(F.col("area"), (-F.col("face_id")).alias("neg"), *normal)).alias("s")
    ).select("mesh_id", (-F.col("s.neg")).alias("seed"), *[F.col(f"s.n{k}").alias(f"s{k}") for k in "xyz"]))
    directions = None
    for index in range(MAX_NORMALS):
        if seeds.isEmpty():
            break
        grouped = cut(spread_join(faces, seeds, ["mesh_id"], ["face_id"], how="left").select(
            *faces.columns, "seed",
            F.coalesce((F.col("face_id") == F.col("seed"))
                       | (~F.col("taken") & (g.dot(normal, g.vec("s")) > half)), F.lit(False)).alias("joins"),
        ))
        sums = grouped.filter("joins").groupBy("mesh_id").agg(*[F.sum(f"n{k}").alias(f"s{k}") for k in "xyz"])
        size = g.norm(g.vec("s"))
        mean = cut(sums.filter(size > 0.0).select("mesh_id", *[(F.col(f"s{k}") / size).alias(f"p{k}") for k in "xyz"]))
        stored = mean.select("mesh_id", F.lit(index).cast("bigint").alias("chart_id"), "px", "py", "pz")
        directions = stored if directions is None else directions.unionByName(stored)
        fit = g.dot(normal, g.vec("p"))
        better = F.coalesce(fit > F.col("score"), F.lit(False))
        faces = cut(spread_join(grouped, mean, ["mesh_id"], ["face_id"], how="left").select(
            "mesh_id", "face_id", "area", "nx", "ny", "nz", (F.col("taken") | F.col("joins")).alias("taken"),
            F.when(better, fit).otherwise(F.col("score")).alias("score"),
            F.when(better, F.lit(index).cast("bigint")).otherwise(F.col("chart_id")).alias("chart_id"),
        ))
        worst = faces.join(shuffled(seeds.select("mesh_id")), "mesh_id", "left_semi").filter(~F.col("taken")).groupBy("mesh_id").agg(
            F.min(F.struct("score", "area", "face_id", *normal)).alias("s")
        )
        seeds = cut(worst.filter(F.col("s.score") < full).select(
            "mesh_id", F.col("s.face_id").alias("seed"), *[F.col(f"s.n{k}").alias(f"s{k}") for k in "xyz"]
        ))
    else:
        raise RuntimeError("Too many chart directions.")
    charts = mesh.faces.select("mesh_id", "face_id").join(
        shuffled(faces.select("mesh_id", "face_id", "chart_id")), ["mesh_id", "face_id"], "left"
    )
    planar = spread_join(
        m.corners(mesh).join(shuffled(charts), ["mesh_id", "face_id"]), cut(directions), ["mesh_id", "chart_id"], ["face_id"], how="left"
    )
    nx, ny, nz = g.vec("p")
    # In-plane axes: across the world axis that is farthest from the normal, then at right angles to both.
    steep = [F.abs(n) for n in (nx, ny, nz)]
    axis = F.when((steep[0] <= steep[1]) & (steep[0] <= steep[2]), 0).when(steep[1] <= steep[2], 1).otherwise(2)
    ex, ey, ez = (F.when(axis == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(3))
    across = [ey * nz - ez * ny, ez * nx - ex * nz, ex * ny - ey * nx]
    size = F.sqrt(sum(c * c for c in across[1:]) + across[0] * across[0])
    based = planar.withColumns({f"_u{k}": c / size for k, c in zip("xyz", across)})
    bx, by, bz = F.col("_ux"), F.col("_uy"), F.col("_uz")
    vx, vy, vz = ny * bz - nz * by, nz * bx - nx * bz, nx * by - ny * bx
    has = nx.isNotNull()
    uv = based.select(
        "mesh_id", "face_id", F.col("corner").cast("bigint").alias("corner"),
        F.when(has, bx * F.col("x") + by * F.col("y") + bz * F.col("z")).otherwise(F.lit(0.0)).alias("u"),
        F.when(has, vx * F.col("x") + vy * F.col("y") + vz * F.col("z")).otherwise(F.lit(0.0)).alias("v"),
    )
    return charts.select("mesh_id", "face_id", F.coalesce("chart_id", F.lit(0).cast("bigint")).alias("chart_id")), uv


def uv_links(corner_uv: DataFrame, faces: DataFrame) -> DataFrame:
    """Links between faces whose shared side has the same UVs at both ends."""
    uv = corner_uv.groupBy("mesh_id", "face_id").agg(*[
        F.max(F.when(F.col("corner") == k, F.struct("u", "v"))).alias(f"t{k}") for k in range(3)
    ])
    wide = faces.join(shuffled(uv), ["mesh_id", "face_id"])
    sides = []
    for p, q, i, j in (("a", "b", 0, 1), ("b", "c", 1, 2), ("c", "a", 2, 0)):
        ahead = F.col(p) < F.col(q)
        sides.append(F.struct(
            F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"),
            F.when(ahead, F.col(f"t{i}")).otherwise(F.col(f"t{j}")).alias("at_lo"),
            F.when(ahead, F.col(f"t{j}")).otherwise(F.col(f"t{i}")).alias("at_hi"),
        ))
    return wide.select("mesh_id", "face_id", F.explode(F.array(*sides)).alias("link"))


def uv_islands(corner_uv: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, face_id, component): faces joined through sides that agree in UV."""
    return graph.components(faces, uv_links(corner_uv, faces))


def layout_islands(corner_uv: DataFrame, islands: DataFrame, margin: float = 0.002) -> tuple[DataFrame, DataFrame]:
    """One cell of a square grid per island, its box stretched into the cell less a margin.

    Returns corner_uv in the unit tile and charts(mesh_id, face_id, chart_id).
    """
    placed = corner_uv.join(shuffled(islands), ["mesh_id", "face_id"])
    boxes = placed.groupBy("mesh_id", "component").agg(
        F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1")
    )
    ranked = m.compact(boxes.select("mesh_id", "component"), "component", "chart_id")
    count = boxes.groupBy("mesh_id").agg(F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).cast("bigint").alias("side"))
    cells = spread_join(boxes.join(shuffled(ranked), ["mesh_id", "component"]), count, ["mesh_id"], ["component"])
    size = F.lit(1.0) / F.col("side")

    def place(value, low, high, cell):
        span = F.col(high) - F.col(low)
        inner = F.when(span > 0.0, (value - F.col(low)) / span).otherwise(F.lit(0.5))
        return cell * size + margin * size + inner * size * (1.0 - 2.0 * margin)

    side = F.col("side")
    col_i = (F.col("chart_id") % side).cast("double")
    row_i = F.floor(F.col("chart_id") / side).cast("double")
    joined = spread_join(placed, cells, ["mesh_id", "component"], ["face_id"])
    uv = joined.select(
        "mesh_id", "face_id", "corner",
        place(F.col("u"), "u0", "u1", col_i).alias("u"), place(F.col("v"), "v0", "v1", row_i).alias("v"),
    )
    charts = spread_join(islands, ranked, ["mesh_id", "component"], ["face_id"]).select("mesh_id", "face_id", "chart_id")
    return uv, charts
