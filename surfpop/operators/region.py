"""Region selection by a closed curve, and set reports over ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import color as col
from surfpop.functions import geometry as g
from surfpop.operators import checks
from surfpop.operators import mesh as m
from surfpop.operators import spatial
from surfpop.session import cut, shuffled, spread_join

MAX_CURVE = 100_000
MAX_PLAIN = 32  # hull corners that are written out as columns
MARGIN = 0.05  # of the curve's larger extent, and of the mesh's short axis
SIMILAR = 0.7


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the 2-D hull in counter-clockwise order (monotone chain)."""
    pts = sorted({(float(x), float(y)) for x, y in points})

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) >= 2 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0
            ):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def curve_plane(points: np.ndarray):
    """Centre, two in-plane axes, hull corners and margin of a curve."""
    if len(points) < 3 or np.linalg.matrix_rank(points - points.mean(axis=0)) < 2:
        raise ValueError("A curve on one line encloses nothing.")
    centre = points.mean(axis=0)
    basis = np.linalg.eigh((points - centre).T @ (points - centre))[1][:, ::-1].T[:2]
    flat = (points - centre) @ basis.T
    return centre, basis, convex_hull(flat), float(np.ptp(flat, axis=0).max() * MARGIN)


def inside_hull(vertices: DataFrame, centre: np.ndarray, basis: np.ndarray, hull: np.ndarray, margin: float) -> DataFrame:
    """vertices plus ``inside``: within the hull of the curve, or within the margin of its edge."""
    flat = [
        sum((F.col(n) - float(centre[i])) * float(axis[i]) for i, n in enumerate("xyz")) for axis in basis
    ]
    placed = vertices.withColumn("_u", flat[0]).withColumn("_v", flat[1])
    p = (F.col("_u"), F.col("_v"))
    sides = list(zip(hull.tolist(), np.roll(hull, -1, axis=0).tolist()))
    if len(sides) <= MAX_PLAIN:
        # Plain columns are compiled; functions over an array are interpreted for every vertex.
        within, close = F.lit(True), F.lit(False)
        for (ax, ay), (bx, by) in sides:
            within = within & ((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) >= 0.0)
            ends = [tuple(F.lit(v) for v in q) for q in ((ax, ay), (bx, by))]
            close = close | (g.segment_distance(p, *ends) <= margin)
        return placed.withColumn("inside", within | close).drop("_u", "_v")
    # More of them travel as one constant array.
    edges = F.array(*[
        F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*p, *q), ("ax", "ay", "bx", "by"))])
        for p, q in zip(hull, np.roll(hull, -1, axis=0))
    ])
    within = F.forall(edges, lambda e: (
        (e["bx"] - e["ax"]) * (p[1] - e["ay"]) - (e["by"] - e["ay"]) * (p[0] - e["ax"]) >= 0.0
    ))
    close = F.exists(edges, lambda e: g.segment_distance(p, (e["ax"], e["ay"]), (e["bx"], e["by"])) <= margin)
    return placed.withColumn("inside", within | close).drop("_u", "_v")


def same_side(vertices: DataFrame, points: np.ndarray) -> DataFrame:
    """Per mesh: keep vertices on the curve's side of the middle of the shortest box axis."""
    box = m.bounding_box(m_vertices(vertices))
    axis = F.col("short_axis")
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{n}") for n in "xyz"]), (axis + 1).cast("int"))
    curve = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in points])
    sided = box.withColumn("_lo", pick("lo")).withColumn("_hi", pick("hi")).withColumn("_mid", (F.col("_lo") + F.col("_hi")) / 2.0)
    on_high = F.size(F.filter(curve, lambda r: F.element_at(r, (axis + 1).cast("int")) >= F.col("_mid")))
    sided = sided.select("mesh_id", "short_axis", "_lo", "_hi", "_mid",
                         F.when(on_high * 2 >= len(points), 1.0).otherwise(-1.0).alias("_sign"))
    joined = spread_join(vertices, sided, ["mesh_id"], ["vertex_id"])
    here = F.element_at(F.array("x", "y", "z"), (axis + 1).cast("int"))
    keep = (here - F.col("_mid")) * F.col("_sign") >= (F.col("_hi") - F.col("_lo")) * -MARGIN
    return joined.withColumn("inside", F.col("inside") & keep).select(*vertices.columns)


def m_vertices(vertices: DataFrame) -> DataFrame:
    return vertices.select("mesh_id", "vertex_id", "x", "y", "z")


def complete_faces(faces: DataFrame, inside: DataFrame) -> DataFrame:
    """Faces with all corners inside, and whether some are: (mesh_id, face_id, whole, part)."""
    return m.face_corners(faces).join(shuffled(inside.select("mesh_id", "vertex_id", "inside")), ["mesh_id", "vertex_id"]).groupBy(
        "mesh_id", "face_id"
    ).agg(F.bool_and("inside").alias("whole"), F.bool_or("inside").alias("part"))


def reference_colors(points: np.ndarray, vertices: DataFrame, colors: DataFrame) -> DataFrame:
    """Mean and spread of the vertex colours nearest to the curve points, per mesh."""
    curve = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("query_id"), *[F.lit(float(v)).alias(f"q{n}") for v, n in zip(row, "xyz")])
        for i, row in enumerate(points)
    ])
    queries = vertices.select("mesh_id").distinct().select("mesh_id", F.explode(curve).alias("s")).select("mesh_id", "s.*")
    near = spatial.nearest_vertex(queries, vertices)
    return near.join(shuffled(colors), ["mesh_id", "vertex_id"]).groupBy("mesh_id").agg(
        *[F.avg(c).alias(f"m{c}") for c in "rgb"], *[F.stddev_pop(c).alias(f"s{c}") for c in "rgb"]
    )


def refine_by_color(inside: DataFrame, faces: DataFrame, points: np.ndarray, colors: DataFrame) -> DataFrame:
    """On faces the boundary cuts, keep only vertices coloured like the curve."""
    ref = reference_colors(points, m_vertices(inside), colors)
    mixed = complete_faces(faces, inside).filter(F.col("part") & ~F.col("whole")).select("mesh_id", "face_id")
    edge = m.face_corners(faces).join(shuffled(mixed), ["mesh_id", "face_id"]).select("mesh_id", "vertex_id").distinct().withColumn("_edge", F.lit(True))
    joined = inside.join(shuffled(edge), ["mesh_id", "vertex_id"], "left").join(shuffled(colors), ["mesh_id", "vertex_id"], "left")
    joined = spread_join(joined, ref, ["mesh_id"], ["vertex_id"], how="left")
    like = col.similarity([F.col(c) for c in "rgb"], [F.col(f"m{c}") for c in "rgb"], [F.col(f"s{c}") for c in "rgb"]) >= SIMILAR
    return joined.withColumn("inside", F.col("inside") & (F.col("_edge").isNull() | F.coalesce(like, F.lit(False)))).select(*inside.columns)


def select_region(mesh: m.Mesh, curve: np.ndarray, same_side_only: bool = True, colors: DataFrame | None = None,
                  previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) selected by a curve's buffered convex outline.

    ``curve`` is an (N, 3) array of boundary points; ``colors(mesh_id, vertex_id, r, g, b)``
    refines the boundary; ``previous(mesh_id, vertex_id)`` is a selection to add to.
    """
    points = np.asarray(curve, dtype=float).reshape(-1, 3)
    if len(points) > MAX_CURVE:
        raise ValueError(f"More than {MAX_CURVE} curve points.")
    inside = inside_hull(mesh.vertices, *curve_plane(points))
    if same_side_only:
        inside = same_side(inside, points)
    if colors is not None:
        inside = refine_by_color(cut(inside), mesh.faces, points, colors)
    if previous is not None:
        checks.require_none(
            previous.join(shuffled(mesh.vertices), ["mesh_id", "vertex_id"], "left_anti"), "The previous selection belongs to another mesh."
        )
        before = previous.select("mesh_id", "vertex_id").distinct().withColumn("_was", F.lit(True))
        inside = inside.join(shuffled(before), ["mesh_id", "vertex_id"], "left").withColumn(
            "inside", F.col("inside") | F.col("_was").isNotNull()
        ).drop("_was")
    inside = cut(inside)
    faces = complete_faces(mesh.faces, inside).filter("whole").select("mesh_id", "face_id")
    found = inside.groupBy("mesh_id").agg(F.bool_or("inside").alias("any")).filter(~F.col("any"))
    checks.require_none(found, "The curve selects nothing on a mesh.")
    return inside.filter("inside").select("mesh_id", "vertex_id"), faces


def union_selection(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both selections of one mesh without repeats."""
    return first.unionByName(second).distinct()


def pairing_report(models: DataFrame, landmarks: DataFrame, textures: DataFrame) -> DataFrame:
    """(specimen_id, problem) for ids missing or extra in each list; model ids are the standard."""
    ids = [d.select("specimen_id").distinct() for d in (models, landmarks, textures)]
    out = []
    for have, name in ((ids[1], "landmark"), (ids[2], "texture")):
        out.append(ids[0].join(have, "specimen_id", "left_anti").withColumn("problem", F.lit(f"missing {name}")))
        out.append(have.join(ids[0], "specimen_id", "left_anti").withColumn("problem", F.lit(f"extra {name}")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
