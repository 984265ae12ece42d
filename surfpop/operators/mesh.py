"""Surfaces as tables: gathers, measures, compaction, remapping and extraction.

``vertices(mesh_id, vertex_id, x, y, z)``, ``faces(mesh_id, face_id, a, b, c)`` and
``corner_uv(mesh_id, face_id, corner, u, v)``. Ids carry the order; rows do not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import geometry as g
from surfpop.session import cut, number_rows, shuffled

BLOCK = 65536  # ids per block when numbering


@dataclass(frozen=True)
class Mesh:
    vertices: DataFrame
    faces: DataFrame
    corner_uv: DataFrame | None = None


def face_corners(faces: DataFrame) -> DataFrame:
    """One row per corner: (mesh_id, face_id, corner, vertex_id)."""
    return faces.select(
        "mesh_id", "face_id", F.posexplode(F.array("a", "b", "c")).alias("corner", "vertex_id")
    )


def corners(mesh: Mesh) -> DataFrame:
    """Vertex positions gathered per face corner."""
    return face_corners(mesh.faces).join(shuffled(mesh.vertices), ["mesh_id", "vertex_id"])


def triangles(mesh: Mesh) -> DataFrame:
    """One row per face with its nine coordinates ax..cz."""
    wide = [
        F.max(F.when(F.col("corner") == k, F.col(axis))).alias(f"{name}{axis}")
        for k, name in enumerate("abc") for axis in "xyz"
    ]
    return corners(mesh).groupBy("mesh_id", "face_id").agg(*wide)


def _corner_vectors():
    return g.vec("a"), g.vec("b"), g.vec("c")


def face_measures(mesh: Mesh, tri: DataFrame | None = None) -> DataFrame:
    """Area, doubled area and centre of every face."""
    a, b, c = _corner_vectors()
    area2 = g.triangle_area2(a, b, c)
    return (triangles(mesh) if tri is None else tri).select(
        "mesh_id", "face_id", (area2 / 2.0).alias("area"), area2.alias("area2"),
        *[((a[i] + b[i] + c[i]) / 3.0).alias(f"c{n}") for i, n in enumerate("xyz")],
    )


def uv_centroids(corner_uv: DataFrame) -> DataFrame:
    return corner_uv.groupBy("mesh_id", "face_id").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


def bounding_box(vertices: DataFrame) -> DataFrame:
    """Box, diagonal and shortest axis (0, 1 or 2; the first wins a tie) per mesh."""
    box = vertices.groupBy("mesh_id").agg(
        *[fn(n).alias(f"{tag}{n}") for n in "xyz" for fn, tag in ((F.min, "lo"), (F.max, "hi"))],
        F.count(F.lit(1)).alias("n_vertices"),
    )
    spans = [F.col(f"hi{n}") - F.col(f"lo{n}") for n in "xyz"]
    return box.withColumn("diagonal", F.sqrt(sum(s * s for s in spans))).withColumn(
        "short_axis", (F.array_position(F.array(*spans), F.least(*spans)) - 1).cast("bigint")
    )


def prepare(mesh: Mesh, axes: str = "LPS") -> tuple[Mesh, DataFrame]:
    """RAS mesh without exactly-flat faces, and the removed face ids.

    Ids of what stays are unchanged here; ``renumber_faces`` closes the gaps.
    """
    vertices = mesh.vertices
    if axes == "LPS":
        vertices = vertices.select("mesh_id", "vertex_id", *[
            c.alias(n) for c, n in zip(g.lps_to_ras(F.col("x"), F.col("y"), F.col("z")), "xyz")
        ])
    elif axes != "RAS":
        raise ValueError("axes must be RAS or LPS.")
    moved = Mesh(vertices, mesh.faces, mesh.corner_uv)
    flat = face_measures(moved).filter(F.col("area2") == 0.0).select("mesh_id", "face_id")
    keep = mesh.faces.join(shuffled(flat), ["mesh_id", "face_id"], "left_anti")
    uv = None if mesh.corner_uv is None else mesh.corner_uv.join(shuffled(flat), ["mesh_id", "face_id"], "left_anti")
    return Mesh(vertices, keep, uv), flat


def compact(ids: DataFrame, id_col: str, new_col: str = "new_id", group: tuple = ("mesh_id",)) -> DataFrame:
    """Old id -> new id, in the order of the old ids, from 0 in every group."""
    blocked = ids.select(*group, id_col).withColumn("_block", F.floor(F.col(id_col) / BLOCK))
    return number_rows(blocked, list(group), "_block", [F.col(id_col)], new_col).drop("_block")


def renumber_faces(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """Close gaps in the face ids; returns the mesh and face_map(face_id, new_id)."""
    face_map = compact(mesh.faces, "face_id")
    key = ["mesh_id", "face_id"]
    faces = mesh.faces.join(shuffled(face_map), key).select("mesh_id", F.col("new_id").alias("face_id"), "a", "b", "c")
    uv = None
    if mesh.corner_uv is not None:
        uv = mesh.corner_uv.join(shuffled(face_map), key).select(
            "mesh_id", F.col("new_id").alias("face_id"), "corner", "u", "v"
        )
    return Mesh(mesh.vertices, faces, uv), face_map


def map_corners(faces: DataFrame, vertex_map: DataFrame) -> DataFrame:
    """Replace corner ids through vertex_map(mesh_id, vertex_id, new_id); one join."""
    moved = face_corners(faces).join(shuffled(vertex_map), ["mesh_id", "vertex_id"])
    return moved.groupBy("mesh_id", "face_id").agg(*[
        F.max(F.when(F.col("corner") == k, F.col("new_id"))).alias(n) for k, n in enumerate("abc")
    ])


def remap_faces(faces: DataFrame, representatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces after a vertex merge, and face_map(mesh_id, face_id, new_id) with -1 for dropped ones.

    A face that changed and collapsed is dropped. A changed face that now has the
    corners of another face is folded into the first such face. Faces the merge did
    not touch always stay, even where the input already held copies.
    """
    rep = representatives.select("mesh_id", "vertex_id", F.col("rep_id").alias("new_id"))
    mapped = map_corners(faces, rep).select("mesh_id", "face_id", *[F.col(n).alias(f"n{n}") for n in "abc"])
    both = faces.join(shuffled(mapped), ["mesh_id", "face_id"]).withColumn(
        "changed", (F.col("a") != F.col("na")) | (F.col("b") != F.col("nb")) | (F.col("c") != F.col("nc"))
    ).withColumn(
        "flat", (F.col("na") == F.col("nb")) | (F.col("nb") == F.col("nc")) | (F.col("nc") == F.col("na"))
    ).withColumn("key", F.array_sort(F.array("na", "nb", "nc")))
    live = both.filter(~(F.col("changed") & F.col("flat")))
    # An untouched face owns its corners; among changed faces the smallest id does.
    owner = live.groupBy("mesh_id", "key").agg(
        F.min(F.when(~F.col("changed"), F.col("face_id"))).alias("still"),
        F.min("face_id").alias("first"),
    ).select("mesh_id", "key", F.coalesce("still", "first").alias("owner"))
    placed = cut(live.join(shuffled(owner), ["mesh_id", "key"]).select(
        "mesh_id", "face_id", "na", "nb", "nc",
        F.when(F.col("changed"), F.col("owner")).otherwise(F.col("face_id")).alias("target"),
    ))
    kept = placed.filter(F.col("target") == F.col("face_id"))
    new_ids = compact(kept, "face_id")
    out = kept.join(shuffled(new_ids), ["mesh_id", "face_id"]).select(
        "mesh_id", F.col("new_id").alias("face_id"),
        F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c"),
    )
    targets = placed.select("mesh_id", "face_id", F.col("target").alias("_t")).join(
        shuffled(new_ids.select("mesh_id", F.col("face_id").alias("_t"), "new_id")), ["mesh_id", "_t"]
    ).drop("_t")
    face_map = faces.select("mesh_id", "face_id").join(shuffled(targets), ["mesh_id", "face_id"], "left").select(
        "mesh_id", "face_id", F.coalesce("new_id", F.lit(-1).cast("bigint")).alias("new_id")
    )
    return out, face_map


def extract(mesh: Mesh, selected: DataFrame) -> tuple[Mesh, DataFrame, DataFrame]:
    """Submesh of the selected faces with old->new vertex and face maps; UVs go along.

    ``selected`` holds (mesh_id, face_id).
    """
    faces = mesh.faces.join(shuffled(selected.select("mesh_id", "face_id").distinct()), ["mesh_id", "face_id"], "left_semi")
    used = face_corners(faces).select("mesh_id", "vertex_id").distinct()
    vertex_map = compact(used, "vertex_id")
    face_map = compact(faces, "face_id")
    vertices = mesh.vertices.join(shuffled(vertex_map), ["mesh_id", "vertex_id"]).select(
        "mesh_id", F.col("new_id").alias("vertex_id"), "x", "y", "z"
    )
    out_faces = map_corners(faces, vertex_map).join(shuffled(face_map), ["mesh_id", "face_id"]).select(
        "mesh_id", F.col("new_id").alias("face_id"), "a", "b", "c"
    )
    uv = None
    if mesh.corner_uv is not None:
        uv = mesh.corner_uv.join(shuffled(face_map), ["mesh_id", "face_id"]).select(
            "mesh_id", F.col("new_id").alias("face_id"), "corner", "u", "v"
        )
    return Mesh(vertices, out_faces, uv), vertex_map, face_map
