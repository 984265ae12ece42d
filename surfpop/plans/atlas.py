"""From specimens to a mean surface, resampled specimens and transferred textures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfpop.functions import color as col
from surfpop.operators import align, charts, checks, texture
from surfpop.operators import mesh as m
from surfpop.operators import weld as w
from surfpop.session import cut
from surfpop.sources import discovery, images, landmarks, obj

ATLAS = "atlas"


@dataclass(frozen=True)
class AtlasOptions:
    axes: str = "LPS"
    scale: bool = False
    merge_distance: float = 0.0001
    uv_angle: float = 66.0
    island_margin: float = 0.002
    texture_size: int = 2048
    extrusion: float = 0.001
    max_dist: float = 0.0
    margin: int = 2
    method: str = "common"
    limit: float | None = None


@dataclass(frozen=True)
class AtlasResult:
    mesh: m.Mesh  # mesh_id = 'atlas', with corner_uv
    landmarks: DataFrame
    charts: DataFrame
    aligned: m.Mesh
    resampled: DataFrame
    texels: DataFrame | None  # byte texels per specimen
    average: DataFrame | None


def load_specimens(spark: SparkSession, root: str, axes: str = "LPS"):
    """(mesh, landmarks, pixels, removed faces) of a dataset folder, checked and in RAS."""
    specimens = discovery.discover(spark, root)
    checks.require_none(specimens.filter(~F.lower("mesh_path").endswith(".obj")), "Only OBJ meshes can be read.")
    raw = obj.read_obj(spark, f"{root}/models")
    mesh, removed = m.prepare(raw, axes)
    mesh, _ = m.renumber_faces(m.Mesh(cut(mesh.vertices), cut(mesh.faces), cut(mesh.corner_uv)))
    bare = specimens.join(mesh.faces.select(F.col("mesh_id").alias("specimen_id")), "specimen_id", "left_anti")
    checks.require_none(bare, "A specimen has no faces left.")
    marks = cut(landmarks.read_landmarks(spark, f"{root}/landmarks"))
    mesh = m.Mesh(mesh.vertices, cut(mesh.faces), cut(mesh.corner_uv))
    files = discovery.list_files(spark, f"{root.rstrip('/')}/textures", "texture")
    checks.require_none(checks.texture_violations(specimens, files, mesh.corner_uv), "Texture or UVs missing.")
    return mesh, marks, images.read_pixels(spark, f"{root}/textures"), removed


def validate(mesh: m.Mesh, marks: DataFrame) -> DataFrame:
    """Fail before expensive work; returns landmarks in the common label order."""
    checks.require_none(checks.finite_violations(mesh.vertices, ["x", "y", "z"]), "Coordinates must be finite.")
    checks.require_none(checks.bad_face_refs(mesh.faces, mesh.vertices), "Face index out of range.")
    checks.require_none(checks.collapsed_faces(mesh.faces), "Faces need three distinct corners.")
    checks.require_none(checks.degenerate_faces(mesh), "Degenerate faces.")
    checks.require_none(checks.label_violations(marks), "Labels must be unique and nonempty.")
    checks.require_none(checks.label_mismatches(marks), "Specimens need the same labels.")
    ordered = checks.align_labels(marks)
    checks.require_none(checks.landmark_rank(ordered).filter("n < 3 OR rank < 2"), "Three noncollinear landmarks needed.")
    checks.require_none(checks.duplicate_points(ordered), "Two landmarks share a position.")
    return ordered


def check_surface(mesh: m.Mesh, when: str) -> None:
    """A surface to chart and sample: at least one face and none degenerate."""
    if mesh.faces.isEmpty():
        raise ValueError(f"No faces left {when}.")
    checks.require_none(checks.degenerate_faces(mesh), f"Degenerate faces {when}.")


def validate_atlas(mesh: m.Mesh, marks: DataFrame, specimens: DataFrame) -> None:
    """A supplied atlas passes the checks of a specimen and has the specimens' labels."""
    checks.require_none(checks.finite_violations(mesh.vertices, ["x", "y", "z"]), "Atlas coordinates must be finite.")
    checks.require_none(checks.bad_face_refs(mesh.faces, mesh.vertices), "Atlas face index out of range.")
    checks.require_none(checks.collapsed_faces(mesh.faces), "Atlas faces need three distinct corners.")
    check_surface(mesh, "in the supplied atlas")
    checks.require_none(align.label_gaps(specimens, marks, ["label"]), "Specimens need the labels of the supplied atlas.")


def mean_surface(mesh: m.Mesh, marks: DataFrame, scale: bool = False, limit: float | None = None):
    """(atlas mesh, atlas landmarks, alignment) averaged over all specimens."""
    fit = align.gpa(marks, scale)
    _, template, template_marks = align.reference_template(fit, mesh, marks)
    template = m.Mesh(cut(template.vertices), cut(template.faces))
    parts = cut(align.contribute(mesh, marks, fit, template, cut(template_marks), limit))
    vertices = cut(align.mean_mesh(parts).withColumn("mesh_id", F.lit(ATLAS)))
    faces = template.faces.withColumn("mesh_id", F.lit(ATLAS))
    aligned_marks = align.apply_transform(marks, fit.transforms.select("specimen_id", "r", "t", "scale"), "ord")
    return m.Mesh(vertices, faces), cut(align.mean_landmarks(aligned_marks)), fit


def build_atlas(mesh: m.Mesh, marks: DataFrame, pixels: DataFrame | None = None, options: AtlasOptions = AtlasOptions(),
                supplied: tuple[m.Mesh, DataFrame] | None = None) -> AtlasResult:
    """The whole job over all specimens; each step keeps specimen_id as a key.

    ``supplied`` is an atlas mesh (mesh_id 'atlas') with its landmarks, used instead of a
    mean surface.
    """
    marks = cut(validate(mesh, marks))
    if supplied is None:
        surface, atlas_marks, _ = mean_surface(mesh, marks, options.scale, options.limit)
        if options.method == "tps_projection":
            vertices, atlas_marks, _ = align.restore_scale(surface.vertices, atlas_marks, marks)
            surface, atlas_marks = m.Mesh(cut(vertices), surface.faces), cut(atlas_marks)
    else:
        surface, atlas_marks = supplied
        validate_atlas(surface, atlas_marks, marks)
    clean, _, _ = w.weld(surface, options.merge_distance)
    clean = m.Mesh(cut(clean.vertices), cut(clean.faces))
    check_surface(clean, "after merging vertices; a smaller merge distance keeps more")
    _, flat = charts.assign_charts(clean, options.uv_angle)
    flat = cut(flat)
    islands = cut(charts.uv_islands(flat, clean.faces))
    uv, chart_ids = charts.layout_islands(flat, islands, options.island_margin)
    atlas = m.Mesh(clean.vertices, clean.faces, cut(uv))
    fits = cut(align.procrustes(marks, atlas_marks, options.scale))
    aligned, aligned_marks = align.align_mesh(mesh, marks, fits)
    aligned = m.Mesh(cut(aligned.vertices), aligned.faces, aligned.corner_uv)
    resampled = cut(align.resample(
        aligned, cut(aligned_marks), atlas.vertices, atlas_marks,
        atlas_marks if options.method == "common" else None, options.limit, options.method,
    ))
    texels = average = None
    if pixels is not None:
        size = options.texture_size
        texels = cut(texture.transfer_texture(
            aligned, resampled.withColumnRenamed("specimen_id", "mesh_id"), atlas.faces, atlas.corner_uv,
            pixels, size, size, options.extrusion, options.max_dist, options.margin,
        ))
        average = average_texels(texels, resampled.select("specimen_id").distinct().count())
    return AtlasResult(atlas, atlas_marks, chart_ids, aligned, resampled, texels, average)


def average_texels(texels: DataFrame, specimens: int) -> DataFrame:
    """Mean of byte texels over all specimens; a texel a specimen lacks counts as black, uncovered.

    ``specimens`` counts those without any texel too.
    """
    n = F.lit(specimens)
    return texels.groupBy("px", "py").agg(
        *[(F.floor(F.sum(c) / n) / 255.0).alias(c) for c in "rgb"], (F.max("alpha") / 255.0).alias("alpha")
    )


def texel_pixels(texels: DataFrame, width: int, height: int) -> DataFrame:
    """Full pixel tables from sparse byte texels, uncovered ones with alpha 0."""
    grid = texels.select("texture_id").distinct().select(
        "texture_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width * height - 1).cast("bigint"))).alias("k")
    ).select("texture_id", (F.col("k") % width).alias("px"), F.floor(F.col("k") / width).cast("bigint").alias("py"))
    full = grid.join(texels, ["texture_id", "px", "py"], "left")
    return full.select("texture_id", "px", "py", *[
        col.byte_to_unit(F.coalesce(c, F.lit(0).cast("bigint"))).alias(c) for c in ("r", "g", "b", "alpha")
    ])
