"""Validation as queries: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import geometry as g
from surfpop.functions import names
from surfpop.operators import mesh as m
from surfpop.session import block_digest, row_parts, shuffled

# Fixed value: a triangle is degenerate below 32 float64 spacings of its edge lengths' product.
DEGENERATE = 32 * g.EPS
REF_FACES = 150_000  # faces whose corners one task sorts
RANK_TOLERANCE = 1e-12


def require_none(df: DataFrame, message: str) -> None:
    """Raise when a violation query has rows; shows a few of them."""
    rows = df.limit(3).collect()
    if rows:
        raise ValueError(f"{message} e.g. {[r.asDict() for r in rows]}")


def finite_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        value = F.col(c)
        bad = bad | value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return df.filter(bad)


def bad_face_refs(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Corners without their vertex; both sides are dealt by the number of faces, so a task sorts a bounded share."""
    parts, on = row_parts(faces, REF_FACES), ["mesh_id", "vertex_id"]
    known = vertices.select(*on).repartition(parts, *on)
    return m.face_corners(faces).repartition(parts, *on).join(shuffled(known), on, "left_anti")


def collapsed_faces(faces: DataFrame) -> DataFrame:
    return faces.filter("a = b OR b = c OR c = a")


def degenerate_faces(mesh: m.Mesh) -> DataFrame:
    a, b, c = g.vec("a"), g.vec("b"), g.vec("c")
    limit = g.norm(g.sub(b, a)) * g.norm(g.sub(c, a)) * DEGENERATE
    return m.triangles(mesh).filter(g.triangle_area2(a, b, c) <= limit).select("mesh_id", "face_id")


def uv_violations(mesh: m.Mesh, tile: bool = True) -> DataFrame:
    """Faces without three UV corners and, with ``tile``, corners outside [0, 1]."""
    seen = mesh.corner_uv.groupBy("mesh_id", "face_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max((~F.col("u").between(0.0, 1.0)) | (~F.col("v").between(0.0, 1.0))).alias("outside"),
    )
    joined = mesh.faces.select("mesh_id", "face_id").join(shuffled(seen), ["mesh_id", "face_id"], "left")
    missing = F.coalesce("n", F.lit(0)) != 3
    outside = F.coalesce("outside", F.lit(False)) if tile else F.lit(False)
    return joined.filter(missing | outside).select(
        "mesh_id", "face_id", F.when(missing, "missing").otherwise("outside").alias("problem")
    )


def label_violations(landmarks: DataFrame) -> DataFrame:
    """Repeated or empty labels per specimen."""
    return (
        landmarks.groupBy("specimen_id", "label").agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) | (F.trim("label") == ""))
    )


def duplicate_specimens(specimens: DataFrame) -> DataFrame:
    return specimens.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reference_labels(landmarks: DataFrame, specimen=None) -> DataFrame:
    """(label, ord) of one specimen; the smallest id by default."""
    if specimen is None:
        chosen = landmarks.agg(F.min("specimen_id").alias("s")).scalar()
    else:
        chosen = F.lit(specimen)
    return landmarks.filter(F.col("specimen_id") == chosen).select("label", F.col("ord").alias("ref_ord"))


def label_mismatches(landmarks: DataFrame, specimen=None) -> DataFrame:
    """(specimen_id, label, problem) where a specimen misses a reference label or has another one."""
    ref = reference_labels(landmarks, specimen)
    extra = landmarks.join(ref, "label", "left_anti").select("specimen_id", "label", F.lit("extra").alias("problem"))
    # The label set is small and fixed per study; it rides along as one array per specimen row.
    wanted = ref.agg(F.array_sort(F.collect_set("label")).alias("w")).scalar()
    missing = (
        landmarks.groupBy("specimen_id").agg(F.collect_set("label").alias("have"))
        .select("specimen_id", F.explode(F.array_except(wanted, "have")).alias("label"), F.lit("missing").alias("problem"))
    )
    return extra.unionByName(missing)


def align_labels(landmarks: DataFrame, specimen=None) -> DataFrame:
    """Landmarks renumbered to the reference specimen's label order."""
    ref = reference_labels(landmarks, specimen)
    return landmarks.join(ref, "label").select(
        "specimen_id", "label", F.col("ref_ord").alias("ord"), "x", "y", "z"
    )


def landmark_rank(landmarks: DataFrame) -> DataFrame:
    """Rank of each centred configuration from the principal minors of its scatter matrix."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    s = landmarks.groupBy("specimen_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.covar_pop(p, q).alias(p + q) for p, q in pairs]
    )
    xx, xy, xz, yy, yz, zz = (F.col(p + q) for p, q in pairs)
    trace = xx + yy + zz
    minors = (xx * yy - xy * xy) + (xx * zz - xz * xz) + (yy * zz - yz * yz)
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    rank = (
        F.when((F.col("n") > 1) & (trace > 0.0) & (det > trace * trace * trace * RANK_TOLERANCE), 3)
        .when((trace > 0.0) & (minors > trace * trace * RANK_TOLERANCE), 2)
        .when(trace > 0.0, 1).otherwise(0)
    )
    return s.select("specimen_id", F.col("n").cast("bigint").alias("n"), rank.cast("bigint").alias("rank"))


def duplicate_points(landmarks: DataFrame) -> DataFrame:
    return (
        landmarks.groupBy("specimen_id", "x", "y", "z").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


def texture_violations(specimens: DataFrame, files: DataFrame, uv_meshes: DataFrame) -> DataFrame:
    """Specimens whose texture is not named, not among ``files(path)``, or whose mesh has no UVs."""
    known = files.select(F.col("path").alias("texture_path"), F.lit(True).alias("_file")).distinct()
    mapped = uv_meshes.select(F.col("mesh_id").alias("specimen_id"), F.lit(True).alias("_uv")).distinct()
    out = specimens.join(known, "texture_path", "left").join(mapped, "specimen_id", "left")
    problem = (
        F.when(F.col("texture_path").isNull(), "no texture")
        .when(F.col("_file").isNull(), "file missing")
        .when(F.col("_uv").isNull(), "no uv")
    )
    return out.select("specimen_id", problem.alias("problem")).filter("problem IS NOT NULL")


def color_violations(colors: DataFrame) -> DataFrame:
    """Per specimen: out-of-range colours, no valid sample, or another sample count than most."""
    bad = F.lit(False)
    for c in "rgb":
        bad = bad | ~F.col(c).between(0.0, 1.0) | F.isnan(c)
    per = colors.groupBy("specimen_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad.cast("bigint")).alias("out_of_range"),
        F.sum(F.col("valid").cast("bigint")).alias("n_valid"),
    )
    usual = per.agg(F.max("n").alias("m")).scalar()
    return per.filter((F.col("out_of_range") > 0) | (F.col("n_valid") == 0) | (F.col("n") != usual))


def fingerprint(what: str, *, faces: DataFrame | None = None, corner_uv: DataFrame | None = None,
                vertices: DataFrame | None = None, samples: DataFrame | None = None,
                landmarks: DataFrame | None = None) -> DataFrame:
    """Content hash per mesh: ``topology`` (faces, UVs), ``sampling`` (sample order) or ``content``."""
    def digest(df, position, cols, out):
        return block_digest(df.withColumn("_line", F.concat_ws(",", *cols)), ["mesh_id"], position, "_line", out)

    if what == "sampling":
        return digest(samples, "sample_id", ["sample_id", "face_id"], "fingerprint")
    parts = []
    if what in ("topology", "content"):
        parts.append(digest(faces, "face_id", ["face_id", "a", "b", "c"], "_faces"))
        if corner_uv is not None:
            placed = corner_uv.withColumn("_at", F.col("face_id") * 3 + F.col("corner"))
            parts.append(digest(placed, "_at", ["_at", "u", "v"], "_uv"))
        parts.append(vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).cast("string").alias("_n")))
    if what == "content":
        parts.append(digest(vertices, "vertex_id", ["vertex_id", "x", "y", "z"], "_vertices"))
        if landmarks is not None:
            lm = landmarks.withColumnRenamed("specimen_id", "mesh_id")
            parts.append(digest(lm, "ord", ["ord", "label", "x", "y", "z"], "_landmarks"))
    if not parts:
        raise ValueError("what must be topology, sampling or content.")
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "mesh_id", "left")
    fields = [c for c in out.columns if c != "mesh_id"]
    return out.select("mesh_id", F.sha2(F.concat_ws("|", *fields), 256).alias("fingerprint"))


def assert_same(fingerprints: DataFrame) -> None:
    """Every mesh must have one and the same fingerprint."""
    low, high = fingerprints.agg(F.min("fingerprint"), F.max("fingerprint")).first()
    if low != high:
        raise ValueError("Tables describe different topology or sampling.")


def stale_stats(moments: DataFrame, recomputed: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Specimens whose stored moments no longer match their colours, or that have none stored."""
    fields = ["mean_l", "std_l", "mean_c", "std_c"]
    old = moments.select("specimen_id", *[F.col(f).alias(f"old_{f}") for f in ["n", *fields]])
    both = recomputed.join(old, "specimen_id", "left")
    differs = F.col("old_n").isNull() | (F.col("n") != F.col("old_n"))
    for f in fields:
        differs = differs | (F.abs(F.col(f) - F.col(f"old_{f}")) > F.abs(F.col(f"old_{f}")) * rtol + atol)
    return both.filter(differs).select("specimen_id")


def population_textures(files: DataFrame) -> DataFrame:
    """Image files of specimens: display averages are left out."""
    name = F.col("name")
    return files.filter(
        names.has_suffix(name, names.TEXTURE_SUFFIXES) & ~names.is_hidden(name) & ~names.is_average_texture(name)
    )
