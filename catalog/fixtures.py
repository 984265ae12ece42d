"""Meshes, landmarks, textures, samples and features derived from the driver's tables.

Each fixture exists twice: as a DataFrame and as a SQL common table expression with the
same rows. Sizes follow the source tables; nothing is filtered away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfpop.operators.mesh import Mesh
from surfpop.session import cut, shuffled, wide_parts

SIDE = 12  # vertices along a grid edge
PIXELS = 32  # texture side
VECTOR = 64
MARKS = 22  # landmarks of three coordinates; the vector is read cyclically, so all its entries are used
FEATURES = 66  # 22 faces x L, a, b; the vector is read cyclically


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def R(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0e0)"


def each(n: int, name: str) -> Column:
    return F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias(name)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows that become hundreds each, dealt over all tasks first: their file is one small split."""
    return df.repartition(wide_parts(df.sparkSession), df.columns[0])


# ------------------------------------------------------------------ surfaces

VERTICES_SQL = f"""
fx_vertices as (
  select s_suppkey as mesh_id, n as vertex_id, (n // {SIDE})::double as x, (n % {SIDE})::double as y,
         (((n // {SIDE}) * 7 + (n % {SIDE}) * 13 + s_suppkey * 5) % 11)::double / 11e0 as z
  from supplier, unnest(range({SIDE * SIDE})) t(n))"""

_Q = (SIDE - 1)
FACES_SQL = f"""
fx_faces as (
  select s_suppkey as mesh_id, n as face_id, ci * {SIDE} + cj as a, (ci + 1) * {SIDE} + cj + t as b,
         case when t = 0 then (ci + 1) * {SIDE} + cj + 1 else ci * {SIDE} + cj + 1 end as c
  from (select s_suppkey, n, n % 2 as t, (n // 2) // {_Q} as ci, (n // 2) % {_Q} as cj
        from supplier, unnest(range({2 * _Q * _Q})) t(n)))"""

CORNERS_SQL = """
fx_corners as (
  select mesh_id, face_id, corner, vertex_id, x, y, z from (
    select mesh_id, face_id, unnest([0, 1, 2]) as corner, unnest([a, b, c]) as vertex_id from fx_faces)
  join fx_vertices using (mesh_id, vertex_id)),
fx_tri as (
  select mesh_id, face_id, """ + ", ".join(
    f"max(case when corner = {k} then {axis} end) as \"{name}{axis}\"" for k, name in enumerate("abc") for axis in "xyz"
) + """ from fx_corners group by all)"""

UV_SQL = f"""
fx_uv as (select mesh_id, face_id, corner::bigint as corner, x / {_Q}e0 as u, y / {_Q}e0 as v from fx_corners)"""

MESH_SQL = ",".join([VERTICES_SQL, FACES_SQL, CORNERS_SQL, UV_SQL])


def vertices(spark, sf) -> DataFrame:
    v = dealt(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("mesh_id"))).select("mesh_id", each(SIDE * SIDE, "vertex_id"))
    i, j = F.floor(F.col("vertex_id") / SIDE), F.col("vertex_id") % SIDE
    return v.select(
        "mesh_id", "vertex_id", i.cast("double").alias("x"), j.cast("double").alias("y"),
        (((i * 7 + j * 13 + F.col("mesh_id") * 5) % 11).cast("double") / 11.0).alias("z"),
    )


def faces(spark, sf) -> DataFrame:
    f = dealt(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("mesh_id"))).select("mesh_id", each(2 * _Q * _Q, "face_id"))
    t, q = F.col("face_id") % 2, F.floor(F.col("face_id") / 2)
    i, j = F.floor(q / _Q), q % _Q
    return f.select(
        "mesh_id", "face_id", (i * SIDE + j).alias("a"), ((i + 1) * SIDE + j + t).alias("b"),
        F.when(t == 0, (i + 1) * SIDE + j + 1).otherwise(i * SIDE + j + 1).alias("c"),
    )


def mesh(spark, sf, uv: bool = True) -> Mesh:
    v, f = vertices(spark, sf), faces(spark, sf)
    if not uv:
        return Mesh(v, f)
    from surfpop.operators.mesh import corners
    c = corners(Mesh(v, f))
    return Mesh(v, f, c.select("mesh_id", "face_id", F.col("corner").cast("bigint").alias("corner"),
                               (F.col("x") / float(_Q)).alias("u"), (F.col("y") / float(_Q)).alias("v")))


ATLAS_SQL = MESH_SQL + """,
fx_atlas_v as (select vertex_id, avg(x) as x, avg(y) as y, avg(z) as z from fx_vertices group by 1),
fx_atlas_f as (select distinct face_id, a, b, c from fx_faces),
fx_atlas_uv as (select distinct face_id, corner, u, v from fx_uv)"""


def atlas(spark, sf) -> Mesh:
    """Mean of all grids with the shared faces and UVs."""
    own = mesh(spark, sf)
    return Mesh(*[cut(part.withColumn("mesh_id", F.lit("atlas"))) for part in (
        own.vertices.groupBy("vertex_id").agg(*[F.avg(n).alias(n) for n in "xyz"]),
        own.faces.drop("mesh_id").distinct(),
        own.corner_uv.drop("mesh_id").distinct(),
    )])


# ------------------------------------------------------------------ landmarks

LANDMARKS_SQL = f"""
fx_landmarks as (
  select vec_id as specimen_id, 'L' || lpad(k::varchar, 2, '0') as label, k as ord,
         embedding[k * 3 % {VECTOR} + 1]::double as x, embedding[(k * 3 + 1) % {VECTOR} + 1]::double as y, embedding[(k * 3 + 2) % {VECTOR} + 1]::double as z
  from embeddings, unnest(range({MARKS})) t(k))"""


def landmarks(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("specimen_id"), "embedding", each(MARKS, "ord"))
    at = lambda i: F.get("embedding", ((F.col("ord") * 3 + i) % VECTOR).cast("int")).cast("double")
    return e.select("specimen_id", F.concat(F.lit("L"), F.lpad(F.col("ord").cast("string"), 2, "0")).alias("label"), "ord",
                    at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


# ------------------------------------------------------------------ textures

PIXELS_SQL = f"""
fx_pixels as (
  select s_suppkey as texture_id, n % {PIXELS} as px, n // {PIXELS} as py,
         ((n % {PIXELS} * 37 + n // {PIXELS} * 91 + s_suppkey * 53) % 256)::double / 255e0 as r,
         ((n % {PIXELS} * 11 + n // {PIXELS} * 29 + s_suppkey * 17) % 256)::double / 255e0 as g,
         ((n % {PIXELS} * 5 + n // {PIXELS} * 3 + s_suppkey * 101) % 256)::double / 255e0 as b,
         (case when (n * 7 + s_nationkey * 131) % 499 < 3 then 0 else 1 end)::double as alpha
  from supplier, unnest(range({PIXELS * PIXELS})) t(n))"""


def pixels(spark, sf) -> DataFrame:
    p = dealt(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")).select("*", each(PIXELS * PIXELS, "n"))
    px, py, s = F.col("n") % PIXELS, F.floor(F.col("n") / PIXELS), F.col("s_suppkey")
    channel = lambda i, j, k: ((px * i + py * j + s * k) % 256).cast("double") / 255.0
    return p.select(
        s.alias("texture_id"), px.alias("px"), py.alias("py"), channel(37, 91, 53).alias("r"),
        channel(11, 29, 17).alias("g"), channel(5, 3, 101).alias("b"),
        F.when((F.col("n") * 7 + F.col("s_nationkey") * 131) % 499 < 3, 0.0).otherwise(1.0).alias("alpha"),
    )


# ------------------------------------------------------------------ sampled colours

SAMPLES_SQL = """
fx_samples as (
  select l_suppkey as specimen_id, l_orderkey * 8 + l_linenumber as sample_id, max(l_quantity) / 50e0 as r,
         max(l_discount) * 10e0 as g, max(l_tax) * 100e0 / 8e0 as b, max(l_returnflag) <> 'R' as valid,
         sum(l_extendedprice) as area
  from lineitem group by 1, 2)"""


def samples(spark, sf) -> DataFrame:
    """One colour per order line and supplier: many samples, their ids not shared."""
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("specimen_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id")
    ).agg(
        (F.max("l_quantity") / 50.0).alias("r"), (F.max("l_discount") * 10.0).alias("g"),
        (F.max("l_tax") * 100.0 / 8.0).alias("b"), (F.max("l_returnflag") != "R").alias("valid"),
        F.sum("l_extendedprice").alias("area"),
    )


SHARED_SQL = """
fx_shared as (
  select l_suppkey as specimen_id, l_quantity::bigint as sample_id, max(l_discount) * 10e0 as r,
         avg(l_tax) * 100e0 / 8e0 as g, avg(l_linenumber) / 7e0 as b, avg(l_discount) < 0.0801234e0 as valid,
         cast(floor(avg(l_tax) * 100e0 + 0.013e0) as bigint) as label
  from lineitem group by 1, 2),
fx_areas as (
  select l_quantity::bigint as sample_id, l_quantity::bigint * 2 as face_id, avg(l_extendedprice) as area
  from lineitem group by 1)"""
SHARED_LABELS = 9


def shared(spark, sf) -> DataFrame:
    """Colours with sample ids shared by all specimens, and a coarse cluster label."""
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("specimen_id"), F.col("l_quantity").cast("bigint").alias("sample_id")
    ).agg(
        (F.max("l_discount") * 10.0).alias("r"), (F.avg("l_tax") * 100.0 / 8.0).alias("g"),
        (F.avg("l_linenumber") / 7.0).alias("b"), (F.avg("l_discount") < 0.0801234).alias("valid"),
        F.floor(F.avg("l_tax") * 100.0 + 0.013).alias("label"),
    )


def shared_samples(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("bigint").alias("sample_id")).agg(
        F.avg("l_extendedprice").alias("area")
    ).withColumn("face_id", F.col("sample_id") * 2)


# ------------------------------------------------------------------ features

FEATURES_SQL = f"""
fx_features as (
  select vec_id as specimen_id, j as feature_id,
         'face_' || (j // 3)::varchar || '.' || (['L', 'a', 'b'])[j % 3 + 1] as feature_name,
         embedding[j % 64 + 1]::double as value, label
  from embeddings, unnest(range({FEATURES})) t(j))"""


def features(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", "embedding", "label", each(FEATURES, "j"))
    j = F.col("j")
    return e.select(
        F.col("vec_id").alias("specimen_id"), j.alias("feature_id"),
        F.concat(F.lit("face_"), F.floor(j / 3).cast("string"), F.lit("."),
                 F.get(F.array(F.lit("L"), F.lit("a"), F.lit("b")), (j % 3).cast("int"))).alias("feature_name"),
        F.get("embedding", (j % 64).cast("int")).cast("double").alias("value"), "label",
    )


# ------------------------------------------------------------------ files and text

FILES_SQL = """
fx_files as (
  select 'model' as kind, 'S' || s_suppkey || '.obj' as name from supplier
  union all select 'landmark', 'S' || s_suppkey || '.mrk.json' from supplier
  union all select 'texture', 'S' || s_suppkey || '.PNG' from supplier where s_acctbal >= 0
  union all select 'model', 'C' || n_nationkey || '.stl' from nation
  union all select 'texture', 'average_texture_' || n_name || '.png' from nation
  union all select 'landmark', 'S' || s_suppkey || '.csv' from supplier where s_acctbal > 9000
  union all select 'model', '.hidden' || n_nationkey || '.obj' from nation
  union all select 'model', 'notes' || n_nationkey || '.txt' from nation)"""


def files(spark, sf) -> DataFrame:
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    name = lambda df, kind, pre, key, post: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(pre), F.col(key).cast("string"), F.lit(post)).alias("name"))
    parts = [
        name(s, "model", "S", "s_suppkey", ".obj"), name(s, "landmark", "S", "s_suppkey", ".mrk.json"),
        name(s.filter("s_acctbal >= 0"), "texture", "S", "s_suppkey", ".PNG"), name(n, "model", "C", "n_nationkey", ".stl"),
        name(n, "texture", "average_texture_", "n_name", ".png"), name(s.filter("s_acctbal > 9000"), "landmark", "S", "s_suppkey", ".csv"),
        name(n, "model", ".hidden", "n_nationkey", ".obj"), name(n, "model", "notes", "n_nationkey", ".txt"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("path", F.concat(F.lit("/data/"), "kind", F.lit("/"), "name"))


def obj_lines(spark, sf) -> DataFrame:
    """OBJ text of every grid: comments, vt records and negative indices included."""
    own = mesh(spark, sf)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    whole = lambda c: F.col(c).cast("bigint")
    v = own.vertices.select("mesh_id", F.col("vertex_id").alias("pos"), text("v ", whole("x"), " ", whole("y"), " ", F.rint(F.col("z") * 11.0).cast("bigint"), " # vertex").alias("line"))
    vt = own.vertices.select("mesh_id", (F.col("vertex_id") + SIDE * SIDE).alias("pos"), text("vt ", whole("x"), " ", whole("y")).alias("line"))
    f = own.faces.select("mesh_id", (F.col("face_id") + 2 * SIDE * SIDE).alias("pos"), text(
        "f ", F.col("a") + 1, "/", F.col("a") + 1, " ", F.col("b") + 1, "/", F.col("b") - SIDE * SIDE, "  ",
        F.col("c") - SIDE * SIDE, "/", F.col("c") + 1, " # negative indices").alias("line"))
    return v.unionByName(vt).unionByName(f).withColumn("block", F.floor(F.col("pos") / 100))


# ------------------------------------------------------------------ queries against surfaces

POINTS_SQL = f"""
fx_points as (
  select l_suppkey as mesh_id, l_orderkey * 8 + l_linenumber as query_id, max(l_quantity) / 50e0 * 13e0 - 1e0 as qx,
         max(l_discount) * 110e0 as qy, max(l_tax) * 30e0 - 0.5e0 as qz
  from lineitem group by 1, 2)"""


def points(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("mesh_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("query_id")
    ).agg(
        (F.max("l_quantity") / 50.0 * 13.0 - 1.0).alias("qx"), (F.max("l_discount") * 110.0).alias("qy"),
        (F.max("l_tax") * 30.0 - 0.5).alias("qz"),
    )


RAYS_SQL = """
fx_rays as (
  select mesh_id, query_id, qx + 0.013e0 as qx, qy + 0.0071e0 as qy, qz + 3e0 as qz,
         (query_id % 7 - 3)::double / 10e0 / sqrt(1e0 + power((query_id % 7 - 3)::double / 10e0, 2)) as dx, 0e0 as dy,
         -1e0 / sqrt(1e0 + power((query_id % 7 - 3)::double / 10e0, 2)) as dz
  from fx_points)"""


def rays(spark, sf) -> DataFrame:
    tilt = (F.col("query_id") % 7 - 3).cast("double") / 10.0
    size = F.sqrt(F.lit(1.0) + tilt * tilt)
    return points(spark, sf).select(
        "mesh_id", "query_id", (F.col("qx") + 0.013).alias("qx"), (F.col("qy") + 0.0071).alias("qy"), (F.col("qz") + 3.0).alias("qz"),
        (tilt / size).alias("dx"), F.lit(0.0).alias("dy"), (F.lit(-1.0) / size).alias("dz"),
    )


# ------------------------------------------------------------------ landmarks on the grids

MARK_VERTICES = [i * SIDE + j for i in (0, 5, 11) for j in (0, 6, 11)]

MARKS_SQL = f"""
fx_marks as (
  select mesh_id as specimen_id, 'P' || k as label, k as ord, x, y, z
  from (select unnest({MARK_VERTICES}) as vertex_id, unnest(range({len(MARK_VERTICES)})) as k)
  join fx_vertices using (vertex_id))"""


def marks(spark, sf) -> DataFrame:
    """Nine landmarks at fixed grid places of every surface."""
    ids = F.posexplode(F.array(*[F.lit(v).cast("bigint") for v in MARK_VERTICES])).alias("ord", "vertex_id")
    own = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("mesh_id"), ids)
    return own.join(shuffled(vertices(spark, sf)), ["mesh_id", "vertex_id"]).select(
        F.col("mesh_id").alias("specimen_id"), F.concat(F.lit("P"), F.col("ord").cast("string")).alias("label"),
        F.col("ord").cast("bigint").alias("ord"), "x", "y", "z",
    )
