"""Sources, validation, joins and measures of surfaces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sqlkit as k
from catalog.fixtures import R, r6
from catalog.registry import query
from surfpop.functions import geometry as g
from surfpop.functions import names
from surfpop.operators import checks, graph, region
from surfpop.operators import mesh as m
from surfpop.plans import colors as plan
from surfpop.session import cut, shuffled, work_root
from surfpop.sources import discovery, landmarks, obj, tables

NAMED = fx.FILES_SQL + r""",
fx_named as (select kind, name, regexp_replace(name, '\.(mrk\.json|obj|ply|stl|vtp|fcsv|json|csv|png|jpg|jpeg|tif|tiff|bmp)$', '', 'i') as specimen_id
  from fx_files where name not like '.%' and (
    (kind = 'model' and regexp_matches(lower(name), '\.(obj|ply|stl|vtp)$')) or (kind = 'landmark' and regexp_matches(lower(name), '\.(mrk\.json|fcsv|json|csv)$'))
    or (kind = 'texture' and regexp_matches(lower(name), '\.(png|jpg|jpeg|tif|tiff|bmp)$')))),
fx_ids as (select specimen_id, sum((kind = 'model')::int) as nm, sum((kind = 'landmark')::int) as nl, sum((kind = 'texture')::int) as nt from fx_named group by 1)"""


@query("s1_pair_files", k.with_(NAMED) + """
select specimen_id, problem from (
  select specimen_id, unnest([case when nm > 1 then 'several model files' end, case when nl > 1 then 'several landmark files' end,
    case when nt > 1 then 'several texture files' end, case when nm > 0 and nl = 0 then 'missing landmark' end,
    case when nm = 0 and nl > 0 then 'missing model' end, case when nm > 0 and nt = 0 then 'missing texture' end,
    case when nm = 0 and nl = 0 and nt > 0 then 'extra texture' end]) as problem from fx_ids) where problem is not null
union all select specimen_id, 'paired' from fx_ids where nm > 0 and nl > 0""")
def s1(spark, sf):
    pairs, problems = discovery.pair_files(fx.files(spark, sf), exact_textures=True)
    return problems.unionByName(pairs.select("specimen_id", F.lit("paired").alias("problem")))


@query("s2_parse_obj_faces", k.with_(fx.VERTICES_SQL, fx.FACES_SQL) + " select mesh_id, face_id, a, b, c from fx_faces")
def s2_faces(spark, sf):
    return obj.parse_obj(fx.obj_lines(spark, sf))[0].faces


@query("s2_parse_obj_vertices", k.with_(fx.VERTICES_SQL) + """
select mesh_id, vertex_id, -x as x, -y as y, round(z * 11) as z from fx_vertices""")
def s2_vertices(spark, sf):
    v = obj.parse_obj(fx.obj_lines(spark, sf), axes="LPS")[0].vertices
    return v.select("mesh_id", "vertex_id", "x", "y", "z")


@query("s2_parse_obj_uv", k.with_(fx.MESH_SQL) + " select mesh_id, face_id, corner, x as u, y as v from fx_corners")
def s2_uv(spark, sf):
    return obj.parse_obj(fx.obj_lines(spark, sf))[0].corner_uv.withColumn("corner", F.col("corner").cast("int"))


def _landmark_texts(lm):
    """The same landmarks as Markups (LPS), FCSV and CSV text, one kind per third of the specimens."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "label", "x", "y", "z")))
    packed = lm.groupBy("specimen_id").agg(ordered.alias("p"))
    kind = F.element_at(F.array(F.lit("json"), F.lit("fcsv"), F.lit("csv")), (F.col("specimen_id") % 3 + 1).cast("int"))
    rows = lambda fn: F.array_join(F.transform("p", fn), "\n")
    s = lambda c: c.cast("string")
    json = F.to_json(F.struct(F.array(F.struct(
        F.lit("Fiducial").alias("type"), F.lit("LPS").alias("coordinateSystem"),
        F.transform("p", lambda q: F.struct(q["label"].alias("label"), F.array(-q["x"], -q["y"], q["z"]).alias("position"), F.lit("defined").alias("positionStatus"))).alias("controlPoints"),
    )).alias("markups")))
    fcsv = F.concat(F.lit("# Markups fiducial file version = 4.11\n# CoordinateSystem = 1\n# columns = id,label,x,y,z\n"),
                    rows(lambda q: F.concat_ws(",", s(q["ord"]), q["label"], s(-q["x"]), s(-q["y"]), s(q["z"]))))
    csv = F.concat(F.lit("z,y,note,label,x\n"), rows(lambda q: F.concat_ws(",", s(q["z"]), s(q["y"]), F.lit('"a, b"'), q["label"], s(q["x"]))))
    return packed.select("specimen_id", kind.alias("kind"), F.when(kind == "json", json).when(kind == "fcsv", fcsv).otherwise(csv).alias("text"))


@query("s3_parse_landmarks", k.with_(fx.LANDMARKS_SQL) + f" select specimen_id, label, ord, {R('x')} as x, {R('y')} as y, {R('z')} as z from fx_landmarks")
def s3(spark, sf):
    lm, _ = landmarks.parse_landmarks(_landmark_texts(fx.landmarks(spark, sf)))
    return lm.select("specimen_id", "label", "ord", *[r6(F.col(n)).alias(n) for n in "xyz"])


# Flattened copies make exactly-flat faces: z is dropped and x folded, so a row of faces closes up.
FLAT = fx.VERTICES_SQL.replace("(n // 12)::double as x", "(case when n // 12 = 5 then 4 else n // 12 end)::double as x")
FLAT = FLAT.replace("((n // 12) * 7", "((case when n // 12 = 5 then 4 else n // 12 end) * 7")


def _folded(spark, sf):
    own = fx.mesh(spark, sf)
    fold = own.vertices.filter("x = 4").select("mesh_id", "y", F.col("z").alias("z4"))
    v = own.vertices.join(fold, ["mesh_id", "y"]).select(
        "mesh_id", "vertex_id", F.when(F.col("x") == 5, 4.0).otherwise(F.col("x")).alias("x"), "y",
        F.when(F.col("x") == 5, F.col("z4")).otherwise(F.col("z")).alias("z"))
    return m.Mesh(v, own.faces, own.corner_uv)


@query("s7_prepare_removed", k.with_(FLAT, fx.FACES_SQL, fx.CORNERS_SQL, k.MEASURES_CTE) + """
select mesh_id, face_id, case when area2 = 0 then -1 else row_number() over (partition by mesh_id, area2 = 0 order by face_id) - 1 end as new_id from fx_measures""")
def s7(spark, sf):
    mesh, removed = m.prepare(_folded(spark, sf), axes="LPS")
    _, face_map = m.renumber_faces(mesh)
    return face_map.unionByName(removed.withColumn("new_id", F.lit(-1).cast("bigint")))


# ------------------------------------------------------------------ validation

@query("v1_finite", """select o_orderkey as row_id from orders where o_orderstatus = 'F' or o_totalprice > 400000""")
def v1(spark, sf):
    o = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", float("nan")).otherwise(F.col("o_totalprice")).alias("x"),
        F.when(F.col("o_totalprice") > 400000, float("inf")).otherwise(0.0).alias("y"))
    return checks.finite_violations(o, ["x", "y"]).select("row_id")


@query("v2_bad_face_refs", k.with_(fx.VERTICES_SQL, fx.FACES_SQL) + """
select mesh_id, face_id, corner::int as corner, vertex_id from (select mesh_id, face_id, unnest([0, 1, 2]) as corner, unnest([a, b, c]) as vertex_id from fx_faces) f
where not exists (select 1 from fx_vertices v where v.mesh_id = f.mesh_id and v.vertex_id = f.vertex_id and v.z > 0.1)""")
def v2(spark, sf):
    own = fx.mesh(spark, sf, uv=False)
    return checks.bad_face_refs(own.faces, own.vertices.filter("z > 0.1d")).select("mesh_id", "face_id", "corner", "vertex_id")


@query("v3_collapsed_faces", """
select l_suppkey as mesh_id, l_orderkey as face_id, l_linenumber as a, l_quantity::bigint as b, l_partkey as c from lineitem
where l_linenumber = l_quantity::bigint or l_quantity::bigint = l_partkey or l_partkey = l_linenumber""")
def v3(spark, sf):
    f = fx.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mesh_id"), F.col("l_orderkey").alias("face_id"),
        F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("bigint").alias("b"), F.col("l_partkey").alias("c"))
    return checks.collapsed_faces(f)


@query("v4_degenerate_faces", k.with_(FLAT, fx.FACES_SQL, fx.CORNERS_SQL, k.MEASURES_CTE) + """
select mesh_id, face_id from fx_measures where area2 < 1e-13""")
def v4(spark, sf):
    return checks.degenerate_faces(_folded(spark, sf))


@query("v5_uv_violations", k.with_(fx.MESH_SQL) + """
select mesh_id, face_id, case when n <> 3 then 'missing' else 'outside' end as problem from (
  select f.mesh_id, f.face_id, count(u.u) as n, coalesce(max((u.v > 0.95e0)::int), 0) as o from fx_faces f
  left join (select * from fx_uv where not (u > 0.95e0 and corner = 2)) u using (mesh_id, face_id) group by 1, 2) where n <> 3 or o = 1""")
def v5(spark, sf):
    own = fx.mesh(spark, sf)
    uv = own.corner_uv.filter(~((F.col("u") > 0.95) & (F.col("corner") == 2))).withColumn("v", F.col("v") + F.lit(0.05))
    return checks.uv_violations(m.Mesh(own.vertices, own.faces, uv))


@query("v6_label_violations", """
select l_suppkey as specimen_id, label, count(*) as n from (
  select l_suppkey, case when l_quantity = 1 then ' ' else 'L' || l_partkey end as label from lineitem) group by 1, 2 having count(*) > 1 or trim(label) = ''""")
def v6(spark, sf):
    lm = fx.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("specimen_id"),
        F.when(F.col("l_quantity") == 1, " ").otherwise(F.concat(F.lit("L"), F.col("l_partkey").cast("string"))).alias("label"))
    return checks.label_violations(lm)


@query("v6_duplicate_specimens", "select c_name as specimen_id, count(*) as n from (select left(c_name, 12) || c_mktsegment as c_name from customer) group by 1 having count(*) > 1")
def v6b(spark, sf):
    return checks.duplicate_specimens(fx.read(spark, sf, "customer").select(F.concat(F.left("c_name", F.lit(12)), "c_mktsegment").alias("specimen_id")))


@query("v7_face_area", k.with_(fx.MESH_SQL, k.MEASURES_CTE) + f" select mesh_id, face_id, {R('area')} as area, {R('area2')} as area2 from fx_measures")
def v7(spark, sf):
    return m.face_measures(fx.mesh(spark, sf, uv=False)).select("mesh_id", "face_id", r6(F.col("area")).alias("area"), r6(F.col("area2")).alias("area2"))


def _shuffled_labels(lm):
    """Later specimens list their landmarks backwards; some lack one or carry another."""
    back = lm.withColumn("ord", F.when(F.col("specimen_id") > 0, fx.MARKS - 1 - F.col("ord")).otherwise(F.col("ord")))
    return back.withColumn("label", F.when((F.col("specimen_id") > 0) & (F.col("x") > 0.35), F.concat(F.col("label"), F.lit("x"))).otherwise(F.col("label")))


SHUFFLED = fx.LANDMARKS_SQL + """,
fx_back as (select specimen_id, case when specimen_id > 0 and x > 0.35e0 then label || 'x' else label end as label, x, y, z from fx_landmarks)"""


@query("v8_label_mismatches", k.with_(SHUFFLED) + """
select specimen_id, label, 'extra' as problem from fx_back where label not in (select label from fx_back where specimen_id = 0)
union all select s.specimen_id, r.label, 'missing' from (select distinct specimen_id from fx_back) s, (select label from fx_back where specimen_id = 0) r
where not exists (select 1 from fx_back b where b.specimen_id = s.specimen_id and b.label = r.label)""")
def v8(spark, sf):
    return checks.label_mismatches(_shuffled_labels(fx.landmarks(spark, sf)))


@query("v8_align_labels", k.with_(SHUFFLED) + f"""
select b.specimen_id, b.label, l.ord, {R('b.x')} as x from fx_back b join (select label, ord from fx_landmarks where specimen_id = 0) l using (label)""")
def v8b(spark, sf):
    return checks.align_labels(_shuffled_labels(fx.landmarks(spark, sf))).select("specimen_id", "label", "ord", r6(F.col("x")).alias("x"))


@query("v9_landmark_rank", k.with_(fx.LANDMARKS_SQL) + """
select specimen_id, count(*) as n, (case when max(abs(y)) <= 0.3e0 then 1 when max(abs(z)) <= 0.35e0 then 2 else 3 end)::bigint as rank
from fx_landmarks group by 1""")
def v9(spark, sf):
    lm = fx.landmarks(spark, sf)
    top = lm.groupBy("specimen_id").agg(F.max(F.abs("y")).alias("my"), F.max(F.abs("z")).alias("mz"))
    flat = lm.join(top, "specimen_id").select("specimen_id", "label", "ord", "x",
        F.when(F.col("my") <= 0.3, F.col("x") * 2.0).otherwise(F.col("y")).alias("y"),
        F.when(F.col("my") <= 0.3, F.col("x") * 3.0).when(F.col("mz") <= 0.35, F.col("x") + F.col("y")).otherwise(F.col("z")).alias("z"))
    return checks.landmark_rank(flat)


@query("v10_duplicate_points", k.with_(fx.LANDMARKS_SQL) + """
select specimen_id, x, y, z, count(*) as n from (select specimen_id, round(x * 4) / 4e0 + 0e0 as x, round(y * 4) / 4e0 + 0e0 as y, round(z * 4) / 4e0 + 0e0 as z from fx_landmarks) group by 1, 2, 3, 4 having count(*) > 1""")
def v10(spark, sf):
    lm = fx.landmarks(spark, sf)
    return checks.duplicate_points(lm.select("specimen_id", *[(F.round(F.col(n) * 4.0) / 4.0 + 0.0).alias(n) for n in "xyz"]))


@query("v11_texture_violations", """
select specimen_id, problem from (select s_suppkey as specimen_id, case when s_acctbal < 0 then 'no texture' when s_acctbal > 9000 then 'file missing'
  when s_nationkey not in (select n_nationkey from nation where n_regionkey > 0) then 'no uv' end as problem from supplier) where problem is not null""")
def v11(spark, sf):
    s, n = fx.read(spark, sf, "supplier"), fx.read(spark, sf, "nation")
    path = F.concat(F.lit("/t/"), F.col("s_suppkey").cast("string"))
    spec = s.select(F.col("s_suppkey").alias("specimen_id"), F.when(F.col("s_acctbal") >= 0, path).alias("texture_path"))
    listed = s.filter("s_acctbal <= 9000").select(path.alias("path"))
    uv = s.join(n.filter("n_regionkey > 0"), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("mesh_id"))
    return checks.texture_violations(spec, listed, uv)


@query("v12_color_violations", k.with_(fx.SAMPLES_SQL) + """
, per as (select specimen_id, count(*) as n, sum((r > 0.98e0)::bigint)::bigint as out_of_range, sum(valid::bigint)::bigint as n_valid from fx_samples group by 1)
select * from per where out_of_range > 0 or n_valid = 0 or n <> (select max(n) from per)""")
def v12(spark, sf):
    return checks.color_violations(fx.samples(spark, sf).withColumn("r", F.when(F.col("r") > 0.98, 1.5).otherwise(F.col("r"))))


@query("v13_fingerprint_topology", k.with_(fx.VERTICES_SQL, fx.FACES_SQL) + """
, f as (select mesh_id, face_id // 1024 as b, sha256(string_agg(concat_ws(',', face_id, a, b, c), ';' order by face_id)) as h from fx_faces group by 1, 2),
g as (select mesh_id, b // 1024 as b, sha256(string_agg(h, ';' order by b)) as h from f group by 1, 2),
t as (select mesh_id, sha256(string_agg(h, ';' order by b)) as h from g group by 1)
select t.mesh_id, sha256(t.h || '|' || n.n) as fingerprint from t join (select mesh_id, count(*) as n from fx_vertices group by 1) n using (mesh_id)""")
def v13(spark, sf):
    own = fx.mesh(spark, sf, uv=False)
    return checks.fingerprint("topology", faces=own.faces, vertices=own.vertices)


@query("v13_fingerprint_sampling", """
with s as (select l_suppkey as mesh_id, l_orderkey * 8 + l_linenumber as sample_id, max(l_partkey) as face_id from lineitem group by 1, 2),
f as (select mesh_id, sample_id // 1024 as b, sha256(string_agg(concat_ws(',', sample_id, face_id), ';' order by sample_id)) as h from s group by 1, 2),
g as (select mesh_id, b // 1024 as b, sha256(string_agg(h, ';' order by b)) as h from f group by 1, 2)
select mesh_id, sha256(string_agg(h, ';' order by b)) as fingerprint from g group by 1""")
def v13b(spark, sf):
    s = fx.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("mesh_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id")).agg(F.max("l_partkey").alias("face_id"))
    return checks.fingerprint("sampling", samples=s)


@query("v13_fingerprint_content")
def v13c(spark, sf):
    own = fx.mesh(spark, sf)
    return checks.fingerprint("content", faces=own.faces, vertices=own.vertices, corner_uv=own.corner_uv, landmarks=fx.marks(spark, sf))


@query("v17_population_textures", fx.FILES_SQL.join(["with ", ""]) + r"""
select name from fx_files where regexp_matches(lower(name), '\.(png|jpg|jpeg|tif|tiff|bmp)$') and not regexp_matches(lower(name), '^(average|mean)_texture') and name not like '.%'""")
def v17(spark, sf):
    return checks.population_textures(fx.files(spark, sf)).select("name")


# ------------------------------------------------------------------ joins and measures

@query("j1_corners", k.with_(fx.MESH_SQL) + f" select mesh_id, face_id, corner::int as corner, vertex_id, {R('x')} as x, {R('y')} as y, {R('z')} as z from fx_corners")
def j1(spark, sf):
    return m.corners(fx.mesh(spark, sf, uv=False)).select("mesh_id", "face_id", "corner", "vertex_id", *[r6(F.col(n)).alias(n) for n in "xyz"])


@query("j2_adjacency", k.with_(fx.VERTICES_SQL, fx.FACES_SQL, k.ADJACENCY_CTE) + " select mesh_id, face_id, nbr_id from fx_adj")
def j2(spark, sf):
    return graph.adjacency(fx.faces(spark, sf))


@query("a1_mean_mesh", k.with_(fx.VERTICES_SQL) + f" select vertex_id, {R('avg(x)')} as x, {R('avg(y)')} as y, {R('avg(z)')} as z from fx_vertices group by 1")
def a1(spark, sf):
    from surfpop.operators import align
    v = fx.vertices(spark, sf).withColumnRenamed("mesh_id", "specimen_id")
    return align.mean_mesh(v).select("vertex_id", *[r6(F.col(n)).alias(n) for n in "xyz"])


@query("a6_face_centers", k.with_(fx.MESH_SQL, k.MEASURES_CTE) + f" select mesh_id, face_id, {R('mx')} as cx, {R('my')} as cy, {R('mz')} as cz from fx_measures")
def a6(spark, sf):
    return m.face_measures(fx.mesh(spark, sf, uv=False)).select("mesh_id", "face_id", *[r6(F.col(f"c{n}")).alias(f"c{n}") for n in "xyz"])


@query("a6_uv_centroids", k.with_(fx.MESH_SQL) + f" select mesh_id, face_id, {R('avg(u)')} as u, {R('avg(v)')} as v from fx_uv group by 1, 2")
def a6b(spark, sf):
    return m.uv_centroids(fx.mesh(spark, sf).corner_uv).select("mesh_id", "face_id", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("a7_sample_areas", k.with_(fx.MESH_SQL, k.MEASURES_CTE) + f" select mesh_id, face_id // 7 as sample_id, {R('sum(area)')} as area from fx_measures group by 1, 2")
def a7(spark, sf):
    own = cut(m.face_measures(fx.mesh(spark, sf, uv=False)))
    nearest = own.select("mesh_id", "face_id", F.floor(F.col("face_id") / 7).alias("sample_id"))
    return plan.sample_areas(nearest, own).withColumn("area", r6(F.col("area")))


@query("a16_bounding_box", """
select l_suppkey as mesh_id, min(l_quantity) as lox, max(l_quantity) as hix, min(l_discount * 100) as loy, max(l_discount * 100) as hiy, min(l_linenumber)::double as loz, max(l_linenumber)::double as hiz,
  count(*) as n_vertices, (case when max(l_quantity) - min(l_quantity) <= least(max(l_discount * 100) - min(l_discount * 100), max(l_linenumber) - min(l_linenumber)) then 0
  when max(l_discount * 100) - min(l_discount * 100) <= max(l_linenumber) - min(l_linenumber) then 1 else 2 end)::bigint as short_axis from lineitem group by 1""")
def a16(spark, sf):
    v = fx.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mesh_id"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    return m.bounding_box(v).drop("diagonal")


@query("w1_compact", """
select l_suppkey as mesh_id, l_orderkey as old_id, row_number() over (partition by l_suppkey order by l_orderkey) - 1 as new_id from (select distinct l_suppkey, l_orderkey from lineitem)""")
def w1(spark, sf):
    ids = fx.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mesh_id"), F.col("l_orderkey").alias("old_id")).distinct()
    return m.compact(ids, "old_id").select("mesh_id", "old_id", "new_id")


@query("w3_component_seeds", k.with_(fx.MESH_SQL, k.MEASURES_CTE) + """
select mesh_id, face_id // 30 as component, arg_max(face_id, round(area, 9) * 1e6 - face_id / 1e4) as face_id from fx_measures group by 1, 2""")
def w3(spark, sf):
    own = m.face_measures(fx.mesh(spark, sf, uv=False)).withColumn("area", F.round("area", 9))
    return graph.component_seeds(own, own.select("mesh_id", "face_id", F.floor(F.col("face_id") / 30).alias("component")))


# ------------------------------------------------------------------ remap, extract, sets

MERGED = """
fx_rep as (select mesh_id, vertex_id, case when vertex_id % 12 = 1 then vertex_id - 1 else vertex_id end as rep_id from fx_vertices)"""


def _merged(spark, sf):
    return fx.vertices(spark, sf).select("mesh_id", "vertex_id", F.when(F.col("vertex_id") % 12 == 1, F.col("vertex_id") - 1).otherwise(F.col("vertex_id")).alias("rep_id"))


REMAP = k.with_(fx.VERTICES_SQL, fx.FACES_SQL, MERGED) + """
, mapped as (select mesh_id, face_id, max(case when corner = 0 then rep_id end) as na, max(case when corner = 1 then rep_id end) as nb, max(case when corner = 2 then rep_id end) as nc, bool_or(vertex_id <> rep_id) as changed
  from (select mesh_id, face_id, unnest([0, 1, 2]) as corner, unnest([a, b, c]) as vertex_id from fx_faces) join fx_rep using (mesh_id, vertex_id) group by 1, 2),
live as (select *, list_sort([na, nb, nc]) as key from mapped where not (changed and (na = nb or nb = nc or nc = na))),
placed as (select *, case when changed then coalesce(min(case when not changed then face_id end) over (partition by mesh_id, key), min(face_id) over (partition by mesh_id, key)) else face_id end as target from live),
kept as (select mesh_id, face_id, na, nb, nc, row_number() over (partition by mesh_id order by face_id) - 1 as new_id from placed where target = face_id)"""


@query("g7_remap_faces", REMAP + " select mesh_id, new_id as face_id, na as a, nb as b, nc as c from kept")
def g7(spark, sf):
    return m.remap_faces(fx.faces(spark, sf), _merged(spark, sf))[0]


@query("g7_face_map", REMAP + """
select f.mesh_id, f.face_id, coalesce(t.new_id, -1) as new_id from fx_faces f left join
  (select p.mesh_id, p.face_id, kk.new_id from placed p join kept kk on kk.mesh_id = p.mesh_id and kk.face_id = p.target) t using (mesh_id, face_id)""")
def g7b(spark, sf):
    return m.remap_faces(fx.faces(spark, sf), _merged(spark, sf))[1]


PICKED = k.with_(fx.MESH_SQL, k.MEASURES_CTE) + """
, sel as (select mesh_id, face_id from fx_measures where mz > 0.5e0 and mz <> 0.5e0),
vm as (select mesh_id, vertex_id, row_number() over (partition by mesh_id order by vertex_id) - 1 as new_id from (select distinct mesh_id, vertex_id from fx_corners join sel using (mesh_id, face_id)))"""


def _extracted(spark, sf):
    own = fx.mesh(spark, sf)
    sel = cut(m.face_measures(own).filter("cz > 0.5d").select("mesh_id", "face_id"))
    return m.extract(own, sel)


@query("g9_extract_vertices", PICKED + f" select vm.mesh_id, vm.new_id as vertex_id, {R('x')} as x, {R('y')} as y, {R('z')} as z from vm join fx_vertices using (mesh_id, vertex_id)")
def g9(spark, sf):
    return _extracted(spark, sf)[0].vertices.select("mesh_id", "vertex_id", *[r6(F.col(n)).alias(n) for n in "xyz"])


@query("g9_extract_faces", PICKED + """
, fm as (select mesh_id, face_id, row_number() over (partition by mesh_id order by face_id) - 1 as new_id from sel)
select fm.mesh_id, fm.new_id as face_id, max(case when corner = 0 then vm.new_id end) as a, max(case when corner = 1 then vm.new_id end) as b, max(case when corner = 2 then vm.new_id end) as c
from fx_corners c join fm using (mesh_id, face_id) join vm on vm.mesh_id = c.mesh_id and vm.vertex_id = c.vertex_id group by 1, 2""")
def g9b(spark, sf):
    return _extracted(spark, sf)[0].faces


@query("e1_union_selection", """
select l_suppkey as mesh_id, l_orderkey as vertex_id from lineitem where l_quantity > 40 union select l_suppkey, l_orderkey from lineitem where l_discount > 0.08""")
def e1(spark, sf):
    li = fx.read(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "mesh_id", "l_orderkey": "vertex_id"})
    pick = lambda cond: li.filter(cond).select("mesh_id", "vertex_id")
    return region.union_selection(pick("l_quantity > 40"), pick("l_discount > 0.08d"))


@query("e2_pairing_report", k.with_(NAMED) + """
, mo as (select distinct specimen_id from fx_named where kind = 'model'), la as (select distinct specimen_id from fx_named where kind = 'landmark'), te as (select distinct specimen_id from fx_named where kind = 'texture')
select specimen_id, 'missing landmark' as problem from (from mo except from la) union all select specimen_id, 'extra landmark' from (from la except from mo)
union all select specimen_id, 'missing texture' from (from mo except from te) union all select specimen_id, 'extra texture' from (from te except from mo)""")
def e2(spark, sf):
    named = discovery.identify(fx.files(spark, sf))
    part = lambda kind: named.filter(F.col("kind") == kind)
    return region.pairing_report(part("model"), part("landmark"), part("texture"))


# ------------------------------------------------------------------ scalar geometry

@query("f1_lps_to_ras", f"select l_orderkey, l_linenumber, {R('-l_quantity')} as x, {R('-l_discount')} as y, {R('l_tax')} as z from lineitem")
def f1(spark, sf):
    x, y, z = g.lps_to_ras(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"))


@query("f10_normals", k.with_(fx.MESH_SQL, k.MEASURES_CTE) + f"""
, n as (select *, ("by" - ay) * (cz - az) - (bz - az) * (cy - ay) as px, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as py, (bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax) as pz from fx_tri)
select mesh_id, face_id, {R('px / sqrt(px*px + py*py + pz*pz)')} as nx, {R('py / sqrt(px*px + py*py + pz*pz)')} as ny, {R('pz / sqrt(px*px + py*py + pz*pz)')} as nz from n""")
def f10(spark, sf):
    n = g.triangle_normal(g.vec("a"), g.vec("b"), g.vec("c"))
    return m.triangles(fx.mesh(spark, sf, uv=False)).select("mesh_id", "face_id", *[r6(c).alias(f"n{a}") for c, a in zip(n, "xyz")])


# Rotation by 3-4-5 angles about z, then x; scale and shift from the row.
@query("f11_similarity", f"""select l_orderkey, l_linenumber, l_partkey, {R('(1 + l_tax) * (l_quantity * 0.6e0 - l_discount * 0.8e0) + 1')} as x, {R('(1 + l_tax) * (l_quantity * 0.8e0 + l_discount * 0.6e0) + 2')} as y, {R('(1 + l_tax) * l_linenumber + 3')} as z from lineitem""")
def f11(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    r = F.array(*[F.lit(v) for v in (0.6, 0.8, 0.0, -0.8, 0.6, 0.0, 0.0, 0.0, 1.0)])
    t = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    p = g.similarity_transform((F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber").cast("double")), r, t, F.col("l_tax") + 1.0)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(n) for c, n in zip(p, "xyz")])




@query("f12_barycentric", f"""
with p as (select l_orderkey, l_linenumber, l_partkey, l_quantity / 50e0 as px, l_discount * 10e0 as py from lineitem),
w as (select *, greatest(0e0, least(1e0, 1e0 - px / 2e0 - py / 3e0)) as a, greatest(0e0, least(1e0, px / 2e0)) as b, greatest(0e0, least(1e0, py / 3e0)) as c from p)
select l_orderkey, l_linenumber, l_partkey, {R('a / (a + b + c)')} as w0, {R('b / (a + b + c)')} as w1, {R('c / (a + b + c)')} as w2, true as usable from w""")
def f12(spark, sf):
    p = (F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.lit(0.0))
    zero = F.lit(0.0)
    w0, w1, w2, ok = g.barycentric(p, (zero, zero, zero), (F.lit(2.0), zero, zero), (zero, F.lit(3.0), zero))
    return fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(w0).alias("w0"), r6(w1).alias("w1"), r6(w2).alias("w2"), ok.alias("usable"))


@query("f13_image_position", f"""select l_orderkey, l_linenumber, l_partkey, {R('greatest(0, least(63, l_quantity / 50e0 * 64 - 0.5e0))')} as x, {R('greatest(0, least(31, (1 - l_discount * 10e0) * 32 - 0.5e0))')} as y from lineitem""")
def f13(spark, sf):
    x, y = g.image_position(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.lit(64.0), F.lit(32.0))
    return fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(x).alias("x"), r6(y).alias("y"))


@query("f14_repeat_taps", f"""
with p as (select l_orderkey, l_linenumber, l_partkey, (l_quantity / 20e0 - 1.013e0) * 16 - 0.5e0 as x, (l_discount * 30e0 - 1.017e0) * 8 - 0.5e0 as y from lineitem),
t as (select *, floor(x)::bigint as x0, floor(y)::bigint as y0, unnest([0, 1, 0, 1]) as dx, unnest([0, 0, 1, 1]) as dy from p)
select l_orderkey, l_linenumber, l_partkey, (((x0 + dx) % 16) + 16) % 16 as px, 7 - (((y0 + dy) % 8) + 8) % 8 as py, {R('(case when dx = 1 then x - x0 else 1 - (x - x0) end) * (case when dy = 1 then y - y0 else 1 - (y - y0) end)')} as w from t""")
def f14(spark, sf):
    taps = g.repeat_taps(F.col("l_quantity") / 20.0 - 1.013, F.col("l_discount") * 30.0 - 1.017, 16, 8)
    return fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(taps).alias("t")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "t.px", "t.py", r6(F.col("t.w")).alias("w"))


@query("f17_segment_distance", f"""
with p as (select l_orderkey, l_linenumber, l_partkey, l_quantity as x, l_discount * 100 as y from lineitem),
t as (select *, greatest(0e0, least(1e0, ((x - 5) * 20 + (y - 2) * 5) / 425e0)) as t from p)
select l_orderkey, l_linenumber, l_partkey, {R('sqrt(power(x - 5 - 20 * t, 2) + power(y - 2 - 5 * t, 2))')} as d from t""")
def f17(spark, sf):
    d = g.segment_distance((F.col("l_quantity"), F.col("l_discount") * 100.0), (F.lit(5.0), F.lit(2.0)), (F.lit(25.0), F.lit(7.0)))
    return fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(d).alias("d"))


@query("f19_feature_names", k.with_(fx.FEATURES_SQL) + """
select distinct feature_name, feature_id // 3 as face_id, (['L', 'a', 'b'])[feature_id % 3 + 1] as channel, 'cluster_' || feature_id || '.area_l2' as area_name from fx_features""")
def f19(spark, sf):
    f = fx.features(spark, sf)
    built = names.color_feature(F.floor(F.col("feature_id") / 3), F.get(F.array(F.lit("L"), F.lit("a"), F.lit("b")), (F.col("feature_id") % 3).cast("int")))
    return f.select(built.alias("feature_name"), names.feature_face(F.col("feature_name")).alias("face_id"),
                    names.feature_channel(F.col("feature_name")).alias("channel"), names.area_feature(F.col("feature_id"), "l2").alias("area_name")).distinct()


@query("f20_stems", k.with_(NAMED) + " select kind, name, specimen_id from fx_named")
def f20(spark, sf):
    return discovery.identify(fx.files(spark, sf)).select("kind", "name", "specimen_id")


# ------------------------------------------------------------------ sinks, read back


def _new_folder(spark, name):
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def _written_mesh(spark, sf):
    path = _new_folder(spark, "obj")
    obj.write_obj(fx.mesh(spark, sf), path)
    return obj.read_obj(spark, path)


@query("s8_write_obj_vertices", k.with_(fx.VERTICES_SQL) + " select mesh_id, vertex_id, x, y, z from fx_vertices")
def s8(spark, sf):
    """Coordinates survive the text to the last bit."""
    return _written_mesh(spark, sf).vertices.withColumn("mesh_id", F.col("mesh_id").cast("bigint")).select("mesh_id", "vertex_id", "x", "y", "z")


@query("s8_write_obj_uv", k.with_(fx.MESH_SQL) + " select mesh_id, face_id, corner, a, b, c, u, v from fx_uv join fx_faces using (mesh_id, face_id)")
def s8b(spark, sf):
    back = _written_mesh(spark, sf)
    both = back.corner_uv.join(shuffled(back.faces), ["mesh_id", "face_id"])
    return both.withColumn("mesh_id", F.col("mesh_id").cast("bigint")).select("mesh_id", "face_id", "corner", "a", "b", "c", "u", "v")


@query("s9_write_landmarks", k.with_(fx.LANDMARKS_SQL) + " select specimen_id, label, ord, x, y, z from fx_landmarks")
def s9(spark, sf):
    path = _new_folder(spark, "marks")
    landmarks.write_landmarks(fx.landmarks(spark, sf), path)
    back = landmarks.read_landmarks(spark, path)
    return back.withColumn("specimen_id", F.col("specimen_id").cast("bigint")).select("specimen_id", "label", "ord", "x", "y", "z")


@query("s10_publish", k.with_(fx.SAMPLES_SQL) + " select specimen_id, sample_id, r * 0.5e0 as r, g, b, valid from fx_samples")
def s10(spark, sf):
    """A table is published, and then replaced by rows that are read from it."""
    path = tables.publish(fx.samples(spark, sf).select("specimen_id", "sample_id", "r", "g", "b", "valid"), _new_folder(spark, "samples"))
    tables.publish(spark.read.parquet(path).withColumn("r", F.col("r") * 0.5), path, overwrite=True)
    return spark.read.parquet(path)
