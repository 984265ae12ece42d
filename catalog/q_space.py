"""Spatial joins, rasters, charts, regions, alignment and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sqlkit as k
from catalog.fixtures import R, r6
from catalog.registry import query
from surfpop.operators import align, charts, checks, graph, region, spatial, texture, weld
from surfpop.operators import mesh as m
from surfpop.plans import atlas as atlas_plan
from surfpop.session import cut, shuffled

# ------------------------------------------------------------------ nearest, rays

J3 = k.with_(fx.MESH_SQL, fx.POINTS_SQL, "fx_pairs as (select * from fx_points join fx_tri using (mesh_id))", k.closest_cte("fx_pairs", "near"))


@query("j3_nearest_on_surface", J3 + f" select mesh_id, query_id, {R('sqrt(min(d2))')} as dist from near group by 1, 2")
def j3(spark, sf):
    out = spatial.nearest_on_surface(fx.points(spark, sf), m.triangles(fx.mesh(spark, sf, uv=False)))
    return out.select("mesh_id", "query_id", r6(F.sqrt("d2")).alias("dist"))


@query("j4_nearest_vertex", k.with_(fx.VERTICES_SQL, fx.POINTS_SQL) + f"""
select mesh_id, query_id, {R('sqrt(min((x - qx) * (x - qx) + (y - qy) * (y - qy) + (z - qz) * (z - qz)))')} as dist from fx_points join fx_vertices using (mesh_id) group by 1, 2""")
def j4(spark, sf):
    out = spatial.nearest_vertex(fx.points(spark, sf), fx.vertices(spark, sf))
    return out.select("mesh_id", "query_id", r6(F.sqrt("d2")).alias("dist"))


@query("j5_ray_hits", k.with_(fx.MESH_SQL, fx.POINTS_SQL, fx.RAYS_SQL) + f"""
, p as (select *, bx - ax as e1x, "by" - ay as e1y, bz - az as e1z, cx - ax as e2x, cy - ay as e2y, cz - az as e2z, qx - ax as sx, qy - ay as sy, qz - az as sz from fx_rays join fx_tri using (mesh_id)),
h as (select *, dy * e2z - dz * e2y as hx, dz * e2x - dx * e2z as hy, dx * e2y - dy * e2x as hz, sy * e1z - sz * e1y as ox, sz * e1x - sx * e1z as oy, sx * e1y - sy * e1x as oz from p),
d as (select *, e1x * hx + e1y * hy + e1z * hz as det from h),
t as (select mesh_id, query_id, (sx * hx + sy * hy + sz * hz) / det as u, (dx * ox + dy * oy + dz * oz) / det as v, (e2x * ox + e2y * oy + e2z * oz) / det as t from d where det <> 0)
select mesh_id, query_id, {R('min(t)')} as t from t where u >= 0 and v >= 0 and u + v <= 1 and t >= 0 and t < 6e0 group by 1, 2""")
def j5(spark, sf):
    out = spatial.ray_hits(fx.rays(spark, sf), m.triangles(fx.mesh(spark, sf, uv=False)), 6.0)
    return out.select("mesh_id", "query_id", r6(F.col("t")).alias("t"))


V16 = k.with_(fx.MESH_SQL, fx.MARKS_SQL) + """
, q as (select specimen_id as mesh_id, ord * 2 as query_id, x + 0.3e0 as qx, y - 0.2e0 as qy, z as qz from fx_marks union all select specimen_id, ord * 2 + 1, -(x + 0.3e0), -(y - 0.2e0), z from fx_marks),
pr as (select * from q join fx_tri using (mesh_id)),""" + k.closest_cte("pr", "near") + f"""
, s as (select mesh_id, query_id, sqrt(min(d2)) as d from near group by 1, 2),
b as (select mesh_id, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) as g from fx_vertices group by 1)
select mesh_id as specimen_id, {R('max(a) / max(g)')} as as_given, {R('max(f) / max(g)')} as flipped from (
  select mesh_id, quantile_cont(case when query_id % 2 = 0 then d end, 0.5) as a, quantile_cont(case when query_id % 2 = 1 then d end, 0.5) as f from s group by 1) join b using (mesh_id) group by 1"""


@query("v16_axis_check", V16)
def v16(spark, sf):
    lm = fx.marks(spark, sf).withColumns({"x": F.col("x") + 0.3, "y": F.col("y") - 0.2})
    own = fx.mesh(spark, sf, uv=False)
    return spatial.axis_check(lm, m.triangles(own), own.vertices).select("specimen_id", r6(F.col("as_given")).alias("as_given"), r6(F.col("flipped")).alias("flipped"))


@query("j9_pull_back", k.with_(fx.MESH_SQL) + f"""
select mesh_id, face_id, {R('(ax + bx + 2 * cx) / 4e0')} as x, {R('(ay + "by" + 2 * cy) / 4e0')} as y, {R('(az + bz + 2 * cz) / 4e0')} as z from fx_tri""")
def j9(spark, sf):
    """A point at weights (1/4, 1/4, 1/2) of a sheared surface returns to the same weights of the native one."""
    native = cut(m.triangles(fx.mesh(spark, sf, uv=False)))
    sheared = native.select("mesh_id", "face_id", *[e for c in "abc" for e in (
        (F.col(f"{c}x") * 2.0 + F.col(f"{c}y")).alias(f"{c}x"), (F.col(f"{c}y") * 0.5 + F.col(f"{c}z")).alias(f"{c}y"), (F.col(f"{c}z") * 3.0).alias(f"{c}z"))])
    at = sheared.select("mesh_id", "face_id", F.col("face_id").alias("query_id"), F.lit(0.0).alias("d2"), *[
        ((F.col(f"a{n}") + F.col(f"b{n}") + 2.0 * F.col(f"c{n}")) / 4.0).alias(f"p{n}") for n in "xyz"])
    return align.pull_back(at, sheared, native).select("mesh_id", "face_id", *[r6(F.col(n)).alias(n) for n in "xyz"])


# ------------------------------------------------------------------ graphs

PARTS = k.with_(fx.MESH_SQL, k.MEASURES_CTE) + """
, sel as (select mesh_id, face_id from fx_measures where mz > 0.4500001e0),
fs as (select f.* from fx_faces f join sel using (mesh_id, face_id)),
sd as (select mesh_id, face_id, least(p, q) as lo, greatest(p, q) as hi from (select mesh_id, face_id, unnest([a, b, c]) as p, unnest([b, c, a]) as q from fs)),
ad as (select s.mesh_id, s.face_id, t.face_id as nbr_id from sd s join sd t using (mesh_id, lo, hi) where s.face_id <> t.face_id group by 1, 2, 3)"""


def _parts(spark, sf):
    own = fx.mesh(spark, sf, uv=False)
    sel = m.face_measures(own).filter(F.col("cz") > 0.4500001).select("mesh_id", "face_id")
    return cut(own.faces.join(sel, ["mesh_id", "face_id"], "left_semi"))


@query("g3_components", PARTS.replace("with ", "with recursive ", 1) + """
, walk as (select mesh_id, face_id as root, face_id from sel union select w.mesh_id, w.root, a.nbr_id from walk w join ad a on a.mesh_id = w.mesh_id and a.face_id = w.face_id where a.nbr_id > w.root)
select mesh_id, face_id, min(root) as component from walk group by 1, 2""")
def g3(spark, sf):
    faces = _parts(spark, sf)
    return graph.components(faces, graph.edge_links(faces)).select("mesh_id", "face_id", "component")


@query("g15_uv_islands")
def g15(spark, sf):
    own = fx.mesh(spark, sf)
    # Each strip of the grid is moved apart in the image, so strips become islands.
    strip = F.floor(F.col("face_id") / 22)
    uv = own.corner_uv.withColumn("v", F.col("v") + strip * 2.0)
    return charts.uv_islands(uv, own.faces).select("mesh_id", "face_id", "component")


@query("g15_uv_islands_strips", k.with_(fx.VERTICES_SQL, fx.FACES_SQL) + " select mesh_id, face_id, face_id // 22 * 22 as component from fx_faces")
def g15b(spark, sf):
    return g15(spark, sf)


@query("g16_layout_islands", k.with_(fx.MESH_SQL) + f"""
, p as (select *, face_id // 22 as chart_id, min(u) over w as u0, max(u) over w as u1, min(v) over w as v0, max(v) over w as v1 from fx_uv window w as (partition by mesh_id, face_id // 22)),
c as (select *, ceil(sqrt(11e0))::bigint as side from p)
select mesh_id, face_id, corner, chart_id, {R('(chart_id % side)::double / side + 0.002e0 / side + (u - u0) / (u1 - u0) / side * 0.996e0')} as u, {R('(chart_id // side)::double / side + 0.002e0 / side + (v - v0) / (v1 - v0) / side * 0.996e0')} as v from c""")
def g16(spark, sf):
    own = fx.mesh(spark, sf)
    islands = own.faces.select("mesh_id", "face_id", (F.floor(F.col("face_id") / 22) * 22).alias("component"))
    uv, ids = charts.layout_islands(own.corner_uv, islands)
    return uv.join(shuffled(ids), ["mesh_id", "face_id"]).select("mesh_id", "face_id", "corner", "chart_id", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("g14_assign_charts")
def g14(spark, sf):
    return charts.assign_charts(fx.mesh(spark, sf, uv=False), 40.0)[0]


def _edges(spark, sf):
    own = fx.mesh(spark, sf, uv=False)
    measures = cut(m.face_measures(own))
    return own, measures, cut(graph.weighted_adjacency(graph.adjacency(own.faces), measures, own.vertices))


@query("g5_edge_weights", k.with_(fx.MESH_SQL, k.MEASURES_CTE, k.ADJACENCY_CTE) + f"""
select mesh_id, a.face_id, a.nbr_id, {R('sqrt(power(p.mx - q.mx, 2) + power(p.my - q.my, 2) + power(p.mz - q.mz, 2))')} as w from fx_adj a join fx_measures p using (mesh_id, face_id) join (select mesh_id, face_id as nbr_id, mx, my, mz from fx_measures) q using (mesh_id, nbr_id)""")
def g5w(spark, sf):
    return _edges(spark, sf)[2].select("mesh_id", "face_id", "nbr_id", r6(F.col("w")).alias("w"))


@query("g5_nearest_sample", k.with_(fx.MESH_SQL, k.MEASURES_CTE, k.ADJACENCY_CTE).replace("with ", "with recursive ", 1) + f"""
, ed as (select mesh_id, a.face_id, a.nbr_id, sqrt(power(p.mx - q.mx, 2) + power(p.my - q.my, 2) + power(p.mz - q.mz, 2)) as w from fx_adj a join fx_measures p using (mesh_id, face_id) join (select mesh_id, face_id as nbr_id, mx, my, mz from fx_measures) q using (mesh_id, nbr_id)),
sp(mesh_id, face_id, dist) using key (mesh_id, face_id) as (
  select mesh_id, face_id, 0e0 from fx_faces where face_id in (0, 120, 241)
  union (select e.mesh_id, e.nbr_id, min(s.dist + e.w) from sp s join ed e on e.mesh_id = s.mesh_id and e.face_id = s.face_id
    left join recurring.sp r on r.mesh_id = e.mesh_id and r.face_id = e.nbr_id where r.dist is null or s.dist + e.w < r.dist group by 1, 2))
select mesh_id, face_id, {R('dist')} as dist from sp""")
def g5(spark, sf):
    own, measures, edges = _edges(spark, sf)
    seeds = own.faces.filter(F.col("face_id").isin(0, 120, 241)).select("mesh_id", "face_id", F.floor(F.col("face_id") / 120).alias("sample_id"))
    out = graph.nearest_sample(measures, edges, seeds)
    return out.select("mesh_id", "face_id", r6(F.col("dist")).alias("dist"))


def _walk(n: int) -> str:
    """Shortest ways from pick n, the least distance to all picks so far, and the next pick."""
    least = f"select mesh_id, face_id, dist from sp{n}" if not n else f"select mesh_id, face_id, least(p.dist, q.dist) as dist from low{n - 1} p join sp{n} q using (mesh_id, face_id)"
    return f"""
, sp{n}(mesh_id, face_id, dist) using key (mesh_id, face_id) as (
  select mesh_id, face_id, 0e0 from pick{n}
  union (select e.mesh_id, e.nbr_id, min(s.dist + e.w) from sp{n} s join ed e on e.mesh_id = s.mesh_id and e.face_id = s.face_id
    left join recurring.sp{n} r on r.mesh_id = e.mesh_id and r.face_id = e.nbr_id where r.dist is null or s.dist + e.w < r.dist group by 1, 2))
, low{n} as ({least})
, pick{n + 1} as (select mesh_id, face_id from low{n} qualify row_number() over (partition by mesh_id order by dist desc, face_id) = 1)"""


@query("g4_sample_faces", k.with_(fx.MESH_SQL, k.MEASURES_CTE, k.ADJACENCY_CTE).replace("with ", "with recursive ", 1) + f"""
, ed as (select mesh_id, a.face_id, a.nbr_id, {R('sqrt(power(p.mx - q.mx, 2) + power(p.my - q.my, 2) + power(p.mz - q.mz, 2))')} as w from fx_adj a join fx_measures p using (mesh_id, face_id) join (select mesh_id, face_id as nbr_id, mx, my, mz from fx_measures) q using (mesh_id, nbr_id))
, pick0 as (select mesh_id, face_id from fx_faces qualify row_number() over (partition by mesh_id order by (face_id * 97 + mesh_id) % 242 desc) = 1)""" + "".join(map(_walk, range(3))) + """
select mesh_id, 0::bigint as sample_id, face_id from pick0 union all select mesh_id, 1, face_id from pick1
union all select mesh_id, 2, face_id from pick2 union all select mesh_id, 3, face_id from pick3""")
def g4(spark, sf):
    """Edge lengths of six places and areas that no two faces share, so both sides see the same ties."""
    own, measures, edges = _edges(spark, sf)
    comp = own.faces.select("mesh_id", "face_id", F.lit(0).cast("bigint").alias("component"))
    apart = measures.withColumn("area", ((F.col("face_id") * 97 + F.col("mesh_id")) % 242).cast("double"))
    return graph.sample_faces(apart, cut(edges.withColumn("w", r6(F.col("w")))), comp, 4)[0]


PAIR = 0.02  # from a vertex to its twin


@query("g6_weld_pairs", k.with_(fx.VERTICES_SQL) + " select mesh_id, vertex_id + 144 * t as vertex_id, vertex_id as new_id from fx_vertices, (select unnest([0, 1]) as t)")
def g6b(spark, sf):
    """Every vertex of the grid has a twin near it and no other vertex within the radius: the first of each pair answers."""
    own = fx.mesh(spark, sf, uv=False)
    twins = own.vertices.select("mesh_id", (F.col("vertex_id") + 144).alias("vertex_id"), (F.col("x") + PAIR).alias("x"), "y", "z")
    both = m.Mesh(own.vertices.unionByName(twins), own.faces)
    return weld.weld(both, 3 * PAIR)[1]


@query("g6_weld")
def g6(spark, sf):
    return weld.weld(fx.mesh(spark, sf, uv=False), 1.05)[1]


# ------------------------------------------------------------------ rasters

TW, TH = 24, 20
SPANS = f"""
fx_w as (select mesh_id, face_id, """ + ", ".join(f"max(case when corner = {c} then u end) * {TW} - 0.501e0 as x{c}, max(case when corner = {c} then v end) * {TH} - 0.502e0 as y{c}" for c in range(3)) + f""" from fx_uv group by 1, 2),
fx_row as (select *, unnest(range({TH})) as r, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) as s from fx_w),
fx_hit as (select mesh_id, face_id, r, s, x0, y0, x1, y1, x2, y2,
  case when r between least(y0, y1) and greatest(y0, y1) and y0 <> y1 then x0 + (r - y0) / (y1 - y0) * (x1 - x0) end as p,
  case when r between least(y1, y2) and greatest(y1, y2) and y1 <> y2 then x1 + (r - y1) / (y2 - y1) * (x2 - x1) end as q,
  case when r between least(y2, y0) and greatest(y2, y0) and y2 <> y0 then x2 + (r - y2) / (y0 - y2) * (x0 - x2) end as t from fx_row where s <> 0),
fx_cover as (select mesh_id, face_id, c.px, {TH - 1} - r as py, ((px - x0) * (y2 - y0) - (x2 - x0) * (r - y0)) / s as w1, ((x1 - x0) * (r - y0) - (px - x0) * (y1 - y0)) / s as w2
  from fx_hit, (select unnest(range({TW})) as px) c where px > floor(least(p, q, t)) and px <= floor(greatest(p, q, t)))"""


def _bent_uv(spark, sf):
    uv = fx.mesh(spark, sf).corner_uv
    return uv.select("mesh_id", "face_id", "corner", (F.col("u") * 0.9 + F.col("v") * 0.07 + 0.011).alias("u"), (F.col("v") * 0.91 + F.col("u") * 0.03 + 0.017).alias("v"))


BENT = fx.MESH_SQL.replace("x / 11e0 as u, y / 11e0 as v", "x / 11e0 * 0.9e0 + y / 11e0 * 0.07e0 + 0.011e0 as u, y / 11e0 * 0.91e0 + x / 11e0 * 0.03e0 + 0.017e0 as v")


@query("g10_rasterize_uv", k.with_(BENT, SPANS) + f" select mesh_id, face_id, px, py, {R('1 - w1 - w2')} as w0, {R('w1')} as w1, {R('w2')} as w2 from fx_cover")
def g10(spark, sf):
    out = texture.rasterize_uv(_bent_uv(spark, sf), TW, TH)
    return out.select("mesh_id", "face_id", "px", "py", *[r6(F.col(c)).alias(c) for c in ("w0", "w1", "w2")])


@query("w4_texel_owner", k.with_(BENT, SPANS) + " select mesh_id, px // 2 as px, py // 2 as py, max(face_id) as face_id from fx_cover group by 1, 2, 3")
def w4(spark, sf):
    cover = texture.rasterize_uv(_bent_uv(spark, sf), TW, TH).withColumns({"px": F.floor(F.col("px") / 2), "py": F.floor(F.col("py") / 2)})
    return texture.texel_owner(cover).select("mesh_id", "px", "py", "face_id")


def _pad_pass(src, dst):
    mean = lambda c: f"floor(sum({c} * w) / sum(w) + 0.5e0)::bigint"
    return f"""
{dst}_n as (select texture_id, px + dx as px, py + dy as py, case when dx <> 0 and dy <> 0 then 1 else 2 end as w, r, g, b, alpha from {src}, (select unnest([-1, 0, 1]) as dx) dx, (select unnest([-1, 0, 1]) as dy) dy where not (dx = 0 and dy = 0)),
{dst}_g as (select texture_id, px, py, {mean('r')} as r, {mean('g')} as g, {mean('b')} as b, {mean('alpha')} as alpha from {dst}_n where px between 0 and {fx.PIXELS - 1} and py between 0 and {fx.PIXELS - 1} group by 1, 2, 3 having max(w) = 2),
{dst} as (select * from {src} union all select * from {dst}_g x where not exists (select 1 from {src} y where y.texture_id = x.texture_id and y.px = x.px and y.py = x.py))"""


TEXELS = "t0 as (select texture_id, px, py, round(r * 255)::bigint as r, round(g * 255)::bigint as g, round(b * 255)::bigint as b, 255::bigint as alpha from fx_pixels where alpha > 0 and r < 0.2e0)"


@query("g12_pad", k.with_(fx.PIXELS_SQL, TEXELS, _pad_pass("t0", "t1"), _pad_pass("t1", "t2")) + " select * from t2")
def g12(spark, sf):
    byte = lambda c: F.rint(F.col(c) * 255.0).cast("bigint").alias(c)
    t = fx.pixels(spark, sf).filter((F.col("alpha") > 0) & (F.col("r") < 0.2)).select("texture_id", "px", "py", byte("r"), byte("g"), byte("b"), F.lit(255).cast("bigint").alias("alpha"))
    return texture.pad(t, fx.PIXELS, fx.PIXELS, 2)


@query("g11_transfer_texture")
def g11(spark, sf):
    source, shared = fx.mesh(spark, sf), fx.atlas(spark, sf)
    return texture.transfer_texture(source, source.vertices, shared.faces, shared.corner_uv, fx.pixels(spark, sf), 24, 24, 0.25, 1.0, 1)


# ------------------------------------------------------------------ regions

CURVE = np.array([[2.0, 2.1, 0.4], [8.2, 1.7, 0.5], [9.1, 8.3, 0.45], [5.0, 9.6, 0.6], [1.6, 7.2, 0.5]])
_C, _B, _H, _M = region.curve_plane(CURVE)
_C, _B = _C.tolist(), _B.tolist()
_flat = lambda axis: "(" + " + ".join(f"({n} - {_C[i]!r}::DOUBLE) * {_B[axis][i]!r}::DOUBLE" for i, n in enumerate("xyz")) + ")"
_EDGES = [(*p, *q) for p, q in zip(_H.tolist(), np.roll(_H, -1, axis=0).tolist())]
_side = lambda e: f"(({e[2]!r}::DOUBLE - {e[0]!r}) * (pv - {e[1]!r}) - ({e[3]!r}::DOUBLE - {e[1]!r}) * (pu - {e[0]!r}) >= 0)"


def _gap(e):
    dx, dy = e[2] - e[0], e[3] - e[1]
    t = f"greatest(0e0, least(1e0, ((pu - {e[0]!r}) * {dx!r} + (pv - {e[1]!r}) * {dy!r}) / {dx * dx + dy * dy!r}::DOUBLE))"
    return f"(sqrt(power(pu - {e[0]!r} - {t} * {dx!r}, 2) + power(pv - {e[1]!r} - {t} * {dy!r}, 2)) <= {_M!r})"


INSIDE = f"""
fx_uvp as (select *, {_flat(0)} as pu, {_flat(1)} as pv from fx_vertices),
fx_in as (select mesh_id, vertex_id, x, y, z, ({' and '.join(_side(e) for e in _EDGES)}) or {' or '.join(_gap(e) for e in _EDGES)} as inside from fx_uvp)"""


@query("g8_select_vertices", k.with_(fx.MESH_SQL, INSIDE) + " select mesh_id, vertex_id from fx_in where inside")
def g8(spark, sf):
    return region.select_region(fx.mesh(spark, sf, uv=False), CURVE, same_side_only=False)[0]


@query("g8_select_faces", k.with_(fx.MESH_SQL, INSIDE) + " select mesh_id, face_id from fx_corners join fx_in using (mesh_id, vertex_id) group by 1, 2 having bool_and(inside)")
def g8b(spark, sf):
    return region.select_region(fx.mesh(spark, sf, uv=False), CURVE, same_side_only=False)[1]


@query("g8_select_same_side", k.with_(fx.MESH_SQL, INSIDE) + f"""
, bx as (select mesh_id, min(z) as lo, max(z) as hi from fx_vertices group by 1),
sd as (select mesh_id, lo, hi, (lo + hi) / 2 as mid, case when len(list_filter([{', '.join(repr(float(v)) for v in CURVE[:, 2])}], lambda c: c >= (lo + hi) / 2)) * 2 >= {len(CURVE)} then 1 else -1 end as sgn from bx)
select mesh_id, vertex_id from fx_in join sd using (mesh_id) where inside and (z - mid) * sgn >= -(hi - lo) * 0.05e0""")
def g8c(spark, sf):
    return region.select_region(fx.mesh(spark, sf, uv=False), CURVE)[0]


@query("g8_select_by_color")
def g8d(spark, sf):
    own = fx.mesh(spark, sf, uv=False)
    shade = own.vertices.select("mesh_id", "vertex_id", F.col("z").alias("r"), (F.col("z") / 2).alias("g"), (1.0 - F.col("z")).alias("b"))
    before = own.vertices.filter("vertex_id < 24").select("mesh_id", "vertex_id")
    return region.select_region(own, CURVE, colors=shade, previous=before)[1]


# ------------------------------------------------------------------ alignment

@query("a2_mean_landmarks", k.with_(fx.LANDMARKS_SQL) + f" select label, ord, {R('avg(x)')} as x, {R('avg(y)')} as y, {R('avg(z)')} as z from fx_landmarks group by 1, 2")
def a2(spark, sf):
    return align.mean_landmarks(fx.landmarks(spark, sf)).select("label", "ord", *[r6(F.col(n)).alias(n) for n in "xyz"])


SIZES = "sz as (select specimen_id, sqrt(sum(power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2))) as size from (select *, avg(x) over w as mx, avg(y) over w as my, avg(z) over w as mz from fx_landmarks window w as (partition by specimen_id)) group by 1)"


@query("a13_centroid_size", k.with_(fx.LANDMARKS_SQL, SIZES) + f" select specimen_id, {R('size')} as size from sz")
def a13(spark, sf):
    return align.centroid_size(fx.landmarks(spark, sf)).withColumn("size", r6(F.col("size")))


@query("p9_restore_scale", k.with_(fx.VERTICES_SQL, fx.LANDMARKS_SQL, SIZES) + f"""
, atl as (select label, avg(x) as x, avg(y) as y, avg(z) as z from fx_landmarks group by 1), c as (select avg(x) as mx, avg(y) as my, avg(z) as mz from atl),
f as (select (select avg(size) from sz) / sqrt(sum(power(x - mx, 2) + power(y - my, 2) + power(z - mz, 2))) as f from atl, c)
select mesh_id, vertex_id, {R('mx + f * (x - mx)')} as x, {R('my + f * (y - my)')} as y, {R('mz + f * (z - mz)')} as z from fx_vertices, c, f""")
def p9(spark, sf):
    lm = fx.landmarks(spark, sf)
    out, _, _ = align.restore_scale(fx.vertices(spark, sf), align.mean_landmarks(lm), lm)
    return out.select("mesh_id", "vertex_id", *[r6(F.col(n)).alias(n) for n in "xyz"])


COV = ", ".join(f"{R(f'sum((l.{p} - m{p}) * (t.{q} - n{q}))')} as h{i}{j}" for i, p in enumerate("xyz") for j, q in enumerate("xyz"))


@query("p1_cross_covariance", k.with_(fx.LANDMARKS_SQL) + f"""
, t as (select label, avg(x) as x, avg(y) as y, avg(z) as z from fx_landmarks group by 1), n as (select avg(x) as nx, avg(y) as ny, avg(z) as nz from t),
mm as (select specimen_id, avg(x) as mx, avg(y) as my, avg(z) as mz from fx_landmarks group by 1)
select l.specimen_id, {COV}, {R('sum(power(l.x - mx, 2) + power(l.y - my, 2) + power(l.z - mz, 2))')} as size2 from fx_landmarks l join t using (label) join mm using (specimen_id), n group by 1""")
def p1c(spark, sf):
    lm = fx.landmarks(spark, sf)
    out = align.cross_covariance(lm, align.mean_landmarks(lm))
    return out.select("specimen_id", *[r6(F.col(f"h{i}{j}")).alias(f"h{i}{j}") for i in range(3) for j in range(3)], r6(F.col("size2")).alias("size2"))


# A turn by the 3-4-5 angle about z with scale 2 and a shift: the fit must find exactly it.
@query("p1_procrustes_recovers", k.with_(fx.LANDMARKS_SQL) + f" select specimen_id, label, {R('x')} as x, {R('y')} as y, {R('z')} as z from fx_landmarks")
def p1(spark, sf):
    lm = cut(fx.landmarks(spark, sf))
    turned = lm.select("specimen_id", "label", "ord", ((F.col("x") * 0.6 - F.col("y") * 0.8) * 2 + 1).alias("x"), ((F.col("x") * 0.8 + F.col("y") * 0.6) * 2 - 3).alias("y"), (F.col("z") * 2 + 0.5).alias("z"))
    # Fit every turned specimen to its own original by naming the pair in the label.
    own = lambda df: df.withColumn("label", F.concat(F.col("specimen_id").cast("string"), F.lit("/"), F.col("label")))
    fits = align.procrustes(own(turned), own(lm), scale=True, same_labels=False)
    back = align.apply_transform(turned, fits, "ord")
    return back.select("specimen_id", "label", *[r6(F.col(n)).alias(n) for n in "xyz"])


@query("p2_align", k.with_(fx.LANDMARKS_SQL) + f" select specimen_id, label, {R('1.5e0 * (x * 0.6e0 - y * 0.8e0) + 1')} as x, {R('1.5e0 * (x * 0.8e0 + y * 0.6e0) + 2')} as y, {R('1.5e0 * z + 3')} as z from fx_landmarks")
def p2(spark, sf):
    lm = fx.landmarks(spark, sf)
    f = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    t = lm.select("specimen_id").distinct().select("specimen_id", f(.6, .8, 0, -.8, .6, 0, 0, 0, 1).alias("r"), f(1, 2, 3).alias("t"), F.lit(1.5).alias("scale"))
    return align.apply_transform(lm, t, "ord").select("specimen_id", "label", *[r6(F.col(n)).alias(n) for n in "xyz"])


@query("p3_gpa")
def p3(spark, sf):
    return align.gpa(fx.marks(spark, sf)).transforms


# With scaling, the mean is centred and keeps the population's mean size.
@query("p3_gpa_mean_size", k.with_(fx.VERTICES_SQL, fx.MARKS_SQL, SIZES.replace("fx_landmarks", "fx_marks")) + f" select 0e0 as x, 0e0 as y, 0e0 as z, {R('avg(size)')} as size from sz")
def p3b(spark, sf):
    mean = align.gpa(fx.marks(spark, sf), scale=True).mean
    return mean.agg(*[(F.round(F.avg(n), 6) + F.lit(0.0)).alias(n) for n in "xyz"], r6(F.sqrt(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))).alias("size"))


@query("w2_closest_to_mean", k.with_(fx.LANDMARKS_SQL) + f"""
, t as (select label, avg(x) as x, avg(y) as y, avg(z) as z from fx_landmarks group by 1),
r as (select specimen_id, sum(power(l.x - t.x, 2) + power(l.y - t.y, 2) + power(l.z - t.z, 2)) as residual from fx_landmarks l join t using (label) group by 1)
select specimen_id, {R('residual')} as residual from r order by r.residual, specimen_id limit 1""")
def w2(spark, sf):
    lm = fx.landmarks(spark, sf)
    f = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    still = lm.select("specimen_id").distinct().select("specimen_id", f(1, 0, 0, 0, 1, 0, 0, 0, 1).alias("r"), f(0, 0, 0).alias("t"), F.lit(1.0).alias("scale"))
    return align.closest_to_mean(lm, still, align.mean_landmarks(lm)).withColumn("residual", r6(F.col("residual")))


@query("p4_reference_template")
def p4(spark, sf):
    lm, own = cut(fx.marks(spark, sf)), fx.mesh(spark, sf, uv=False)
    return align.reference_template(align.gpa(lm), own, lm)[1].vertices


# A spline passes through its landmarks.
@query("p5_spline_interpolates", k.with_(fx.LANDMARKS_SQL) + """
, t as (select label, avg(x) as x, avg(y) as y, avg(z) as z from fx_landmarks group by 1)
select specimen_id, label, round(t.x, 5) + 0e0 as x, round(t.y, 5) + 0e0 as y, round(t.z, 5) + 0e0 as z from fx_landmarks join t using (label)""")
def p5(spark, sf):
    lm = fx.landmarks(spark, sf)
    coef = align.fit_spline(align.spline_pairs(lm, align.mean_landmarks(lm), per_specimen=False))
    return align.apply_spline(lm, coef, "ord").select("specimen_id", "label", *[(F.round(n, 5) + F.lit(0.0)).alias(n) for n in "xyz"])


# A spline fitted to an affine map is that map.
@query("p5_spline_affine", k.with_(fx.VERTICES_SQL) + """
select mesh_id as specimen_id, vertex_id, round(1.2e0 * x + 0.3e0 * y - 0.1e0 * z + 2, 5) + 0e0 as x, round(0.9e0 * y - 0.2e0 * x, 5) + 0e0 as y, round(0.7e0 * z + 0.05e0 * x - 1, 5) + 0e0 as z from fx_vertices""")
def p5b(spark, sf):
    lm = cut(fx.marks(spark, sf))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    moved = lm.select("specimen_id", "label", (1.2 * x + 0.3 * y - 0.1 * z + 2).alias("x"), (0.9 * y - 0.2 * x).alias("y"), (0.7 * z + 0.05 * x - 1).alias("z"))
    coef = align.fit_spline(align.spline_pairs(lm, moved))
    out = align.apply_spline(fx.vertices(spark, sf).withColumnRenamed("mesh_id", "specimen_id"), coef, "vertex_id")
    return out.select("specimen_id", "vertex_id", *[(F.round(n, 5) + F.lit(0.0)).alias(n) for n in "xyz"])


def _resampled(spark, sf, method, mean=True):
    own, lm = fx.mesh(spark, sf, uv=False), cut(fx.marks(spark, sf))
    shared = cut(fx.atlas(spark, sf).vertices)
    ids = F.posexplode(F.array(*[F.lit(v).cast("bigint") for v in fx.MARK_VERTICES])).alias("ord", "vertex_id")
    marks = cut(shared.join(shared.limit(1).select(ids), "vertex_id").select(F.concat(F.lit("P"), F.col("ord").cast("string")).alias("label"), F.col("ord").cast("bigint").alias("ord"), "x", "y", "z"))
    return align.resample(own, lm, shared, marks, marks if mean else None, method=method)


# Every specimen is its own affine image of the atlas. Splines reproduce affine maps, so each
# atlas vertex must land on its image, at distance 0.
IMAGE = ("(1 + s_nationkey / 50e0) * x + 0.1e0 * y - 0.2e0 * z + s_suppkey", "(1 + s_nationkey / 100e0) * y + 0.05e0 * x", "1.5e0 * z - 0.1e0 * x + 2e0")
IMAGES_SQL = k.with_(fx.ATLAS_SQL) + "\n, img as (select s_suppkey as specimen_id, vertex_id, " + ", ".join(f"{e} as {n}" for e, n in zip(IMAGE, "xyz")) + " from supplier, fx_atlas_v)"


def _images(spark, sf, df, key):
    s = fx.read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.explode(F.expr("sequence(0L, 143L)")).alias("vertex_id"))
    rows = s.join(df.select("vertex_id", "x", "y", "z", *[c for c in df.columns if c in ("label", "ord")]), "vertex_id")
    return rows.select(F.col("s_suppkey").alias(key), *[c for c in df.columns if c not in ("mesh_id", "x", "y", "z")], *[F.expr(e.replace("e0", "d")).alias(n) for e, n in zip(IMAGE, "xyz")])


def _image_case(spark, sf, method):
    shared = fx.atlas(spark, sf)
    ids = F.posexplode(F.array(*[F.lit(v).cast("bigint") for v in fx.MARK_VERTICES])).alias("ord", "vertex_id")
    marks = cut(shared.vertices.limit(1).select(ids).join(shared.vertices, "vertex_id").select(
        "vertex_id", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("label"), F.col("ord").cast("bigint").alias("ord"), "x", "y", "z"))
    vertices = cut(_images(spark, sf, shared.vertices, "mesh_id"))
    own = m.Mesh(vertices, fx.faces(spark, sf))
    lm = cut(_images(spark, sf, marks, "specimen_id").drop("vertex_id"))
    out = align.resample(own, lm, shared.vertices, marks, method=method)
    places = 4 if method == "tps_projection" else 5
    return out.select("specimen_id", "vertex_id", *[(F.round(n, places) + F.lit(0.0)).alias(n) for n in ("x", "y", "z")], (F.col("dist") < 1e-4).alias("on_surface"))


@query("p6_resample_affine", IMAGES_SQL + " select specimen_id, vertex_id, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(z, 5) + 0e0 as z, true as on_surface from img")
def p6a(spark, sf):
    return _image_case(spark, sf, "common")


@query("p6_resample")
def p6(spark, sf):
    return _resampled(spark, sf, "common", mean=False)


@query("p7_resample_tps_projection")
def p7(spark, sf):
    return _resampled(spark, sf, "tps_projection")


@query("p8_mean_surface")
def p8(spark, sf):
    return atlas_plan.mean_surface(fx.mesh(spark, sf, uv=False), cut(fx.marks(spark, sf)))[0].vertices


@query("a14_distance_report", k.with_(fx.MESH_SQL, fx.POINTS_SQL, "fx_pairs as (select * from fx_points join fx_tri using (mesh_id))", k.closest_cte("fx_pairs", "near")) + f"""
, d as (select mesh_id, query_id, sqrt(min(d2)) as d from near group by 1, 2)
select mesh_id as specimen_id, {R('max(d)')} as max_dist, {R('avg(d)')} as mean_dist, {R('quantile_cont(d, 0.5)')} as median_dist, count(*) as n, max(d) <= 2e0 as accepted from d group by 1""")
def a14(spark, sf):
    near = spatial.nearest_on_surface(fx.points(spark, sf), m.triangles(fx.mesh(spark, sf, uv=False)))
    out = align.distance_report(near.select(F.col("mesh_id").alias("specimen_id"), F.sqrt("d2").alias("dist")), 2.0)
    return out.select("specimen_id", *[r6(F.col(c)).alias(c) for c in ("max_dist", "mean_dist", "median_dist")], "n", "accepted")


@query("p10_build_atlas")
def p10(spark, sf):
    lm = cut(fx.marks(spark, sf))
    options = atlas_plan.AtlasOptions(texture_size=32, uv_angle=80.0, extrusion=0.05)
    own = fx.mesh(spark, sf)
    out = atlas_plan.build_atlas(m.Mesh(cut(own.vertices), cut(own.faces), cut(own.corner_uv)), lm, fx.pixels(spark, sf), options)
    return out.average
