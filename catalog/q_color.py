"""Colour functions, statistics, sampling, smoothing, clusters and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sqlkit as k
from catalog.fixtures import R, r6
from catalog.registry import query
from surfpop.functions import color as col
from surfpop.operators import checks, cluster, colors, features, graph, texture
from surfpop.operators import mesh as m
from surfpop.plans import colors as plan
from surfpop.session import cut, shuffled

KEY = ("l_orderkey", "l_linenumber", "l_partkey")
KEYS = ", ".join(KEY)
RGB = "l_quantity / 50e0 as r, l_discount * 10e0 as g, l_tax * 100e0 / 8e0 as b"


def _rgb(spark, sf):
    return fx.read(spark, sf, "lineitem").select(
        *KEY, (F.col("l_quantity") / 50.0).alias("r"), (F.col("l_discount") * 10.0).alias("g"), (F.col("l_tax") * 100.0 / 8.0).alias("b"))


LAB = k.with_(fx.SAMPLES_SQL, k.lab_cte("fx_samples", "lab"))
MOMENTS = k.with_(fx.SAMPLES_SQL, k.lab_cte("fx_samples", "lab"), k.moments_cte("lab", "mom"))


# ------------------------------------------------------------------ scalar functions

@query("f2_byte_unit", f"""select {KEYS}, {R('l_quantity::bigint / 255e0')} as unit, round_even((l_discount * 10e0 + 0.003e0) * 255e0, 0)::bigint as byte, (l_quantity > 49)::boolean as rejected from lineitem""")
def f2(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    out = col.unit_to_byte(F.when(F.col("l_quantity") > 49, F.lit(1.5)).otherwise(F.lit(0.5)))
    byte = F.rint((F.col("l_discount") * 10.0 + 0.003) * 255.0).cast("bigint")
    checked = F.coalesce(col.unit_to_byte(F.least(F.col("l_discount") * 10.0 + 0.003, F.lit(1.0))), byte)
    return li.select(*KEY, r6(col.byte_to_unit(F.col("l_quantity").cast("bigint"))).alias("unit"),
                     F.when(F.col("l_discount") * 10.0 + 0.003 <= 1.0, checked).otherwise(byte).alias("byte"), out.isNull().alias("rejected"))


@query("f3_srgb_to_linear", f"select {KEYS}, {R(k.linear('(l_quantity / 50e0)'))} as v, {R(k.linear('(l_tax)'))} as w from lineitem")
def f3(spark, sf):
    return fx.read(spark, sf, "lineitem").select(*KEY, r6(col.srgb_to_linear(F.col("l_quantity") / 50.0)).alias("v"), r6(col.srgb_to_linear(F.col("l_tax"))).alias("w"))


@query("f4_linear_to_srgb", f"select {KEYS}, {R(k.encoded('(l_quantity / 40e0 - 0.1e0)'))} as v, {R(k.encoded('(l_tax / 20e0)'))} as w from lineitem")
def f4(spark, sf):
    return fx.read(spark, sf, "lineitem").select(*KEY, r6(col.linear_to_srgb(F.col("l_quantity") / 40.0 - 0.1)).alias("v"), r6(col.linear_to_srgb(F.col("l_tax") / 20.0)).alias("w"))


@query("f5_srgb_to_lab", k.with_(f"src as (select {KEYS}, {RGB} from lineitem)", k.lab_cte("src", "lab")) + f" select {KEYS}, {R('lab_l')} as lab_l, {R('lab_a')} as lab_a, {R('lab_b')} as lab_b from lab")
def f5(spark, sf):
    lab = col.srgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return _rgb(spark, sf).select(*KEY, *[r6(c).alias(n) for c, n in zip(lab, ("lab_l", "lab_a", "lab_b"))])


@query("f6_lab_to_srgb", k.with_(f"src as (select {KEYS}, l_quantity * 2 as lab_l, l_discount * 1000 - 50 as lab_a, l_tax * 1000 - 40 as lab_b from lineitem)", k.rgb_cte("src", "rgb")) + f" select {KEYS}, {R('dr')} as r, {R('dg')} as g, {R('db')} as b from rgb")
def f6(spark, sf):
    rgb = col.lab_to_srgb(F.col("l_quantity") * 2.0, F.col("l_discount") * 1000.0 - 50.0, F.col("l_tax") * 1000.0 - 40.0)
    return fx.read(spark, sf, "lineitem").select(*KEY, *[r6(c).alias(n) for c, n in zip(rgb, "rgb")])


@query("f7_chroma", LAB + f" select specimen_id, sample_id, {R('sqrt(lab_a * lab_a + lab_b * lab_b)')} as chroma from lab")
def f7(spark, sf):
    lab = colors.to_lab(fx.samples(spark, sf))
    return lab.select("specimen_id", "sample_id", r6(col.chroma(F.col("a"), F.col("b_"))).alias("chroma"))


@query("f8_match_moment", f"""
with s as (select l_suppkey, avg(l_quantity) as am, stddev_pop(l_quantity) as sd from lineitem group by 1), p as (select avg(l_quantity) as pm, stddev_pop(l_quantity) as ps from lineitem)
select l_suppkey, {KEYS}, {R('(l_quantity - am) * (case when sd > 1e-12 then ps / sd else 0 end) + pm')} as v, {R('pm')} as flat from lineitem join s using (l_suppkey), p""")
def f8(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    s = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("am"), F.stddev_pop("l_quantity").alias("sd"))
    p = li.agg(F.avg("l_quantity").alias("pm"), F.stddev_pop("l_quantity").alias("ps"))
    s = s.withColumn("pm", p.select("pm").scalar()).withColumn("ps", p.select("ps").scalar())
    c = F.col
    return li.join(s, "l_suppkey").select("l_suppkey", *KEY, r6(col.match_moment(c("l_quantity"), c("am"), c("sd"), c("pm"), c("ps"))).alias("v"),
        r6(col.match_moment(c("l_quantity"), c("l_quantity"), F.lit(0.0), c("pm"), c("ps"))).alias("flat"))


@query("f9_delta_e76", LAB + f" select specimen_id, sample_id, {R('sqrt(power(lab_l - 50, 2) + power(lab_a - 10, 2) + power(lab_b + 20, 2))')} as de from lab")
def f9(spark, sf):
    lab = colors.to_lab(fx.samples(spark, sf))
    de = col.delta_e76((F.col("L"), F.col("a"), F.col("b_")), (F.lit(50.0), F.lit(10.0), F.lit(-20.0)))
    return lab.select("specimen_id", "sample_id", r6(de).alias("de"))


@query("f15_premultiply", f"select {KEYS}, (l_partkey % 256 * l_quantity::bigint * 5) // 255 as v from lineitem")
def f15(spark, sf):
    return fx.read(spark, sf, "lineitem").select(*KEY, col.premultiply_byte(F.col("l_partkey") % 256, F.col("l_quantity") * 5).alias("v"))


@query("f16_transfer_byte", f"select {KEYS}, greatest(0, least(255, floor((l_quantity / 45e0 - 0.05e0) * 255e0 + 0.5e0)))::bigint as v from lineitem")
def f16(spark, sf):
    return fx.read(spark, sf, "lineitem").select(*KEY, col.transfer_byte(F.col("l_quantity") / 45.0 - 0.05).alias("v"))


@query("f18_similarity", f"""
with p as (select *, 1 / (1 + (abs(r - 0.5e0) / 0.200001e0 + abs(g - 0.4e0) / 0.300001e0 + abs(b - 0.6e0) / 0.100001e0) / 3) as s from (select {KEYS}, {RGB} from lineitem))
select {KEYS}, {R('s')} as s, s >= 0.7e0 as similar from p""")
def f18(spark, sf):
    s = col.similarity([F.col(c) for c in "rgb"], [F.lit(v) for v in (0.5, 0.4, 0.6)], [F.lit(v) for v in (0.2, 0.3, 0.1)])
    return _rgb(spark, sf).select(*KEY, r6(s).alias("s"), (s >= 0.7).alias("similar"))


# ------------------------------------------------------------------ moments and normalisation

MOMENT_COLS = ", ".join(f"{R(c)} as {c}" for c in ("mean_l", "std_l", "mean_c", "std_c"))


def _rounded(df):
    return df.select(*[c for c in df.columns if c not in colors.MOMENTS], *[r6(F.col(c)).alias(c) for c in colors.MOMENTS])


@query("a3_color_moments", MOMENTS + f" select specimen_id, n, {MOMENT_COLS} from mom")
def a3(spark, sf):
    return _rounded(colors.color_moments(fx.samples(spark, sf)))


@query("a4_pooled_moments", MOMENTS + f" select pn as n, {R('pl')} as mean_l, {R('pls')} as std_l, {R('pc')} as mean_c, {R('pcs')} as std_c from mom_pool")
def a4(spark, sf):
    return _rounded(colors.pooled_moments(colors.color_moments(fx.samples(spark, sf))))


@query("c2_normalization_stats", MOMENTS + f""" select specimen_id, n, {MOMENT_COLS} from mom
union all select null, pn, {R('pl')}, {R('pls')}, {R('pc')}, {R('pcs')} from mom_pool""")
def c2(spark, sf):
    per, pooled = colors.normalization_stats(fx.samples(spark, sf))
    return _rounded(per.unionByName(pooled.withColumn("specimen_id", F.lit(None).cast("bigint"))))


@query("v15_stale_stats", MOMENTS + " select specimen_id from mom where specimen_id in (select l_suppkey from lineitem where l_tax > 0.075e0 group by 1 having count(*) > 37)")
def v15(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    own = cut(colors.color_moments(fx.samples(spark, sf)))
    moved = li.filter("l_tax > 0.075d").groupBy(F.col("l_suppkey").alias("specimen_id")).agg(F.count(F.lit(1)).alias("k"))
    stored = own.join(moved, "specimen_id").withColumn("mean_l", F.when(F.col("k") > 37, F.col("mean_l") * 1.001).otherwise(F.col("mean_l") * (1 + 1e-9))).drop("k")
    return checks.stale_stats(stored, own)


LABS = f"{R('lab_l')} as lab_l, {R('lab_a')} as lab_a, {R('lab_b')} as lab_b"


def _labs(df, *extra):
    return df.select("specimen_id", "sample_id", "valid", *[r6(F.col(c)).alias(n) for c, n in (("L", "lab_l"), ("a", "lab_a"), ("b", "lab_b"))], *extra)


@query("c6_normalize", k.with_(fx.SAMPLES_SQL, k.lab_cte("fx_samples", "lab"), k.moments_cte("lab", "mom"), k.normalized_cte("lab", "nrm", "mom")) + f" select specimen_id, sample_id, valid, {LABS} from nrm")
def c6(spark, sf):
    s = fx.samples(spark, sf)
    return _labs(colors.normalize(s, *colors.normalization_stats(s)))


@query("j8_statistics_join", MOMENTS + f" select s.specimen_id, s.sample_id, {R('m.mean_l')} as mean_l, {R('p.pl')} as pooled_l from fx_samples s join mom m using (specimen_id), mom_pool p")
def j8(spark, sf):
    from surfpop.session import spread_join
    s = fx.samples(spark, sf)
    per, pooled = colors.normalization_stats(s)
    own = per.select("specimen_id", "mean_l", pooled.select("mean_l").scalar().alias("pooled_l"))
    return spread_join(s, own, ["specimen_id"], ["sample_id"]).select("specimen_id", "sample_id", r6(F.col("mean_l")).alias("mean_l"), r6(F.col("pooled_l")).alias("pooled_l"))


@query("c3_process_colors", k.with_(fx.SAMPLES_SQL, k.lab_cte("fx_samples", "lab"), k.moments_cte("lab", "mom"), k.normalized_cte("lab", "nrm", "mom"), k.rgb_cte("nrm", "out")) + f"""
select specimen_id, sample_id, valid, {LABS}, case when valid then {R('dr')} else 0 end as r, case when valid then {R('dg')} else 0 end as g, case when valid then {R('db')} else 0 end as b from out""")
def c3(spark, sf):
    s = cut(fx.samples(spark, sf))  # read by the statistics, their checks and the colours
    done, _ = colors.process_colors(s, colors.normalization_stats(s))
    return _labs(done, *[r6(F.col(f"d{c}")).alias(c) for c in "rgb"])


@query("a12_distinct_colors", k.with_(fx.SAMPLES_SQL) + " select specimen_id, count(*) as n_colors from (select distinct specimen_id, r, g, b from fx_samples where valid) group by 1")
def a12(spark, sf):
    return colors.distinct_colors(colors.raw_lab(fx.samples(spark, sf)))


@query("a17_coverage", k.with_(fx.SAMPLES_SQL) + f" select specimen_id, {R('avg(valid::int)')} as valid_share, count(*) as n from fx_samples group by 1")
def a17(spark, sf):
    return colors.coverage(fx.samples(spark, sf)).withColumn("valid_share", r6(F.col("valid_share")))


# ------------------------------------------------------------------ textures

@query("a5_average_textures", k.with_(fx.PIXELS_SQL) + f"""
select px, py, {R('(sum(round_even(r * 255e0, 0)::bigint) // count(*)) / 255e0')} as r, {R('(sum(round_even(g * 255e0, 0)::bigint) // count(*)) / 255e0')} as g, {R('(sum(round_even(b * 255e0, 0)::bigint) // count(*)) / 255e0')} as b, max(alpha) as alpha from fx_pixels group by 1, 2""")
def a5(spark, sf):
    return texture.average_textures(fx.pixels(spark, sf)).select("px", "py", *[r6(F.col(c)).alias(c) for c in "rgb"], "alpha")


@query("a5_average_textures_linear", k.with_(fx.PIXELS_SQL) + f"""
, s as (select px, py, avg({k.linear('r')}) as r, avg({k.linear('g')}) as g, avg({k.linear('b')}) as b, max(alpha) as alpha from fx_pixels group by 1, 2)
select px, py, {R(k.encoded('r'))} as r, {R(k.encoded('g'))} as g, {R(k.encoded('b'))} as b, alpha from s""")
def a5b(spark, sf):
    return texture.average_textures(fx.pixels(spark, sf), "linear").select("px", "py", *[r6(F.col(c)).alias(c) for c in "rgb"], "alpha")


CENTRES = "fx_centres as (select face_id, avg(u) as u, avg(v) as v from fx_atlas_uv group by 1)"
P = fx.PIXELS
SAMPLED = f"""
fx_pos as (select face_id, greatest(0, least({P - 1}, u * {P} - 0.5e0)) as x, greatest(0, least({P - 1}, (1 - v) * {P} - 0.5e0)) as y from fx_centres),
fx_taps as (select face_id, least(floor(x)::bigint + dx, {P - 1}) as px, least(floor(y)::bigint + dy, {P - 1}) as py,
  (case when dx = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when dy = 1 then y - floor(y) else 1 - (y - floor(y)) end) as w
  from (select *, unnest([0, 1, 0, 1]) as dx, unnest([0, 0, 1, 1]) as dy from fx_pos)),
fx_mix as (select texture_id, face_id, sum(w * alpha) as alpha, sum(r * w * alpha) as r, sum(g * w * alpha) as g, sum(b * w * alpha) as b from fx_taps join fx_pixels using (px, py) group by 1, 2),
fx_sampled as (select texture_id as specimen_id, face_id, alpha, alpha >= 0.99e0 as valid, case when alpha > 0 then r / alpha else 0 end as r, case when alpha > 0 then g / alpha else 0 end as g, case when alpha > 0 then b / alpha else 0 end as b from fx_mix)"""


def _centres(spark, sf):
    return m.uv_centroids(fx.atlas(spark, sf).corner_uv)


@query("j10_sample_image", k.with_(fx.ATLAS_SQL, fx.PIXELS_SQL, CENTRES, SAMPLED) + f" select specimen_id as texture_id, face_id, {R('r')} as r, {R('g')} as g, {R('b')} as b, {R('alpha')} as alpha from fx_sampled")
def j10(spark, sf):
    return texture.sample_image(_centres(spark, sf), fx.pixels(spark, sf)).select("texture_id", "face_id", *[r6(F.col(c)).alias(c) for c in ("r", "g", "b", "alpha")])


@query("c1_sample_colors", k.with_(fx.ATLAS_SQL, fx.PIXELS_SQL, CENTRES, SAMPLED) + f" select specimen_id, face_id as sample_id, case when valid then {R('r')} else 0 end as r, case when valid then {R('g')} else 0 end as g, case when valid then {R('b')} else 0 end as b, valid from fx_sampled")
def c1(spark, sf):
    own = plan.prepare_analysis(fx.atlas(spark, sf))
    out = colors.sample_colors(fx.pixels(spark, sf), _centres(spark, sf), own.measures, own.adjacency, own.samples)
    return out.select("specimen_id", "sample_id", *[r6(F.col(c)).alias(c) for c in "rgb"], "valid")


ATLAS_MEASURES = """
fx_at as (select face_id, p.x as ax, p.y as ay, p.z as az, q.x as bx, q.y as "by", q.z as bz, s.x as cx, s.y as cy, s.z as cz from fx_atlas_f f join fx_atlas_v p on p.vertex_id = f.a join fx_atlas_v q on q.vertex_id = f.b join fx_atlas_v s on s.vertex_id = f.c),
fx_ar as (select face_id, """ + k.AREA2 + """ / 2e0 as area from fx_at),
fx_as as (select face_id, least(p, q) as lo, greatest(p, q) as hi from (select face_id, unnest([a, b, c]) as p, unnest([b, c, a]) as q from fx_atlas_f)),
fx_an as (select s.face_id, t.face_id as nbr_id from fx_as s join fx_as t using (lo, hi) group by 1, 2)"""
PASS = """
{dst} as (select o.specimen_id, o.face_id, o.valid, case when o.valid then sum(n.r * a.area) / sum(a.area) else 0 end as r,
  case when o.valid then sum(n.g * a.area) / sum(a.area) else 0 end as g, case when o.valid then sum(n.b * a.area) / sum(a.area) else 0 end as b
  from {src} o join fx_an e on e.face_id = o.face_id left join (select * from {src} where valid) n on n.specimen_id = o.specimen_id and n.face_id = e.nbr_id
  left join fx_ar a on a.face_id = n.face_id group by 1, 2, 3)"""
SMOOTHED = [fx.ATLAS_SQL, fx.PIXELS_SQL, CENTRES, SAMPLED, ATLAS_MEASURES, "s0 as (select specimen_id, face_id, valid, r, g, b from fx_sampled)"] + [PASS.format(src=f"s{i}", dst=f"s{i + 1}") for i in range(3)]


@query("g2_smooth", k.with_(*SMOOTHED) + f" select specimen_id, face_id as sample_id, {R('r')} as r, {R('g')} as g, {R('b')} as b, valid from s3")
def g2(spark, sf):
    own = plan.prepare_analysis(fx.atlas(spark, sf))
    out = colors.sample_colors(fx.pixels(spark, sf), _centres(spark, sf), own.measures, own.adjacency, own.samples, smoothing=3)
    return out.select("specimen_id", "sample_id", *[r6(F.col(c)).alias(c) for c in "rgb"], "valid")


@query("g1_prepare_analysis", k.with_(fx.MESH_SQL, k.MEASURES_CTE, k.ADJACENCY_CTE) + f"""
select mesh_id, face_id, face_id as sample_id, {R('area')} as area, {R('area')} as sample_area, {R('mx')} as cx, {R('my')} as cy, {R('mz')} as cz, n as neighbours
from fx_measures join (select mesh_id, face_id, count(*) as n from fx_adj group by 1, 2) using (mesh_id, face_id)""")
def g1(spark, sf):
    own = plan.prepare_analysis(fx.mesh(spark, sf))
    n = own.adjacency.groupBy("mesh_id", "face_id").agg(F.count(F.lit(1)).alias("neighbours"))
    areas = plan.sample_areas(own.nearest, own.measures).withColumnRenamed("area", "sample_area")
    return own.measures.join(shuffled(n), ["mesh_id", "face_id"]).join(shuffled(own.nearest), ["mesh_id", "face_id"]).join(shuffled(areas), ["mesh_id", "sample_id"]).select(
        "mesh_id", "face_id", "sample_id", *[r6(F.col(c)).alias(c) for c in ("area", "sample_area", "cx", "cy", "cz")], "neighbours")


# ------------------------------------------------------------------ display

NEAREST = "fx_near as (select distinct face_id, (face_id % 50) + 1 as sample_id from fx_faces)"


def _nearest(spark, sf):
    return fx.faces(spark, sf).select("face_id", (F.col("face_id") % 50 + 1).alias("sample_id")).distinct()


@query("j6_expand_face_colors", k.with_(fx.SHARED_SQL, fx.VERTICES_SQL, fx.FACES_SQL, NEAREST) + f" select specimen_id, face_id, {R('r')} as r, {R('g')} as g, {R('b')} as b, valid from fx_shared join fx_near using (sample_id)")
def j6(spark, sf):
    out = colors.expand_face_colors(fx.shared(spark, sf), _nearest(spark, sf))
    return out.select("specimen_id", "face_id", *[r6(F.col(c)).alias(c) for c in "rgb"], "valid")


@query("j7_display", k.with_(fx.SHARED_SQL, fx.VERTICES_SQL, fx.FACES_SQL, NEAREST) + f"""
select specimen_id, face_id, case when valid then {R('label / 10e0')} else 0 end as r, case when valid then {R('label / 20e0')} else 0 end as g, case when valid then 0.25e0 else 0 end as b, valid from fx_shared join fx_near using (sample_id)""")
def j7(spark, sf):
    s = fx.shared(spark, sf).withColumn("label", F.when(F.col("valid"), F.col("label")).otherwise(F.lit(-1)))
    pal = s.filter("valid").select("label").distinct().select("label", (F.col("label") / 10.0).alias("r"), (F.col("label") / 20.0).alias("g"), F.lit(0.25).alias("b"))
    out = colors.display(s, _nearest(spark, sf), pal)
    return out.select("specimen_id", "face_id", *[r6(F.col(c)).alias(c) for c in "rgb"], "valid")


# ------------------------------------------------------------------ clusters and features

SHARED_LAB = k.with_(fx.SHARED_SQL, k.lab_cte("fx_shared", "lab"))


def _shared_lab(spark, sf):
    lab = colors.raw_lab(fx.shared(spark, sf))
    return lab.join(fx.shared(spark, sf).select("specimen_id", "sample_id", F.when(F.col("valid"), F.col("label")).otherwise(F.lit(-1)).alias("label")), ["specimen_id", "sample_id"])


CENTROIDS = SHARED_LAB + ", cen as (select specimen_id, label, avg(lab_l) as l, avg(lab_a) as a, avg(lab_b) as b, count(*) as n from lab where valid group by 1, 2)"


@query("a10_centroids", CENTROIDS + f" select specimen_id, label, {R('l')} as lab_l, {R('a')} as lab_a, {R('b')} as lab_b, n from cen")
def a10(spark, sf):
    return cluster.centroids(_shared_lab(spark, sf)).select("specimen_id", "label", r6(F.col("L")).alias("lab_l"), r6(F.col("a")).alias("lab_a"), r6(F.col("b")).alias("lab_b"), "n")


@query("a11_palette", CENTROIDS + ", pal as (select label, avg(l) as lab_l, avg(a) as lab_a, avg(b) as lab_b from cen group by 1)," + k.rgb_cte("pal", "out") + f"\nselect label, {LABS}, {R('dr')} as r, {R('dg')} as g, {R('db')} as b from out")
def a11(spark, sf):
    return cluster.palette(cluster.centroids(_shared_lab(spark, sf))).select("label", r6(F.col("L")).alias("lab_l"), *[r6(F.col(c)).alias(c) for c in ("lab_a", "lab_b", "r", "g", "b")])


@query("c7_match_costs", CENTROIDS + f""" select c.specimen_id, c.label, f.label as ref_label, {R('sqrt(power(c.l - f.l, 2) + power(c.a - f.a, 2) + power(c.b - f.b, 2))')} as cost
from cen c, cen f where f.specimen_id = (select min(specimen_id) from cen)""")
def c7(spark, sf):
    return cluster.match_costs(cut(cluster.centroids(_shared_lab(spark, sf)))).withColumn("cost", r6(F.col("cost")))


COMMON = "com as (select sample_id from fx_shared group by 1 having sum(valid::int) = (select count(distinct specimen_id) from fx_shared))"


@query("a9_common_valid", k.with_(fx.SHARED_SQL, COMMON) + " select sample_id from com")
def a9(spark, sf):
    return features.common_valid(fx.shared(spark, sf))


AREAS = k.with_(fx.SHARED_SQL, COMMON) + f"""
, grid as (select specimen_id, label from (select distinct specimen_id from fx_shared where sample_id in (select sample_id from com)), (select unnest(range({fx.SHARED_LABELS})) as label)),
ar as (select g.specimen_id, g.label, coalesce(sum(x.area), 0) as area from grid g left join (select specimen_id, label, area from fx_shared join fx_areas using (sample_id) where sample_id in (select sample_id from com)) x using (specimen_id, label) group by 1, 2)"""


@query("a8_cluster_areas", AREAS + f" select specimen_id, label, {R('area')} as area from ar")
def a8(spark, sf):
    return features.cluster_areas(_shared_lab(spark, sf), fx.shared_samples(spark, sf), fx.SHARED_LABELS, none="empty").withColumn("area", r6(F.col("area")))


def _area_query(norm, divisor):
    @query(f"c9_area_features_{norm}", AREAS + f" select specimen_id, label as feature_id, 'cluster_' || label || '.area_{norm}' as feature_name, {R('area / ' + divisor)} as value from ar")
    def c9(spark, sf):
        out = features.area_features(_shared_lab(spark, sf), fx.shared_samples(spark, sf), fx.SHARED_LABELS, norm, none="empty")
        return out.withColumn("value", r6(F.col("value")))


_area_query("fraction", "sum(area) over (partition by specimen_id)")
_area_query("l2", "sqrt(sum(area * area) over (partition by specimen_id))")
_area_query("none", "1e0")

COLOR_FEATURES = k.with_(fx.SHARED_SQL, COMMON, k.lab_cte("fx_shared", "lab")) + f"""
select specimen_id, sample_id * 3 + j as feature_id, 'face_' || face_id || '.' || (['L', 'a', 'b'])[j + 1] as feature_name, {R('(case j when 0 then lab_l when 1 then lab_a else lab_b end)')} as value
from (select *, unnest([0, 1, 2]) as j from lab where sample_id in (select sample_id from com)) join fx_areas using (sample_id)"""


@query("c8_color_features", COLOR_FEATURES)
def c8(spark, sf):
    return features.color_features(_shared_lab(spark, sf), fx.shared_samples(spark, sf), "drop", none="empty").withColumn("value", r6(F.col("value")))


@query("c10_population_features", COLOR_FEATURES)
def c10(spark, sf):
    return features.population_features(_shared_lab(spark, sf), fx.shared_samples(spark, sf), False, fx.SHARED_LABELS, none="empty").withColumn("value", r6(F.col("value")))


@query("c10_population_features_areas", AREAS + f" select specimen_id, label as feature_id, 'cluster_' || label || '.area_l2' as feature_name, {R('area / sqrt(sum(area * area) over (partition by specimen_id))')} as value from ar")
def c10b(spark, sf):
    return features.population_features(_shared_lab(spark, sf), fx.shared_samples(spark, sf), True, fx.SHARED_LABELS, none="empty").withColumn("value", r6(F.col("value")))


@query("c4_kmeans_by")
def c4(spark, sf):
    lab = colors.raw_lab(fx.samples(spark, sf)).filter("valid")
    return cluster.kmeans_by(lab, 8)


@query("c4_kmeans_separate_groups", k.with_(fx.SAMPLES_SQL) + """
, placed as (select specimen_id, sample_id, cast(floor(sqrt(sample_id % 121)) as bigint) as grp from fx_samples),
used as (select specimen_id from placed group by 1 having count(distinct grp) = 11)
select specimen_id, sample_id, min(sample_id) over (partition by specimen_id, grp) as first_sample from placed join used using (specimen_id)""")
def c4b(spark, sf):
    """Eleven tight groups of unequal size in every specimen that has them all; clusters are named by their first sample."""
    at = fx.samples(spark, sf).select("specimen_id", "sample_id", F.floor(F.sqrt(F.col("sample_id") % 121)).alias("grp"))
    used = at.groupBy("specimen_id").agg(F.count_distinct("grp").alias("n")).filter("n = 11")
    wobble = (F.col("sample_id") % 7).cast("double") / 1000.0
    lab = cut(at.join(used, "specimen_id", "left_semi").select(
        "specimen_id", "sample_id", (F.col("grp") % 3 * 40.0 + 5.0 + wobble).alias("L"), (F.floor(F.col("grp") / 3) * 30.0 - wobble).alias("a"), (wobble * 2.0).alias("b")))
    named = lab.join(cluster.kmeans_by(lab, 11), ["specimen_id", "L", "a", "b"])
    first = Window.partitionBy("specimen_id", "label")
    return named.select("specimen_id", "sample_id", F.min("sample_id").over(first).alias("first_sample"))


SUPER_SQL = k.with_(fx.SAMPLES_SQL) + """
, placed as (select specimen_id, sample_id, cast(floor(sqrt(sample_id % 121)) as bigint) as grp from fx_samples),
used as (select specimen_id from placed group by 1 having count(distinct grp) = 11)"""


def _super_groups(spark, sf):
    """Eleven tight groups, a unit apart in four families of groups that are twenty apart."""
    at = fx.samples(spark, sf).select("specimen_id", "sample_id", F.floor(F.sqrt(F.col("sample_id") % 121)).alias("grp"))
    used = at.groupBy("specimen_id").agg(F.count_distinct("grp").alias("n")).filter("n = 11")
    wobble = (F.col("sample_id") % 7).cast("double") / 1000.0
    return cut(at.join(used, "specimen_id", "left_semi").select(
        "specimen_id", "sample_id", F.lit(True).alias("valid"), (F.col("grp") % 4 * 20.0 + 5.0).alias("L"), (F.floor(F.col("grp") / 4) * 1.0 + wobble).alias("a"), wobble.alias("b")))


@query("c5_separate_families", SUPER_SQL + """
select specimen_id, sample_id, min(sample_id) over (partition by specimen_id, grp % 4) as first_sample from placed join used using (specimen_id)""")
def c5b(spark, sf):
    """Eleven clusters merge to the four families; clusters are named by their first sample."""
    labelled, _ = cluster.cluster_colors(_super_groups(spark, sf), 4, 11)
    first = Window.partitionBy("specimen_id", "label")
    return labelled.select("specimen_id", "sample_id", F.min("sample_id").over(first).alias("first_sample"))


@query("c7_align_separate_families", SUPER_SQL + """
select specimen_id, sample_id, grp % 4 * 20e0 + 5e0 as palette_l from placed join used using (specimen_id)""")
def c7c(spark, sf):
    """Aligned labels mean the same family in every specimen, so the palette has the families' lightness."""
    labelled, centres = cluster.cluster_colors(_super_groups(spark, sf), 4, 11)
    moved, _, shared = cluster.align_clusters(centres, labelled)
    return moved.join(shared.select("label", r6(F.col("L")).alias("palette_l")), "label").select("specimen_id", "sample_id", "palette_l")


@query("c5_consolidated_clusters")
def c5(spark, sf):
    lab = colors.raw_lab(fx.samples(spark, sf))
    return cluster.cluster_colors(lab, 8, 24)[1]


@query("c7_align_clusters")
def c7b(spark, sf):
    labelled, centres = cluster.cluster_colors(colors.raw_lab(fx.samples(spark, sf)), 8)
    return cluster.align_clusters(centres, labelled)[0]


@query("c17_run_colors_unclustered", k.with_(fx.ATLAS_SQL, fx.PIXELS_SQL, CENTRES, SAMPLED, "zeroed as (select specimen_id, face_id as sample_id, valid, case when valid then r else 0 end as r, case when valid then g else 0 end as g, case when valid then b else 0 end as b from fx_sampled)", k.lab_cte("zeroed", "lab")) + """
select specimen_id, sample_id, valid, """ + ", ".join(f"case when valid then {R(c)} else 0 end as {c}" for c in ("lab_l", "lab_a", "lab_b")) + " from lab")
def c17(spark, sf):
    out = plan.run_colors(fx.atlas(spark, sf), fx.pixels(spark, sf), plan.ColorOptions(sample_count=None, clustering=False))
    return _labs(out.processed)


@query("c17_run_colors_sampled")
def c17c(spark, sf):
    """A real sample budget: 60 of the atlas's 242 faces."""
    out = plan.run_colors(fx.atlas(spark, sf), fx.pixels(spark, sf), plan.ColorOptions(sample_count=60, smoothing=1, clusters=6, initial_clusters=12))
    return _labs(out.processed, "label")


@query("c17_run_colors")
def c17b(spark, sf):
    out = plan.run_colors(fx.atlas(spark, sf), fx.pixels(spark, sf), plan.ColorOptions(sample_count=None, smoothing=1, clusters=6, initial_clusters=12))
    return _labs(out.processed, "label")
