"""Feature tables, models and plot helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import sqlkit as k
from catalog.fixtures import R, r6
from catalog.registry import query
from surfpop.operators import models, neighbors
from surfpop.plans import colors as color_plan
from surfpop.plans import population
from surfpop.session import cut, work_root
from surfpop.sources import tables

FEAT = k.with_(fx.FEATURES_SQL)


@query("a15_fit_scaler", FEAT + f" select feature_id, feature_name, {R('avg(value)')} as center, {R('stddev_pop(value)')} as scale from fx_features group by 1, 2")
def a15(spark, sf):
    return models.fit_scaler(fx.features(spark, sf)).select("feature_id", "feature_name", r6(F.col("center")).alias("center"), r6(F.col("scale")).alias("scale"))


@query("c11_gram", FEAT + f"""
, c as (select specimen_id, feature_id, value - avg(value) over (partition by feature_id) as v from fx_features)
select p.feature_id as i, q.feature_id as j, {R('sum(p.v * q.v)')} as value from c p join c q using (specimen_id) where p.feature_id <= q.feature_id group by 1, 2""")
def c11g(spark, sf):
    f = fx.features(spark, sf)
    prep = models.fit_scaler(f).select("feature_id", F.lit(0.0).alias("center"), F.lit(1.0).alias("scale"), F.col("center").alias("mean"))
    return models.gram(cut(models.scaled(f, prep))).withColumn("value", r6(F.col("value")))


@query("c13_model_checks", FEAT + """
, p as (select feature_id, count(*) as n, max(value) = min(value) as k from fx_features group by 1)
select (select count(distinct specimen_id) from fx_features) as n_specimens, count(*) as n_features, sum((n <> (select count(distinct specimen_id) from fx_features))::bigint)::bigint as ragged, sum(k::bigint)::bigint as constant from p""")
def c13(spark, sf):
    return models.model_checks(fx.features(spark, sf))


@query("j12_knn_graph", k.with_("e as (select vec_id, [x::double for x in embedding] as v from embeddings)") + f"""
, d as (select p.vec_id as specimen_id, q.vec_id as nbr_id, list_distance(p.v, q.v) as dist from e p, e q where p.vec_id <> q.vec_id)
select specimen_id, rank, nbr_id, {R('dist')} as dist from (select *, row_number() over (partition by specimen_id order by dist, nbr_id) as rank from d) where rank <= 15""")
def j12(spark, sf):
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("specimen_id"), F.posexplode("embedding").alias("feature_id", "value"))
    out = neighbors.knn_graph(e.withColumn("value", F.col("value").cast("double")))
    return out.withColumn("dist", r6(F.col("dist")))


@query("c11_fit_pca_scores")
def c11(spark, sf):
    return models.fit_pca(fx.features(spark, sf), 2).scores


# Full-rank reconstruction gives the input back.
@query("c11_pca_round_trip", FEAT + f" select specimen_id as row_id, feature_id, feature_name, {R('value')} as value from fx_features")
def c11b(spark, sf):
    f = fx.features(spark, sf)
    model = models.fit_pca(f, 64)
    return models.reconstruct(model, model.scores.withColumnRenamed("specimen_id", "row_id")).select("row_id", "feature_id", "feature_name", r6(F.col("value")).alias("value"))


@query("c12_fit_ica_scores")
def c12(spark, sf):
    return models.fit_ica(fx.features(spark, sf), 3).scores


# Scores of an unmixed model still give the whitened data back: their covariance is the unit matrix.
@query("c12_ica_covariance", "select i::int as i, j::int as j, (case when i = j then 1 else 0 end)::double as value from (select unnest(range(3)) as i), (select unnest(range(3)) as j)")
def c12b(spark, sf):
    s = models.fit_ica(fx.features(spark, sf), 3).scores
    pair = s.join(s.select("specimen_id", F.col("component").alias("j"), F.col("value").alias("w")), "specimen_id")
    return pair.groupBy(F.col("component").alias("i"), "j").agg((F.round(F.covar_pop("value", "w"), 6) + F.lit(0.0)).alias("value"))


def _given(spark, sf):
    """A fixed model: component c weighs feature f by ((f * (c + 2)) % 7 - 3) / 10, centred and scaled per feature."""
    f = fx.features(spark, sf)
    prep = models.fit_scaler(f).withColumn("mean", F.lit(0.25))
    loads = prep.select("feature_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("component"))
    weight = ((F.col("feature_id") * (F.col("component") + 2)) % 7 - 3).cast("double") / 10.0
    loads = loads.select("component", "feature_id", weight.alias("weight"), weight.alias("inverse"))
    return f, models.Model("pca", prep, loads, None, None)


GIVEN = FEAT + """
, prep as (select feature_id, feature_name, avg(value) as c, stddev_pop(value) as s from fx_features group by 1, 2),
ld as (select feature_id, k as component, ((feature_id * (k + 2)) % 7 - 3)::double / 10e0 as w from prep, (select unnest([0, 1]) as k)),
sc as (select specimen_id, component, sum(((value - c) / s - 0.25e0) * w) as v from fx_features join prep using (feature_id) join ld using (feature_id) group by 1, 2),
rec as (select specimen_id, feature_id, feature_name, (sum(v * w) + 0.25e0) * max(s) + max(c) as value from sc join ld using (component) join prep using (feature_id) group by 1, 2, 3)"""


@query("c14_transform", GIVEN + f" select specimen_id, component::int as component, {R('v')} as value from sc")
def c14(spark, sf):
    f, model = _given(spark, sf)
    return models.transform(f, model).withColumn("value", r6(F.col("value")))


@query("c19_saved_model_scores", GIVEN + f" select specimen_id, component::int as component, {R('v')} as value from sc")
def c19(spark, sf):
    """A model that is saved, loaded and used gives the scores of the model itself."""
    f, model = _given(spark, sf)
    saved = tables.save_model(model, f"{work_root(spark)}/model-{uuid.uuid4().hex}")
    return models.transform(f, tables.load_model(spark, saved)).withColumn("value", r6(F.col("value")))


@query("c15_reconstruct", GIVEN + f" select specimen_id, feature_id, feature_name, {R('value')} as value from rec")
def c15(spark, sf):
    f, model = _given(spark, sf)
    coords = models.transform(f, model).withColumnRenamed("specimen_id", "row_id")
    out = models.reconstruct(model, coords)
    return out.select(F.col("row_id").alias("specimen_id"), "feature_id", "feature_name", r6(F.col("value")).alias("value"))


@query("c16_reconstruct_colors", GIVEN + """
, lab as (select specimen_id, feature_id // 3 as face_id, greatest(0, least(100, max(case when feature_id % 3 = 0 then value end))) as lab_l, max(case when feature_id % 3 = 1 then value end) as lab_a, max(case when feature_id % 3 = 2 then value end) as lab_b from rec group by 1, 2),""" + k.rgb_cte("lab", "rgb") + f"""
select specimen_id, face_id, {R('dr')} as r, {R('dg')} as g, {R('db')} as b, true as valid from rgb""")
def c16(spark, sf):
    f, model = _given(spark, sf)
    coords = models.transform(f, model).withColumnRenamed("specimen_id", "row_id")
    faces = f.select(F.floor(F.col("feature_id") / 3).alias("face_id")).distinct()
    samples = faces.select("face_id", F.col("face_id").alias("sample_id"))
    out = models.reconstruct_colors(model, coords, samples, samples)
    return out.select("specimen_id", "face_id", *[r6(F.col(c)).alias(c) for c in "rgb"], "valid")


@query("w8_plot_axes", GIVEN + f" select specimen_id, {R('max(case when component = 0 then v end)')} as x, {R('max(case when component = 1 then v end)')} as y from sc group by 1")
def w8(spark, sf):
    f, model = _given(spark, sf)
    return models.plot_axes(models.transform(f, model), 0, 1).select("specimen_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("w7_morph_coordinates", GIVEN + f"""
, bd as (select component, min(v) as lo, max(v) as hi from sc group by 1)
select component::int as component, {R('case component when 0 then lo + 0.25e0 * (hi - lo) else lo + 0.75e0 * (hi - lo) end')} as value, {R('case component when 0 then 0.25e0 else 0.75e0 end')} as position from bd""")
def w7(spark, sf):
    f, model = _given(spark, sf)
    scores = models.transform(f, model)
    out = models.morph_coordinates(scores, scores.agg(F.min("specimen_id")).scalar(), (0, 1), (0.25, 0.75))
    return out.select("component", r6(F.col("value")).alias("value"), r6(F.col("position")).alias("position"))


def _color_result(spark, sf):
    return color_plan.run_colors(fx.atlas(spark, sf), fx.pixels(spark, sf), color_plan.ColorOptions(sample_count=10000, clustering=False))


@query("c18_run_population")
def c18(spark, sf):
    return population.run_population(_color_result(spark, sf), "pca", 2).scores


@query("c18_morph")
def c18b(spark, sf):
    result = _color_result(spark, sf)
    model = population.run_population(result, "pca", 2)
    first = model.scores.agg(F.min("specimen_id")).first()[0]
    return population.morph(result, model, first, (0, 1), (0.1, 0.9))
