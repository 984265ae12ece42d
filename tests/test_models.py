"""Clusters, alignment and models against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfpop.operators import align, cluster, colors, models
from surfpop.session import wide_parts
from surfpop.sources import tables


@pytest.fixture(scope="module")
def lab(spark):
    rng = np.random.default_rng(2)
    rows = []
    for sid in ("a", "b"):
        for k in range(300):
            centre = [(20, 0, 0), (60, 30, -20), (80, -40, 10)][k % 3]
            rows.append((sid, k, True, *[float(c + rng.normal()) for c in centre]))
        rows.append((sid, 300, False, 0.0, 0.0, 0.0))
    return spark.createDataFrame(rows, ["specimen_id", "sample_id", "valid", "L", "a", "b"]).cache()


def test_kmeans_finds_separate_groups(lab):
    labelled, centres = cluster.cluster_colors(lab, 3)
    got = np.array(sorted((r["specimen_id"], round(r["L"], -1), r["n"]) for r in centres.collect()), dtype=object)
    assert [g[2] for g in got] == [100] * 6
    assert labelled.filter("label = -1").count() == 2
    assert labelled.filter("(label = -1) <> (NOT valid)").count() == 0


def test_kmeans_over_blocks_equals_one_block(lab):
    key = ["specimen_id", "L", "a", "b"]
    whole = cluster.kmeans_by(lab.filter("valid"), 4, n_init=2)
    split = cluster.kmeans_by(lab.filter("valid"), 4, n_init=2, block=64)
    both = whole.join(split.withColumnRenamed("label", "other"), key)
    assert both.count() == 600 and both.filter("label <> other").count() == 0


@pytest.mark.parametrize("block", [16384, 40])
def test_kmeans_finds_24_tight_groups_of_unequal_size(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(24):
        for _ in range(4 + 12 * (g % 4 == 0) + 40 * (g == 5)):
            rows.append(("s", g, *map(float, np.array([g % 4 * 25, g // 4 % 3 * 30, g // 12 * 50]) + rng.normal(size=3) * 0.01)))
    lab = spark.createDataFrame(rows, ["specimen_id", "grp", "L", "a", "b"])
    found = lab.join(cluster.kmeans_by(lab, 24, n_init=3, block=block), ["specimen_id", "L", "a", "b"]).collect()
    assert len(found) == len(rows) and len({(r["grp"], r["label"]) for r in found}) == 24


@pytest.mark.parametrize("block", [16384, 4])
def test_kmeans_fills_every_cluster(spark, block):
    """As many clusters as colours, most of them nearly alike: none may stay empty."""
    rows = [("s", float(v), 0.0, 0.0) for v in (0, 1e-9, 2e-9, 3e-9, 50, 50 + 1e-9, 100, 100 + 1e-9, 1e-5)]
    lab = spark.createDataFrame(rows * 2, ["specimen_id", "L", "a", "b"])
    assert len({r["label"] for r in cluster.kmeans_by(lab, 9, n_init=2, block=block).collect()}) == 9


def test_emptied_clusters_take_the_farthest_colours():
    x = np.array([[0.0, 0, 0], [1, 0, 0], [9, 0, 0], [5, 0, 0]])
    count, total, _, d = cluster._sums(x, np.ones(4), np.array([[0.0, 0, 0], [-50, 0, 0], [-60, 0, 0]]))
    new = cluster._move(np.zeros((3, 3)), count, total, x[cluster._farthest(x, d, 2)])
    assert count.tolist() == [4, 0, 0] and new[1:, 0].tolist() == [9, 5]


def test_draws_follow_the_weights():
    x = np.arange(12.0).reshape(4, 3)
    wins = np.bincount([cluster._draw(x, np.array([0.0, 1, 2, 7]), cluster._salt("s", 0, run, 0))[1] for run in range(2000)], minlength=4) / 2000
    assert wins[0] == 0 and np.allclose(wins[1:], [0.1, 0.2, 0.7], atol=0.04)


@pytest.mark.parametrize("colours", [40, 500])
def test_runs_side_by_side_step_as_each_alone(colours):
    x = np.random.default_rng(5).integers(0, 40, (colours, 3)).astype(float)
    w, salts = np.arange(1.0, colours + 1), [[cluster._salt("s", 0, run, step) for step in range(6)] for run in range(4)]
    centres, inertia = cluster._settle_runs(x, w, 6, salts, 0.01, 300)
    for run, own in enumerate(salts):
        near = ((x[:, None] - centres[run]) ** 2).sum(axis=2)
        mean = np.array([np.average(x[near.argmin(axis=1) == j], axis=0, weights=w[near.argmin(axis=1) == j]) for j in range(6)])
        assert ((mean - centres[run]) ** 2).sum() <= 0.01 and np.isclose(inertia[run], (w * near.min(axis=1)).sum())
        assert np.array_equal(cluster._settle_runs(x, w, 6, [own], 0.01, 300)[0][0], centres[run])


def test_linkage_and_matching_are_dealt_by_count(lab):
    """Small rows with much work each: not put into one task by their bytes."""
    centres = cluster.cluster_colors(lab, 3)[1]
    for work in (cluster.consolidate(centres, 2), cluster.label_map(centres)):
        assert work.rdd.getNumPartitions() == wide_parts(lab.sparkSession)


def test_consolidation_to_fewer_clusters(lab):
    _, centres = cluster.cluster_colors(lab, 3, 9)
    assert sorted(r["n"] for r in centres.collect()) == [100] * 6


def test_too_few_colors_is_an_error(lab):
    with pytest.raises(ValueError):
        cluster.kmeans_by(lab.filter("valid AND sample_id < 2"), 3)


def test_assignment_is_minimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 6):
        cost = rng.random((n, n))
        got = cluster.best_assignment(cost)
        assert sorted(got) == list(range(n))
        want = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert np.isclose(cost[np.arange(n), got].sum(), want)


def test_matching_gives_labels_one_meaning(lab):
    labelled, centres = cluster.cluster_colors(lab, 3)
    moved, named, shared = cluster.align_clusters(centres, labelled)
    spread = named.groupBy("label").agg((F.max("L") - F.min("L")).alias("d")).collect()
    assert len(spread) == 3 and all(r["d"] < 2 for r in spread)
    assert shared.count() == 3 and moved.filter("valid AND label < 0").count() == 0


def test_normalizing_to_own_moments_changes_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [("s", k, *map(float, rng.random(3)), True) for k in range(80)]
    df = spark.createDataFrame(rows, ["specimen_id", "sample_id", "r", "g", "b", "valid"])
    moved = colors.normalize(df, *colors.normalization_stats(df))
    both = moved.join(colors.raw_lab(df).select("sample_id", F.col("L").alias("l2"), F.col("a").alias("a2")), "sample_id")
    assert both.filter("abs(L - l2) > 1e-6 OR abs(a - a2) > 1e-6").count() == 0


def _features(spark, n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)) @ np.diag(np.linspace(3, 0.5, d))
    rows = [(i, j, f"face_{j // 3}.{'Lab'[j % 3]}", float(x[i, j])) for i in range(n) for j in range(d)]
    return x, spark.createDataFrame(rows, ["specimen_id", "feature_id", "feature_name", "value"])


@pytest.mark.parametrize("n,d,dense", [(30, 6, 1024), (8, 15, 1024), (30, 12, 4)])
def test_pca_matches_svd(spark, n, d, dense):
    x, df = _features(spark, n, d)
    model = models.fit_pca(df, 3, dense=dense)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    got = np.zeros((n, 3))
    for r in model.scores.collect():
        got[r["specimen_id"], r["component"]] = r["value"]
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-5)
    var = [r["value"] for r in model.variance.orderBy("component").collect()]
    assert np.allclose(var, s[:3] ** 2 / (n - 1))


def test_pca_needs_rank(spark):
    _, df = _features(spark, 5, 6)
    with pytest.raises(ValueError):
        models.fit_pca(df, 5)


def test_saved_model_transforms(spark, tmp_path):
    _, df = _features(spark, 20, 6)
    model = models.fit_pca(df, 2)
    loaded = models_loaded = tables.load_model(spark, tables.save_model(model, str(tmp_path / "m")))
    both = models.transform(df, loaded).join(model.scores.withColumnRenamed("value", "w"), ["specimen_id", "component"])
    assert both.count() == 40 and both.filter("abs(value - w) > 1e-9").count() == 0
    with pytest.raises(Exception):
        tables.save_model(models_loaded, str(tmp_path / "m"))


def test_ica_separates_sources(spark):
    rng = np.random.default_rng(6)
    s = np.stack([np.sign(np.sin(np.arange(400) * 0.7)) + 0.05 * rng.normal(size=400), rng.uniform(-1, 1, 400)], axis=1)
    x = s @ np.array([[1.0, 0.6, 0.2], [-0.4, 1.0, 0.7]])
    rows = [(i, j, f"face_0.{'Lab'[j]}", float(x[i, j])) for i in range(400) for j in range(3)]
    model = models.fit_ica(spark.createDataFrame(rows, ["specimen_id", "feature_id", "feature_name", "value"]), 2)
    got = np.zeros((400, 2))
    for r in model.scores.collect():
        got[r["specimen_id"], r["component"]] = r["value"]
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert np.allclose(np.sort(c.max(axis=0)), 1, atol=0.02)
    back = models.reconstruct(model, model.scores.withColumnRenamed("specimen_id", "row_id")).collect()
    assert max(abs(r["value"] - x[r["row_id"], r["feature_id"]]) for r in back) < 1e-6


def test_gpa_recovers_one_shape(spark):
    rng = np.random.default_rng(9)
    shape = rng.normal(size=(7, 3))
    rows = []
    for sid in range(12):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        for k, p in enumerate(shape @ q * (1 + sid / 10) + rng.normal(size=3)):
            rows.append((sid, f"P{k}", k, *map(float, p)))
    lm = spark.createDataFrame(rows, ["specimen_id", "label", "ord", "x", "y", "z"])
    fit = align.gpa(lm, scale=True)
    assert fit.converged and fit.transforms.agg(F.max("residual")).first()[0] < 1e-12
    for r in fit.transforms.collect():
        rot = np.array(r["r"]).reshape(3, 3)
        assert np.allclose(rot @ rot.T, np.eye(3)) and np.isclose(np.linalg.det(rot), 1)
    sizes = [r["size"] for r in align.centroid_size(lm).collect()]
    mean = np.array([[r["x"], r["y"], r["z"]] for r in fit.mean.collect()])
    assert np.isclose(np.linalg.norm(mean), np.mean(sizes))


def test_incomplete_inputs_are_refused(spark):
    ragged = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (2, 1, 3.0), (3, 1, 1.0), (3, 2, 5.0)], "specimen_id int, feature_id int, value double")
    with pytest.raises(ValueError):
        models.fit_pca(ragged, 1)
    colours = spark.createDataFrame(
        [(s, i, 0.2, 0.4, 0.6, s == 1) for s in (1, 2) for i in range(3)], "specimen_id int, sample_id int, r double, g double, b double, valid boolean")
    with pytest.raises(ValueError):
        colors.normalization_stats(colours)
    with pytest.raises(ValueError):
        colors.process_colors(colours)


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_scatter_adds_up_from_arrow_buffers(spark, capsys, monkeypatch, kind):
    """Cells of a batch stay numbers: as Python objects, ten thousand wide rows took gigabytes. A missing cell counts as 0."""
    monkeypatch.setattr(models, "GRAM_CELLS", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 7))
    x[rng.random(x.shape) < 0.2] = 0.0
    rows = [(s, int(f), float(x[s, f])) for s in range(len(x)) for f in rng.permutation(7) if x[s, f]]
    cells = spark.createDataFrame(rows, "specimen_id bigint, feature_id bigint, value double").withColumn("feature_id", F.col("feature_id").cast(kind))
    out = models.gram(cells)
    capsys.readouterr()
    out.explain()
    assert "MapInPandas" not in capsys.readouterr().out
    assert out.schema["i"].dataType.simpleString() == kind
    got = {(int(r["i"]), int(r["j"])): r["value"] for r in out.collect()}
    assert sorted(got) == [(i, j) for i in range(7) for j in range(i, 7)]
    assert all(abs(v - (x.T @ x)[k]) < 1e-9 for k, v in got.items())
