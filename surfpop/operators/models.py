"""Population models as tables: PCA, ICA, transform, inverse and plot helpers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import color as col
from surfpop.functions import names
from surfpop.operators import checks, colors
from surfpop.session import cut

# Largest side of a dense symmetric problem on the driver; beyond it subspace rounds are used.
SHARES = 32  # of the samples that a reconstructed row is spread over
MAX_DENSE = 1024
# Cells of one step of a scatter matrix.
GRAM_CELLS = 1_000_000
MAX_COMPONENTS = 64


@dataclass(frozen=True)
class Model:
    """``prep(feature_id, feature_name, center, scale, mean)``, ``loadings(component, feature_id,
    weight, inverse)``, ``scores(specimen_id, component, value)``, ``variance(component, value)``."""

    method: str
    prep: DataFrame
    loadings: DataFrame
    scores: DataFrame
    variance: DataFrame


def fit_scaler(features: DataFrame) -> DataFrame:
    """Centre and spread per feature; a constant feature gets scale 1."""
    spread = F.stddev_pop("value")
    return features.groupBy("feature_id").agg(
        F.min("feature_name").alias("feature_name"), F.avg("value").alias("center"),
        F.when(spread > 0.0, spread).otherwise(F.lit(1.0)).alias("scale"),
    )


def scaled(features: DataFrame, prep: DataFrame) -> DataFrame:
    """(specimen_id, feature_id, value) centred for the model: ((x - center) / scale) - mean."""
    return features.join(prep, "feature_id").select(
        "specimen_id", "feature_id", ((F.col("value") - F.col("center")) / F.col("scale") - F.col("mean")).alias("value")
    )


def _prep(features: DataFrame, standardize: bool) -> DataFrame:
    prep = fit_scaler(features)
    if standardize:
        return prep.withColumn("mean", F.lit(0.0))
    return prep.select("feature_id", "feature_name", F.lit(0.0).alias("center"), F.lit(1.0).alias("scale"),
                       F.col("center").alias("mean"))


def model_checks(features: DataFrame) -> DataFrame:
    """One row: specimens, features, missing or repeated cells, features without spread."""
    per = features.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("specimen_id").alias("d"), F.max("value").alias("hi"), F.min("value").alias("lo")
    )
    specimens = features.agg(F.count_distinct("specimen_id").alias("n")).scalar()
    return per.agg(
        specimens.alias("n_specimens"), F.count(F.lit(1)).alias("n_features"),
        F.coalesce(F.sum(((F.col("n") != specimens) | (F.col("d") != specimens)).cast("bigint")), F.lit(0)).alias("ragged"),
        F.coalesce(F.sum((F.col("hi") == F.col("lo")).cast("bigint")), F.lit(0)).alias("constant"),
    )


def gram(features: DataFrame) -> DataFrame:
    """Scatter between features, (i, j, value) with i <= j, from centred long rows.

    Values of one specimen are packed into one row; each partition adds up its products
    in numpy, straight from Arrow buffers, and only those sums are shuffled.
    """
    return _gram(features, "specimen_id", "feature_id").filter("i <= j")


def _gram(features: DataFrame, rows: str, cols: str) -> DataFrame:
    ids = sorted(r[0] for r in features.select(cols).distinct().limit(MAX_DENSE + 1).collect())
    if len(ids) > MAX_DENSE:
        raise ValueError(f"A dense scatter is limited to {MAX_DENSE} columns.")
    kind = features.schema[cols].dataType.simpleString()
    packed = features.groupBy(rows).agg(F.collect_list(F.struct(F.col(cols).alias("k"), F.col("value").alias("v"))).alias("s")).select(
        F.col("s.k").alias("k"), F.col("s.v").alias("v"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((len(ids), len(ids))), False
        step = max(1, GRAM_CELLS // max(len(ids), 1))
        for b in batches:
            known = pa.array(ids, b.schema.field("k").type.value_type)
            for at in range(0, b.num_rows, step):
                keys, values = (c.slice(at, step) for c in b.columns)
                x = np.zeros((len(keys), len(ids)))
                row = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False))
                place = pc.index_in(keys.flatten(), value_set=known).to_numpy(zero_copy_only=False)
                x[row, place] = values.flatten().to_numpy(zero_copy_only=False)
                total += x.T @ x
                used = True
        if used:
            i, j = np.divmod(np.arange(total.size), len(ids))
            yield pa.RecordBatch.from_arrays([known.take(pa.array(i)), known.take(pa.array(j)), pa.array(total.ravel())], names=["i", "j", "value"])

    return packed.mapInArrow(add, f"i {kind}, j {kind}, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def _dense(features: DataFrame, rows: str, cols: str) -> tuple[list, np.ndarray]:
    table = cut(_gram(features, rows, cols))
    ids = sorted(r[0] for r in table.select("i").distinct().collect())
    place = {v: i for i, v in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in table.toLocalIterator():
        out[place[r["i"]], place[r["j"]]] = r["value"]
    return ids, (out + out.T) / 2


def _table(spark, key: str, kind: str, ids: list, matrix: np.ndarray) -> DataFrame:
    rows = [(v, c, float(matrix[i, c])) for i, v in enumerate(ids) for c in range(matrix.shape[1])]
    return spark.createDataFrame(rows, f"{key} {kind}, component int, value double")


def _project(features: DataFrame, weights: DataFrame, on: str, keep: str) -> DataFrame:
    """Sum over ``on`` of value * weight per (keep, component).

    The weights hold a few numbers per id, packed into one row, so the join does not
    multiply the long table by the number of components.
    """
    packed = weights.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("w"))
    parts = features.join(packed, on).select(keep, F.col("value").alias("x"), F.explode("w").alias("w"))
    return parts.groupBy(keep, F.col("w.component").alias("component")).agg(F.sum(F.col("x") * F.col("w.value")).alias("value"))


def _subspace(data: DataFrame, k: int, n: int, d: int, tol: float = 1e-12, max_rounds: int = 500):
    """Leading singular values and right vectors by rounds of X'X on a small block of vectors."""
    spark = data.sparkSession
    kind = data.schema["feature_id"].dataType.simpleString()
    width = min(k + 8, n, d)
    ids = data.select("feature_id").distinct()
    vectors = cut(ids.select("feature_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("component")).select(
        "feature_id", "component", (F.xxhash64("feature_id", "component") / F.lit(float(2**63))).alias("value")
    ))

    def inner(table, key):
        """Products between the few columns of a long table, as a small matrix."""
        wide = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("w"))
        pairs = wide.select(F.explode("w").alias("p"), "w").select("p", F.explode("w").alias("q"))
        out = np.zeros((width, width))
        for r in pairs.groupBy("p.component", F.col("q.component").alias("c2")).agg(F.sum(F.col("p.value") * F.col("q.value")).alias("v")).collect():
            out[r["component"], r["c2"]] = r["v"]
        return (out + out.T) / 2

    def mix(table, key, matrix):
        rows = spark.createDataFrame(
            [(i, j, float(matrix[i, j])) for i in range(width) for j in range(matrix.shape[1])], "component int, c2 int, m double"
        )
        return table.join(rows, "component").groupBy(key, F.col("c2").alias("component")).agg(F.sum(F.col("value") * F.col("m")).alias("value"))

    def whiten(matrix):
        lam, vec = np.linalg.eigh(matrix)
        return vec / np.sqrt(np.maximum(lam, lam.max() * 1e-30))

    old = np.zeros(k)
    for _ in range(max_rounds):
        vectors = cut(mix(vectors, "feature_id", whiten(inner(vectors, "feature_id"))))
        images = cut(_project(data, vectors, "feature_id", "specimen_id"))
        lam, rot = np.linalg.eigh(inner(images, "specimen_id"))
        order = np.argsort(lam)[::-1]
        now = lam[order][:k]
        if np.all(np.abs(now - old) <= tol * max(now[0], 1e-300)):
            return np.sqrt(np.maximum(now, 0)), cut(mix(vectors, "feature_id", rot[:, order[:k]]))
        old = now
        vectors = cut(_project(data, images, "specimen_id", "feature_id"))
    raise RuntimeError("Subspace rounds did not settle.")


def _decompose(data: DataFrame, k: int, dense: int):
    """(singular values, right vectors(feature_id, component, value), n) of centred long data."""
    spark = data.sparkSession
    n, d = data.agg(F.count_distinct("specimen_id"), F.count_distinct("feature_id")).first()
    if n < 2:
        raise ValueError("Population models need at least two specimens.")
    fkind, skind = (data.schema[c].dataType.simpleString() for c in ("feature_id", "specimen_id"))
    if min(n, d) <= dense:
        rows, cols = ("specimen_id", "feature_id") if d <= n else ("feature_id", "specimen_id")
        ids, matrix = _dense(data, rows, cols)
        lam, vec = np.linalg.eigh(matrix)
        lam, vec = lam[::-1], vec[:, ::-1]
        # Eigenvalues are squared singular values: rounding reaches eps times the largest.
        rank = int((lam > lam[0] * max(n, d) * 2.3e-16).sum()) if lam[0] > 0 else 0
        _rank_check(rank, k)
        sigma = np.sqrt(lam[:k])
        if d <= n:
            return sigma, _table(spark, "feature_id", fkind, ids, vec[:, :k]), n
        left = _table(spark, "specimen_id", skind, ids, vec[:, :k] / sigma)
        return sigma, _project(data, left, "specimen_id", "feature_id"), n
    sigma, right = _subspace(data, k, n, d)
    _rank_check(int((sigma**2 > sigma[0]**2 * max(n, d) * 2.3e-16).sum()) if sigma[0] > 0 else 0, k)
    return sigma, right, n


def _rank_check(rank: int, k: int) -> None:
    if rank == 0:
        raise ValueError("No feature differs between specimens.")
    if k > rank:
        raise ValueError(f"{k} components asked for; the features span only {rank}.")


def _fix_signs(right: DataFrame) -> DataFrame:
    """Largest-magnitude entry of every component positive."""
    lead = right.groupBy("component").agg(
        F.max_by("value", F.struct(F.round(F.abs("value"), 9), -F.col("feature_id"))).alias("lead")
    )
    return right.join(lead, "component").select(
        "component", "feature_id", (F.col("value") * F.when(F.col("lead") < 0, -1.0).otherwise(1.0)).alias("value")
    )


def fit_pca(features: DataFrame, k: int = 2, standardize: bool = False, dense: int = MAX_DENSE) -> Model:
    """Principal components of a long feature table.

    The smaller side decides the scatter matrix (specimens or features); it is summed by
    Spark and solved on the driver while at most ``dense`` wide. Larger on both sides,
    rounds over the long table replace it.
    """
    if not 1 <= k <= MAX_COMPONENTS:
        raise ValueError(f"k must be from 1 to {MAX_COMPONENTS}.")
    if model_checks(features).first()["ragged"]:
        raise ValueError("Every specimen needs each feature once.")
    prep = cut(_prep(features, standardize))
    data = cut(scaled(features, prep))
    sigma, right, n = _decompose(data, k, dense)
    right = cut(_fix_signs(right))
    scores = cut(_project(data, right, "feature_id", "specimen_id"))
    variance = features.sparkSession.createDataFrame(
        [(c, float(s * s / (n - 1))) for c, s in enumerate(sigma)], "component int, value double"
    )
    loadings = right.select("component", "feature_id", F.col("value").alias("weight"), F.col("value").alias("inverse"))
    return Model("pca", prep, loadings, scores, variance)


def fit_ica(features: DataFrame, k: int = 2, max_iter: int = 1000, tol: float = 1e-4, seed: int = 0,
            standardize: bool = False, dense: int = MAX_DENSE) -> Model:
    """Independent components with unit variance (log cosh contrast, symmetric rounds).

    Whitening is the PCA above. Each round is one pass over the k whitened scores per
    specimen that returns k x k sums.
    """
    if max_iter < 1 or not tol > 0:
        raise ValueError("max_iter and tol must be positive.")
    base = fit_pca(features, k, standardize, dense)
    spark = features.sparkSession
    n = base.scores.agg(F.count_distinct("specimen_id")).first()[0]
    sigma = np.sqrt(np.array([r["value"] for r in base.variance.orderBy("component").collect()]) * (n - 1))
    unit = np.sqrt(n) / sigma
    packed = cut(base.scores.groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("s")).select(
        "specimen_id", F.transform("s", lambda s: s["value"]).alias("z")
    ))

    def decorrelate(w):
        lam, vec = np.linalg.eigh(w @ w.T)
        return (vec / np.sqrt(np.maximum(lam, 1e-300))) @ vec.T @ w

    w = decorrelate(np.random.default_rng(seed).standard_normal((k, k)))
    for _ in range(max_iter):
        current = w

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, k + 1))
            for b in batches:
                if len(b):
                    z = np.stack(b["z"].to_numpy()) * unit
                    t = np.tanh(z @ current.T)
                    total[:, :k] += t.T @ z
                    total[:, k] += (1 - t * t).sum(axis=0)
            i, j = np.divmod(np.arange(total.size), k + 1)
            yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

        sums = np.zeros((k, k + 1))
        for r in packed.mapInPandas(step, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            sums[r["i"], r["j"]] = r["v"]
        sums /= n
        new = decorrelate(sums[:, :k] - sums[:, k:] * w)
        change = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max()
        w = new
        if change < tol:
            break
    else:
        raise RuntimeError("The independent components did not settle; try fewer of them.")
    # Order by explained variance, i.e. by the length of the mixing columns.
    size = ((w * (sigma / np.sqrt(n))) ** 2).sum(axis=1)
    w = w[np.argsort(-size, kind="stable")]
    forward, back = w * unit, w * (sigma / np.sqrt(n))
    mixer = spark.createDataFrame(
        [(j, c, float(forward[c, j]), float(back[c, j])) for c in range(k) for j in range(k)],
        "component int, c2 int, f double, b double",
    )
    mixed = base.loadings.join(mixer, "component").groupBy(F.col("c2").alias("component"), "feature_id").agg(
        F.sum(F.col("weight") * F.col("f")).alias("weight"), F.sum(F.col("weight") * F.col("b")).alias("inverse")
    )
    lead = mixed.groupBy("component").agg(F.max_by("inverse", F.struct(F.round(F.abs("inverse"), 9), -F.col("feature_id"))).alias("lead"))
    flip = F.when(F.col("lead") < 0, -1.0).otherwise(1.0)
    loadings = cut(mixed.join(lead, "component").select(
        "component", "feature_id", (F.col("weight") * flip).alias("weight"), (F.col("inverse") * flip).alias("inverse")
    ))
    model = replace(base, method="ica", loadings=loadings)
    scores = cut(transform(features, model))
    variance = scores.groupBy("component").agg(F.var_pop("value").alias("value"))
    return replace(model, scores=scores, variance=variance)


def transform(features: DataFrame, model: Model) -> DataFrame:
    """Scores of any specimens from stored tables: (specimen_id, component, value)."""
    weights = model.loadings.select("component", "feature_id", F.col("weight").alias("value"))
    return _project(scaled(features, model.prep), weights, "feature_id", "specimen_id")


def reconstruct(model: Model, coords: DataFrame) -> DataFrame:
    """Features from coordinates(row_id, component, value): (row_id, feature_id, feature_name, value).

    Only per-face colour features can be placed back on a surface.
    """
    checks.require_none(
        model.prep.filter(names.feature_face(F.col("feature_name")).isNull()).select("feature_name"),
        "Reconstruction needs spatial colour features.",
    )
    weights = model.loadings.select("component", "feature_id", "inverse")
    sums = coords.join(weights, "component").groupBy("row_id", "feature_id").agg(
        F.sum(F.col("value") * F.col("inverse")).alias("s")
    )
    return sums.join(model.prep, "feature_id").select(
        "row_id", "feature_id", "feature_name",
        ((F.col("s") + F.col("mean")) * F.col("scale") + F.col("center")).alias("value"),
    )


def place_colors(reconstructed: DataFrame) -> DataFrame:
    """Per-face Lab from colour features by name: (row_id, face_id, L, a, b, n)."""
    face, channel = names.feature_face(F.col("feature_name")), names.feature_channel(F.col("feature_name"))
    parsed = reconstructed.select("row_id", face.alias("face_id"), channel.alias("channel"), "value")
    return parsed.groupBy("row_id", "face_id").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in ("L", "a", "b")],
        F.count(F.lit(1)).alias("n"),
    )


def reconstruct_colors(model: Model, coords: DataFrame, samples: DataFrame, nearest: DataFrame) -> DataFrame:
    """Displayable face colours of reconstructed features: (specimen_id, face_id, r, g, b, valid)."""
    placed = place_colors(reconstruct(model, coords))
    known = placed.join(samples.select("face_id", "sample_id"), "face_id", "left")
    checks.require_none(
        known.filter(F.col("sample_id").isNull() | (F.col("n") != 3) | F.col("L").isNull() | F.col("a").isNull() | F.col("b").isNull()),
        "Reconstructed features do not match the analysis mesh.",
    )
    rgb = col.lab_to_srgb(col.clip(F.col("L"), 0, 100), F.col("a"), F.col("b"))
    shown = known.select(F.col("row_id").alias("specimen_id"), "sample_id", *[c.alias(n) for c, n in zip(rgb, "rgb")])
    # Samples without features stay on the surface as uncovered: every row gets every sample, a share of the samples at a time.
    share = F.pmod(F.xxhash64("sample_id"), F.lit(SHARES)).cast("int").alias("_share")
    every = shown.select("specimen_id").distinct().withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    grid = every.join(samples.select("sample_id", share), "_share").drop("_share")
    full = grid.join(shown, ["specimen_id", "sample_id"], "left").select(
        "specimen_id", "sample_id", F.col("r").isNotNull().alias("valid"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"]
    )
    return colors.expand_face_colors(full, nearest)


# ---------------------------------------------------------------- plot helpers


def plot_axes(scores: DataFrame, x: int, y: int) -> DataFrame:
    """Two components side by side: (specimen_id, x, y)."""
    return scores.filter(F.col("component").isin(x, y)).groupBy("specimen_id").agg(
        F.max(F.when(F.col("component") == x, F.col("value"))).alias("x"),
        F.max(F.when(F.col("component") == y, F.col("value"))).alias("y"),
    )


def morph_coordinates(scores: DataFrame, specimen, axes: tuple[int, int], t: tuple[float, float] | None = None) -> DataFrame:
    """Coordinates of one specimen with two axes moved along their range, and slider positions:
    (component, value, position). Other components keep the specimen's score."""
    bounds = scores.groupBy("component").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    own = scores.filter(F.col("specimen_id") == specimen).select("component", "value")
    value = F.col("value")
    if t is not None:
        for axis, position in zip(axes, t):
            value = F.when(F.col("component") == axis, F.col("low") + (F.col("high") - F.col("low")) * float(position)).otherwise(value)
    out = own.join(bounds, "component").withColumn("value", value)
    position = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.5))
    return out.select("component", "value", F.when(F.col("component").isin(*axes), position).alias("position"))
