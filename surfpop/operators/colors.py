"""Sampled colours: sampling, moments, normalisation, display.

``colors(specimen_id, sample_id, r, g, b, valid)``; a missing colour is valid = false,
never black and never NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import color as col
from surfpop.operators import checks, graph, texture
from surfpop.session import cut, spread_join

MOMENTS = ("mean_l", "std_l", "mean_c", "std_c")


def to_lab(colors: DataFrame) -> DataFrame:
    """Adds L, a, b."""
    return col.with_lab(colors)


def _lab_columns(colors: DataFrame) -> DataFrame:
    out = to_lab(colors)
    return out.select("specimen_id", "sample_id", "valid", "L", F.col("a"), F.col("b_").alias("b"))


def sample_colors(pixels: DataFrame, uv: DataFrame, measures: DataFrame, adj: DataFrame, samples: DataFrame,
                  smoothing: int = 0, min_alpha: float = 0.99) -> DataFrame:
    """Colour of every texture at the UV centre of every sample face.

    ``uv(face_id, u, v)`` are face centroids of the shared layout, ``samples(sample_id,
    face_id)`` the measured faces. Enough alpha makes a colour valid. Smoothing runs over
    all faces before the samples are taken.
    """
    if smoothing < 0 or not 0 < min_alpha <= 1:
        raise ValueError("smoothing must be >= 0 and min_alpha in (0, 1].")
    wanted = uv if smoothing else uv.join(samples.select("face_id"), "face_id", "left_semi")
    raw = texture.sample_image(wanted, pixels).select(
        F.col("texture_id").alias("specimen_id"), "face_id", "r", "g", "b", (F.col("alpha") >= min_alpha).alias("valid")
    )
    shown = graph.smooth(raw, measures, adj, smoothing, samples)
    return shown.join(samples.select("sample_id", "face_id"), "face_id").select(
        "specimen_id", "sample_id", "r", "g", "b", "valid"
    )


def color_moments(colors: DataFrame) -> DataFrame:
    """Count, mean and population spread of L* and C* per specimen over valid samples."""
    lab = _lab_columns(colors.filter("valid"))
    return lab.select("specimen_id", "L", col.chroma(F.col("a"), F.col("b")).alias("C")).groupBy("specimen_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("L").alias("mean_l"), F.stddev_pop("L").alias("std_l"),
        F.avg("C").alias("mean_c"), F.stddev_pop("C").alias("std_c"),
    )


def pooled_moments(moments: DataFrame) -> DataFrame:
    """One row: the moments of all samples together, from the per-specimen rows alone.

    Within and between spread are added about the pooled mean, so new specimens only
    need their own row.
    """
    moments = cut(moments)  # one row per specimen, read once per statistic below
    n = F.col("n").cast("double")
    means = moments.agg(
        F.sum("n").alias("n"), *[(F.sum(F.col(f"mean_{c}") * n) / F.sum(n)).alias(f"mean_{c}") for c in "lc"]
    )
    spread = moments.agg(*[
        F.sqrt(F.sum(n * (F.col(f"std_{c}") * F.col(f"std_{c}")
                          + (F.col(f"mean_{c}") - means.select(f"mean_{c}").scalar())
                          * (F.col(f"mean_{c}") - means.select(f"mean_{c}").scalar()))) / F.sum(n)).alias(f"std_{c}")
        for c in "lc"
    ])
    return means.select("n", "mean_l", spread.select("std_l").scalar().alias("std_l"),
                        "mean_c", spread.select("std_c").scalar().alias("std_c"))


def require_valid(colors: DataFrame) -> None:
    """Fail if a specimen has no valid sample: it has no moments and would go missing in joins with them."""
    per = colors.groupBy("specimen_id").agg(F.count_if(F.col("valid")).alias("n"))
    checks.require_none(per.filter("n = 0"), "Every specimen needs a valid colour sample.")


def normalization_stats(colors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per specimen, pooled); every specimen needs at least one valid sample."""
    require_valid(colors)
    moments = cut(color_moments(colors))
    return moments, cut(pooled_moments(moments))


def normalize(colors: DataFrame, moments: DataFrame, pooled: DataFrame, norm_l: bool = True,
              norm_c: bool = True, check: bool = True) -> DataFrame:
    """Lab colours moved to the pooled moments: (specimen_id, sample_id, valid, L, a, b)."""
    if check:
        require_valid(colors)
        stale = checks.stale_stats(moments, color_moments(colors))
        checks.require_none(stale, "Colours changed after their statistics, or a specimen has none.")
    target = {k: pooled.select(k).scalar() for k in MOMENTS}
    own = moments.select("specimen_id", *MOMENTS, *[target[k].alias(f"to_{k}") for k in MOMENTS])
    lab = spread_join(_lab_columns(colors), own, ["specimen_id"], ["sample_id"])
    moved = col.normalized_lab(
        F.col("L"), F.col("a"), F.col("b"), {k: F.col(k) for k in MOMENTS},
        {k: F.col(f"to_{k}") for k in MOMENTS}, norm_l, norm_c,
    )
    return lab.select("specimen_id", "sample_id", "valid", *[
        F.when(F.col("valid"), c).otherwise(F.lit(0.0)).alias(n) for c, n in zip(moved, ("L", "a", "b"))
    ])


def raw_lab(colors: DataFrame) -> DataFrame:
    """Lab without normalisation; invalid samples are zero placeholders."""
    return _lab_columns(colors).select("specimen_id", "sample_id", "valid", *[
        F.when(F.col("valid"), F.col(n)).otherwise(F.lit(0.0)).alias(n) for n in ("L", "a", "b")
    ])


def with_display(lab: DataFrame) -> DataFrame:
    """Adds displayable dr, dg, db; black on invalid samples."""
    rgb = col.lab_to_srgb(F.col("L"), F.col("a"), F.col("b"))
    return lab.withColumns({
        f"d{n}": F.when(F.col("valid"), c).otherwise(F.lit(0.0)) for n, c in zip("rgb", rgb)
    })


def process_colors(colors: DataFrame, stats: tuple[DataFrame, DataFrame] | None = None, norm_l: bool = True,
                   norm_c: bool = True, n_clusters: int | None = None, initial: int | None = None,
                   seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Lab, optional normalisation, optional clustering, display colour.

    Returns processed(specimen_id, sample_id, valid, L, a, b, dr, dg, db, label) with label
    -1 on invalid samples and NULL without clustering, and centroids or None.
    """
    from surfpop.operators import cluster

    if n_clusters is None and initial is not None:
        raise ValueError("initial needs n_clusters.")
    if stats is None:
        require_valid(colors)
    lab = raw_lab(colors) if stats is None else normalize(colors, *stats, norm_l, norm_c)
    if n_clusters is None:
        return with_display(lab).withColumn("label", F.lit(None).cast("bigint")), None
    labelled, centres = cluster.cluster_colors(lab, n_clusters, initial, seed)
    return with_display(labelled), centres


def distinct_colors(lab: DataFrame) -> DataFrame:
    """Number of distinct valid Lab colours per specimen."""
    return lab.filter("valid").select("specimen_id", "L", "a", "b").distinct().groupBy("specimen_id").agg(
        F.count(F.lit(1)).alias("n_colors")
    )


def coverage(colors: DataFrame, by: str = "specimen_id") -> DataFrame:
    """Share of valid samples per specimen or per sample."""
    return colors.groupBy(by).agg(
        F.avg(F.col("valid").cast("double")).alias("valid_share"), F.count(F.lit(1)).alias("n")
    )


def expand_face_colors(colors: DataFrame, nearest: DataFrame) -> DataFrame:
    """Every face takes its owner sample's colour: (specimen_id, face_id, r, g, b, valid)."""
    return colors.join(nearest.select("face_id", "sample_id"), "sample_id").select(
        "specimen_id", "face_id", "r", "g", "b", "valid"
    )


def display(processed: DataFrame, nearest: DataFrame, palette: DataFrame | None = None, specimen=None) -> DataFrame:
    """Face colours for viewing; with a palette valid samples show their cluster's colour."""
    chosen = processed if specimen is None else processed.filter(F.col("specimen_id") == specimen)
    if palette is None:
        shown = chosen.select("specimen_id", "sample_id", F.col("dr").alias("r"), F.col("dg").alias("g"),
                              F.col("db").alias("b"), "valid")
    else:
        shown = chosen.select("specimen_id", "sample_id", "valid", "label").join(
            palette.select("label", "r", "g", "b"), "label", "left"
        ).select(
            "specimen_id", "sample_id",
            *[F.when(F.col("valid"), F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)).alias(c) for c in "rgb"], "valid",
        )
    return expand_face_colors(shown, nearest)
