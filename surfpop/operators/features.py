"""Specimen-by-feature tables in long form: (specimen_id, feature_id, feature_name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import names
from surfpop.operators import checks

CHANNELS = ("L", "a", "b")


def common_valid(colors: DataFrame) -> DataFrame:
    """Samples that are present and valid in every specimen: (sample_id)."""
    total = colors.agg(F.count_distinct("specimen_id").alias("n")).scalar()
    return colors.groupBy("sample_id").agg(
        F.sum(F.col("valid").cast("bigint")).alias("ok")
    ).filter(F.col("ok") == total).select("sample_id")


def _kept(processed: DataFrame, missing: str, none: str) -> DataFrame:
    """Rows of the common samples. Where there is none, ``none`` says whether that is an error or a table without rows."""
    if missing not in ("error", "drop"):
        raise ValueError("missing must be error or drop.")
    if none not in ("error", "empty"):
        raise ValueError("none must be error or empty.")
    common = common_valid(processed)
    if none == "error" and common.isEmpty():
        raise ValueError("No sample has a valid colour in every specimen.")
    if missing == "error":
        checks.require_none(
            processed.select("sample_id").distinct().join(common, "sample_id", "left_anti"),
            "Some samples lack a colour in a specimen; missing='drop' leaves them out.",
        )
    return processed.join(common, "sample_id", "left_semi")


def color_features(processed: DataFrame, samples: DataFrame, missing: str = "error", none: str = "error") -> DataFrame:
    """L, a, b of every common sample; feature ids follow sample order, then channel."""
    kept = _kept(processed, missing, none).join(samples.select("sample_id", "face_id"), "sample_id")
    stacked = F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in CHANNELS
    ])).alias("k", "s")
    return kept.select("specimen_id", "sample_id", "face_id", stacked).select(
        "specimen_id", (F.col("sample_id") * 3 + F.col("k")).cast("bigint").alias("feature_id"),
        names.color_feature(F.col("face_id"), F.col("s.channel")).alias("feature_name"), F.col("s.value").alias("value"),
    )


def cluster_areas(processed: DataFrame, samples: DataFrame, n_clusters: int, missing: str = "drop",
                  none: str = "error") -> DataFrame:
    """Represented area of every label in every specimen; unused labels count 0."""
    kept = _kept(processed, missing, none).join(samples.select("sample_id", F.col("area").alias("_area")), "sample_id")
    found = kept.groupBy("specimen_id", "label").agg(F.sum("_area").alias("area"))
    grid = kept.select("specimen_id").distinct().select(
        "specimen_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_clusters - 1).cast("bigint"))).alias("label")
    )
    return grid.join(found, ["specimen_id", "label"], "left").select(
        "specimen_id", "label", F.coalesce("area", F.lit(0.0)).alias("area")
    )


def area_features(processed: DataFrame, samples: DataFrame, n_clusters: int, norm: str = "fraction",
                  missing: str = "drop", none: str = "error") -> DataFrame:
    """Cluster areas as features, normalised per specimen to sum 1, to length 1, or not."""
    if norm not in ("fraction", "l2", "none"):
        raise ValueError("norm must be fraction, l2 or none.")
    areas = cluster_areas(processed, samples, n_clusters, missing, none)
    # At most 64 labels per specimen.
    lists = areas.groupBy("specimen_id").agg(
        F.collect_list(F.struct("label", "area")).alias("s"), F.sum("area").alias("total"),
        F.sqrt(F.sum(F.col("area") * F.col("area"))).alias("length"),
    )
    divisor = {"fraction": F.col("total"), "l2": F.col("length"), "none": F.lit(1.0)}[norm]
    return lists.select("specimen_id", divisor.alias("_d"), F.explode("s").alias("s")).select(
        "specimen_id", F.col("s.label").alias("feature_id"), names.area_feature(F.col("s.label"), norm).alias("feature_name"),
        (F.col("s.area") / F.col("_d")).alias("value"),
    )


def population_features(processed: DataFrame, samples: DataFrame, all_faces: bool, n_clusters: int | None,
                        none: str = "error") -> DataFrame:
    """Areas when every face was measured and clusters were matched, colours otherwise."""
    if all_faces and n_clusters is not None:
        return area_features(processed, samples, n_clusters, norm="l2", missing="drop", none=none)
    return color_features(processed, samples, missing="drop", none=none)
