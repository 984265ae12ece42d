"""From processed colours to a population model and back to surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.operators import features as ft
from surfpop.operators import models
from surfpop.plans.colors import ColorResult
from surfpop.session import cut


def run_population(result: ColorResult, method: str = "pca", k: int = 2) -> models.Model:
    """Areas of matched clusters when every face was measured, face colours otherwise."""
    clusters = result.options.clusters if result.options.clustering else None
    table = cut(ft.population_features(
        result.processed, result.analysis.samples, result.options.sample_count is None, clusters
    ))
    if method == "pca":
        return models.fit_pca(table, k)
    if method == "ica":
        return models.fit_ica(table, k)
    raise ValueError("method must be pca or ica.")


def morph(result: ColorResult, model: models.Model, specimen, axes: tuple[int, int], t: tuple[float, float]) -> DataFrame:
    """Face colours at a slider position between the population's extremes."""
    at = models.morph_coordinates(model.scores, specimen, axes, t).select(
        F.lit("reconstruction_0").alias("row_id"), "component", "value"
    )
    return models.reconstruct_colors(model, at, result.analysis.samples, result.analysis.nearest)
