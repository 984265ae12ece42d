"""From textures on a shared layout to processed colours and matched clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.functions import names
from surfpop.operators import checks, cluster, colors, graph
from surfpop.operators import mesh as m
from surfpop.session import cut, shuffled


@dataclass(frozen=True)
class Analysis:
    measures: DataFrame  # mesh_id, face_id, area, area2, cx, cy, cz
    adjacency: DataFrame
    samples: DataFrame  # mesh_id, sample_id, face_id, area
    nearest: DataFrame  # mesh_id, face_id, sample_id
    all_faces: bool


@dataclass(frozen=True)
class ColorOptions:
    sample_count: int | None = 10000
    smoothing: int = 0
    normalize: bool = False
    clustering: bool = True
    clusters: int = 8
    initial_clusters: int = 24
    seed: int = 0


@dataclass(frozen=True)
class ColorResult:
    analysis: Analysis
    processed: DataFrame
    centroids: DataFrame | None
    palette: DataFrame | None
    options: ColorOptions


def sample_areas(nearest: DataFrame, measures: DataFrame) -> DataFrame:
    """Area represented by every sample: (mesh_id, sample_id, area)."""
    return nearest.join(shuffled(measures.select("mesh_id", "face_id", "area")), ["mesh_id", "face_id"]).groupBy(
        "mesh_id", "sample_id"
    ).agg(F.sum("area").alias("area"))


def prepare_analysis(mesh: m.Mesh, sample_count: int | None = None) -> Analysis:
    """Areas, centres, adjacency and samples of the atlas; every face is a sample by default."""
    checks.require_none(checks.degenerate_faces(mesh), "Degenerate faces.")
    checks.require_none(checks.uv_violations(mesh), "UVs must lie within one tile on every face.")
    measures = cut(m.face_measures(mesh))
    adj = cut(graph.adjacency(mesh.faces))
    total = mesh.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if sample_count is None or sample_count >= total:
        samples = measures.select("mesh_id", F.col("face_id").alias("sample_id"), "face_id", "area")
        return Analysis(measures, adj, samples, samples.select("mesh_id", "face_id", "sample_id"), True)
    comp = graph.components(mesh.faces, graph.edge_links(mesh.faces))
    edges = cut(graph.weighted_adjacency(adj, measures, mesh.vertices))
    chosen, owners = graph.sample_faces(measures, edges, comp, sample_count)
    nearest = owners.select("mesh_id", "face_id", "sample_id")
    samples = cut(chosen.join(shuffled(sample_areas(nearest, measures)), ["mesh_id", "sample_id"]))
    return Analysis(measures, adj, samples, nearest, False)


def run_colors(mesh: m.Mesh, pixels: DataFrame, options: ColorOptions = ColorOptions(), analysis: Analysis | None = None) -> ColorResult:
    """Sample, pool, normalise, cluster and match all specimens' colours in one flow.

    Display averages among the textures are left out. Normalisation only applies when
    clustering is on.
    """
    analysis = prepare_analysis(mesh, options.sample_count) if analysis is None else analysis
    own = pixels.filter(~names.is_average_texture(F.col("texture_id").cast("string")))
    sampled = cut(colors.sample_colors(
        own, m.uv_centroids(mesh.corner_uv), analysis.measures, analysis.adjacency, analysis.samples, options.smoothing
    ))
    checks.require_none(checks.color_violations(sampled), "Colours out of range, or a specimen without valid samples.")
    stats = None
    if options.clustering and options.normalize:
        moments, pooled = colors.normalization_stats(sampled)
        stats = (cut(moments), cut(pooled))
    processed, centres = colors.process_colors(
        sampled, stats, n_clusters=options.clusters if options.clustering else None,
        initial=options.initial_clusters if options.clustering else None, seed=options.seed,
    )
    shared = None
    if options.clustering:
        processed, centres, shared = cluster.align_clusters(centres, processed)
        centres, shared = cut(centres), cut(shared)
    return ColorResult(analysis, cut(processed), centres, shared, options)
