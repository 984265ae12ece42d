"""Rows of surfaces, pixels and colours are never a side that is broadcast, however small the planner takes them for."""

import re

import pytest

import __spark_entry__ as entry
from catalog import fixtures as fx
from surfpop.operators import charts, graph, region, sampling, spatial
from surfpop.operators import mesh as m
from surfpop.plans import colors as plan
from surfpop.session import spread_join

SF = "/root/testdata/sf0.001"
MESH = lambda spark: fx.mesh(spark, SF, uv=False)


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def _weights(spark):
    own = MESH(spark)
    return graph.weighted_adjacency(graph.adjacency(own.faces), m.face_measures(own), own.vertices)


def _islands(spark):
    own = fx.mesh(spark, SF)
    faces = own.faces.selectExpr("mesh_id", "face_id", "face_id div 22 as component")
    return charts.layout_islands(own.corner_uv, faces)[0]


def _inside(spark):
    own = MESH(spark)
    return region.complete_faces(own.faces, region.same_side(own.vertices.selectExpr("*", "x > 3 as inside"), [[1.0, 1.0, 1.0]] * 3))


@pytest.mark.parametrize("made", [
    *[lambda spark, n=n: entry.queries()[n](spark, SF) for n in ("a6_face_centers", "a6_uv_centroids", "f10_normals", "g10_rasterize_uv")],
    _weights, _islands, _inside,
    lambda spark: plan.sample_areas(MESH(spark).faces.selectExpr("mesh_id", "face_id", "face_id as sample_id"), m.face_measures(MESH(spark))),
    lambda spark: spread_join(fx.pixels(spark, SF), fx.pixels(spark, SF).groupBy("texture_id").count(), ["texture_id"], ["px"]),
], ids=["centers", "uv", "normals", "raster", "weights", "islands", "inside", "areas", "spread"])
def test_no_surface_is_broadcast(spark, capsys, made):
    text = plan_of(made(spark), capsys)
    assert "Join" in text and "Broadcast" not in text


@pytest.mark.parametrize("name", ["g16_layout_islands", "g1_prepare_analysis"])
def test_no_surface_is_broadcast_by_a_query(spark, capsys, name):
    text = plan_of(entry.queries()[name](spark, SF), capsys)
    assert "Join" in text and "Broadcast" not in text


def test_marks_meet_their_vertices_by_shuffle(spark, capsys):
    text = plan_of(fx.marks(spark, SF), capsys)
    assert "Join" in text and "Broadcast" not in text


def test_boxes_and_patches_meet_their_faces_by_shuffle(spark, capsys, monkeypatch):
    """Faces of a written table are many for its bytes; only tables of a row per mesh or per partition may be broadcast."""
    own = MESH(spark)
    near = spatial.nearest_on_surface(fx.points(spark, SF), m.triangles(own))
    met = spatial.nearest_vertex(fx.points(spark, SF), own.vertices)
    made = [plan_of(near, capsys), plan_of(met, capsys)]
    keep = sampling.cut
    monkeypatch.setattr(sampling, "cut", lambda df: made.append(plan_of(df, capsys)) or keep(df))
    sampling.patches(m.face_measures(own), _weights(spark))
    assert len(made) == 4 and re.search(r"SortMergeJoin \[mesh_id#\d+L?, _node", made[0])
    for text in made:
        assert not re.search(r"BroadcastHashJoin \[mesh_id#\d+L?, ", text)


def test_supplier_rows_are_dealt_before_they_become_pixels(spark, capsys):
    text = plan_of(fx.pixels(spark, SF), capsys)
    assert 0 < text.index("Generate") < text.index("Exchange")


def test_chart_seeds_meet_their_faces_by_shuffle(spark, capsys, monkeypatch):
    """There is a seed for every mesh that needs another direction, so seeds grow with the meshes."""
    made, keep = [], charts.cut
    monkeypatch.setattr(charts, "cut", lambda df: made.append(plan_of(df, capsys)) or keep(df))
    charts.assign_charts(MESH(spark), 40.0)
    assert any("LeftSemi" in text for text in made)
    for text in made:
        assert "Broadcast" not in text
