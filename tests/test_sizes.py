"""Tasks are counted by rows, and what travels does not grow faster than the input."""

import heapq
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import fixtures as fx
from surfpop import session
from surfpop.functions import geometry as g
from surfpop.operators import align, checks, graph, region, sampling, spatial, texture, weld
from surfpop.operators import mesh as m
from surfpop.sources import obj

SF = "/root/testdata/sf0.001"


def test_padding_in_bands_equals_whole_images(spark, capsys, monkeypatch):
    """Neighbours meet over the edges of bands, no side is joined, and tasks follow the rows."""
    monkeypatch.setattr(texture, "PAD_BAND", 3)
    monkeypatch.setattr(texture, "PAD_ROWS", 4)
    rng = np.random.default_rng(2)
    width, height, passes = 9, 11, 3
    rows = [(t, int(x), int(y), *map(int, rng.integers(0, 256, 3)), 255)
            for t in range(2) for x in range(width) for y in range(height) if rng.random() < 0.15 or (x, y) == (8, 10)]
    texels = spark.createDataFrame(rows, "texture_id long, px long, py long, r long, g long, b long, alpha long")
    out = texture.pad(texels, width, height, passes)
    capsys.readouterr()
    out.explain()
    assert "Join" not in capsys.readouterr().out and out.rdd.getNumPartitions() > len(rows) // 4
    want = {r[:3]: r[3:] for r in rows}
    for _ in range(passes):
        fresh = {}
        for t, x, y in itertools.product(range(2), range(width), range(height)):
            near = [(2 - abs(dx * dy), want[t, x + dx, y + dy]) for dx in (-1, 0, 1) for dy in (-1, 0, 1)
                    if (dx or dy) and (t, x + dx, y + dy) in want]
            if (t, x, y) not in want and any(w == 2 for w, _ in near):
                total = sum(w for w, _ in near)
                fresh[t, x, y] = tuple(int(np.floor(sum(w * c[k] for w, c in near) / total + 0.5)) for k in range(4))
        want |= fresh
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and {r[:3]: r[3:] for r in got} == want


def test_corners_are_dealt_by_the_number_of_faces(spark, monkeypatch):
    monkeypatch.setattr(checks, "REF_FACES", 100)
    own = fx.mesh(spark, SF, uv=False)
    out = checks.bad_face_refs(own.faces, own.vertices.filter("vertex_id <> 5"))
    assert out.rdd.getNumPartitions() == -(-own.faces.count() // 100)
    assert {r["vertex_id"] for r in out.collect()} == {5}


def test_hull_of_a_curve_is_compiled(spark, capsys, monkeypatch):
    """Few corners are plain columns; with many, as an array, the same vertices are inside."""
    own = fx.vertices(spark, SF)
    curve = np.array([[2.0, 2.1, 0.4], [8.2, 1.7, 0.5], [9.1, 8.3, 0.45], [5.0, 9.6, 0.6], [1.6, 7.2, 0.5]])
    plain = region.inside_hull(own, *region.curve_plane(curve))
    capsys.readouterr()
    plain.explain()
    assert "lambdafunction" not in capsys.readouterr().out
    monkeypatch.setattr(region, "MAX_PLAIN", 0)
    array = region.inside_hull(own, *region.curve_plane(curve))
    rows = sorted(map(tuple, plain.collect()))
    assert rows == sorted(map(tuple, array.collect())) and 0 < sum(r[-1] for r in rows) < len(rows)


def test_landmarks_meet_their_labels_and_splines_by_shuffle(spark, capsys):
    """Labels of all specimens are no small table, and the nodes of a spline travel once to a specimen's landmarks."""
    marks = fx.landmarks(spark, SF)
    for target, on in ((align.mean_landmarks(marks), ["label"]), (marks, ["specimen_id", "label"])):
        capsys.readouterr()
        align.label_gaps(marks, target, on).explain()
        text = capsys.readouterr().out
        assert "LeftAnti" in text and "Broadcast" not in text
    coef = spark.createDataFrame([(1, [0.0] * 3, 1.0, [[0.0] * 6], [0.0] * 12)],
                                 "specimen_id long, centre array<double>, size double, nodes array<array<double>>, affine array<double>")
    capsys.readouterr()
    align.apply_spline(marks, coef, "ord").explain()
    text = capsys.readouterr().out
    assert "[0]" in text and "14, 15]" not in text


def test_processed_colours_are_read_once_made(spark, capsys):
    """Statistics, their checks and the colours share one grouping of the order lines."""
    out = entry.queries()["c3_process_colors"](spark, SF)
    capsys.readouterr()
    out.explain()
    assert "lineitem" not in capsys.readouterr().out


def test_rows_become_objects_one_by_one(spark, monkeypatch):
    """A batch of whole meshes is not turned into Python objects at once, nor what they make."""
    monkeypatch.setattr(session, "ROW_BYTES", 1000)
    df, seen = spark.createDataFrame([], "mesh_id string, n long"), []

    class Rows:
        schema = df.schema
        mapInArrow = staticmethod(lambda each, schema: (each, schema))

    def work(row):
        seen.append(row["n"])
        yield row["mesh_id"], row["n"], b"x" * 400

    each, schema = session.by_row(Rows, work, "mesh_id key, n bigint, data binary")
    made = each(iter([pa.RecordBatch.from_pydict({"mesh_id": ["a"] * 9, "n": list(range(9))})]))
    assert schema == "mesh_id string, n bigint, data binary"
    assert next(made).num_rows == 2 and len(seen) == 2
    assert sum(b.num_rows for b in made) == 7 and seen == list(range(9))


def _cuts(module, capsys, monkeypatch):
    """Plans of the tables that ``module`` writes."""
    plans, keep = [], module.cut

    def cut(df):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return keep(df)

    monkeypatch.setattr(module, "cut", cut)
    return plans


def test_patches_are_made_without_broadcasts_or_batches_of_meshes(spark, capsys, monkeypatch):
    plans = _cuts(sampling, capsys, monkeypatch)
    entry.queries()["g4_sample_faces"](spark, SF)
    assert len(plans) > 4 and any("MapInArrow" in text for text in plans)
    for text in plans:
        assert "MapInPandas" not in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("patch,rounds", [(sampling.PATCH, 4), (60, 30)])
def test_nearest_samples_take_rounds_by_patches(spark, capsys, monkeypatch, patch, rounds):
    """A mesh of 242 faces in one patch is searched in one step; in several patches the ways are the same."""
    own = fx.mesh(spark, SF, uv=False)
    measures = session.cut(m.face_measures(own))
    edges = session.cut(graph.weighted_adjacency(graph.adjacency(own.faces), measures, own.vertices))
    seeds = own.faces.filter("face_id in (0, 120, 241)").selectExpr("mesh_id", "face_id", "face_id div 120 as sample_id")
    plans = _cuts(sampling, capsys, monkeypatch)
    got = {(r["mesh_id"], r["face_id"]): (r["sample_id"], r["dist"]) for r in graph.nearest_sample(measures, edges, seeds, patch).collect()}
    assert len(plans) <= rounds and len(got) == own.faces.count()
    ways = {}
    for r in edges.collect():
        ways.setdefault((r["mesh_id"], r["face_id"]), []).append(((r["mesh_id"], r["nbr_id"]), r["w"]))
    want, heap = {}, [(0.0, r["sample_id"], (r["mesh_id"], r["face_id"])) for r in seeds.collect()]
    heapq.heapify(heap)
    while heap:
        d, owner, face = heapq.heappop(heap)
        if face not in want:
            want[face] = owner, d
            for nbr, w in ways.get(face, []):
                heapq.heappush(heap, (d + w, owner, nbr))
    assert got == want


def test_welding_sends_no_points_through_the_driver(spark, capsys, monkeypatch):
    """A start becomes 27 rows, many more than the bytes of the table that holds it."""
    plans = _cuts(weld, capsys, monkeypatch)
    map_ = weld.weld(fx.mesh(spark, SF, uv=False), 1.05)[1]
    capsys.readouterr()
    map_.explain()
    plans.append(capsys.readouterr().out)
    assert len(plans) > 6
    for text in plans:
        assert "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["j3_nearest_on_surface", "j5_ray_hits"])
def test_queries_make_no_row_per_box(spark, capsys, name):
    capsys.readouterr()
    entry.queries()[name](spark, SF).explain()
    text = capsys.readouterr().out
    assert "MapInArrow" in text and "Generate" not in text


@pytest.mark.parametrize("fan,places", [(16, 1 << 16), (3, 10)])
def test_surfaces_and_rays_in_blocks_are_exact(spark, monkeypatch, fan, places):
    """Two meshes, one much larger; blocks of nine faces are cut from them, and their queries are dealt over places."""
    monkeypatch.setattr(spatial, "FAN", fan)
    monkeypatch.setattr(spatial, "PLACE_ROWS", places)
    rng = np.random.default_rng(9)
    corners = [tuple(map(float, rng.normal(size=3).repeat(3).reshape(3, 3).T.ravel() * 3 + rng.normal(size=9))) for _ in range(200)]
    tri = [(int(i >= 190), i, *c) for i, c in enumerate(corners)] + [(0, 500, *corners[3])]
    names = ["mesh_id", "face_id"] + [f"{c}{n}" for c in "abc" for n in "xyz"]
    q = [(i % 2, i, *map(float, rng.normal(size=3) * 4)) for i in range(60)] + [(0, 60, *corners[3][:3]), (1, 61, float("nan"), 0.0, 0.0)]
    queries, faces = spark.createDataFrame(q, ["mesh_id", "query_id", "qx", "qy", "qz"]), spark.createDataFrame(tri, names)
    near = {r["query_id"]: r for r in spatial.nearest_on_surface(queries, faces).collect()}
    assert len(near) == len(q) and near[60]["face_id"] == 3 and np.isnan(near[61]["d2"]) and near[61]["face_id"] == 190
    down = queries.filter("query_id < 60").selectExpr("*", "0.0d as dx", "0.6d as dy", "-0.8d as dz")
    first = {r["query_id"]: r for r in spatial.ray_hits(down, faces).collect()}
    hits = {}
    for mesh_id, i, *at in q[:60]:
        own = [r for r in tri if r[0] == mesh_id]
        a, b, c = ([np.array([r[2 + 3 * k + j] for r in own]) for j in range(3)] for k in range(3))
        p = [np.full(len(own), v) for v in at]
        point = g.closest_on_triangle(p, a, b, c)
        d2 = (point[0] - p[0]) * (point[0] - p[0]) + (point[1] - p[1]) * (point[1] - p[1]) + (point[2] - p[2]) * (point[2] - p[2])
        k = int(d2.argmin())
        assert (near[i]["face_id"], near[i]["d2"], near[i]["px"]) == (own[k][1], d2[k], point[0][k])
        e1, e2, s, d = g.sub(b, a), g.sub(c, a), g.sub(p, a), (0.0, 0.6, -0.8)
        h, r = g.cross(d, e2), g.cross(s, e1)
        det = g.dot(e1, h)
        u, v, t = g.dot(s, h) / det, g.dot(d, r) / det, g.dot(e2, r) / det
        t = np.where((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t, np.inf)
        if np.isfinite(t.min()):
            hits[i] = own[int(t.argmin())][1], t.min()
    assert 5 < len(hits) and {i: (r["face_id"], r["t"]) for i, r in first.items()} == hits


def test_obj_files_are_written_by_their_tasks_and_read_once(spark, capsys, monkeypatch, tmp_path):
    """A mesh over several tasks is several part files in order; no writer of Spark's, and one table reads the files."""
    monkeypatch.setattr(obj, "wide_parts", lambda spark: 3)
    own = fx.mesh(spark, SF)
    own = m.Mesh(own.vertices.withColumn("mesh_id", F.concat(F.lit("a b:"), "mesh_id")), own.faces.withColumn("mesh_id", F.concat(F.lit("a b:"), "mesh_id")))
    obj.write_obj(own, f"{tmp_path}/out")
    assert not list(tmp_path.glob("out/_SUCCESS")) and not list(tmp_path.glob("out/*/.part*.crc"))
    folders = sorted(tmp_path.glob("out/mesh_id=*"))
    assert len(folders) == 10 and folders[0].name.startswith("mesh_id=a b%3A")
    for folder in folders:
        lines = "".join(p.read_text() for p in sorted(folder.glob("part-*.txt"))).splitlines()
        assert [l[0] for l in lines] == ["v"] * 144 + ["f"] * 242 and lines[0].startswith("v 0.0 0.0 ") and lines[144].startswith("f 1 13 14")
    plans = _cuts(obj, capsys, monkeypatch)
    assert obj.read_obj(spark, f"{tmp_path}/out").faces.count() == 2420
    assert [("FileScan text" in text, "Coalesce 3" in text) for text in plans] == [(True, True), (False, False)]
    capsys.readouterr()
    entry.queries()["s8_write_obj_uv"](spark, SF).explain()
    assert "BroadcastHashJoin" not in "".join(plans) + capsys.readouterr().out
