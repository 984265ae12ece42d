"""Files in and out, and the whole flow on a four-specimen folder."""

import json
import pathlib
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from surfpop.operators import checks
from surfpop.operators import mesh as m
from surfpop.plans import atlas, population
from surfpop.plans import colors as color_plan
from surfpop.sources import discovery, images, landmarks, obj, tables


def png(path, rgba):
    h, w, _ = rgba.shape
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + rgba[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


N = 5


def grid(shift=0.0):
    v = [(i, j, 0.3 * np.sin(i * 1.3 + j + shift) + 0.1 * i * j) for i in range(N) for j in range(N)]
    f = []
    for i in range(N - 1):
        for j in range(N - 1):
            a = i * N + j
            f += [(a, a + N, a + N + 1), (a, a + N + 1, a + 1)]
    return v, f


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    for d in ("models", "landmarks", "textures"):
        (root / d).mkdir()
    rng = np.random.default_rng(0)
    for s in range(4):
        v, f = grid(0.2 * s)
        text = ["﻿# grid"] + [f"v {-x} {-y} {z} # lps" for x, y, z in v] + [f"vt {x / (N - 1)} {y / (N - 1)}" for x, y, _ in v]
        text += ["f " + " ".join(f"{k + 1}/{k - len(v)}" for k in t) for t in f]
        (root / "models" / f"S{s}.obj").write_text("\r\n".join(text), encoding="utf-8")
        ids = [0, N - 1, N * N - 1, N * (N - 1), N * N // 2, 7]
        points = [{"id": k, "label": f"P{k}", "position": [float(x) for x in v[i]], "positionStatus": "defined", "extra": 1} for k, i in enumerate(ids)]
        doc = {"@schema": "x", "markups": [{"type": "Fiducial", "coordinateSystem": "RAS", "controlPoints": points}]}
        (root / "landmarks" / f"S{s}.mrk.json").write_text(json.dumps(doc))
        px = rng.integers(0, 256, (16, 16, 4), dtype=np.uint8)
        px[..., 3] = 255
        png(root / "textures" / f"S{s}.png", px)
    return root


def test_discovery_and_errors(spark, dataset):
    found = discovery.discover(spark, str(dataset)).collect()
    assert sorted(r["specimen_id"] for r in found) == ["S0", "S1", "S2", "S3"]
    files = spark.createDataFrame([("model", "a.obj", "p"), ("model", "a.stl", "q"), ("landmark", "b.csv", "r")], ["kind", "name", "path"])
    _, problems = discovery.pair_files(files)
    assert {(r["specimen_id"], r["problem"]) for r in problems.collect()} == {("a", "several model files"), ("a", "missing landmark"), ("b", "missing model")}


def test_obj_reading_and_round_trip(spark, dataset, tmp_path):
    mesh = obj.read_obj(spark, str(dataset / "models"), axes="LPS")
    v, f = grid(0.0)
    got = mesh.vertices.filter("mesh_id = 'S0'").orderBy("vertex_id").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], v)
    assert [(r["a"], r["b"], r["c"]) for r in mesh.faces.filter("mesh_id = 'S0'").orderBy("face_id").collect()] == f
    obj.write_obj(mesh, str(tmp_path / "out"))
    again = obj.read_obj(spark, str(tmp_path / "out"))
    for a, b in ((mesh.vertices, again.vertices), (mesh.faces, again.faces), (mesh.corner_uv, again.corner_uv)):
        assert a.count() == b.count() and a.exceptAll(b.select(a.columns)).isEmpty()


@pytest.mark.parametrize("body,problem", [
    ("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 4\n", "face index out of range"), ("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 0 1 2\n", "face index out of range"),
    ("v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1 2 3 4\n", "face is not a triangle"), ("v 0 0 nan\nv 1 0 0\nv 0 1 0\nf 1 2 3\n", "vertex without three finite numbers"),
    ("v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nf 1/1 2 3\n", "texture coordinates on some corners only"),
])
def test_bad_obj(spark, tmp_path, body, problem):
    (tmp_path / "x.obj").write_text(body)
    _, problems = obj.parse_obj(obj.read_lines(spark, str(tmp_path)))
    assert {r["problem"] for r in problems.collect()} == {problem}


def test_landmark_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note,z,y,x,label\n"q, r",3,2,1,"p,1"\n,6,5,4,p2\n')
    (tmp_path / "b.fcsv").write_text("# Markups\n# CoordinateSystem = LPS\nv0,1,2,3,0,0,0,1,1,1,0,p1,,\n")
    got = {(r["specimen_id"], r["label"]): (r["x"], r["y"], r["z"]) for r in landmarks.read_landmarks(spark, str(tmp_path)).collect()}
    assert got == {("a", "p,1"): (1, 2, 3), ("a", "p2"): (4, 5, 6), ("b", "p1"): (-1, -2, 3)}
    out = str(tmp_path / "w")
    df = landmarks.read_landmarks(spark, str(tmp_path))
    rows = sorted(map(tuple, df.collect()))
    landmarks.write_landmarks(spark.createDataFrame(rows, df.schema), out)
    assert sorted(map(tuple, landmarks.read_landmarks(spark, out).collect())) == rows


def test_landmark_files_are_dealt_and_read_once(spark, tmp_path, monkeypatch):
    """Folders are named as partitionBy names them, the files come from many tasks and are opened by one plan."""
    ids = [f"s{i}" for i in range(40)] + ["a b", "é%/x", "q=1:?", 'he"y', "[z]^{", "\t", "x+y"]
    df = spark.createDataFrame([(s, "p1", 0, 1.0, 2.0, 3.0) for s in ids], "specimen_id string, label string, ord long, x double, y double, z double")
    out, other = tmp_path / "w", str(tmp_path / "other")
    landmarks.write_landmarks(df, str(out))
    landmarks.markups_text(df).write.partitionBy("specimen_id").text(other)
    files = lambda at: {p.parent.name: p.read_bytes() for p in pathlib.Path(at).glob("*/part-*.txt")}
    assert files(out) == files(other) and len(files(out)) == len(ids)
    dealt = landmarks.cut
    made = []
    monkeypatch.setattr(landmarks, "cut", lambda rows: made.append(rows) or dealt(rows))
    back = landmarks.read_landmarks(spark, str(out))
    assert back.count() == len(ids) and len(made) == 1
    assert not set(back.inputFiles()) & {f for f in made[0].inputFiles()}
    monkeypatch.setattr(tables, "local_path", lambda *_: None)  # a store that tasks do not open by themselves
    landmarks.write_landmarks(df, str(tmp_path / "far"))
    assert files(tmp_path / "far") == files(out)
    landmarks.write_landmarks(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        landmarks.write_landmarks(df, str(out))


def test_undefined_point_is_an_error(spark, tmp_path):
    doc = {"markups": [{"controlPoints": [{"label": "p", "position": [0, 0, 0], "positionStatus": "undefined"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError):
        landmarks.read_landmarks(spark, str(tmp_path))


def test_pixels(spark, tmp_path):
    rgba = np.random.default_rng(1).integers(0, 256, (70, 3, 4), dtype=np.uint8)
    png(tmp_path / "t.png", rgba)
    got = np.zeros((70, 3, 4))
    for r in images.read_pixels(spark, str(tmp_path)).collect():
        got[r["py"], r["px"]] = [r["r"], r["g"], r["b"], r["alpha"]]
    assert np.allclose(got * 255, rgba)
    info = images.texture_info(spark, str(tmp_path), "k").first()
    assert (info["specimen_id"], info["width"], info["height"]) == ("t", 3, 70)


def test_publish_refuses_to_replace(spark, tmp_path):
    df = spark.range(3)
    tables.publish(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        tables.publish(df, str(tmp_path / "t"))
    tables.publish(df, str(tmp_path / "t"), overwrite=True)


def test_publish_is_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.publish(spark.range(3), path)
    tables.publish(spark.read.parquet(path).selectExpr("id + 10 as id"), path, overwrite=True)  # from the table itself
    with pytest.raises(Exception):
        tables.publish(spark.range(3).selectExpr("raise_error('no') as id"), path, overwrite=True)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]


def test_labels_that_differ_are_an_error(spark):
    from surfpop.operators import align

    schema = "specimen_id string, label string, ord long, x double, y double, z double"
    marks = spark.createDataFrame([("s", c, i, float(i), float(i * i), 1.0) for i, c in enumerate("abcd")] + [("t", c, i, float(i), 2.0, 0.0) for i, c in enumerate("abc")], schema)
    for call in (lambda: align.procrustes(marks, marks.filter("specimen_id = 's'")), lambda: align.spline_pairs(marks, marks.filter("label <> 'a'")),
                 lambda: align.spline_pairs(marks, marks.filter("specimen_id = 's'"), per_specimen=False)):
        with pytest.raises(ValueError, match="labels differ"):
            call()


def test_textures_of_other_sizes_are_not_averaged(spark):
    from surfpop.operators import texture

    pixels = spark.createDataFrame([(t, x, y, 0.5, 0.5, 0.5, 1.0) for t, w in (("p", 2), ("q", 3)) for x in range(w) for y in range(2)],
                                   "texture_id string, px long, py long, r double, g double, b double, alpha double")
    with pytest.raises(ValueError, match="differ in size"):
        texture.average_textures(pixels)
    with pytest.raises(ValueError, match="differ in size"):
        texture.average_textures(pixels.filter("texture_id = 'p' and not (px = 1 and py = 1)"))
    assert texture.average_textures(pixels.filter("texture_id = 'q'")).count() == 6


def test_no_common_sample_is_an_error(spark):
    from surfpop.operators import features

    rows = spark.createDataFrame([("s", 0, True), ("s", 1, False), ("t", 0, False), ("t", 1, True)], "specimen_id string, sample_id long, valid boolean")
    with pytest.raises(ValueError, match="No sample"):
        features.color_features(rows, rows, "drop")


def test_queries_on_features_have_no_rows_without_a_common_sample(spark, tmp_path):
    """Their SQL twins have none: suppliers enough that every sample is invalid for one of them."""
    import __spark_entry__ as entry

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lines.withColumn("l_discount", F.when(F.col("l_quantity") % 2 == F.col("l_suppkey") % 2, 0.1).otherwise(0.0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    names = [n for n in entry.queries() if n.startswith(("a8_", "c8_", "c9_", "c10_"))]
    assert len(names) == 7
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in names:
        got = entry.queries()[name](spark, str(tmp_path))
        assert duck.execute(entry.oracle_sql()[name]).fetchall() == got.collect() == [], name


def test_different_topology_is_reported(spark):
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (1, 0, 0, 2, 1)], ["mesh_id", "face_id", "a", "b", "c"])
    v = spark.createDataFrame([(k, i) for k in (0, 1) for i in range(3)], ["mesh_id", "vertex_id"])
    with pytest.raises(ValueError):
        checks.assert_same(checks.fingerprint("topology", faces=f, vertices=v))


def test_whole_flow(spark, dataset):
    mesh, marks, pixels, removed = atlas.load_specimens(spark, str(dataset))
    assert removed.count() == 0
    options = atlas.AtlasOptions(texture_size=24, extrusion=0.05, uv_angle=80)
    result = atlas.build_atlas(mesh, marks, pixels, options)
    assert result.mesh.vertices.count() == N * N and result.resampled.count() == 4 * N * N
    assert result.mesh.corner_uv.filter("u < 0 OR u > 1 OR v < 0 OR v > 1").count() == 0
    weights = result.resampled.select(F.abs(F.col("w0") + F.col("w1") + F.col("w2") - 1).alias("e"), "dist")
    assert weights.agg(F.max("e")).first()[0] < 1e-9 and weights.filter("dist < 0").count() == 0
    assert result.average.filter("alpha > 0").count() > 24 * 24 // 3
    textures = atlas.texel_pixels(result.texels, 24, 24)
    out = color_plan.run_colors(result.mesh, textures, color_plan.ColorOptions(sample_count=None, clusters=3, initial_clusters=5))
    assert out.palette.count() == 3 and out.processed.filter("valid AND label NOT IN (0, 1, 2)").count() == 0
    scores = population.run_population(out, "pca", 2).scores
    assert scores.count() == 8


def test_supplied_atlas_and_welded_surface_are_checked(spark):
    v = spark.createDataFrame([("atlas", i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1)])], ["mesh_id", "vertex_id", "x", "y", "z"])
    f = spark.createDataFrame([("atlas", 0, 0, 1, 2)], ["mesh_id", "face_id", "a", "b", "c"])
    schema = "specimen_id string, label string, ord long, x double, y double, z double"
    marks = spark.createDataFrame([("s", c, i, float(i), 0.0, 0.0) for i, c in enumerate("abc")], schema)
    own = marks.drop("specimen_id")
    atlas.validate_atlas(m.Mesh(v, f), own, marks)
    bad = [(m.Mesh(v, f.withColumn("c", F.lit(7))), own, "out of range"), (m.Mesh(v, f.withColumn("c", F.lit(1))), own, "three distinct"),
           (m.Mesh(v, f.limit(0)), own, "No faces"), (m.Mesh(v, f), own.filter("label <> 'c'"), "labels"), (m.Mesh(v.withColumn("y", F.lit(0.0)), f), own, "Degenerate")]
    for mesh, labels, words in bad:
        with pytest.raises(ValueError, match=words):
            atlas.validate_atlas(mesh, labels, marks)


def test_landmark_table_is_wide_and_quoted(spark):
    from surfpop.sources import landmarks

    extra = ",".join(f"e{i}" for i in range(70))
    text = f'{extra},"label","x",y,z\n' + ",".join(["0"] * 70) + ',"nose, ""tip""",1,2.5,-3\n'
    got, problems = landmarks.parse_landmarks(spark.createDataFrame([("s", "csv", text)], "specimen_id string, kind string, text string"))
    assert problems.isEmpty()
    assert [tuple(r) for r in got.collect()] == [("s", 'nose, "tip"', 0, 1.0, 2.5, -3.0)]
