"""Spark queries beside their SQL twins on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# One per family; tools/check.py runs every pair.
NAMES = [
    "s1_pair_files", "s2_parse_obj_faces", "s3_parse_landmarks", "s7_prepare_removed", "v5_uv_violations", "v9_landmark_rank",
    "v13_fingerprint_topology", "j2_adjacency", "w1_compact", "g7_face_map", "g9_extract_faces", "a3_color_moments",
    "a4_pooled_moments", "c3_process_colors", "a5_average_textures", "j10_sample_image", "g2_smooth", "c9_area_features_l2",
    "c8_color_features", "j3_nearest_on_surface", "j5_ray_hits", "g3_components", "g10_rasterize_uv", "g12_pad",
    "g8_select_same_side", "p5_spline_affine", "c11_gram", "j12_knn_graph", "c16_reconstruct_colors",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert math.isclose(x, y, abs_tol=2e-6) if isinstance(y, float) else x == y
