"""Spatial joins, welding and sampling against brute force."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfpop.operators import graph, neighbors, spatial, weld
from surfpop.operators import mesh as m


def _closest(p, a, b, c):
    """Distance by minimising over a triangle with plain projections."""
    best = np.inf
    for u, v in ((a, b), (b, c), (c, a)):
        e = v - u
        t = np.clip(np.dot(p - u, e) / np.dot(e, e), 0, 1)
        best = min(best, np.linalg.norm(p - u - t * e))
    n = np.cross(b - a, c - a)
    h = np.dot(p - a, n) / np.dot(n, n)
    q = p - h * n
    inside = all(np.dot(np.cross(v - u, q - u), n) >= 0 for u, v in ((a, b), (b, c), (c, a)))
    return min(best, abs(h) * np.linalg.norm(n)) if inside else best


@pytest.fixture(scope="module")
def scene(spark):
    """Random triangles of three meshes: one spread out, one crowded into a corner, one tiny."""
    rng = np.random.default_rng(3)
    tris = []
    for mesh_id, count, width in ((0, 700, 10.0), (1, 400, 0.01), (2, 3, 1.0)):
        base = rng.random((count, 3)) * width
        if mesh_id == 1:
            base[0] += 50
        corners = base[:, None] + rng.normal(size=(count, 3, 3)) * width * 0.05
        tris += [(mesh_id, i, *map(float, t.ravel())) for i, t in enumerate(corners)]
    names = ["mesh_id", "face_id"] + [f"{c}{n}" for c in "abc" for n in "xyz"]
    tri = spark.createDataFrame(tris, names)
    points = [(int(k % 3), k, *map(float, rng.normal(size=3) * (8 if k % 2 else 60))) for k in range(150)]
    return tris, tri, points, spark.createDataFrame(points, ["mesh_id", "query_id", "qx", "qy", "qz"])


def test_nearest_on_surface_is_exact(scene):
    tris, tri, points, queries = scene
    got = {(r["mesh_id"], r["query_id"]): r for r in spatial.nearest_on_surface(queries, tri).collect()}
    assert len(got) == len(points)
    for mesh_id, qid, *p in points:
        p = np.array(p)
        want = min(_closest(p, *np.array(t[2:]).reshape(3, 3)) for t in tris if t[0] == mesh_id)
        row = got[(mesh_id, qid)]
        assert np.isclose(np.sqrt(row["d2"]), want, atol=1e-9)
        assert np.isclose(np.linalg.norm(np.array([row["px"], row["py"], row["pz"]]) - p), want, atol=1e-9)


@pytest.mark.parametrize("sizes, levels", [((200, 3, 90), 1), ((700, 3, 90), 2), ((5000, 3, 90), 3)])
def test_nearest_vertex_is_exact(spark, sizes, levels, monkeypatch):
    """Grids with ties, a mesh without queries and one without vertices; queries of a mesh dealt over several places."""
    monkeypatch.setattr(spatial, "PLACE_ROWS", 20)
    monkeypatch.setattr(spatial, "DISTANCES", 1000)
    rng = np.random.default_rng(8)
    vertices = [(k, i, *map(float, rng.integers(0, 12, 3))) for k, n in enumerate(sizes) for i in rng.permutation(n).tolist()]
    points = [(k % 2 if k % 9 else 7, k, *map(float, rng.integers(-3, 30, 3) / 2)) for k in range(150)]
    points += [(0, None, 1.0, 2.0, 3.0), (0, 1000, None, 0.0, 0.0)]
    kind = "mesh_id long, {} long, {}x double, {}y double, {}z double"
    queries = spark.createDataFrame(points, kind.format("query_id", *["q"] * 3))
    near = spatial.nearest_vertex(queries, spark.createDataFrame(vertices, kind.format("vertex_id", "", "", "")))
    want = {(m, q, *min((sum((a - b) ** 2 for a, b in zip(v[2:], p)), v[1]) for v in vertices if v[0] == m)) for m, q, *p in points if m < 3 and None not in p}
    got = near.select("mesh_id", "query_id", "d2", "vertex_id").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert spatial.PackedBoxes(spark.createDataFrame(vertices, kind.format("vertex_id", "", "", "")), ("",), "vertex_id").depth == levels


def test_nearest_vertex_makes_no_row_per_box(spark):
    """On meshes of a single block each query is shuffled once and gives one row; boxes and vertices were joined to it as rows before."""
    vertices = spark.range(400).selectExpr("id % 2 as mesh_id", "id as vertex_id", "id % 7 as x", "id % 11 as y", "id % 13 as z").selectExpr("mesh_id", "vertex_id", *[f"cast({n} as double) {n}" for n in "xyz"])
    queries = vertices.selectExpr("mesh_id", "vertex_id as query_id", "x + 0.2 as qx", "y as qy", "z as qz").selectExpr("mesh_id", "query_id", *[f"cast(q{n} as double) q{n}" for n in "xyz"])
    near = spatial.nearest_vertex(queries, vertices)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "_boxes" not in plan and not any("Join" in line and "_node" in line for line in plan.splitlines())
    assert near.count() == 400 and near.agg(F.max("d2")).first()[0] < 0.05


def test_small_meshes_use_several_levels(spark, scene):
    _, tri, _, queries = scene
    assert spatial.PackedBoxes(tri, ("a", "b", "c"), "face_id").depth >= 2


def test_nearest_plan_has_no_nested_loop(spark, scene):
    _, tri, _, queries = scene
    plan = spatial.nearest_on_surface(queries, tri)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ray_hits_are_exact(spark, scene):
    tris, tri, _, _ = scene
    rng = np.random.default_rng(5)
    rays = []
    for k in range(120):
        target = np.array(tris[rng.integers(700)][2:]).reshape(3, 3).mean(axis=0)
        o = target + rng.normal(size=3) * 5
        d = (target - o) / np.linalg.norm(target - o)
        rays.append((0, k, *map(float, o), *map(float, d)))
    df = spark.createDataFrame(rays, ["mesh_id", "query_id", "qx", "qy", "qz", "dx", "dy", "dz"])
    got = {r["query_id"]: r["t"] for r in spatial.ray_hits(df, tri).collect()}
    for _, k, *v in rays:
        o, d = np.array(v[:3]), np.array(v[3:])
        best = np.inf
        for t in tris:
            if t[0] != 0:
                continue
            a, b, c = np.array(t[2:]).reshape(3, 3)
            try:
                u, w, s = np.linalg.solve(np.stack([b - a, c - a, -d], axis=1), o - a)
            except np.linalg.LinAlgError:
                continue
            if u >= 0 and w >= 0 and u + w <= 1 and s >= 0:
                best = min(best, s)
        assert np.isclose(got[k], best)


def test_weld_matches_greedy_order(spark):
    rng = np.random.default_rng(8)
    pts = rng.random((150, 3)).astype(np.float32).astype(float)
    pts[140:] = pts[3]
    rows = [(0, i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, ["mesh_id", "vertex_id", "x", "y", "z"])
    r = 0.18
    got = {row["vertex_id"]: row["rep_id"] for row in weld.weld_representatives(df, r).collect()}
    free, want = set(range(len(pts))), {}
    for i in range(len(pts)):
        if i not in free:
            continue
        members = [j for j in sorted(free) if ((pts[j] - pts[i]) ** 2).sum() <= r * r]
        centre = (pts[members].sum(axis=0) + pts[i]) / (len(members) + 1)
        # Copies of one position answer for each other through the smallest id.
        rep = min(members, key=lambda j: (round(((pts[j] - centre) ** 2).sum(), 12), j))
        for j in members:
            want[j] = rep
        free -= set(members)
    assert got == want


def _weld(points, r):
    """Representatives by the plain greedy rule; ``points`` by id."""
    free, want = dict(enumerate(points)), {}
    for i in range(len(points)):
        if i not in free:
            continue
        members = [j for j in free if ((points[j] - points[i]) ** 2).sum() <= r * r]
        centre = (points[members].sum(axis=0) + points[i]) / (len(members) + 1)
        rep = min(members, key=lambda j: (((points[j] - centre) ** 2).sum(), j))
        for j in members:
            want[j] = rep
            del free[j]
    return want


def _cloud(spark, points):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(points)], ["mesh_id", "vertex_id", "x", "y", "z"])


@pytest.mark.parametrize("step,most", [(65536, 15), (300, 25)])
def test_weld_settles_a_line_in_few_rounds(spark, monkeypatch, step, most):
    """2000 vertices, each reached by the one before: a dependency through all of them."""
    monkeypatch.setattr(weld, "STEP_POINTS", step)
    rounds = []
    plain = weld.cut
    monkeypatch.setattr(weld, "cut", lambda df: rounds.append(df) or plain(df))
    line = np.array([(np.float32(i * 0.6), 0.0, 0.0) for i in range(2000)], dtype=np.float64)
    got = {r["vertex_id"]: r["rep_id"] for r in weld.weld_representatives(_cloud(spark, line), 1.0).collect()}
    assert got == _weld(line, 1.0)
    assert len(rounds) < most


def test_weld_of_crowded_points_and_of_scattered_ids(spark, monkeypatch):
    monkeypatch.setattr(weld, "CROWD", 4)
    monkeypatch.setattr(weld, "SIDES", (3,))
    rng = np.random.default_rng(4)
    crowd = np.r_[rng.random((150, 3)) * 0.2, rng.random((150, 3)) * 0.9, rng.random((200, 3)) * 3].astype(np.float32).astype(np.float64)
    crowd = crowd[rng.permutation(len(crowd))]
    df = _cloud(spark, crowd)
    for r in (0.3, 1.0):
        got = {row["vertex_id"]: row["rep_id"] for row in weld.weld_representatives(df, r).collect()}
        assert got == _weld(crowd, r)


def test_weld_plan_makes_no_pairs_of_points(spark):
    points = weld._positions(_cloud(spark, np.zeros((3, 3))))
    plan = weld._claims(points, points, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Cartesian" not in plan


def test_weld_zero_is_identity(spark):
    v = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(4)], ["mesh_id", "vertex_id", "x", "y", "z"])
    assert all(r["vertex_id"] == r["rep_id"] for r in weld.weld_representatives(v, 0.0).collect())


def _strip(spark, n=14):
    v = [(0, i, float(i // 2), float(i % 2), 0.1 * ((i * 7) % 5)) for i in range(2 * n)]
    f = [(0, i, i, i + 1, i + 2) for i in range(2 * n - 2)]
    return (spark.createDataFrame(v, ["mesh_id", "vertex_id", "x", "y", "z"]),
            spark.createDataFrame(f, ["mesh_id", "face_id", "a", "b", "c"]))


def test_sample_faces_follow_greedy_order(spark):
    v, f = _strip(spark)
    mesh = m.Mesh(v, f)
    measures = m.face_measures(mesh)
    adj = graph.adjacency(f)
    edges = graph.weighted_adjacency(adj, measures, v)
    comp = graph.components(f, graph.edge_links(f))
    assert {r["component"] for r in comp.collect()} == {0}
    chosen, owners = graph.sample_faces(measures, edges, comp, 4)
    got = [r["face_id"] for r in chosen.orderBy("sample_id").collect()]
    links = {}
    for r in edges.collect():
        links.setdefault(r["face_id"], []).append((r["nbr_id"], r["w"]))
    area = {r["face_id"]: r["area"] for r in measures.collect()}
    low, own, want = {k: np.inf for k in area}, {}, []
    for s in range(4):
        face = max(area, key=lambda k: (area[k], -k)) if s == 0 else max(low, key=lambda k: (low[k], -k))
        want.append(face)
        dist, heap = {}, [(0.0, face)]
        while heap:
            d, k = heapq.heappop(heap)
            if k in dist:
                continue
            dist[k] = d
            for nbr, w in links[k]:
                heapq.heappush(heap, (d + w, nbr))
        for k, d in dist.items():
            if d < low[k]:
                low[k], own[k] = d, s
    assert got == want
    assert {r["face_id"]: r["sample_id"] for r in owners.collect()} == own


def test_smoothing_a_constant_keeps_it(spark):
    v, f = _strip(spark)
    measures = m.face_measures(m.Mesh(v, f))
    colors = f.select(F.lit("s").alias("specimen_id"), "face_id", F.lit(0.3).alias("r"), F.lit(0.4).alias("g"), F.lit(0.5).alias("b"), (F.col("face_id") != 5).alias("valid"))
    for row in graph.smooth(colors, measures, graph.adjacency(f), 3).collect():
        want = (0.3, 0.4, 0.5) if row["face_id"] != 5 else (0, 0, 0)
        assert np.allclose([row["r"], row["g"], row["b"]], want)


def test_adjacency_keeps_all_pairs_on_a_crowded_edge(spark):
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 1, 0, 3), (0, 2, 0, 1, 4)], ["mesh_id", "face_id", "a", "b", "c"])
    assert graph.adjacency(f).count() == 6


def test_shortcuts_of_a_mesh_do_not_depend_on_others(spark):
    pairs = [(1, i, i + 1) for i in range(6)] + [(2, 0, i) for i in range(1, 21)]
    rows = [(k, *e, 1.0) for k, a, b in pairs for e in ((a, b), (b, a))]
    edges = spark.createDataFrame(rows, "mesh_id long, face_id long, nbr_id long, w double")
    alone = sorted(map(tuple, graph.shortcuts(edges.filter("mesh_id = 1")).collect()))
    beside = sorted(map(tuple, graph.shortcuts(edges).collect()))
    assert len(alone) > 12 and [r for r in beside if r[0] == 1] == alone
    assert [r for r in beside if r[0] == 2] == sorted(r for r in rows if r[0] == 2)


@pytest.mark.parametrize("pivots,block", [(6, 16), (None, 16384), (1, 7)])
def test_knn_is_exact_with_a_crowded_cell(spark, pivots, block):
    """A crowded cell, equal rows and many equal distances; ids are strings."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 5)), 20 + 0.01 * rng.normal(size=(40, 5)), np.ones((7, 5)), rng.integers(0, 2, (30, 5))])
    rows = [(f"s{i:03}", j, float(x[i, j])) for i in range(len(x)) for j in range(5)]
    df = spark.createDataFrame(rows, ["specimen_id", "feature_id", "value"])
    got = {(r["specimen_id"], r["rank"]): (r["nbr_id"], r["dist"]) for r in neighbors.knn_graph(df, 4, pivots=pivots, block_rows=block).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 4 * len(x)
    for i in range(len(x)):
        want = np.argsort(d[i], kind="stable")[:4]
        assert [got[(f"s{i:03}", k)][0] for k in range(1, 5)] == [f"s{j:03}" for j in want]
        assert np.allclose([got[(f"s{i:03}", k)][1] for k in range(1, 5)], d[i][want])


def test_knn_of_two_rows_and_bad_k(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in (3, 5)], ["specimen_id", "feature_id", "value"])
    assert [tuple(r) for r in neighbors.knn_graph(df).orderBy("specimen_id").collect()] == [(3, 1, 5, 2.0), (5, 1, 3, 2.0)]
    for k in (0, 2):
        with pytest.raises(ValueError):
            neighbors.knn_graph(df, k)


def test_pivots_grow_with_the_root_of_the_rows():
    tree = neighbors.Pivots(np.random.default_rng(0).normal(size=(100, 3)))
    x = np.random.default_rng(1).normal(size=(500, 3))
    cell, far = tree.cells(x)
    assert len(tree.tops) == 10 and np.allclose(far, np.linalg.norm(x - tree.centres[cell], axis=1))
    assert (tree.branch[cell] == np.argmin(((x[:, None] - tree.tops[None]) ** 2).sum(2), axis=1)).all()


def _greedy(faces, area, links, component, count):
    """Samples in plain greedy order: one shortest-path search per sample."""
    low, own, chosen = {f: np.inf for f in faces}, {}, []
    seeds = [max((f for f in faces if component[f] == c), key=lambda f: (area[f], -f)) for c in sorted(set(component.values()))]
    for s in range(count):
        face = seeds[s] if s < len(seeds) else max(faces, key=lambda f: (low[f], -f))
        chosen.append(face)
        heap, near = [(0.0, face)], {}
        while heap:
            d, f = heapq.heappop(heap)
            if f in near:
                continue
            near[f] = d
            for g, w in links.get(f, []):
                if g not in near:
                    heapq.heappush(heap, (d + w, g))
        for f, d in near.items():
            if d < low[f]:
                low[f], own[f] = d, s
    return chosen, own, low


@pytest.fixture(scope="module")
def bumpy(spark):
    """A bumpy sheet, an evenly spaced sheet full of ties, and a lone triangle, as one mesh; the bumpy sheet again as another."""
    rng = np.random.default_rng(8)
    v, f = [], []

    def sheet(mesh_id, n, k, rough, at):
        base, first = sum(r[0] == mesh_id for r in v), sum(r[0] == mesh_id for r in f)
        for i in range(n * k):
            v.append((mesh_id, base + i, float(i // k) + at + rough * float(rng.random()), float(i % k), rough * float(rng.random())))
        for q in range((n - 1) * (k - 1)):
            a = base + (q // (k - 1)) * k + q % (k - 1)
            f.append((mesh_id, first + 2 * q, a, a + k, a + k + 1))
            f.append((mesh_id, first + 2 * q + 1, a, a + k + 1, a + 1))

    sheet(0, 14, 17, 0.7, 0.0)
    sheet(0, 9, 9, 0.0, 100.0)
    sheet(1, 12, 12, 0.7, 0.0)
    base, first = sum(r[0] == 0 for r in v), sum(r[0] == 0 for r in f)
    v += [(0, base, 50.0, 0.0, 0.0), (0, base + 1, 51.0, 0.0, 0.0), (0, base + 2, 50.0, 1.0, 0.0)]
    f.append((0, first, base, base + 1, base + 2))
    vertices = spark.createDataFrame(v, ["mesh_id", "vertex_id", "x", "y", "z"])
    faces = spark.createDataFrame(f, ["mesh_id", "face_id", "a", "b", "c"])
    mesh = m.Mesh(vertices, faces)
    measures = spark.createDataFrame(m.face_measures(mesh).collect())
    edges = graph.weighted_adjacency(graph.adjacency(faces), measures, vertices)
    edges = spark.createDataFrame(edges.collect())
    comp = spark.createDataFrame(graph.components(faces, graph.edge_links(faces)).collect())
    return measures, edges, comp


@pytest.mark.parametrize("patch,count", [(100000, 200), (150, 30)])
def test_many_samples_are_in_greedy_order(bumpy, patch, count):
    measures, edges, comp = bumpy
    chosen, owners = graph.sample_faces(measures, edges, comp, count, patch)
    for mesh_id in (0, 1):
        area = {r["face_id"]: r["area"] for r in measures.collect() if r["mesh_id"] == mesh_id}
        component = {r["face_id"]: r["component"] for r in comp.collect() if r["mesh_id"] == mesh_id}
        links = {}
        for r in edges.collect():
            if r["mesh_id"] == mesh_id:
                links.setdefault(r["face_id"], []).append((r["nbr_id"], r["w"]))
        want, own, low = _greedy(sorted(area), area, links, component, count)
        assert [r["face_id"] for r in chosen.filter(F.col("mesh_id") == mesh_id).orderBy("sample_id").collect()] == want
        got = {r["face_id"]: (r["sample_id"], r["dist"]) for r in owners.filter(F.col("mesh_id") == mesh_id).collect()}
        assert got == {f: (own[f], low[f]) for f in area}


def test_samples_of_all_faces_and_too_few(bumpy):
    measures, edges, comp = bumpy
    few = measures.filter("mesh_id = 1 and face_id < 40")
    links = edges.filter("mesh_id = 1 and face_id < 40 and nbr_id < 40")
    one = few.selectExpr("mesh_id", "face_id", "0 as component")
    for patch in (25, 1000):
        chosen, _ = graph.sample_faces(few, links, one, 40, patch)
        assert sorted(r["face_id"] for r in chosen.collect()) == list(range(40))
    with pytest.raises(ValueError):
        graph.sample_faces(measures, edges, comp, 2)


def test_nearest_rows_rank_again_only_where_someone_came_near(monkeypatch):
    """Rows come in small parts; equal rows, ties and the row itself among them. Each part once ranked all rows of the block anew."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 4)), np.ones((40, 4)), rng.integers(0, 2, (60, 4))])
    ids = rng.permutation(len(x))
    monkeypatch.setattr(neighbors, "PAIRS", 64 * 200)
    monkeypatch.setattr(neighbors, "SLICE", 37, raising=False)
    now = neighbors.Nearest(6)
    now.hold(ids[:200], x[:200])
    now.start()
    for at in range(0, len(x), 90):
        now.meet(ids[at:at + 90], x[at:at + 90])
    got = now.result()
    d = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2))
    for i in range(200):
        want = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:6]
        mine = got[got["specimen_id"] == ids[i]].sort_values("rank")
        assert list(mine["nbr_id"]) == [w[1] for w in want] and np.allclose(mine["dist"], [w[0] for w in want])
    # A part that comes near to one row has only that row's neighbours ranked.
    ranked, keep = [], neighbors.pd.DataFrame.sort_values
    monkeypatch.setattr(neighbors.pd.DataFrame, "sort_values", lambda df, *a, **kw: ranked.append(len(df)) or keep(df, *a, **kw))
    now.meet(np.arange(1000, 1100), np.vstack([x[:1] + 1e-3, np.full((99, 4), 1e6)]))
    assert 0 < sum(ranked) < 200
