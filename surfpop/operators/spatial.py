"""Spatial joins: nearest surface point, nearest vertex, first ray hit, nearest rows.

Items of a mesh are packed into boxes of ``FAN`` neighbours along a Morton curve, boxes
into boxes, and so on. A query walks down one level per join and keeps only the boxes
that may still hold its answer. Boxes hold equal counts, so dense spots do not grow
crowded cells, and a query far from everything stays as cheap as a near one.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from surfpop.functions import geometry as g
from surfpop.session import cut, shuffled, spread_join, wide_parts

FAN = 16
SALTS = 16
# Queries that meet one block in one place, those of all blocks in one task, blocks with queries in one task, and distances held at a time.
PLACE_ROWS = 1 << 16
TASK_ROWS = 1 << 19
TASK_BLOCKS = 1 << 10
DISTANCES = 1 << 20
# A box may be dropped only when it is farther than the bound by more than rounding.
SLACK = 1.0 + 1e-9

# Masks of the usual 21-bit Morton spreading steps.
SPREAD = (
    (32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249),
)


def _spread_bits(value):
    for shift, mask in SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def morton(x, y, z, low, high):
    """63-bit curve position of a point inside the box low..high (tuples of floats)."""
    code = F.lit(0).cast("bigint")
    for i, (c, lo, hi) in enumerate(zip((x, y, z), low, high)):
        span = (hi - lo) or 1.0
        cell = F.floor((c - lo) / span * float(2**21 - 1)).cast("bigint")
        cell = F.greatest(F.lit(0), F.least(F.lit(2**21 - 1), cell))
        code = code.bitwiseOR(F.shiftleft(_spread_bits(cell), i))
    return code


BOX = [f"{tag}{n}" for tag in ("lo", "hi") for n in "xyz"]


class PackedBoxes:
    """Items with a packing position, and per level the boxes below each parent as one array.

    ``levels[l]`` maps (mesh_id, _parent) to at most FAN boxes; ``top`` maps mesh_id to the
    few boxes of the highest level.
    """

    def __init__(self, items: DataFrame, corner_prefixes: tuple[str, ...], item_id: str):
        def extent(fn):
            cols = [[F.col(p + n) for p in corner_prefixes] for n in "xyz"]
            return [fn(*c) if len(c) > 1 else c[0] for c in cols]

        lo, hi = extent(F.least), extent(F.greatest)
        bounds = [F.min(c).alias(f"lo{n}") for c, n in zip(lo, "xyz")] + [F.max(c).alias(f"hi{n}") for c, n in zip(hi, "xyz")]
        per_mesh = items.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), *bounds)
        row = per_mesh.agg(F.max("n"), *[F.min(f"lo{n}") for n in "xyz"], *[F.max(f"hi{n}") for n in "xyz"]).first()
        largest = row[0] or 0
        low, high = (row[1:4], row[4:7]) if largest else ((0.0,) * 3, (1.0,) * 3)
        centre = [(p + q) / 2.0 for p, q in zip(lo, hi)]
        order = ["mesh_id", "_code", item_id]
        sorted_items = cut(
            items.withColumn("_code", morton(*centre, low, high))
            .repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_at", F.monotonically_increasing_id()).drop("_code")
        ).withColumn("_part", F.shiftright("_at", 33))
        # Close the gaps between partitions: one small row per partition.
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sorted_items.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select(
            "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
        )
        row_in_part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        self.items = sorted_items.join(starts, "_part").withColumn(
            "_node", F.floor((F.col("_start") + row_in_part) / FAN).cast("bigint")
        ).drop("_at", "_part", "_start")
        self.depth = max(1, math.ceil(math.log(max(largest / FAN, 1.0), FAN) - 1e-9))
        first = corner_prefixes[0]
        boxes = cut(self.items.groupBy("mesh_id", "_node").agg(
            *bounds, F.min(F.struct(F.col(item_id).alias("id"), *[F.col(first + n).alias(n) for n in "xyz"])).alias("rep")
        ))
        self.levels = {}
        for level in range(1, self.depth + 1):
            packed = F.collect_list(F.struct("_node", *BOX, *[F.col(f"rep.{n}").alias(f"r{n}") for n in "xyz"])).alias("_boxes")
            if level == self.depth:
                self.top = boxes.groupBy("mesh_id").agg(packed)
                break
            parent = F.floor(F.col("_node") / FAN).cast("bigint")
            self.levels[level] = boxes.withColumn("_parent", parent).groupBy("mesh_id", "_parent").agg(packed)
            boxes = cut(boxes.withColumn("_node", parent).groupBy("mesh_id", "_node").agg(
                *[F.min(f"lo{n}").alias(f"lo{n}") for n in "xyz"], *[F.max(f"hi{n}").alias(f"hi{n}") for n in "xyz"], F.min("rep").alias("rep")
            ))


def _sum_squares(values):
    return reduce(lambda p, q: p + q, [v * v for v in values])


def _walk(points: DataFrame, tree: PackedBoxes, down_to: int = 1) -> DataFrame:
    """(points columns, _q, _best, _node): the boxes of level ``down_to`` that may hold the nearest item, 1 the lowest.

    Boxes travel as arrays of at most FAN, so a level costs one row per kept parent.
    ``_q`` names a query in one column. Pruning groups by it alone, so Spark reshuffles by
    query instead of keeping the join's mesh-wise layout with a hot mesh in one task.
    """
    query = points.columns
    p = g.vec("q")

    def score(df):
        """Lower and upper bound of the squared distance for every box of the row."""
        return df.select(*query, "_q", F.transform("_boxes", lambda b: F.struct(
            b["_node"].alias("node"),
            _sum_squares([F.greatest(b[f"lo{n}"] - c, c - b[f"hi{n}"], F.lit(0.0)) for c, n in zip(p, "xyz")]).alias("lb"),
            _sum_squares([b[f"r{n}"] - c for c, n in zip(p, "xyz")]).alias("ub"),
        )).alias("_s"))

    def keep(df):
        # The row number keeps the bound a column: inlined, it would be taken anew for every box.
        df = df.withColumn("_row", F.monotonically_increasing_id())
        return df.select(*query, "_q", F.explode(
            F.filter("_s", lambda b: (b["lb"] <= F.col("_best") * SLACK) & (F.col("_row") >= 0))
        ).alias("_b"), "_best").select(*query, "_q", "_best", F.col("_b.node").alias("_node"))

    nearest = F.array_min(F.transform("_s", lambda b: b["ub"]))
    state = points.withColumn("_q", F.struct("mesh_id", "query_id"))
    state = score(spread_join(state, tree.top, ["mesh_id"], ["_q"], SALTS, heavy=True))
    state = keep(state.select(*query, "_q", "_s", nearest.alias("_best")))
    for level in range(tree.depth - 1, down_to - 1, -1):
        state = score(state.withColumnRenamed("_node", "_parent").join(shuffled(tree.levels[level]), ["mesh_id", "_parent"]))
        state = keep(state.withColumn("_best", F.min(nearest).over(Window.partitionBy("_q"))))
    return state


def _in_blocks(points: DataFrame, tree: PackedBoxes, items: list[str], settle, kinds: StructType) -> DataFrame:
    """What ``settle`` makes of the queries of a block and its items, for points(mesh_id, _node, query_id, ...) that name their blocks.

    Blocks are those of level 2, of at most FAN * FAN items, or whole meshes if no mesh holds more. A block and its queries are one
    row each, so a query is shuffled once per block. A block of more than PLACE_ROWS queries is sent to as many places as they need;
    only such blocks are listed. ``settle(points, items)`` gets arrays by name and gives arrays as ``kinds`` has them after mesh_id,
    the first of them places in ``points``.
    """
    on = ["mesh_id", "_node"]
    points = cut(points)
    # A single block is 0 by its node: a literal would be folded out of the join.
    blocks = tree.items.withColumn("_box", F.col("_node")).withColumn(
        "_node", F.floor(F.col("_box") / FAN).cast("bigint") if tree.depth > 1 else F.shiftright("_box", 62)).select(*on, "_box", *items)
    counts = cut(points.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total, largest, many = counts.agg(F.sum("_n"), F.max("_n"), F.count(F.lit(1))).first()
    tasks = max(wide_parts(points.sparkSession), (total or 0) // TASK_ROWS, many // TASK_BLOCKS)
    if (largest or 0) > PLACE_ROWS:
        full = F.broadcast(counts.filter(F.col("_n") > PLACE_ROWS).select(*on, F.ceil(F.col("_n") / PLACE_ROWS).alias("_places")))
        places = F.coalesce("_places", F.lit(1))
        points = points.join(full, on, "left").withColumn("_place", F.pmod(F.xxhash64("query_id"), places)).drop("_places")
        blocks = blocks.join(full, on, "left").withColumn("_place", F.explode(F.sequence(F.lit(0).cast("bigint"), places - 1))).drop("_places")
        on = [*on, "_place"]

    def packed(df, name):
        return df.repartition(tasks, *on).groupBy(*on).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in on])).alias(name))

    def arrays(lists: pa.ListArray, k: int) -> dict[str, np.ndarray]:
        rows = lists[k].values
        return {rows.type.field(i).name: c.to_numpy(zero_copy_only=False) for i, c in enumerate(rows.flatten())}

    names = kinds.names

    def each(batches):
        for b in batches:
            for k in range(b.num_rows):
                points, items = (arrays(b.column(name), k) for name in ("_points", "_items"))
                at, *found = settle(points, items)
                if len(at):
                    ids = b.column("_points")[k].values.field("query_id").take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([b.column("mesh_id").take(pa.array(np.full(len(at), k))), ids, *map(pa.array, found)], names)

    met = packed(points, "_points").join(shuffled(packed(blocks, "_items")), on)
    return met.select("mesh_id", "_points", "_items").mapInArrow(each, kinds)


class BlockBoxes:
    """The boxes of a block: their bounds, and the items of each in id order, short rows filled up with their first."""

    def __init__(self, items: dict[str, np.ndarray], corners: str, item_id: str):
        xyz = np.array([[items[c + n] for n in "xyz"] for c in corners])
        self.lo, self.hi = xyz.min(axis=0), xyz.max(axis=0)
        order = np.lexsort((items[item_id], items["_box"]))
        _, start, count = np.unique(items["_box"][order], return_index=True, return_counts=True)
        width = np.arange(count.max())
        self.items = order[start[:, None] + np.where(width < count[:, None], width, 0)]
        self.box_lo, self.box_hi = self.lo[:, self.items].min(axis=2), self.hi[:, self.items].max(axis=2)


def _least(at: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the rows of every ``at`` the one of least value, the smaller id on a tie."""
    order = np.lexsort((ids, values, at))
    return order[np.r_[True, at[order][1:] != at[order][:-1]]] if len(order) else order


def _gap2(q: list, lo, hi):
    return _sum_squares([np.maximum(np.maximum(low - c, c - high), 0.0) for c, low, high in zip(q, lo, hi)])


def _nearest_faces(points: dict[str, np.ndarray], faces: dict[str, np.ndarray]) -> tuple:
    """For every query of a block its nearest face, the smaller id on a tie: (query, face_id, px, py, pz, d2)."""
    boxes, found = BlockBoxes(faces, "abc", "face_id"), []
    corners, ids = [[faces[c + n] for n in "xyz"] for c in "abc"], faces["face_id"]
    rep = [corners[0][k][boxes.items[:, 0]] for k in range(3)]
    step = max(1, DISTANCES // (2 * len(ids)))

    def exact(at, q, rows, bound):
        """Rows (place in ``at``, face, point, d2): the nearest of the faces ``rows`` of every entry of ``at`` that may lie within its bound."""
        wide = [c[at][:, None] for c in q]
        i, j = np.nonzero(~(_gap2(wide, boxes.lo[:, rows], boxes.hi[:, rows]) > bound[at][:, None]))
        f = rows[i, j]
        here = [c[at[i]] for c in q]
        point = g.closest_on_triangle(here, *[[n[f] for n in c] for c in corners])
        d2 = _sum_squares([p - c for p, c in zip(point, here)])
        pick = _least(at[i], d2, ids[f])
        return at[i][pick], f[pick], [p[pick] for p in point], d2[pick]

    for k in range(0, len(points["qx"]), step):
        q = [points[f"q{n}"][k:k + step] for n in "xyz"]
        wide = [c[:, None] for c in q]
        low = _gap2(wide, boxes.box_lo[:, None], boxes.box_hi[:, None])
        best = _sum_squares([r[None] - c for r, c in zip(rep, wide)]).min(axis=1)
        # Ways that differ by rounding alone are all taken exactly, so the smaller id wins as it does without boxes.
        near = 1e-24 * _sum_squares(q)
        first, every = low.argmin(axis=1), np.arange(len(q[0]))
        one = exact(every, q, boxes.items[first], best * SLACK + near)
        np.minimum.at(best, one[0], one[3])
        bound = best * SLACK + near
        more = ~(low > bound[:, None])
        more[every, first] = False
        at, box = np.nonzero(more)
        two = exact(at, q, boxes.items[box], bound)
        at, f, d2 = (np.r_[one[n], two[n]] for n in (0, 1, 3))
        pick = _least(at, d2, ids[f])
        found.append((at[pick] + k, ids[f[pick]], *[np.r_[p, r][pick] for p, r in zip(one[2], two[2])], d2[pick]))
    return tuple(map(np.concatenate, zip(*found)))


def _blocks_of(points: DataFrame, tree: PackedBoxes, walk) -> DataFrame:
    """Points with the block in ``_node``: the only one, or those that ``walk`` leaves open."""
    return walk() if tree.depth > 1 else points.withColumn("_node", F.lit(0).cast("bigint"))


def nearest_on_surface(points: DataFrame, tri: DataFrame) -> DataFrame:
    """Closest surface point of the query's own mesh, exact.

    ``points(mesh_id, query_id, qx, qy, qz)``, ``tri(mesh_id, face_id, ax..cz)`` ->
    (mesh_id, query_id, face_id, px, py, pz, d2); the smaller face id wins a tie.
    """
    q, abc = ["qx", "qy", "qz"], [f"{c}{n}" for c in "abc" for n in "xyz"]
    points = points.select("mesh_id", "query_id", *q).filter(" and ".join(f"{c} is not null" for c in q))
    tri = tri.select("mesh_id", "face_id", *abc).filter(" and ".join(f"{c} is not null" for c in abc))
    tree = PackedBoxes(tri, ("a", "b", "c"), "face_id")
    open_blocks = _blocks_of(points, tree, lambda: _walk(points, tree, down_to=2)).select("mesh_id", "_node", "query_id", *q)
    kinds = StructType([points.schema["mesh_id"], points.schema["query_id"], tri.schema["face_id"], *[StructField(n, DoubleType()) for n in ("px", "py", "pz", "d2")]])
    near = _in_blocks(open_blocks, tree, ["face_id", *abc], _nearest_faces, kinds)
    if tree.depth == 1:
        return near
    best = near.groupBy("mesh_id", "query_id").agg(F.min(F.struct("d2", "face_id", "px", "py", "pz")).alias("s"))
    return best.select("mesh_id", "query_id", "s.face_id", "s.px", "s.py", "s.pz", "s.d2")


def _nearest_in_block(points: pa.Table, vertices: pa.Table, names: list[str]) -> pa.Table:
    """For every query the nearest vertex of a block, the smaller id on a tie."""
    vertices = vertices.sort_by("vertex_id")
    at = [[table[f"{tag}{n}"].to_numpy() for n in "xyz"] for table, tag in ((points, "q"), (vertices, ""))]
    near, d2 = np.empty(points.num_rows, np.int64), np.empty(points.num_rows)
    step = max(1, DISTANCES // max(1, vertices.num_rows))
    for k in range(0, points.num_rows, step):
        part = _sum_squares([v[None, :] - q[k:k + step, None] for q, v in zip(*at)])
        near[k:k + step] = np.where(np.isnan(part), np.inf, part).argmin(axis=1)
        d2[k:k + step] = part[np.arange(len(part)), near[k:k + step]]
    return pa.table([points["mesh_id"], points["query_id"], vertices["vertex_id"].take(pa.array(near)), pa.array(d2)], names)


def nearest_vertex(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Closest vertex of the query's own mesh: (mesh_id, query_id, vertex_id, d2); the smaller vertex id wins a tie.

    The walk ends at blocks of at most FAN * FAN vertices. A query is shuffled once to each block left open, its only one for a
    mesh of no more vertices, and held against all of it there. A block is sent to as many places as its queries need;
    only blocks that need several are listed, fewer than one for PLACE_ROWS queries.
    """
    points = points.dropna(subset=["mesh_id", *[f"q{n}" for n in "xyz"]])
    tree = PackedBoxes(vertices.select("mesh_id", "vertex_id", "x", "y", "z"), ("",), "vertex_id")
    on, blocks = ["mesh_id"], tree.items.dropna(subset=["mesh_id", "x", "y", "z"])
    if tree.depth > 1:
        on = ["mesh_id", "_block"]
        blocks = blocks.withColumn("_block", F.floor(F.col("_node") / FAN).cast("bigint"))
        points = _walk(points, tree, down_to=2).withColumnRenamed("_node", "_block")
    points, blocks = cut(points.select(*on, "query_id", "qx", "qy", "qz")), blocks.select(*on, "vertex_id", "x", "y", "z")
    counts = cut(points.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    tasks = max(wide_parts(points.sparkSession), (counts.agg(F.sum("_n")).first()[0] or 0) // TASK_ROWS)
    full = F.broadcast(counts.filter(F.col("_n") > PLACE_ROWS).select(*on, F.ceil(F.col("_n") / PLACE_ROWS).alias("_places")))
    places = F.coalesce("_places", F.lit(1))

    def dealt(df, place):
        return df.join(full, on, "left").withColumn("_place", place).drop("_places").repartition(tasks, *on, "_place").groupBy(*on, "_place")

    kinds = StructType([*[points.schema[n] for n in ("mesh_id", "query_id")], blocks.schema["vertex_id"], StructField("d2", DoubleType())])
    names = kinds.names

    def settle(points: pa.Table, vertices: pa.Table) -> pa.Table:
        if not points.num_rows or not vertices.num_rows:
            return pa.table({n: c.slice(0, 0) for n, c in zip(names, (points["mesh_id"], points["query_id"], vertices["vertex_id"], vertices["x"]))})
        return _nearest_in_block(points, vertices, names)

    near = dealt(points, F.pmod(F.xxhash64("query_id"), places)).cogroup(
        dealt(blocks, F.explode(F.sequence(F.lit(0).cast("bigint"), places - 1)))).applyInArrow(settle, kinds)
    if tree.depth == 1:
        return near
    best = near.groupBy("mesh_id", "query_id").agg(F.min(F.struct("d2", "vertex_id")).alias("s"))
    return best.select("mesh_id", "query_id", "s.vertex_id", "s.d2")


def _slab_hit(p, d, inverse, limit, b):
    """Whether a ray meets box ``b``, grown by rounding. ``inverse`` is NULL where d is 0."""
    enter, leave = F.lit(0.0), limit
    inside = F.lit(True)
    for c, v, w, n in zip(p, d, inverse, "xyz"):
        pad = (F.abs(b[f"lo{n}"]) + F.abs(b[f"hi{n}"]) + F.abs(c)) * 1e-9
        lo, hi = b[f"lo{n}"] - pad, b[f"hi{n}"] + pad
        t0, t1 = (lo - c) * w, (hi - c) * w
        enter = F.greatest(enter, F.least(t0, t1))  # NULLs are skipped by both
        leave = F.least(leave, F.greatest(t0, t1))
        inside = inside & ((v != 0.0) | ((c >= lo) & (c <= hi)))
    return inside & (enter <= leave)


def ray_hits(rays: DataFrame, tri: DataFrame, max_dist: float = 0.0) -> DataFrame:
    """First face met by each ray of its own mesh, as (mesh_id, query_id, face_id, t, px, py, pz).

    ``rays(mesh_id, query_id, qx..qz, dx..dz)`` with unit directions. A hit must be nearer
    than ``max_dist``; 0 means no limit. Edges count as hit.
    """
    abc, qd = [f"{c}{n}" for c in "abc" for n in "xyz"], [f"{c}{n}" for c in "qd" for n in "xyz"]
    rays = rays.select("mesh_id", "query_id", *qd).filter(" and ".join(f"{c} is not null" for c in qd))
    tri = tri.select("mesh_id", "face_id", *abc).filter(" and ".join(f"{c} is not null" for c in abc))
    tree = PackedBoxes(tri, ("a", "b", "c"), "face_id")
    p, d, inverse = g.vec("q"), g.vec("d"), g.vec("i")
    limit = F.lit(float(max_dist) if max_dist else float("inf"))
    state = rays.select(*rays.columns, F.struct("mesh_id", "query_id").alias("_q"), *[
        F.when(v != 0.0, F.lit(1.0) / v).alias(f"i{n}") for v, n in zip(d, "xyz")
    ])
    query = state.columns

    def keep(df):
        met = F.filter("_boxes", lambda b: _slab_hit(p, d, inverse, limit, b))
        return df.select(*query, F.explode(F.transform(met, lambda b: b["_node"])).alias("_node"))

    def walk():
        left = keep(spread_join(state, tree.top, ["mesh_id"], ["_q"], SALTS, heavy=True))
        for level in range(tree.depth - 1, 1, -1):
            left = keep(left.withColumnRenamed("_node", "_parent").join(shuffled(tree.levels[level]), ["mesh_id", "_parent"]))
        return left

    open_blocks = _blocks_of(rays, tree, walk).select("mesh_id", "_node", "query_id", *qd)
    kinds = StructType([rays.schema["mesh_id"], rays.schema["query_id"], tri.schema["face_id"], *[StructField(n, DoubleType()) for n in ("t", "px", "py", "pz")]])
    far = float(max_dist) if max_dist else float("inf")
    met = _in_blocks(open_blocks, tree, ["face_id", *abc], lambda rays, faces: _first_faces(rays, faces, far), kinds)
    if tree.depth == 1:
        return met
    best = met.groupBy("mesh_id", "query_id").agg(F.min(F.struct("t", "face_id", "px", "py", "pz")).alias("s"))
    return best.select("mesh_id", "query_id", "s.face_id", "s.t", "s.px", "s.py", "s.pz")


def _first_faces(rays: dict[str, np.ndarray], faces: dict[str, np.ndarray], limit: float) -> tuple:
    """For every ray that meets a face of a block its first, the smaller id on a tie: (ray, face_id, t, px, py, pz)."""
    boxes, found = BlockBoxes(faces, "abc", "face_id"), []
    a, b, c = ([faces[v + n] for n in "xyz"] for v in "abc")
    e1, e2, ids = g.sub(b, a), g.sub(c, a), faces["face_id"]
    step = max(1, DISTANCES // (2 * len(ids)))
    with np.errstate(all="ignore"):
        for k in range(0, len(rays["qx"]), step):
            q, d = ([rays[tag + n][k:k + step] for n in "xyz"] for tag in "qd")
            enter, leave, inside = 0.0, limit, True
            for p, v, lo, hi in zip(q, d, boxes.box_lo, boxes.box_hi):
                p, v = p[:, None], v[:, None]
                pad = (np.abs(lo) + np.abs(hi) + np.abs(p)) * 1e-9
                w = np.where(v != 0.0, 1.0 / v, np.nan)
                t0, t1 = (lo - pad - p) * w, (hi + pad - p) * w
                # fmax and fmin pass over the sides that a ray runs along.
                enter, leave = np.fmax(enter, np.fmin(t0, t1)), np.fmin(leave, np.fmax(t0, t1))
                inside = inside & ((v != 0.0) | ((p >= lo - pad) & (p <= hi + pad)))
            at, box = np.nonzero(inside & (enter <= leave))
            rows = boxes.items[box]
            p, v = [n[at][:, None] for n in q], [n[at][:, None] for n in d]
            e, f, s = [n[rows] for n in e1], [n[rows] for n in e2], [m - n[rows] for m, n in zip(p, a)]
            h, r = g.cross(v, f), g.cross(s, e)
            det = g.dot(e, h)
            det = np.where(det != 0.0, det, np.nan)
            u, w, t = g.dot(s, h) / det, g.dot(v, r) / det, g.dot(f, r) / det
            i, j = np.nonzero((u >= 0.0) & (w >= 0.0) & (u + w <= 1.0) & (t >= 0.0) & (t < limit))
            pick = _least(at[i], t[i, j], ids[rows[i, j]])
            at, first, t = at[i][pick], ids[rows[i, j]][pick], t[i, j][pick]
            found.append((at + k, first, t, *[p[at] + v[at] * t for p, v in zip(q, d)]))
    return tuple(map(np.concatenate, zip(*found)))


def axis_check(landmarks: DataFrame, tri: DataFrame, vertices: DataFrame) -> DataFrame:
    """Median landmark-to-surface distance over the box diagonal, as given and with X, Y negated."""
    marks = landmarks.select(F.col("specimen_id").alias("mesh_id"), "ord", "x", "y", "z")
    both = marks.select("mesh_id", F.explode(F.array(
        F.struct((F.col("ord") * 2).alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")),
        F.struct((F.col("ord") * 2 + 1).alias("query_id"), (-F.col("x")).alias("qx"), (-F.col("y")).alias("qy"), F.col("z").alias("qz")),
    )).alias("s")).select("mesh_id", "s.*")
    dist = nearest_on_surface(both, tri).withColumn("d", F.sqrt("d2"))
    med = dist.groupBy("mesh_id").agg(
        F.percentile(F.when(F.col("query_id") % 2 == 0, F.col("d")), 0.5).alias("as_given"),
        F.percentile(F.when(F.col("query_id") % 2 == 1, F.col("d")), 0.5).alias("flipped"),
    )
    spans = [F.max(n) - F.min(n) for n in "xyz"]
    size = vertices.groupBy("mesh_id").agg(F.greatest(F.sqrt(_sum_squares(spans)), F.lit(1e-9)).alias("diagonal"))
    return med.join(size, "mesh_id").select(
        F.col("mesh_id").alias("specimen_id"), (F.col("as_given") / F.col("diagonal")).alias("as_given"),
        (F.col("flipped") / F.col("diagonal")).alias("flipped"),
    )
