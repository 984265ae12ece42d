"""Farthest-face samples in exact greedy order, many at a time.

A mesh is cut into patches of at most ``PATCH`` faces along a Morton curve. Work inside a patch is a plain shortest-path search in
one task step; paths that leave a patch go on as messages, so a search takes as many Spark rounds as it crosses patches, and no
task ever holds a mesh that is larger than a patch.

The greedy order adds the face farthest from all samples, again and again (ties: the smaller id). A face ``c`` at distance D will be added
at that very distance if no face that comes before it lies nearer to it than D: whatever is added before ``c`` is itself at D or more when it is
added, so it is one of those faces, and none of them brings ``c`` nearer. All such faces are added in one round. Each
sends a search over the ball of radius D around itself; the search fails when it meets a face that comes before, and otherwise has
the distances that ``c`` brings to its ball, beyond which it can change nothing that is still to be added after it. Sorted by the distance at which
they were added, the samples are in greedy order; a round's first samples are settled once they lie farther out than every face that is left.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfpop.operators.spatial import morton
from surfpop.session import by_row, cut, number_rows, shuffled, spread_join

PATCH = 32768
MAX_ROUNDS = 10000
PEAKS = 0.35
# A ball reaches a little over its radius, so that rounding of opposite ways never hides a face that comes before.
REACH = 1.0 + 1e-9
INF = float("inf")


class Patch:
    """Faces with their ways inside the patch and out of it, their distances and owners, and the searches under way."""

    def __init__(self, faces: list[int], edges: Iterable[tuple[int, int, int, float]]):
        self.faces = sorted(faces)
        self.at = {f: i for i, f in enumerate(self.faces)}
        self.ways = [[] for _ in self.faces]
        self.exits = [[] for _ in self.faces]
        for face, nbr, nbr_patch, w in edges:
            i, j = self.at[face], self.at.get(nbr)
            if j is None:
                self.exits[i].append((nbr, nbr_patch, w))
            else:
                self.ways[i].append((j, w))
        self.dist = [INF] * len(self.faces)
        self.owner = [-1] * len(self.faces)
        self.seen: dict[int, dict[int, float]] = {}

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def load(cls, data: bytes) -> Patch:
        patch = cls.__new__(cls)
        patch.__dict__ = pickle.loads(data)
        return patch

    def clear(self) -> None:
        self.dist, self.owner, self.seen = [INF] * len(self.faces), [-1] * len(self.faces), {}

    def settle(self, offers: list[tuple[float, int, int]]) -> list[tuple[int, int, int, float]]:
        """Takes (distance, owner, face) offers, nearest first and smaller owner at ties; (patch, owner, face, distance) go out."""
        heap, out = [(d, o, self.at[f]) for d, o, f in offers], {}
        heapq.heapify(heap)
        while heap:
            d, o, i = heapq.heappop(heap)
            if (d, o) >= (self.dist[i], self.owner[i] if self.owner[i] >= 0 else INF):
                continue
            self.dist[i], self.owner[i] = d, o
            for j, w in self.ways[i]:
                if d + w <= self.dist[j]:
                    heapq.heappush(heap, (d + w, o, j))
            for face, patch, w in self.exits[i]:
                out[patch, face] = min(out.get((patch, face), (INF, 0)), (d + w, o))
        return [(patch, o, face, d) for (patch, face), (d, o) in out.items()]

    def before(self, i: int, d: float, face: int) -> bool:
        return self.dist[i] > d or (self.dist[i] == d and self.faces[i] < face)

    def peaks(self, least: float) -> list[tuple[int, float]]:
        """Faces from ``least`` on that come before all their neighbours in the patch."""
        found = []
        for i, (d, face) in enumerate(zip(self.dist, self.faces)):
            if d >= least and d > 0 and not any(self.before(j, d, face) for j, _ in self.ways[i]):
                found.append((face, d))
        return found

    def search(self, face: int, radius: float, offers: list[tuple[float, int]]) -> list[tuple[int, int, float]] | None:
        """Goes on with the ball of ``face``: (patch, face, distance) of the ways out, or None if a face in it comes before."""
        seen, heap, out = self.seen.setdefault(face, {}), [(d, self.at[f]) for d, f in offers], {}
        heapq.heapify(heap)
        while heap:
            d, i = heapq.heappop(heap)
            if d >= seen.get(i, INF):
                continue
            seen[i] = d
            if self.faces[i] != face and self.before(i, radius, face):
                return None
            for j, w in self.ways[i]:
                if d + w < radius * REACH and d + w < seen.get(j, INF):
                    heapq.heappush(heap, (d + w, j))
            for other, patch, w in self.exits[i]:
                if d + w < radius * REACH:
                    out[patch, other] = min(out.get((patch, other), INF), d + w)
        return [(patch, other, d) for (patch, other), d in out.items()]

    def accept(self, failed: set[int]) -> list[tuple[int, float]]:
        """Puts in what the searches that did not fail have found: (face, its distance when added) of this patch's own."""
        own = []
        for face, seen in self.seen.items():
            if face in failed:
                continue
            if face in self.at:
                own.append((face, self.dist[self.at[face]]))
            for i, d in seen.items():
                if d < self.dist[i]:
                    self.dist[i] = d
        self.seen = {}
        return own

    def farthest(self) -> tuple[float, int]:
        """Distance of the face that comes first, and the face."""
        d = max(self.dist)
        return d, self.faces[self.dist.index(d)]

    def greedy(self, count: int) -> list[tuple[int, float]]:
        """The next ``count`` samples of a mesh that is this patch alone."""
        heap, added = [(-d, f) for d, f in zip(self.dist, self.faces)], []
        heapq.heapify(heap)
        while heap and len(added) < count:
            d, face = heapq.heappop(heap)
            i = self.at[face]
            if -d != self.dist[i]:
                if self.dist[i] > 0:
                    heapq.heappush(heap, (-self.dist[i], face))
                continue
            if d == 0:
                break
            added.append((face, -d))
            front = [(0.0, i)]
            while front:
                near, i = heapq.heappop(front)
                if near >= self.dist[i]:
                    continue
                self.dist[i] = near
                for j, w in self.ways[i]:
                    if near + w < self.dist[j]:
                        heapq.heappush(front, (near + w, j))
        return added


def patches(measures: DataFrame, edges: DataFrame, size: int = PATCH) -> DataFrame:
    """(mesh_id, patch, patches, data): the faces of every mesh in packed patches of ``size`` faces that lie together."""
    box = measures.groupBy("mesh_id").agg(*[fn(f"c{n}").alias(f"{tag}{n}") for n in "xyz" for tag, fn in (("lo", F.min), ("hi", F.max))])
    unit = [(F.col(f"c{n}") - F.col(f"lo{n}")) / F.when(F.col(f"hi{n}") > F.col(f"lo{n}"), F.col(f"hi{n}") - F.col(f"lo{n}")).otherwise(1.0) for n in "xyz"]
    curve = spread_join(measures, box, ["mesh_id"], ["face_id"]).select("mesh_id", "face_id", morton(*unit, (0.0,) * 3, (1.0,) * 3).alias("_code"))
    curve = curve.withColumn("_block", F.shiftright("_code", 48))
    placed = cut(number_rows(curve, ["mesh_id"], "_block", ["_code", "face_id"], "place").select(
        "mesh_id", "face_id", F.floor(F.col("place") / size).cast("bigint").alias("patch")))
    there = placed.select("mesh_id", F.col("face_id").alias("nbr_id"), F.col("patch").alias("nbr_patch"))
    ways = edges.join(shuffled(placed), ["mesh_id", "face_id"]).join(shuffled(there), ["mesh_id", "nbr_id"]).groupBy("mesh_id", "patch").agg(
        F.collect_list(F.struct("face_id", "nbr_id", "nbr_patch", "w")).alias("_edges")
    ).select("mesh_id", "patch", *[F.col(f"_edges.{n}").alias(f"_{n}") for n in ("face_id", "nbr_id", "nbr_patch", "w")])
    held = placed.groupBy("mesh_id", "patch").agg(F.collect_list("face_id").alias("_faces"))
    total = placed.groupBy("mesh_id").agg((F.max("patch") + 1).alias("patches"))

    def pack(row: dict):
        edges = zip(*[row[n] or [] for n in ("_face_id", "_nbr_id", "_nbr_patch", "_w")])
        yield row["mesh_id"], row["patch"], row["patches"], Patch(row["_faces"], edges).dump()

    return cut(by_row(held.join(shuffled(ways), ["mesh_id", "patch"], "left").join(shuffled(total), "mesh_id"), pack,
                      "mesh_id key, patch bigint, patches bigint, data binary"))


def _run(rows: DataFrame, work) -> DataFrame:
    """``work(patch, row)`` on every patch row, giving (what, patch, name, face, d, radius) rows; the patches come back as rows ``patch``."""

    def step(row: dict):
        patch = Patch.load(row["data"])
        for what, to, name, face, d, radius in work(patch, row):
            yield row["mesh_id"], to, what, name, face, d, radius, None, None
        yield row["mesh_id"], row["patch"], "patch", None, None, None, None, patch.dump(), row["patches"]

    return cut(by_row(rows, step, "mesh_id key, patch bigint, what string, name bigint, face bigint, d double, radius double, data binary, patches bigint"))


def _state(out: DataFrame) -> DataFrame:
    return out.filter("what = 'patch'").select("mesh_id", "patch", "patches", "data")


def _exchange(out: DataFrame, work) -> Iterator[DataFrame]:
    """Hands offers to their patches and runs ``work`` until none is left: the rows of every round, these first.

    Of the offers of a search for a face the least counts; patches without offers pass.
    """
    while True:
        yield out
        offers = out.filter("what = 'offer'")
        if offers.isEmpty():
            return
        least = offers.groupBy("mesh_id", "patch", "name", "face").agg(F.min(F.struct("d", "radius")).alias("o"))
        box = least.groupBy("mesh_id", "patch").agg(F.collect_list(F.struct("name", "face", "o.d", "o.radius")).alias("inbox"))
        out = _run(_state(out).join(shuffled(box), ["mesh_id", "patch"], "left"), lambda patch, row: [] if row["inbox"] is None else work(patch, row["inbox"]))


def nearest(state: DataFrame, seeds: DataFrame) -> DataFrame:
    """Patches whose faces know the nearest of seeds(mesh_id, face_id, sample_id) and its distance; the smaller sample wins a tie."""

    def start(patch: Patch, row: dict):
        patch.clear()
        mine = row["seeds"] if row["seeds"] is not None else []
        return offers(patch, [(0.0, s["sample_id"], s["face_id"]) for s in mine if s["face_id"] in patch.at])

    def offers(patch: Patch, got: list):
        return [("offer", to, owner, face, d, None) for to, owner, face, d in patch.settle(got)]

    here = by_row(state.select("mesh_id", "patch", "data"), _faces_of, "mesh_id key, patch bigint, face_id bigint")
    mine = seeds.join(shuffled(here), ["mesh_id", "face_id"]).groupBy("mesh_id", "patch").agg(F.collect_list(F.struct("sample_id", "face_id")).alias("seeds"))
    out = _run(state.join(shuffled(mine), ["mesh_id", "patch"], "left"), start)
    for out in _exchange(out, lambda patch, inbox: offers(patch, [(m["d"], m["name"], m["face"]) for m in inbox])):
        pass
    return _state(out)


def _faces_of(row: dict) -> Iterator[tuple]:
    for face in Patch.load(row["data"]).faces:
        yield row["mesh_id"], row["patch"], face


def owners_of(state: DataFrame) -> DataFrame:
    """(mesh_id, face_id, dist, sample_id) of every face that a seed reaches."""

    def reached(row: dict):
        patch = Patch.load(row["data"])
        for face, dist, owner in zip(patch.faces, patch.dist, patch.owner):
            if owner >= 0:
                yield row["mesh_id"], face, dist, owner

    return by_row(state.select("mesh_id", "data"), reached, "mesh_id key, face_id bigint, dist double, sample_id bigint")


def _searched(patch: Patch, wanted: list) -> list[tuple]:
    out = []
    for face, radius, offers in wanted:
        ways = patch.search(face, radius, offers)
        if ways is None:
            out.append(("fail", -1, face, face, radius, radius))
        else:
            out += [("offer", to, face, other, d, radius) for to, other, d in ways]
    return out


def _turn(patch: Patch, row: dict) -> list[tuple]:
    """Ends the searches of the round before, tells what they added and what is left, and begins new ones from the peaks."""
    added = patch.accept(set() if row["failed"] is None else set(row["failed"]))
    d, face = patch.farthest()
    told = [("added", row["patch"], face, face, d, d) for face, d in added] + [("left", row["patch"], face, face, d, d)]
    return told + _searched(patch, [(face, d, [(0.0, face)]) for face, d in patch.peaks(row["least"])])


def _go_on(patch: Patch, inbox: list) -> list[tuple]:
    by_face: dict[int, tuple[float, list]] = {}
    for m in inbox:
        by_face.setdefault(m["name"], (m["radius"], []))[1].append((m["d"], m["face"]))
    return _searched(patch, [(face, radius, offers) for face, (radius, offers) in by_face.items()])


def farthest_faces(state: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """(mesh_id, sample_id, face_id): seeds(mesh_id, face_id, sample_id) and the faces added to them, up to ``count`` a mesh."""
    state = nearest(state, seeds)
    have = cut(seeds.groupBy("mesh_id").agg(F.count(F.lit(1)).cast("bigint").alias("have")))

    def alone(row: dict):
        for face, dist in Patch.load(row["data"]).greedy(count - row["have"]):
            yield row["mesh_id"], face, dist

    added = cut(by_row(state.filter("patches = 1").join(shuffled(have), "mesh_id"), alone, "mesh_id key, face_id bigint, dist double"))
    wide = state.filter("patches > 1")
    least = wide.select("mesh_id").distinct().withColumn("least", F.lit(0.0))
    failed = wide.select("mesh_id", F.array(F.lit(0).cast("bigint")).alias("failed")).limit(0)
    for _ in range(MAX_ROUNDS):
        if wide.isEmpty():
            break
        turn = _run(wide.join(least, "mesh_id").join(failed, "mesh_id", "left"), _turn)
        rounds = list(_exchange(turn, _go_on))
        added = cut(added.unionByName(turn.filter("what = 'added'").select("mesh_id", F.col("face").alias("face_id"), F.col("d").alias("dist"))))
        left = turn.filter("what = 'left'").groupBy("mesh_id").agg(F.max(F.struct("d", (-F.col("face")).alias("neg"))).alias("s"))
        first = left.select("mesh_id", F.col("s.d").alias("_d"), (-F.col("s.neg")).alias("_f"))
        settled = added.join(first, "mesh_id").filter((F.col("dist") > F.col("_d")) | ((F.col("dist") == F.col("_d")) & (F.col("face_id") < F.col("_f")))).groupBy(
            "mesh_id").agg(F.count(F.lit(1)).alias("n"))
        # The next peaks lie at PEAKS of this distance or more. It is a little old then, which delays some samples and loses none.
        least = cut(first.join(have, "mesh_id").join(settled, "mesh_id", "left").filter(
            (F.col("_d") > 0) & (F.col("have") + F.coalesce("n", F.lit(0)) < count)).select("mesh_id", (F.col("_d") * PEAKS).alias("least")))
        fails = reduce(DataFrame.unionByName, [r.filter("what = 'fail'").select("mesh_id", "name") for r in rounds])
        failed = fails.groupBy("mesh_id").agg(F.collect_set("name").alias("failed"))
        wide = _state(rounds[-1]).join(least.select("mesh_id"), "mesh_id", "left_semi")
    else:
        raise RuntimeError("Samples did not settle.")
    order = Window.partitionBy("mesh_id").orderBy(F.desc("dist"), "face_id")
    ranked = added.withColumn("_k", F.row_number().over(order)).join(shuffled(have), "mesh_id").withColumn("sample_id", F.col("have") + F.col("_k") - 1)
    return seeds.select("mesh_id", "sample_id", "face_id").unionByName(ranked.filter(F.col("sample_id") < count).select("mesh_id", "sample_id", "face_id"))
