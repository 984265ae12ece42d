"""Exact k-nearest-neighbour rows in feature space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.session import cut

# Rows whose neighbours one task step holds; every row travels once to each such block that may need it.
BLOCK_ROWS = 8192
LEAST_ROWS = 2048
LEAST_BLOCKS = 8
# Distances of one step at a time.
PAIRS = 4_000_000
# Rows of a block whose distances are at hand at a time, few enough for a core's cache.
SLICE = 1024
# Candidates that are measured at a time.
MEASURED = 262_144


class Pivots:
    """About √n rows as cell centres, in two levels: a row goes to its nearest branch and to the nearest centre of that branch."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.tops = centres[: math.ceil(math.sqrt(len(centres)))]
        self.branch = _squares(centres, self.tops).argmin(axis=1)
        self.order = np.argsort(self.branch, kind="stable")

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its distance to the cell's centre."""
        top, cell = _squares(x, self.tops).argmin(axis=1), np.empty(len(x), np.int64)
        for t in np.unique(top):
            mine, own = np.flatnonzero(top == t), np.flatnonzero(self.branch == t)
            cell[mine] = own[_squares(x[mine], self.centres[own]).argmin(axis=1)]
        return cell, np.linalg.norm(x - self.centres[cell], axis=1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


class Nearest:
    """The k nearest rows so far of a block of rows, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows = k, [], []

    def hold(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(x)

    def start(self) -> None:
        self.id, self.x = np.concatenate(self.ids), np.concatenate(self.rows)
        self.best = pd.DataFrame({"q": np.zeros(0, np.int64), "dist": np.zeros(0), "nbr_id": self.id[:0]})
        self.kth = np.full(len(self.id), np.inf)
        self.square = (self.x**2).sum(1)
        # One product per distance: (x, 1) . (-2 y, y²) is the squared distance less x².
        self.left = np.hstack([self.x, np.ones((len(self.x), 1))])

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(64, PAIRS // len(self.id))
        for at in range(0, len(ids), step):
            self._meet(ids[at:at + step], x[at:at + step])

    def _meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        square = (x**2).sum(1)
        right = np.hstack([-2 * x, square[:, None]]).T
        # Everything that may tie with the k-th stays, and is then measured without cancellation.
        slack = 1e-12 * (self.square + square.max())
        limit = self.kth**2 - self.square + slack
        found = []
        for at in range(0, len(self.id), SLICE):
            part, most = self.left[at:at + SLICE] @ right, limit[at:at + SLICE]
            unsure = np.flatnonzero(np.isinf(most))
            if len(unsure) and len(ids) > self.k:
                # One of the first k + 1 may be the row itself.
                most[unsure] = np.partition(part[unsure], self.k, axis=1)[:, self.k] + slack[at + unsure]
            found.append(np.flatnonzero(part <= most[:, None]) + at * len(ids))
        q, r = np.divmod(np.concatenate(found), len(ids))
        for at in range(0, len(q), MEASURED):
            self._keep(q[at:at + MEASURED], ids, x, r[at:at + MEASURED])

    def _keep(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray, r: np.ndarray) -> None:
        other = self.id[q] != ids[r]
        q, r = q[other], r[other]
        dist = np.sqrt(((self.x[q] - x[r]) ** 2).sum(axis=1))
        near = dist <= self.kth[q]
        if not near.any():
            return
        fresh = pd.DataFrame({"q": q[near], "dist": dist[near], "nbr_id": ids[r[near]]})
        # Only the rows that found someone are ranked again.
        hit = np.zeros(len(self.id), bool)
        hit[fresh["q"]] = True
        again = hit[self.best["q"].to_numpy()]
        now = pd.concat([self.best[again], fresh]).sort_values(["q", "dist", "nbr_id"], kind="stable").groupby("q").head(self.k)
        nth = now.groupby("q").cumcount().to_numpy() == self.k - 1
        self.kth[now["q"].to_numpy()[nth]] = now["dist"].to_numpy()[nth]
        self.best = pd.concat([self.best[~again], now], ignore_index=True)

    def result(self) -> pd.DataFrame:
        self.best = self.best.sort_values(["q", "dist", "nbr_id"], kind="stable")
        return pd.DataFrame({"specimen_id": self.id[self.best["q"]], "rank": self.best.groupby("q").cumcount().to_numpy() + 1,
                             "nbr_id": self.best["nbr_id"].to_numpy(), "dist": self.best["dist"].to_numpy()})


def knn_graph(features: DataFrame, k: int | None = None, pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other specimens by Euclidean distance: (specimen_id, rank, nbr_id, dist).

    Default k = min(15, n - 1). Rows go to the cells of about √n pivots; cells that lie together make blocks of bounded size, a crowded
    cell several. A block meets the rows of a cell only if the triangle inequality leaves room for a neighbour in it. They
    come to it one after another, and the block's k nearest so far are all it keeps, so a row is shuffled
    once per block that needs it and nothing is ranked afterwards. Equal distances go to the smaller id.
    """
    kind = features.schema["specimen_id"].dataType.simpleString()
    packed = cut(features.groupBy("specimen_id").agg(
        F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("s")
    ).select("specimen_id", F.transform("s", lambda s: s["value"]).alias("x")))
    n = packed.count()
    k = min(15, n - 1) if k is None else k
    if not 1 <= k < n:
        raise ValueError("k must be at least 1 and below the number of specimens.")
    picked = packed.orderBy(F.xxhash64("specimen_id"), "specimen_id").limit(pivots or math.ceil(math.sqrt(n))).collect()
    tree = Pivots(np.array([r["x"] for r in picked]))

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, far = tree.cells(np.stack(b["x"].to_numpy()))
                yield pd.DataFrame({"specimen_id": b["specimen_id"], "x": b["x"], "cell": cell, "far": far})

    celled = cut(packed.mapInPandas(to_cell, f"specimen_id {kind}, x array<double>, cell bigint, far double"))
    shape = {r["cell"]: (r["n"], r["far"]) for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    cells = np.array([c for c in tree.order if c in shape])  # at most one per pivot, branch by branch
    count, radius = np.array([shape[c][0] for c in cells]), np.array([shape[c][1] for c in cells]) * (1 + 1e-9)
    size = min(block_rows, max(LEAST_ROWS, -(-n // LEAST_BLOCKS)))
    first = (np.cumsum(count) - count) // size
    last = (np.cumsum(count) - 1) // size
    centres = tree.centres[cells]

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = set()
            for i in b["i"]:
                apart = np.sqrt(_squares(centres[i:i + 1], centres)[0])
                # For any row of the cell, at least k others lie within reach.
                worst = apart + radius[i] + radius
                order = np.argsort(worst, kind="stable")
                reach = worst[order][np.searchsorted(np.cumsum(count[order]), k + 1)]
                near = cells[apart - radius[i] - radius <= reach * (1 + 1e-9) + 1e-9 * apart.max()]
                out |= {(block, int(c)) for block in range(first[i], last[i] + 1) for c in near}
            yield pd.DataFrame(sorted(out), columns=["block", "cell"])

    spark = packed.sparkSession
    of_cell = spark.createDataFrame([(int(c), int(a), int(z)) for c, a, z in zip(cells, first, last)], "cell bigint, first bigint, last bigint")
    open_cells = spark.range(len(cells)).withColumnRenamed("id", "i").mapInPandas(visits, "block bigint, cell bigint").distinct()
    held = celled.join(F.broadcast(of_cell), "cell").select(  # at most one row per pivot
        (F.col("first") + F.pmod(F.xxhash64("specimen_id"), F.col("last") - F.col("first") + 1)).alias("block"), F.lit(0).alias("turn"), "specimen_id", "x")
    come = celled.join(open_cells, "cell").select("block", F.lit(1).alias("turn"), "specimen_id", "x")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, now, started = None, None, False
        for b in batches:
            for (own, turn), rows in b.groupby(["block", "turn"], sort=True):
                if own != block:
                    if now is not None and started:
                        yield now.result()
                    block, now, started = own, Nearest(k), False
                ids, x = rows["specimen_id"].to_numpy(), np.stack(rows["x"].to_numpy())
                if turn == 0:
                    now.hold(ids, x)
                elif now.ids:
                    if not started:
                        now.start()
                        started = True
                    now.meet(ids, x)
        if now is not None and started:
            yield now.result()

    blocks = int(last.max()) + 1
    return held.unionByName(come).repartition(4 * blocks, "block").sortWithinPartitions("block", "turn").mapInPandas(
        stream, f"specimen_id {kind}, rank bigint, nbr_id {kind}, dist double")
