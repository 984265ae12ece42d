"""Colour clusters per specimen and their matching across the population."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfpop.functions import color as col
from surfpop.operators import checks
from surfpop.session import cut, shuffled, spread_join, wide_parts

MAX_CLUSTERS = 64
BLOCK = 16384  # distinct colours handled by one task step
MAX_ITER = 300
TOL = 1e-4
STEP = 1 << 16  # distances taken at once


# ---------------------------------------------------------------- k-means


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label, d = _nearest_of_runs(x, centres[None])
    return label[0], d[0]


def _nearest_of_runs(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each colour's nearest centre and squared distance to it, for the centres (run, cluster, axis) of every run."""
    runs, k, _ = centres.shape
    label, best = np.empty((runs, len(x)), np.int64), np.empty((runs, len(x)))
    step = max(1, STEP // (runs * k))
    for at in range(0, len(x), step):
        part, d = slice(at, at + step), None
        for c in range(3):
            gap = x[None, None, part, c] - centres[:, :, c, None]
            gap *= gap
            d = gap if d is None else np.add(d, gap, out=d)
        low, first = best[:, part], label[:, part]
        low[:], first[:] = d[:, 0], 0
        for j in range(1, k):  # the first of equally near centres stays
            first[d[:, j] < low] = j
            np.minimum(low, d[:, j], out=low)
    return label, best


def _sums_of_runs(x: np.ndarray, w: np.ndarray, centres: np.ndarray):
    """Weighted counts and colour sums per run and cluster; each run's labels (run * k + cluster) and squared distances."""
    runs, k, _ = centres.shape
    label, d = _nearest_of_runs(x, centres)
    label += (np.arange(runs) * k)[:, None]
    flat, weights = label.ravel(), [w, *(w * x[:, c] for c in range(3))]
    count, *total = (np.bincount(flat, np.tile(v, runs), runs * k).reshape(runs, k) for v in weights)
    return count, np.stack(total, axis=2), flat, d


def _inertia(w: np.ndarray, flat: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(flat, (w * d).ravel(), len(d) * k).reshape(len(d), k)


def _settle_runs(x: np.ndarray, w: np.ndarray, k: int, salts: list[list[int]], limit: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Lloyd rounds of all runs of one specimen side by side: (centres, inertia) per run."""
    runs = len(salts)
    centres, d = np.empty((runs, k, 3)), np.ones((runs, len(x)))
    for step in range(k):
        place = _draw_of_runs(x, w * d, [s[step] for s in salts])[1]
        centres[:, step] = x[place]
        near = _nearest_of_runs(x, centres[:, step:step + 1])[1]
        d = np.minimum(d, near) if step else near
    live = np.arange(runs)
    for _ in range(max_iter):
        count, total, _, d = _sums_of_runs(x, w, centres[live])
        new = total / np.maximum(count, 1e-300)[:, :, None]
        full = (count > 0).all(axis=1)
        for r in np.flatnonzero(~full):
            new[r] = _move(centres[live[r]], count[r], total[r], x[_farthest(x, d[r], int((count[r] == 0).sum()))])
        done = full & (((new - centres[live]) ** 2).reshape(len(live), -1).sum(axis=1) <= limit)
        centres[live[~done]] = new[~done]
        live = live[~done]
        if not len(live):
            break
    _, _, flat, d = _sums_of_runs(x, w, centres)
    return centres, _inertia(w, flat, d, k).sum(axis=1)


def _sums(x: np.ndarray, w: np.ndarray, centres: np.ndarray):
    """Weighted counts, colour sums and inertia per cluster; each colour's squared distance."""
    count, total, flat, d = _sums_of_runs(x, w, centres[None])
    return count[0], total[0], _inertia(w, flat, d, len(centres))[0], d[0]


def _farthest(x: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` colours farthest from their centres, farthest first."""
    return np.lexsort((x[:, 2], x[:, 1], x[:, 0], -d))[:n]


def _move(centres: np.ndarray, count: np.ndarray, total: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """New centres; an emptied cluster takes its seat at one of the ``spare`` colours."""
    new = total / np.maximum(count, 1e-300)[:, None]
    empty = np.flatnonzero(count == 0)
    new[empty] = spare[:len(empty)]
    return new


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _draw(x: np.ndarray, weight: np.ndarray, salt: int) -> tuple[float, int]:
    """A race that each colour wins with a chance in proportion to its weight: (time, place) of the winner.

    A colour's time is exponential with its weight as rate, from a hash of the colour and the salt, so
    the winner is the same however the colours are dealt over tasks.
    """
    times, places = _draw_of_runs(x, weight[None], [salt])
    return float(times[0]), int(places[0])


def _draw_of_runs(x: np.ndarray, weight: np.ndarray, salts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``_draw`` for the weights and the salt of every run."""
    h = np.array([salt & 0xFFFFFFFFFFFFFFFF for salt in salts], np.uint64)[:, None]
    for c in range(3):
        h = _mix(h + np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(x[:, c] + 0.0).view(np.uint64))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    with np.errstate(divide="ignore"):
        times = np.where(weight > 0, -np.log(u) / weight, np.inf)
    places = times.argmin(axis=1)
    return times[np.arange(len(times)), places], places


def _salt(specimen, seed: int, run: int, step: int) -> int:
    return (zlib.crc32(repr(specimen).encode()) << 32) ^ (seed << 24) ^ (run << 12) ^ step


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest centre; 1 where there is none yet."""
    return _nearest(x, centres)[1] if len(centres) else np.ones(len(x))


def kmeans_by(lab: DataFrame, k: int, n_init: int = 10, seed: int = 0, block: int = BLOCK,
              max_iter: int = MAX_ITER, tol: float = TOL) -> DataFrame:
    """K-means of every specimen's colours in one job: (specimen_id, L, a, b, label).

    Equal colours are folded to one weighted row first. Starts are drawn one after another, a colour's chance in
    proportion to its weight and its squared distance to the starts before it; the run with the least inertia wins. A
    cluster that loses all its colours takes its seat at the colour farthest from its centre. A specimen
    whose distinct colours fit one block runs its rounds inside one task step; a larger
    one is spread over blocks and each round is one Spark aggregate. Both ways take the
    same steps. A run ends at centres that every cluster has colours at.
    """
    if not 1 <= k <= MAX_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MAX_CLUSTERS}.")
    kind = lab.schema["specimen_id"].dataType.simpleString()
    folded = cut(lab.groupBy("specimen_id", "L", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))
    size = folded.groupBy("specimen_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m{c}") for c in ("L", "a", "b")],
        *[(F.sum(F.col(c) * F.col(c) * F.col("w")) / F.sum("w")).alias(f"q{c}") for c in ("L", "a", "b")],
    ).select("specimen_id", "n", (sum(F.col(f"q{c}") - F.col(f"m{c}") * F.col(f"m{c}") for c in ("L", "a", "b")) / 3.0).alias("var"))
    size = cut(size)
    checks.require_none(size.filter(F.col("n") < k), "Fewer distinct colours than clusters.")

    pieces = F.ceil(F.col("n") / float(block)).cast("int")
    placed = spread_join(folded, size.select("specimen_id", pieces.alias("pieces")), ["specimen_id"], ["L", "a", "b"])
    blocks = cut(
        placed.withColumn("piece", F.pmod(F.xxhash64("L", "a", "b"), F.col("pieces")).cast("int"))
        .groupBy("specimen_id", "pieces", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("L", "a", "b", "w"))).alias("s"))
        .select("specimen_id", "pieces", "piece",
                F.flatten(F.transform("s", lambda s: F.array(s["L"], s["a"], s["b"], s["w"]))).alias("x"))
    )
    limits = cut(size.select("specimen_id", (F.col("var") * tol).alias("limit")))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, flat, limit in zip(b["specimen_id"], b["x"], b["limit"]):
                rows = np.asarray(flat).reshape(-1, 4)
                x, w = np.ascontiguousarray(rows[:, :3]), rows[:, 3]
                salts = [[_salt(sid, seed, run, step) for step in range(k)] for run in range(n_init)]
                found = _settle_runs(x, w, k, salts, limit, max_iter)
                out += [(sid, run, centres.ravel().tolist(), float(inertia)) for run, (centres, inertia) in enumerate(zip(*found))]
            yield pd.DataFrame(out, columns=["specimen_id", "run", "c", "inertia"])

    run_schema = f"specimen_id {kind}, run int, c array<double>, inertia double"
    # Thousands of operations a colour: dealt by count, for a scan deals small files by their bytes.
    single = blocks.filter("pieces = 1").repartition(wide_parts(lab.sparkSession), "specimen_id")
    whole = single.join(limits, "specimen_id").mapInPandas(settle, run_schema)
    split = blocks.filter("pieces > 1")
    if not split.isEmpty():
        whole = whole.unionByName(_settle_split(split, limits, k, n_init, max_iter, seed, kind))
    # Hundredths of rounding must not decide between runs that found the same clusters.
    best = cut(
        cut(whole).groupBy("specimen_id").agg(F.min_by("c", F.struct(F.round("inertia", 6), F.col("run"))).alias("c"))
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, flat, c in zip(b["specimen_id"], b["x"], b["c"]):
                x = np.asarray(flat).reshape(-1, 4)[:, :3]
                label = _nearest(x, np.asarray(c).reshape(k, 3))[0]
                yield pd.DataFrame({"specimen_id": [sid] * len(x), "L": x[:, 0], "a": x[:, 1], "b": x[:, 2], "label": label})

    return blocks.join(best, "specimen_id").mapInPandas(
        assign, f"specimen_id {kind}, L double, a double, b double, label bigint"
    )


def _settle_split(blocks, limits, k, n_init, max_iter, seed, kind) -> DataFrame:
    """Starts and Lloyd rounds for specimens spread over several blocks; one aggregate per start and per round."""
    state = cut(
        limits.join(blocks.select("specimen_id").distinct(), "specimen_id")
        .withColumn("c", F.array_repeat(F.array().cast("array<double>"), n_init))
        .withColumn("done", F.array_repeat(F.lit(False), n_init))
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, flat, c in zip(b["specimen_id"], b["x"], b["c"]):
                rows = np.asarray(flat).reshape(-1, 4)
                x = np.ascontiguousarray(rows[:, :3])
                for run in range(n_init):
                    centres = np.asarray(c[run], np.float64).reshape(-1, 3)
                    time, place = _draw(x, rows[:, 3] * _apart(x, centres), _salt(sid, seed, run, len(centres)))
                    out.append((sid, run, time, *x[place].tolist()))
            yield pd.DataFrame(out, columns=["specimen_id", "run", "time", "L", "a", "b"])

    for _ in range(k):
        won = (
            blocks.join(state.select("specimen_id", "c"), "specimen_id")
            .mapInPandas(draw, f"specimen_id {kind}, run int, time double, L double, a double, b double")
            .groupBy("specimen_id", "run").agg(F.min(F.struct("time", "L", "a", "b")).alias("s"))
            .groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("run", "s"))).alias("won"))
        )
        state = cut(state.join(won, "specimen_id").select("specimen_id", "limit", F.zip_with(
            "c", "won", lambda c, s: F.concat(c, F.array(s["s"]["L"], s["s"]["a"], s["s"]["b"]))).alias("c"), "done"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["run", "label", "far", "n", "sl", "sa", "sb", "e"]
        for b in batches:
            for sid, flat, c, done in zip(b["specimen_id"], b["x"], b["c"], b["done"]):
                rows = np.asarray(flat).reshape(-1, 4)
                parts = []
                for run in range(n_init):
                    if not done[run]:
                        count, total, inertia, d = _sums(rows[:, :3], rows[:, 3], np.asarray(c[run]).reshape(k, 3))
                        parts.append(pd.DataFrame({"run": run, "label": np.arange(k), "far": 0.0, "n": count, "sl": total[:, 0],
                                                   "sa": total[:, 1], "sb": total[:, 2], "e": inertia}))
                        # A cluster that is empty everywhere is empty here, so these are seats enough.
                        spare = _farthest(rows[:, :3], d, int((count == 0).sum())) if (count == 0).any() else np.zeros(0, int)
                        parts.append(pd.DataFrame({"run": run, "label": -1 - np.arange(len(spare)), "far": d[spare], "n": 0.0, "sl": rows[spare, 0],
                                                   "sa": rows[spare, 1], "sb": rows[spare, 2], "e": 0.0}))
                if parts:
                    yield pd.concat(parts).assign(specimen_id=sid)[["specimen_id", *names]]

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, c, limit, done, rows, far in zip(b["specimen_id"], b["c"], b["limit"], b["done"], b["s"], b["far"]):
                centres, flags = [np.array(x).reshape(k, 3) for x in c], list(done)
                table = np.array([[r["run"], r["label"], r["n"], r["sl"], r["sa"], r["sb"]] for r in rows])
                seats = np.array([[r["run"], r["far"], r["sl"], r["sa"], r["sb"]] for r in ([] if far is None else far)]).reshape(-1, 5)
                for run in range(n_init):
                    if not flags[run]:
                        mine = table[table[:, 0] == run]
                        mine = mine[np.argsort(mine[:, 1])]
                        spare = seats[seats[:, 0] == run]
                        new = _move(centres[run], mine[:, 2], mine[:, 3:], spare[_farthest(spare[:, 2:], spare[:, 1], k), 2:])
                        flags[run] = bool((mine[:, 2] > 0).all() and ((new - centres[run]) ** 2).sum() <= limit)
                        centres[run] = centres[run] if flags[run] else new
                out.append((sid, [x.ravel().tolist() for x in centres], limit, flags))
            yield pd.DataFrame(out, columns=["specimen_id", "c", "limit", "done"])

    sum_schema = f"specimen_id {kind}, run int, label int, far double, n double, sl double, sa double, sb double, e double"
    measures = [F.sum(c).alias(c) for c in ("n", "sl", "sa", "sb")]
    for _ in range(max_iter):
        told = cut(blocks.join(state, "specimen_id").mapInPandas(sums, sum_schema))
        table = (
            told.filter("label >= 0").groupBy("specimen_id", "run", "label").agg(*measures)
            .groupBy("specimen_id").agg(F.collect_list(F.struct("run", "label", "n", "sl", "sa", "sb")).alias("s"))
        )
        far = told.filter("label < 0").groupBy("specimen_id").agg(F.collect_list(F.struct("run", "far", "sl", "sa", "sb")).alias("far"))
        state = cut(state.join(table, "specimen_id").join(far, "specimen_id", "left").mapInPandas(
            update, f"specimen_id {kind}, c array<array<double>>, limit double, done array<boolean>"
        ).unionByName(state.filter(~F.exists("done", lambda d: ~d))))
        if state.filter(F.exists("done", lambda d: ~d)).isEmpty():
            break
    last = state.withColumn("done", F.array_repeat(F.lit(False), n_init))
    inertia = blocks.join(last, "specimen_id").mapInPandas(sums, sum_schema).groupBy("specimen_id", "run").agg(F.sum("e").alias("inertia"))
    return inertia.join(state, "specimen_id").select("specimen_id", "run", F.get("c", F.col("run")).alias("c"), "inertia")


def consolidate(centres: DataFrame, k: int) -> DataFrame:
    """Merge initial clusters to k by average linkage: (specimen_id, label, merged).

    At most 64 centres per specimen meet in one group.
    """
    kind = centres.schema["specimen_id"].dataType.simpleString()
    if k == 1:
        return centres.select("specimen_id", "label", F.lit(0).cast("bigint").alias("merged"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        x = pdf[["L", "a", "b"]].to_numpy()
        apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        groups, gaps = [[i] for i in range(len(x))], apart.copy()
        gaps[np.tril_indices(len(x))] = np.inf
        while len(groups) > k:
            i, j = divmod(int(gaps.argmin()), len(groups))  # the first of equal gaps
            groups[i] += groups.pop(j)
            gaps = np.delete(np.delete(gaps, j, axis=0), j, axis=1)
            for o in range(len(groups)):
                if o != i:
                    lo, hi = min(i, o), max(i, o)
                    gaps[lo, hi] = apart[np.ix_(groups[lo], groups[hi])].mean()
        merged = np.empty(len(x), dtype=np.int64)
        for index, members in enumerate(sorted(groups, key=min)):
            merged[members] = index
        return pd.DataFrame({"specimen_id": pdf["specimen_id"].to_numpy(), "label": pdf["label"].to_numpy(), "merged": merged})

    dealt = centres.repartition(wide_parts(centres.sparkSession), "specimen_id")
    return dealt.groupBy("specimen_id").applyInPandas(link, f"specimen_id {kind}, label bigint, merged bigint")


def centroids(processed: DataFrame) -> DataFrame:
    """Mean Lab colour and size of every cluster from its samples."""
    return processed.filter("valid").groupBy("specimen_id", "label").agg(
        *[F.avg(c).alias(c) for c in ("L", "a", "b")], F.count(F.lit(1)).alias("n")
    )


def cluster_colors(lab: DataFrame, n_clusters: int, initial: int | None = None, seed: int = 0,
                   block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Labels (-1 on invalid samples) and recomputed centroids of every specimen."""
    first = n_clusters if initial is None else initial
    if not 1 <= n_clusters <= first:
        raise ValueError("Cluster counts must satisfy 1 <= n_clusters <= initial.")
    by_color = cut(kmeans_by(lab.filter("valid"), first, seed=seed, block=block))
    if first > n_clusters:
        weights = lab.filter("valid").groupBy("specimen_id", "L", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        parts = by_color.join(shuffled(weights), ["specimen_id", "L", "a", "b"])
        centres = parts.groupBy("specimen_id", "label").agg(
            *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("L", "a", "b")]
        )
        merged = cut(consolidate(centres, n_clusters))
        by_color = spread_join(by_color, merged, ["specimen_id", "label"], ["L", "a", "b"]).select(
            "specimen_id", "L", "a", "b", F.col("merged").alias("label")
        )
    labelled = lab.join(shuffled(by_color.withColumn("valid", F.lit(True))), ["specimen_id", "L", "a", "b", "valid"], "left").select(
        "specimen_id", "sample_id", "valid", "L", "a", "b",
        F.when(F.col("valid"), F.col("label")).otherwise(F.lit(-1).cast("bigint")).alias("label"),
    )
    labelled = cut(labelled)
    centres = cut(centroids(labelled))
    short = centres.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < n_clusters)
    checks.require_none(short, "Clustering left an empty cluster; use fewer clusters.")
    return labelled, centres


# ---------------------------------------------------------------- matching


def match_costs(centres: DataFrame, reference=None) -> DataFrame:
    """Delta E 76 of every local centroid to every reference centroid:
    (specimen_id, label, ref_label, cost). The reference has at most 64 centroids."""
    ref_rows = _reference_rows(centres, reference)[1]
    table = F.array(*[
        F.struct(F.lit(r["label"]).cast("bigint").alias("ref_label"), *[F.lit(float(r[c])).alias(f"r{c}") for c in ("L", "a", "b")])
        for r in ref_rows
    ])
    spread = centres.select("specimen_id", "label", "L", "a", "b", F.explode(table).alias("r"))
    cost = col.delta_e76(tuple(F.col(c) for c in ("L", "a", "b")), tuple(F.col(f"r.r{c}") for c in ("L", "a", "b")))
    return spread.select("specimen_id", "label", "r.ref_label", cost.alias("cost"))


def _reference_rows(centres: DataFrame, reference=None):
    if reference is None:
        reference = centres.agg(F.min("specimen_id")).first()[0]
    rows = centres.filter(F.col("specimen_id") == reference).orderBy("label").limit(MAX_CLUSTERS + 1).collect()
    if not rows:
        raise ValueError("The reference specimen has no clusters.")
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"More than {MAX_CLUSTERS} clusters.")
    return reference, rows


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the least-cost one-to-one assignment (shortest augmenting paths)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of, back = np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        slack, seen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while row_of[j]:
            seen[j] = True
            reduced = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            closer = ~seen[1:] & (reduced < slack[1:])
            slack[1:][closer] = reduced[closer]
            back[1:][closer] = j
            nxt = int(np.where(seen, np.inf, slack)[1:].argmin()) + 1
            step = slack[nxt]
            u[row_of[seen]] += step
            v[seen] -= step
            slack[~seen] -= step
            j = nxt
        while j:
            row_of[j] = row_of[back[j]]
            j = back[j]
    out = np.empty(n, dtype=int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def label_map(centres: DataFrame, reference=None) -> DataFrame:
    """(specimen_id, label, new_label): clusters matched one-to-one to the reference's."""
    reference, rows = _reference_rows(centres, reference)
    k = len(rows)
    counts = centres.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != k)
    checks.require_none(counts, "Every specimen needs the same number of clusters.")
    kind = centres.schema["specimen_id"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ref_label", "label"])
        table = pdf["cost"].to_numpy().reshape(k, k)
        # The reference keeps its own labels even where two of its centroids tie.
        own = pdf["specimen_id"].iloc[0] == reference
        picked = np.arange(k) if own else best_assignment(table)
        return pd.DataFrame({"specimen_id": [pdf["specimen_id"].iloc[0]] * k,
                             "label": pdf["label"].to_numpy()[:k][picked], "new_label": pdf["ref_label"].to_numpy()[::k]})

    costs = match_costs(centres, reference).repartition(wide_parts(centres.sparkSession), "specimen_id")
    return costs.groupBy("specimen_id").applyInPandas(
        solve, f"specimen_id {kind}, label bigint, new_label bigint"
    )


def align_clusters(centres: DataFrame, processed: DataFrame, reference=None):
    """(processed, centroids, palette) with labels that mean the same in every specimen."""
    mapping = cut(label_map(centres, reference))
    moved = spread_join(processed, mapping, ["specimen_id", "label"], ["sample_id"], how="left")
    relabelled = moved.withColumn("label", F.coalesce("new_label", F.lit(-1).cast("bigint"))).drop("new_label")
    named = centres.join(shuffled(mapping), ["specimen_id", "label"]).withColumn("label", F.col("new_label")).drop("new_label")
    return relabelled.select(*processed.columns), named, palette(named)


def palette(centres: DataFrame) -> DataFrame:
    """Common colour per label, every specimen with equal weight: (label, L, lab_a, lab_b, r, g, b)."""
    mean = centres.groupBy("label").agg(*[F.avg(c).alias(n) for c, n in (("L", "L"), ("a", "lab_a"), ("b", "lab_b"))])
    rgb = col.lab_to_srgb(F.col("L"), F.col("lab_a"), F.col("lab_b"))
    return mean.select("label", "L", "lab_a", "lab_b", *[c.alias(n) for c, n in zip(rgb, "rgb")])
