"""Face graphs: adjacency, components, shortest paths, sampling and diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfpop.operators import mesh as m
from surfpop.operators import sampling
from surfpop.session import cut, shuffled, spread_join


def face_edges(faces: DataFrame) -> DataFrame:
    """One row per side of a face: (mesh_id, face_id, lo, hi), lo < hi."""
    sides = F.array(*[
        F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"))
        for p, q in (("a", "b"), ("b", "c"), ("c", "a"))
    ])
    return faces.select("mesh_id", "face_id", F.explode(sides).alias("e")).select(
        "mesh_id", "face_id", "e.lo", "e.hi"
    )


def adjacency(faces: DataFrame) -> DataFrame:
    """Directed neighbour pairs (mesh_id, face_id, nbr_id) over shared sides.

    Where more than two faces meet on a side, each is a neighbour of each other one;
    the pairs are the result asked for, so an equi-join on the side makes them.
    """
    sides = face_edges(faces)
    other = sides.withColumnRenamed("face_id", "nbr_id")
    return (
        sides.join(shuffled(other), ["mesh_id", "lo", "hi"])
        .filter(F.col("face_id") != F.col("nbr_id"))
        .select("mesh_id", "face_id", "nbr_id").distinct()
    )


def components(faces: DataFrame, links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(mesh_id, face_id, component): the smallest face id reachable through shared links.

    ``links`` holds (mesh_id, face_id, link): faces with the same link are connected.
    Labels travel face -> link -> face, so a link shared by very many faces costs its
    size, never its square. Each round also follows the label's own label, which
    makes the number of rounds logarithmic in the length of a strip of faces.
    """
    links = cut(links.select("mesh_id", "face_id", "link"))
    labels = cut(faces.select("mesh_id", "face_id", F.col("face_id").alias("component")))
    for _ in range(max_rounds):
        by_link = (
            links.join(shuffled(labels), ["mesh_id", "face_id"])
            .groupBy("mesh_id", "link").agg(F.min("component").alias("low"))
        )
        near = links.join(shuffled(by_link), ["mesh_id", "link"]).groupBy("mesh_id", "face_id").agg(F.min("low").alias("low"))
        hooked = cut(
            labels.join(shuffled(near), ["mesh_id", "face_id"], "left").select(
                "mesh_id", "face_id", F.col("component").alias("old"),
                F.least("component", F.coalesce("low", "component")).alias("component"),
            )
        )
        # The label of a label. Late rounds have few labels with very many faces each, so only
        # labels in use are looked up and a crowded label is split over several tasks.
        used = hooked.select("mesh_id", "component").distinct()
        roots = hooked.select("mesh_id", F.col("face_id").alias("component"), F.col("component").alias("root")).join(
            used, ["mesh_id", "component"], "left_semi"
        )
        jumped = spread_join(hooked, roots, ["mesh_id", "component"], ["face_id"], salts=8).select(
            "mesh_id", "face_id", "old", F.col("root").alias("component")
        )
        labels = cut(jumped)
        if labels.filter("old <> component").isEmpty():
            return labels.drop("old")
        labels = labels.drop("old")
    raise RuntimeError("Connected components did not settle.")


def edge_links(faces: DataFrame) -> DataFrame:
    """Links for ``components``: two faces touch when they share a side."""
    return face_edges(faces).select("mesh_id", "face_id", F.struct("lo", "hi").alias("link"))


def component_seeds(measures: DataFrame, comp: DataFrame) -> DataFrame:
    """Largest face of each component; the smaller id wins a tie."""
    return measures.join(shuffled(comp), ["mesh_id", "face_id"]).groupBy("mesh_id", "component").agg(
        F.max(F.struct(F.col("area"), (-F.col("face_id")).alias("neg"))).alias("best")
    ).select("mesh_id", "component", (-F.col("best.neg")).alias("face_id"))


def weighted_adjacency(adj: DataFrame, measures: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adjacency with centre distances, floored at 1e-12 of the mesh diagonal."""
    box = m.bounding_box(vertices).select("mesh_id", "diagonal")
    here = measures.select("mesh_id", "face_id", "cx", "cy", "cz")
    there = here.select("mesh_id", F.col("face_id").alias("nbr_id"), *[F.col(f"c{n}").alias(f"d{n}") for n in "xyz"])
    length = F.sqrt(sum((F.col(f"c{n}") - F.col(f"d{n}")) * (F.col(f"c{n}") - F.col(f"d{n}")) for n in "xyz"))
    return (
        spread_join(adj.join(shuffled(here), ["mesh_id", "face_id"]).join(shuffled(there), ["mesh_id", "nbr_id"]), box, ["mesh_id"], ["face_id"])
        .select("mesh_id", "face_id", "nbr_id", F.greatest(length, F.col("diagonal") * 1e-12).alias("w"))
    )


def shortcuts(edges: DataFrame, doublings: int = 2, max_degree: int = 16) -> DataFrame:
    """Edges plus the shortest ways over up to 2**doublings edges.

    Distances stay exact and relaxing needs that many times fewer rounds. A face has
    three sides, so this stays small; a mesh whose faces crowd on one side keeps its
    plain edges, whatever meshes stand beside it.
    """
    crowded = cut(edges.groupBy("mesh_id", "face_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_degree).select("mesh_id").distinct())
    edges = edges.select("mesh_id", "face_id", "nbr_id", "w")
    plain = edges.join(crowded, ["mesh_id"], "left_semi")
    out = edges.join(crowded, ["mesh_id"], "left_anti")
    for _ in range(doublings):
        far = out.select("mesh_id", F.col("nbr_id").alias("_mid"), "face_id", "w").join(
            shuffled(out.select("mesh_id", F.col("face_id").alias("_mid"), "nbr_id", F.col("w").alias("w2"))), ["mesh_id", "_mid"]
        ).filter(F.col("face_id") != F.col("nbr_id")).select("mesh_id", "face_id", "nbr_id", (F.col("w") + F.col("w2")).alias("w"))
        out = cut(out.unionByName(far).groupBy("mesh_id", "face_id", "nbr_id").agg(F.min("w").alias("w")))
    return out.unionByName(plain)


def nearest_sample(measures: DataFrame, edges: DataFrame, seeds: DataFrame, patch: int = sampling.PATCH) -> DataFrame:
    """Owner and graph distance of every reachable face from seeds(mesh_id, face_id, sample_id).

    A patch of faces is searched in one step, so the rounds count the patches that a way crosses, not its faces (see ``sampling``).
    """
    return sampling.owners_of(sampling.nearest(sampling.patches(measures, edges, patch), seeds))


def sample_faces(measures: DataFrame, edges: DataFrame, comp: DataFrame, count: int,
                 patch: int = sampling.PATCH) -> tuple[DataFrame, DataFrame]:
    """Farthest-point samples of every mesh: samples(mesh_id, sample_id, face_id) and owners.

    Every component gets its largest face first, then the farthest face follows again and
    again: the exact greedy order, found many samples at a time (see ``sampling``).
    Owners are (mesh_id, face_id, dist, sample_id), the earlier sample keeping ties.
    """
    seeds = component_seeds(measures, comp)
    first = Window.partitionBy("mesh_id").orderBy("component")
    chosen = cut(
        seeds.select("mesh_id", "face_id", (F.row_number().over(first) - 1).cast("bigint").alias("sample_id"))
    )
    crowded = chosen.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > count)
    if not crowded.isEmpty():
        raise ValueError("Fewer samples than disconnected components.")
    state = sampling.patches(measures, edges, patch)
    samples = cut(sampling.farthest_faces(state, chosen, count))
    return samples, cut(sampling.owners_of(sampling.nearest(state, samples)))


def smooth(colors: DataFrame, measures: DataFrame, adj: DataFrame, steps: int,
           sample_ids: DataFrame | None = None) -> DataFrame:
    """Area-weighted averaging of face colours over each face and its neighbours.

    ``colors(specimen_id, face_id, r, g, b, valid)`` over one shared mesh. Invalid faces
    give nothing and stay invalid with a zero colour. Every pass reads the colours of
    the pass before. With ``sample_ids(face_id)`` the last pass only works for those.
    """
    out = colors.select("specimen_id", "face_id", "valid", *[
        F.when(F.col("valid"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in "rgb"
    ])
    if steps:
        out = cut(out)  # read twice per pass
        area = measures.select("face_id", "area")
        itself = area.select("face_id", F.col("face_id").alias("nbr_id"))
        links = cut(
            adj.select("face_id", "nbr_id").unionByName(itself)
            .join(area.withColumnRenamed("face_id", "nbr_id"), "nbr_id")
        )
    for step in range(steps):
        wanted = links
        if step == steps - 1 and sample_ids is not None:
            wanted = links.join(sample_ids.select("face_id"), "face_id", "left_semi")
        spread = (
            out.filter("valid").withColumnRenamed("face_id", "nbr_id").join(wanted, "nbr_id")
            .groupBy("specimen_id", "face_id")
            .agg(*[(F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(f"n{c}") for c in "rgb"])
        )
        targets = out.select("specimen_id", "face_id", "valid")
        if step == steps - 1 and sample_ids is not None:
            targets = targets.join(sample_ids.select("face_id"), "face_id", "left_semi")
        out = targets.join(shuffled(spread), ["specimen_id", "face_id"], "left").select(
            "specimen_id", "face_id", "valid",
            *[F.when(F.col("valid"), F.col(f"n{c}")).otherwise(F.lit(0.0)).alias(c) for c in "rgb"],
        )
        if step != steps - 1:
            out = cut(out)
    if steps == 0 and sample_ids is not None:
        out = out.join(sample_ids.select("face_id"), "face_id", "left_semi")
    return out
