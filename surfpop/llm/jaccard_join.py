"""N-gram Jaccard join by chosen paths.

Each text becomes a set of hashed word shingles; texts with equal sets are one set from there on. A run
starts every set at one root. At a node a set moves on along those of its shingles whose hash with the
node's path lies under ``rate`` / (threshold * size): a pair at the threshold then shares at least ``rate``
branches on average, whatever the sizes. Nodes of at most
``bucket`` sets end there; larger ones split again, unless splitting leaves more than half of the node
together (sets that are all alike) or ``levels`` is reached. Runs are repeated until a pair at the threshold
meets with probability ``recall``; pairs above it meet more often.

In an end node, sets are first held against each other by their ``SKETCH`` smallest shingle hashes: two sets at 0.8 share
at least half of the smaller sketch but for a chance below one in a million. A pair usually meets in several end
nodes; each row knows the smaller end nodes of its set, so a pair is taken up in the smallest common one alone. Only
sets with such a partner are sent on whole, to those nodes. They are compared by brute force in blocks of chunk pairs,
so a node that holds a third of all sets is many tasks. A block does not emit its pairs: it gives each set's number of
links and enough edges to keep its linked sets connected. A pair that meets in several end nodes is counted in the smallest of them.
Connected sets are one class. Work in a group of copies grows with the square of its different sets, the
rows that move with sets times chunks. Shingles are compared as 32-bit hashes.

Defined results: texts of fewer than n words have their words as one shingle; texts without words
(null, empty) are alone in their class. Rows that share an id are sets by their own texts. Class and set ids are
the smallest document id in them; a null id counts as the smallest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import BROADCAST_BYTES, NO_ID, id_of, query, stowed, table, unstowed
from surfpop.llm.decontaminate import words
from surfpop.session import cut

CHUNK = 512
COLUMNS = 4096
SKETCH = 48


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def branches(path: int, tokens: np.ndarray, share: float) -> np.ndarray:
    """Paths of the node's children that a set with these tokens enters."""
    drawn = mix(tokens.astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(path & 0xFFFFFFFFFFFFFFFF))
    taken = drawn if share >= 1 else drawn[drawn < np.uint64(int(share * 2**64))]
    return mix(taken ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def runs_for(recall: float, rate: float) -> int:
    """Runs after which a pair at the threshold has met: a run's chance to lose it is the branching's extinction."""
    lost = 0.0
    for _ in range(200):
        lost = math.exp(-rate * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(docs: DataFrame, doc_id: str, text: str, n: int, share: float, runs: int, rate: float) -> DataFrame:
    """(_doc, _row, _text, _key, _tokens, _sketch, _paths) per document: its set and the first nodes it enters."""
    def build(batches):
        powers = np.array([pow(0xD1342543DE82EF95, k, 2**64) for k in range(n)], np.uint64)
        for batch in batches:
            keys, tokens, sketches, paths = [], [], [], []
            for hashes in batch["_hs"]:
                h = np.asarray(hashes, np.int64).view(np.uint64)
                m = max(len(h) - n + 1, min(len(h), 1))
                code = np.zeros(m, np.uint64)
                for k in range(min(n, len(h))):
                    code += mix(h[k:k + m] + np.uint64(k)) * powers[k]
                grams = np.unique(mix(code))
                folded = np.unique((grams >> np.uint64(32)).astype(np.uint32)).view(np.int32)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if m else None)
                tokens.append(folded.tobytes())
                drawn = mix(folded.view(np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
                sketches.append(folded[np.argsort(drawn)[:SKETCH]].tobytes())
                paths.append(np.unique(np.concatenate([branches(r + 1, folded, rate / (share * max(len(folded), 1))) for r in range(runs)])))
            yield pd.DataFrame({"_doc": batch["_doc"], "_row": batch["_row"], "_text": batch["_text"], "_key": keys, "_tokens": tokens, "_sketch": sketches, "_paths": paths})

    hashed = docs.select(
        id_of(doc_id).alias("_doc"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text"),
        F.transform(words(F.lower(F.col(text))), lambda w: F.xxhash64(w)).alias("_hs"))
    return hashed.mapInPandas(build, "_doc long, _row long, _text long, _key string, _tokens binary, _sketch binary, _paths array<long>")


def beside(sets: DataFrame, chosen: DataFrame, width: Column) -> DataFrame:
    """The chosen sets with their shingles: rows of at most ``BROADCAST_BYTES`` go to the shingles, more meet them in a shuffle."""
    few = (chosen.agg(F.sum(width + 32)).first()[0] or 0) <= BROADCAST_BYTES
    return sets.join(F.broadcast(chosen) if few else chosen, "_set")


def children(batch: pd.DataFrame, share: float, rate: float):
    """(parent, its child paths, set) of every node that a set of the batch is in."""
    for chosen, paths, tokens in zip(batch["_set"], batch["_paths"], batch["_tokens"]):
        tokens = np.frombuffer(tokens, np.int32)
        for path in paths:
            yield int(path), branches(int(path), tokens, rate / (share * max(len(tokens), 1))), chosen


def with_paths(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(_set, _tokens, _paths) of the sets of (_path, _set) rows."""
    by_set = cut(nodes.groupBy("_set").agg(F.collect_list("_path").alias("_paths")))
    return beside(sets.select("_set", "_tokens"), by_set, F.size("_paths") * 8)


def child_sizes(nodes: DataFrame, sets: DataFrame, share: float, rate: float) -> DataFrame:
    """(_parent, _path, _n) of the children that several sets enter. A task adds up its sets, so copies of a text are one row a child."""

    def count(batches):
        for batch in batches:
            found = [np.stack([np.full(len(c), p, np.int64), c], 1) for p, c, _ in children(batch, share, rate) if len(c)]
            rows, n = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            yield pd.DataFrame({"_parent": rows[:, 0], "_path": rows[:, 1], "_n": n})

    counted = with_paths(nodes, sets).mapInPandas(count, "_parent long, _path long, _n long")
    return counted.groupBy("_parent", "_path").agg(F.sum("_n").alias("_n")).where("_n > 1")


def split_nodes(nodes: DataFrame, sets: DataFrame, share: float, rate: float) -> DataFrame:
    """(_path, _set) of the children of (_path, _set) rows."""

    def split(batches):
        for batch in batches:
            yield pd.DataFrame([(child, chosen) for _, found, chosen in children(batch, share, rate) for child in found], columns=["_path", "_set"])

    return with_paths(nodes, sets).mapInPandas(split, "_path long, _set long")


def end_nodes(start: DataFrame, sets: DataFrame, share: float, rate: float, bucket: int, levels: int) -> DataFrame:
    """(_leaf, _set, _n): end nodes with their sets and number of sets."""
    of_path = start.groupBy("_path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    nodes, ends = cut(start.join(of_path, "_path")), []
    for level in range(1, levels + 1):
        ends.append(nodes.where(F.col("_n") <= bucket).select(F.col("_path").alias("_leaf"), "_set", "_n"))
        big = nodes.where(F.col("_n") > bucket).select("_path", "_set", "_n")
        if level == levels or big.isEmpty():
            ends.append(big.select(F.col("_path").alias("_leaf"), "_set", "_n"))
            break
        # Children are counted before any set is sent to them: a node of sets that are all alike ends here.
        sizes = cut(child_sizes(big, sets, share, rate))
        largest = sizes.groupBy(F.col("_parent").alias("_path")).agg(F.max("_n").alias("_most"))
        alike = cut(big.select("_path", "_n").distinct().join(largest, "_path").where("_most > 0.5 * _n").select("_path"))
        ends.append(big.join(alike, "_path", "left_semi").select(F.col("_path").alias("_leaf"), "_set", "_n"))
        parted = big.join(alike, "_path", "left_anti")
        nodes = cut(split_nodes(parted, sets, share, rate).join(sizes.select("_path", "_n"), "_path"))
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["_leaf", "_set"])


def common_counts(tokens: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks over the tokens that two sets hold."""
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), list(map(len, tokens)))
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    several = times[column] > 1
    column, owner = place[column[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(tokens), len(tokens)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(tokens), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - first] = 1
        total += held @ held.T
    return total


def met_earlier(block: pd.DataFrame) -> np.ndarray:
    """Which pairs of the block are together in an end node smaller than this one."""
    earlier = [np.asarray(x, np.int64) for x in block["_earlier"]]
    return common_counts(earlier) > 0 if sum(map(len, earlier)) else np.zeros((len(block), len(block)), bool)


def compare(block: pd.DataFrame, threshold: float) -> list[tuple[int, int, int]]:
    """(set, set it is connected to, links counted here) for the sets of a block that have a link."""
    tokens = [np.frombuffer(x, np.int32) for x in block["_tokens"]]
    size = np.array(list(map(len, tokens)), np.float64)
    common = common_counts(tokens)
    linked = common >= threshold / (1 + threshold) * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if block["_a"].iat[0] != block["_b"].iat[0]:
        chunk = block["_chunk"].to_numpy()
        linked &= chunk[:, None] != chunk[None, :]
    if not linked.any():
        return []
    counts = (linked & ~met_earlier(block)).sum(1)
    ids, root = block["_set"].to_numpy(), np.full(len(block), -1)
    for i in np.flatnonzero(linked.any(1)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(linked[front].any(0) & (root < 0))
                root[front] = i
    return [(int(ids[i]), int(ids[root[i]]), int(counts[i])) for i in np.flatnonzero(root >= 0)]


def screen(block: pd.DataFrame, share: float = 0.5) -> list[tuple[int, int]]:
    """(node, set) for the sets of a block whose sketch shares enough with that of a set not met in a smaller node."""
    tokens = [np.frombuffer(x, np.int32) for x in block["_tokens"]]
    size = np.array(list(map(len, tokens)), np.float64)
    close = common_counts(tokens) >= share * np.minimum(size[:, None], size[None, :])
    np.fill_diagonal(close, False)
    near = np.flatnonzero(close.any(1))
    if not len(near):
        return []
    block = block.iloc[near]
    fresh = (close[np.ix_(near, near)] & ~met_earlier(block)).any(1)
    return list(zip(block["_leaf"][fresh].tolist(), block["_set"][fresh].tolist()))


def mates(by_set: DataFrame, chunk: int) -> DataFrame:
    """(_leaf, _mate, _mates) per node of more than ``chunk`` sets: the smaller such node that most of its sets are in, and how many.

    These sets have met there, so in this node they need not be held against each other.
    """
    large = by_set.select(F.transform(F.filter("_ends", lambda e: e["_n"] > chunk), lambda e: e["_leaf"]).alias("_large")).where(F.size("_large") > 1)
    rows = large.select("_large", F.explode("_large").alias("_leaf"))
    both = rows.select("_leaf", F.explode(F.filter("_large", lambda x: x < F.col("_leaf"))).alias("_mate"))
    most = both.groupBy("_leaf", "_mate").agg(F.count(F.lit(1)).alias("_mates")).groupBy("_leaf").agg(F.max(F.struct("_mates", "_mate")).alias("_m"))
    return most.select("_leaf", "_m._mate", "_m._mates")


def in_blocks(rows: DataFrame, by_set: DataFrame, chunk: int, work, columns: list[str]) -> DataFrame:
    """``work`` on the chunk pairs of every node, from rows (_leaf, _n, _set, _tokens, _earlier), ``_n`` being the node's sets.

    ``by_set`` has the nodes of each set. A node's mates are in chunks of their own, which meet the other chunks and not each other.
    """
    known = cut(mates(by_set, chunk))
    few = known.count() * 64 <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(known) if few else known, "_leaf", "left")
    mate, many = F.coalesce(F.array_contains("_earlier", F.col("_mate")), F.lit(False)), F.coalesce("_mates", F.lit(0))
    apart, rest = F.ceil(many / chunk), F.ceil((F.col("_n") - many) / chunk)
    place = F.xxhash64("_set")
    rows = (
        rows.withColumn("_chunk", F.when(mate, F.pmod(place, F.greatest(apart, F.lit(1)))).otherwise(apart + F.pmod(place, F.greatest(rest, F.lit(1)))))
        .withColumn("_with", F.explode(F.when(rest > 0, F.sequence(F.when(mate, apart).otherwise(F.lit(0).cast("bigint")), apart + rest - 1))))
        .withColumns({"_a": F.least("_chunk", "_with"), "_b": F.greatest("_chunk", "_with")}).drop("_with", "_n", "_mate", "_mates")
    )

    def blocks(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch[["_leaf", "_a", "_b"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            out = [x for s, e in zip(starts[:-1], starts[1:]) if e - s > 1 for x in work(batch.iloc[s:e])]
            rest = batch.iloc[starts[-1]:]
            yield pd.DataFrame(out, columns=columns)
        if rest is not None and len(rest) > 1:
            yield pd.DataFrame(work(rest), columns=columns)

    return rows.repartition("_leaf", "_a", "_b").sortWithinPartitions("_leaf", "_a", "_b").mapInPandas(blocks, ", ".join(f"{c} long" for c in columns))


def by_node(rows: DataFrame) -> DataFrame:
    """A row per end node of (_set, _tokens, _ends), with the smaller end nodes of its set."""
    return rows.select("_set", "_tokens", F.col("_ends._leaf").alias("_leaves"), F.inline("_ends")).withColumn(
        "_earlier", F.filter("_leaves", lambda x: x < F.col("_leaf"))).drop("_leaves")


def compare_blocks(ends: DataFrame, sets: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(_set, _to, _links) from all blocks of all end nodes."""
    def per_set(nodes):
        return cut(nodes.groupBy("_set").agg(F.collect_list(F.struct("_leaf", "_n")).alias("_ends")))

    of_ends = per_set(ends)
    sketched = by_node(beside(sets.select("_set", F.col("_sketch").alias("_tokens")), of_ends, F.size("_ends") * 24))
    near = cut(in_blocks(sketched, of_ends, chunk, screen, ["_leaf", "_set"]).distinct())
    of_near = per_set(near.join(near.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")), "_leaf"))
    whole = by_node(beside(sets.select("_set", "_tokens"), of_near, F.size("_ends") * 24))
    return in_blocks(whole, of_near, chunk, lambda block: compare(block, threshold), ["_set", "_to", "_links"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(_set, _class): the smallest set reachable over (_set, _to) edges, by large and small stars in turn."""
    links = cut(edges.where("_set <> _to").select(F.greatest("_set", "_to").alias("_v"), F.least("_set", "_to").alias("_u")).distinct())
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("_u").alias("_v"), F.col("_v").alias("_u")))
        low = both.groupBy("_v").agg(F.min("_u").alias("_m")).withColumn("_m", F.least("_v", "_m"))
        large = cut(both.join(low, "_v").where("_u > _v").select(F.col("_u").alias("_v"), F.col("_m").alias("_u")).distinct())
        low = large.groupBy("_v").agg(F.min("_u").alias("_m"))
        small = large.join(low, "_v")
        links = cut(
            small.where("_u <> _m").select(F.col("_u").alias("_v"), F.col("_m").alias("_u"))
            .unionByName(low.select("_v", F.col("_m").alias("_u"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_v", "_u").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("_v").alias("_set"), F.col("_u").alias("_class"))
        before = now
    raise RuntimeError(f"Classes did not settle in {rounds} rounds.")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999,
                    rate: float = 3.0, bucket: int = 64, levels: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(_doc, _text, _set_doc, _class_doc, _links, _first) per row of ``docs``: its set, class and number of linked sets.

    ``_text`` is a hash of the text. ``_first`` holds for one (_doc, _text) of each class, one with the smallest id.
    """
    share = threshold  # a pair at the threshold has at least this part of its larger set in common
    base = cut(shingle_sets(docs, doc_id, text, n, share, runs_for(recall, rate), rate))
    of_key = base.groupBy("_key").agg(F.min("_row").alias("_set")).where("_key is not null")
    rows = cut(base.select("_doc", "_row", "_text", "_key").join(of_key, "_key", "left").select(
        "_doc", "_row", "_text", "_key", F.coalesce("_set", "_row").alias("_set")))
    chosen = rows.where("_row = _set and _key is not null").select("_set")
    sets = base.withColumnRenamed("_row", "_set").join(chosen, "_set", "left_semi")
    ends = cut(end_nodes(sets.select(F.explode("_paths").alias("_path"), "_set"), base.withColumnRenamed("_row", "_set"), share, rate, bucket, levels))
    found = cut(compare_blocks(ends, base.withColumnRenamed("_row", "_set"), threshold, chunk))
    links = found.groupBy("_set").agg(F.sum("_links").alias("_links"))
    classes = components(found)
    placed = (
        rows.join(links, "_set", "left").join(classes, "_set", "left")
        .withColumn("_class", F.coalesce("_class", "_set")).withColumn("_links", F.coalesce("_links", F.lit(0)))
    )
    placed = cut(placed.select("_doc", "_row", "_text", "_set", "_class", "_links"))
    of_set = placed.groupBy("_set").agg(F.min("_doc").alias("_set_doc"))
    of_class = placed.groupBy("_class").agg(F.min(F.struct("_doc", "_text")).alias("_head"))
    return (
        placed.join(of_set, "_set").join(of_class, "_class")
        .select("_doc", "_text", "_set_doc", F.col("_head._doc").alias("_class_doc"), "_links",
                (F.struct("_doc", "_text") == F.col("_head")).alias("_first"))
    )


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the smallest id. Of rows with one id and one text, one stays."""
    rows = cut(near_duplicates(docs.select("doc_id", "text")).groupBy("_doc", "_text").agg(F.first("_first").alias("_first"), F.count(F.lit(1)).alias("_n")))
    rows = rows.withColumnRenamed("_text", "_of_text")
    own = stowed(docs, "text", "doc_id")
    same = (id_of("_id") == F.col("_doc")) & (F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))) == F.col("_of_text"))
    single = own.join(rows.where("not _first or _n > 1").select("_doc", "_of_text"), same, "left_anti")
    repeated = own.join(rows.where("_first and _n > 1").select("_doc", "_of_text"), same, "left_semi")
    return single.unionByName(repeated.dropDuplicates(["_id", "_text"])).select(*unstowed(docs, "text"))


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark, sf_dir):
    done = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return done.select(back("_doc").alias("doc_id"), back("_class_doc").alias("class_id"), back("_set_doc").alias("set_id"), F.col("_links").alias("n_links"))
