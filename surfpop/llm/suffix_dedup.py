"""Exact repeats of ``length`` bytes, by blockwise suffix sorting with a difference cover.

Every byte under a string of ``length`` bytes that also starts anywhere else goes. Steps:

1. Equal texts are one text from there on, with a count.
2. A text in which no string of ``ANCHOR`` bytes chosen by its surroundings (window minima of hashes, so that
   equal ``length``-byte strings choose alike) occurs twice holds no repeat and needs no sorting.
3. Cover samples: suffixes at positions whose remainder modulo ``period`` is in a difference cover, so any two
   suffixes have a common shift below ``period`` at which both are samples. Samples are ranked by their first
   ``length - period + 1`` bytes. A repeat has a tied sample within its first ``period`` places.
4. The suffixes that have one are dealt into buckets and sorted one bucket at a time; the ties that
   are left there agree in ``length`` bytes.

Ranks and sort keys are hashes of the strings (64 bits for samples, 80 for suffixes), since only equality is asked
for: the samples preselect suffixes and settle no tie between them; no text and no whole rank array is ever gathered. Texts are processed in chunks of about ``CHUNK_BYTES``;
a chunk sends each key once, with a mark if it has it several times, and gets back a bit per key, so a
passage found in a third of all texts is one entry per chunk. A chunk makes its keys anew to read the bits. Buckets hold about ``BUCKET_KEYS`` keys.

Defined results: a null or empty text has no bytes and no repeats. Rows that share an id are texts of
their own. What is left may not be valid UTF-8, as bytes are judged and not characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import NO_ID, id_of, query, table
from surfpop.session import cut

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 2 << 20
#: A chunk's keys are sorted in so many parts, one after another.
KEY_PARTS = 16
#: So many suspect texts (four longs each) are sent to the texts; more meet them in a shuffle.
BROADCAST_ROWS = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def difference_cover(period: int) -> np.ndarray:
    """Remainders such that every difference modulo ``period`` is one of two of them: a run and its multiples."""
    step = int(np.ceil(np.sqrt(period)))
    return np.unique(np.r_[np.arange(step), np.arange(step, period + step, step) % period])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Hashes of all substrings of one length, from prefix sums of byte codes times powers."""

    def __init__(self, base: int):
        self.base, self.inverse, self.code = base, pow(base, -1, 2**64), mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.powers = self.back = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.powers):
            n = 2 * len(data)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)], dtype=np.uint64)
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse, np.uint64)], dtype=np.uint64)
        return np.r_[np.uint64(0), np.cumsum(self.code[data] * self.powers[:len(data)], dtype=np.uint64)]

    def at(self, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        return mix((sums[starts + length] - sums[starts]) * self.back[starts])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = best(x[:-step], x[step:]), have + step
    return x


def anchors(data: np.ndarray, tool: Prefixes, length: int, size: int) -> tuple[np.ndarray, bool]:
    """Distinct hashes of the chosen strings of ``size`` bytes, and whether one is chosen at two places."""
    if len(data) < length:
        return np.zeros(0, np.int64), False
    hashes = tool.at(tool.sums(data), np.arange(len(data) - size + 1), size)
    width = length - size + 1
    low = sliding(hashes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    chosen = hashes[sliding(np.r_[pad, low, pad], width, np.maximum) == hashes]
    found = np.unique(chosen)
    return found.view(np.int64), len(found) < len(chosen)


def bytes_of(text) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def suspects(base: DataFrame) -> DataFrame:
    """(_k1, _k2, _doc, _copies) of texts that share an anchor with another text or with themselves."""
    texts = cut(base.groupBy("_k1", "_k2").agg(
        F.min("_doc").alias("_doc"), F.count(F.lit(1)).alias("_copies"), F.first("_anchors").alias("_anchors"), F.first("_self").alias("_self")))
    # By half of the hash pair: texts that share it can only become suspects together.
    places = texts.select("_k1", F.explode("_anchors").alias("_anchor"))
    shared = places.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    linked = places.join(shared, "_anchor").select("_k1").distinct()
    own = texts.where("_self").select("_k1")
    return texts.drop("_anchors", "_self").join(linked.unionByName(own).distinct(), "_k1", "left_semi")


def order_of(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, check), and which places in it equal the one before."""
    order = np.argsort(keys)
    same_key = keys[order[1:]] == keys[order[:-1]]
    same = same_key & (checks[order[1:]] == checks[order[:-1]])
    if (same_key & ~same).any():  # equal keys with other checks
        order = np.lexsort((checks, keys))
        same = (keys[order[1:]] == keys[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
    return order, same


def once(keys: np.ndarray, checks: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, check) in ascending order, which of them occur several times or are marked in ``more``, and the place of each given one."""
    order, same = order_of(keys, checks)
    new = np.r_[np.ones(min(len(order), 1), bool), ~same]
    first, place = np.flatnonzero(new), np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    several = np.diff(np.r_[first, len(order)]) > 1
    if more is not None and len(first):
        several |= np.logical_or.reduceat(more[order], first)
    return keys[order[first]], checks[order[first]], several, place


KEY_ROWS = "_chunk long, _bucket long, _keys binary, _checks binary, _many binary"
ANSWERS = "_chunk long, _bucket long, _bits binary"


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(33)).astype(np.int64) * buckets >> 31


def bucket_runs(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of ascending keys."""
    if not len(keys):
        return []
    bucket = buckets_of(keys, buckets)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return list(zip(bucket[cuts].tolist(), cuts.tolist(), np.r_[cuts[1:], len(keys)].tolist()))


def key_parts(keys: np.ndarray, buckets: int):
    """The places of all keys, those of some whole buckets at a time: sorting holds a part of a chunk's keys, never all."""
    parts, part = min(buckets, KEY_PARTS), np.empty(len(keys), np.uint8)
    for a in range(0, len(keys), 1 << 16):
        part[a:a + (1 << 16)] = buckets_of(keys[a:a + (1 << 16)], buckets) * parts // buckets
    for n in range(parts):
        yield np.flatnonzero(part == n)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, all lowest bytes first: the high bytes are zeros, which the shuffle compresses."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def key_rows(chunk: int, keys: np.ndarray, checks: np.ndarray, more: np.ndarray, buckets: int) -> pd.DataFrame:
    """A chunk's distinct keys, one row per bucket; ``more`` marks keys of texts that have copies."""
    rows = []
    for at in key_parts(keys, buckets):
        key, check, several, _ = once(keys[at], checks[at], more[at])
        rows += [(chunk, n, packed(key[a:b]), check[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for n, a, b in bucket_runs(key, buckets)]
    return pd.DataFrame(rows, columns=["_chunk", "_bucket", "_keys", "_checks", "_many"])


def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket sorted: for each chunk a bit per key it sent, set if another chunk, or it itself several times, has the key."""
    parts = [unpacked(x) for x in rows["_keys"]]
    keys, checks = np.concatenate(parts), np.frombuffer(b"".join(rows["_checks"]), np.uint16)
    order, same = order_of(keys, checks)
    repeated = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows["_many"], parts)]).astype(bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    ends = np.cumsum([len(p) for p in parts])
    out = [(c, n, np.packbits(repeated[e - len(p):e]).tobytes()) for c, n, p, e in zip(rows["_chunk"], rows["_bucket"], parts, ends) if repeated[e - len(p):e].any()]
    return pd.DataFrame(out, columns=["_chunk", "_bucket", "_bits"])


def repeats(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("_bucket").applyInPandas(sort_bucket, ANSWERS))


def answered(keys: np.ndarray, checks: np.ndarray, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """Which of a chunk's keys repeat, from the bits that its buckets sent back for the distinct ones."""
    bits, out = dict(zip(answers["_bucket"], answers["_bits"])), np.zeros(len(keys), bool)
    for at in key_parts(keys, buckets):
        key, _, _, place = once(keys[at], checks[at])
        found = np.zeros(len(key), bool)
        for n, a, b in bucket_runs(key, buckets):
            if n in bits:
                found[a:b] = np.unpackbits(np.frombuffer(bits[n], np.uint8), count=b - a)
        out[at] = found[place]
    return out


class Chunk:
    """The keys of a chunk's texts, all in one array that is filled text by text.

    A suffix takes 12 bytes (key, check, part, answer) and a bit, and besides the texts nothing else has a chunk's size: the arrays
    are reserved for every byte of the chunk, and what is not written takes no memory.
    """

    def __init__(self, group: pd.DataFrame, length: int, period: int, buckets: int):
        self.texts, self.copied = group["_text"], group["_copies"].to_numpy() > 1
        self.total = sum(len(bytes_of(t)) for t in self.texts)
        self.length, self.period, self.buckets = length, period, buckets
        self.prefix, self.cover = length - period + 1, difference_cover(period)

    def places(self, data: np.ndarray) -> np.ndarray:
        """The cover samples of a text."""
        place = np.arange(max(len(data) - self.prefix + 1, 0))
        return place[np.isin(place % self.period, self.cover)]

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and empty checks of the cover samples, and how many each text has."""
        tool, keys, ends = Prefixes(BASES[0]), np.empty(self.total, np.uint64), [0]
        for data in map(bytes_of, self.texts):
            place = self.places(data)
            ends.append(ends[-1] + len(place))
            keys[ends[-2]:ends[-1]] = tool.at(tool.sums(data), place, self.prefix)
        return keys[:ends[-1]], np.zeros(ends[-1], np.uint16), np.diff(ends)

    def suffixes(self, ranked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Keys and checks of the suffixes with a tied sample at a shift below the period, how many each text has, and a bit per place for them."""
        keys, checks, counts = self.samples()
        ties = np.split(answered(keys, checks, ranked, self.buckets), np.cumsum(counts)[:-1])
        del keys, checks
        tools, ends, bits = [Prefixes(b) for b in BASES], [0], []
        keys, checks = np.empty(self.total, np.uint64), np.empty(self.total, np.uint16)
        for data, tie in zip(map(bytes_of, self.texts), ties):
            chosen = np.zeros(0, bool)
            if tie.any():
                tied = np.zeros(len(data) + 1, np.int32)
                tied[self.places(data) + 1] = tie
                tied = np.cumsum(tied)
                start = np.arange(max(len(data) - self.length + 1, 0))
                chosen = tied[start + self.period] > tied[start]
            start = np.flatnonzero(chosen)
            bits.append(np.packbits(chosen))
            ends.append(ends[-1] + len(start))
            if len(start):
                at = slice(ends[-2], ends[-1])
                keys[at] = tools[0].at(tools[0].sums(data), start, self.length)
                checks[at] = tools[1].at(tools[1].sums(data), start, self.length) >> np.uint64(48)
        return keys[:ends[-1]], checks[:ends[-1]], np.diff(ends), bits

    def rows(self, chunk: int, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return key_rows(chunk, keys, checks, np.repeat(self.copied, counts), self.buckets)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, period: int | None = None,
                   chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame]:
    """Per row (_doc, _k1, _k2, _bytes, _sha, _copies) and per text with repeats (_k1, _k2, _removed, _spans, _kept, _runs)."""
    if length < 8:
        raise ValueError("length is at least 8")
    period = period or max(2, length // 3)
    size = max(4, length * 5 // 8)
    content = F.coalesce(F.col(text), F.lit(""))

    @F.pandas_udf("found array<long>, own boolean")
    def anchored(texts: pd.Series) -> pd.DataFrame:
        tool = Prefixes(BASES[0])
        rows = [anchors(bytes_of(t), tool, length, size) for t in texts]
        return pd.DataFrame({"found": [a for a, _ in rows], "own": [b for _, b in rows]})

    key = [F.xxhash64(content).alias("_k1"), F.xxhash64(F.lit(1), content).alias("_k2")]
    base = cut(
        docs.select(id_of(doc_id).alias("_doc"), *key, F.octet_length(content).cast("bigint").alias("_bytes"),
                    F.sha2(content.cast("binary"), 256).alias("_sha"), anchored(content).alias("_a"))
        .select("_doc", "_k1", "_k2", "_bytes", "_sha", F.col("_a.found").alias("_anchors"), F.col("_a.own").alias("_self")))
    chosen = cut(suspects(base))
    of_text = base.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_copies"))
    rows = base.select("_doc", "_k1", "_k2", "_bytes", "_sha").join(of_text, ["_k1", "_k2"])

    total = base.select("_bytes", "_k1", "_k2").join(chosen.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").agg(F.sum("_bytes")).first()[0] or 0
    chunks, buckets = total // chunk_bytes + 1, total // bucket_keys + 1
    same = (id_of(doc_id) == F.col("_doc")) & (F.xxhash64(content) == F.col("_k1"))
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = cut(
        docs.select(doc_id, text).join(F.broadcast(chosen) if few else chosen, same).select("_k1", "_k2", "_copies", content.alias("_text")).dropDuplicates(["_k1", "_k2"])
        .withColumn("_chunk", F.pmod("_k1", F.lit(chunks))))

    def sample_keys(group: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(group, length, period, buckets)
        return chunk.rows(group["_chunk"].iat[0], *chunk.samples())

    def suffix_keys(group: pd.DataFrame, ranked: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(group, length, period, buckets)
        return chunk.rows(group["_chunk"].iat[0], *chunk.suffixes(ranked)[:3])

    def remove(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        of_suffix, chunk = answers["_suffix"].to_numpy(bool), Chunk(group, length, period, buckets)
        keys, checks, counts, bits = chunk.suffixes(answers[~of_suffix])
        hits, ends = answered(keys, checks, answers[of_suffix], buckets), np.cumsum(counts)
        out = []
        for k1, k2, data, first, end, chosen in zip(group["_k1"], group["_k2"], map(bytes_of, chunk.texts), ends - counts, ends, bits):
            start = np.flatnonzero(np.unpackbits(chosen))[hits[first:end]]
            if not len(start):
                continue
            edge = np.zeros(len(data) + 1, np.int64)
            edge[start] += 1
            edge[start + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            out.append((k1, k2, int(gone.sum()), len(turns) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest(), turns))
        return pd.DataFrame(out, columns=["_k1", "_k2", "_removed", "_spans", "_kept", "_runs"])

    ranked = repeats(texts.groupBy("_chunk").applyInPandas(sample_keys, KEY_ROWS))
    sorted_keys = repeats(texts.groupBy("_chunk").cogroup(ranked.groupBy("_chunk")).applyInPandas(suffix_keys, KEY_ROWS))
    answers = ranked.withColumn("_suffix", F.lit(False)).unionByName(sorted_keys.withColumn("_suffix", F.lit(True)))
    done = texts.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInPandas(
        remove, "_k1 long, _k2 long, _removed long, _spans long, _kept string, _runs array<long>")
    return rows, done


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, **how) -> DataFrame:
    """Per row (_doc, _bytes, _removed, _spans, _kept): what goes from it and the hash of what stays."""
    rows, done = repeated_bytes(docs, doc_id, text, length, **how)
    whole = (F.col("_copies") > 1) & (F.col("_bytes") >= length)
    return rows.join(done.drop("_runs"), ["_k1", "_k2"], "left").select(
        "_doc", "_bytes",
        F.when(whole, F.col("_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("bigint").alias("_removed"),
        F.when(whole, 1).otherwise(F.coalesce("_spans", F.lit(0))).cast("bigint").alias("_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept", "_sha")).alias("_kept"))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark, sf_dir):
    done = dedup_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"),
        F.col("_spans").alias("n_spans"), F.col("_kept").alias("kept_sha256"))
