"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents become tokens and pieces of at most ``capacity`` tokens where they are read. Only the number
of pieces of each length, at most ``capacity`` counts, goes to the driver, which runs best fit in
decreasing order over counts: equal pieces go to equal bins together, so the plan's size depends on the
capacity and not on the corpus. Then pieces are numbered within their length and take the planned slot
of that number. The numbering works in blocks, so a length that a third of all pieces has is many tasks.

Defined results: a null or empty text is the end mark alone. Rows that share an id are packed each on
its own. ``<|endoftext|>`` inside a text is one token, as the vocabulary's own file has it, and parts the text
around it.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import NO_ID, id_of, query, table
from surfpop.session import cut, number_rows

BLOCK_ROWS = 200_000
#: The one added token of byte_bpe_50k.
MARK, MARK_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def encoder(ranks: str | None):
    """The byte-level vocabulary of byte_bpe_50k, by its rank file; one per Python worker."""
    import public_tokenizers
    import tiktoken

    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={MARK: MARK_ID})


def token_ids(tool, content: str) -> list[int]:
    return tool.encode(content, allowed_special={MARK}, disallowed_special=()) if MARK in content else tool.encode_ordinary(content)


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2,
              ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """(_doc, piece, start, length, ids_crc32[, ids]) of every document, its first piece the shorter one."""
    if capacity < 1:
        raise ValueError("capacity is at least 1")

    def cut_up(batches):
        tool = encoder(ranks)
        for batch in batches:
            rows = []
            for doc, content in zip(batch["_doc"], batch["_text"]):
                ids = np.array([*token_ids(tool, content or ""), end_id], "<u4")
                first = len(ids) % capacity
                starts = range(first - capacity if first else 0, len(ids), capacity)
                for piece, at in enumerate(starts):
                    part = ids[max(at, 0):at + capacity]
                    rows.append((doc, piece, max(at, 0), len(part), zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["_doc", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = "_doc long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(id_of(doc_id).alias("_doc"), F.col(text).alias("_text")).mapInPandas(cut_up, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: (length, first rank, end rank, first bin, pieces per bin, offset)."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of bins (first, number)
    rooms: list[int] = []
    bins = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left, first = capacity, bins
                n = -(-todo // (capacity // length))
                bins += n
            per = left // length
            whole = min(n, todo // per)
            for take, each in ((whole, per), (1 if whole < n and todo > whole * per else 0, todo - whole * per)):
                if take:
                    plan.append((length, rank, rank + take * each, first, each, capacity - left))
                    put(left - each * length, first, take)
                    rank, todo, first, n = rank + take * each, todo - take * each, first + take, n - take
            put(left, first, n)
    return plan


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The columns of ``pieces``, then sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(
        best_fit(counts, capacity), "length long, _from long, _to long, _first long, _per long, _offset long")
    blocks = max(1, sum(counts.values()) // BLOCK_ROWS)
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("_doc", "piece"), F.lit(blocks)))
    ranked = number_rows(blocked, ["length"], "_block", ["_doc", "piece", "ids_crc32"], "_nth").drop("_block")
    slot = F.col("_nth") - F.col("_from")
    return (
        ranked.join(F.broadcast(plan), ["length"]).where("_nth >= _from and _nth < _to")
        .withColumn("sequence_id", F.col("_first") + F.floor(slot / F.col("_per")).cast("bigint"))
        .withColumn("offset", F.col("_offset") + slot % F.col("_per") * F.col("length"))
        .drop("_nth", "_from", "_to", "_first", "_per", "_offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of pieces packed ``with_ids``: its ids, at most a capacity of them, and its documents."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "_doc", "piece"))).alias("_p")).select(
        "sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"),
        F.transform("_p", lambda p: F.struct(F.nullif(p["_doc"], F.lit(NO_ID)).alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("pieces"))


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    packed = pack(cut(pieces_of(docs, **how)), how.get("capacity", 1024))
    return packed.select(F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
