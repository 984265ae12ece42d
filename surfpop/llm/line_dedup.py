"""Line dedup: lines that several documents share stay in one of them only.

Lines are exploded and normalised, their hashes are grouped with the smallest and the largest document
that holds each, and the lines of shared keys go everywhere but in the smallest document. The rest is
put together again by position. Grouping keeps two ids per key, so a line found in a third of all
documents is combined before it is shuffled. The keys of shared lines go to the places where their size allows it; else the
join that finds the places can be split by adaptive execution. Nothing gathers the places of one key.

Defined results: a null or empty text is one empty line. A null id counts as the smallest id. Rows that
share an id count as one document for the "found in two documents" test and all keep their lines where
that id is the smallest. Input columns may have any names; only the two named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import BLANK, BROADCAST_BYTES, ascii_lower, free_name, hash_pair, id_of, query, replace_text, stowed, table, unstowed
from surfpop.session import cut


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def dropped_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10,
                      min_docs: int = 2) -> DataFrame:
    """(_doc, _drop): for each document that loses lines, their positions from 0 in ascending order."""
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(BLANK)))
    places = cut(
        docs.select(id_of(doc_id).alias("_doc"), F.posexplode(split_lines(text)).alias("_at", "_line"))
        .select("_doc", "_at", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_doc", "_at", *hash_pair(F.col("_key")))
    )
    held = places.groupBy("_h1", "_h2")
    if min_docs == 2:
        shared = held.agg(F.min("_doc").alias("_keep"), F.max("_doc").alias("_last")).where("_keep < _last")
    else:
        shared = held.agg(F.min("_doc").alias("_keep"), F.count_distinct("_doc").alias("_n")).where(F.col("_n") >= min_docs)
    # 64 bytes for three longs and what a hash table adds. Beyond that adaptive execution splits the lines that very many documents share.
    shared = cut(shared.select("_h1", "_h2", "_keep"))
    few = shared.count() * 64 <= BROADCAST_BYTES
    return (
        places.join(F.broadcast(shared) if few else shared, ["_h1", "_h2"])
        .where("_doc <> _keep")
        .groupBy("_doc").agg(F.array_sort(F.collect_set("_at")).alias("_drop"))
    )


def without(lines: Column, drop: Column) -> Column:
    """The lines but those at the ascending positions, as runs between two dropped places."""
    first = F.concat(F.array(F.lit(-1)), drop)
    last = F.concat(drop, F.array(F.size(lines)))
    return F.flatten(F.zip_with(first, last, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10,
                min_docs: int = 2) -> DataFrame:
    """The columns of ``docs``, then struct ``_lines`` (under a free name where they have one): text (what is kept), n_lines and n_dropped."""
    drops = dropped_positions(docs, doc_id, text, min_chars, min_docs).withColumnRenamed("_doc", "_doc_of_drop")
    joined = stowed(docs, text, doc_id).withColumn("_split", split_lines("_text")).join(drops, id_of("_id") == F.col("_doc_of_drop"), "left")
    kept = F.when(F.col("_drop").isNull(), F.coalesce(F.col("_text"), F.lit(""))).otherwise(
        F.array_join(without(F.col("_split"), F.col("_drop")), "\n"))
    result = free_name(docs, "_lines")
    return joined.withColumn(result, F.struct(
        kept.alias("text"), F.size("_split").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )).select(*unstowed(docs, text), result)


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """Documents with the shared lines taken out of all but their first holder."""
    lines = free_name(docs, "_lines")
    return replace_text(dedup_lines(docs), "text", F.col(lines)["text"]).drop(lines)


@query("op4_line_dedup", r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
shared as (select k, min(doc_id) as keep from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
marked as (select keyed.*, shared.k is not null and doc_id <> keep as gone from keyed left join shared using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""")
def op4_line_dedup(spark, sf_dir):
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.text"), 256).alias("kept_sha256"))
