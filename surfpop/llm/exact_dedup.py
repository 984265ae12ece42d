"""Exact dedup by salted digest groups: of rows whose normalised texts are equal, the one with the smallest id stays.

Three stages combine rows, each grouping by digest *and* whole normalised text, so two texts are never taken for
one because of their digests:

1. locally: the partial aggregate of the first grouping leaves one row per text and task, before anything is shuffled;
2. by salt: a task's rows meet the others of its salt, so a text found in a third of all rows is ``salts`` groups;
3. globally: at most ``salts`` winners of a text meet.

Rows learn their group by digest alone where the groups show that the digest has a single text; texts whose
digests collide are looked up by their content. Groups above one in ``HOT_GROUPS`` of all copies, of which there are
fewer than ``HOT_GROUPS``, are broadcast; every other group is small enough for an ordinary join.

Defined results: a null text counts as empty. A null id counts as the smallest id. Rows that share id and text are
copies like others; of those with the smallest id one is kept. An empty table gives no rows. Input columns may have
any names; only the two named ones are read, and ``exact_dedup`` hands all of them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import NO_ID, id_of, query, table
from surfpop.session import cut

HOT_GROUPS = 4096


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def with_digest(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(_doc, _norm, _digest) per row."""
    return docs.select(id_of(doc_id).alias("_doc"), normalised(text).alias("_norm")).withColumn("_digest", digest(F.col("_norm")))


def text_groups(rows: DataFrame, salts: int) -> DataFrame:
    """(_digest, _norm, _keep, _size) per text of (_doc, _norm, _digest) rows, all texts of a digest in one task."""
    salted = (
        rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_salt", "_digest", "_norm").agg(F.min("_doc").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    return salted.repartition("_digest").groupBy("_digest", "_norm").agg(F.min("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def look_up(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (_doc, ...) with ``_keep`` and ``_size`` of their group; rows without one are alone."""
    copies = groups.agg(F.sum("_size")).first()[0] or 0
    hot = F.col("_size") > copies / HOT_GROUPS
    first = F.broadcast(groups.where(hot).withColumnsRenamed({"_keep": "_hot_keep", "_size": "_hot_size"}))
    found = rows.join(first, on, "left")
    # A row that has its group already takes part in the second join under a key of its own.
    cold = F.when(F.col("_hot_keep").isNull(), F.col("_digest")).otherwise(F.unhex(F.sha2(F.col("_doc").cast("string"), 256)))
    return (
        found.withColumn("_cold", cold).join(groups.where(~hot).withColumnRenamed("_digest", "_cold"), ["_cold", *on[1:]], "left")
        .select("_doc", "_digest", F.coalesce("_hot_keep", "_keep", "_doc").alias("_keep"),
                F.coalesce("_hot_size", "_size", F.lit(1)).cast("bigint").alias("_size"))
    )


def copy_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(_doc, _digest, _keep, _size, _kept) per row: the id of the row that stays, the copies of its text, and whether it is that row."""
    rows = with_digest(docs, doc_id, text, digest)
    by_digest = cut(text_groups(rows, salts).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"), F.min("_keep").alias("_keep"), F.sum("_size").alias("_size")).where("_size > 1"))
    found = look_up(rows.select("_doc", "_digest"), by_digest.where("_texts = 1").drop("_texts"), ["_digest"])
    collided = by_digest.where("_texts > 1").select("_digest")
    if not collided.isEmpty():
        theirs = rows.join(collided, "_digest", "left_semi")
        found = found.join(collided, "_digest", "left_anti").unionByName(look_up(theirs, cut(text_groups(theirs, salts)), ["_digest", "_norm"]))
    found = cut(found)
    first = F.col("_size") > 1, F.col("_doc") == F.col("_keep")
    rest = found.where(~(first[0] & first[1])).withColumn("_kept", F.col("_doc") == F.col("_keep"))
    # Rows with the smallest id of their group are alike here, so they are counted and told out again, the first of them kept.
    winners = found.where(first[0] & first[1]).groupBy("_doc", "_digest", "_keep", "_size").agg(F.count(F.lit(1)).alias("_n"))
    told = winners.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    return rest.unionByName(told.select("_doc", "_digest", "_keep", "_size", (F.col("_nth") == 1).alias("_kept")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    report = cut(copy_report(docs, doc_id, text, salts))
    dropped = report.where("not _kept")
    packed = docs.select(id_of(doc_id).alias("_doc"), sha256(normalised(text)).alias("_digest"), F.struct("*").alias("_row"))
    left = packed.join(dropped.where("_doc <> _keep").select("_doc", "_digest"), ["_doc", "_digest"], "left_anti")
    twice = dropped.where("_doc = _keep").select("_doc", "_digest").distinct()
    single = left.join(twice, ["_doc", "_digest"], "left_anti")
    return single.unionByName(left.join(twice, ["_doc", "_digest"], "left_semi").dropDuplicates(["_doc", "_digest"])).select("_row.*")


@query("op12_exact_dedup", r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d""")
def op12_exact_dedup(spark, sf_dir):
    done = copy_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return done.select(
        back("_doc").alias("doc_id"), back("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
