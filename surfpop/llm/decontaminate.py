"""Benchmark decontamination: documents that hold windows of benchmark items.

Items and documents are cut into words; an item gives its windows of 10 words, or itself where it is
shorter. The windows' hashes are one set of bounded size that goes out with the tasks and is probed where
a document's text is read; the words of each match stay with the row and are verified by a broadcast
join. Document text is never shuffled. More than ``SET_WINDOWS`` windows are taken in blocks of that
size, one scan each. DataFrame functions only.

Defined results: null and empty texts have no words and no hits. Items without words have no window.
Items with equal ids count once. Rows that share a document id are judged each by its own text. A null
document or item id stays null; a null item id is not listed among the items. Words compare exactly
after A-Z are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import NO_ID, ascii_lower, id_of, name_of, query, replace_text, stowed, table, unstowed
from surfpop.session import cut

#: What parts words after lower-casing, and words before it, by the contract's pattern; fixed values.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
SET_WINDOWS = 50_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), "")


def run_hash(length: int) -> str:
    """Hash of the ``length`` words from place i on, from the array _hs of the words' hashes."""
    return f"xxhash64({', '.join(f'get(_hs, i + {k})' for k in range(length))})"


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: its words as text, their number, hash and the items that hold it."""
    cut_up = (
        items.select(F.col(item_id).alias("_item"), words(F.col(text)).alias("_words"))
        .where(F.size("_words") > 0)
        .withColumn("_len", F.least(F.size("_words"), F.lit(window)))
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_words") - F.col("_len"))))
        .withColumn("_run", F.slice("_words", F.col("_at") + 1, F.col("_len")))
    )
    return cut_up.groupBy("_len", F.array_join("_run", " ").alias("_window")).agg(
        F.first("_run").alias("_run"), F.collect_set("_item").alias("_items"))


def scan(docs: DataFrame, doc_id: str, text: str, sets: dict[int, list[int]]) -> DataFrame:
    """(_doc, _row, _n, _runs): word count of each text and its runs of words whose hash is in the set of their length."""
    probes = [
        f"transform(filter(sequence(0, greatest(size(_hs) - {n}, 0)), i -> i + {n} <= size(_hs) and {run_hash(n)} in "
        f"({', '.join(f'{h}L' if h != -(2**63) else 'cast(-9223372036854775808 as bigint)' for h in sorted(hashes))})), "
        f"i -> struct(i as at, {n} as len, array_join(slice(_words, i + 1, {n}), ' ') as run))"
        for n, hashes in sets.items()
    ]
    return (
        docs.select(id_of(doc_id).alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"), words(F.col(text)).alias("_words"))
        .withColumn("_hs", F.expr("transform(_words, w -> xxhash64(w))"))
        .select("_doc", "_row", F.size("_words").cast("bigint").alias("_n"), F.expr(f"concat({', '.join(probes)})").alias("_runs"))
    )


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, set_windows: int = SET_WINDOWS) -> tuple[DataFrame, DataFrame] | None:
    """Per text (_doc, _row, _n), and the verified (_doc, _row, _at, _len, _items); None if the items have no words."""
    keyed = cut(item_windows(items, item_id, item_text, window).withColumn("_hs", F.expr("transform(_run, w -> xxhash64(w))")).withColumn(
        "_hash", F.expr("case _len " + " ".join(f"when {n} then {run_hash(n).replace('i + ', '')}" for n in range(1, window + 1)) + " end")
    ).select("_len", "_hash", "_window", "_items"))
    n = keyed.count()
    blocks = -(-n // set_windows)
    texts = found = None
    for block in range(blocks):
        chosen = keyed.where(F.pmod("_hash", F.lit(blocks)) == block)
        sets: dict[int, list[int]] = {}
        for r in chosen.select("_len", "_hash").distinct().collect():  # about set_windows rows
            sets.setdefault(r["_len"], []).append(r["_hash"])
        if not sets:
            continue
        scanned = cut(scan(docs, doc_id, text, sets))
        texts = texts or scanned.select("_doc", "_row", "_n")
        part = (
            scanned.where(F.size("_runs") > 0).select("_doc", "_row", F.inline("_runs").alias("_at", "_len", "_window"))
            .join(F.broadcast(chosen.select("_window", "_items")), "_window")
            .select("_doc", "_row", "_at", "_len", "_items")
        )
        found = part if found is None else found.unionByName(part)
    return (texts, found) if blocks else None


def covered(places: Column) -> Column:
    """Distinct word positions under the (at, len) runs."""
    return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["_at"], p["_at"] + p["_len"] - 1))))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per text (_doc, _row): _n words, _hit (hit word positions from 0) and _names (items, sorted as strings)."""
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    got = matches(docs, items, doc_id, text, **how)
    if got is None:
        return docs.select(id_of(doc_id).alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"),
                           F.size(words(F.col(text))).cast("bigint").alias("_n"), none[0].alias("_hit"), none[1].alias("_names"))
    texts, found = got
    per_text = (
        found.groupBy("_doc", "_row")
        .agg(F.collect_set(F.struct("_at", "_len")).alias("_places"), F.collect_set("_items").alias("_lists"))
        .select("_doc", "_row", covered(F.col("_places")).alias("_hit"),
                F.array_sort(F.transform(F.array_distinct(F.flatten("_lists")), lambda i: i.cast("string"))).alias("_names"))
    )
    return texts.join(per_text, ["_doc", "_row"], "left").withColumns(
        {"_hit": F.coalesce("_hit", none[0]), "_names": F.coalesce("_names", none[1])})


def remove_hits(text: Column, hit: Column) -> Column:
    """The text without its hit words; what stands between words stays."""
    text = F.coalesce(text, F.lit(""))
    gaps, found = F.split(text, WORD_ANY_CASE, -1), F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), hit)
    whole = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.get(gaps, i))
    kept = F.transform(left, lambda i: F.struct(i.alias("i"), F.get(found, i).alias("w")))
    merged = F.array_sort(F.concat(
        F.transform(whole, lambda g, i: F.struct((i * 2).alias("i"), g.alias("w"))),
        F.transform(kept, lambda k: F.struct((k["i"] * 2 + 1).alias("i"), k["w"].alias("w"))),
    ))
    rebuilt = F.concat(F.array_join(F.transform(merged, lambda m: m["w"]), ""), F.element_at(gaps, -1))
    return F.when(F.size(hit) == 0, text).otherwise(rebuilt)


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The columns of ``docs``: contaminated documents go, or with ``remove="spans"`` only their hit words."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    bad = (
        contamination(docs, items, doc_id, text, **how).where(F.size("_hit") > 0)
        .select(F.col("_doc").alias("_bad_doc"), F.col("_row").alias("_bad_row"), F.col("_hit").alias("_bad_hit"))
        .dropDuplicates(["_bad_doc", "_bad_row"])
    )
    own = stowed(docs, text, doc_id)
    same = (id_of("_id") == F.col("_bad_doc")) & (F.xxhash64(F.coalesce(F.col("_text"), F.lit(""))) == F.col("_bad_row"))
    if remove == "documents":
        return own.join(bad, same, "left_anti").select(*unstowed(docs, text))
    left = F.when(F.col("_bad_hit").isNull(), F.col("_text")).otherwise(remove_hits(F.col("_text"), F.col("_bad_hit")))
    joined = own.join(bad, same, "left").withColumn("_left", left).select(*unstowed(docs, text, "_left"))
    return replace_text(joined, text, name_of(text))


@query("op5_benchmark_decontamination", r"""
with d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as materialized (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as materialized (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as win
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as materialized (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n)),
hit as materialized (select doc_id, p, n, item_id from dw join bw using (n, win)),
pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s
        from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join its using (doc_id)""")
def op5_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id"), F.col("_n").alias("n_words"), F.size("_hit").cast("bigint").alias("n_hit"),
        F.size("_names").cast("bigint").alias("n_items"), F.sha2(F.array_join("_names", ","), 256).alias("items_sha256"),
        (F.size("_hit") > 0).alias("contaminated"))
