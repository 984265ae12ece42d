"""Exact dedup against brute force: copies, repeated ids, colliding digests, clashing names."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from surfpop.llm import exact_dedup

LONG = " ".join(f"word{i}" for i in range(30000))
ROWS = [
    (5, "one  text"), (3, "one\ttext"), (9, "one\r\n\x0btext "), (4, "one text "), (None, None), (7, ""), (8, " "), (6, "\n\n"), (1, LONG), (2, LONG + " "),
    (0, LONG.replace(" ", "  ")), (11, "same id and text"), (11, "same id and text"), (12, "same id and text"), (None, "no id"), (None, "no id"), (13, "no id"),
    (14, "one text"), (14, "two text"),
] + [(100 + i, "very common") for i in range(300)]
NAMES = "doc_id long, text string, _doc string, _digest int, _keep long, _norm string, _size int, _kept boolean, _row int, _cold int, _n int"


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[norm(text)].append(-(2**63) if doc is None else doc)
    out = []
    for ids in groups.values():
        ids.sort()
        out += [(i, ids[0], len(ids), place == 0) for place, i in enumerate(ids)]
    return sorted(out)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 2, "0"))], ids=["sha256", "colliding"])
def test_report_equals_brute_force(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    got = sorted((r["_doc"], r["_keep"], r["_size"], r["_kept"]) for r in exact_dedup.copy_report(docs, digest=digest).collect())
    assert got == brute(ROWS)


def test_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(*r, "a", 1, 2, "b", 3, True, 4, 5, 6) for r in ROWS], NAMES)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.schema["_digest"].dataType == docs.schema["_digest"].dataType
    got = sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], norm(r["text"])) for r in kept.collect())
    ids = collections.defaultdict(list)
    for doc, text in ROWS:
        ids[norm(text)].append(-(2**63) if doc is None else doc)
    assert got == sorted((min(v), k) for k, v in ids.items())
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 and exact_dedup.copy_report(docs.limit(0)).count() == 0


def test_stays_in_the_jvm(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").write.mode("overwrite")
    from surfpop.session import work_root
    path = f"{work_root(spark)}/exact-jvm"
    docs.parquet(path)
    plan = exact_dedup.text_groups(exact_dedup.with_digest(spark.read.parquet(path), "doc_id", "text", exact_dedup.sha256), 16)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and text.count("Exchange hashpartitioning") == 2
