"""Spelling variants against brute force over all pairs of words."""

import collections
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from surfpop.llm import catalog, spelling

SF = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def brute(counts, pairs):
    beside = collections.defaultdict(list)
    for a, b in pairs:
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 2 * n:
            form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(beside[w]), counts[form[w]] if w in form else None))
    return sorted(rows)


def result(df):
    return sorted((r["_word"], r["_form"], r["_root"], r["_n"], r["_near"], r["_form_n"]) for r in df.collect())


def test_dense_words(spark):
    draw = random.Random(3)
    counts = {"".join(draw.choice("aabé") for _ in range(draw.randint(1, 7))): draw.choice([1, 2, 3, 4, 6, 8, 13, 30, 70]) for _ in range(900)}
    counts |= {"letter": 40, "leter": 3, "lettter": 5, "lletter": 3, "x" * 5000: 9, "x" * 5001: 4}
    df = spark.createDataFrame(list(counts.items()), "w string, n int").select("w", F.explode(F.sequence(F.lit(1), "n")).alias("_word")).repartition(5)
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert result(spelling.variants(df.select(F.col("w").alias("word")), "word")) == brute(kept, itertools.combinations(kept, 2))
    assert result(spelling.variants(df.select("w").limit(0), "w")) == []


def test_chain_of_forms(spark):
    chain = [("aaaaa" + "b" * k, 3 * 2**k) for k in range(9)]
    df = spark.createDataFrame(chain, "w string, n long").select("w", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_i"))
    assert {r["_root"] for r in spelling.variants(df, "w").collect()} == {"aaaaabbbbbbbb"}


def test_runs_and_drawn_letters(spark):
    docs = [(1, "Don't ÉTÉs Δelta ABCdef×÷ a1b"), (2, None), (None, ""), (None, "Word"), (2, "Word word")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, _doc string, _run int")
    got = collections.Counter(tuple(r) for r in spelling.letter_runs(df).collect())
    assert got == collections.Counter((d, w.translate(ASCII)) for d, t in docs for w in LETTERS.findall(t or ""))


def counted(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_on_the_smallest_tables(spark):
    counts = counted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    by_gap = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            by_gap[w[:i] + "\0" + w[i:]].add(w)
            if i < len(w):
                by_gap[w[:i] + "\0" + w[i + 1:]].add(w)
    pairs = {tuple(sorted(p)) for g in by_gap.values() for p in itertools.combinations(g, 2)}
    got = sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in catalog.QUERIES["op11_spelling_variants"](spark, SF).collect()))
    assert got == brute(counts, pairs)
