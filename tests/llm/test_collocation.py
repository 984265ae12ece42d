"""Phrase collocations against brute force, and the automata against plain dictionaries."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from surfpop.llm import collocation as c

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count=30, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if a >= min_count and len(g) > 1}
        over = collections.Counter()
        for g, a in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    over[g[i:i + k]] = max(over[g[i:i + k]], a)
        best = []
        for g, a in often.items():
            if 100 * over[g] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, docs=400):
    draw = random.Random(seed)
    words = ["of", "The", "the", "é", "ÉTÉ", "new", "york", "times", "\u0001x", "a|b", "東京", "of"] + [f"w{i}" for i in range(20)]
    marks = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\r\n", "; ", " ! ", "? :", "\x0b"]
    rows = []
    for _ in range(docs):
        text = "".join(draw.choice(["new york times", "new york", *draw.choices(words, k=5)]) + draw.choice(marks) for _ in range(draw.randint(0, 80)))
        rows.append((draw.choice(["en", "en", "en", "fr", None, ""]), text))
    return rows + [("en", None), ("en", ""), (None, "\t \n"), ("xx", "alone here"), ("en", "hot pair " * 4000), ("en", "the of " * 900)] + rows[:40]


def test_automata_keep_rows_and_share_states():
    draw = random.Random(1)
    rows = sorted({(a, b, *(w if b else (0, 0))) for a, b, w in ((draw.randint(1, 5), draw.randint(0, 9), (draw.randint(1, 4), draw.randint(0, 3))) for _ in range(900))})
    grams, weights = np.array(rows, np.int64), np.array([draw.randint(1, 3) for _ in rows], np.int64)
    levels = c.automaton(grams, weights)
    got, w = c.paths(levels)
    assert (got == grams).all() and (w == weights).all()
    assert len(levels[3][0]) - 1 < len({r[:3] for r in rows})  # equal ends are one state
    asked = np.array([(a, b, x, y) for a in range(7) for b in range(4) for x in range(4) for y in range(4)], np.int64)
    held = dict(zip(rows, weights.tolist()))
    assert c.compose(levels, asked).tolist() == [held.get(tuple(r), 0) for r in asked.tolist()]
    words = pa.array([f"word{i:02}".encode() for i in range(12)], pa.binary())
    again, w, names = c.unpacked(c.packed(grams, weights, words))
    named = lambda rows, words: [[words[i - 1].as_py() if i else None for i in r] for r in rows]
    assert named(again.tolist(), names) == named(rows, words) and (w == weights).all()


def test_states_with_equal_codes_stay_apart(monkeypatch):
    monkeypatch.setattr(c.np, "unique", lambda x, **_: (x[:1], np.zeros(1, np.int64), np.zeros(len(x), np.int64)))
    kept, place = c.shared(np.array([0, 1, 2, 4]), np.array([1, 1, 1, 2]), np.array([5, 6, 5, 5]))
    assert kept.tolist() == [0, 1, 2] and place.tolist() == [0, 1, 2]


@pytest.mark.parametrize("seed,chunk,span", [(1, 1 << 20, 1 << 24), (2, 700, 1500), (3, 300, 4000)])
def test_equals_brute_force(spark, seed, chunk, span):
    rows = made(seed)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "lang string, text string, _lang string, _f int").repartition(6)
    done = c.collocations(docs, chunk_bytes=chunk, range_bytes=span)
    assert sorted(tuple(r) for r in done.collect()) == brute(rows)


def test_top_ties_and_empty(spark):
    rows = [("en", " . ".join(f"p{i} q{i}" for i in range(90)))] * 30
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in c.collocations(docs, top=7).collect()) == brute(rows, top=7)
    assert c.collocations(docs.limit(0)).count() == 0
