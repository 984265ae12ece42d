"""Toxicity: features and lexicon against plain restatements, the learning split, edges."""

import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from surfpop.llm import catalog, toxicity

SF = "/root/testdata/sf0.001"


def plain_features(text, terms, stems, strong):
    """The figures one by one, by their names."""
    words = re.findall(r"[^\W\d_]+", text or "")
    if not words:
        return dict.fromkeys(toxicity.FEATURES, 0.0)
    low = [w.lower() for w in words]
    n = len(words)
    weight = [max(terms.get(w, 0), stems.get(w[:5], 0)) for w in low]
    fixed = sum(w in toxicity.INSULTS for w in low)
    hard = sum(x >= strong and x > 0 for x in weight)
    marks = [i for i in range(n) if weight[i] and weight[i] >= strong or low[i] in toxicity.INSULTS]
    you = [i for i in range(n) if low[i] in toxicity.SECOND_PERSON]
    mixed = re.findall(r"[A-Za-z]+[0-9@$!|*#]+[A-Za-z0-9@$!|*#]*[A-Za-z]", text)
    plain = [re.sub("[*#]", "", x.lower().translate(str.maketrans("013457@$!|", "oieastasii"))) for x in mixed]
    return {
        "strong": hard / n, "strong_count": math.log(1 + hard), "weak": sum(0 < x < strong for x in weight) / n, "weight": sum(weight) / n,
        "fixed": fixed / n, "fixed_count": math.log(1 + fixed), "disguised": sum(p in toxicity.INSULTS or p in terms for p in plain) / n,
        "near_you": sum(1 / (1 + min(abs(i - j) for j in you)) for i in marks) / len(marks) if marks and you else 0.0,
        "second_person": len(you) / n, "capitals": sum(c.isupper() for c in text) / sum(map(len, words)),
        "capital_words": sum(len(w) > 2 and w.isupper() for w in words) / n, "exclaims": text.count("!") / n,
        "punctuation": sum(text.count(c) for c in ".,;:?!") / n, "mixed": len(mixed) / n, "stretched": len(re.findall(r"([A-Za-z])\1\1", text)) / n,
        "log_words": math.log(1 + n),
    }


def test_features_against_a_restatement():
    terms, stems = {"grobnak": 4.0, "zorp": 1.0}, {"unple": 5.0}
    texts = [None, "", "123 ...", "You IDIOT!!! grobnak zorp, you unpleasantness; 1d10t gr0bnak b@stard soooo", "Ein Satz über nichts. " * 50 + "du Grobnak",
             "word " * 200_000 + "you grobnak", "é É 東京 ты"]
    for text in texts:
        got = dict(zip(toxicity.FEATURES, toxicity.features(text, terms, stems, math.log(30))))
        want = plain_features(text, terms, stems, math.log(30))
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in toxicity.FEATURES), text and text[:60]


def test_lexicon_against_counts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"plain{c}" for c in "abcdefghij"] + ["vile", "grobnak", "unpleasant", "unpleasing"], 4)) for _ in range(90)]
    rows = [(t, float("grobnak" in t or "unpleas" in t and i % 9 > 0)) for i, t in enumerate(texts)] + [(None, 0.0), ("", 1.0)]
    n, pos_all = len(rows), sum(y for _, y in rows)
    counts = collections.defaultdict(lambda: [0.0, 0])
    for text, y in rows:
        words = set(re.findall(r"[^\W\d_]{3,40}", (text or "").lower()))
        for key in {("term", w) for w in words} | {("stem", w[:5]) for w in words if len(w) > 5}:
            counts[key][0] += y
            counts[key][1] += 1
    want, share = {"term": {}, "stem": {}}, pos_all / n
    for (kind, term), (pos, k) in counts.items():
        odds = math.log((pos + 0.5) / (pos_all + 1)) - math.log((k - pos + 0.5) / (n - pos_all + 1))
        if pos >= 2 and odds >= math.log(1.5) and (pos - k * share) / math.sqrt(k * share * (1 - share)) >= 4:
            want[kind][term] = odds
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "_text string, _y double"), 100, 2, 1.5)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(math.isclose(got[k][t], want[k][t]) for k in want for t in want[k]) and got["term"]


def test_query_learns_from_two_thirds_only(spark, monkeypatch):
    seen = []
    plain = toxicity.score
    monkeypatch.setattr(toxicity, "score", lambda docs, labelled, **how: seen.append((docs.columns, labelled)) or plain(docs, labelled, **how))
    rows = catalog.QUERIES["op3_toxicity"](spark, SF).collect()
    columns, labelled = seen[0]
    assert columns == ["doc_id", "text"]
    assert not any(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in labelled.collect())
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(docs, docs.select("doc_id", F.lit(1).alias("toxic"))).columns == ["doc_id", "text", "_score"]
    assert toxicity.score(docs, docs.select("doc_id", F.lit(1).alias("toxic"))).count() == 0
