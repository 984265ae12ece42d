"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

Learning takes labelled rows only, at most about ``max_rows`` of them (a hash of the id decides), in
three folds: one finds the words and word beginnings that mark the label (document counts over the fold),
one grows the trees, one fits the isotonic curve. Learned terms are at most ``max_terms``. The features
of a whole text: densities of the learned strong and weak terms, of a fixed list and of terms written with
digits or signs, how near they are to the second person, rates of capitals, punctuation and obfuscation,
and length. Scoring is one scan of the documents with Arrow batches; nothing is shuffled.

Defined results: a null or empty text has features of zero and the score they get. Labels for the same
id count as their maximum, null labels not at all. Without both labels among the learning rows every score
is their mean, or 0 without any. Rows that share an id are scored each by its own text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import free_name, query, stowed, table, unstowed
from surfpop.session import cut

#: Insults, second-person words and sign-for-letter writing; fixed values.
INSULTS = frozenset(
    "arsehole asshole bastard bitch brainless clown coward creep cretin crap cunt degenerate despicable dirtbag disgrace disgusting dumb "
    "dumbass dunce failure fool freak fuck fucking garbage idiot idiotic idiots imbecile jerk kys liar loser losers lowlife maggot moron "
    "moronic morons nazi parasite pathetic pervert pig prick psycho rat repulsive retard retarded scum shit shitty shut slut stupid sucks "
    "swine trash twat ugly useless vermin vile wanker whore worthless".split())
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine euch ihr tu te toi ton tes vous votre vos usted ustedes ti tus".split())
LEET = str.maketrans("013457@$!|", "oieastasii")

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[A-Za-z]+[0-9@$!|*#]+[A-Za-z0-9@$!|*#]*[A-Za-z]")
LONG_LETTER = re.compile(r"([A-Za-z])\1\1")
STEM = 5
FEATURES = ("strong", "strong_count", "weak", "weight", "fixed", "fixed_count", "disguised", "near_you", "second_person", "capitals",
            "capital_words", "exclaims", "punctuation", "mixed", "stretched", "log_words")


def features(text: str | None, terms: dict[str, float], stems: dict[str, float], strong: float) -> list[float]:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    low = [w.lower() for w in words]
    weight = [max(terms.get(w, 0.0), stems.get(w[:STEM], 0.0)) for w in low]
    hit = [i for i, x in enumerate(weight) if x]
    fixed = [i for i, w in enumerate(low) if w in INSULTS]
    hard = [i for i in hit if weight[i] >= strong]
    marks = sorted(set(hard) | set(fixed))
    you = np.array([i for i, w in enumerate(low) if w in SECOND_PERSON])
    near = 0.0
    if marks and len(you):
        at = np.searchsorted(you, marks)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - marks), np.abs(you[np.maximum(at - 1, 0)] - marks))
        near = float((1 / (1 + gap)).mean())
    mixed = MIXED.findall(text)
    disguised = sum(1 for w in mixed if (p := w.lower().translate(LEET).replace("*", "").replace("#", "")) in INSULTS or p in terms)
    letters = sum(map(len, words))
    upper = sum(1 for c in text if c.isupper())
    return [
        len(hard) / n, math.log1p(len(hard)), (len(hit) - len(hard)) / n, sum(weight) / n, len(fixed) / n, math.log1p(len(fixed)), disguised / n,
        near, len(you) / n, upper / letters, sum(1 for w in words if len(w) > 2 and w.isupper()) / n, text.count("!") / n,
        sum(map(text.count, ".,;:?!")) / n, len(mixed) / n, len(LONG_LETTER.findall(text)) / n, math.log1p(n),
    ]


def with_features(docs: DataFrame, text: str, lexicon: dict[str, dict[str, float]], strong: float) -> DataFrame:
    terms, stems = lexicon["term"], lexicon["stem"]

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, terms, stems, strong) for t in texts])

    return docs.withColumn("_features", array_to_vector(dense(F.col(text))))


def learn_lexicon(rows: DataFrame, max_terms: int, min_rows: int, min_odds: float) -> dict[str, dict[str, float]]:
    """Terms and stems with log odds for the label, from (text, _y): document counts over all rows given."""
    totals = rows.agg(F.sum("_y"), F.count("_y")).first()
    n_pos, n_all = totals[0] or 0, totals[1] or 0
    word = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(r"\p{L}{3,40}"), F.lit(0)))
    stem = F.array_distinct(F.transform(F.filter(word, lambda w: F.char_length(w) > STEM), lambda w: F.substring(w, 1, STEM)))

    def of_kind(kind, found):
        return F.transform(found, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("term")))

    kinds = F.explode(F.concat(of_kind("term", word), of_kind("stem", stem)))
    share = n_pos / max(n_all, 1)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("n") - F.col("pos") + 0.5) / (n_all - n_pos + 1))
    z = (F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    best = (
        rows.select("_y", kinds.alias("k")).groupBy("k.kind", "k.term").agg(F.sum("_y").alias("pos"), F.count("_y").alias("n"))
        .where(F.col("pos") >= min_rows).withColumn("odds", odds).where((F.col("odds") >= math.log(min_odds)) & (z >= 4))
        .orderBy(F.desc("odds"), F.desc("n"), "kind", "term").limit(max_terms).collect()  # at most max_terms rows
    )
    out: dict[str, dict[str, float]] = {"term": {}, "stem": {}}
    for r in best:
        out[r["kind"]][r["term"]] = r["odds"]
    return out


def score(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 100_000,
          max_terms: int = 4000, min_rows: int = 4, min_odds: float = 4.0, strong: float = math.log(30), trees: int = 20, depth: int = 4) -> DataFrame:
    """The columns of ``docs``, then ``_score`` (under a free name where they have one). ``labelled``: ids and labels of the rows to learn from."""
    ids = labelled.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_doc")).agg(F.max(label).cast("double").alias("_y"))
    n = ids.count()
    buckets = 1_000_000
    share = min(buckets, int(buckets * max_rows / n)) if n else 0
    picked = ids.where(F.pmod(F.xxhash64("_doc"), F.lit(buckets)) < share).withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), "_doc"), F.lit(10)))
    rows = cut(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_doc"))
        .select("_doc", "_text", "_y", "_fold"))
    by = {(r["_part"], r["_y"]): r["n"] for r in rows.groupBy(F.when(F.col("_fold") < 8, "learn").otherwise("fit").alias("_part"), "_y").agg(F.count("_y").alias("n")).collect()}
    if any(by.get((part, y), 0) == 0 for part in ("learn", "fit") for y in (0.0, 1.0)):
        mean = sum(y * c for (_, y), c in by.items()) / max(sum(by.values()), 1)
        return docs.withColumn(free_name(docs, "_score"), F.lit(float(mean)))
    lexicon = learn_lexicon(rows.where("_fold < 4"), max_terms, min_rows, min_odds)
    dense = cut(with_features(rows, "_text", lexicon, strong).select("_y", "_fold", "_features"))
    grow = dense.where("_fold >= 4 and _fold < 8")
    if grow.select("_y").distinct().count() < 2:
        grow = dense.where("_fold < 8")
    model = GBTClassifier(featuresCol="_features", labelCol="_y", predictionCol="_class",
                          maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=3, seed=11).setProbabilityCol("_p").setRawPredictionCol("_raw").fit(grow)
    margin = vector_to_array("_p")[1].alias("_margin")
    curve = IsotonicRegression(featuresCol="_margin", labelCol="_y", predictionCol="_level").fit(
        model.transform(dense.where("_fold >= 8")).select(margin, "_y"))
    scored = model.transform(with_features(stowed(docs, text), "_text", lexicon, strong)).withColumn("_margin", margin)
    # The curve is flat in places; a small share of the trees' own probability keeps the order there.
    result = free_name(docs, "_score")
    return curve.transform(scored).withColumn(result, 0.99 * F.col("_level") + 0.01 * F.col("_margin")).select(*unstowed(docs, text), result)


def third(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(third("doc_id") != 1)
    done = score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return done.select("doc_id", (third("doc_id") == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))
