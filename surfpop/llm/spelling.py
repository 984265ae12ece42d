"""Spelling variants by permuterm rotations: words one edit apart, and the commoner form each of them stands for.

Every word gets an end mark, and all rotations of the marked word are sorted. Rotated so that its edited character
would come last, a word ``t x u`` lies in the range of the prefix ``u $ t``, whatever x is: words that differ from it in x
alone are in that range, and the word ``t u``, which lacks x, has the prefix itself as a rotation. So a word sends one row
to each range that skips one of its characters and one row to each of its own rotations; the sorted rows are scanned
range by range. A range holds one word per letter of the alphabet and the word without, at most 91, so all work
is in proportion to the rotations. No pair is emitted: a scan gives each word the number of its neighbours in the range and the best of them.

A word that lacks one of several equal characters in a row, as ``leter`` of ``letter``, meets the longer word once for each of
them; only the first character of such a run counts for insertions and deletions, so that every neighbour is counted once.

A word's form is its neighbour with the most occurrences, if these are at least ``ratio`` times its own. A form is commoner than its word by
that factor, so chains end; they are followed by doubling.

Defined results: null and empty texts have no words; a null id is written as an empty string where occurrences are drawn by id. Rows that share
an id count all their occurrences. An empty table gives no rows. Of ``docs`` only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import ascii_lower, query, table
from surfpop.session import cut

#: Letters of a word; fixed values of the result contract.
LETTERS = "[A-Za-zÀ-ÿ]+"
END = "$"
WHOLE, FIRST, LATER = 0, 1, 2


def letter_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """(_doc, _run): every run of letters of at least ``min_chars``, A-Z lower-cased."""
    runs = docs.select(F.col(doc_id).alias("_doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("_run"))
    return runs.where(F.char_length("_run") >= min_chars).select("_doc", F.when(F.col("_run").rlike("[A-Z]"), ascii_lower(F.col("_run"))).otherwise(F.col("_run")).alias("_run"))


def one_in(every: int) -> Column:
    """``_run`` without one character in the occurrences that its id and letters draw, one in ``every``."""
    drawn = F.crc32(F.concat(F.coalesce(F.col("_doc").cast("string"), F.lit("")), F.lit(":"), F.col("_run")).cast("binary"))
    at = (drawn % F.char_length("_run")).cast("int")
    short = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    return F.when(drawn % every == 0, short).otherwise(F.col("_run"))


def rotations(words: DataFrame) -> DataFrame:
    """(_key, _word, _n, _kind): a row for each prefix range that a word lies in, by its own rotations and by those less a character."""
    at, word = F.col("_at"), F.col("_word")
    split = words.withColumn("_at", F.explode(F.sequence(F.lit(0), F.char_length("_word"))))
    head, tail = F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.char_length(word))
    again = (at > 0) & (F.substring(word, at, F.lit(1)) == F.substring(word, at + 1, F.lit(1)))
    skipped = F.struct(F.concat(F.substring(word, at + 2, F.char_length(word)), F.lit(END), head).alias("_key"), F.when(again, LATER).otherwise(FIRST).alias("_kind"))
    own = F.struct(F.concat(tail, F.lit(END), head).alias("_key"), F.lit(WHOLE).alias("_kind"))
    both = F.when(at < F.char_length(word), F.array(own, skipped)).otherwise(F.array(own))
    return split.select("_word", "_n", F.inline(both))


def other_than(rows: np.ndarray, group: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For rows ``of``, the first of the ascending ``rows`` in their group that is another row; -1 if there is none."""
    first = np.flatnonzero(np.r_[True, group[rows][1:] != group[rows][:-1]]) if len(rows) else np.zeros(0, np.int64)
    best, second = np.full(group[-1] + 1, -1), np.full(group[-1] + 1, -1)
    best[group[rows[first]]] = rows[first]
    after = first[np.r_[np.diff(first), len(rows) - first[-1:]] > 1] if len(first) else first
    second[group[rows[after]]] = rows[after + 1]
    return np.where(best[group[of]] == of, second[group[of]], best[group[of]])


def ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """(_word, _near, _best_n, _best) of each row with neighbours, from whole ranges sorted by (_key, _n descending, _word)."""
    key = rows["_key"].to_numpy()
    new = np.r_[True, key[1:] != key[:-1]]
    alone = new & np.r_[new[1:], True]
    rows, group = rows[~alone], np.cumsum(new[~alone]) - 1
    if not len(rows):
        return pd.DataFrame(columns=["_word", "_near", "_best_n", "_best"])
    kind, n, word = rows["_kind"].to_numpy(), rows["_n"].to_numpy(), rows["_word"].to_numpy()
    count = lambda which: np.bincount(group, which, group[-1] + 1).astype(np.int64)[group]
    whole, skipping, firsts = count(kind == WHOLE), count(kind != WHOLE), count(kind == FIRST)
    near = np.select([kind == WHOLE, kind == FIRST], [firsts, skipping - 1 + whole], skipping - 1)
    best = np.full(len(rows), -1)
    for own, among in ((WHOLE, kind == FIRST), (FIRST, kind >= 0), (LATER, kind != WHOLE)):
        of = np.flatnonzero(kind == own)
        best[of] = other_than(np.flatnonzero(among), group, of)
    found = near > 0
    return pd.DataFrame({"_word": word[found], "_near": near[found], "_best_n": n[best[found]], "_best": word[best[found]]})


def scan(batches):
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        key = batch["_key"].to_numpy()
        last = len(key) - 1
        while last > 0 and key[last - 1] == key[-1]:
            last -= 1
        rest = batch.iloc[last:]
        if last:
            yield ranges(batch.iloc[:last])
    if rest is not None:
        yield ranges(rest)


def neighbours(words: DataFrame) -> DataFrame:
    """(_word, _near, _best_n, _best) of the words of (_word, _n) that have neighbours: how many, and the commonest, ties by smallest word."""
    sorted_rows = rotations(words).repartitionByRange("_key").sortWithinPartitions("_key", F.desc("_n"), "_word")
    met = sorted_rows.mapInPandas(scan, "_word string, _near long, _best_n long, _best string")
    return met.groupBy("_word").agg(F.sum("_near").alias("_near"), F.min(F.struct((-F.col("_best_n")).alias("_less"), "_best")).alias("_top")).select(
        "_word", "_near", (-F.col("_top._less")).alias("_best_n"), F.col("_top._best").alias("_best"))


def roots(forms: DataFrame) -> DataFrame:
    """(_word, _root) for (_word, _root) links, each link followed to its end."""
    links = cut(forms)
    while True:
        step = links.join(links.select(F.col("_word").alias("_root"), F.col("_root").alias("_next")), "_root", "left")
        further = cut(step.select("_word", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved")))
        links = further.select("_word", "_root")
        if further.where("_moved").isEmpty():
            return links


def variants(occurrences: DataFrame, word: str = "_word", min_chars: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """(_word, _n, _near, _form, _form_n, _root) per word of at least ``min_chars`` and ``min_count`` rows of ``occurrences``."""
    words = cut(
        occurrences.select(F.col(word).alias("_word")).where(F.char_length("_word") >= min_chars)
        .groupBy("_word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count))
    formed = F.col("_best_n") >= ratio * F.col("_n")
    met = cut(words.join(neighbours(words), "_word", "left").select(
        "_word", "_n", F.coalesce("_near", F.lit(0)).cast("bigint").alias("_near"),
        F.when(formed, F.col("_best")).alias("_form"), F.when(formed, F.col("_best_n")).alias("_form_n")))
    ends = roots(met.where("_form is not null").select("_word", F.col("_form").alias("_root")))
    return met.join(ends, "_word", "left").withColumn("_root", F.coalesce("_root", "_word"))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    runs = letter_runs(table(spark, sf_dir, "documents"), min_chars=5)
    done = variants(runs.select(one_in(97).alias("_word")))
    return done.select(
        F.col("_word").alias("word"), F.col("_form").alias("form"), F.col("_root").alias("root"),
        F.col("_n").alias("n"), F.col("_near").alias("n_near"), F.col("_form_n").alias("form_n"))
