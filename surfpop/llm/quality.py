"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

A line fails
- punctuation: more than ``max_symbol_ratio`` symbols per word, or no letter at all, or fewer than
  ``min_line_words`` words without an end mark;
- navigation: at least ``min_bars`` separators with at most ``max_bar_words`` words between two of them;
- boilerplate: at most ``max_notice_words`` words that hold one of the fixed phrases.
A letter is one of any script, with case or without. Scripts that set no space between words count two
letters as a word of the line; the document's own words stay those between white space.
Blank lines neither fail nor count. A document is rejected if the base rules fail, or if the words left
are fewer than ``min_words``, or if more than ``max_lost`` of its word characters went with failing lines.

Each document is judged alone, in the tasks that read it: no shuffle. Texts go to Python in Arrow
batches; the repeated 8-word windows of a text are found by sorting the windows' hashes and, where two
agree, exactly by doubling ranks.

Defined results: a null or empty text has no words and is rejected. Very long texts are judged whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfpop.llm.common import BLANK, free_name, query, table

#: Symbols of the contract and the phrases that mark a notice; fixed values.
SYMBOLS = "#*$%&|<>"
NOTICES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on",
    "javascript is disabled", "log in to", "lorem ipsum", "privacy policy", "share this", "sign up for",
    "skip to content", "subscribe to", "terms of service", "terms of use", "this site uses cookies",
)
END_MARKS = (
    ".!?:;…\"'”’»›)]"
    "。！？：；｡．」』）】》〉"  # Chinese, Japanese
    "؟؛۔"  # Arabic, Urdu
    "।॥"  # danda
    "׃։՞՜።፧፨။៕។།༎๚๛\u037e"  # Hebrew, Armenian, Ethiopic, Burmese, Khmer, Tibetan, Thai, Greek
)
UNSPACED = re.compile(  # Thai, Lao, Tibetan, Burmese, Khmer, kana, ideographs
    "[\u0e01-\u0e2e\u0e81-\u0eae\u0f40-\u0f6c\u1000-\u102a\u1780-\u17b3\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
BARS = re.compile(r"[|•·»›]|\s[>/]\s")
NOTICE = re.compile("|".join(map(re.escape, NOTICES)), re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat: float = 0.30
    repeat_window: int = 8
    max_symbol_ratio: float = 0.3
    min_line_words: int = 3
    min_bars: int = 3
    max_bar_words: float = 4.0
    max_notice_words: int = 30
    max_lost: float = 0.5


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array(list(map(first.setdefault, words, range(len(words)))), np.int64)  # a word's first place
    if len(first) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    code = np.zeros(n, np.uint64)
    for k in range(window):
        code = code * np.uint64(0xD1342543DE82EF95) + mixed[k:k + n]
    order = np.sort(code)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal hashes
        return 0
    rank, width = ids, 1
    while width < window:
        step = min(width, window - width)
        pair = rank[:len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        rank, width = np.unique(pair, return_inverse=True)[1], width + step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fails(line: str, rules: Rules) -> str | None:
    """The rule that a line with words fails."""
    n, bars = len(line.encode("utf-8", "surrogatepass").split()), len(BARS.findall(line))
    if not line.isascii():
        n += len(UNSPACED.findall(line)) // 2
    if bars >= rules.min_bars and n - bars <= rules.max_bar_words * (bars + 1):
        return "navigation"
    if not any(map(str.isalpha, line)) or (n < rules.min_line_words and line.strip(BLANK)[-1] not in END_MARKS):
        return "punctuation"
    if sum(map(line.count, SYMBOLS)) > rules.max_symbol_ratio * n:
        return "punctuation"
    if n <= rules.max_notice_words and NOTICE.search(line):
        return "boilerplate"
    return None


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, BLANK))


def judge(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(BLANK)]
    chars, repeated = word_chars(text), repeated_words(words, rules.repeat_window)
    base_failed = len(words) < rules.min_words or repeated > rules.max_repeat * len(words) + 1e-9
    left = [x for x in lines if not x.strip(BLANK) or line_fails(x, rules) is None]
    clean = "\n".join(left)
    kept = not base_failed and len(clean.encode("utf-8", "surrogatepass").split()) >= rules.min_words and word_chars(clean) >= (1 - rules.max_lost) * chars
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), repeated, base_failed, kept,
            len(lines) - len(left), clean)


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_failed_lines long")


def quality(docs: DataFrame, text: str = "text", rules: Rules | None = None, with_text: bool = True) -> DataFrame:
    """The columns of ``docs``, then struct ``_quality`` (under a free name where they have one): the figures, the verdict and the text of the lines that pass."""
    rules = rules or Rules()
    fields = FIELDS + (", clean string" if with_text else "")
    names = [x.split()[0] for x in fields.split(", ")]

    @F.pandas_udf(fields)
    def figures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, rules)[:len(names)] for t in texts], columns=names)

    return docs.withColumn(free_name(docs, "_quality"), figures(F.col(text)))


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged."""
    judged = free_name(docs, "_quality")
    return quality(docs, with_text=False).where(F.col(judged)["kept"]).drop(judged)


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, with_text=False).select("doc_id", "_quality.*")
