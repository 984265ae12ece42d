"""Phrase collocations from weighted acyclic automata.

1. A task cuts its texts into pieces and words and sorts all windows of four words (shorter at the end of a piece). From the sorted
   windows it builds one automaton per prefix range: an arc per word, equal states shared from the last word upwards, the
   number of windows on the last arc. A window's prefixes are the shorter n-grams, so nothing else needs to be counted.
2. The automata of a prefix range meet, their paths are merged and the weights summed. The weight below a prefix is the count of that
   n-gram. Counts under ``min_count`` end here, except those on the rim of a range, which other ranges may add to.
3. What is left makes one transducer per range again. The first and the second parts of all candidates, sorted, are composed with it and get their counts.

Ranges lie between sampled windows, some per ``RANGE_BYTES`` of a language's text, so a pair of words that starts a large part of all
windows is several ranges; the sample decides where the ranges end and no result. Counts, totals and candidates come from all texts. Products of counts
are decimals of 38 digits.

Defined results: a null or empty text has no words; a null language is ``und``. Texts of any length are taken in parts that end between pieces.
Rows are taken as they are: repeated rows count again. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfpop.llm.common import LOWER, UPPER, query, table
from surfpop.session import cut

#: Marks between pieces; fixed values of the result contract.
MARKS = ".,;:!?\n\x0b\x0c\r"
DEPTH = 4
CHUNK_BYTES = 6 << 20
RANGE_BYTES = 6 << 20
#: Composed at once with one range's transducer.
BLOCK_PARTS = 1_000_000
FOLD = bytes.maketrans((UPPER + MARKS + "\t").encode(), (LOWER + "\n" * len(MARKS) + " ").encode())
TOKEN = re.compile(rb"[^ \n]+|\n")


def folded(text: bytes | None) -> bytes:
    """The text in lower case, words between blanks and pieces between line ends."""
    return (text or b"").translate(FOLD)


def strings(offsets: np.ndarray, data) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def ordered(found: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Per string its id in the order of the bytes, from 1, and the distinct strings in that order."""
    found = found.dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(1, len(order) + 1)
    return place[found.indices.to_numpy()], found.dictionary.take(order)


def coded(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Per word its id in the order of the words' bytes, from 1, and its piece; then the words."""
    chars = np.frombuffer(data, np.uint8)
    letter = (chars != 32) & (chars != 10)
    begin = np.flatnonzero(letter & np.r_[True, ~letter[:-1]])
    pieces = np.cumsum(chars == 10, dtype=np.int32)[begin]
    ends = np.cumsum(letter, dtype=np.int32)  # letters so far: where words end once blanks are left out
    ids, words = ordered(strings(np.r_[ends[begin] - 1, ends[-1:]], chars[letter]))
    return ids, pieces, words


def windows(ids: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """A row of ``DEPTH`` ids per word, 0 from the end of its piece on."""
    out = np.zeros((len(ids), DEPTH), np.int32)
    for k in range(min(DEPTH, len(ids))):
        rest = len(ids) - k
        out[:rest, k] = np.where(pieces[k:] == pieces[:rest], ids[k:], 0)
    return out


def summed(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order with the sums of their weights."""
    wide = int(grams.max(initial=0)).bit_length()
    pair = lambda k: (grams[:, k].astype(np.int64) << wide) | grams[:, k + 1]
    first, second = pair(0), pair(2)
    if 4 * wide > 63:  # the first pair by its rank, so that all four fit one number
        order = np.argsort(first)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.diff(first[order], prepend=first[order[:1]]) != 0)
        first = rank
    if int(first.max(initial=0)).bit_length() + 2 * wide <= 63:
        order = np.argsort(first << (2 * wide) | second)
    else:
        order = np.lexsort((second, first))
    grams = grams[order]
    first = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]).any(1)])
    return grams[first], np.add.reduceat(weights[order], first)


def shared(first: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For states with arcs ``first[i]:first[i + 1]``: the states that stay, and each one's place among them; equal states become one."""
    size, begin = np.diff(first), first[:-1]
    at = np.arange(len(label), dtype=np.uint64) - np.repeat(begin, size).astype(np.uint64)
    code = (label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ target.astype(np.uint64)) + (at << np.uint64(48))
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    _, kept, place = np.unique(np.add.reduceat(code ^ (code >> np.uint64(32)), begin), return_index=True, return_inverse=True)
    like = kept[place]
    arc = np.minimum(np.repeat(first[like] - begin, size) + np.arange(len(label)), len(label) - 1)
    odd = (size != size[like]) | np.logical_or.reduceat((label != label[arc]) | (target != target[arc]), begin)
    if odd.any():  # other states with an equal code stay by themselves
        place[odd] = len(kept) + np.arange(odd.sum())
        kept = np.r_[kept, np.flatnonzero(odd)]
    return kept, place


def spans(first: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs of the states one after another, and how many each has."""
    size = first[states + 1] - first[states]
    return np.repeat(first[states] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()), size


def automaton(grams: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (first arc of each state, labels, targets) of the automaton of sorted distinct rows; the last targets are the weights."""
    levels, rows, target = [], np.arange(len(grams)), weights
    for depth in range(DEPTH - 1, -1, -1):
        above = grams[rows, :depth]
        new = np.flatnonzero(np.r_[True, (above[1:] != above[:-1]).any(1)])
        first, label = np.r_[new, len(rows)], grams[rows, depth]
        kept, place = shared(first, label, target)
        arcs, size = spans(first, kept)
        levels.append((np.r_[0, np.cumsum(size)], label[arcs], target[arcs]))
        rows, target = rows[new], place
    return levels[::-1]


def paths(levels) -> tuple[np.ndarray, np.ndarray]:
    """The rows and weights of an automaton."""
    states, columns = np.zeros(1, np.int64), []
    for first, label, target in levels:
        arcs, size = spans(first, states)
        columns = [np.repeat(c, size) for c in columns] + [label[arcs]]
        states = target[arcs]
    return np.stack(columns, 1), states


def compose(levels, grams: np.ndarray) -> np.ndarray:
    """The weight that the automaton gives each row, 0 where it has no such path."""
    states, alive = np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
    for depth, (first, label, target) in enumerate(levels):
        wide = max(label.max(initial=0), grams.max(initial=0)) + 1
        keys, wanted = np.repeat(np.arange(len(first) - 1), np.diff(first)) * wide + label, states * wide + grams[:, depth]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        alive &= keys[at] == wanted
        states = np.where(alive, target[at], 0)
    return states


def packed(grams: np.ndarray, weights: np.ndarray, words: pa.BinaryArray) -> bytes:
    """The automaton of the rows with the words it uses, compressed."""
    mine = np.zeros(len(words) + 1, np.int32)
    mine[grams] = 1
    mine[0] = 0
    used, own = np.flatnonzero(mine) - 1, np.where(mine, np.cumsum(mine, dtype=np.int32), 0)[grams]
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    levels = [(small(np.diff(first)), small(label), small(target)) for first, label, target in automaton(own, weights)]
    names = words.take(pa.array(used))
    data = pickle.dumps((small(pc.binary_length(names).to_numpy()), b"".join(names.to_pylist()), levels))
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    sizes, names, levels = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))
    wide = [(np.r_[0, np.cumsum(size.astype(np.int64))], label.astype(np.int32), target.astype(np.int64)) for size, label, target in levels]
    return *paths(wide), strings(np.r_[0, np.cumsum(sizes.astype(np.int64))], names)


def place_of(bound: tuple[bytes, ...], grams: np.ndarray, words: list[bytes]) -> int:
    """Number of sorted rows below the bound; ``words`` by id, from 1."""
    low, high = 0, len(grams)
    for depth, word in enumerate(bound):
        code = bisect_right(words, word)
        column = grams[low:high, depth]
        if not code or words[code - 1] != word:
            return low + int(np.searchsorted(column, code, "right"))
        low, high = low + int(np.searchsorted(column, code)), low + int(np.searchsorted(column, code, "right"))
    return low


def parts_of(data: bytes, limit: int):
    """The text in parts of about ``limit`` bytes that end between pieces."""
    at = 0
    while len(data) - at > limit:
        end = data.find(b"\n", at + limit)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def prefix_ranges(docs: DataFrame, range_bytes: int, seed: int = 7) -> dict[str, list[tuple[bytes, ...]]]:
    """Per language with more text than a range, sampled windows between which its ranges lie."""
    sizes = docs.groupBy("_lang").agg(F.sum(F.octet_length("_text")).alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("b") > range_bytes).collect()
    if not sizes:
        return {}
    ranges = {r["_lang"]: int(r["b"] // range_bytes) + 1 for r in sizes}
    shares = {r["_lang"]: min(1.0, (16 * ranges[r["_lang"]] + 500) / r["n"]) for r in sizes}

    def windows_of(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch["_lang"], batch["_text"]):
                tokens = TOKEN.findall(folded(text))
                for i in range(len(tokens) % 100, len(tokens), 200):
                    gram = b" ".join(tokens[i:i + DEPTH]).split(b"\n")[0].strip(b" ")
                    if gram:
                        out.append((lang, gram))
            yield pd.DataFrame(out, columns=["_lang", "_gram"])

    drawn = defaultdict(list)
    for lang, gram in docs.sampleBy("_lang", shares, seed).mapInPandas(windows_of, "_lang string, _gram binary").collect():
        drawn[lang].append(tuple(bytes(gram).split(b" ")))
    return {lang: sorted({sorted(x)[len(x) * k // ranges[lang]] for k in range(1, ranges[lang])}) for lang, x in drawn.items()}


def shard_automata(docs: DataFrame, bounds: dict, chunk_bytes: int) -> DataFrame:
    """(_lang, _range, _data): each task's automata."""

    def cut_up(lang: str, data: list[bytes]):
        *ids, words = coded(b"\n".join(data))
        if not len(words):
            return
        grams = windows(*ids)
        grams, weights = summed(grams, np.ones(len(grams), np.int64))
        names = words.to_pylist()
        ends = [0, *(place_of(b, grams, names) for b in bounds.get(lang, [])), len(grams)]
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if b > a:
                yield lang, n, packed(grams[a:b], weights[a:b], words)

    def build(batches):
        held, size = defaultdict(list), defaultdict(int)
        for batch in batches:
            for lang, text in zip(batch["_lang"], batch["_text"]):
                for part in parts_of(folded(text), chunk_bytes):
                    held[lang].append(part)
                    size[lang] += len(part)
                    if size[lang] >= chunk_bytes or sum(size.values()) >= 2 * chunk_bytes:
                        full = max(size, key=size.get)
                        del size[full]
                        yield pd.DataFrame(cut_up(full, held.pop(full)), columns=["_lang", "_range", "_data"])
        for lang, data in held.items():
            yield pd.DataFrame(cut_up(lang, data), columns=["_lang", "_range", "_data"])

    return docs.mapInPandas(build, "_lang string, _range int, _data binary")


def range_counts(min_count: int):
    """Merges the automata of one range: (_lang, _phrase, _f) of its n-grams, and the number of its words under a null phrase."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        grams, weights, lists = zip(*map(unpacked, rows["_data"]))
        ids, words = ordered(pa.concat_arrays(lists))
        starts = np.cumsum([0, *map(len, lists)])
        grams = np.concatenate([np.r_[np.int32(0), ids[a:b]][g] for a, b, g in zip(starts[:-1], starts[1:], grams)])
        grams, weights = summed(grams, np.concatenate(weights))
        words = [b"", *words.to_pylist()]
        out = [(None, int(weights.sum()))]
        for depth in range(1, DEPTH + 1):
            first = np.flatnonzero(np.r_[True, (grams[1:, :depth] != grams[:-1, :depth]).any(1)])
            f = np.add.reduceat(weights, first)
            keep = f >= min_count
            keep[[0, -1]] = True  # these may go on in the ranges beside this one
            keep &= grams[first, depth - 1] > 0
            out += [(b" ".join(words[i] for i in g).decode(), n) for g, n in zip(grams[first[keep], :depth].tolist(), f[keep].tolist())]
        return pd.DataFrame({"_lang": rows["_lang"].iat[0], "_phrase": [p for p, _ in out], "_f": [n for _, n in out]})

    return merge


def padded(phrases: list[str], ids: dict[bytes, int]) -> np.ndarray:
    out = np.zeros((len(phrases), DEPTH), np.int64)
    for row, phrase in zip(out, phrases):
        for k, word in enumerate(phrase.encode().split(b" ")):
            row[k] = ids[word]
    return out


def with_counts(counts: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """Composes the parts with the transducer of a range's counts."""
    columns = ["_lang", "_phrase", "_cut", "_second", "_f"]
    if not len(counts) or not len(parts):
        return pd.DataFrame(columns=columns)
    known, wanted = counts["_phrase"].tolist(), parts["_part"].tolist()
    ids = {w: i for i, w in enumerate(sorted({w for p in known + wanted for w in p.encode().split(b" ")}), 1)}
    levels = automaton(*summed(padded(known, ids), counts["_f"].to_numpy()))
    return parts.assign(_f=compose(levels, padded(wanted, ids)))[columns]


def phrase_counts(docs: DataFrame, lang: str, text: str, min_count: int, chunk_bytes: int, range_bytes: int) -> tuple[DataFrame, dict]:
    """(_lang, _phrase, _f) of all n-grams with ``min_count``, and of null, the number of words; with the bounds of the prefix ranges."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("_lang"), F.col(text).cast("binary").alias("_text"))
    bounds = prefix_ranges(texts, range_bytes)
    merged = shard_automata(texts, bounds, chunk_bytes).groupBy("_lang", "_range").applyInPandas(range_counts(min_count), "_lang string, _phrase string, _f long")
    return cut(merged.groupBy("_lang", "_phrase").agg(F.sum("_f").alias("_f")).where((F.col("_f") >= min_count) | F.col("_phrase").isNull())), bounds


def part_counts(counts: DataFrame, bounds: dict) -> DataFrame:
    """(_lang, _phrase, _cut, _l, _r): the counts of both parts of each phrase, cut after ``_cut`` words."""
    words = F.split("_phrase", " ")
    cuts = counts.where("instr(_phrase, ' ') > 0").select("_lang", "_phrase", words.alias("_w")).withColumn(
        "_cut", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)))
    blocks = cuts.count() // BLOCK_PARTS + 1
    both = F.array(
        F.struct(F.array_join(F.slice("_w", F.lit(1), F.col("_cut")), " ").alias("_part"), F.lit(False).alias("_second")),
        F.struct(F.array_join(F.slice("_w", F.col("_cut") + 1, F.size("_w")), " ").alias("_part"), F.lit(True).alias("_second")))
    parts = cuts.select("_lang", "_phrase", "_cut", F.inline(both)).withColumn("_block", F.pmod(F.xxhash64("_phrase"), F.lit(blocks)))

    @F.pandas_udf("int")
    def range_of(langs: pd.Series, phrases: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds.get(a, []), tuple(p.encode().split(b" "))) for a, p in zip(langs, phrases)], dtype="int32")

    known = counts.where("_phrase is not null").withColumn("_range", range_of("_lang", "_phrase")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1))))
    key = ["_lang", "_range", "_block"]
    composed = known.groupBy(*key).cogroup(parts.withColumn("_range", range_of("_lang", "_part")).groupBy(*key)).applyInPandas(
        with_counts, "_lang string, _phrase string, _cut int, _second boolean, _f long")
    return composed.groupBy("_lang", "_phrase", "_cut").agg(
        F.max(F.when(~F.col("_second"), F.col("_f"))).alias("_l"), F.max(F.when(F.col("_second"), F.col("_f"))).alias("_r"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = 30, covered: int = 80, top: int = 2000,
                 chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(_lang, _rank, _phrase, _a, _l, _r, _n, _score): each language's ``top`` phrases of 2 to ``DEPTH`` words.

    A phrase goes if a longer one that holds it has at least ``covered`` percent of its count.
    """
    counts, bounds = phrase_counts(docs, lang, text, min_count, chunk_bytes, range_bytes)
    phrases = counts.where("instr(_phrase, ' ') > 0").withColumnRenamed("_f", "_a")
    scored = part_counts(counts, bounds).join(phrases, ["_lang", "_phrase"]).withColumn(
        "_score", F.expr("(cast(_a as decimal(20, 0)) * 2000000) div (cast(_l as decimal(20, 0)) + _r)"))
    lowest = scored.groupBy("_lang", "_phrase", "_a").agg(F.min(F.struct("_score", "_cut", "_l", "_r")).alias("_best"))
    words = phrases.withColumn("_w", F.split("_phrase", " "))
    inner = words.where("size(_w) > 2").select("_lang", F.col("_a").alias("_more"), F.explode(F.expr(
        "flatten(transform(sequence(2, size(_w) - 1), k -> transform(sequence(1, size(_w) - k + 1), i -> array_join(slice(_w, i, k), ' '))))")).alias("_phrase"))
    over = inner.groupBy("_lang", "_phrase").agg(F.max("_more").alias("_more"))
    kept = lowest.join(over, ["_lang", "_phrase"], "left").where(
        f"_more is null or cast(_more as decimal(20, 0)) * 100 < cast(_a as decimal(20, 0)) * {int(covered)}")
    order = [F.desc("_score"), F.desc("_a"), F.asc("_phrase")]
    flat = kept.select("_lang", "_phrase", "_a", "_best._l", "_best._r", "_best._score")
    # The best of each of 32 parts of a language, then the best of those.
    some = flat.withColumn("_part", F.pmod(F.xxhash64("_phrase"), F.lit(32))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*order)).cast("bigint")).where(F.col("_rank") <= top)
    totals = counts.where("_phrase is null").select("_lang", F.col("_f").alias("_n"))
    return ranked.join(totals, "_lang").select("_lang", "_rank", "_phrase", "_a", "_l", "_r", "_n", "_score")


@query("op13_phrase_collocations", r"""
with docs as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from docs),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
starts as (select lang, w, unnest(generate_series(1, len(w))) as i from words where len(w) > 0),
grams as (select lang, w[i:i + k - 1] as g from starts, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w)),
f as (select lang, array_to_string(g, ' ') as p, g, count(*) as a from grams group by lang, g having count(*) >= 30),
cuts as (select lang, p, g, a, unnest(generate_series(1, len(g) - 1)) as k from f where len(g) > 1),
scored as (
  select cuts.lang, cuts.p, cuts.g, cuts.a, k, x.a as l, y.a as r, 2000000 * cuts.a // (x.a + y.a) as score
  from cuts join f x on x.lang = cuts.lang and x.g = cuts.g[1:k] join f y on y.lang = cuts.lang and y.g = cuts.g[k + 1:]),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
inside as (
  select lang, g[i:i + k - 1] as g, max(a) as more
  from (select lang, g, a, k, unnest(generate_series(1, len(g) - k + 1)) as i from f, (select unnest([2, 3]) as k) where len(g) > k) group by all),
kept as (
  select best.* from best left join inside on inside.lang = best.lang and inside.g = best.g where more is null or 100 * more < 80 * best.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from kept)
select lang, rank, p as phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000""")
def op13_phrase_collocations(spark, sf_dir):
    done = collocations(table(spark, sf_dir, "documents"))
    return done.select(*(F.col(c).alias(c[1:]) for c in done.columns))
