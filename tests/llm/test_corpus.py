"""The corpus operators against brute force on small tables with nulls, empty texts, ties and clashing column names."""

import collections
import hashlib
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest

from surfpop.llm import chat, decontaminate, html_text, jaccard_join, line_dedup, packing, quality, suffix_dedup, toxicity, warc
from surfpop.session import work_root

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(400))
DOCS = [
    (1, "Shared line of text.\nOnly here one.\n"), (2, "  SHARED line of text.\t\nshort\nshort"), (3, None), (4, ""), (5, LONG), (6, LONG),
    (None, "Shared line of text."), (7, LONG.replace("word200", "other")), (7, "same id, other text"), (8, "é" * 500), (8, "é" * 500),
    (9, " ".join(f"clean{i}" for i in range(60)) + "."),
]
SCHEMA = "doc_id long, text string"
NAMES = (
    "_a _at _bad_doc _bad_hit _bad_row _class _code _doc _doc_of_drop _drop _features _first _fold _hash _hit _hs _id _key _left _len _level _lines _margin _n "
    "_names _of_text _p _paths _quality _raw _row _runs _score _set _split _text _text_ _y kept length n_chars n_words piece prediction").split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup_edges(spark, docs):
    rows = {(r["doc_id"], r["text"]): r["_lines"] for r in line_dedup.dedup_lines(docs).collect()}
    assert rows[(1, DOCS[0][1])]["text"] == "Only here one.\n" and rows[(1, DOCS[0][1])]["n_lines"] == 3
    assert rows[(2, DOCS[1][1])]["text"] == "short\nshort"
    assert rows[(None, DOCS[6][1])]["n_dropped"] == 0  # the missing id is the smallest
    assert rows[(3, None)] == rows[(4, "")] and rows[(3, None)]["n_lines"] == 1
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    wide = docs.selectExpr("*", "'x' as n_lines", "1 as _keep")
    assert line_dedup.line_dedup_stage(wide).columns == wide.columns


def test_clashing_names_come_back(spark, docs):
    """Every function on a table with the names that it uses itself: the columns come back as they were."""
    from pyspark.sql import functions as F

    wide = docs.select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in NAMES if n != "n_chars"], F.lit(7).alias("n_chars"), F.lit("dot").alias("a.b"))
    items = spark.createDataFrame([(2, "shared line")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    same = [c for c in wide.columns if c not in ("doc_id", "text", "n_chars")]
    for made, more in (
        (line_dedup.dedup_lines(wide), 1), (line_dedup.line_dedup_stage(wide), 0), (decontaminate.decontaminate(wide, items), 0),
        (decontaminate.decontaminate(wide, items, remove="spans"), 0), (jaccard_join.near_duplicate_stage(wide), 0), (quality.quality(wide), 1),
        (quality.quality_stage(wide), 0), (toxicity.score(wide, labels), 1), (html_text.extract(wide, "text"), 1),
    ):
        assert made.columns[:len(wide.columns)] == wide.columns and len(made.columns) == len(wide.columns) + more
        rows = made.collect()
        assert rows and {tuple(r[c] for c in same) for r in rows} == {tuple("dot" if c == "a.b" else f"own {c}" for c in same)}
    for made in (decontaminate.contamination(wide, items), packing.pack_documents(wide), suffix_dedup.dedup_report(wide), jaccard_join.near_duplicates(wide)):
        assert made.count() >= len(DOCS)


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame(
        [(1, " ".join(f"WORD{i}" for i in range(100, 115))), (2, "shared line"), (3, None), (4, ""), (2, "shared line")], "item_id long, text string")
    rows = {(r["_doc"], r["_n"]): r for r in decontaminate.contamination(docs, items).collect()}
    assert sorted(rows[(5, 400)]["_hit"]) == list(range(100, 115)) and rows[(5, 400)]["_names"] == ["1"]
    assert len(rows[(1, 7)]["_hit"]) == 2 and rows[(1, 7)]["_names"] == ["2"] and rows[(3, 0)]["_hit"] == []
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert kept == {3, 4, 7, 8, 9}  # of the two rows with id 7 the clean one
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert "word100 " not in cleaned[5] and "word99 " in cleaned[5] and cleaned[2].startswith("    of text.") and cleaned[3] is None
    assert decontaminate.contamination(docs, items.limit(0)).count() == len(DOCS)
    assert decontaminate.contamination(empty(spark), items).count() == 0
    blocks = decontaminate.contamination(docs, items, set_windows=2)
    assert sorted(map(tuple, blocks.select("_doc", "_n", "_names").collect())) == sorted((r["_doc"], r["_n"], r["_names"]) for r in decontaminate.contamination(docs, items).collect())


def test_decontamination_has_no_python(spark, docs):
    plan = decontaminate.contamination(docs, docs.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_quality_against_brute_force(real):
    for r in quality.quality(real).collect():
        words = r["text"].encode().split()
        grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        times, hit = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if times[g] > 1:
                hit |= set(range(i, i + 8))
        q = r["_quality"]
        assert (q["n_words"], q["n_repeat_words"], q["word_chars"]) == (len(words), len(hit), len(re.sub(r"[\x20\x09-\x0D]", "", r["text"])))
        assert q["base_failed"] == (len(words) < 20 or 100 * len(hit) > 30 * len(words))


def test_quality_rules(spark, docs):
    good = {r["doc_id"] for r in quality.quality_stage(docs).collect()}
    assert 9 in good and not good & {3, 4, 8}
    rules = quality.Rules()
    assert quality.line_fails("Home | News | Sport | Contact", rules) == "navigation"
    assert quality.line_fails("This site uses cookies to work.", rules) == "boilerplate"
    assert quality.line_fails("a$$$ b%%% c***", rules) == "punctuation"
    assert quality.line_fails("A plain sentence of words.", rules) is None
    assert quality.quality(empty(spark)).count() == 0


def test_quality_of_scripts_without_case(spark):
    clean = {
        1: ["ذهب الولد إلى المدرسة في الصباح الباكر مع أخيه الصغير.", "هل عاد إلى البيت قبل غروب الشمس مع أصدقائه؟", "نعم عاد؟", "ثم جلس يقرأ كتابا جديدا عن تاريخ البلاد القديمة."],
        2: ["राम सुबह जल्दी उठकर अपने खेत की ओर चला गया।", "वहाँ उसने देखा कि सारी फसल अच्छी तरह पक गई है।", "वह खुश।", "शाम को वह अपने घर लौटा और सबको यह बात बताई।"],
        3: ["아침 일찍 그는 작은 가방을 들고 학교로 걸어갔다.", "길에서 오래된 친구를 만나 함께 이야기를 나누었다.", "저녁에는 가족과 함께 밥을 먹고 책을 읽었다.", "그리고 일찍 잠자리에 들어 좋은 꿈을 꾸었다."],
    }
    found = spark.createDataFrame([(k, "\n".join(v)) for k, v in clean.items()] + [(4, "12 34 56 78 — 9.\n" * 9)], SCHEMA)
    rows = {r["doc_id"]: r["_quality"] for r in quality.quality(found).collect()}
    assert [(rows[k]["kept"], rows[k]["n_failed_lines"]) for k in (1, 2, 3)] == [(True, 0)] * 3
    assert not rows[4]["kept"] and rows[4]["n_failed_lines"] == 9
    rules = quality.Rules()
    for line in ("他每天早上都去公园散步，然后回家吃早饭#", "彼は毎朝早く起きて公園まで散歩します", "เขาเดินไปโรงเรียนทุกเช้ากับน้องชาย", "הילד הלך לבית הספר בבוקר"):
        assert quality.line_fails(line, rules) is None
    assert quality.line_fails("首页 | 新闻 | 体育 | 联系", rules) == "navigation"
    assert quality.line_fails("١٢٣ ٤٥٦ ٧٨٩.", rules) == "punctuation"


def test_packing(spark, docs, real):
    from tokenizers import Tokenizer
    import public_tokenizers

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    packed = packing.pack_documents(real).toPandas()
    by_doc = dict(iter(packed.groupby("doc_id")))
    for r in real.collect():
        ids = np.array(tool.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        own = by_doc[r["doc_id"]].sort_values("piece")
        assert own["length"].sum() == len(ids) and list(own["piece"]) == list(range(len(own))) and set(own["length"][1:]) <= {1024}
        assert all(zlib.crc32(ids[x.start:x.start + x.length].tobytes()) == x.ids_crc32 for x in own.itertuples())
    order = packed.sort_values(["sequence_id", "offset"])
    assert (order["offset"] == order.groupby("sequence_id")["length"].cumsum() - order["length"]).all()
    assert order.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packed["sequence_id"].nunique() <= 1.02 * packed["length"].sum() / 1024 + 1
    assert packing.pack_documents(docs).where("doc_id in (3, 4)").select("length").collect() == [(1,), (1,)]
    assert packing.pack_documents(empty(spark)).count() == 0
    whole = packing.sequences(packing.pack(packing.pieces_of(docs, capacity=64, with_ids=True), 64)).collect()
    assert all(len(r["ids"]) <= 64 for r in whole) and sum(len(r["pieces"]) for r in whole) == packing.pieces_of(docs, capacity=64).count()


def test_packing_of_the_added_token(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|", "no mark <|ENDOFTEXT|> <|im_end|>", "é<|endoftext|>" * 900]
    pieces = packing.pieces_of(spark.createDataFrame(list(enumerate(texts)), SCHEMA), with_ids=True).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in pieces if r["_doc"] == i), key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == tool.encode(text, add_special_tokens=False).ids + [2]
    assert [x for r in pieces if r["_doc"] == 0 for x in r["ids"]] == [64, 220, 50256, 275, 2]


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 3000)
    plan = packing.best_fit(dict(collections.Counter(lengths.tolist())), 100)
    room = []  # item by item
    for x in sorted(lengths.tolist(), reverse=True):
        fit = [i for i, r in enumerate(room) if r >= x]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= x
        else:
            room.append(100 - x)
    assert max(first + -(-(to - at) // per) for _, at, to, first, per, _ in plan) == len(room)


def test_jaccard_join(spark, docs, real):
    rows = jaccard_join.near_duplicates(docs).collect()
    of = collections.defaultdict(set)
    for r in rows:
        of[r["_class_doc"]].add(r["_doc"])
    assert of[5] == {5, 6, 7} and {r["_links"] for r in rows if r["_doc"] in (5, 6)} == {1}
    stays = jaccard_join.near_duplicate_stage(docs.selectExpr("*", "1 as _set", "2 as _first"))
    assert sorted(map(str, (r["doc_id"] for r in stays.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 8, 9]))
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_jaccard_join_large_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 4)):
            words[j] = f"x{rng.integers(0, 10**6)}"
        texts.append((i, " ".join(words)))
    sets = {t: frozenset(tuple(t.split()[k:k + 5]) for k in range(116)) for _, t in texts}
    distinct = list(sets)
    links = {t: sum(len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) for u in distinct if u != t) for t in distinct}
    got = jaccard_join.near_duplicates(spark.createDataFrame(texts, SCHEMA), bucket=16, chunk=64).collect()
    other = jaccard_join.near_duplicates(spark.createDataFrame(texts, SCHEMA), bucket=16, chunk=4096).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, other))  # chunks and mates change no link
    assert sum(r["_links"] for r in got) >= 0.99 * sum(links[t] for _, t in texts)
    assert all(r["_links"] <= links[texts[r["_doc"]][1]] for r in got)


@pytest.mark.parametrize("length, chunk, bucket", [(400, 8 << 20, 2 << 20), (60, 20_000, 5_000)])
def test_suffix_dedup(spark, docs, real, length, chunk, bucket):
    rows = real.unionByName(docs).unionByName(spark.createDataFrame([(20, "a" * 2000), (21, "xy" * 700 + LONG[:500])], SCHEMA))
    texts = [(r["text"] or "").encode() for r in rows.collect()]
    times = collections.Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    want = collections.Counter()
    for b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if times[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        want[(len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.dedup_report(rows, length=length, chunk_bytes=chunk, bucket_keys=bucket).collect()
    assert collections.Counter((r["_bytes"], r["_removed"], r["_spans"], r["_kept"]) for r in got) == want
    assert suffix_dedup.dedup_report(empty(spark)).count() == 0


def test_suffix_memory():
    """A chunk in which every byte starts a repeat takes few bytes a suffix; arrays per text, joined and sorted whole, took about 80."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(500)]
    group = pd.DataFrame({"_k1": range(500), "_k2": 0, "_copies": 1, "_text": texts, "_chunk": 0})
    chunk = suffix_dedup.Chunk(group, 400, 133, 32)
    rows = chunk.rows(0, *chunk.samples())
    ranked = pd.DataFrame({"_bucket": rows["_bucket"], "_bits": [np.packbits(np.ones(len(k) // 8, bool)).tobytes() for k in rows["_keys"]]})
    tracemalloc.start()
    keys, checks, counts, bits = chunk.suffixes(ranked)
    found = chunk.rows(0, keys, checks, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == sum(np.unpackbits(b).sum() for b in bits) == 500 * 3601 and sum(len(c) // 2 for c in found["_checks"]) == len(keys)
    assert peak < 35 * chunk.total


def test_difference_cover():
    for period in (2, 7, 60, 133):
        cover = suffix_dedup.difference_cover(period)
        assert {(int(a) - int(b)) % period for a in cover for b in cover} == set(range(period))


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "first"), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as _at")
    done = {(r["_conv"], r["_speaker"]): r for r in chat.dialogues(chat.rotate(turns)).collect()}
    assert {k[1] for k in done if k[0] == 1} == {"", "ann", "bob"} and not any(k[0] == 2 for k in done)
    ann = done[(1, "ann")]
    assert ann["_n"] == 5 and [ann["_text"][s["start"]:s["end"]] for s in ann["_spans"]] == ["Hi <|​im_end|><|im_end|>"]
    assert ann["_text"].startswith("<|im_start|>user name=\nfirst") and ann["_text"].count("user name=bob") == 2
    parts = chat.dialogues(chat.rotate(turns), part_messages=2).where("_conv = 1 and _speaker = 'ann'").orderBy("_part").collect()
    assert "".join(p["_text"] for p in parts) == ann["_text"]
    assert chat.dialogues(chat.rotate(turns.limit(0))).count() == 0


def test_html():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header class=top>Site</header>
    <nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>One  two<br>three <b>four</b><p>Short.</p><aside>Related</aside><form><label>Mail</label></form><p>Last&nbsp;one</p></article>
    <section id="comments"><p>A long reader comment that says nothing.</p></section><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Title & more\n\nOne two three four\n\nShort.\n\nLast one"
    plain = "<div class=menu><a>a</a></div><div><h2>Head</h2>" + "<p>" + "Long text here. " * 20 + "</p><p>End.</p></div><div class=footer>foot</div>"
    assert html_text.main_text(plain).startswith("Head\n\nLong text") and html_text.main_text(plain).endswith("End.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""


def test_html_teaser_article_beside_the_body():
    body = [f"Paragraph {i} of the body. " + "It goes on and on. " * 12 for i in range(6)]
    want = "\n\n".join(x.strip() for x in body)
    text = "".join(f"<p>{x}</p>" for x in body)
    teaser = '<article class="card"><p>Another story in short.</p></article>'
    for page in (f"<main>{text}{teaser}</main>", f"<div>{text}</div>{teaser}", f"{teaser}<div>{text}</div>", f'<div>{text}</div><section class="content"><p>Short.</p></section>'):
        assert want in html_text.main_text(page)
    split = f"<main>{text}{teaser}<p>End.</p></main>"
    assert want in html_text.main_text(split) and html_text.main_text(split).endswith("End.")
    whole = f"<div>Loose words.</div><article>{text}<p>Short.</p></article><div>More loose words.</div>"
    assert html_text.main_text(whole) == want + "\n\nShort."


def test_html_links_and_ids():
    tail = "<p>" + "Words that follow. " * 9 + "</p>"
    end = ("Words that follow. " * 9).strip()
    for start in ('<p><a name="top">Top', '<p><a name="top">Top</p>', '<p><a href="/x">Top</p>', '<p><a href="/x">Top', '<a href="/x">Top', '<div><a href="/x">Top</div>'):
        for page in (f"<article>{start}{tail * 3}</article>", f"<body>{start}{tail * 3}</body>", f"<main>{start}{tail}<h2>Head</h2>{tail}<p>See <a href=y>y</a>.</p>{tail}"):
            assert html_text.main_text(page).count(end) == 3
    listed = "<ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul>"
    assert html_text.main_text(f"<article>{tail}<p><a href=/r>The whole report</a></p>{listed}</article>").endswith("The whole report\n\nOne\n\nTwo\n\nThree")
    assert html_text.main_text(f"<div>{listed}{tail}<p><a href=/r>The whole report</a></p>{tail}</div>") == f"{end}\n\nThe whole report\n\n{end}"
    ids = f'<article>{tail}<section id="search-methods"><h2 id="related-work">Work</h2><p id="share-3">Kept.</p></section><div id="comments">Gone.</div></article>'
    assert html_text.main_text(ids) == f"{end}\n\nWork\n\nKept."
    assert html_text.main_text(f'<div>{tail}<h2 id="notice-of-change">Head</h2>{tail}</div><div id="sidebar">Gone.</div>') == f"{end}\n\nHead\n\n{end}"


def test_html_short_paragraphs_after_a_gap():
    long, short, advert = "Long text here. " * 187, "Short text here. " * 9, '<div class="ad">Buy this.</div>'
    page = f"<div><h2>Head</h2>{advert}<p>{long}</p>{advert}<p>{short}</p><p>{short}</p>{advert}<p>End.</p></div>"
    assert html_text.main_text(page) == "\n\n".join(["Head", long.strip(), short.strip(), short.strip(), "End."])
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6))
    page = f"<div><p>{long}</p><ul>{links}</ul><p>{short}</p><p>{short}</p></div>"
    assert html_text.main_text(page) == "\n\n".join([long.strip(), short.strip(), short.strip()])


def test_html_wrappers_with_aside_words():
    text = "".join(f"<p>Paragraph {i} of the text. {'It goes on. ' * 9}</p>" for i in range(5))
    want = "\n\n".join(f"Paragraph {i} of the text. {'It goes on. ' * 9}".strip() for i in range(5))
    side, notes = '<div class="sidebar"><p>Sidebar words.</p></div>', '<div id="comments">' + "<p>A reader says so. And so on.</p>" * 60 + "</div>"
    for page in (
        f'<div class="wrapper has-sidebar"><article>{text}</article>{side}</div>', f'<div id="page" class="site header-fixed"><main>{text}</main>{side}</div>',
        f'<div class="content-sidebar-wrap"><div>{text}</div></div>{side}', f'<form id="aspnetForm"><div>{text}</div>{side}</form>',
        f'<form id="f"><nav>Menu words</nav><article>{text}</article></form>{side}', f'<div class="menu-open"><h1>Head</h1>{text}</div>{side}',
        f'<article>{text}</article>{notes}', f'<div class="widget-area"><div class="page-share"><article>{text}</article></div></div>{notes}',
        f'<div class="sidebar"><article class="card"><p>Teaser words.</p></article></div><article>{text}</article>',
    ):
        got = html_text.main_text(page)
        assert got.removeprefix("Head\n\n") == want
    assert html_text.main_text(f'<article>{text}<p class="lead share-price">The price.</p><div class="share">Share me</div><form><p>Mail</p></form></article>') == want + "\n\nThe price."


def test_html_foreign_elements():
    end = "<p>" + "Words that follow. " * 9 + "</p>"
    assert html_text.main_text(f"<article><p>Let <math><mi>x</mi>=<mn>1</mn></math> be so. {'More of it. ' * 9}</p></article>").startswith("Let x=1 be so.")
    for page in (f"<article>{end}<p>Icon <svg><path d=1>here</p>{end}</article>", f"<article>{end}<p>Icon <canvas>x</p>{end}</article>",
                 f"<article>{end}<p>Icon <svg><path d=1></p>{end}<svg><title>T</title></svg></article>"):
        assert html_text.main_text(page).count("Words that follow. Words") == 2 * 4 or html_text.main_text(page).count(("Words that follow. " * 9).strip()) == 2
    assert "seen" not in html_text.main_text(f"<article>{end}<svg><title>not seen</title><text>nor seen</text></svg>{end}</article>")


def test_html_stray_tags_in_linear_time():
    for page in ("<div>" * 8000 + "</b>" * 8000, "<div><b>" * 8000 + "</q>" * 8000, '<a "' * 16000, "</div>" * 16000, "<p>x" * 16000 + "</li>" * 16000, '<div class="ad">' * 900 + "<p>x</p>" * 3000):
        start = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - start < 1.5


def test_html_by_hand():
    """Pages without articles, their text told by hand."""
    for page, want in HAND:
        assert html_text.main_text(page) == "\n\n".join(want)


P = [f"Sentence {i} of a paragraph that is as long as paragraphs are, with a clause and another one after it." for i in range(8)]
ITEMS = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(7))
HAND = [
    (f"<body><ul>{ITEMS}</ul><div><h2>Head</h2><p>{P[0]}</p><p>{P[1]}</p></div><div id=footer>foot</div></body>", ["Head", P[0], P[1]]),
    (f"<table><tr><td><ul>{ITEMS}</ul><td><p>{P[0]}<p>{P[1]}<ul><li>{P[2]}<li>{P[3]}</ul></table>", P[:4]),
    (f"<div class=page><div role=navigation>Go</div><blockquote>{P[0]}</blockquote><pre>{P[1]}\n  {P[2]}</pre><div class='comment-list'><p>{P[3]}</p></div></div>", [P[0], f"{P[1]} {P[2]}"]),
    (f"<p>{P[0]}&nbsp;&lt;b&gt; &eacute;&#233;&#xE9;</p><noscript><p>{P[1]}</p></noscript><p hidden>{P[2]}</p><p style='display:none'>{P[3]}</p><p>{P[4]}</p>", [P[0] + " <b> ééé", P[4]]),
    (f"<!-- <p>{P[0]}</p> --><p>{P[1]}</p><p>{P[2]} <!-- no end <p>{P[3]}</p>", [P[1], P[2]]),
]


def test_html_through_spark(spark):
    rows = [(1, "u", "<p>" + P[0], "kept", 7), (2, None, None, None, None), (None, "u", "", "x", 1), (3, "u", "<p>" + "Long words. " * 400_000, None, 2), (3, "u", "<p>" + P[0], "kept", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _text string, n_chars int")
    done = html_text.extract(pages)
    assert done.columns == [*pages.columns, "_text_"]
    assert sorted((r["_text"] or "", len(r["_text_"])) for r in done.collect()) == sorted([("kept", len(P[0])), ("", 0), ("x", 0), ("", 12 * 400_000 - 1), ("kept", len(P[0]))])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a b/", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "WARC/1.1\r\n\r\n\r\nWARC-Type: response"), (5, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"{work_root(spark)}/{tmp_path.name}-{id(tmp_path)}"
    warc.write_archive(warc.archive_rows(pages.selectExpr("*", "'x' as payload", "1 as record_type")), path, file_bytes=300)
    back = {r["record_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert len(back) == 6 and back["urn:page:1"]["record_type"] == "revisit" and back["urn:page:1"]["refers_to"] == "urn:page:2"
    assert back["urn:page:5"]["payload"].decode() == "é" * 100_000 and back["urn:page:null"]["payload"].decode() == rows[4][2]
    assert back["urn:page:3"]["refers_to"] == "urn:page:4" and back["urn:page:1"]["target_uri"] == "http://a%20b/"
    some = warc.read_archive(spark, path, payload=False).where("record_type = 'response' and record_id in ('urn:page:2', 'urn:page:1')").collect()
    assert [(r["record_id"], r["payload"]) for r in some] == [("urn:page:2", None)]


def test_toxicity(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(900):
        text = [words[k] for k in rng.integers(0, 6, 40)]
        if i % 4 == 0:
            text[3:3] = ["you", "grobnak", "idiot"] if i % 8 else ["grobnak", "grobnak"]
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("prediction", F.lit(3))
    done = toxicity.score(data.drop("toxic"), data.where("doc_id % 3 != 1").select("doc_id", "toxic")).join(data.select("doc_id", "toxic"), "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([(r["_score"] >= 0.7) == bool(r["toxic"]) for r in done]) > 0.97
    none = toxicity.score(spark.createDataFrame(DOCS, SCHEMA), data.limit(0).select("doc_id", "toxic")).collect()
    assert {r["_score"] for r in none} == {0.0} and len(none) == len(DOCS)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = set(r["doc_id"] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        now = set(r["doc_id"] for r in docs.collect())
        assert now <= seen and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(r["doc_id"] for r in packed.select("doc_id").collect()) == seen and len(seen) > 100


def plain_quality(docs):
    """The rules once more, without the module's own functions."""
    def fails(line):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        bars = len(re.findall(r"[|•·»›]|\s[>/]\s", line))
        if bars >= 3 and n - bars <= 4 * (bars + 1) or not any(c.isalpha() for c in line):
            return True
        if n < 3 and line.strip(" \t\n\x0b\x0c\r")[-1] not in quality.END_MARKS or sum(c in "#*$%&|<>" for c in line) > 0.3 * n:
            return True
        return n <= 30 and any(x in line.lower() for x in quality.NOTICES)

    kept = {}
    for doc, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        times = collections.Counter(grams)
        hit = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 8)}
        left = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r") and not fails(x)]
        left_words = [w for x in left for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
        if len(words) >= 20 and 100 * len(hit) <= 30 * len(words) and len(left_words) >= 20 and 2 * sum(map(len, left_words)) >= sum(map(len, words)):
            kept[doc] = text
    return kept


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_line_dedup(docs):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for doc, text in docs.items():
        for line in text.split("\n"):
            holders[key(line)].add(doc)
    return {doc: "\n".join(x for x in text.split("\n") if len(key(x)) < 10 or doc == min(holders[key(x)])) for doc, text in docs.items()}


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text))


def plain_near_duplicates(docs):
    sets = {}
    for doc, text in docs.items():
        w = plain_words(text)
        sets[doc] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    of = {doc: doc for doc in docs}  # smallest document of the class
    for a in docs:
        for b in docs:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and of[a] != of[b]:
                one, two = sorted((of[a], of[b]))
                of = {d: one if c == two else c for d, c in of.items()}
    return {doc: text for doc, text in docs.items() if of[doc] == doc}


def plain_decontamination(docs, items):
    windows = set()
    for text in items:
        w = plain_words(text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = {}
    for doc, text in docs.items():
        w = plain_words(text)
        if not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean[doc] = text
    return clean


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = [plain_quality, plain_line_dedup, plain_near_duplicates, lambda d: plain_decontamination(d, items)]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        docs, plain = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema), step(plain)
        rows = docs.collect()
        assert len(rows) == len(plain) and {r["doc_id"]: r["text"] for r in rows} == plain, name
