import gzip
import io
import math
import random
import string
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import block_labeller, decontaminate, html, langid, lm, minhash, mixing, repeats, tokens, topk, warc
from voxloom.llm.common import shared_dir
from voxloom.llm.components import components
from voxloom.llm.html_pages import labelled
from voxloom.llm.suffix_array import suffix_array

from . import brute


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


# ---- 1 top-k


def test_topk_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.01, -0.3, 0.5]) for _ in range(6)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [math.nan] * 6), (303, [math.inf] * 6), (None, [1.0] * 6), (304, []), (350, [0.5, 0.1])]
    d = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    w = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert {r["vec_id"] for r in d.collect()} == set(w)
    got = {}
    for x in topk.top_k(d.where("vec_id % 50 = 0"), d).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    for q in [i for i in w if i % 50 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(w[q], v)), i) for i, v in w.items() if i != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_topk_empty(spark):
    d = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>").withColumn("row", F.lit("clash")))
    assert topk.top_k(d, d).count() == 0
    assert topk.best(np.array([3, 1, 3, 3]), np.array([1, 2, 5, 7]), 2).tolist() == [0, 2]


def test_topk_of_large_components_and_repeated_ids(spark):
    rows = [(50, [1e7, 1.0]), (50, [1.0, 2.0]), (1, [-1e7, 0.5]), (1, [-1e7, 0.5]), (2, [3e38, -3e38]), (3, [0.25, 8e15])]
    d = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("own", F.lit("clash")).withColumn("w", F.lit(1)))
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    w = [(i, [clip(math.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q in (0, 1):
        scores = sorted((-clip(sum(a * b for a, b in zip(w[q][1], w[j][1]))), w[j][0]) for j in range(len(w)) if j != q)
        want += [(50, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = topk.top_k(d.where("vec_id = 50"), d).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_of_many_blocks(spark, monkeypatch):
    """Blocks meet without a join that copies one side for every block of the other."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 24)
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, 0.0, 0.5, -1.0, 0.01]) for _ in range(r.choice([3, 5]))]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(200)]  # ties beyond every block
    d = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = topk.top_k(d.where("vec_id % 5 = 0"), d)
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in out.collect()}
    w = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    queries = [i for i in w if i % 5 == 0]
    assert len(got) == 5 * len(queries)
    for q in queries:
        best = sorted(((-sum(a * b for a, b in zip(w[q], v)), i) for i, v in w.items() if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


# ---- 2 WARC


def test_warc_round_trip(spark):
    long = "ä" * 60
    rows = [(3, "http://a/ b", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", long), (1, "dup", long)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    kinds = {(x["page_id"], x["record_type"], x["refers_to"], x["payload_bytes"]) for x in got}
    assert {(3, "revisit", 1, 120), (1, "response", None, 120), (2, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (None, "revisit", 1, 120)} <= kinds
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_normalise_reads_any_members():
    records = [warc.record(i, "u", bytes([65 + i]) * (70_000 * i), "d", None) for i in range(4)]
    for raw in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(records[0] + records[1][:30]) + gzip.compress(records[1][30:] + records[2] + records[3])):
        out = io.BytesIO()
        index = list(warc.normalise_stream(io.BytesIO(raw), out))
        assert [zlib.decompress(out.getvalue()[o : o + n], warc.GZIP) for o, n, _ in index] == records
    with pytest.raises(EOFError):
        list(warc.normalise_stream(io.BytesIO(gzip.compress(b"".join(records))[:-20]), io.BytesIO()))


# ---- 3 mixing


def water_fill(sizes):
    """The contract's own words: clamp and share again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    clamped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in clamped)
        total = sum(w for s, w in weight.items() if s not in clamped)
        target = {s: 2 * sizes[s] if s in clamped else rest * weight[s] / total for s in order}
        above = {s for s in order if s not in clamped and target[s] > 2 * sizes[s]}
        if not above:
            return target
        clamped |= above


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "c", "d", None, "a", "a"]), r.randrange(0, 50)) for i in range(2000)] + [(None, "e", 5), (1, "a", 7), (1, "a", 7)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash"))
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = water_fill(sizes)
    taken: dict = {}
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
        assert 0 <= x["taken"] <= 2 * x["size"] and (x["size"] == 0 or x["taken"] % x["size"] == 0)
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - want[s]) <= 50 for s in want)
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["last", "full", "whole", "room", "bin", "d", "_draw", "_source", "size2", "Copy of it"]
    d = spark.createDataFrame([(i, "a" if i % 3 else "b", i, *(f"{n}{i}" for n in names)) for i in range(50)], ["doc_id", "source", "size", *names])
    got = mixing.mix(d).collect()
    assert len(got) == 50 and all(x[n] == f"{n}{x['doc_id']}" for x in got for n in names)


def test_mixing_empty_and_zero(spark):
    d = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(d).count() == 0
    d = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert {(x["target"], x["taken"]) for x in mixing.mix(d).collect()} == {(0.0, 0)}


# ---- 4 decontamination

ITEMS = [(1, "What is the tallest mountain on the whole wide earth today? It is Mount Everest in Nepal."), (2, "Name every planet that circles our sun. Mercury Venus Earth Mars Jupiter Saturn."), (3, None), (4, "")]


def test_leaks(spark):
    r = random.Random(4)
    docs = [(i, prose(r, 300)) for i in range(20)]
    docs += [(100, prose(r, 500) + " " + ITEMS[0][1] + " " + prose(r, 90)), (101, ITEMS[1][1].upper()), (102, None), (103, ""), (104, "mountain earth planet sun"), (None, ITEMS[1][1]), (105, "What is the tallest mountain on the whole wide earth today?")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(d, b).collect()}
    assert got == {(100, 1), (101, 2), (None, 2), (105, 1)}
    kept = decontaminate.without_leaks(d.withColumn("score", F.lit("clash")), b)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(docs) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(d, none).count() == 0 and decontaminate.without_leaks(d, none).count() == len(docs)


@pytest.mark.parametrize("n", [60, 130, 300, 1000, 3000])
def test_leaks_of_long_items(spark, n):
    r = random.Random(n)
    item = prose(r, n, 5000) + ". " + prose(r, 12, 5000)
    docs = [(1, item), (2, prose(r, 777, 5000) + " " + item + " " + prose(r, 90, 5000)), (3, prose(r, 2 * n, 5000))]
    b = spark.createDataFrame([(7, item), (8, prose(r, 40, 5000))], "item_id long, text string")
    assert sorted((x["doc_id"], x["item_id"]) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()) == [(1, 7), (2, 7)]


def test_leaks_of_null_and_shared_ids(spark):
    r = random.Random(6)
    texts = [prose(r, 30, 5000) for _ in range(4)]
    b = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3])], "item_id long, text string")
    d = spark.createDataFrame([*enumerate(texts), (9, prose(r, 200, 5000))], "doc_id long, text string")
    assert sorted((x["doc_id"], x["item_id"] or 0) for x in decontaminate.leaks(d, b).collect()) == [(0, 0), (1, 0), (2, 5), (3, 5)]
    assert [x["doc_id"] for x in decontaminate.without_leaks(d, b).collect()] == [9]


@pytest.mark.parametrize("postings", [decontaminate.SHARD_TERMS, 700])
def test_leaks_against_brute_force(spark, monkeypatch, postings):
    """The whole operator against all passages times all pieces, with one shard and with several."""
    monkeypatch.setattr(decontaminate, "SHARD_TERMS", postings)
    r = random.Random(14)
    sizes = [5, 9, 20, 63, 64, 65, 128, 200, 400, 1000, 2000]
    items = [(None if k == 3 else 9007199254740993 + k, prose(r, n, 3000) + (". " + prose(r, 6, 3000) if k % 2 else "")) for k, n in enumerate(sizes)]
    docs = [(k, " ".join([prose(r, r.randrange(300), 3000), *(edited(r, t, e) for _, t in r.sample(items, 1)), prose(r, r.randrange(200), 3000)])) for k, e in enumerate([0, 0, 0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8] * 4)]
    docs += [(100 + k, t) for k, (_, t) in enumerate(items)] + [(200, None), (201, ""), (None, items[2][1]), (202, prose(r, 3000, 3000))]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.leaks(docs, items)
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    assert {(100 + k, i) for k, (i, _) in enumerate(items)} <= want


def test_wand_against_all_scores():
    r = random.Random(5)
    texts = {i: [prose(r, r.randrange(3, 40), 60)] for i in range(150)}
    rows = [{"item_id": i, "term": int(np.uint64(t).view(np.int64)), "w": r.random()} for i, t0 in texts.items() for t in np.unique(decontaminate.hashed(t0[0]))]
    index = decontaminate._shard(texts, {"item": np.array([x["item_id"] for x in rows]), "piece": np.zeros(len(rows), int), "term": np.array([x["term"] for x in rows]), "w": np.array([x["w"] for x in rows])})
    own: dict = {}
    for x in rows:
        own[x["item_id"]] = own.get(x["item_id"], 0) + x["w"]
    for _ in range(60):
        passage = np.unique(decontaminate.hashed(prose(r, 60, 60)))
        terms = [int(k) for k in np.flatnonzero(np.isin(index.terms, passage))]
        held = {int(t.view(np.int64)) for t in passage}
        score: dict = {}
        for x in rows:
            if x["term"] in held:
                score[x["item_id"]] = score.get(x["item_id"], 0) + x["w"] / own[x["item_id"]]
        want = {i for i, s in score.items() if s >= 0.5}
        got = {index.items[i] for k in range(index.greatest.shape[1]) for i, _ in decontaminate.wand(index, terms, 0.5, k)}
        assert got == want


# ---- 5 HTML


def test_blocks_of_bad_markup():
    page = "<p>a &amp; b<b>c<br>d<p>e<script>if (a<b) {}</script><!-- x --><ul><li>f<li>g</ul></div>h<textarea>no</textarea><p"
    assert [b.text for b in html.blocks(page)] == ["a & bc d", "e", "f", "g", "h"]
    assert html.blocks("") == [] and html.blocks("<<<>>") != None  # noqa: E711
    assert [b.text for b in html.blocks("x" * 100_000)] == ["x" * 100_000]


def test_blocks_after_unclosed_elements():
    of = lambda page: [b.text for b in html.blocks(page)]
    assert of("<p>a</p><button>Share<p>Article text<p>more") == ["a", "Article text", "more"]
    assert of("<div>x<select><option>A<option>B</div><p>Article") == ["x", "Article"]
    assert of("<header><object><embed>old</header><p>Article <button>no</button> text") == ["Article text"]
    assert of("<button>one<p>kept<button>two</button> end") == ["kept end"]
    assert of("<svg><path/><text>no</text></svg>b<object>c<object>d</object>e</object>f") == ["b f"]
    assert of("a<![CDATA[ b > c <p>d") == ["a c", "d"] and of("a<![CDATA[ <p>b ]]>c") == ["ac"]
    assert of("a<script>var x = '<p>no") == ["a"] and of("a<textarea>b</textarea>c") == ["a c"]
    assert len(of("<button>" * 3000 + "<p>x" * 3000)) == 3000


#: Hand-written pages in styles the training pages do not have, with their main text.
PAGES = [
    ("""<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Home</a> <a href="/n">News</a></header>
<nav><ul><li><a href="/a">Sports</a><li><a href="/b">Weather</a></ul></nav><main><article><h1>River levels fall after a dry spring</h1>
<p>Water levels along the upper river fell by a third of a metre in April, the agency said on Monday, after the driest spring in twenty years.</p>
<p>Farmers near the delta have been asked to water their fields at night, and two locks stay closed until further notice.</p></article></main>
<footer><p>&copy; 2024 All rights reserved. <a href="/privacy">Privacy policy</a></p></footer></body></html>""",
     "River levels fall after a dry spring\nWater levels along the upper river fell by a third of a metre in April, the agency said on Monday, after the driest spring in twenty years.\nFarmers near the delta have been asked to water their fields at night, and two locks stay closed until further notice."),
]


def test_extract_in_spark(spark):
    rows = [(9007199254740993, "u1", PAGES[0][0]), (None, None, PAGES[0][0]), (3, "u", None), (4, "u", ""), (9007199254740993, "u1", PAGES[0][0]), (5, "u", "<p>")]
    got = block_labeller.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).coalesce(1)).collect()
    assert [tuple(x) for x in got] == [(i, u, (t := PAGES[0][1] if h == PAGES[0][0] else ""), len(t)) for i, u, h in rows]
    empty = block_labeller.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="<>/ap='\"!- b&;", max_size=60))
def test_blocks_never_fail(page):
    html.blocks(page)


def test_words_of_long_blocks_are_read():
    text = "Prose that goes on for long. " * 40
    first, second = (html.blocks(f"<p>{text}{last}</p>") for last in ("subscribe", "delta"))
    assert len(first[0].text) > 1000 and len(block_labeller.word_places(first[0])) == 7
    words = slice(block_labeller.PATH + block_labeller.LEAF, -block_labeller.SHAPE)
    a, b = (block_labeller.features(p)[0, words] for p in (first, second))
    assert (a != b).any() and abs(a.sum() - 1) < 1e-6
    own = block_labeller.Labeller()
    for d, got in zip((own.f, own.r), own.project(first)):
        assert np.allclose(got, block_labeller.features(first) @ d.wx + d.b, atol=1e-4)


def test_labeller_on_held_out_pages():
    own = block_labeller.Labeller().train(labelled(250), epochs=5)
    test = labelled(60, seed=77)
    got = own.labels([[b for b, _ in p] for p in test])
    right = sum(int((g == np.array([y for _, y in p])).sum()) for g, p in zip(got, test))
    assert right / sum(map(len, test)) > 0.97
    one = own.labels([[b for b, _ in test[0]]])[0]
    assert (one == got[0]).all()  # a page's labels do not depend on its batch
    page = [b for b, _ in test[0]]
    x = block_labeller.features(page)
    for d, g in zip((own.f, own.r), own.project(page)):
        assert np.allclose(x @ d.wx + d.b, g, atol=1e-4)
    assert block_labeller.main_texts([None, "", "<p>"], own) == ["", "", ""]


# ---- 6 MinHash


def edited(r, text, share):
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(6)
    docs = []
    for g in range(12):
        base = prose(r, r.choice([5, 30, 80, 200]), 5000)
        docs += [edited(r, base, s) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    docs += ["", None, "   ", "one two", "ONE  two", "one two three", "x" * 5000, "Ä b c d e f", "ä b c d e f", "a b c d e f", "A B C D E F"]
    rows = list(enumerate(docs))
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("kept", F.lit("clash"))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(d).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    d = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(d).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)]


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in root and b in root and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


# ---- 7 LM


def test_log_probs_against_plain_loops():
    net = lm.Net.new(8)
    r = np.random.default_rng(1)
    tokens = r.integers(0, 64, 300)
    net.start_at(tokens)
    net.weights[2][:] = r.standard_normal(lm.HIDDEN)
    around, token, of = next(lm.windows([(0, tokens[:200]), (1, tokens[200:])], 63))
    got = net.log_probs(around, token)
    emb, w1, b1, wc, bc, wm, bm = (w.astype(float) for w in net.weights)
    for text, lp in ((tokens[:200], got[:200]), (tokens[200:], got[200:])):
        for i, t in enumerate(text):
            x = [v for k in (-2, -1, 1, 2) for v in emb[text[i + k] if 0 <= i + k < len(text) else 63]]
            z = [b1[j] + sum(x[k] * w1[k, j] for k in range(len(x))) for j in range(lm.HIDDEN)]
            h = [v / (1 + abs(v)) for v in z]
            c, m = divmod(int(t), 8)
            one = [bc[j] + sum(h[k] * wc[k, j] for k in range(lm.HIDDEN)) for j in range(8)]
            two = [bm[c, j] + sum(h[k] * wm[c, k, j] for k in range(lm.HIDDEN)) for j in range(8)]
            want = one[c] - math.log(sum(map(math.exp, one))) + two[m] - math.log(sum(map(math.exp, two)))
            assert lp[i] == pytest.approx(want, abs=1e-4)
    everything = np.repeat(around[:1], 64, axis=0)
    assert np.exp(net.log_probs(everything, np.arange(64))).sum() == pytest.approx(1, abs=1e-4)
    assert all(np.array_equal(x, y) for x, y in zip(net.weights, lm.Net.unpack(net.pack(), 8).weights))


def test_step_follows_the_gradient():
    """A step with small rate moves every weight against the loss's numeric gradient."""
    net = lm.Net.new(4)
    net.squares = [np.full_like(s, 1e6) for s in net.squares]  # then a step is rate * gradient / 1000
    r = np.random.default_rng(2)
    around, token = r.integers(0, 16, (50, 4)).astype(np.int32), r.integers(0, 16, 50)
    before = [w.copy() for w in net.weights]
    net.step(around, token, 1.0)
    for k, (w, old) in enumerate(zip(net.weights, before)):
        at = np.unravel_index(np.abs(w - old).argmax(), w.shape)
        loss = []
        for d in (1e-2, -1e-2):
            other = lm.Net(4, [x.copy() for x in before], net.squares)
            other.weights[k][at] += d
            loss.append(-other.log_probs(around, token).sum())
        assert (old - w)[at] * 1000 == pytest.approx((loss[0] - loss[1]) / 2e-2, rel=0.05), k


def test_lm_is_far_above_word_frequencies(spark):
    """Texts that training has not seen, in nats a token, with frequencies over the same places as the floor."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null").dropDuplicates(["text"])
    seen, held = docs.where("crc32(text) % 5 > 0"), docs.where("crc32(text) % 5 = 0")
    words = lm.vocabulary(seen)
    ids = lm.encoded(seen, words)
    net = lm.train(ids, words)
    tokens = np.concatenate([np.frombuffer(x["ids"], words.kind) for x in ids.collect()])
    n = np.bincount(tokens, minlength=words.side**2) + 0.5
    floor = np.log(n / n.sum())
    texts = [np.frombuffer(x["text"].encode(), np.uint8) for x in held.collect()]
    t = np.concatenate([words.of(x) for x in texts if len(x)])
    got = lm.score(held, words, net).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    assert got[1] == len(t) and got[0] / got[1] > floor[t].mean() + 0.7
    backwards = spark.createDataFrame([(" ".join(random.Random(i).sample(w, len(w))),) for i, w in enumerate(x.tobytes().decode().split() for x in texts) if w], "text string")
    shuffled = lm.score(backwards, words, net).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
    assert shuffled[0] / shuffled[1] < got[0] / got[1]


def test_lm_scores_do_not_depend_on_partitions(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["the cat sat", "a dog ran", "on the mat", f"w{r.randrange(300)}"]) for _ in range(120))) for i in range(80)] + [(100, None), (101, ""), (None, "the cat sat"), (5, "again"), (5, "again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash"))
    seen = []
    for dealt in (d.coalesce(1), d.repartition(7), d.orderBy(F.desc("text"))):
        words = lm.vocabulary(dealt)
        ids = lm.encoded(dealt, words)
        seen.append(sorted(lm.score_encoded(ids, words, lm.train(ids, words)).collect(), key=str))
    for x, y, z in zip(*seen):
        assert x[:2] == y[:2] == z[:2] and x[2] == pytest.approx(y[2], rel=1e-4) == pytest.approx(z[2], rel=1e-4)
    got = {x["doc_id"]: x for x in seen[0]}
    assert got[100]["n_tokens"] == 0 and got[100]["log_prob"] == 0 and got[101]["mean_log_prob"] is None and got[None]["n_tokens"] == 3
    again = [x for x in seen[0] if x["doc_id"] == 5 and x["n_tokens"] == 1]
    assert len(again) == 2 and again[0][2] == pytest.approx(again[1][2], rel=1e-5)
    net = lm.train(ids, words)
    kept = lm.score(d.withColumn("log_prob", F.lit("clash")), words, net)
    assert kept.columns == ["doc_id", "text", "h", "n_tokens", "log_prob", "mean_log_prob"]
    assert {(x["doc_id"], x["n_tokens"], round(x["log_prob"], 2)) for x in kept.collect()} == {(x["doc_id"], x["n_tokens"], round(x["log_prob"], 2)) for x in lm.score_encoded(ids, words, net).collect()}
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = lm.vocabulary(empty)
    assert lm.score_encoded(lm.encoded(empty, none), none, lm.train(lm.encoded(empty, none), none)).count() == 0


def test_lm_windows_in_pieces():
    """Every position of every text once, with its own neighbours, also where a text is cut."""
    r = np.random.default_rng(3)
    rows = [r.integers(0, 60, n) for n in (1, 2, 3, 50_000, 1, 7, 2 * lm.PIECE)]
    want = [[63 if not 0 <= i + k < len(x) else x[i + k] for k in (-2, -1, 1, 2, 0)] + [j] for j, x in enumerate(rows) for i in range(len(x))]
    got = [np.concatenate([a, t[:, None], np.asarray(o)[:, None]], axis=1) for a, t, o in lm.windows(enumerate(rows), 63)]
    assert np.array_equal(np.concatenate(got), np.array(want)) and max(map(len, got)) <= 2 * lm.PIECE
    assert [len(x) for x in got]


def test_lm_vocabulary_grows(spark):
    words = lm.vocabulary(spark.createDataFrame([("a b c",)], "text string"))
    assert words.side == 40 and len(words.hashes) == 3
    assert [lm.side_of(n) for n in (0, 10**6, 10**8, 10**10, 10**13)] == sorted(lm.side_of(n) for n in (0, 10**6, 10**8, 10**10, 10**13)) and lm.side_of(10**10) > 64 and lm.side_of(10**13) > 128
    large = lm.Words(words.hashes, words.tokens, 264)
    assert large.kind == "<u4" and large.of(np.frombuffer(b"A a nowhere Somewhere", np.uint8)).max() < 264**2
    a, b = large.of(np.frombuffer("Xhaus yhAus".encode(), np.uint8)), large.of(np.frombuffer("zzus qqqqus".encode(), np.uint8))
    assert a[0] == a[1] and b[0] != a[0]  # rare words go by their ends


# ---- 8 language ID


def test_language_id(spark):
    r = random.Random(9)
    sy = {"xx": ["ba", "do", "ki", "zu"], "yy": ["été", "ça", "oui", "que"], "zz": ["ß", "sch", "ung", "ein"]}
    make = lambda x, n: " ".join("".join(r.choice(sy[x]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, make(x := r.choice(list(sy)), r.choice([20, 60])), x) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(d.where("doc_id < 200"))
    test = spark.createDataFrame([*rows[200:], (400, None, None), (401, "123 ...", "xx"), (402, "漢字漢字漢字漢字", None), (403, make("xx", 400_000), "xx"), (404, "", None)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.predict(test, model).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x in rows[200:]]) > 0.97 and not any(got[i]["rejected"] for i, _, _ in rows[200:])
    assert got[400]["lang_pred"] == got[401]["lang_pred"] == got[404]["lang_pred"] == "und" and got[402]["rejected"] and got[403]["lang_pred"] == "xx"
    none = langid.fit(d.where("false"))
    assert {x["lang_pred"] for x in langid.predict(test, none).collect()} == {"und"}


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_grams_against_plain_loops(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    r = random.Random(15)
    for text in ("", "a", "ab", "Ab 12 cd", "ÉÀ été 漢字 x", "".join(r.choice("aB é1É. ") for _ in range(500))):
        got = langid.gram_counts(np.frombuffer(text.encode(), np.uint8))
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == brute.grams(text.encode())


def test_language_prediction_against_plain_loops(spark):
    """All documents of the smallest table, by the query's own model, against plain sums."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 3 > 0"))
    got = langid.predict(docs, model).where("lang_pred <> 'und'").collect()
    assert len(got) > 150
    for x in got:
        lang, score = brute.nearest_centroid(x["text"], model)
        assert x["score"] == pytest.approx(min(1, max(0, score)), abs=1e-4) and x["lang_pred"] == lang


def test_language_rejection(spark):
    """Held-out texts of every length are kept; other scripts, languages and random strings are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where("doc_id % 4 <> 0"))
    kept = langid.predict(docs.where("doc_id % 4 = 0"), model).agg(F.avg(F.col("rejected").cast("int")), F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert kept[0] < 0.02 and kept[1] > 0.98
    r = random.Random(5)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. "
    odd = ["!?.," * 125 + "a"]
    for n in (30, 100, 300, 1000, 4000):
        odd += [some("0123456789abcdef", n), some(string.ascii_letters + string.digits + "+/", n), some(string.ascii_lowercase, n), some([chr(c) for c in range(0x4E00, 0x9FA5)], n), some("абвгдежзийклмнопрстуфхцчшщыьэюя    ", n), (polish * 40)[:n]]
    seen = langid.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert [x["text"][:40] for x in seen if not x["rejected"]] == []


def test_language_of_many_copies_is_learned(spark):
    """A language of few texts, each copied many times, has as many rows as others and is learned."""
    r = random.Random(3)
    make = lambda sy, n: " ".join("".join(r.choice(sy) for _ in range(3)) for _ in range(n))
    few = [make(["ba", "do", "ki", "zu"], 30) for _ in range(3)]
    rows = [(few[i % 3], "xx") for i in range(30_000)] + [(make(["sch", "ung", "ein"], 20), "zz") for _ in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample=100)
    assert set(model.langs) == {"xx", "zz"}
    got = langid.predict(spark.createDataFrame([(few[0],), (make(["ba", "do", "ki", "zu"], 30),)], "text string"), model).collect()
    assert [x["lang_pred"] for x in got] == ["xx", "xx"]


# ---- 9 token shards


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(tokens.feistel(np.arange(n), n).tolist()) == list(range(n))


@pytest.mark.parametrize("kind, kinds, n", [("<u2", 1, 1), ("<u2", 192, 3000), ("<u2", 5000, 300_000), ("<u2", 65_000, 300_000), ("<u4", 100_000, 400_000), ("<u4", 700_000, 700_000)])
def test_packed_ids(kind, kinds, n):
    import zstandard

    z, unz, r = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), np.random.default_rng(kinds)
    often = r.permutation(kinds)[(np.minimum(r.pareto(1.0, n), kinds - 1)).astype(np.int64)]
    ids = np.concatenate([often, r.permutation(kinds)]).astype(kind)
    for x in (ids, ids[:0]):
        got = tokens.unpack(tokens.pack(x, z), kind, unz)
        assert got.dtype == x.dtype and (got == x).all()
    if kinds == 5000:  # words of a corpus
        assert len(tokens.pack(ids, z)) < 0.9 * len(z.compress(ids.tobytes()))


def test_shards_round_trip(spark):
    r = random.Random(10)
    docs = [(i, prose(r, r.randrange(1, 300))) for i in range(40)] + [(50, None), (51, ""), (None, "no id"), (1, "twice"), (1, "twice")]
    folder = shared_dir(spark) + "/test-shards"
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("slot", F.lit("clash")).withColumn("task", F.lit("clash"))
    out = tokens.shards(d, folder, stride=32, per_shard=64)
    assert tokens.read_shard(folder, 0).shape == (64, 32)  # written before any action
    got = out.collect()
    assert sorted(x["slot"] for x in got) == list(range(len(got)))
    parts: dict = {}
    enc = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    for x in got:
        rec = tokens.read_shard(folder, x["shard"], x["offset"] // 64)[0]
        assert zlib.crc32(np.ascontiguousarray(rec)) == x["crc32"] and x["slot"] == x["shard"] * 64 + x["offset"] // 64
        assert (rec[x["n_tokens"] :] == tokens.pad_of(enc.kind)).all()
        parts.setdefault(x["doc_id"], []).append((x["seq"], rec[: x["n_tokens"]].tolist()))
    for i, t in docs:
        if t and i != 1:
            ids = [k for _, p in sorted(parts[i]) for k in p]
            assert ids[-1] == enc.end and enc.split.decode(ids[:-1]) == t
    assert 50 not in parts and 51 not in parts and len([s for s, _ in parts[1] if s == 0]) == 3
    empty = tokens.shards(spark.createDataFrame([], "doc_id long, text string"), folder + "-none")
    assert empty.count() == 0 and empty.columns == out.columns


def test_slots_are_numbers_in_order_of_documents(spark):
    """The whole operator against plain loops: same slots however the rows are dealt."""
    r = random.Random(12)
    docs = [(r.randrange(-50, 10**6), prose(r, r.randrange(1, 200))) for _ in range(150)] + [(None, "no id " * 40), (7, "a " * 70), (7, "b " * 70)]
    enc = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    d = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = {x["text"]: x["h"] for x in d.select("text", F.xxhash64("text").alias("h")).collect()}
    want, number = {}, 0
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]])):
        ids = enc.split.encode_ordinary(t) + [enc.end]
        for k in range(-(-len(ids) // 32)):
            part = ids[32 * k : 32 * k + 32]
            want[number] = (i, k, len(part), zlib.crc32(np.array(part + [0xFFFF] * (32 - len(part)), "<u2")))
            number += 1
    slots = tokens.feistel(np.arange(number), number).tolist()
    want = {slots[n]: x for n, x in want.items()}
    for dealt in (d.coalesce(1), d.repartition(3), d.orderBy(F.desc("text")).repartition(7)):
        got = tokens.shards(dealt, stride=32, per_shard=50).collect()
        assert {x["slot"]: (x["doc_id"], x["seq"], x["n_tokens"], x["crc32"]) for x in got} == want and len(got) == number


WHITE = [" ", "\t", "\u3000", "\u2003", "\n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a", "don't", " the", "12", "\x1c", "!?", "é"]), st.tuples(st.sampled_from(WHITE), st.integers(1, 12)).map(lambda x: x[0] * x[1])), max_size=12))
def test_runs_of_white_space_are_encoded_as_in_the_whole(parts):
    enc, text = tokens.encoder(open(tokens.VOCABULARY, "rb").read()), "".join(parts)
    before = tokens.LONG, tokens._RUNS
    tokens.LONG, tokens._RUNS = 3, tokens.re.compile(f"[{tokens.WHITE}]{{3,}}")
    try:
        assert enc.ids(text).tolist() == enc.split.encode_ordinary(text) + [enc.end]
    finally:
        tokens.LONG, tokens._RUNS = before


def test_very_long_texts_are_encoded():
    enc = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    for text in (" " * 1_000_000, "a" * 1_000_000, "x" + "\n" * 1_000_000 + "y", "!" * 1_000_000, "ab " * 400_000):
        assert enc.split.decode(enc.ids(text)[:-1].tolist()) == text
    assert tokens.kind_of(65534) == "<u2" and tokens.kind_of(65535) == "<u4" and tokens.pad_of("<u4") == 2**32 - 1


# ---- 10 suffix arrays and repeats


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(t):
    assert suffix_array(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeats_against_brute_force(spark):
    r = random.Random(11)
    shared = [prose(r, 12, 5000) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [r.choice([prose(r, r.randrange(1, 30), 5000), r.choice(shared), r.choice(shared)[: r.randrange(30, 70)], "ä" * r.randrange(60), "\0" * 55]) for _ in range(r.randrange(5))]
        docs.append((i * 3 % 61, "".join(parts)))
    docs += [(100, docs[3][1]), (101, None), (102, ""), (103, "a" * 400), (104, "a" * 49), (105, "a" * 50), (106, "ab" * 100), (107, prose(r, 4000, 9000))]
    docs.append((108, docs[-1][1][:20_000] + "!" + docs[-1][1][20_001:]))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("frame", F.lit("clash")).repartition(5)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.without_repeats(d).collect()}
    assert got == brute.repeats(docs)


def test_repeats_edges(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "x" * 30 + "y" * 30
    got = repeats.without_repeats(spark.createDataFrame([(None, t), (5, t), (5, t)], "doc_id long, text string")).collect()
    assert sorted((str(x["doc_id"]), x["n_removed"]) for x in got) == [("5", 0), ("5", 0), ("None", 60)]


@pytest.mark.parametrize("wide", [40, 1 << 40])
def test_repeats_at_the_edges_of_a_frequent_passage(monkeypatch, wide):
    """Frames and buckets in one process: no suffix array and, of wide anchors, no group grows with the documents that hold a passage."""
    import zstandard

    arrays: list = []
    monkeypatch.setattr(repeats, "suffix_array", lambda t: arrays.append(len(t)) or suffix_array(t))
    monkeypatch.setattr(repeats, "SA_BATCH", 1000)
    monkeypatch.setattr(repeats, "LARGE", 30, raising=False)
    monkeypatch.setattr(repeats, "WIDE", wide)
    monkeypatch.setattr(repeats, "FEW", 2)
    monkeypatch.setattr(repeats, "SLICE", 50)
    r = random.Random(12)
    shared = [prose(r, 25, 5000), "ab " * 40]
    noise = lambda: "".join(r.choice("abcdefghij ") for _ in range(r.randrange(60)))
    docs = [(i * 7 % 401, noise() + r.choice(shared)[: r.choice([40, 75, 500])] + noise()) for i in range(400)]
    frames = []
    for k in range(0, 400, 20):
        raw = [t.encode() for _, t in docs[k : k + 20]]
        frames.append({"frame": k, "docs": [d for d, _ in docs[k : k + 20]], "sizes": list(map(len, raw)), "data": zstandard.compress(b"".join(raw))})
    frames, buckets = pd.DataFrame(frames), 3
    each = lambda rows, judge: pd.concat([judge(own) for _, own in rows.groupby("bucket")])
    gathered = lambda rows: frames["frame"].map({k: own.to_dict("records") for k, own in rows.groupby("frame")})
    frames["masks"] = gathered(each(pd.concat(repeats._send_anchors(buckets)([frames])), repeats._repeated))
    entries = pd.concat(repeats._send_entries(buckets)([frames]))
    frames["judged"] = gathered(each(entries, repeats._judge))
    got = pd.concat(repeats._cut(buckets)([frames]))
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.itertuples()} == brute.repeats(docs)
    assert max(arrays) < 1000 + 30 * 81
    if wide == 40:
        sent = np.concatenate([repeats._load(zstandard.decompress(x))["h"] for x in entries["entries"]])
        assert np.unique(sent, return_counts=True)[1].max() < 4 * 40
