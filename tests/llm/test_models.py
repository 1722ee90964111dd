"""Pieces, toxicity, quality, pages, media and shards: exactness, odd rows, held-out accuracy."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from barloom.llm import common, html_text, jpeg, media, pieces, quality, sharding, toxicity
from barloom.llm import queries as registered

from . import brute
from .test_text import CLASH, LONG, corpus

ODD = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "b\n\nc"), (5, LONG), (6, "▁ literal ▁▁ 🙂\u0000"), (7, "x" * 3000)]
MORE = CLASH + ["text_crc32", "size", "shard", "slot", "score", "media", "payload", "ids", "lossless", "p_toxic", "labels"]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in MORE})


@pytest.fixture(scope="module")
def words():
    return pieces.load()


def test_pieces_without_dropout_are_the_models(words):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t in corpus() if t] + ["x" * 100 + " a" * 3]
    ids, first = pieces.Encoder(words, 0.0, 1).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [sp.encode(t) for t in texts]


def test_dropout_follows_the_agenda(words):
    """Steps in numpy, the heap and a plain loop over candidates give the same pieces, also with few units kept."""
    merges = {divmod(k, words.base): (r, words.made[r]) for k, r in words.merges.items()}
    texts = [t.encode() for _, t in corpus() if t and len(t) < 4000] + [("ab" * 50 + "c").encode(), "▁ 🙂\u0000 naïve 🙂🙂".encode()]
    for most in (pieces.KEPT_UNITS, 40):
        e = pieces.Encoder(words, 0.3, 5, most)
        got = [e.encode(texts[i : i + 5]) for i in range(0, len(texts), 5)]
        found = [ids[a:b].tolist() for ids, first in got for a, b in zip(first[:-1], first[1:], strict=True)]
        for raw, ids in zip(texts, found, strict=True):
            units, want = e.units_of(raw.decode()), []
            for u, key in zip(units, e.keys_of(raw, len(units)), strict=True):

                def skip(a, b, c, key=key):
                    return bool(pieces.skipped(np.array([key]), np.array([pieces._candidate(a, b, c)]), 0.3)[0])

                own = brute.bpe([words.chars.get(c, words.base - 1) for c in u], merges, words.pieces, skip)
                assert e.heap(u, int(key)) == brute.spelt(own, u, words)
                want += brute.spelt(own, u, words)
            assert ids == want
    other, _ = pieces.Encoder(words, 0.3, 6).encode(texts)
    assert other.tolist() != [i for f in found for i in f]


def test_occurrences_of_a_word_are_cut_in_many_ways(words):
    e = pieces.Encoder(words, 0.3, 5)
    one, _ = e.encode([("international " * 2000).encode()])
    two, _ = e.encode([("international " * 2000 + "x").encode()])
    assert one[:4000].tolist() != two[:4000].tolist()  # by text, not only by place
    cuts = set()
    for k in range(300):
        ids, _ = e.encode([f"international {k}".encode()])
        cuts.add(tuple(ids[:-1].tolist()))
    assert len(cuts) > 12


def test_pieces_of_odd_rows_decode(spark):
    for alpha in (0.0, 0.5):
        out = pieces.encode_texts(odd(spark), carry=["doc_id"], alpha=alpha).collect()
        assert len(out) == len(ODD) and all(r["lossless"] for r in out)
    assert pieces.encode_texts(odd(spark, []), carry=["doc_id"]).collect() == []


def test_toxicity_finds_held_out_toxic_rows(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    labels = common.table(spark, "/root/testdata/sf0.1", "labels")
    chain = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    scored = toxicity.score(docs, chain, carry=["doc_id"]).select("row.doc_id", "p_toxic").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = [(r["p_toxic"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in scored]
    assert sum(right) / len(right) > 0.97
    assert not any(r["p_toxic"] >= toxicity.THRESHOLD for r in scored if r["toxic"] == 0)


def test_toxicity_needs_no_given_vocabulary(spark):
    """Invented toxic stems of two scripts, one of them in 4 of 2,000 rows: every group feeds the chain, rare rows are found."""
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("abdegiklmnorstu"), 6)) for _ in range(300)]
    rows = []
    for i in range(2000):
        stem = {0: "вжщю", 1: "zqxw", 2: "вжщю", 3: "zqxw"}.get(i % 40, "") if i >= 4 else "ψφξθ"
        toxic = [stem + plain[(i * 7 + k) % 300] for k in range(2)] if stem else []
        rows.append((i, " ".join([*rng.choice(plain, 12), *toxic]), int(bool(stem))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert len(chain.names) > 2 and chain.names[-1] == "toxic"
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain, carry=["doc_id"]).select("row.doc_id", *[f"p_{n}" for n in chain.names]).collect()}
    assert all(any(r[f"p_{n}"] >= toxicity.THRESHOLD for r in got.values()) for n in chain.names)
    assert all((got[i]["p_toxic"] >= toxicity.THRESHOLD) == (y == 1) for i, _, y in rows)


def test_terms_of_words_do_not_cross_words_or_texts():
    texts = ["ab  ça.", "", " ça"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    together, text = toxicity.term_hashes(data, offsets)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        alone = toxicity.term_hashes(raw, np.array([0, len(raw)]))[0]
        assert sorted(together[text == i].tolist()) == sorted(alone.tolist())
    # "ça": the word, " ç", "ça", "a ", " ça", "ça ", " ça "
    assert (text == 2).sum() == 7 and (text == 0).sum() == 14


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        chain = toxicity.fit(odd(spark), given)
        assert toxicity.score(odd(spark), chain, carry=["doc_id"]).count() == len(ODD)
        assert toxicity.score(odd(spark, []), chain).collect() == []


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.stack(((x[:, 0] > 0), (x[:, 1] > 0)), 1).astype(float)
    weights = toxicity.fit_chain(x, y, np.arange(300) % 3)
    assert [len(w) for w in weights] == [4, 5]
    assert ((toxicity.apply_chain(x, weights) > 0.5) == (y == 1)).mean() > 0.95


def test_quality_held_out(spark):
    out = registered.QUERIES["op6_line_crf"](spark, "/root/testdata/sf0.01")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_lines_of_mixed_documents_get_mixed_labels(spark):
    """Lines of good and of bad held-out documents in one text: each keeps its kind, wherever it stands."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    field = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").where("n_chars between 800 and 6000").orderBy("doc_id").collect()
    parts = {k: [[x for x in r["text"].split("\n") if len(x) > 80][:4] for r in held if r["quality"] == k] for k in (0, 1)}
    parts = {k: [p for p in v if len(p) >= 3] for k, v in parts.items()}
    mixed = [(i, "\n".join([*g, *b] if i % 2 else [*b, *g]), [1] * len(g) + [0] * len(b) if i % 2 else [0] * len(b) + [1] * len(g)) for i, (g, b) in enumerate(zip(parts[1], parts[0], strict=False))]
    assert len(mixed) > 5
    want = {i: w for i, _, w in mixed}
    got = quality.line_scores(spark.createDataFrame([m[:2] for m in mixed], "doc_id long, text string"), field).collect()
    right = [(p > 0.5) == (w == 1) for r in got for p, w in zip(r["good"], want[r["row"]["doc_id"]], strict=True)]
    assert sum(right) / len(right) > 0.9
    assert all(min(r["good"]) < 0.5 < max(r["good"]) for r in got)
    assert quality.line_scores(odd(spark), field, carry=["doc_id"]).where("size(good) = 0").count() == 0


def test_line_labels_keep_half_a_document():
    good, size, first = np.array([0.9, 0.1, 0.95, 0.99, 0.99]), np.array([10, 100, 20, 50, 60]), np.array([0, 3, 5])
    assert quality.relabelled(good, size, first, np.array([0, 0])).tolist() == [1, 0, 1, 1, 0]
    assert quality.relabelled(good, size, first, np.array([1, 1])).tolist() == [1, 1, 1, 1, 1]


def test_quality_matches_brute_force(spark):
    """Scores of the query against plain loops over lines, words and labels."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (common.table(spark, sf, t) for t in ("documents", "labels"))
    field = quality.fit(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in registered.QUERIES["op6_line_crf"](spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        want = brute.quality_score(field, (texts[r["doc_id"]] or "").encode())
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_matches_brute_force(spark):
    """Probabilities of the query against plain loops over words, n-grams and links."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    chain = toxicity.fit(docs, common.table(spark, sf, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in registered.QUERIES["op7_classifier_chain"](spark, sf).collect():
        want = brute.toxicity(chain, (texts[r["doc_id"]] or "").encode())
        assert all(abs(r[f"p_{n}"] - w) < 2e-6 for n, w in zip(chain.names, want, strict=True))
        assert r["toxic"] == (r["p_toxic"] >= toxicity.THRESHOLD)


def test_shards_match_brute_force(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in common.table(spark, sf, "documents").collect()}
    slots = {}
    for r in registered.QUERIES["op10_weighted_tree"](spark, sf).collect():
        raw = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == brute.shard(sharding.grid_tree(8), r["doc_id"]) and r["grown_shard"] == brute.shard(sharding.grid_tree(9), r["doc_id"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(map(len, slots.values())) == len(docs)


def test_quality_fit_of_long_texts(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = common.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    long = spark.createDataFrame([(-1, "\n".join(f"line {i} of a log | {i * 7}" for i in range(60_000)))], "doc_id long, text string")
    drawn = []
    plain = quality.fit_field
    monkeypatch.setattr(quality, "fit_field", lambda x, size, first, label: drawn.append((len(x), int(np.diff(first).max()))) or plain(x, size, first, label))
    monkeypatch.setattr(quality, "FIT_LINES", 20_000)
    began = time.time()
    field = quality.fit(docs.unionByName(long), labels.union(spark.createDataFrame([(-1, 0)], labels.schema)))
    assert time.time() - began < 60 and np.isfinite(field.weights).all()
    assert 10_000 < drawn[0][0] < 30_000 and drawn[0][1] <= quality.PIECE_LINES
    text, piece, cuts = quality.pieces_of(np.array([0, 1, 3000, 4024]))
    assert text.tolist() == [0, 1, 1, 1, 2] and piece.tolist() == [0, 0, 1, 2, 0] and cuts[[0, 1, -2, -1]].tolist() == [0, 1, 3000, 4024]


def test_quality_fit_matches_enumeration():
    r = np.random.default_rng(5)
    first = np.concatenate(([0], np.cumsum(r.integers(1, 6, 10))))
    x, y = r.normal(size=(first[-1], 3)), r.integers(0, 2, first[-1]).astype(float)
    for chains in (True, False):
        field = quality.fit_labels(x, first, y, steps=15, chains=chains)
        weights, ties = brute.quality_fit(x, first, y, 15, chains, quality.RIDGE, quality.TIE_RIDGE)
        assert np.allclose(field.weights, weights, atol=1e-9) and np.allclose(field.transitions, ties, atol=1e-9)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (1, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        out = quality.score(odd(spark), quality.fit(odd(spark), given), carry=["doc_id"]).collect()
        assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.score(odd(spark, []), quality.Field(np.zeros(43), np.zeros((2, 2)))).collect() == []


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    e, t = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for k in range(32):
        y = [(k >> i) & 1 for i in range(5)]
        weight[tuple(y)] = np.exp(sum(e[i] * y[i] for i in range(5)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
    z = sum(weight.values())
    good, pairs = quality.marginals(e, np.array([0, 5]), t)
    assert np.allclose(good, [sum(w for y, w in weight.items() if y[i]) / z for i in range(5)])
    assert np.allclose(pairs[0, 1], sum(w * sum(a == 0 and b == 1 for a, b in zip(y, y[1:], strict=False)) for y, w in weight.items()) / z)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav>
<div class="promo-x"><ul><li>Same list</ul></div><div><h1>Title &amp; more</h1><p>One<br>two  <b>bold</b><script>var t="</p>";</script>
<p>Text &lt;%d&gt;<ul><li>a<li>b</ul><div class="comments">nice</div><form>f</form><footer>foot</footer></div></body></html>"""


def test_pages_lose_furniture_and_template(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % i) for i in range(6)]
    rows += [(6, None, None), (7, "http://h.example/7", ""), (8, "http://h.example/8", "<article>A<p>x<aside>no</aside><p>y <tr"), (9, "::", "plain &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "host", "marks", "row", "mark")})
    got = {r["row"]["page_id"]: r["text"] for r in html_text.main_text(df, carry=["page_id"]).collect()}
    # the list recurs on many pages of its host; the heading and paragraphs stay
    assert got == {i: f"Title & more\nOne two bold\nText <{i}>" for i in range(6)} | {6: "", 7: "", 8: "A\nx\ny", 9: "plain &am"}
    assert html_text.main_text(df.limit(0)).collect() == []


def test_pages_keep_repeated_articles(spark):
    rows = [(i, "http://h.example/", "<body><div class=ad>x</div><article><h1>Same</h1><p>Text</article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_text(df).collect()} == {"Same\nText"}


def test_template_is_told_from_reposts_on_hosts_of_any_size(spark):
    note = "<div><div>Section note: all times are local.</div><ul><li>one</ul></div>"
    rows = [(i, f"http://big.example/{i}", f"<body><div>Page {i} says thing number {i} at some length, and more of it than notes.</div>{note if i < 4 else ''}") for i in range(400)]
    bodies = {
        "a": "<body><article><div>First half.</div><ul><li>Second half.</ul></article>",
        "b": "<body><div><div>First half.</div><ul><li>Second half.</ul></div>",
        "c": "<body><section>First half. Second half.</section><p>%d</p>",
    }
    for h, body in bodies.items():
        rows += [(1000 + len(rows) + k, f"http://{h}.example/{k}", body.replace("%d", str(k))) for k in range(3)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["row"]["url"].split("/")[2].split(".")[0], []).append(r["text"])
    assert by["a"] == by["b"] == ["First half.\nSecond half."] * 3
    assert sorted(by["c"]) == [f"First half. Second half.\n{k}" for k in range(3)]
    assert len(by["big"]) == 400 and not any("Section" in t for t in by["big"])


def test_articles_are_judged(spark):
    def text(page):
        return html_text.blocks_of(html_text.parse(page), frozenset())

    thread = '<div class="thread"><article class="comment"><p>reader says</p></article></div>'
    assert text(f"<main><div><h1>T</h1><p>Main text is here.</p></div>{thread}</main>") == ["T", "Main text is here."]
    assert text('<main><p>Main text</p><article class="promo"><p>Buy</p></article></main>') == ["Main text"]
    assert text('<main><p>A long main text of words</p><article><p>Next</p></article></main>') == ["A long main text of words", "Next"]
    assert text('<article><p>Yes</p></article><article class="related"><p>No</p></article>') == ["Yes"]
    for name in ("user-comments", "fb-comments", "reader-comments", "cookie-law-info", "gdpr-overlay", "werbung", "publicidad"):
        assert text(f'<article><p>Yes</p><div class="{name}"><p>No</p></div></article>') == ["Yes"], name
    assert text("<title>Title</title><p>Text</p>") == ["Text"]


def test_furniture_by_counts_alone(spark):
    """Tags and names that say nothing: only recurrence on the host tells the template from the text."""
    rows = []
    for host in range(3):
        for i in range(7):
            body = f"<div class='q'><p>Story {host} {i}</p><p>It has words {i * 31 + host} of its own and of some length</p></div>"
            rows.append((host * 10 + i, f"http://h{host}.x/{i}", f"<body><div class='a'>Start Home {host}</div><div class='b'><ul><li>One<li>Two</ul></div>{body}<div class='c'>Address {host}</div></body>"))
    got = html_text.main_text(spark.createDataFrame(rows, "`page.id` long, url string, html string")).collect()
    assert {(r["row"]["page.id"], r["text"]) for r in got} == {(h * 10 + i, f"Story {h} {i}\nIt has words {i * 31 + h} of its own and of some length") for h in range(3) for i in range(7)}
    assert all((r["n_recurring"], r["n_named"]) == (3, 0) for r in got)


def test_pages_of_any_depth(spark):
    rows = [(i, "http://h.example/", f"<body>{t * 6000}deep") for i, t in enumerate(("<div>", "<b>", "<span><font>", "<article>", "<ul><li>"))]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["deep"] * len(rows)


def test_names_and_attributes():
    page = """<article><p style="overflow: hidden ">kept</p><p style="color:red; DISPLAY : none">no</p><p hidden>no</p><p data-hidden="x" title="display: none">kept too</p>
    <div class="social-history"><p>chapter</p></div><div class="notice-of-meeting">meeting</div><div id=cookieBanner>no</div><div class="story share-buttons_2">no</div>
    <div aria-hidden=true>no</div><div aria-hidden=false>yes</div><div class="shadow ready-comments-x1">ready</div><div role="navigation">no</div><p title="a > b" class='x "y"'>q</p></article>"""
    assert html_text.blocks_of(html_text.parse(page), frozenset()) == ["kept", "kept too", "chapter", "meeting", "yes", "ready", "q"]
    for name in ("ad", "ads-top", "cookie-notice", "site-footer", "mainNav", "related_posts", "comments", "sidebar-left"):
        assert html_text.furniture_name(name)
    for name in ("adventure", "social-history", "add", "download", "header", "main-content", "share-price", "menu-engineering", ""):
        assert not html_text.furniture_name(name)


def test_three_mirrored_articles_keep_everything(spark):
    body = "<article><h1>T</h1><div class='content'><p>one</p></div><ul><li>two</li></ul></article>"
    rows = [(i, f"http://m.example/{i}", f"<body><div>Page {i} of it</div>{body}") for i in range(3)]
    assert {r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"T\none\ntwo"}


def test_pages_match_brute_force(spark, sf):
    """The table's pages against a plain reading by the standard parser, and generated pages against what went into them."""
    for r in registered.QUERIES["op2_site_template"](spark, sf).join(common.table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        assert (r["text"], r["n_chars"]) == (brute.article_text(r["html"]), len(r["text"]))
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(300):
        host = rng.choice(["a.example", "B.example:8080", "c.example"])
        source, blocks = brute.page(rng, host, i)
        rows.append((i, f"https://u@{host}/{i}", source))
        want[i] = "\n".join(blocks)
    rows += [(r[0] + 1000, r[1], r[2]) for r in rows[:20]]  # repeated pages
    want |= {i + 1000: want[i] for i in range(20)}
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["row"]["page_id"]: r["text"] for r in got} == want


def test_long_pages(spark):
    rows = [(1, "http://h.example/", "<body>" + "<p>word &amp; more" * 200_000), (2, "http://h.example/", "<div>" * 50_000 + "x" + "</div>" * 50_000)]
    got = {r["row"]["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "\n".join(["word & more"] * 200_000), 2: "x"}


def test_media_round_trip(spark):
    out = media.decode(media.store(odd(spark), carry=["doc_id"])).collect()
    assert len(out) == len(ODD) and {r["status"] for r in out} == {"ok"}
    texts = {(str(d), (t or "").encode()) for d, t in ODD}
    for r in out:
        raw, n = bytes(r["payload"]), r["row"]["n_bytes"]
        assert (str(r["row"]["row"]["doc_id"]), raw[:n]) in texts
        assert len(raw) % 576 == 0 and len(raw) > 0 and set(raw[n:]) <= {255}
        assert sum(c["frames"] for c in r["clips"]) * 576 == len(raw)
    assert media.clip_rows(media.decode(media.store(odd(spark), carry=["doc_id"]))).count() >= len(ODD)
    assert media.store(odd(spark, [])).collect() == []


def test_frames_survive_all_values():
    rng = np.random.default_rng(1)
    for p in (rng.integers(0, 256, 576 * 5, dtype=np.uint8).tobytes(), b"\xff" * 1152, bytes(576), bytes([0, 255] * 288)):
        avi = media.write_avi(p)
        assert media.read_frames(avi).tobytes() == p
        # the general reader takes the same frames one by one
        assert b"".join(jpeg.decode(avi[a:b]).tobytes() for a, b in media.read_index(avi).tolist()) == p
    dark, light = np.zeros((10, 24, 24), np.uint8), np.full((10, 24, 24), 200, np.uint8)
    assert media.shots_of(np.concatenate((dark, light))).tolist() == [0, 10]


def test_baseline_frames_of_other_makers():
    rng = np.random.default_rng(3)
    for height, width, chroma, restart in ((8, 8, False, 0), (21, 35, False, 2), (40, 33, True, 0), (32, 48, True, 3)):
        image = np.clip(np.cumsum(rng.normal(0, 9, (height, width)), axis=1) + 128, 0, 255).astype(np.uint8)
        frame = brute.baseline_jpeg(image, chroma, restart)
        assert np.abs(jpeg.decode(frame).astype(int) - image).max() <= 1
        for cut in (3, 40, len(frame) // 2):
            with pytest.raises(ValueError):
                jpeg.decode(frame[:cut])
    with pytest.raises(ValueError, match="process 2"):
        jpeg.decode(frame.replace(b"\xff\xc0", b"\xff\xc2"))


def test_media_of_any_kind_gets_a_status(spark):
    dark, light = (brute.baseline_jpeg(np.full((16, 24), v, np.uint8), False, 0) for v in (20, 220))
    frames = [dark] * 12 + [light] * 6
    good = media.write_avi(b"x" * 576)
    rows = [
        (1, None), (2, b""), (3, b"RIFF\0\0\0\0WAVE"), (4, good[:-40]), (5, good[:100]), (6, good), (6, good), (7, b"\0" * 5000),
        (8, brute.avi(frames, 25, 2)), (9, brute.avi(frames, 25, 2, index=False)), (10, brute.avi([dark, dark[:60]], 25, 1)), (11, brute.avi([], 25, 1)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumns({c: F.lit("x") for c in [*MORE, "status", "clips"] if c != "media"})
    got = {r["row"]["doc_id"]: r for r in media.decode(df).collect()}
    assert {d for d, r in got.items() if r["status"] == "ok"} == {6, 8, 9}
    for d, r in got.items():
        assert (r["payload"] is None) == (r["status"] != "ok") and (r["clips"] == []) == (r["status"] != "ok")
    assert got[1]["status"] == got[2]["status"] == "no media"
    for d in (8, 9):
        assert [(c["first_frame"], c["frames"], c["start_s"]) for c in got[d]["clips"]] == [(0, 12, 0.0), (12, 6, 12 / 12.5)]
        assert len(got[d]["payload"]) == 18 * 16 * 24
    assert media.decode(df.limit(0)).collect() == []


def test_shards_are_balanced_gapless_and_stable(spark):
    rows = [(i, f"t{i % 7}") for i in range(4000)] + [(None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in MORE})
    out = sharding.place(docs, sharding.grid_tree(8), sharding.grid_tree(9)).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) == set(range(8)) and max(map(len, by.values())) < 1.3 * len(rows) / 8
    assert {r["text_crc32"] for r in out} == {0} | {zlib.crc32(f"t{k}".encode()) for k in range(7)}
    assert sharding.place(docs.limit(0), sharding.grid_tree(8)).collect() == []


def test_every_further_shard_takes_keys_only_into_itself(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in range(8, 13):
        df = sharding.with_shard(df, "doc_id", sharding.grid_tree(n), f"s{n}")
    for r in df.collect():
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for n in range(8, 12))
    assert sharding.grid_tree(9)["region2"] == {"rack4": {8: 1.0}} and len(sharding.grid_tree(12)) == 6


def test_many_rows_of_one_id(spark):
    docs = spark.range(6000).selectExpr("7L as doc_id", "cast(null as string) as text")
    out = sharding.place(docs, sharding.grid_tree(8)).collect()
    assert len({r["shard"] for r in out}) == 1 and sorted(r["slot"] for r in out) == list(range(6000))


def test_weights_move_keys_only_between_changed_subtrees(spark):
    keys = spark.range(3000).withColumnRenamed("id", "doc_id")
    tree = sharding.grid_tree(8)
    heavier = sharding.grid_tree(8)
    heavier["region0"]["rack0"][1] = 3.0
    both = sharding.with_shard(sharding.with_shard(keys, "doc_id", tree, "a"), "doc_id", heavier, "b").collect()
    moved = [(r["a"], r["b"]) for r in both if r["a"] != r["b"]]
    assert moved and all(b < 4 for _, b in moved)  # nothing moves into or within region1
    with pytest.raises(ValueError):
        sharding.with_shard(keys, "doc_id", {"r": {"k": {0: 0.0}}}, "a").collect()


def test_media_digest_columns(spark, sf):
    """Every digest against a stored form made here by itself, sample by sample."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in common.table(spark, sf, "documents").collect()}
    for r in registered.QUERIES["op9_motion_jpeg"](spark, sf).collect():
        raw = docs[r["doc_id"]]
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        if len(raw) < 20_000:
            stored = brute.stored_form(padded)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert r["feature"].startswith(f"frames={len(padded) // 576};")
            assert abs(float(r["feature"].rsplit("=", 1)[1]) - sum(padded) / len(padded)) < 0.001
