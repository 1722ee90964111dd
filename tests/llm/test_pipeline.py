"""The corpus pipeline: every stage against brute force on its own input, odd rows, and run()."""

import corpus_pipeline as cp
from barloom.llm import toxicity
from barloom.llm.common import Scratch, table

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_stages_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    scratch = Scratch(spark)
    items = texts([{"doc_id": r["item_id"], "text": r["text"]} for r in table(spark, sf, "benchmark").collect()])
    before = docs.collect()
    for name, stage in cp.STAGES:
        out = scratch.put(stage(spark, docs, sf))
        after = out.collect()
        had, left = dict(texts(before)), {r["doc_id"]: r for r in after}
        if name != "encode":
            assert out.columns == COLUMNS
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
            assert all(labels.get(d) != 0 for d in had.keys() - left.keys())
        elif name == "near_dedup":
            assert left.keys() == {d for d, (_, c) in brute.components(texts(before), 5).items() if d == c}
        elif name == "substring_dedup":
            want = brute.without_repeats(texts(before))
            whole = {d: len(brute.SPACED.findall((t or "").encode())) for d, t in had.items()}
            assert left.keys() == {d for d, w in want.items() if w or not whole[d]}
            for d, r in left.items():
                assert brute.SPACED.findall((r["text"] or "").encode()) == want[d]
                assert r["text"] == had[d] or len(want[d]) < whole[d]
        elif name == "decontamination":
            assert left.keys() == {d for d, (_, n, _) in brute.hits(texts(before), items).items() if not n}
        else:
            assert left.keys() == had.keys() and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in after)
        docs, before = out, after


def test_run_is_the_stages_in_order(spark, sf):
    docs, scratch = table(spark, sf, "documents"), Scratch(spark)
    for _, stage in cp.STAGES:
        docs = scratch.put(stage(spark, docs, sf))
    assert sorted(map(str, cp.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_odd_rows_pass_every_stage(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a", "en", None, 1), (3, "a", "en", None, 1), (None, "b c", None, "s", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() == len(given)
            docs = out if out.columns == COLUMNS else docs


def test_toxic_seed_words_are_rejected(spark):
    sf = "/root/testdata/sf0.1"
    chain = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = [(1, "you idiot and stupid moron, worthless scum"), (2, "a plain line of text")]
    got = {r["row"]["doc_id"]: r["p_toxic"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    assert got[1] >= toxicity.THRESHOLD > got[2]
