"""Near-duplicates, substrings, repeated bytes, benchmark leaks: against brute force and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import components, decontaminate, difference_cover, near_dup, setsketch, substring, suffix_array, winnow
from barloom.llm.common import Scratch

from . import brute

LONG = " ".join(f"w{i}" for i in range(3000))
CLASH = ["row", "_id", "_key", "rows", "h", "c", "start", "n", "spans", "kept", "items", "bucket", "u", "v", "registers", "f1", "f2", "n_words"]


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, shared passages, repeated lines and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ab cd ef gh é".split() for b in range(40)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(55, 130))) for _ in range(4)]
    texts = [None, "", " \n\t", "one", "One", "a b", "A  b", LONG, LONG, "ha " * 700]
    while len(texts) < n:
        kind = rng.random()
        own = rng.choices(vocabulary, k=rng.randint(1, 300))
        if kind < 0.2 and len(texts) > 12:
            texts.append(rng.choice(texts[10:]))
        elif kind < 0.5 and len(texts) > 12:
            words = (rng.choice(texts[10:]) or "").split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
        elif kind < 0.8:
            at = rng.randrange(len(own))
            texts.append(" ".join(own[:at]) + "\n" + rng.choice(passages) + " " + " ".join(own[at:]))
        else:
            texts.append(" ".join(own))
    return list(enumerate(texts, 1))


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASH}) if extra else df


@pytest.fixture(scope="module")
def docs():
    return corpus()


def test_near_duplicates_match_brute_force(spark, docs):
    for size in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, docs), size=size).collect()}
        assert got == brute.components(docs, size)


def test_near_duplicates_in_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, docs), size=2).collect()}
    assert got == {d: c for d, (_, c) in brute.components(docs, 2).items()}


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "x y z"), (1, "x y z"), (1, "x y z"), (2, None), (3, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (1, 1), (1, 1), (2, 2), (3, 3)], key=str)
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    sa, sb = (setsketch.sketch(x, np.zeros(len(x), np.int64), 1) for x in (a, b))
    both = setsketch.sketch(np.union1d(a, b), np.zeros(2500, np.int64), 1)
    assert np.array_equal(setsketch.merge(sa, sb), both)
    assert abs(setsketch.jaccard(sa, sb, np.array([2000]), np.array([2000]))[0] - 0.6) < 0.15


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components.components(edges.limit(0), Scratch(spark)).collect() == []


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_matches_brute_force(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(winnow, "HOT_CONTENTS", hot)
    out = substring.remove_repeats(frame(spark, docs)).collect()
    want = brute.without_repeats(docs)
    assert {r["row"]["doc_id"]: r["kept"] for r in out} == {d: b" ".join(w).decode() for d, w in want.items()}
    assert all(r["n_words"] - r["n_removed"] == len(want[r["row"]["doc_id"]]) for r in out)


def test_substring_odd_rows_and_layout(spark):
    rows = [(None, LONG), (1, LONG), (1, LONG), (2, f"head  {LONG}\n tail"), (3, None), (4, "")]
    out = {(r["row"]["doc_id"], r["n_removed"], r["kept"]) for r in substring.remove_repeats(frame(spark, rows), layout=True).collect()}
    assert out == {(None, 0, LONG), (1, 0, LONG), (2, 3000, "head  tail"), (3, 0, ""), (4, 0, "")}
    assert substring.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_bytes_match_brute_force(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(winnow, "HOT_CONTENTS", hot)
    rows = [*docs, (None, LONG), (3, "ü" * 900)]
    out = suffix_array.remove_repeated_bytes(frame(spark, rows)).collect()
    want = brute.without_repeated_bytes([t for _, t in rows])
    assert sorted((str(r["doc_id"]), bytes(r["kept"])) for r in out) == sorted((str(d), k) for (d, _), k in zip(rows, want, strict=True))
    assert all(sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] for r in out)
    assert suffix_array.remove_repeated_bytes(frame(spark, [])).collect() == []


def test_suffix_array_sorts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(1, 80))
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("n", [9, 10, 11])
def test_spark_sorts_suffixes_by_difference_cover(spark, n):
    """Tables of every length modulo 3, with deep repeats, against sorting the suffixes themselves."""
    text = ([1, 2, 1, 1, 2, 1, 3] * 3)[:n]
    s = spark.createDataFrame(list(enumerate(text)), "i long, c long").repartition(3)
    got = {r["i"]: r["rank"] for r in difference_cover.suffix_ranks(s, Scratch(spark), small=3).collect()}
    assert [got[i] for i in range(n)] == [sorted(range(n), key=lambda k: text[k:]).index(i) for i in range(n)]


ITEMS = [(1, "The quick, brown fox jumps over the lazy dog and then it sleeps."), (2, "two words"), (3, None), (4, "!!"), (10, "Ünï code")]


def test_decontamination_matches_brute_force(spark):
    rows = [
        (1, "x THE quick brown-fox jumps over the lazy dog, and y"),
        (2, "Two, words two words"),
        (3, None),
        (4, ""),
        (5, "twowords two word s"),
        (6, "a ÜnÏ code ünï CODE Ünï-CODE"),
        (6, "two words"),
        (None, "two words"),
        (7, LONG + " two words " + LONG),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(str((d, *brute.hits([(d, t)], ITEMS)[d])) for d, t in rows)
    for most in (decontaminate.MAX_NODES, 30):  # one automaton, or several passes of three windows
        out = decontaminate.find_benchmark(frame(spark, rows), items, max_nodes=most).collect()
        assert sorted(str((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in out) == want
        text = {(d, t) for d, t in rows}
        for r in out:
            for s in r["spans"]:
                own = [t for d, t in text if d == r["row"]["doc_id"] and t and s["end_char"] <= len(t)]
                assert any(len(decontaminate.words_of(t[s["start_char"] : s["end_char"]].encode())) == s["end_word"] - s["first_word"] for t in own)
    assert decontaminate.find_benchmark(frame(spark, []), items).collect() == []
    assert {r["n_hit"] for r in decontaminate.find_benchmark(frame(spark, rows), items.limit(0)).collect()} == {0}
