"""Nearest vectors, token alignment and periodic runs: against brute force and on odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import align, near_dup, periodic, permutation, substring

from . import brute


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_nearest_finds_most_of_brute_force(spark, d):
    rows = spark.read.parquet(f"/root/testdata/{d}/embeddings.parquet").toPandas()
    m, ids = np.array(rows.embedding.tolist(), np.float64), rows.vec_id.to_numpy()
    out = permutation.op11_permutation_index(spark, f"/root/testdata/{d}").toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, found in out.groupby("query_id"):
        s = (m * m[ids == q][0]).sum(axis=1)
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert found["rank"].tolist() == list(range(1, 21)) and q not in set(found.vec_id)
        at = [int(np.flatnonzero(ids == v)[0]) for v in found.vec_id]
        assert np.allclose(s[at], found.score, atol=1e-14, rtol=0)
        hits += len(set(at) & set(want))
    assert out.query_id.nunique() == (ids % 20 == 0).sum()
    assert hits / len(out) >= 0.9


def test_nearest_reaches_recall_through_the_index(spark):
    """Blocks of many more rows than are reranked, unequal lengths, a hot vector, clusters."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(9000, 24)) * rng.uniform(0.5, 2.0, size=(9000, 1))
    m[1000:4000] = m[1000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    asked = (F.col("id") % 300 == 0)
    out = permutation.nearest(df, asked).toPandas()
    hits = total = 0
    for q, found in out.groupby("query_id"):
        s = (m * m[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(m)), -s))[:20]
        hits, total = hits + len(np.intersect1d(found.id, want)), total + 20
        assert found.sort_values("rank").score.is_monotonic_decreasing
    assert total == 30 * 20 and hits / total >= 0.9


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (40, [0.0, 0.0]), (11, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, `h.v` string")
    got = permutation.nearest(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in got] == [(0, 1, 4, 2.0), (0, 2, 3, 1.0), (0, 3, 3, 1.0), (0, 4, 20, 1.0), (20, 1, 4, 2.0), (20, 2, 0, 1.0), (20, 3, 3, 1.0), (20, 4, 3, 1.0)]
    assert permutation.nearest(df.limit(0)).count() == 0
    assert permutation.nearest(df.where("vec_id = 3")).count() == 0


def texts_to_align():
    rng = random.Random(3)
    words = "the unhappy transformer tokenises naïve 漢字 über 12345 <|endoftext|> </s> <unk> don't 😀 re-run".split()
    odd = [None, "", " ", "\n\t  \n", "a▁b", "x\x00y", "é́ ﬁ", "a" * 700, "  lead", "trail  ", "１２３ ½"]
    return list(enumerate(odd + [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)] + ["same text twice"] * 3))


def test_alignment_matches_plain_merge(spark, monkeypatch):
    docs = texts_to_align()
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, `a.b` long").withColumn("row", F.lit(1))
    want = brute.aligned(docs, align.A_FILE, align.B_FILE)
    out = align.align(df).collect()
    got = {r.row.doc_id: (r.n_a, r.n_b, r.groups, r.n_links, r.n_best, r.count_sum) for r in out}
    assert got == want and len(out) == len(docs) and out[0].row["a.b"] == out[0].row.doc_id
    assert got[4] == (0, 0, "", 0, 0, 0)  # "▁" comes back as a space
    digests = {r.row.doc_id: r.groups for r in align.align(df, carry=["doc_id"], digest=True).collect()}
    assert digests == {d: hashlib.sha256(w[2].encode()).hexdigest() if w[2] else "" for d, w in want.items()}
    assert align.align(df.limit(0)).count() == 0


def test_alignment_of_given_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.aligned(docs, align.A_FILE, align.B_FILE)
    for r in align.op12_merge_path(spark, sf).collect():
        na, nb, g, n, best, total = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (na, nb, n, n, best, total)
        assert r.groups_sha256 == (hashlib.sha256(g.encode()).hexdigest() if g else "")


def test_written_blocks_hold_one_text_a_row(spark, monkeypatch):
    """However many texts a task and a block have, so that no row grows with them."""
    written, put = [], align.Scratch.put
    monkeypatch.setattr(align.Scratch, "put", lambda self, df, **options: written.append(put(self, df, **options)) or written[-1])
    text = " ".join(f"word{i} über's" for i in range(60))
    df = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text"))
    assert align.align(df).count() == 1500
    assert written[0].select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 20 * len(text)


@pytest.mark.parametrize("distinct", [1 << 16, (1 << 16) + 1])
def test_places_tell_all_pairs_of_a_block_apart(monkeypatch, distinct):
    own = [np.arange(distinct)[::-1], np.empty(0, np.int64), np.array([7, distinct - 1, 7])]
    given = iter(own)
    monkeypatch.setattr(align, "PASS_BYTES", 1)
    monkeypatch.setattr(align, "aligned", lambda pair, raws, digest: (np.ones(1, int), np.ones(1, int), ["x"], np.array([len(x := next(given))]), 3 * x))
    texts, code, times = align.block(None, pa.array([b"ab", b"cd", b"ef"]), True)
    assert (code == 3 * np.arange(distinct)).all() and (times == np.bincount(np.concatenate(own))).all()
    sums = align.added(texts["links"].slice(1), texts["n_links"].to_numpy()[1:], code)
    assert sums.tolist() == [0, 3 * (7 + distinct - 1 + 7)]
    assert align.added(texts["links"], texts["n_links"].to_numpy(), code)[0] == code.sum()


def test_merge_path_pieces_are_equal_and_stitched():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 200, rng.integers(0, 90))) for _ in range(2))
        a, b = (np.append(x, 200) for x in (a[a < 200], b[b < 200]))
        piece = int(rng.integers(1, 40))
        i, j = align.diagonals(a, b, piece)
        assert (np.diff(i + j)[:-1] == piece).all() and (i[-1], j[-1]) == (len(a), len(b))
        at, to = align.links(a, b, piece)
        both = np.intersect1d(a, b)
        assert (a[at] == both).all() and (b[to] == both).all()


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    monkeypatch.setattr(align, "PART_CHARS", 50)
    text = " ".join(f"word{i}  über's\n{i}" for i in range(200)) + " " + "z" * 400
    pair = align.Pair(align.A_FILE, align.B_FILE, align.load_a(), align.load_b())
    assert len(align.parts_of(text)) > 5 and "".join(align.parts_of(text)) == text
    a, b = pair.encode([text.encode(), b"\xff", None])
    monkeypatch.setattr(align, "PART_CHARS", 10**6)
    for x, y in zip(pair.encode([text.encode(), b"\xff", None]), (a, b), strict=True):
        assert [v.tolist() for v in x] == [v.tolist() for v in y] and not len(x[1]) and not len(x[2])


def test_runs_match_brute_force():
    rng = np.random.default_rng(0)
    for t in range(400):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 60 if t % 4 else 300))
            w = rng.integers(0, rng.integers(1, 6), n)
            if n and rng.random() < 0.7:
                a = int(rng.integers(0, n))
                w[a:] = w[a + np.arange(n - a) % int(rng.integers(1, max(2, n // 4)))]
            texts.append(w)
        s, e, q = periodic.find_runs(np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in texts]))
        want, first = [], 0
        for w in texts:
            want += [(a + first, n, p) for a, n, p in brute.runs(w.tolist())]
            first += len(w)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == want


@pytest.mark.parametrize("w", [np.zeros(400_000), np.arange(400_000) % 2, np.tile(np.r_[np.zeros(3000), 1], 60), np.arange(400_000) % 77_777])
def test_long_repetitive_texts_take_little_time(w):
    s, e, q = periodic.find_runs(w.astype(np.int64), np.zeros(len(w), np.int64))
    assert len(s) >= 1 and ((e - s) >= np.maximum(6, 4 * q)).all()


def test_frequency_splitting_recurses():
    """c parts the text; then a is too rare in one part, b in the other."""
    words = np.array([0, 1, 0, 1, 0, 1, 0, 2, 1, 1, 1, 1, 1, 1, 0, 1])
    at, segment = periodic.split(words, np.zeros(len(words), np.int64))
    assert at.tolist() == list(range(8, 14)) and len(set(segment.tolist())) == 1


def test_runs_odd_rows(spark, sf):
    docs = [(1, None), (2, ""), (3, " \n\t "), (4, "ha " * 9), (4, "ha " * 9), (5, "a b a b a b a b a c"), (None, "x y " * 5), (6, "é é é é é é")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, `runs.x` long").withColumn("kept", F.lit("k"))
    got = [(r.row.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in periodic.periodic_runs(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 9, [(0, 9, 1)], "ha"), (4, 9, [(0, 9, 1)], "ha"), (5, 10, [(0, 9, 2)], "a b c"), (None, 10, [(0, 10, 2)], "x y"), (6, 6, [(0, 6, 1)], "é")], key=str
    )
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_given_tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = periodic.op13_periodic_runs(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        words = brute.looped_words(r.doc_id, docs[r.doc_id])
        if len(words) > 1500:
            continue
        runs = brute.runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


@pytest.mark.parametrize("size", [1024, 2048])
def test_structured_long_words_stay_apart(spark, size):
    """Thue-Morse words, whose sums modulo 2^64 agree with their complement's."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other)], "doc_id long, text string")
    assert sorted(r.component_id for r in near_dup.near_duplicates(df).collect()) == [1, 2]
    common = " ".join(f"c{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{word} {common}"), (2, f"{other} {common}")], "doc_id long, text string")
    cut = {r.doc_id: r.n_removed for r in substring.remove_repeats(df, carry=["doc_id"]).select("row.doc_id", "n_removed").collect()}
    assert cut == {1: 0, 2: 60}
