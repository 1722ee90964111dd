"""Toxicity by a chain of linear classifiers over features of words and character n-grams.

Categories are predicted one after another; each link sees the features and the earlier links' probabilities. While
fitting, those probabilities are out-of-fold predictions, as a link must not learn to trust numbers its predecessors
gave for rows they had been fitted on. The last link is the label itself. labels marks a single kind of toxicity, so the
finer categories are weak labels: the terms that go with the label are grouped by how they stand together in toxic rows, and
a toxic row belongs to each group that it holds a term of. No vocabulary, language or script is given beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, blob, chunks, flat, mix, prefix_hash, span_hash, table, word_spans
from .decontaminate import _FOLD

#: Weak categories before the label.
KINDS = 3
#: Labelled rows that the chain is fitted on at most: those of least hash.
FIT_ROWS = 12_000
#: Features by chi-squared with the label, among those that stand in MIN_ROWS rows at least.
FEATURES = 1024
MIN_ROWS = 3
#: Characters of the n-grams; a word's two ends count as characters.
GRAMS = (2, 3, 4, 5, 6)
FOLDS = 3
THRESHOLD = 0.5
#: Text bytes that are taken at once: a short text has a row of all features, and its n-grams outnumber its bytes.
PART_BYTES = 1 << 18

_FOLD_ARRAY = np.frombuffer(_FOLD, np.uint8)


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words (letters, digits, non-ASCII) of consecutive texts and of their character n-grams, and the
    text of each. N-grams catch words that languages build on from a toxic stem; they never cross words."""
    data = _FOLD_ARRAY[data]
    starts, ends, first = word_spans(data, offsets)
    size = ends - starts
    number = np.repeat(np.arange(len(starts)), size)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    before = np.cumsum(size) - size
    spaced = np.full(len(number) + len(starts) + 1, 32, np.uint8)
    spaced[np.arange(len(number)) + number + 1] = data[np.arange(len(number)) - before[number] + starts[number]]
    sums = prefix_hash(spaced)
    begin = before + np.arange(len(starts)) + 1
    hashes, texts = [span_hash(sums, begin, begin + size)], [text]
    at = np.flatnonzero((spaced & 0xC0) != 0x80)
    gap = spaced[at] == 32
    gaps = np.concatenate(([0], np.cumsum(gap)))
    word = gaps[1:] - 1  # a gap opens the word behind it
    at = np.append(at, len(spaced))
    for n in GRAMS:
        last = len(gap) - n + 1
        if last < 1:
            break
        i = np.flatnonzero(gaps[n - 1 : n - 1 + last] == gaps[1 : 1 + last])
        hashes.append(span_hash(sums, at[i], at[i + n]))
        texts.append(text[word[i]])
    return np.concatenate(hashes), np.concatenate(texts)


@dataclass
class Links:
    """words: sorted hashes; weights: one row a link of bias, term weights, weights of the earlier links."""

    names: list[str]
    words: np.ndarray
    weights: list[np.ndarray]


def features(words: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + count) of the chosen terms for each text."""
    n = len(offsets) - 1
    if not len(words):
        return np.zeros((n, 0))
    h, text = term_hashes(data, offsets)
    maybe = np.zeros(1 << 20, bool)  # most terms are not chosen and end here
    maybe[words.view(np.uint64) >> np.uint64(44)] = True
    some = np.flatnonzero(maybe[h >> np.uint64(44)])
    h, text = h[some].view(np.int64), text[some]
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    return np.log1p(np.bincount(text[hit] * len(words) + at[hit], minlength=n * len(words)).reshape(n, len(words)))


def kinds_of(x: np.ndarray, y: np.ndarray, kinds: int = KINDS, rounds: int = 10) -> np.ndarray:
    """A 0/1 column a category: toxic rows that hold one of its terms.

    Terms most of whose rows are toxic are grouped by the rows they share (cosine), from centres that are frequent and far
    from each other; categories come in the order of their rows.
    """
    toxic = y > 0.5
    held = x > 0
    out = np.zeros((len(x), kinds))
    df = held.sum(0)
    terms = np.flatnonzero(held[toxic].sum(0) * 2 > df) if toxic.any() else np.empty(0, np.int64)
    if not len(terms):
        return out
    rows = held[toxic][:, terms].astype(np.float32)
    count = rows.sum(0)
    unit = rows / np.sqrt(count)
    centres = [int(np.argmax(count))]
    near = unit.T @ unit[:, centres[0]]
    while len(centres) < min(kinds, len(terms)):
        centres.append(int(np.argmax(count * (1 - near))))
        near = np.maximum(near, unit.T @ unit[:, centres[-1]])
    middle = unit[:, centres]
    for _ in range(rounds):
        own = np.argmax(unit.T @ middle, 1)
        middle = np.stack([unit[:, own == c].sum(1) if (own == c).any() else middle[:, c] for c in range(len(centres))], 1)
        middle = middle / np.maximum(np.linalg.norm(middle, axis=0), 1e-12)
    own = np.argmax(unit.T @ middle, 1)
    found = [rows[:, own == c].any(1) for c in range(len(centres))]
    for c, members in enumerate(sorted(found, key=lambda m: -int(m.sum()))):
        out[np.flatnonzero(toxic), c] = members
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_link(x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None, rows: np.ndarray | None = None, steps: int = 200) -> np.ndarray:
    """Logistic regression of features x and the earlier links' columns, a bias in front, by full-batch Adam; the ridge weighs as half
    a row does. rows marks the rows to fit on: the matrix is never copied."""
    x = x.astype(np.float32, copy=False)
    before = np.zeros((len(x), 0), np.float32) if before is None else before.astype(np.float32, copy=False)
    use = np.ones(len(x), np.float32) if rows is None else rows.astype(np.float32)
    n, k = max(1.0, float(use.sum())), x.shape[1]
    ridge, mean = 1e-4 + 0.5 / n, float((y * use).sum() / n)
    w = np.zeros(1 + k + before.shape[1], np.float32)
    w[0] = np.log((mean + 1e-3) / (1 - mean + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        rest = ((_sigmoid(w[0] + x @ w[1 : 1 + k] + before @ w[1 + k :]) - y) * use).astype(np.float32) / np.float32(n)
        g = np.concatenate(([rest.sum()], x.T @ rest, before.T @ rest)).astype(np.float32) + np.float32(ridge) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w.astype(np.float64)


def apply_link(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(w[0] + x @ w[1:])


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """Weights of each link; labels has a column a link."""
    x, k = x.astype(np.float32, copy=False), x.shape[1]
    weights, before = [], np.zeros((len(x), 0), np.float32)
    for link in range(labels.shape[1]):
        y = labels[:, link]
        weights.append(fit_link(x, y, before))
        if link + 1 < labels.shape[1]:
            out = np.zeros(len(x), np.float32)
            for f in range(folds):
                away = fold == f
                if away.any() and not away.all():
                    w = fit_link(x, y, before, ~away).astype(np.float32)
                    out[away] = _sigmoid(w[0] + x @ w[1 : 1 + k] + before @ w[1 + k :])[away]
            before = np.column_stack((before, out))
    return weights


def apply_chain(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """A probability a link for each row; earlier ones feed later ones."""
    for w in weights:
        x = np.hstack((x, apply_link(x, w)[:, None]))
    return x[:, x.shape[1] - len(weights) :]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Links:
    """Fit the chain on the labelled rows of docs, on `rows` labels of least hash if there are more.

    Rows without a label or id are left out; without any labelled row every probability is 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = [*(f"kind_{k + 1}" for k in range(KINDS)), label_col]
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), F.xxhash64(F.lit("fit"), F.col(id_col)).alias("_order")
    )
    sample = F.broadcast(sample.orderBy("_order", "_label").limit(rows))
    texts = docs.select(F.col(id_col).alias("_id"), blob(text_col).alias("text")).join(sample, "_id")
    counted = scratch.put(texts.select("text", "_order", (F.col("_label") == 1).cast("int").alias("label")))
    n, positive = counted.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return Links(names, np.empty(0, np.int64), [np.array([-40.0, *[0.0] * i]) for i in range(len(names))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            label, order = batch.column("label").to_numpy(), batch.column("_order").to_numpy()
            for a, b in chunks(offsets, PART_BYTES):
                found = [np.unique(term_hashes(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]) for i in range(a, b)]
                row = np.repeat(np.arange(a, b), [len(f) for f in found])
                h = np.concatenate(found)
                if not len(h):
                    continue
                by = np.argsort(h, kind="stable")
                h, row = h[by], row[by]
                at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                columns = [h[at].view(np.int64), np.diff(np.append(at, len(h))), np.add.reduceat(label[row].astype(np.int64), at), np.bitwise_xor.reduceat(mix(order[row].view(np.uint64)), at).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w", "df", "y", "rows"])

    tables = counted.mapInArrow(count, "w long, df long, y long, rows long").groupBy("w").agg(F.sum("df").alias("df"), F.sum("y").alias("y"), F.bit_xor("rows").alias("rows"))
    # terms that stand in the very same rows are one feature
    listed = scratch.put(tables.where(F.col("df") >= MIN_ROWS).groupBy("df", "y", "rows").agg(F.min("w").alias("w")))
    p = positive / n
    expected = F.col("df") * F.lit(p)
    score = F.pow(F.col("y") - expected, 2) / (expected * F.lit(1 - p) * (1 - F.col("df") / F.lit(n)) + F.lit(1e-9))
    tables = listed.withColumn("score", score).where(F.col("score") >= 2 * np.log(max(2, listed.count())).item())  # beyond chance among so many
    words = np.array(sorted(r["w"] for r in tables.orderBy(F.col("score").desc(), "w").limit(FEATURES).select("w").collect()), np.int64)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The terms that each text holds, and their values: most texts hold few of the features."""
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets, PART_BYTES):
                x = features(words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, at = np.nonzero(x)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a)))), pa.int32())
                terms, values = pa.ListArray.from_arrays(ends, pa.array(at, pa.int16())), pa.ListArray.from_arrays(ends, pa.array(x[row, at], pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("_order").slice(a, b - a), batch.column("label").slice(a, b - a), terms, values], ["_order", "label", "terms", "values"])

    got = counted.mapInArrow(vectors, "_order long, label int, terms array<short>, values array<float>").toArrow().sort_by("_order").combine_chunks()
    scratch.drop(counted, listed)
    terms, values = (got.column(c).combine_chunks() for c in ("terms", "values"))
    x = np.zeros((got.num_rows, len(words)), np.float32)
    x[np.repeat(np.arange(got.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False)), terms.flatten().to_numpy()] = values.flatten().to_numpy()
    y = got.column("label").to_numpy().astype(np.float64)
    fold = (np.abs(got.column("_order").to_numpy()) // 7) % FOLDS
    return Links(names, words, fit_chain(x, np.column_stack((kinds_of(x, y), y)), fold))


def score(docs: DataFrame, chain: Links, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, by default all) and p_<category> for every row of docs.

    Null and empty texts have no terms and get the chain's base rates; repeated rows get equal scores.
    """
    carry = docs.columns if carry is None else carry
    model = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.struct(*carry).alias("row"), blob(text_col).alias("text"))
    columns = [f"p_{n}" for n in chain.names]
    schema = StructType([rows.schema["row"], *_parse_datatype_string(", ".join(f"{c} double" for c in columns)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = model.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets, PART_BYTES):
                x = features(links.words, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                p = apply_chain(x, links.weights)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *[pa.array(p[:, i]) for i in range(p.shape[1])]], ["row", *columns])

    return rows.mapInArrow(run, schema)


def op7_classifier_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, chain, carry=["doc_id"])
    probabilities = [F.round(f"p_{n}", 6).alias(f"p_{n}") for n in chain.names]
    return scored.select("row.doc_id", *probabilities, (F.col("p_toxic") >= THRESHOLD).cast("int").alias("toxic"))
