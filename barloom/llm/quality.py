"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is linear in its own features and those of the lines before and after it; a
transition score ties neighbouring labels; the forward-backward algorithm gives each line's probability of being good, and a
document's score is their mean weighted by the lines' bytes. Labels are known for documents only, so a line's own label is
latent: it starts as its document's, and lines that plainly look like the other kind change sides, as long as half of the document's bytes keep
its label. The field is fitted on these mixed chains. Only the text is looked at: language, source and id never enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, blob, chunks, flat, prefix_hash, span_hash, table, word_spans

#: Labelled rows that the field is fitted on at most: those of least hash.
FIT_ROWS = 6_000
#: Lines that the field is fitted on, beyond which pieces of texts are drawn by hash so that about as many are left.
FIT_LINES = 200_000
#: Lines of a chain that is fitted; longer texts are fitted in equal pieces, so that no step of the fit walks a longer chain.
PIECE_LINES = 1_024
THRESHOLD = 0.3
#: A line takes the other label when the field gives that at least this much.
PLAIN = 0.8
#: Ridges of the evidence and of the transitions: documents of one label throughout would else tie their lines without limit.
RIDGE, TIE_RIDGE = 1e-5, 0.03

_CLASSES = np.zeros((256, 7), np.int64)
for _i, _members in enumerate(
    (
        range(0x41, 0x5B),  # upper case
        range(0x30, 0x3A),  # digits
        b"$%&*#@^~=+<>\\",  # symbols
        b"|_/",  # rules
        b"!?",  # shouting
        b".,;:'\"()-",  # punctuation
        range(0x80, 0xC0),  # continuation bytes
    )
):
    _CLASSES[list(_members), _i] = 1
OWN = 14


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of consecutive texts, and the first line of each text; every text has one at least."""
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    count = 1 + np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    starts[first[:-1]] = offsets[:-1]
    ends[first[1:] - 1] = offsets[1:]
    at = np.arange(len(breaks)) + text
    ends[at], starts[at + 1] = breaks, breaks + 1
    return starts, ends, first


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own features of each line, its bytes, first line of each text) of consecutive texts."""
    starts, ends, first = line_spans(data, offsets)
    lines = len(starts)
    size = ends - starts
    n = np.maximum(size, 1)
    x = np.zeros((lines, OWN))
    for i in range(_CLASSES.shape[1]):
        sums = np.concatenate(([0], np.cumsum(_CLASSES[data, i])))
        x[:, i] = np.sqrt((sums[ends] - sums[starts]) / n)
    x[:, 7] = np.log1p(size) / 8
    sums = prefix_hash(data)
    a, b, _ = word_spans(data, offsets)
    line = np.searchsorted(starts, a, "right") - 1
    h = span_hash(sums, a, b)
    words = np.bincount(line, minlength=lines)
    w = np.maximum(words, 1)
    key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=lines)
    x[:, 8] = 1 - distinct / w
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    x[:, 9] = np.bincount(line[again], minlength=lines) / w
    x[:, 10] = np.bincount(line, weights=b - a, minlength=lines) / w / 10
    x[:, 11] = words == 0
    whole = span_hash(sums, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((whole, text))
    same = np.zeros(lines, bool)
    same[1:] = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    repeat = np.zeros(lines, bool)
    repeat[order] = same
    x[:, 12] = repeat & (words > 0)
    x[1:, 13] = (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])
    return x, size, first


def pieces_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number within the text, and the bounds in lines) of pieces of at most PIECE_LINES lines of each text."""
    sizes = np.diff(first)
    count = -(-sizes // PIECE_LINES)
    text = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    return text, piece, np.append(first[text] + sizes[text] * piece // count[text], first[-1])


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A bias, each line's own features and those of the lines before and after it (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack((np.ones((len(x), 1)), x, before, after))


@dataclass
class Field:
    """weights of a line's evidence for good; transitions[i, j] of a label i followed by j (0 bad, 1 good).

    cut is the mean probability that separates the fitted documents best; scores are scaled so that it becomes THRESHOLD.
    """

    weights: np.ndarray
    transitions: np.ndarray
    cut: float = THRESHOLD


def best_cut(mean: np.ndarray, label: np.ndarray) -> float:
    """The middle of the cuts that put the most documents on their label's side, kept within 0.05 to 0.95."""
    order = np.argsort(mean, kind="stable")
    good = label[order] == 1
    right = np.concatenate(([0], np.cumsum(~good))) + np.concatenate((np.cumsum(good[::-1])[::-1], [0]))
    at = np.flatnonzero(right == right.max())
    edges = np.concatenate(([0.0], mean[order], [1.0]))
    return float(np.clip((edges[at[0]] + edges[at[-1] + 1]) / 2, 0.05, 0.95))


def marginals(evidence: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions 2 x 2) by forward-backward over all chains at once."""
    sizes = np.diff(first)
    by_size = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][by_size], sizes[by_size]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
    score = np.stack((np.zeros(len(evidence)), evidence), 1)
    forward = np.empty((len(evidence), 2))
    backward = np.zeros((len(evidence), 2))
    t00, t01, t10, t11 = transitions.ravel()
    for t in range(longest):
        at = begin[: live[t]] + t
        if t:
            f = forward[at - 1]
            into = np.stack((np.logaddexp(f[:, 0] + t00, f[:, 1] + t10), np.logaddexp(f[:, 0] + t01, f[:, 1] + t11)), 1)
            forward[at] = score[at] + into
        else:
            forward[at] = score[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        g = score[at + 1] + backward[at + 1]
        backward[at] = np.stack((np.logaddexp(t00 + g[:, 0], t01 + g[:, 1]), np.logaddexp(t10 + g[:, 0], t11 + g[:, 1])), 1)
    total = forward + backward
    good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
    inner = np.ones(len(evidence), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    log_z = np.logaddexp(total[at, 0], total[at, 1])
    g = score[at] + backward[at]
    pairs = forward[at - 1][:, :, None] + transitions[None] + g[:, None, :] - log_z[:, None, None]
    return good, np.exp(np.minimum(pairs, 0)).sum(axis=0)


def relabelled(good: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, plain: float = PLAIN) -> np.ndarray:
    """Line labels: the document's, but for lines whose probability of the other is at least plain.

    The plainest lines go first, and a document keeps its label on half of its bytes at least."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    own = label[text].astype(np.float64)
    other = np.where(own == 1, 1 - good, good)
    order = np.lexsort((-other, text))
    weight = np.maximum(size, 1)[order].astype(np.int64)
    so_far = np.cumsum(weight)
    before = np.concatenate(([0], so_far))[first[:-1]]
    total = np.concatenate(([0], so_far))[first[1:]] - before
    change = (other[order] >= plain) & (2 * (so_far - before[text]) <= total[text])
    own[order[change]] = 1 - own[order[change]]
    return own


def fit_labels(x: np.ndarray, first: np.ndarray, y: np.ndarray, start: Field | None = None, steps: int = 120, chains: bool = True) -> Field:
    """Maximum likelihood with a ridge, by full-batch Adam, of the line labels y; without chains lines are independent."""
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    k = x.shape[1]
    p = np.concatenate((start.weights, start.transitions.ravel())) if start else np.zeros(k + 4)
    ridge = np.repeat((RIDGE, TIE_RIDGE), (k, 4))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        good, expected = marginals(x @ p[:k], first, p[k:].reshape(2, 2))
        g = np.concatenate((x.T @ (good - y), (expected - seen).ravel() * chains)) / len(x) + ridge * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(p[:k], p[k:].reshape(2, 2))


def fit_field(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> Field:
    """The field of documents whose lines' labels are latent; label is each document's.

    Lines by themselves tell which of them look like the other kind; the chain that is fitted on the labels so changed changes them
    once more and is fitted again."""
    text = np.repeat(np.arange(len(label)), np.diff(first))
    field = fit_labels(x, first, label[text].astype(np.float64), steps=60, chains=False)
    for steps in (60, 120):
        good, _ = marginals(x @ field.weights, first, field.transitions)
        field = fit_labels(x, first, relabelled(good, size, first, label), field, steps)
    return field


def mean_good(field: Field, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The byte-weighted mean of P(good) over each text's lines; an empty text is one empty line."""
    good, _ = marginals(with_neighbours(x, first) @ field.weights, first, field.transitions)
    weight = np.maximum(size, 1)
    return np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def score_texts(field: Field, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    mean = mean_good(field, *line_features(data, offsets))
    return np.interp(mean, [0, field.cut, 1], [0, THRESHOLD, 1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Field:
    """Fit on the labelled rows of docs, on `rows` labels of least hash if there are more.

    Texts of over PIECE_LINES lines count as pieces, each a chain with the text's label; of more than FIT_LINES lines in all
    pieces are drawn by hash. So neither the driver's memory nor a step's time follows the length of any text.
    Rows without a label or id are left out, null texts are one empty line, labels and texts that share an id are joined each
    with each; without any labelled row every line is as likely good as bad. Other columns of either table are ignored.
    """
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.lit("quality"), F.col(id_col)).alias("_order")
    )
    sample = F.broadcast(sample.orderBy("_order", "label").limit(rows))
    texts = docs.select(F.col(id_col).alias("_id"), blob(text_col).alias("text")).join(sample, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                x, _, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                text, piece, cuts = pieces_of(first)
                parts = [x[i:j].astype(np.float32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                order, label = (batch.column(c).take(pa.array(text + a)) for c in ("_order", "label"))
                yield pa.RecordBatch.from_arrays([order, label, pa.array(piece, pa.int32()), pa.array(parts, pa.binary())], ["_order", "label", "piece", "x"])

    found = Scratch(docs.sparkSession).put(texts.mapInArrow(run, "_order long, label int, piece int, x binary"))
    lines = (found.agg(F.sum(F.length("x"))).first()[0] or 0) // (4 * OWN)
    if lines > FIT_LINES:
        found = found.where(F.pmod(F.xxhash64(F.lit("piece"), "_order", "piece"), F.lit(1 << 20)) < F.lit(FIT_LINES * (1 << 20) // lines))
    got = found.toArrow().sort_by([(c, "ascending") for c in ("_order", "label", "piece")])
    if not got.num_rows:
        return Field(np.zeros(1 + 3 * OWN), np.zeros((2, 2)))
    parts = [np.frombuffer(r, np.float32).reshape(-1, OWN) for r in got.column("x").to_pylist()]
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    x, label = np.concatenate(parts).astype(np.float64), got.column("label").to_numpy()
    size = np.rint(np.expm1(x[:, 7] * 8))
    field = fit_field(with_neighbours(x, first), size, first, label)
    field.cut = best_cut(mean_good(field, x, size, first), label)
    return field


def score(docs: DataFrame, field: Field, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, by default all) and score for every row; null texts score as empty ones."""
    carry = docs.columns if carry is None else carry
    model = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.struct(*carry).alias("row"), blob(text_col).alias("text"))
    schema = StructType([rows.schema["row"], *_parse_datatype_string("score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                s = score_texts(model.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(s)], ["row", "score"])

    return rows.mapInArrow(run, schema)


def line_scores(docs: DataFrame, field: Field, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, by default all) and good, each line's probability of being good, for every row.

    Lines end at a line feed; null and empty texts have one empty line."""
    carry = docs.columns if carry is None else carry
    model = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.struct(*carry).alias("row"), blob(text_col).alias("text"))
    schema = StructType([rows.schema["row"], *_parse_datatype_string("good array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                x, _, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                good, _ = marginals(with_neighbours(x, first) @ model.value.weights, first, model.value.transitions)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(good))], ["row", "good"])

    return rows.mapInArrow(run, schema)


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op6_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels").where(_fold("doc_id") != 0))
    scored = score(docs, field, carry=["doc_id"]).select("row.doc_id", "score")
    return scored.select(
        "doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
