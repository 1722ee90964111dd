"""Candidate passages for exact substring jobs: windows dealt by their minimiser.

Every window of `window` consecutive tokens (words or bytes) has a minimiser: the smallest hash of its `gram`-token
parts. Consecutive windows whose minimiser stands at the same place form one segment, so each window of each text is in exactly one
segment and equal windows anywhere carry the same anchor h. A window can repeat only under an anchor that repeats;
all other segments leave after one shuffle of 40-byte rows. Nothing is sampled: this only decides which windows meet.

Anchors with very many different contents (a frequent line in ever other surroundings) are refined: their segments are
cut by the anchor's place in the window and dealt by a hash of all tokens common to the cut's windows, at last by the
whole window. No group then holds more than HOT_CONTENTS contents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import _BYTE_VALUES, Scratch, blob, chunks, flat, mix, powers, sliding_min, span_hash, word_hashes, word_spans

#: Different segment contents under one anchor that one task may index together.
HOT_CONTENTS = 2_000

SEGMENT = "start int, n int, h long, c long"


@dataclass(frozen=True)
class Windows:
    """What is cut: words or bytes, the length of a window, the length of the parts that are hashed."""

    tokens: str
    window: int
    gram: int

    @property
    def width(self) -> int:
        return self.window - self.gram + 1


def token_hashes(data: np.ndarray, offsets: np.ndarray, tokens: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each token of consecutive texts, and the first token of each text."""
    if tokens == "bytes":
        return _BYTE_VALUES[data], offsets
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first


def _sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=out[1:])
    return out


def content_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of tokens: equal ones are taken for equal contents, so no sum modulo 2^64, which regular stretches fool."""
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(hashes[a:b]) for a, b in spans), np.uint64, len(starts))


def cut(hashes: np.ndarray, first: np.ndarray, how: Windows) -> tuple[np.ndarray, ...]:
    """(text, start within the text, windows, anchor, content hash) of every segment of consecutive texts."""
    n, empty = len(hashes), np.empty(0, np.int64)
    if n < how.window:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = _sums(hashes)
    at = np.arange(n - how.gram + 1)
    grams = span_hash(sums, at, at + how.gram)
    low = sliding_min(grams, how.width)
    leaves = grams[: len(low)] == low  # the minimiser stands at the window's start, so the next window has another place
    sizes = np.diff(first)
    inside = np.repeat(first[1:], sizes)[: len(low)] >= np.arange(len(low)) + how.window
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    low, leaves = low[at], leaves[at]
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    new = np.ones(len(at), bool)
    new[1:] = leaves[:-1] | (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    content = content_hashes(hashes, start, start + count - 1 + how.window)
    return text[begin], start - first[text[begin]], count, low[begin], content


def _columns(schema: StructType, *columns) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    made = []
    for c, f in zip(columns, out, strict=True):
        if isinstance(c, np.ndarray) and c.dtype == np.uint64:
            c = c.view(np.int64)
        made.append(c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(made, schema=out)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (a hash of the text, so that rows that share an id stay apart), text as bytes."""
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), blob(text_col).alias("text"))


def _schema(docs: DataFrame, rest: str) -> StructType:
    return _parse_datatype_string(f"_id {docs.schema['_id'].dataType.simpleString()}, _key long, {rest}")


def segments(docs: DataFrame, how: Windows) -> DataFrame:
    """All segments of keyed texts: _id, _key, start, n, h, c."""
    schema = _schema(docs, SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                text, start, n, h, c = cut(*token_hashes(part, offsets[a : b + 1] - offsets[a], how.tokens), how)
                rows = pa.array(text + a)
                yield _columns(schema, batch.column("_id").take(rows), batch.column("_key").take(rows), start, n, h, c)

    return docs.mapInArrow(run, schema)


def _recut(hashes: np.ndarray, start: int, n: int, how: Windows, step: int) -> Iterator[tuple[int, int, int, int]]:
    """The segment's windows cut by the place of their minimiser, step places a cut: (start, n, h, c)."""
    part = hashes[start : start + n - 1 + how.window]
    sums = _sums(part)
    at = np.arange(how.width)
    place = int(np.argmin(span_hash(sums, at, at + how.gram)))  # the same place for all windows of a segment
    group = (place - np.arange(n)) // step
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.append(first, n))
    common = place - group[first] * step
    h = mix(span_hash(sums, common, common - step + 1 + how.window) + group[first].astype(np.uint64))
    c = content_hashes(part, first, first + count - 1 + how.window)
    yield from zip((first + start).tolist(), count.tolist(), h.view(np.int64).tolist(), c.view(np.int64).tolist(), strict=True)


def with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_id, _key, text, and the rows of that text as a list; bounded by the text's own windows."""
    listed = rows.groupBy("_id", "_key").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("_id", "_key")])).alias("rows"))
    return docs.join(listed, ["_id", "_key"])


def refine(docs: DataFrame, hot: DataFrame, how: Windows, step: int) -> DataFrame:
    schema = _schema(docs, SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, (text, rows) in enumerate(zip(batch.column("text"), batch.column("rows"), strict=True)):
                raw = np.frombuffer(text.as_py(), np.uint8)
                hashes, _ = token_hashes(raw, np.array([0, len(raw)]), how.tokens)
                for r in rows.as_py():
                    for row in _recut(hashes, r["start"], r["n"], how, step):
                        for column, value in zip(out, (i, *row), strict=True):
                            column.append(value)
            at = pa.array(out[0], pa.int64())
            yield _columns(schema, batch.column("_id").take(at), batch.column("_key").take(at), *out[1:])

    return with_texts(docs, hot).mapInArrow(run, schema)


def _shared(rows: DataFrame, across_texts: bool, scratch: Scratch) -> DataFrame:
    """Segments whose anchor stands in two texts of different id (across_texts) or at two places at all.

    The anchors are written first: a join of two plain exchanges can split an anchor that holds many rows.
    """
    kept = (
        rows.groupBy("h").agg(F.min("_id").alias("a"), F.max("_id").alias("b")).where("a <> b")
        if across_texts
        else rows.groupBy("h").agg(F.count("*").alias("a")).where("a > 1")
    )
    anchors = scratch.put(kept.select("h"))
    shared = scratch.put(rows.join(anchors, "h", "left_semi").select(*rows.columns))
    scratch.drop(anchors)
    return shared


def contents(rows: DataFrame) -> DataFrame:
    """One row for each anchor and content: smallest id, number of places, one place."""
    return rows.groupBy("h", "c").agg(
        F.min("_id").alias("first"), F.count("*").alias("places"), F.min(F.struct("_id", "_key", "start", "n")).alias("at")
    )


def candidates(docs: DataFrame, how: Windows, scratch: Scratch, across_texts: bool) -> DataFrame:
    """A written table of the segments whose windows may repeat, with no anchor of more than HOT_CONTENTS contents."""
    every = scratch.put(segments(docs, how))
    rows = _shared(every, across_texts, scratch)
    scratch.drop(every)
    for step in (-(-how.width // 8), 1):
        counts = rows.select("h", "c").distinct().groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > HOT_CONTENTS)
        anchors = scratch.put(counts.select("h"))
        if anchors.isEmpty():
            scratch.drop(anchors)
            break
        hot = scratch.put(rows.join(anchors, "h", "left_semi").select(*rows.columns))
        cold = scratch.put(rows.join(anchors, "h", "left_anti").select(*rows.columns))
        cut_again = scratch.put(refine(docs, hot, how, step))
        scratch.drop(rows, anchors, hot)
        finer = _shared(cut_again, across_texts, scratch)
        rows = scratch.put(cold.unionByName(finer))
        scratch.drop(cold, cut_again, finer)
    return rows


def extract(docs: DataFrame, places: DataFrame, how: Windows) -> DataFrame:
    """The tokens of one place of each content: h, c, first, places, n, part (bytes; words joined by one space)."""
    id_type = docs.schema["_id"].dataType.simpleString()
    schema = _parse_datatype_string(f"h long, c long, first {id_type}, places long, n int, part binary")
    rows = places.select("h", "c", "first", "places", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at._id").alias("_id"), F.col("at._key").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column("rows")
            rows = pa.RecordBatch.from_struct_array(listed.flatten())
            sizes = np.diff(listed.offsets.to_numpy())
            starts, counts = rows.column("start").to_numpy(), rows.column("n").to_numpy()
            parts, at = [], 0
            for text, k in zip(batch.column("text"), sizes, strict=True):
                raw = text.as_py()
                words = raw.split() if how.tokens == "words" else None
                for i in range(at, at + k):
                    a, b = int(starts[i]), int(starts[i] + counts[i] - 1 + how.window)
                    parts.append(b" ".join(words[a:b]) if words is not None else raw[a:b])
                at += k
            yield _columns(schema, *[rows.column(c) for c in ("h", "c", "first", "places", "n")], parts)

    return with_texts(docs, rows).mapInArrow(run, schema)


def with_shards(parts: DataFrame, tokens_per_shard: int) -> DataFrame:
    """Equal anchors meet in one shard; the number of shards follows the tokens."""
    size = parts.agg(F.sum(F.length("part"))).first()[0] or 0
    return parts.withColumn("shard", F.pmod(F.col("h"), F.lit(max(1, -(-size // tokens_per_shard)))))


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """A mask of n tokens from spans {a, b} of token positions."""
    step = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(step, np.fromiter((s["a"] for s in spans), np.int64, len(spans)), 1)
        np.add.at(step, np.fromiter((s["b"] for s in spans), np.int64, len(spans)), -1)
    return np.cumsum(step[:-1]) > 0


def spans_by_text(rows: DataFrame, found: DataFrame, how: Windows, keep) -> DataFrame:
    """_id, _key, spans: what is to go from each text; keep(run) says which runs hold for a place."""
    placed = rows.join(found, ["h", "c"]).select("_id", "_key", "start", F.explode("runs").alias("r")).where(keep(F.col("r")))
    span = F.struct((F.col("start") + F.col("r.off")).alias("a"), (F.col("start") + F.col("r.off") + F.col("r.len") - 1 + how.window).alias("b"))
    return placed.groupBy("_id", "_key").agg(F.collect_list(span).alias("spans"))
