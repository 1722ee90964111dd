"""Runs of words that repeat with a period: recursive frequency splitting, then a scan of lags.

A run of period q holds at least max(6, 4q) words, so each of its words stands in it four times or more. Within a segment (at first a whole
text), words that occur less often than that cannot belong to a run: they split it, and what is left is counted anew until no segment changes.
Segments that survive are compared with themselves shifted:

* lags under DIRECT by comparing all neighbours q apart, in all segments of a batch at once;
* longer lags in doubling ranges b..2b: every run of such a period has an anchor (a multiple of b) in its first b words, whose b words come
  again q later. One comparison of each anchor with the b places behind it finds all lags of the range in a pass over the segment.
  What an anchor proposes is confirmed by the words themselves, so hashes decide only what is looked at.

The work is n log n for a text of n words, whatever it repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import blob, chunks, flat, hash_sums, mix, span_hash, table
from .winnow import runs_of

LEAST, COPIES = 6, 4
#: Lags below are scanned directly; the first doubling range begins here.
DIRECT = 16


def least_length(q):
    """The fewest words of a run of period q."""
    return np.maximum(LEAST, COPIES * q)


def split(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive, and the number of each one's segment. words: numbers; text: the text of each, ascending."""
    live = np.arange(len(words))
    segment = text.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    base, top = 0, int(words.max()) + 1 if len(words) else 1
    while len(live):
        _, back, times = np.unique(segment * top + words[live], return_inverse=True, return_counts=True)
        often = times[back] >= COPIES
        new = np.ones(len(live), bool)
        new[1:] = (segment[1:] != segment[:-1]) | ~often[:-1]
        part = np.cumsum(new) - 1  # a word that goes ends its part
        changed = np.zeros(int(segment[-1]) + 1, bool)
        changed[segment[~often]] = True
        settled = ~changed[segment]
        if settled.any():
            at = live[settled]
            own = np.unique(segment[settled], return_inverse=True)[1]
            done.append((at, own + base))
            base += int(own[-1]) + 1
        stay = often & ~settled
        live, part = live[stay], part[stay]
        if len(live):
            part = np.unique(part, return_inverse=True)[1]
            long = np.bincount(part)[part] >= LEAST
            live, part = live[long], part[long]
            segment = np.unique(part, return_inverse=True)[1] if len(part) else part
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, own = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    long = np.bincount(own)[own] >= LEAST
    return at[long], own[long]


class _Runs:
    """Runs found so far, by period: starts and ends, ascending."""

    def __init__(self) -> None:
        self.by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def inside(self, start: np.ndarray, end: np.ndarray, q: int) -> np.ndarray:
        """Which stretches of period q lie in a run of a period that divides q."""
        out = np.zeros(len(start), bool)
        for r, (s, e) in self.by_period.items():
            if r < q and q % r == 0:
                i = np.searchsorted(s, start, "right") - 1
                out |= (i >= 0) & (e[np.maximum(i, 0)] >= end)
        return out

    def add(self, start: np.ndarray, end: np.ndarray, q: int) -> None:
        new = ~self.inside(start, end, q)
        if new.any():
            self.by_period[q] = start[new], end[new]


def _direct(words: np.ndarray, segment: np.ndarray, found: _Runs) -> None:
    for q in range(1, min(DIRECT, len(words))):
        at, size = runs_of((words[q:] == words[:-q]) & (segment[q:] == segment[:-q]))
        long = size + q >= least_length(q)
        found.add(at[long], at[long] + size[long] + q, q)


def _reach(words: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """Start and end of the longest stretch around p and p + q whose words q apart are equal; looks on in doubling steps."""
    lo, step = p, 64
    while lo > 0:
        a = max(0, lo - step)
        bad = np.flatnonzero(words[a:lo] != words[a + q : lo + q])
        if len(bad):
            lo = a + int(bad[-1]) + 1
            break
        lo, step = a, step * 2
    hi, step, last = p, 64, len(words) - q
    while hi < last:
        b = min(last, hi + step)
        bad = np.flatnonzero(words[hi:b] != words[hi + q : b + q])
        if len(bad):
            hi += int(bad[0])
            break
        hi, step = b, step * 2
    return lo, hi + q


def _anchored(words: np.ndarray, found: _Runs, offset: int) -> None:
    """Runs of periods from DIRECT on in one segment of a text; found counts from the batch's begin, offset is the segment's."""
    m = len(words)
    sums, b = hash_sums(mix(words.astype(np.uint64) + np.uint64(1))), DIRECT
    while COPIES * b <= m:
        at = np.arange(m - b + 1)
        h = span_hash(sums, at, at + b)
        rows = (len(h) - b) // b  # anchors that have b places behind them
        same = h[b : b + rows * b].reshape(rows, b) == h[: rows * b : b][:, None] if rows > 0 else np.zeros((0, b), bool)
        for r, (starts, ends) in found.by_period.items():
            for s, e in zip((starts - offset).tolist(), (ends - offset).tolist(), strict=True):
                if e - s >= 3 * b and r < 2 * b:  # what such a run's own period explains is no new lag
                    same[-(-s // b) : (e - 3 * b + 1) // b + 1, -b % r :: r] = False
        j, column = np.nonzero(same)
        p, q = j * b, b + column
        # the first anchor of a run has 3q words of the run behind it
        fits = p + 3 * q <= m
        p, q = p[fits], q[fits]
        deep = span_hash(sums, p, p + 2 * q) == span_hash(sums, p + q, p + 3 * q)
        p, q = p[deep], q[deep]
        order = np.lexsort((p, q))
        p, q = p[order], q[order]
        edge = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1], [True]))) if len(q) else np.zeros(1, np.int64)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            mine, lag = p[x:y], int(q[x])
            mine = mine[~found.inside(mine + offset, mine + 3 * lag + offset, lag)]
            starts, ends, after = [], [], -1
            for place in mine.tolist():
                if place + lag < after:
                    continue  # the stretch that was found last holds this anchor
                lo, hi = _reach(words, place, lag)
                after = hi
                if hi - lo >= least_length(lag):
                    starts.append(lo + offset)
                    ends.append(hi + offset)
            if starts:
                found.add(np.array(starts), np.array(ends), lag)
        b *= 2


def find_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts one after another, by start, then period."""
    at, segment = split(words, text)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(at):
        own = words[at]
        runs = _Runs()
        _direct(own, segment, runs)
        for q, (s, e) in runs.by_period.items():
            found.append((at[s], at[e - 1] + 1, np.full(len(s), q)))
        edge = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a < COPIES * DIRECT:
                continue
            near = _Runs()
            for q, (s, e) in runs.by_period.items():
                i, j = np.searchsorted(s, (a, b))
                if j > i:
                    near.by_period[q] = s[i:j], e[i:j]
            known = set(near.by_period)
            _anchored(own[a:b], near, a)
            for q, (s, e) in near.by_period.items():
                if q not in known:
                    found.append((at[s], at[e - 1] + 1, np.full(len(s), q)))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def looped(n: int, seed: int | None) -> np.ndarray:
    """Which original word stands at each of n places; a seed divisible by ten repeats the words from a place on."""
    at = np.arange(n)
    if seed is not None and seed % 10 == 0 and n:
        g = seed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, kept string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, loop: bool = False) -> DataFrame:
    """row (a struct of the carried columns, by default all), n_words, runs (by start, then period) and kept, for every row.

    A run is a stretch of words with smallest period q and at least max(6, 4q) words that neither neighbour extends. kept is the text without
    the words that some run holds after its first q, joined by one space; n_words counts the words before. With loop, texts are first
    made periodic as crc32 of their decimal id says (a tenth of them), which plants runs of every length.

    Null and empty texts and texts of white space have no words, no runs and an empty kept text; a null id loops nothing. Repeated rows
    stay, each with its result. A text of any length is one piece of work, n log n in its words; texts share a pass of 1 MB. An empty
    table gives no rows. Carried columns stand in a struct, so their names cannot clash.
    """
    carry = docs.columns if carry is None else carry
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in carry]
    rows = docs.select(F.struct(*quoted).alias("row"), F.col(id_col).cast("string").alias("_id"), blob(text_col).alias("text"))
    schema = StructType([rows.schema["row"], *_parse_datatype_string(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            ids = batch.column("_id")
            _, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                seeds = [zlib.crc32(i.encode()) if loop and i is not None else None for i in ids.slice(a, b - a).to_pylist()]
                made = _batch(batch.column("text").slice(a, b - a).to_pylist(), seeds)
                columns = [batch.column("row").slice(a, b - a), *(pa.array(x, f.type) for x, f in zip(made, list(out)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, schema)


def _batch(texts: list[bytes], seeds: list[int | None]) -> tuple[list, list, list]:
    listed = [t.split() for t in texts]  # on 0x20 and 0x09-0x0D
    sizes = np.array([len(x) for x in listed])
    first = np.concatenate(([0], np.cumsum(sizes)))
    flat_words = [x for words in listed for x in words]
    numbers = pa.array(flat_words, pa.binary()).dictionary_encode().indices.to_numpy()
    source = np.concatenate([looped(len(x), s) + f for x, s, f in zip(listed, seeds, first[:-1].tolist(), strict=True)]) if len(listed) else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start, end, period = find_runs(numbers[source].astype(np.int64), text)
    step = np.zeros(len(source) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    keep = np.cumsum(step[:-1]) == 0
    bounds = np.searchsorted(start, first)
    runs, kept = [], []
    for i in range(len(listed)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        f, g = int(first[i]), int(first[i + 1])
        runs.append([{"start": s - f, "length": e - s, "period": q} for s, e, q in zip(start[a:b].tolist(), end[a:b].tolist(), period[a:b].tolist(), strict=True)])
        words = listed[i] if a == b and seeds[i] is None else [flat_words[x] for x in source[f:g][keep[f:g]].tolist()]
        kept.append(b" ".join(words).decode("utf-8", "replace"))
    return sizes.tolist(), runs, kept


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents"), carry=["doc_id"], loop=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    out = out.withColumn("best", best).withColumns({"start": -F.col("best.col2"), "length": F.col("best.length"), "period": -F.col("best.col3")})
    return out.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
