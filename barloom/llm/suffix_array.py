"""Exact repeated byte strings: suffix arrays by the difference-cover algorithm, one per shard of candidate passages.

Windows are dealt to shards by their minimiser (winnow), so all places of a window are in one shard and the shards'
suffix arrays together answer what one array over the corpus would. Within a shard the skew (DC3) algorithm sorts the
triples at positions 1 and 2 modulo 3, recurses on their names, sorts the other suffixes by one byte and a rank, merges,
and compares each suffix's first bytes with its neighbour's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, blob, prefix_hash, span_hash, table
from .winnow import Windows, candidates, contents, covered, extract, keyed, runs_of, spans_by_text, with_shards

BYTES = Windows("bytes", 400, 100)
#: Bytes of passages that one suffix array holds.
SHARD_BYTES = 192 << 10


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, name of each in that order) of rows of small integers, equal rows sharing a name from 1."""
    key, limit = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if limit * size >= 1 << 62:  # too wide for one integer: rank what there is so far
            key = np.unique(key, return_inverse=True)[1]
            limit = len(key) + 1
        key, limit = key * size + c, limit * size
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    return order, np.cumsum(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of integers >= 1; a suffix that ends is less than one that goes on."""
    n = len(text)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate((text.astype(np.int64), [0, 0, 0, 0]))
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    order, names = _names([s[sample], s[sample + 1], s[sample + 2]])
    if names[-1] == len(sample):
        by_rank = sample[order]
    else:
        named = np.empty(len(sample), np.int64)
        named[order] = names
        by_rank = sample[suffix_array(named)]
    rank = np.zeros(n + 4, np.int64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]

    rest = np.arange(0, n, 3)
    top = len(sample) + 2
    rest_key = s[rest] * top + rank[rest + 1]
    at = np.argsort(rest_key, kind="stable")
    rest, rest_key = rest[at], rest_key[at]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(s[first] * top + rank[first + 1], rest_key)
    wide = int(s.max()) + 1
    if wide * wide * top < 1 << 62:
        before += np.searchsorted((s[second] * wide + s[second + 1]) * top + rank[second + 2], (s[rest] * wide + s[rest + 1]) * top + rank[rest + 2])
    else:
        both = np.concatenate((second, rest))
        order, names = _names([s[both], s[both + 1], rank[both + 2]])
        named = np.empty(len(both), np.int64)
        named[order] = names
        before += np.searchsorted(named[: len(second)], named[len(second) :])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    other = np.ones(n, bool)
    other[place] = False
    out[other] = by_rank
    return out


def equal_prefixes(text: np.ndarray, order: np.ndarray, inside: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares its first `length` values with the one before; equal hashes are compared in full."""
    same = np.zeros(len(order), bool)
    sums = prefix_hash(text)
    last = np.minimum(order + length, len(text))
    h = span_hash(sums, order, last)
    ok = inside[order]
    same[1:] = ok[1:] & ok[:-1] & (h[1:] == h[:-1])
    at = np.flatnonzero(same)
    step = np.arange(length)
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        same[part] = (text[order[part][:, None] + step] == text[order[part - 1][:, None] + step]).all(axis=1)
    return same


def repeated(parts: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    """For each part and window whether the window stands at two places or more; part i stands at places[i] of them."""
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    position = np.arange(len(text))
    inside = position + window <= (begin + sizes)[owner]
    order = suffix_array(text.astype(np.int64) + 1)
    same = equal_prefixes(text, order, inside, window)
    first = np.flatnonzero(~same)
    total = np.add.reduceat(np.where(inside, places[owner], 0)[order], first)
    twice = np.empty(len(text), bool)
    twice[order] = np.repeat(total >= 2, np.diff(np.append(first, len(order))))
    return [twice[b : b + n - window + 1] for b, n in zip(begin, sizes, strict=True)]


_FOUND = "h long, c long, runs array<struct<off:int,len:int>>"


def _sorter(how: Windows):
    def sort(rows: pa.Table) -> pa.Table:
        flags = repeated(rows.column("part").to_pylist(), rows.column("places").to_numpy(), how.window)
        runs = [[{"off": int(a), "len": int(n)} for a, n in zip(*runs_of(f), strict=True)] for f in flags]
        kind = pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32())]))
        return pa.table({"h": rows.column("h"), "c": rows.column("c"), "runs": pa.array(runs, kind)})

    return sort


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Windows = BYTES) -> DataFrame:
    """Remove every byte covered by a string of how.window bytes that also starts anywhere else.

    Returns the id, n_bytes, n_removed, spans (maximal removed runs {a, b} of byte offsets) and kept (the remaining bytes)
    for every row. Strings never cross texts, overlaps count, all is judged on the input. Null texts are empty, short texts
    stay whole, repeated rows remove each other's bytes, null ids are one more id, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keyed_docs = keyed(docs.withColumn("_name", F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "_name", text_col)
    rows = candidates(keyed_docs, how, scratch, across_texts=False)
    # rows that share id and text are at the same place in the join below: each still counts, as each was cut
    parts = scratch.put(extract(keyed_docs, contents(rows), how))
    found = with_shards(parts, SHARD_BYTES).groupBy("shard").applyInArrow(_sorter(how), _FOUND)
    found = scratch.put(found.groupBy("h", "c").agg(F.first("runs").alias("runs")))
    scratch.drop(parts)
    spans = scratch.put(spans_by_text(rows, found, how, lambda r: F.lit(True)))
    whole = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_key"),
        F.struct(F.col(id_col).alias("id")).alias("row"),
        blob(text_col).alias("text"),
    )
    joined = whole.join(spans, ["_id", "_key"], "left").select("row", "text", "spans")
    rest = "n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary"
    schema = StructType([joined.schema["row"], *_parse_datatype_string(rest).fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, removed, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py()
                gone: list[dict] = []
                rest = raw
                if spans.is_valid:
                    mask = covered(len(raw), spans.as_py())
                    gone = [{"a": int(a), "b": int(a + n)} for a, n in zip(*runs_of(mask), strict=True)]
                    rest = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                removed.append(gone)
                kept.append(rest)
            spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, spans_type), pa.array(kept, pa.binary())],
                ["row", "n_bytes", "n_removed", "spans", "kept"],
            )

    return joined.mapInArrow(apply, schema).select(F.col("row.id").alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def op8_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.octet_length("kept").cast("long").alias("n_kept"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
