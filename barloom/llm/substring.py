"""Substring removal across documents: an FM-index per shard answers which windows an earlier document holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, blob, table, word_spans
from .fm_index import FMIndex
from .winnow import Windows, candidates, contents, covered, extract, keyed, spans_by_text, with_shards

WORDS = Windows("words", 50, 10)
#: Bytes of passages that one FM-index holds.
SHARD_BYTES = 1 << 20


def _matcher(how: Windows, schema):
    def match(rows: pa.Table) -> pa.Table:
        """Index the shard's passages, stream them through it, and give each window's least document."""
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = rows.combine_chunks()
        firsts = rows.column("first").combine_chunks()
        ids = pc.unique(firsts)
        ids = ids.take(pc.array_sort_indices(ids))
        owner = pc.index_in(firsts, ids).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols: dict[bytes, int] = {}
        parts = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in p.split(b" ")], np.int64) for p in rows.column("part").to_pylist()]
        index = FMIndex(parts, owner, len(symbols) + 1, how.window)
        least = [index.class_least[c] for c in index.matching_classes(parts)]
        sizes = np.array([len(x) for x in least])
        value = np.concatenate(least)
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        new[np.cumsum(sizes) - sizes] = True
        at = np.flatnonzero(new)
        part = np.repeat(np.arange(len(sizes)), sizes)[at]
        runs = pa.StructArray.from_arrays(
            [
                pa.array(at - (np.cumsum(sizes) - sizes)[part], pa.int32()),
                pa.array(np.diff(np.append(at, len(value))), pa.int32()),
                ids.take(pa.array(value[at])),
            ],
            ["off", "len", "least"],
        )
        begin = np.searchsorted(part, np.arange(len(sizes) + 1))
        listed = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), runs)
        out = pa.table({"h": rows.column("h"), "c": rows.column("c"), "runs": listed})
        return out.cast(to_arrow_schema(schema))

    return match


def repeated_windows(docs: DataFrame, how: Windows, scratch: Scratch) -> DataFrame:
    """_id, _key, spans (of words): windows whose words also start in a document of smaller id."""
    known = docs.where("_id is not null")
    rows = candidates(known, how, scratch, across_texts=True)
    parts = scratch.put(extract(known, contents(rows), how))
    id_type = docs.schema["_id"].dataType.simpleString()
    schema = _parse_datatype_string(f"h long, c long, runs array<struct<off:int,len:int,least:{id_type}>>")
    found = with_shards(parts, SHARD_BYTES).groupBy("shard").applyInArrow(_matcher(how, schema), schema)
    found = scratch.put(found.groupBy("h", "c").agg(F.first("runs").alias("runs")))
    scratch.drop(parts)
    return spans_by_text(rows, found, how, lambda r: r["least"] < F.col("_id"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, how: Windows = WORDS, layout: bool = False
) -> DataFrame:
    """Remove every word covered by a window that also starts in a document of smaller id.

    Returns row (a struct of the columns in carry, by default the id), n_words, n_removed, kept (words joined by one
    space; with layout the text as it was but for the removed words and the white space behind each) for every row. Windows are judged on the input and never cross documents. Null texts have no words; texts
    shorter than a window stay whole; rows with a null id neither lose words nor count as earlier; rows that share an id do
    not remove each other's words; an empty table gives no rows. Extra columns may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    carry = [id_col] if carry is None else carry
    spans = scratch.put(repeated_windows(keyed(docs, id_col, text_col), how, scratch))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), F.struct(*carry).alias("row"), blob(text_col).alias("text")
    )
    joined = rows.join(spans, ["_id", "_key"], "left").select("row", "text", "spans")
    schema = StructType([joined.schema["row"], *_parse_datatype_string("n_words long, n_removed long, kept string").fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_py()
                words = raw.split()
                n_words.append(len(words))
                removed, rest = 0, raw if layout else b" ".join(words)
                if spans.is_valid:
                    gone = covered(len(words), spans.as_py())
                    removed = int(gone.sum())
                    if layout:
                        starts, _, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                        stay, byte = np.concatenate(([True], ~gone)), np.concatenate(([0], starts, [len(raw)]))
                        rest = b"".join(raw[byte[i] : byte[i + 1]] for i in np.flatnonzero(stay))
                    else:
                        rest = b" ".join([words[i] for i in np.flatnonzero(~gone)])
                n_removed.append(removed)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(apply, schema)


def op5_fm_index(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
