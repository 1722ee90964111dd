"""Near-duplicate classes: SetSketch registers propose pairs, a likelihood estimate thins them, full sets confirm.

1. Rows of equal shingle sets (a 128-bit fingerprint) become one set; all later work is on distinct sets.
2. Four neighbouring registers make a band; sets that share a band meet in a bucket. At similarity 0.8 a pair shares
   none of the 32 bands with probability 5e-8.
3. Every bucket first links its members to its least member: linear in the bucket. Confirmed links give components.
4. In buckets that still hold several components, pairs across components are compared in blocks of BLOCK members, each
   pair in the first band it shares: by registers first, and where the estimate does not rule them out by their sets, inside
   the task. Only pairs that hold leave it. Members of a bucket's largest component meet the others only, so a large group
   of near copies costs rows and pairs in proportion to its size; no bucket, block or partner is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from .common import Scratch, blob, chunks, flat, mix, powers, span_hash, table, word_hashes, word_spans
from .components import components
from .setsketch import M, jaccard, sketch

ROWS_A_BAND = 4
#: Pairs whose estimate is below are ruled out: six standard deviations of 128 registers under 0.8.
RULED_OUT = 0.59
#: Members of a bucket that one task compares with each other.
BLOCK = 1_000

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FOLD_ARRAY = np.frombuffer(_FOLD, np.uint8)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of consecutive texts and the text of each; distinct within a text, ascending."""
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(1, count - size + 1))
    text = np.repeat(np.arange(len(n)), n)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][text]
    end = np.minimum(begin + size, first[1:][text])
    h = span_hash(sums, begin, end)
    at = np.cumsum(n) - n
    for a, k in zip(at.tolist(), n.tolist(), strict=True):
        h[a : a + k].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, text = shingles(_FOLD_ARRAY[data], offsets, size)
    return h, text, np.bincount(text, minlength=len(offsets) - 1)


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                h, text, n = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                registers = sketch(h, text, b - a)
                marks = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h ^ np.uint64(salt)), out=sums[1:])
                    ends = np.cumsum(n)
                    marks.append((sums[ends] - sums[ends - n]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(a, b - a),
                        batch.column("_key").slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    ["_id", "_key", "n", "f1", "f2", "registers"],
                )

    return run


def _lister(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for a, b in chunks(offsets):
                h, _, n = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                at = np.concatenate(([0], np.cumsum(n)))
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a), listed], ["_id", "items"])

    return run


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            j = jaccard(_registers(batch.column("ra")), _registers(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.filter(pa.array(j >= RULED_OUT)).select(["u", "v"])


def _meet(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two ascending arrays share."""
    at = b.searchsorted(a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def _across(rows: pa.Table) -> pa.Table:
    """Linked pairs of one bucket's block (or of two) in different components.

    A call gets the blocks of many buckets; pairs of all of them are judged together, some 50,000 at a time. Sets come as
    31 bits of each shingle; a pair that holds give or take a shared value in a hundred is passed on to be confirmed.
    """
    rows = rows.combine_chunks()
    r, n = _registers(rows.column("registers")), rows.column("n").to_numpy()
    items = rows.column("items").combine_chunks()
    values, ends = items.values.to_numpy(), items.offsets.to_numpy()
    sets: dict[int, np.ndarray] = {}
    roots = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
    side, bucket, band = (rows.column(c).to_numpy() for c in ("side", "bucket", "band"))
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    out: list[tuple[int, int]] = []

    def of(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = np.sort(values[ends[k] : ends[k + 1]])
        return sets[k]

    def judge() -> None:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            same = r[a] == r[b]
            first = same.reshape(len(a), -1, ROWS_A_BAND).all(axis=2).argmax(axis=1)
            near = (first == band[a]) & (same.sum(axis=1) >= RULED_OUT * M * 0.75)
            a, b = a[near], b[near]
            likely = jaccard(r[a], r[b], n[a], n[b]) >= RULED_OUT
            for u, v in zip(a[likely].tolist(), b[likely].tolist(), strict=True):
                both = _meet(of(u), of(v))
                if 101 * both + 100 >= 80 * (n[u] + n[v] - both):
                    out.append((u, v))

    count = 0
    for at in np.split(order, cuts):
        left, right = at[side[at] <= 1], at[side[at] != 1]
        step = max(1, 50_000 // max(1, len(right)))
        for k in range(0, len(left), step):
            i = np.repeat(left[k : k + step], len(right))
            j = np.tile(right, len(left[k : k + step]))
            fit = (roots[i] != roots[j]) & (n[j] * 5 >= n[i] * 4) & (n[i] * 5 >= n[j] * 4) & ((side[i] == 1) | (i < j))
            held.append((i[fit], j[fit]))
            count += len(i)
            if count > 50_000:
                judge()
                count = 0
    if held:
        judge()
    ids = rows.column("_id")
    return pa.table({c: ids.take(pa.array([p[k] for p in out], pa.int64())) for k, c in enumerate("uv")})


def _confirm(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of the pairs whose full sets have 100 * intersection >= 80 * union."""
    pairs = scratch.put(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    joined = pairs.join(sets.select(F.col("_id").alias("v"), F.col("items").alias("b")), "v").join(
        sets.select(F.col("_id").alias("u"), F.col("items").alias("a")), "u"
    )
    both = F.size(F.array_intersect("a", "b"))
    confirmed = scratch.put(joined.where(100 * both >= 80 * (F.size("a") + F.size("b") - both)).select("u", "v"))
    scratch.drop(pairs)
    return confirmed


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """Return the id, a hash of the text (_key), n_shingles and component_id for every row of docs.

    Words are runs of bytes other than white space, with A-Z lower-cased; a set is the distinct shingles of `size` words,
    the whole text if it has fewer words. Sets with 100 * intersection >= 80 * union are linked; component_id is the
    least id reachable. Null and empty texts have no shingles and no links; rows of a null id keep a null component;
    rows that share an id are one node; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_key"), blob(text_col).alias("text"))
    kind = keyed.schema["_id"].dataType.simpleString()
    rows = scratch.put(keyed.mapInArrow(_sketcher(size), f"_id {kind}, _key long, n long, f1 long, f2 long, registers binary"))
    sets = rows.where("_id is not null and n > 0").groupBy("f1", "f2").agg(F.min("_id").alias("_id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    sets = scratch.put(sets)

    width = 2 * ROWS_A_BAND
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(M // ROWS_A_BAND - 1)),
        lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))).alias("bucket")),
    )
    members = sets.select("_id", F.explode(bands).alias("b")).select("_id", "b.band", "b.bucket")
    leaders = members.groupBy("bucket").agg(F.min("_id").alias("u"), F.count("*").alias("members")).where("members > 1")
    leaders = scratch.put(leaders)  # a join of two plain exchanges can split a bucket of many members
    buckets = scratch.put(members.join(leaders, "bucket"))
    scratch.drop(leaders)
    known = sets.select("_id", "n", "registers")
    needed = buckets.select("_id").distinct()
    full = scratch.put(keyed.join(needed, "_id", "left_semi").mapInArrow(_lister(size), f"_id {kind}, items array<long>"))
    pairs = buckets.where("_id <> u").select("u", F.col("_id").alias("v")).distinct()
    sized = pairs.join(known.select(F.col("_id").alias("v"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "v")
    sized = sized.join(known.select(F.col("_id").alias("u"), F.col("n").alias("na"), F.col("registers").alias("ra")), "u")
    sized = sized.where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
    links = _confirm(sized.mapInArrow(_likely, f"u {kind}, v {kind}"), full, scratch)
    roots = scratch.put(components(links, scratch))

    rooted = buckets.join(roots.withColumnRenamed("node", "_id"), "_id", "left").select("bucket", "band", "_id", "members", F.coalesce("root", "_id").alias("root"))
    shares = rooted.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots"), F.sum("k").alias("all")).where("roots > 1")
    mixed = mixed.select("bucket", F.col("top.root").alias("main"), F.col("top.k").alias("mains"), (F.col("all") - F.col("top.k")).alias("others"))
    open_ = scratch.put(rooted.drop("members").join(mixed, "bucket").withColumn("is_main", F.col("root") == F.col("main")).drop("main"))
    scratch.drop(buckets)
    few, many = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("others", "mains"))
    own = F.pmod(F.xxhash64(F.lit("block"), "_id"), F.when(F.col("is_main"), many).otherwise(few)).cast("int")

    def hand(x, y, side):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))

    # a block of others meets itself (side 0) and, as the lower (1) or higher (2) one, every other such block of its bucket;
    # a block of the largest component (2) meets every block of others (1)
    blocks = F.sequence(F.lit(0), few - 1)
    among = F.transform(blocks, lambda k: hand(F.least(own, k), F.greatest(own, k), F.when(own == k, 0).when(own < k, 1).otherwise(2)))
    across = F.transform(F.sequence(F.lit(0), many - 1), lambda k: hand(own, few + k, F.lit(1)))
    meet = F.when(F.col("is_main"), F.transform(blocks, lambda k: hand(k, few + own, F.lit(2)))).otherwise(F.concat(among, across))
    hands = max(1, -(-open_.count() // (2 * BLOCK)))
    short = full.select("_id", F.transform("items", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("items"))
    dealt = open_.join(known, "_id").join(short, "_id").select("bucket", "band", "_id", "root", "n", "registers", "items", F.explode(meet).alias("m"))
    dealt = dealt.select("bucket", "band", "_id", "root", "n", "registers", "items", "m.*")
    more = dealt.groupBy(F.pmod("bucket", F.lit(hands)).alias("hand"), "x", "y").applyInArrow(_across, f"u {kind}, v {kind}")
    more = _confirm(more, full, scratch)
    scratch.drop(open_)
    joined = more.join(roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(
        roots.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left"
    )
    higher = scratch.put(components(joined.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")), scratch))

    by_set = sets.select("f1", "f2", F.col("_id").alias("node")).join(roots, "node", "left").select("f1", "f2", F.coalesce("root", "node").alias("node"))
    by_set = by_set.join(higher.withColumnRenamed("root", "top"), "node", "left").select("f1", "f2", F.coalesce("top", "node").alias("top"))
    out = rows.select("_id", "_key", "n", "f1", "f2").join(by_set, ["f1", "f2"], "left")
    return out.select(
        F.col("_id").alias(id_col), "_key", F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("top", "_id")).alias("component_id")
    )


def op3_setsketch(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
