"""Nearest vectors by a permutation index.

A few pivots order every vector: its list names the NEAREST pivots by similarity, nearest first. Vectors alike see the pivots in much the same
order, so the footrule distance of two lists (the sum over pivots of how far their places differ, a pivot not listed standing behind the
last) ranks candidates without touching a vector. With lists of k pivots it is k(k + 1) - 2 * sum over shared pivots of (k - the later
of the two places): a pivot's inverted file posts this weight for each row of a block, and a query adds up the files of its own pivots.
The best share of each block by footrule is reranked by exact inner products.

Inner products of unequal lengths become angles by one more coordinate, sqrt(M^2 - |x|^2), for indexed vectors and pivots and 0 for queries.

Rows of the index are dealt by hash to RANGES parts, queries to blocks of QUERIES. A task holds the queries of one block and streams the index
rows of one part past them, so its memory is bounded by both parameters; it returns one row of at most `top` neighbours for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, table

#: Pivots (a sample of the vectors by least hash; a parameter of the fit) and how many of them a vector's list names.
PIVOTS, NEAREST = 128, 64
#: Share of a block of index rows that is reranked, and the fewest rows of it.
SHARE, FEWEST = 0.1, 256
RANGES, QUERIES, ROWS = 8, 4_096, 4_096


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of doubles) and h of the rows that take part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~odd & F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("id", "v"))


def squared(column: str) -> F.Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x)


def weights(vectors: np.ndarray, pivots: np.ndarray, longest: float, indexed: bool) -> np.ndarray:
    """For each pivot and vector the list's length less the pivot's place, 0 for a pivot not listed. pivots: with their last coordinate."""
    sim = vectors @ pivots[:, :-1].T
    if indexed:
        sim += np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(1), 0.0))[:, None] * pivots[:, -1]
    k = min(NEAREST, len(pivots))
    order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    out = np.zeros((len(pivots), len(vectors)), np.uint16)
    out[order, np.arange(len(vectors))[:, None]] = np.arange(k, 0, -1, dtype=np.uint16)
    return out


class _Block:
    """The queries of one task and their best rows so far."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, top: int) -> None:
        self.ids, self.keys, self.vectors, self.top = ids, keys, vectors, top
        self.pivots, self.longest = pivots, longest
        posted = weights(vectors, pivots, longest, False)
        self.listed = [np.flatnonzero(posted[:, i]) for i in range(len(ids))]
        self.own = [posted[x, i][:, None] for i, x in enumerate(self.listed)]
        self.best = [(np.empty(0, ids.dtype), np.empty(0)) for _ in range(len(ids))]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        files = weights(vectors, self.pivots, self.longest, True)
        wanted = min(len(ids), max(FEWEST, -int(-SHARE * len(ids) // 1)))
        for i, (x, own) in enumerate(zip(self.listed, self.own, strict=True)):
            if wanted < len(ids):
                near = np.minimum(files[x], own).sum(axis=0, dtype=np.uint16)
                at = np.flatnonzero(near >= np.partition(near, len(ids) - wanted)[len(ids) - wanted])  # ties come along
            else:
                at = np.arange(len(ids))
            at = at[ids[at] != self.ids[i]]
            scores = (vectors[at] * self.vectors[i]).sum(axis=1)  # row by row, so equal vectors score the same
            old_ids, old = self.best[i]
            if len(old) == self.top:
                good = scores >= old[-1]
                at, scores = at[good], scores[good]
                if not len(at):
                    continue
            new_ids, new = np.concatenate((old_ids, ids[at])), np.concatenate((old, scores))
            order = np.lexsort((new_ids, -new))[: self.top]
            self.best[i] = new_ids[order], new[order]


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS) -> tuple[np.ndarray, float]:
    """Distinct vectors of least hash, as unit vectors with their last coordinate, and the largest length. Only these come to the driver."""
    longest = float(np.sqrt(rows.agg(F.max(squared("v"))).first()[0] or 0.0))
    named = rows.groupBy(F.xxhash64("v").alias("k")).agg(F.first("v").alias("v")).orderBy("k").limit(pivots).collect()
    vectors = np.array([r["v"] for r in named], np.float64)
    if not len(vectors):
        return vectors, longest
    last = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(1), 0.0))
    return np.column_stack((vectors, last)) / longest, longest


def nearest(
    df: DataFrame,
    is_query: F.Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    top: int = 20,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the `top` rows of largest inner product found for every query, nearest first, ties to smaller id.

    Every row with an id and a usable vector is indexed; queries are those for which is_query holds (by default an id divisible by 20). Rows of
    the query's own id are no candidates. Scores are inner products of the original vectors in double precision.

    Vectors that are null, all zero, or hold null or non-finite values take no part, nor do vectors of another length than the most
    frequent one (ties: the longer). Equal rows are one query but stay candidates each; an id with several vectors is a query with each.
    Empty tables, or tables without a query, give no rows; further columns are not read, so their names cannot clash. A query whose
    vector no row shares a pivot with still gets its nearest, as every block gives its best share.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    every = usable(df, id_col, vector_col)
    sizes = every.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    id_type = every.schema["id"].dataType.simpleString()
    result = _parse_datatype_string(f"query_id {id_type}, rank int, id {id_type}, score double")
    if sizes is None:
        return spark.createDataFrame([], result)
    rows = scratch.put(every.where(F.size("v") == sizes["d"]))
    asked = rows.where(F.col("id") % 20 == 0 if is_query is None else is_query).dropDuplicates(["id", "h"])
    n = asked.count()
    model, longest = fit_pivots(rows, pivots)
    blocks = max(1, -(-n // QUERIES))
    parts = RANGES * blocks
    deal = lambda cell: F.pmod(F.col("h"), F.lit(RANGES)) * blocks + cell
    index = rows.select("id", "h", "v", F.lit(0).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    index = index.withColumn("cell", deal(F.col("b")).cast("int")).drop("b")
    asked = asked.select("id", "h", "v", F.lit(1).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("g"))
    asked = asked.withColumn("cell", (F.col("g") * blocks + F.pmod(F.xxhash64("h"), F.lit(blocks))).cast("int")).drop("g")
    cells = index.unionByName(asked).repartition(parts, "cell").sortWithinPartitions("cell", F.desc("asks"))
    schema: StructType = _parse_datatype_string(f"query_id {id_type}, h long, ids array<{id_type}>, scores array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        cell, block, asking, waiting, held = None, None, [], [], 0

        def arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = pa.Table.from_batches(batches)
            v = t.column("v").combine_chunks()
            return t.column("id").to_numpy(), t.column("h").to_numpy(), v.flatten().to_numpy().reshape(len(v), -1)

        def flush() -> None:
            nonlocal block, asking, waiting, held
            if block is None and asking:
                block = _Block(*arrays(asking), model, longest, top)
            if block is not None and waiting:
                ids, _, v = arrays(waiting)
                for s in range(0, len(ids), ROWS):
                    block.search(ids[s : s + ROWS], v[s : s + ROWS])
            waiting, held = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, asking
            flush()
            if block is not None:
                listed = [pa.array([x[j] for x in block.best], f.type) for j, f in ((0, out.field("ids")), (1, out.field("scores")))]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids, out.field("query_id").type), pa.array(block.keys), *listed], schema=out)
            block, asking = None, []

        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if cell != cells[a]:
                    yield from close()
                    cell = cells[a]
                part = batch.slice(a, b - a)
                if asks[a]:
                    asking.append(part)
                    continue
                waiting.append(part)
                held += b - a
                if held >= ROWS:
                    flush()
        yield from close()

    found = cells.mapInArrow(run, schema).select("query_id", "h", F.inline(F.arrays_zip("ids", "scores")))
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("scores"), "ids")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("ids").alias("id"), F.col("scores").alias("score"))


def op11_permutation_index(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
