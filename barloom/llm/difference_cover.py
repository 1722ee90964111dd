"""The difference-cover suffix sort as Spark jobs: triples sorted and named, recursion on the names, the rest merged by rank.

A sequence is a table of (i, c). All sorting is Spark's range sort; places in it come from each partition's offset, so no task or
driver sees the whole. A level costs some eight sorts of parts of its rows and three more shuffles, and the levels together three times
the first. The README has its figures next to those of suffix_array.py, which op8 uses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .suffix_array import suffix_array

#: Rows of a level that one task sorts by itself.
SMALL = 100_000


def numbered(df: DataFrame, scratch: Scratch, *keys: str) -> DataFrame:
    """df with at, each row's place in the order of keys, from 0; written once, so that the places stay."""
    placed = scratch.put(df.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    at = F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn("at", at).drop("_part", "_m", "_start")


def _gathered(tables: dict[str, tuple[DataFrame, str, int]]) -> DataFrame:
    """i and, for each name, the value that its table has at i + shift, 0 if none; one shuffle."""
    long = None
    for k, (df, column, shift) in enumerate(tables.values()):
        part = df.select((F.col("i") - shift).alias("i"), F.lit(k).alias("k"), F.col(column).cast("long").alias("v"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("i").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).alias(n) for k, n in enumerate(tables)])


def suffix_ranks(s: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """(i, rank) of the suffixes of a sequence: s has i from 0 without gaps and c >= 1. A suffix that ends is less than one that goes on."""
    n = s.count()
    if n <= small:

        def sort(rows: pa.Table) -> pa.Table:
            i = rows.column("i").to_numpy()
            text = np.empty(len(i), np.int64)
            text[i] = rows.column("c").to_numpy()
            order = suffix_array(np.unique(text, return_inverse=True)[1] + 1)
            return pa.table({"i": order, "rank": np.arange(len(order))})

        return scratch.put(s.select("i", F.col("c").cast("long").alias("c")).groupBy(F.lit(0)).applyInArrow(sort, "i long, rank long"))
    extra = s.sparkSession.createDataFrame([(n, 0, 0, 0)] if n % 3 == 1 else [], "i long, a long, b long, c long")
    triples = scratch.put(_gathered({"a": (s, "c", 0), "b": (s, "c", 1), "c": (s, "c", 2)}).where("i >= 0"))
    sample = scratch.put(triples.where("i % 3 <> 0").unionByName(extra))
    names = numbered(sample.select("a", "b", "c").distinct(), scratch, "a", "b", "c")
    named = scratch.put(sample.join(names, ["a", "b", "c"]).select("i", (F.col("at") + 1).alias("name")))
    if named.agg(F.max("name")).first()[0] < sample.count():
        ones = (n + 2 * (n % 3 == 1)) // 3 if n % 3 != 2 else (n + 1) // 3
        place = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(F.floor(F.col("i") / 3) + ones)
        deeper = suffix_ranks(scratch.put(named.select(place.alias("i"), F.col("name").alias("c"))), scratch, small)
        back = F.when(F.col("i") < ones, F.col("i") * 3 + 1).otherwise((F.col("i") - ones) * 3 + 2)
        ranks = scratch.put(deeper.select(back.alias("i"), (F.col("rank") + 1).alias("r")))
    else:
        ranks = named.withColumnRenamed("name", "r")
    full = _gathered({"a": (triples, "a", 0), "b": (triples, "b", 0), "r": (ranks, "r", 0), "r1": (ranks, "r", 1), "r2": (ranks, "r", 2)})
    full = scratch.put(full.where((F.col("i") >= 0) & (F.col("i") < n)).withColumn("kind", F.col("i") % 3))
    rest, first, second = (full.where(F.col("kind") == k) for k in range(3))
    own = {k: numbered(df.select("i", *keys), scratch, *keys).select("i", F.col("at").alias("own")) for k, df, keys in ((0, rest, ("a", "r1")), (1, first, ("r",)), (2, second, ("r",)))}
    with_first = numbered(rest.unionByName(first).select("i", "kind", "a", "r1"), scratch, "a", "r1")
    with_second = numbered(rest.unionByName(second).select("i", "kind", "a", "b", "r2"), scratch, "a", "b", "r2")
    # a rest suffix comes after those of its kind and after the sampled ones that both merges put before it
    a, b = (t.where("kind = 0").select("i", F.col("at").alias(c)) for t, c in ((with_first, "p"), (with_second, "q")))
    of_rest = a.join(b, "i").join(own[0], "i").select("i", (F.col("p") + F.col("q") - F.col("own")).alias("rank"))
    both = numbered(first.unionByName(second).select("i", "r"), scratch, "r").select("i", F.col("at").alias("among"))
    merged = with_first.where("kind = 1").select("i", "at").unionByName(with_second.where("kind = 2").select("i", "at"))
    of_sample = merged.join(own[1].unionByName(own[2]), "i").join(both, "i").select("i", (F.col("at") - F.col("own") + F.col("among")).alias("rank"))
    return scratch.put(of_rest.unionByName(of_sample))
