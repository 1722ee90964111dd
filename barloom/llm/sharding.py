"""Weighted hash tree placement: region, then rack, then shard, by weighted hash draws.

Each child of a node draws -ln(u) / weight with u from a hash of (seed, child, key); the smallest draw wins, so a
child is chosen in proportion to its weight. A key's draw at a child depends on nothing but that child, so changed
weights move keys only into subtrees that gained and out of subtrees that lost weight: below a node none of whose
children changed, nothing moves. A shard that joins as a region of its own takes keys only into itself; one that joins
an existing region also lets that region gain keys, which then spread over that region's shards.

Everything is a column expression: no Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

ROWS_PER_BLOCK = 2_000


def grid_tree(n_shards: int, per_rack: int = 2, racks_per_region: int = 2, start: int = 8) -> Tree:
    """Equal shards: the first `start` fill regions rack by rack, with 8 two regions of two racks of two; every later one opens a
    region of its own, so that each step from n >= start to n + 1 shards takes keys only into the new shard."""
    tree: Tree = {}
    for s in range(n_shards):
        region, rack = s // (per_rack * racks_per_region), s // per_rack
        if s >= start:
            region, rack = -(-start // (per_rack * racks_per_region)) + s - start, -(-start // per_rack) + s - start
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def _weight(node: object) -> float:
    return sum(_weight(x) for x in node.values()) if isinstance(node, dict) else float(node)


def _draw(key: Column, path: str, weight: float, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(path), F.lit(seed), key), 11)
    return -F.ln((bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(weight)


def _choose(key: Column, path: str, children: dict, seed: int) -> Column:
    """Position of the chosen child; children of no weight are never chosen."""
    live = [(i, name, _weight(node)) for i, (name, node) in enumerate(children.items()) if _weight(node) > 0]
    if not live:
        raise ValueError(f"{path or 'the tree'} has no weight")
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = [F.struct(_draw(key, f"{path}/{name}", w, seed).alias("d"), F.lit(i).alias("i")) for i, name, w in live]
    return F.array_min(F.array(*draws))["i"]


def _by(position: Column, choices: list[Column]) -> Column:
    out = choices[-1]
    for i in range(len(choices) - 2, -1, -1):
        out = F.when(position == i, choices[i]).otherwise(out)
    return out


def with_shard(df: DataFrame, key: str, tree: Tree, out: str, seed: int = 0) -> DataFrame:
    """df and column out: the shard (an int) of each row's key. Null keys are one key like any other."""
    k = F.col(key)
    regions = [(f"/{r}", racks) for r, racks in tree.items() if _weight(racks) > 0]
    live_regions = {r: racks for r, racks in tree.items() if _weight(racks) > 0}
    racks = [(f"{path}/{name}", shards) for path, node in regions for name, shards in node.items() if _weight(shards) > 0]
    rack_at = {path: i for i, (path, _) in enumerate(racks)}
    region_col, rack_col = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(region_col, _choose(k, "", live_regions, seed))
    in_region = []
    for path, node in regions:
        live = {name: shards for name, shards in node.items() if _weight(shards) > 0}
        at = [F.lit(rack_at[f"{path}/{name}"]) for name in live]
        in_region.append(_by(_choose(k, path, live, seed), at))
    df = df.withColumn(rack_col, _by(F.col(region_col), in_region))
    in_rack = []
    for path, shards in racks:
        live = {s: w for s, w in shards.items() if w > 0}
        in_rack.append(_by(_choose(k, path, live, seed), [F.lit(int(s)) for s in live]))
    return df.withColumn(out, _by(F.col(rack_col), in_rack).cast("int")).drop(region_col, rack_col)


def place(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 0,
) -> DataFrame:
    """Return id, size (UTF-8 bytes + 1), text_crc32, shard, slot, grown_shard for every row of docs.

    slot numbers the rows of a shard from 0 without gaps. No task sees a whole shard: rows are numbered within
    hashed blocks of about ROWS_PER_BLOCK rows and each block adds the count of the blocks before it.
    Null texts have size 1 and the CRC of no bytes; null ids hash like one more id; repeated rows get a slot each, rows alike in id,
    CRC and size in any order among themselves;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    blocks = max(1, math.ceil(docs.count() / ROWS_PER_BLOCK / max(1, sum(len(s) for r in tree.values() for s in r.values()))))
    block = F.pmod(F.xxhash64(F.lit("block"), F.col("_id")), F.lit(blocks)).alias("_block")

    def placed(df: DataFrame) -> DataFrame:
        return with_shard(df, "_id", tree, "shard", seed).withColumn("_block", block)

    full = placed(rows)
    full = with_shard(full, "_id", grown, "grown_shard", seed) if grown else full.withColumn("grown_shard", F.lit(None).cast("int"))
    counts = placed(docs.select(F.col(id_col).alias("_id"))).groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_block").orderBy("_id", "text_crc32", "size")
    numbered = full.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_block"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), "grown_shard"
    )


def op10_weighted_tree(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = place(table(spark, sf_dir, "documents"), grid_tree(8), grid_tree(9))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
