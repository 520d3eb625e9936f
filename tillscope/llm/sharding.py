"""Shards by a weighted hash tree: regions, racks, shards.

At each level every child draws -ln(u) / weight, u decided by key and child; the least draw wins.
A child whose weight grows wins more keys and takes them from its siblings only; a new child takes
keys only into itself. So a change moves rows only into or within the subtrees whose weights
changed. A further shard is opened as a region of its own, which is why no old shard gains a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import table, unit_draw

LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Leaf:
    """A shard: where it stands, its number and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, regions: int = 2) -> list[Leaf]:
    """Shards dealt over regions and racks in equal parts; weight 1 each."""
    place = lambda s: (s * regions // shards, s * regions * racks // shards % racks)
    return [Leaf(f"r{place(s)[0]}", f"r{place(s)[0]}.k{place(s)[1]}", s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own."""
    s = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"new{s}", f"new{s}.k0", s, weight)]


def _pick(key: Column, weights: dict) -> Column:
    """The child with the least weighted draw; ties go to the first."""
    draws = [
        F.struct((-F.log(unit_draw(key, F.lit(str(child)))) / F.lit(float(w))).alias("draw"),
                 F.lit(i).alias("place"), F.lit(child).alias("child"))
        for i, (child, w) in enumerate(weights.items()) if w > 0
    ]
    return F.array_min(F.array(*draws))["child"]


def _below(tree: list[Leaf], level: str, above: tuple[str, str] | None) -> dict:
    found: dict = {}
    for leaf in tree:
        if above is None or getattr(leaf, above[0]) == above[1]:
            child = getattr(leaf, level)
            found[child] = found.get(child, 0.0) + leaf.weight
    return {k: w for k, w in found.items() if w > 0}


def descend(df: DataFrame, key: Column, tree: list[Leaf], names: tuple[str, str, str]) -> DataFrame:
    """Adds the region, rack and shard of each row under the three names."""
    region, rack, shard = names
    df = df.withColumn(region, _pick(key, _below(tree, "region", None)))
    for out, level, parent, up in ((rack, "rack", region, "region"), (shard, "shard", rack, "rack")):
        nodes = list(_below(tree, up, None))
        df = df.withColumn(out, F.coalesce(*[
            F.when(F.col(parent) == node, _pick(key, _below(tree, level, (up, node)))) for node in nodes
        ]))
    return df


def number_slots(df: DataFrame, group: str, order: list[str], rows_per_block: int = 2000) -> DataFrame:
    """Adds `slot`, gapless from 0 in each group.

    Rows are numbered in blocks by hash and the blocks get offsets from their counts, so no group
    is sorted in one task. Equal rows get different slots. Needs one count of the rows.
    """
    blocks = max(1, df.count() // rows_per_block)
    df = df.withColumn("_block", F.pmod(F.xxhash64(F.lit("slot"), *[F.col(c) for c in order]), F.lit(blocks)))
    counts = df.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(inside))
    return (numbered.join(offsets, [group, "_block"])
            .withColumn("slot", F.col("_offset") + F.col("_row") - 1).drop("_block", "_offset", "_row"))


def shard_keys(df: DataFrame, key: str, tree: list[Leaf]) -> DataFrame:
    """Adds region, rack and shard of the key column, and grown_shard with one more shard.

    NULL keys count as one key of their own.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))
    df = descend(df, text, tree, LEVELS)
    return descend(df, text, grown(tree), ("_region", "_rack", "grown_shard")).drop("_region", "_rack")


def op2(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in shards by the law `key`.

    NULL text: size 1, checksum of no bytes. Equal rows: same shard, slots in any order. Empty
    table: no rows.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shard_keys(docs, "doc_id", even_tree(shards))
    return number_slots(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard",
        "slot", "grown_shard")


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str, shards: int = 8) -> DataFrame:
    """Pipeline: each document with its shard and slot. Needs doc_id; other columns pass through,
    a column of the documents that is called like one of the new ones is replaced."""
    own = [c for c in docs.columns if c not in ("region", "rack", "shard", "slot")]
    rows = docs.select(F.struct(*own).alias("_doc"), F.col("doc_id").alias("_id"))
    rows = shard_keys(rows, "_id", even_tree(shards)).drop("grown_shard")
    rows = number_slots(rows, "shard", ["_id"])
    return rows.select("_doc.*", "region", "rack", "shard", "slot")
