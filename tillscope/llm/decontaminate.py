"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact shingle check.

Every document is cut into tiles of words, without gaps. Any window of at least 2 * tile - 1 words
holds a whole tile, so an item that stands in a document, wherever it begins, holds one; and that
tile is one of the item's own windows of that length, taken at every offset. Tiles and item windows
get 60-bit SimHash fingerprints (for each bit the majority of the words' hash bits). Two
fingerprints within `radius` bits agree in full in one of radius + 1 blocks, so joining on blocks
finds all pairs within the radius. A hit names the item-sized window of the document that it would
align with the item; the candidate is verified there, by the weight of the item's five-word
shingles (the rarer in the benchmark, the heavier) that the window has.

All places of a document, and all tile lengths, come from one pass over its words.

Items of one size class share a tile length: the longest that fits four times into the item, so
that some tile stays whole when single words are changed; the shortest for smaller items, down to
the size that holds two of them. Still smaller items are found by their shingles at every place of
the documents, without fingerprints. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import kept, sql_words, table

#: Every fifth bit of a long: twelve counters of five bits each.
EVERY_FIFTH = sum(1 << (5 * i) for i in range(12))
SHINGLE = 5
BITS = 60


@dataclass(frozen=True)
class Settings:
    """Tile lengths (at most 24: the counters have five bits), radius, least similarity.

    Items under 3 * min(tiles) - 1 words may hold no whole tile, or only one, which a changed word
    next to an end can hit; they are looked for by the shingles
    that a window with the least similarity can't do without, at every place. Under SHINGLE words an
    item is one shingle and is looked for whole.
    `broadcast_rows` bounds the item blocks, and the candidates, that are sent to all tasks (some
    20 bytes a row); beyond it Spark joins by shuffles.
    """

    tiles: tuple[int, ...] = (8, 16)
    radius: int = 3
    least: float = 0.8
    broadcast_rows: int = 400_000


def plain_words(text: Column) -> Column:
    """Words in lower case (A-Z), as 64-bit hashes."""
    text = F.coalesce(text, F.lit(""))
    # Of plain ASCII, lower() changes the same letters, in far less time.
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.transform(sql_words(lowered), lambda w: F.xxhash64(w))


def simhash(words: list[Column]) -> Column:
    """60-bit SimHash of word hashes: bit = majority of the words' bits.

    Twelve five-bit counters fit into a long, so five sums count all bits at once; adding 15 - half
    to each counter puts its majority into its top bit.
    """
    mask, lift = F.lit(EVERY_FIFTH), F.lit(EVERY_FIFTH * (15 - len(words) // 2))
    bits = None
    for shift in range(5):
        total = lift
        for w in words:
            total = total + F.shiftrightunsigned(w, shift).bitwiseAND(mask)
        major = F.shiftleft(F.shiftrightunsigned(total, 4).bitwiseAND(mask), shift)
        bits = major if bits is None else bits.bitwiseOR(major)
    return bits


def block_key(bits: Column, block: Column, tile: Column, radius: int) -> Column:
    """A fingerprint's bits of one of radius + 1 blocks that cover all, with the block and the tile
    length, as one long."""
    width = -(-BITS // (radius + 1))
    value = F.call_function("shiftrightunsigned", bits, block * width).bitwiseAND(F.lit((1 << width) - 1))
    return value + (tile.cast("long") * BITS + block) * F.lit(1 << width)


def shingles(words: Column) -> Column:
    """Distinct hashes of five words in a row; a shorter text is one shingle, an empty one has none."""
    n = F.size(words)
    rolled = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(n > 0, F.array_distinct(rolled)).otherwise(F.array().cast("array<bigint>"))


def prepared_items(benchmark: DataFrame, s: Settings) -> DataFrame:
    """item_id, words, n, tile and weighted shingles. Items without words are left out."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0").dropDuplicates(["item_id", "words"])
    fits = F.lit(0)
    for t in sorted(s.tiles):
        least = (3 if t == min(s.tiles) else 4) * t - 1
        fits = F.when(F.col("n") >= least, F.lit(t)).otherwise(fits)
    each = items.select("item_id", "n", F.explode(shingles(F.col("words"))).alias("s"))
    spread = each.groupBy("s").agg(F.count_distinct("item_id").alias("items"))
    weights = each.join(spread, "s").groupBy("item_id", "n").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("s", (1 / F.col("items")).alias("w"))))).alias("weights"))
    return items.withColumn("tile", fits).join(weights, ["item_id", "n"])


def needed(items: DataFrame, s: Settings) -> DataFrame:
    """item_id, n, shingle: the heaviest shingles, so many that a window without any of them weighs
    too little."""
    entries = F.sort_array(F.transform(F.map_entries("weights"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("s"))))
    weight = lambda some: -F.aggregate(some, F.lit(0.0), lambda a, e: a + e["w"])
    spare = (1 - s.least) * weight(F.col("entries")) + 1e-9
    some = F.filter("entries", lambda e, i: weight(F.slice("entries", 1, i)) <= spare)
    return items.withColumn("entries", entries).select("item_id", "n", F.explode(F.transform(some, lambda e: e["s"])).alias("shingle"))


def candidates(docs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, item_id, start): item-sized windows whose tile lies within the radius of the item's.

    `start` is the place, from 0, where the item would begin; it may lie before the document.
    """
    found = None
    words = docs.select("doc_id", plain_words(F.col("text")).alias("words"))
    tiles = [r.tile for r in items.where("tile > 0").select("tile").distinct().orderBy("tile").collect()]  # of s.tiles
    of_items = needed(items.where(F.col("tile") == 0).where(F.col("n") >= SHINGLE), s).select(
        "item_id", "n", F.lit(0).alias("offset"), F.lit(None).cast("long").alias("bits"), F.col("shingle").alias("key"))
    for tile in tiles:
        windows = items.where(F.col("tile") == tile).select("item_id", "n", "words", F.explode(F.expr(f"sequence(0, n - {tile})")).alias("offset"))
        windows = windows.select("item_id", "n", "offset", simhash([F.col("words")[F.col("offset") + i] for i in range(tile)]).alias("bits"))
        windows = windows.withColumn("block", F.explode(F.array(*map(F.lit, range(s.radius + 1)))))
        of_items = of_items.unionByName(windows.withColumn("key", block_key(F.col("bits"), F.col("block"), F.lit(tile), s.radius)).drop("block"))
    of_items = kept(of_items, "item-keys")
    rows = of_items.count()
    if rows:
        # Each text is split once. Tile 0: the shingle at every place, without a fingerprint.
        kinds = [0] * (not of_items.where("bits is null").isEmpty()) + tiles
        places = words.withColumn("n", F.size("words")).withColumn("tile", F.explode(F.array(*map(F.lit, kinds))))
        step, size = F.greatest("tile", F.lit(1)), F.when(F.col("tile") == 0, SHINGLE).otherwise(F.col("tile"))
        places = places.where(F.col("n") >= size)
        places = places.select("doc_id", "words", "n", "tile", F.explode(F.sequence(F.lit(0), F.col("n") - size, step)).alias("at"))
        # A place's words, as far as its kind goes.
        each = [F.col("words")[F.least(F.col("at") + i, F.col("n") - 1)].alias(f"w{i}") for i in range(max([SHINGLE * (0 in kinds), *tiles]))]
        places = places.select("doc_id", "tile", "at", *each)
        own = F.lit(None).cast("long")
        for tile in tiles:
            own = F.when(F.col("tile") == tile, simhash([F.col(f"w{i}") for i in range(tile)])).otherwise(own)
        places = places.withColumn("own", own).withColumn("block", F.explode(
            F.when(F.col("tile") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, range(s.radius + 1))))))
        key = block_key(F.col("own"), F.col("block"), F.col("tile"), s.radius)
        if 0 in kinds:
            key = F.when(F.col("tile") == 0, F.xxhash64(*[f"w{i}" for i in range(SHINGLE)])).otherwise(key)
        places = places.select("doc_id", "at", "own", key.alias("key"))
        hits = places.join(F.broadcast(of_items) if rows <= s.broadcast_rows else of_items, "key")
        hits = hits.where(F.expr(f"own is null and bits is null or bit_count(own ^ bits) <= {s.radius}"))
        # Every window that has the shingle, for words may have come in or gone elsewhere.
        begins = F.sequence(F.greatest(F.col("at") - F.col("n") + SHINGLE, F.lit(0)), F.col("at"))
        found = hits.select("doc_id", "item_id", F.explode(F.when(F.col("own").isNull(), begins).otherwise(F.array(F.col("at") - F.col("offset")))).alias("start"))
    short = items.where("tile = 0").where(F.col("n") < SHINGLE).select("item_id", "n", F.xxhash64("words").alias("whole"))
    sizes = [r.n for r in short.select("n").distinct().collect()]  # under SHINGLE: a few numbers
    for n in sizes:
        starts = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("words", i + 1, n)).alias("whole")))  # noqa: B023
        windows = words.where(F.size("words") >= n).select("doc_id", F.explode(starts).alias("x")).select("doc_id", "x.*")
        hits = windows.join(short.where(F.col("n") == n), "whole").select("doc_id", "item_id", F.col("at").alias("start"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start")).limit(0)
    return found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, similarity (best window), start_word.

    Ties go to the first window. NULL and empty texts and items match nothing; repeated documents
    with one doc_id count as one, with the best of their windows; equal items are all named.
    Empty tables: no rows. Extra columns are not read.
    """
    items = kept(prepared_items(benchmark, s), "items")
    hits = kept(candidates(docs, items, s), "candidates")
    # Few candidates go to the texts, so that no text is shuffled; many meet them by a shuffle.
    few = hits.count() <= s.broadcast_rows
    texts = docs.select("doc_id", F.col("text").alias("_text")).where("_text is not null")
    # A text is split once, before it meets its candidates.
    ids = hits.select("doc_id").distinct()
    texts = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("doc_id", plain_words(F.col("_text")).alias("own"))
    of = lambda keys: F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.element_at("weights", k))
    held = texts.join(F.broadcast(hits) if few else hits, "doc_id").join(items.withColumn("total", of(F.map_keys("weights"))), "item_id")
    first = F.greatest(F.col("start"), F.lit(0)).cast("int")
    window = F.slice("own", first + 1, F.greatest(F.least(F.col("start") + F.col("n"), F.size("own")) - first, F.lit(0)).cast("int"))
    held = held.select("doc_id", "item_id", first.alias("first"), "weights", "total", window.alias("window"))
    held = held.withColumn("common", F.array_intersect(shingles(F.col("window")), F.map_keys("weights")))
    held = held.select("doc_id", "item_id", "first", (of(F.col("common")) / F.col("total")).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("first")).alias("before")))
    # A filter before the grouping would weigh each window twice.
    return held.groupBy("doc_id", "item_id").agg(best.alias("b")).where(F.col("b.similarity") >= s.least).select(
        "doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.before")).alias("start_word"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drops the documents that hold a benchmark item; all columns pass through."""
    hits = kept(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)
