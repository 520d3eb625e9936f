"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

Rows of the incidence matrix are documents with different sets, columns are n-grams (hashes of five
words). The product of the matrix with its transpose counts common n-grams; it is formed column
block by column block, and only where size-derived bounds leave a chance:

- Two sets of sizes n <= m reach the similarity t only if n >= t * m, and then share
  (n + m) * t / (1 + t) n-grams at least.
- With all sets in one order, they also share one of the first n - ceil(t * n) + 1 n-grams of each.
  Only these entries enter the product. The order puts n-grams that many documents have last, so
  passages that are spread widely seldom enter it. (Which n-grams those are is only estimated; any
  common order gives the same result.)
- In a column, entries at places i and j leave at most min(i, j) + min(n - i, m - j) in common. In large
  columns i and j count only entries that other documents have as well: what both sets have before
  a common entry are entries of both, so an entry that stands alone in its column is none of them.
- The set whose entries end first has no more n-grams in common than it has entries that do not stand
  alone and n-grams that are no entries.
- Nothing before a pair's first common entry at places i and j is common, so min(n - i, m - j) and, with
  what stands alone left out, what either set has from there on are bounds. Of a pair in large columns
  only those columns count that may be its first, as the `earlier` entries before it tell; each such pair
  is then counted on the sets' entries.
- Every set has a sketch: of each of 512 parts of the hashes, whether it has an odd number of n-grams. A bit
  differs only if an n-gram is in one set alone, and sets that reach t have at most
  (n + m) * (1 - t) / (1 + t) such n-grams.
- Overlap counts are accumulated over all columns of a pair. The set whose entries end first has
  found all its entries that the other set has, so with c common entries and k entries of n, at
  most c + n - k n-grams are common. Behind a common entry at places i and j there are at most
  min(n - i, m - j) - 1 more, and all before it have been counted.

Pairs that remain are verified on the whole sets. A column with more than `small` documents first
gives pairs with its most central document alone; when the components of those links are known, it gives
the pairs of documents that are not connected yet. So no link between components is lost, and a
large group of near copies is not expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import WordHashes, dropped, kept, pieces_of, table, window_hashes
from tillscope.llm.components import components


@dataclass(frozen=True)
class Settings:
    """Shingle length; similarity as a fraction of whole numbers; largest column that gives all its
    pairs at once; how many n-grams may be put last in the order (8 bytes each, in every task);
    partners of a document that are verified in one go; how many entries before it an entry knows."""

    words: int = 5
    part: int = 4
    whole: int = 5
    small: int = 8
    last: int = 1_000_000
    block: int = 256
    earlier: int = 8


def shingle_set(text: bytes, memory: WordHashes, length: int) -> np.ndarray:
    """Distinct shingle hashes, ascending, of the text with A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    return np.unique(window_hashes(hashes, min(length, len(words))) ^ np.uint64(min(length, len(words))))


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def sketch(grams: np.ndarray) -> np.ndarray:
    """For each of 512 parts of the hashes whether the set has an odd number of them, as eight longs."""
    counts = np.bincount((grams & np.uint64(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH))
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def frequent_grams(docs: DataFrame, s: Settings) -> np.ndarray:
    """N-grams that at least four documents of one stretch of the input have, the most frequent
    first, `last` at most; ascending. An estimate, for the order alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        held, size, seen = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= 4
            yield pa.RecordBatch.from_arrays([pa.array(gram[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["gram", "n"])
        for _, texts in pieces_of(batches):
            for t in texts:
                grams = shingle_set(t, memory, s.words)
                key = set_id(grams)
                if key not in seen:
                    seen.add(key)
                    held.append(grams)
                    size += len(grams)
            if size > 4_000_000:
                yield from flush()
                held, size, seen = [], 0, set()
        if held:
            yield from flush()
    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "gram").limit(s.last).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def entries(docs: DataFrame, last: np.ndarray, s: Settings) -> DataFrame:
    """One row per document (gram NULL): doc_id, n, set_id and sketch; and one per entry of the product:
    gram, doc_id, n, place, often (gram is one of those put last).

    Of equal sets in one task only the first gives entries.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = WordHashes(), set()
        for rows, texts in pieces_of(batches):
            ids, sizes, keys, sketches, columns = rows.column(0).to_pylist(), [], [], [], ([], [], [], [], [])
            for doc_id, t in zip(ids, texts):
                grams = shingle_set(t, memory, s.words)
                n, key = len(grams), set_id(grams)
                sizes.append(n)
                keys.append(key)
                sketches.append(sketch(grams))
                if n and doc_id is not None and key not in seen:
                    seen.add(key)
                    k = n - -(-n * s.part // s.whole) + 1
                    often = last[np.minimum(np.searchsorted(last, grams), len(last) - 1)] == grams if len(last) else np.zeros(n, bool)
                    order = np.concatenate([np.flatnonzero(~often)[:k], np.flatnonzero(often)[:k]])[:k]
                    for c, values in zip(columns, (grams[order].view(np.int64), np.full(k, doc_id, np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), often[order])):
                        c.append(values)
            if len(seen) > 1_000_000:
                seen.clear()
            k, bits = len(ids), np.array(sketches).T
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.bool_()), pa.array(keys, pa.int64()), *map(pa.array, bits)], NAMES)
            if columns[0]:
                gram, doc, size, place, often = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(size), pa.array(place), pa.array(often), *[pa.nulls(len(gram), pa.int64())] * (1 + len(SKETCH))], NAMES)
    return docs.select("doc_id", "text").mapInArrow(run, "gram long, doc_id long, n int, place int, often boolean, set_id long" + "".join(f", {x} long" for x in SKETCH))


SKETCH = [f"bits_{i}" for i in range(8)]
NAMES = ["gram", "doc_id", "n", "place", "often", "set_id", *SKETCH]


def columns_of(cold: DataFrame) -> DataFrame:
    """Entries of the columns with several documents, with their number m.

    Columns come sorted, and only one is held at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            yield from _repeated([x[:cut] for x in now])
        if rest is not None:
            yield from _repeated(rest)
    sorted_ = cold.select("gram", "doc_id", "n", "place").repartition("gram").sortWithinPartitions("gram", "doc_id")
    return sorted_.mapInArrow(run, "gram long, doc_id long, n int, place int, m long")


def _repeated(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    gram = columns[0]
    if len(gram):
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(first), len(gram)))
        m = np.repeat(sizes, sizes)
        some = m > 1
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (*columns, m)], ["gram", "doc_id", "n", "place", "m"])


def _possible(s: Settings, shared: bool):
    """Bounds on a pair x.*, y.* of entries of one column; `shared`: with what stands alone left out."""
    before = "least(x.shared, y.shared)" if shared else "least(x.place, y.place)"
    need = f"({s.whole} + {s.part}) * ({before} + least(x.n - x.place, y.n - y.place)) >= {s.part} * (x.n + y.n)"
    sizes = f"{s.whole} * least(x.n, y.n) >= {s.part} * greatest(x.n, y.n)"
    free = f" and ({s.whole} + {s.part}) * greatest(x.free, y.free) >= {s.part} * (x.n + y.n)" if shared else ""
    return F.expr(f"{sizes} and {need}{free}")


def _first_common(s: Settings):
    """Bounds on a pair x.*, y.* of entries of one column if it is the first that both have, so that
    nothing before it is common."""
    sizes = f"{s.whole} * least(x.n, y.n) >= {s.part} * greatest(x.n, y.n)"
    reach = lambda most: f"({s.whole} + {s.part}) * {most} >= {s.part} * (x.n + y.n)"
    return F.expr(" and ".join((sizes, reach("least(x.n - x.place, y.n - y.place)"), reach("greatest(x.free - x.shared, y.free - y.shared)"))))


def with_shared(columns: DataFrame, s: Settings) -> DataFrame:
    """Entries of the large columns with `shared`, how many entries of the document before this one do not
    stand alone, `free`, how many of its n-grams may be common, and `large`, its entries here."""
    own = Window.partitionBy("doc_id")
    k = F.col("n") - F.ceil(F.col("n") * s.part / s.whole) + 1
    docs = columns.where(F.col("m") > s.small).select("doc_id").distinct()
    rows = columns.join(docs, "doc_id").withColumns({
        "shared": F.row_number().over(own.orderBy("place")) - 1,
        "free": F.col("n") - k + F.count("*").over(own),
        "large": F.count(F.when(F.col("m") > s.small, 1)).over(own)})
    return rows.where(F.col("m") > s.small)


def _products(columns: DataFrame, partners: DataFrame, condition: str, count: int, s: Settings, shared: bool) -> DataFrame:
    """Pairs a < b of a column's documents under the condition and the bounds on one column: their
    sizes, `count` as the common entries, and how many n-grams either has left behind this one."""
    joined = columns.alias("x").join(partners.alias("y"), F.expr(f"x.gram = y.gram and {condition}"))
    return joined.where(_possible(s, shared)).select(*map(F.expr, (
        "least(x.doc_id, y.doc_id) AS a", "greatest(x.doc_id, y.doc_id) AS b", "if(x.doc_id < y.doc_id, x.n, y.n) AS n_a", "if(x.doc_id < y.doc_id, y.n, x.n) AS n_b",
        f"{count} AS c", "least(x.n - x.place, y.n - y.place) - 1 AS behind")))


def _summed(products: DataFrame) -> DataFrame:
    return products.groupBy("a", "b").agg(F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"), F.sum("c").alias("c"), F.min("behind").alias("behind"))


def _reachable(s: Settings, more: str = "0"):
    """Bounds on the accumulated count c (and `more` entries that were not counted)."""
    rest = lambda n: f"(ceil({n} * {s.part} / {s.whole}) - 1)"
    return F.expr(f"({s.whole} + {s.part}) * (c + {more} + least(behind, greatest({rest('n_a')}, {rest('n_b')}))) >= {s.part} * (n_a + n_b)")


def with_earlier(many: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """Adds to each entry the `earlier` n-grams of the document's entries just before it, and its sketch.

    A doc_id with several sets has no sketch and no earlier entries, which leave out nothing.
    """
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(-s.earlier, -1)
    rows = many.withColumn("earlier", F.collect_list("gram").over(before)).join(sketches, "doc_id", "left")
    return rows.withColumn("earlier", F.when(F.col(SKETCH[0]).isNotNull(), F.col("earlier")).otherwise(F.array().cast("array<bigint>")))


def entering(many: DataFrame, s: Settings) -> DataFrame:
    """Rows x.*, y.* of the differently labelled pairs whose sketches leave a chance, by columns that
    may be the pair's first common one. many: as `with_earlier` returns it."""
    apart = " + ".join(f"bit_count(x.{bits} ^ y.{bits})" for bits in SKETCH)
    close = f"coalesce(({s.whole} + {s.part}) * ({apart}) <= ({s.whole} - {s.part}) * (x.n + y.n), true)"
    joined = many.alias("x").join(many.alias("y"), F.expr("x.gram = y.gram and x.label < y.label"))
    return joined.where(_first_common(s) & F.expr(close) & F.expr("not arrays_overlap(x.earlier, y.earlier)"))


def unconnected(many: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of differently labelled documents that may reach the similarity. many: entries of
    the columns that have several labels, the only ones such documents have in common.

    A pair enters by columns that may be its first common one, mostly by that alone; its common
    entries are then counted on the two documents' own lists, one row per pair.
    """
    pairs = entering(kept(with_earlier(many, sketches, s), "earlier"), s).select(*map(F.expr, (
        "least(x.doc_id, y.doc_id) AS a", "greatest(x.doc_id, y.doc_id) AS b", "if(x.doc_id < y.doc_id, x.n, y.n) AS n_a", "if(x.doc_id < y.doc_id, y.n, x.n) AS n_b",
        "0 AS c", "least(x.n - x.place, y.n - y.place) - 1 AS behind")))
    pairs = _summed(pairs)
    lists = many.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    for side in ("a", "b"):
        pairs = pairs.join(lists.select(F.col("doc_id").alias(side), F.col("grams").alias(f"grams_{side}")), side)
    return pairs.withColumn("c", F.size(F.array_intersect("grams_a", "grams_b"))).where(_reachable(s)).select("a", "b")


def with_large(pairs: DataFrame, many: DataFrame) -> DataFrame:
    """Adds to the count c of each pair the large columns that both documents have.

    The entries of the document with fewer of them are looked up among the other's.
    """
    a_less = F.col("large_a") <= F.col("large_b")
    ask = pairs.where("large_a is not null and large_b is not null").select(
        "a", "b", F.when(a_less, F.col("a")).otherwise(F.col("b")).alias("doc_id"), F.when(a_less, F.col("b")).otherwise(F.col("a")).alias("other"))
    common = ask.join(many.select("doc_id", "gram"), "doc_id").join(many.select(F.col("doc_id").alias("other"), "gram"), ["other", "gram"])
    common = common.groupBy("a", "b").agg(F.count("*").alias("more"))
    return pairs.join(common, ["a", "b"], "left").withColumn("c", F.col("c") + F.coalesce("more", F.lit(0)))


def verified(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their whole sets.

    Of a pair, the document with more pairs is the centre. A task gets the text of a centre once per
    block of its partners, then the partners' texts; so a text travels about once per pair, and a
    centre with very many partners is dealt over many blocks.
    """
    pairs = kept(pairs.distinct(), "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").count()
    for side in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("doc_id").alias(side), F.col("count").alias(f"of_{side}")), side)
    a_first = F.col("of_a") >= F.col("of_b")
    pairs = pairs.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("doc_id"),
                         F.ceil(F.greatest("of_a", "of_b") / s.block).alias("blocks"))
    pairs = kept(pairs.select("centre", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), "doc_id"), "partners")
    wanted = pairs.withColumn("partner", F.lit(True)).unionByName(
        pairs.select("centre", "block", F.col("centre").alias("doc_id")).distinct().withColumn("partner", F.lit(False)))
    # The number of pairs grows with the input, so the small case takes the way of the large one.
    both = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select("centre", "block", "partner", "doc_id", "text")
    both = both.repartition("centre", "block").sortWithinPartitions("centre", "block", "partner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, now, own = WordHashes(), None, {}
        for rows, texts in pieces_of(batches, "text", 1 << 20):
            found = ([], [])
            columns = (rows.column(i).to_pylist() for i in range(4))
            for centre, block, partner, doc_id, text in zip(*columns, texts):
                if (centre, block) != now:
                    now, own = (centre, block), {}
                grams = shingle_set(text, memory, s.words)
                if not partner:
                    own[set_id(grams)] = grams
                elif any(_similar(grams, other, s) for other in own.values()):
                    found[0].append(min(centre, doc_id))
                    found[1].append(max(centre, doc_id))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])
    return both.mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return s.whole * common >= s.part * (len(x) + len(y) - common)


def similar_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of each row.

    Empty and NULL texts link with nothing. Rows with one doc_id are one document in so far as
    they share links; each gives a row. Rows with a NULL doc_id take no part and get a NULL component.
    Empty table: no rows.
    """
    all_rows = kept(entries(docs, frequent_grams(docs, s), s), "entries")
    sizes = kept(all_rows.where("gram is null").select("doc_id", "n", "set_id", *SKETCH), "sizes")
    sketches, sizes = sizes.select("doc_id", "set_id", *SKETCH), sizes.select("doc_id", "n", "set_id")
    product = all_rows.where("gram is not null")
    columns = columns_of(product.where("not often"))
    often = product.where("often").select("gram", "doc_id", "n", "place")
    totals = kept(often.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "often")
    columns = kept(columns.unionByName(often.join(totals, "gram")), "columns")
    dropped(all_rows, totals)
    few, many = columns.where(F.col("m") <= s.small), kept(with_shared(columns, s), "large-columns")
    large = kept(many.groupBy("doc_id").agg(F.first("large").alias("large")), "large-entries")
    # The document with most entries in large columns is likely to be the one the others were made of.
    ranked = many.groupBy("gram").agg(F.max(F.struct("large", (-F.col("doc_id")).alias("key"), "n", "place", "shared", "free")).alias("c"))
    centres = ranked.select("gram", (-F.col("c.key")).alias("doc_id"), "c.n", "c.place", "c.shared", "c.free")
    # A star counts nothing, and its pair may share other large columns than the star's.
    stars = _products(many, centres, "x.doc_id <> y.doc_id", 0, s, True)
    first = _summed(_products(few, few, "x.doc_id < y.doc_id", 1, s, False).union(stars))
    for side in ("a", "b"):
        first = first.join(large.select(F.col("doc_id").alias(side), F.col("large").alias(f"large_{side}")), side, "left")
    first = first.where(_reachable(s, "coalesce(least(large_a, large_b), 0) * int(large_a is not null and large_b is not null)"))
    accumulated = kept(first, "first")
    dropped(columns)
    first = kept(with_large(accumulated, many).where(_reachable(s)).select("a", "b"), "candidates")
    dropped(accumulated)
    equal = sizes.where("n > 0 and doc_id is not null")
    equal = equal.join(kept(equal.groupBy("set_id").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c"), "equal"), "set_id")
    links = kept(verified(first, docs, s).union(equal.select("a", F.col("doc_id").alias("b"))), "links")
    dropped(first)
    labels = kept(components(links), "labels")
    # Columns whose documents are all connected give nothing more.
    labelled = many.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    labelled = kept(labelled, "labelled")
    dropped(many, large)
    many = labelled
    mixed = kept(many.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gram"), "mixed")
    # Documents of different components share no entry in the other large columns; those that share
    # one in a small column have been looked at.
    many = many.join(mixed, "gram")
    one_set = sketches.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("set_id").alias("least"), F.max("set_id").alias("most"), *[F.first(x).alias(x) for x in SKETCH])
    one_set = one_set.where("least = most").drop("least", "most")
    links = kept(links.union(verified(unconnected(many, one_set, s), docs, s)), "links")
    labels = components(links)
    return sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group the document with the least doc_id stays, with all its columns.

    Rows that repeat a doc_id: the one with the longest text stays.
    """
    groups = kept(similar_groups(docs).select("doc_id", "component_id"), "groups")
    away = groups.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(away, "doc_id", "left_anti").select(*docs.columns)
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = left.select("doc_id", F.struct(F.length("text").alias("size"), F.struct(*docs.columns).alias("row")).alias("x"))
        one = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("x").alias("x"))
        left = one.select("x.row.*").union(left.where("doc_id is null"))
    return left
