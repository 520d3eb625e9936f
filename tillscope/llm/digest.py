"""Document fingerprints: digests of improbable features in chained Bloom filters.

1. Over all texts the byte pairs are counted; the information of a byte, given the one before it,
   is -log2 of its share (in 1/64 bit, from a table of 65,536 numbers).
2. The rarity of a window of 16 bytes is the sum over its bytes. In each stretch of 32 neighbouring
   windows the rarest is a feature (the first, among equals). Windows that repeat an earlier one
   of the text count once.
3. Features enter a Bloom filter of 2,048 bits by five bits each; after 160 features the next filter
   of the chain begins.
4. Two digests are compared by the share of common bits over what chance gives, for each filter of
   the shorter chain with its best partner, weighted by features. 0: not alike, 1: alike.

The fingerprint is the hex text of the filters, each led by its number of features in two bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import pieces_of, sliding, table

WINDOW = 16
STRETCH = 32
BITS, PROBES, FULL = 2048, 5, 160
PAIRS = 65536


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each of the 65,536 byte pairs occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS, np.int64)
        for _, texts in pieces_of(batches):
            for t in texts:
                b = np.frombuffer(t, np.uint8).astype(np.int32)
                total += np.bincount(b[:-1] * 256 + b[1:], minlength=PAIRS) if len(b) > 4096 else 0
                if 1 < len(b) <= 4096:
                    np.add.at(total, b[:-1] * 256 + b[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["pair", "n"])
    out = np.zeros(PAIRS, np.int64)
    rows = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # 65,536 rows at most
        out[r.pair] = r.n
    return out


def information(counts: np.ndarray) -> np.ndarray:
    """Information of a byte after another, in 1/64 bit; a pair never seen counts as half a pair."""
    table_ = counts.reshape(256, 256) + 0.5
    return np.rint(-64 * np.log2(table_ / table_.sum(axis=1, keepdims=True))).astype(np.int64).ravel()


def rare_places(text: bytes, info: np.ndarray) -> np.ndarray:
    """Where the rarest window of some stretch of a text of more than 16 bytes begins."""
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(info[b[:-1] * 256 + b[1:]])])
    rarity = running[WINDOW - 1:] - running[:len(running) - WINDOW + 1]
    # Rarity first, then the earlier place: one number for both. A rarity is below 2^17 (16 bytes of less
    # than 128 bits, in 1/64 bit), so places up to 2^40 are told apart.
    ranked = rarity * (1 << 40) - np.arange(len(rarity))
    best = np.unique(sliding(ranked, min(STRETCH, len(ranked)), np.maximum))
    return np.flatnonzero(np.isin(ranked, best, assume_unique=True))


def features(text: bytes, info: np.ndarray) -> dict[bytes, int]:
    """The rarest windows of a whole text and where each is first met, in order of place; a text up to
    16 bytes is one feature."""
    if len(text) <= WINDOW:
        return {text: 0} if text else {}
    found: dict[bytes, int] = {}
    for p in rare_places(text, info).tolist():
        found.setdefault(text[p:p + WINDOW], p)
    return found


def features_after_edit(known: dict[bytes, int], text: bytes, same: int, info: np.ndarray) -> dict[bytes, int]:
    """Features of a text whose first `same` bytes are those of a text with the known features. A window
    whose stretches end before that has been judged; only what is behind is looked at."""
    settled = same - WINDOW + 1 - STRETCH + 1
    if settled <= STRETCH:
        return features(text, info)
    found = {f: p for f, p in known.items() if p < settled}
    start = settled - STRETCH + 1
    rest = text[start:]
    if len(rest) - WINDOW + 1 < STRETCH:
        return features(text, info)
    for p in (rare_places(rest, info) + start).tolist():
        if p >= settled:
            found.setdefault(text[p:p + WINDOW], p)
    return found


class Probes(dict):
    """Bits of a feature in its filter; kept from a text to its edited text."""

    def __missing__(self, feature: bytes) -> bytes:
        value = self[feature] = xxhash.xxh3_128_digest(feature)[:2 * PROBES]
        return value


def digest(found: dict[bytes, int], probes: Probes) -> list[tuple[int, np.ndarray]]:
    """Chain of (number of features, filter of 256 bytes)."""
    some, chain = list(found), []
    for i in range(0, len(some), FULL):
        bits = np.zeros(BITS, bool)
        draws = np.frombuffer(b"".join(map(probes.__getitem__, some[i:i + FULL])), ">u2")
        bits[draws % BITS] = True
        chain.append((len(some[i:i + FULL]), np.packbits(bits)))
    return chain


def as_text(chain: list[tuple[int, np.ndarray]]) -> str:
    return "".join(n.to_bytes(2, "big").hex() + f.tobytes().hex() for n, f in chain)


ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """0 to 1. Two empty digests are alike, an empty and another are not."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    total = weight = 0.0
    others = np.stack([f for _, f in b])
    size_b = ONES[others].sum(axis=1)
    for n, f in a:
        size = int(ONES[f].sum())
        common = ONES[others & f].sum(axis=1)
        least = np.minimum(size, size_b)
        chance = size * size_b / BITS
        score = np.where(least > chance, (common - chance) / np.maximum(least - chance, 1e-9), 0)
        total += n * float(np.clip(score, 0, 1).max())
        weight += n
    # The features of the longer chain that found no place count as not alike, by half.
    rest = sum(n for n, _ in b) - weight
    return min(1.0, total / (weight + max(0.0, rest) / 2))


def fingerprint(docs: DataFrame, info: np.ndarray) -> DataFrame:
    """doc_id and fingerprint of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces_of(batches):
            prints = [as_text(digest(features(t, info), Probes())) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """The documents dealt into ranges of doc_id (`range`), sorted by doc_id, and after each range a copy
    of the document that follows it (`guest`), so every document stands before its next one.

    After the last range follows the first document of all. There are as many ranges as shuffle
    partitions, so what the driver and each expression hold does not grow with the documents. NULL ids come
    before all others, rows with one id are ordered by the hash of the text.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    borders = sorted({int(c) for c in docs.approxQuantile("doc_id", shares, 0.2 / ranges)}) if shares else []
    least_id = F.array(*map(F.lit, borders)).cast("array<bigint>")
    place = F.size(F.filter(least_id, lambda b: b <= F.col("doc_id")))
    ranged = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(place)).withColumn("h", F.xxhash64("text"))
    # The least (doc_id, hash) of each range, then its row: texts don't enter the aggregate.
    first = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first")).collect()  # one row a range
    first = sorted((r.range, r.first.doc_id, r.first.h) for r in first)
    before = [r[0] for r in first]
    told = [(i, h, to) for (_, i, h), to in zip(first, before[-1:] + before[:-1])]
    told = docs.sparkSession.createDataFrame(told, "f_id long, f_h long, to int")
    guests = ranged.join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")))
    guests = guests.select("doc_id", "text", F.col("to").alias("range"), "h").dropDuplicates(["doc_id", "range"])
    both = ranged.select("range", F.lit(0).alias("guest"), "doc_id", "text", "h").unionByName(
        guests.select("range", F.lit(1).alias("guest"), "doc_id", "text", "h"))
    return both.repartition(ranges, "range").sortWithinPartitions("range", "guest", "doc_id", "h").drop("h")


def compare(docs: DataFrame, info: np.ndarray) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness; see the README."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = None, None
        for batch, texts in pieces_of(batches):
            out = []
            for place, guest, doc_id, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), texts):
                own = Own(doc_id, raw, info)
                if held and where == place:
                    out.append(held.answer(own, info))
                held, where = None if guest else own, place
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], SCHEMA)
    return neighbours(docs).mapInArrow(run, DDL)


class Own:
    """A text, its features and its digest."""

    def __init__(self, doc_id: int | None, raw: bytes, info: np.ndarray):
        self.doc_id, self.raw, self.chars, self.probes = doc_id, raw, raw.decode("utf-8"), Probes()
        self.features = features(raw, info)
        self.chain = digest(self.features, self.probes)

    def answer(self, following: Own, info: np.ndarray) -> tuple:
        """The row of the text, given the next document's."""
        cut = len(self.chars) // 4
        begin = self.chars[:len(self.chars) - cut].encode()
        edited = begin + following.chars[:cut].encode()
        new = digest(features_after_edit(self.features, edited, len(begin), info), self.probes)
        return (self.doc_id, len(self.chars), hashlib.sha256(edited).hexdigest(), as_text(self.chain), as_text(new), likeness(self.chain, new), likeness(self.chain, following.chain))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
NAMES = SCHEMA.names
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its edited text (the last quarter replaced by the start of the next
    document, in order of doc_id; after the last comes the first).

    NULL and empty texts: an empty fingerprint, likeness 1 to another empty one and 0 to the rest.
    A single document is its own next one. Empty table: no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return compare(docs, information(pair_counts(docs)))
