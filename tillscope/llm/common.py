"""What the operators share: shared-folder tables, tokens, window hashes, minimisers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.session import ensure_checkpoint_dir

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed, return. This is
#: also what bytes.split() takes as white space.
SPACE = r"[\x20\x09-\x0D]+"
PRIME = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read from there; cuts lineage, survives lost executors.

    All files of an application lie in one folder named by its id and can go when it has ended.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables (see `kept`) that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo the divisor; a NULL key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def sql_words(text: Column) -> Column:
    """Array of the words of a text; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def unit_draw(*parts: Column) -> Column:
    """Uniform in (0, 1), decided by the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


class WordHashes(dict):
    """64-bit hash of a word; remembers words, forgets all when it has grown to the limit."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def pieces_of(batches: Iterator[pa.RecordBatch], text: str = "text",
              most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `most` bytes of text each (one row at least), and the
    texts as UTF-8, NULL as empty. Keeps the memory of a task apart from the batch size."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, value in enumerate(values):
            size += len(value or b"")
            if size >= most or i == len(values) - 1:
                yield batch.slice(start, i + 1 - start), [v or b"" for v in values[start:i + 1]]
                start, size = i + 1, 0


def flat_hashes(token_lists: list[list[bytes]], memory: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in one array, and where each list starts (one more entry: the end)."""
    bounds = np.zeros(len(token_lists) + 1, np.int64)
    np.cumsum([len(t) for t in token_lists], out=bounds[1:])
    hashes = np.empty(bounds[-1], np.uint64)
    for tokens, a, b in zip(token_lists, bounds[:-1], bounds[1:]):
        hashes[a:b] = np.fromiter(map(memory.__getitem__, tokens), np.uint64, len(tokens))
    return hashes, bounds


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` tokens from each position; windows that leave the array are absent."""
    n = max(0, len(hashes) - length + 1)
    out = hashes[:n].copy()
    for j in range(1, length):
        out *= PRIME
        out += hashes[j:j + n]
    return mixed(out)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Index of the list of each token."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:len(out) - step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, bounds: np.ndarray, gram: int,
               window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose gram has the least hash in some window of `window` tokens.

    Returns (gram hashes by position, selected flags, least gram hash of the window from each
    position; 0 where the window leaves its list). Equal windows select equal grams wherever
    they stand, so two texts that share a window share its selected gram. Equal hashes are all
    selected.
    """
    n, span = len(hashes), window - gram + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
    grams = np.maximum(window_hashes(hashes, gram), np.uint64(1))
    doc = owners(bounds)
    least = sliding(grams, span, np.minimum)
    least = np.where(doc[:n - window + 1] == doc[window - 1:], least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return grams, sliding(padded, span, np.maximum) == grams, least
