"""Toxicity by a factorization machine over hashed terms.

raw(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, x_i = 1 for each term bucket of the
text, so a pair such as an insult and a group can weigh more, or less, than its parts. Terms are
lower-cased words and their beginnings of four to six letters (inflected and compound forms share
them). Only buckets whose labelled frequencies differ enter the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tillscope.llm.common import pieces_of, remainder, table

WORD = regex.compile(r"\p{L}+")
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows that the machine is fitted on, whatever the input."""

    sample: int = 12_000
    bits: int = 20
    terms: int = 4096
    factors: int = 4
    epochs: int = 12
    rate: float = 0.2
    decay: float = 1e-5
    seed: int = 7


class TermIds(dict):
    """Bucket ids of a word's terms; forgets all at the limit."""

    limit = 300_000

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        starts = [f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n]
        ids = self[word] = tuple(xxhash.xxh3_64_intdigest(t) & self.mask for t in [f"w:{word}", *starts])
        return ids


def term_ids(text: bytes, memory: TermIds) -> np.ndarray:
    """Distinct buckets of a whole text, ascending."""
    found: set[int] = set()
    for word in set(WORD.findall(text.decode("utf-8", "replace").lower())):
        found.update(memory[word])
    return np.array(sorted(found), np.int32)


def term_table(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, label and the term buckets of each text, as packed 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TermIds(bits)
        for rows, texts in pieces_of(batches):
            ids = [term_ids(t, memory).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ids, pa.binary())], ["doc_id", "toxic", "ids"])
    return docs.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, ids binary")


@dataclass
class Machine:
    """Slot of each bucket (-1: not used), bias, linear weights, factors."""

    slots: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def slots_of(self, ids: np.ndarray) -> np.ndarray:
        found = self.slots[ids]
        return found[found >= 0]

    def raw(self, slots: np.ndarray) -> float:
        v = self.factors[slots]
        s = v.sum(axis=0)
        return float(self.bias + self.linear[slots].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(self.slots_of(ids)), -40, 40))))


def fit(rows: list[tuple[np.ndarray, int]], s: Settings) -> Machine:
    """Trains on (bucket ids, label) rows by stochastic gradients with decaying steps.

    Without rows every score is one fifth, under the threshold.
    """
    buckets = 1 << s.bits
    count = [np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)]
    size = [0, 0]
    for ids, y in rows:
        count[y][ids] += 1
        size[y] += 1
    rate = [(c + 0.5) / (n + 1) for c, n in zip(count, size)]
    spread = np.sqrt(1 / (count[0] + 0.5) + 1 / (count[1] + 0.5))
    gain = np.abs(np.log(rate[1] / rate[0])) / spread
    gain[(count[0] + count[1]) < 4] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[: s.terms])
    chosen = chosen[gain[chosen] > 2]
    slots = np.full(buckets, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(s.seed)
    prior = (size[1] + 1) / (sum(size) + 5)
    m = Machine(slots, float(np.log(prior / (1 - prior))), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), s.factors)))
    data = [(m.slots_of(ids), y) for ids, y in rows]
    for epoch in range(s.epochs):
        step = s.rate / (1 + epoch)
        for i in rng.permutation(len(data)):
            x, y = data[i]
            v = m.factors[x]
            total = v.sum(axis=0)
            raw = m.bias + m.linear[x].sum() + 0.5 * (total @ total - (v * v).sum())
            slope = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y
            m.bias -= 0.1 * step * slope
            if len(x):
                scale = step / max(1.0, np.sqrt(len(x)))
                m.linear[x] -= scale * (slope + s.decay * m.linear[x])
                m.factors[x] -= scale * (np.clip(slope * (total - v), -1, 1) + s.decay * v)
    return m


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Machine:
    """Machine of the labelled documents outside the held-out fold.

    The sample takes the `sample` least hashes of doc_id, so it doesn't depend on partitioning.
    Rows without a label or a document are left out; repeated rows count as often as they occur.
    """
    chosen = (labels.where("toxic in (0, 1)").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
              .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id", "toxic").limit(s.sample))
    # At most `sample` rows of two numbers are broadcast.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = term_table(labelled, s.bits).orderBy("doc_id", "toxic").limit(2 * s.sample).collect()
    return fit([(np.frombuffer(r.ids, np.int32), r.toxic) for r in rows], s)


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns `keep` and score, 0 to 1. NULL and empty texts score as texts without terms."""
    bits = len(machine.slots).bit_length() - 1
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = TermIds(bits)
        for rows, texts in pieces_of(batches, "_text"):
            found = pa.array([machine.score(term_ids(t, memory)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], found], names=[*keep, "score"])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document. Empty tables: no rows, or an untrained machine
    (every score the same, under the threshold)."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine, ["doc_id"]).select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drops the documents that score at the threshold or above."""
    machine = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return score(rows, machine, ["_doc"]).where(F.col("score") < THRESHOLD).select("_doc.*")
