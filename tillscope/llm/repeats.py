"""Which window hashes occur more than once, told to the blocks of documents that have them.

Documents are dealt into blocks by hash. Tasks pack their window hashes by (part of the hash range,
block), so a row carries many hashes and a window that countless documents share is sent once or
twice per block and task. A part's hashes meet in one task, whose size is set by `parts`; it answers
each block with those of its hashes that are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import WordHashes, flat_hashes, kept, minimisers, owners, pieces_of

#: Names and types of packed rows: blob of hashes, blob of document ids (empty: not needed).
PACKED = "part int, block int, hashes binary, docs binary"


@dataclass(frozen=True)
class Plan:
    """Number of blocks and parts (a power of two)."""

    blocks: int
    parts: int


def plan(docs: DataFrame, per_block: int = 1000, per_part: int = 8 << 20) -> Plan:
    """Blocks of about `per_block` documents, parts of about `per_part` bytes of text."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = 64
    while parts * per_part < (size or 0):
        parts *= 2
    return Plan(max(8, n // per_block), parts)


def blocked(docs: DataFrame, p: Plan) -> DataFrame:
    """block, doc_id and text."""
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(p.blocks)).cast("int").alias("block"), "doc_id", "text")


def packed(hashes: np.ndarray, block: np.ndarray, parts: int, docs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED. Of equal (hash, block) two entries are kept, those with the least documents."""
    if not len(hashes):
        return
    order = np.lexsort((hashes, block)) if docs is None else np.lexsort((docs, hashes, block))
    h, b = hashes[order], block[order].astype(np.int32)
    third = np.zeros(len(h), bool)
    third[2:] = (h[2:] == h[:-2]) & (b[2:] == b[:-2])
    h, b, order = h[~third], b[~third], order[~third]
    part = (h >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int32)
    # Sorted by block and hash, hence by block and part.
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (b[1:] != b[:-1])]))
    offsets = (np.append(first, len(h)) * 8).astype(np.int32)
    none = pa.array([b""] * len(first), pa.binary())
    blob = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])
    yield pa.RecordBatch.from_arrays(
        [pa.array(part[first]), pa.array(b[first]), blob(h), none if docs is None else blob(docs[order].astype(np.int64))],
        ["part", "block", "hashes", "docs"])


def blobs(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of blobs, and how many each row has."""
    values = table.column(name).combine_chunks().to_pylist() if table.num_rows else []
    return np.frombuffer(b"".join(values), kind), np.array([len(v) // 8 for v in values], np.int64)


def repeated(rows: DataFrame, with_least: bool) -> DataFrame:
    """Answers to the blocks: block, hashes and, if wanted, docs: the least document with each hash
    (then only hashes that some other document of the block has)."""
    def run(table: pa.Table) -> pa.Table:
        h, n = blobs(table, "hashes", np.uint64)
        block = np.repeat(table.column("block").to_numpy(), n)
        doc = blobs(table, "docs", np.int64)[0] if with_least else np.zeros(len(h), np.int64)
        order = np.lexsort((doc, h))
        h, block, doc = h[order], block[order], doc[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
        group = np.cumsum(first) - 1
        least = doc[first][group]
        told = doc > least if with_least else (np.bincount(group) > 1)[group]
        h, block, least = h[told], block[told], least[told]
        order = np.lexsort((h, block))
        h, block, least = h[order], block[order], least[order]
        one = np.concatenate([[True], (h[1:] != h[:-1]) | (block[1:] != block[:-1])])[:len(h)]
        h, block, least = h[one], block[one], least[one]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[:len(h)])
        ends = np.append(starts[1:], len(h))
        return pa.table({
            "block": pa.array(block[starts].astype(np.int32)),
            "hashes": pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "docs": pa.array([least[a:b].tobytes() for a, b in zip(starts, ends)] if with_least else [b""] * len(starts), pa.binary()),
        })
    found = rows.groupBy("part").applyInArrow(run, "block int, hashes binary, docs binary")
    return found.select("block", "hashes", "docs")


def repeated_anchors(docs: DataFrame, p: Plan, gram: int, window: int, fold: Callable[[bytes], bytes]) -> DataFrame:
    """Repeated ones of the gram hashes that are least in some window, by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held, size = WordHashes(), ([], []), 0
        for rows, texts in pieces_of(batches):
            hashes, bounds = flat_hashes([fold(t).split() for t in texts], memory)
            grams, chosen, _ = minimisers(hashes, bounds, gram, window)
            at = np.flatnonzero(chosen)
            doc = owners(bounds)[at]
            # Each document tells a hash once.
            key = np.unique(np.stack([doc.astype(np.uint64), grams[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
            block = rows.column(0).to_numpy()[key[:, 0].astype(np.int64)]
            held[0].append(key[:, 1])
            held[1].append(block)
            size += len(block)
            if size > 1_500_000:
                yield from packed(np.concatenate(held[0]), np.concatenate(held[1]), p.parts)
                held, size = ([], []), 0
        if size:
            yield from packed(np.concatenate(held[0]), np.concatenate(held[1]), p.parts)
    rows = blocked(docs, p).mapInArrow(run, PACKED)
    return kept(repeated(rows, False), "anchors")


def as_set(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's answers, ascending, and their least documents (if told)."""
    h, d = blobs(table, "hashes", np.uint64)[0], blobs(table, "docs", np.int64)[0]
    order = np.argsort(h, kind="stable")
    return h[order], d[order] if len(d) else d


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values
