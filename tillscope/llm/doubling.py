"""Substring dedup by level-wise doubling.

Windows of words that occur once can't be part of a longer repeated window. So each level looks only
at windows whose beginning and end were repeated at the level before, at most twice as long, until
the wanted length is reached or no candidates survive. The first level is thinned: of the short
windows in a window of the second level only the one with the least hash counts, which all copies
of that window share.

At the wanted length each window is told the least document that has it, and the words it covers in
any later document are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import WordHashes, flat_hashes, kept, minimisers, owners, pieces_of, table, window_hashes
from tillscope.llm.repeats import PACKED, Plan, as_set, blocked, member, packed, plan, repeated, repeated_anchors

WINDOW = 13


def levels(length: int) -> list[int]:
    """Window lengths, the wanted one last; each at most twice the one before."""
    out = [length]
    while out[0] > 12:
        out.insert(0, (out[0] + 1) // 2)
    return out


def text_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id and key of the rows whose words are those of a document with a smaller doc_id."""
    def run(batches):
        for rows, texts in pieces_of(batches):
            parts = [t.split() for t in texts]
            keys = [text_key(p) for p in parts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(p) for p in parts], pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "n", "key"])
    keys = kept(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, key binary").where("n > 0 and doc_id is not null"), "keys")
    least = kept(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "copied")
    return keys.join(least, "key").where("doc_id > least").select("doc_id", "key").distinct()


def _answers(found: DataFrame, copies: DataFrame, p: Plan) -> DataFrame:
    """Answers of the level before and the block's whole copies, in one table."""
    copied = copies.select(F.pmod(F.xxhash64("doc_id"), F.lit(p.blocks)).cast("int").alias("block"), "doc_id", "key")
    return found.select("block", "hashes", "docs", F.lit(None).cast("long").alias("copy"), F.lit(None).cast("binary").alias("key")).union(
        copied.select("block", F.lit(b""), F.lit(b""), "doc_id", "key"))


def _opened(left: pa.Table, answers: pa.Table):
    """Documents of a block with their texts, which of them are whole copies, and the answers."""
    known, least = as_set(answers)
    copies = set(zip(answers.column("copy").to_pylist(), answers.column("key").to_pylist()))
    copied = {d for d, _ in copies if d is not None}
    ids = left.column("doc_id").to_pylist()
    texts = [t or b"" for t in left.column("text").cast(pa.binary()).to_pylist()]
    # By row, as rows that share a doc_id can have different texts.
    whole = [d in copied and (d, text_key(t.split())) in copies for d, t in zip(ids, texts)]
    return ids, texts, whole, known, least


def next_level(docs: DataFrame, found: DataFrame, copies: DataFrame, p: Plan, short: int, length: int, thinned: bool, last: bool) -> DataFrame:
    """Answers for the windows of `length` words, given those for windows of `short` words."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, whole, known, _ = _opened(left, right)
        memory, out = WordHashes(), []
        chosen = [i for i, d in enumerate(ids) if d is not None and not whole[i]] if len(known) else []
        for some in _portions(chosen, texts):
            hashes, bounds = flat_hashes([texts[i].split() for i in some], memory)
            if len(hashes) < length:
                continue
            doc = owners(bounds)
            n = len(hashes) - length + 1
            if thinned:
                _, _, least = minimisers(hashes, bounds, short, length)
                live = member(least, known)
            else:
                inner = member(window_hashes(hashes, short), known)
                live = inner[:n] & inner[length - short:length - short + n]
            live &= doc[:n] == doc[length - 1:]
            at = np.flatnonzero(live)
            doc_ids = np.array([ids[i] for i in some], np.int64)[doc[at]]
            out.append((window_hashes(hashes, length)[at], doc_ids))
        block = left.column("block")[0].as_py() if left.num_rows else 0
        h = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
        d = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        if len(h):  # a document tells a window once
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            one = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[one], d[one]
        made = list(packed(h, np.full(len(h), block), p.parts, d))
        return pa.Table.from_batches(made, pa.schema(ARROW)) if made else pa.schema(ARROW).empty_table()
    rows = blocked(docs, p).groupBy("block").cogroup(_answers(found, copies, p).groupBy("block")).applyInArrow(run, PACKED)
    return kept(repeated(rows, last), "level")


ARROW = [("part", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary())]


def _portions(chosen: list[int], texts: list[bytes], most: int = 4 << 20):
    """The chosen documents in portions of about `most` bytes."""
    now, size = [], 0
    for i in chosen:
        now.append(i)
        size += len(texts[i])
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def remove_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row.

    Words covered by a window of `length` words that also starts in a document with a smaller
    doc_id are removed, judged on the input. NULL and empty texts have no words. Rows that share a
    doc_id don't remove each other's words. A NULL doc_id neither removes nor loses words. Empty
    table: no rows.
    """
    p = plan(docs)
    steps = levels(length)
    copies = kept(whole_copies(docs), "copies")
    short = steps[0]
    thinned = len(steps) > 1
    found = repeated_anchors(docs, p, short, steps[1] if thinned else short, bytes)
    for i, size in enumerate(steps[1:] if thinned else steps):
        found = next_level(docs, found, copies, p, short, size, i == 0, size == length)
        short = size

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, whole, known, least = _opened(left, right)
        memory, out = WordHashes(), []
        for doc_id, text, copy in zip(ids, texts, whole):
            words = text.split()
            gone = np.zeros(len(words), bool)
            if doc_id is not None and len(words) >= length:
                if copy:
                    gone[:] = True
                elif len(known):
                    h = window_hashes(np.fromiter(map(memory.__getitem__, words), np.uint64, len(words)), length)
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    starts = np.flatnonzero((known[at] == h) & (least[at] < doc_id))
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[starts] += 1
                    np.subtract.at(edge, starts + length, 1)
                    gone = np.cumsum(edge[:-1]) > 0
            kept_words = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
            out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept_words).hexdigest(), kept_words.decode()))
        return pa.Table.from_pylist([dict(zip(OUT.names, r)) for r in out], OUT)
    rows = blocked(docs, p).groupBy("block").cogroup(_answers(found, copies, p).groupBy("block"))
    return rows.applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
