"""Suffix-array dedup with sparse suffixes.

Suffixes are retained only where the hash of eight words is the least in some window of `length`
words. The choice depends on content alone, so two documents that share a passage of that length
retain the same suffix in it. Suffixes whose first eight words occur once can't match and are left
out; the others are sorted by their words, each is compared with the nearest rows of another document
before and after it, and each match is extended right and left. These two share the most words to the
right of all documents, but another one may share more to the left. So where some window around a
place could still match, the hashes of all windows with that eight-word start of a suffix are
compared as well. Matches reach `length` words to each side of a retained place at most; longer
passages come out whole as the union of overlapping matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import WordHashes, flat_hashes, kept, minimisers, table, window_hashes
from tillscope.llm.repeats import as_set, blocked, member, plan, repeated_anchors

LENGTH, GRAM = 50, 8
SCHEMA = pa.schema([("gram", pa.int64()), ("ahead", pa.binary()), ("back", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32()),
                    ("lo", pa.int32()), ("hi", pa.int32())])
ROW = SCHEMA.names


def lower(text: bytes) -> bytes:
    return text.lower()


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """gram, ahead (the words from the place on), back (the words before it, nearest first), doc_id,
    at, lo and hi. A word is four bytes of its hash, so that sorted bytes are sorted words. The
    windows whose least hash is that of the place begin lo to hi words before it."""
    p = plan(docs)
    docs = docs.where("doc_id is not null")
    anchors = repeated_anchors(docs, p, GRAM, length, lower)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, memory, out = as_set(right)[0], WordHashes(), []
        texts = left.column("text").cast(pa.binary()).to_pylist() if len(known) else []
        for doc_id, text in zip(left.column("doc_id").to_pylist(), texts):
            hashes, bounds = flat_hashes([lower(text or b"").split()], memory)
            grams, chosen, least = minimisers(hashes, bounds, GRAM, length)
            places = np.flatnonzero(chosen)
            places = places[member(grams[places], known)]
            if len(places):
                ahead = (hashes >> np.uint64(32)).astype(">u4")
                back = np.ascontiguousarray(ahead[::-1]).tobytes()
                ahead, n = ahead.tobytes(), len(hashes)
                for a in places.tolist():
                    begin = max(0, a - length + GRAM)
                    own = np.flatnonzero(least[begin:a + 1] == grams[a])
                    out.append((int(grams[a].view(np.int64)), ahead[4 * a:4 * (a + length)], back[4 * (n - a):4 * (n - a + length)], doc_id, a,
                                a - begin - int(own[-1]), a - begin - int(own[0])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA) if out else SCHEMA.empty_table()
    rows = blocked(docs, p).groupBy("block").cogroup(anchors.groupBy("block"))
    return rows.applyInArrow(run, "gram long, ahead binary, back binary, doc_id long, at int, lo int, hi int")


def common_words(x: bytes, y: bytes) -> int:
    """Words that two packed runs have in common from their start."""
    n = min(len(x), len(y)) // 4
    if x[:4 * n] == y[:4 * n]:
        return n
    a, b = np.frombuffer(x, "<u4", n), np.frombuffer(y, "<u4", n)
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else n


def compared(row: tuple, others: list[tuple | None], length: int) -> tuple[tuple | None, list[bool]]:
    """The match (doc_id, start, end, other document) of a row with the nearest rows of another
    document, over those that reach the length; and for its windows that could match any document,
    from the first one on, whether these rows leave that open."""
    gram, ahead, back, doc_id, at, lo, hi = row
    start, end, other, most, shown = at, at, None, 0, []
    for o in others:
        if o is not None and o[0] == gram:
            right, left = common_words(ahead, o[1]), common_words(back, o[2])
            most = max(most, right)
            if left + right >= length:
                start, end = min(start, at - left), max(end, at + right)
                other = o[3] if other is None else min(other, o[3])
                shown.append((length - right, left))
    first = max(lo, length - most)
    unseen = [not any(a <= n <= b for a, b in shown) for n in range(hi, first - 1, -1)]
    return (None if other is None else (doc_id, start, end, other)), unseen


class Found:
    """Collects what comparisons give: matches (kind 0), windows (1) and rows for later (2, 3)."""

    def __init__(self, part: int, length: int):
        self.part, self.length, self.rows, self.spans = part, length, [], []

    def compare(self, row: tuple, others: list[tuple | None]) -> None:
        match, unseen = compared(row, others, self.length)
        if match:
            doc_id, start, end, other = match
            self.rows.append((self.part, 0, None, None, None, doc_id, None, None, None, start, end, other, None))
        if unseen:
            hi, n = row[6], len(unseen)
            words = np.concatenate([np.frombuffer(row[2], ">u4", hi)[::-1], np.frombuffer(row[1], ">u4", self.length + n - 1 - hi)])
            for flag, some in groupby(range(n), unseen.__getitem__):
                some = list(some)
                self.spans.append((len(self.rows), words[some[0]:some[-1] + self.length]))
                self.rows.append((self.part, 1, row[0], None, None, row[3], row[4] - hi + some[0], None, None, None, None, None, flag))

    def later(self, kind: int, row: tuple, number: int) -> None:
        self.rows.append((self.part, kind, *row, number, None, None, None))

    def batch(self) -> pa.RecordBatch:
        rows, spans = self.rows, self.spans
        self.rows, self.spans = [], []
        hashes: list = [None] * len(rows)
        if spans:
            flat = window_hashes(np.concatenate([w for _, w in spans]).astype(np.uint64), self.length).view(np.int64)
            begin = 0
            for i, words in spans:
                hashes[i] = flat[begin:begin + len(words) - self.length + 1]
                begin += len(words)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, ARROW[-1].type)], schema=ARROW)


def key(row: tuple | None) -> tuple | None:
    """Rows in a row with one gram and document are one run."""
    return row and (row[0], row[3])


def neighbours(rows: DataFrame, length: int) -> DataFrame:
    """Compares each suffix with the nearest rows of another document in the sorted order.

    Rows are range-partitioned by the order and by document, so a passage of very many documents
    is spread over tasks. The first and last run of each task are left for `borders` (kind 2), with
    four rows that tell other tasks what stands here (kind 3): the first row, the first one after
    its run, the last one before the last run, and the last row.
    """
    order = ["gram", "ahead", "back", "doc_id", "at"]
    size = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = rows.repartitionByRange(int(size), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = Found(TaskContext.get().partitionId(), length)
        now, before, runs = [], None, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(ROW)))):
                if now and key(row) != key(now[-1]):
                    if runs == 0:
                        found.later(3, now[0], 0)
                        found.later(3, row, 1)
                    for r in now:
                        if runs == 0:
                            found.later(2, r, 0)
                        else:
                            found.compare(r, [before, row])
                    now, before, runs = [], now[-1], runs + 1
                now.append(row)
            if found.rows:
                yield found.batch()
        if now:
            if runs == 0:
                found.later(3, now[0], 0)
            else:
                found.later(3, before, 2)
            found.later(3, now[-1], 3)
            for r in now:
                found.later(2, r, min(runs, 1))
            yield found.batch()
    return kept(ranged.select(*ROW).mapInArrow(run, FOUND), "neighbours")


ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *SCHEMA, ("start", pa.int32()), ("end", pa.int32()), ("other", pa.int64()),
                   ("unseen", pa.bool_()), ("windows", pa.list_(pa.int64()))])
FOUND = ("part int, kind int, gram long, ahead binary, back binary, doc_id long, at int, lo int, hi int, start int, end int, other long, "
         "unseen boolean, windows array<long>")


def beyond(edges: dict[int, dict[int, tuple]], forward: bool) -> dict[int, tuple | None]:
    """By task, the nearest row before its first run, or (not forward) after its last run, of another
    run; runs may go through many tasks."""
    near, far, out = None, None, {}
    mine, inner, last = (0, 2, 3) if forward else (3, 1, 0)
    for part in sorted(edges, reverse=not forward):
        e = edges[part]
        out[part] = near if key(near) != key(e[mine]) else far
        far = e[inner] if inner in e else out[part]
        near = e[last]
    return out


def borders(found: DataFrame, length: int) -> DataFrame:
    """The first and last runs of the tasks, compared with what stands before and after them."""
    edges: dict[int, dict[int, tuple]] = {}
    for r in found.where("kind = 3").select("part", "start", *ROW).collect():  # four rows a task
        edges.setdefault(r.part, {})[r.start] = (r.gram, bytes(r.ahead), bytes(r.back), *r[5:])
    prior, following = beyond(edges, True), beyond(edges, False)
    # By task and end of it: the rows before and after the run.
    sides = {(p, 0): [prior[p], e.get(1, following[p])] for p, e in edges.items()}
    sides |= {(p, 1): [e.get(2), following[p]] for p, e in edges.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Found(0, length)
        for batch in batches:
            for part, end, *row in zip(*(batch.column(i).to_pylist() for i in range(2 + len(ROW)))):
                out.compare(tuple(row), sides[part, end])
            if out.rows:
                yield out.batch()
    return kept(found.where("kind = 2").select("part", "start", *ROW).mapInArrow(run, FOUND), "borders")


def matches(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, end, other): places that match another document over `length` words or more."""
    found = neighbours(rows, length)
    found = found.where("kind < 2").unionByName(borders(found, length))
    # A window that is open for one row may be seen by others, so all rows with its gram tell theirs.
    told = found.where("kind = 1")
    told = told.join(told.where("unseen").select("gram").distinct(), "gram", "left_semi")
    told = kept(told.select("doc_id", "at", "unseen", F.posexplode("windows").alias("i", "window")).select(
        "doc_id", (F.col("at") + F.col("i")).alias("start"), "window", "unseen"), "windows")
    shared = told.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("unseen").alias("open"))
    exact = told.where("unseen").join(shared.where("least < most and open"), "window").select(
        "doc_id", "start", (F.col("start") + length).alias("end"),
        F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("other"))
    return found.where("kind = 0").select("doc_id", "start", "end", "other").union(exact)


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per passage of `length` words or more that another document has too: doc_id,
    start_word, end_word (exclusive), n_words, other_doc_id (the least that was met), text-wise over
    words with A-Z in lower case. Passages that overlap or touch are one.

    NULL and shorter texts have none; rows with one doc_id, or none, don't match each other. Empty
    table: no rows.
    """
    found = matches(kept(suffixes(docs, length), "suffixes"), length)
    per_doc = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "other"))).alias("spans"))
    grown = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int,other:bigint>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
            F.least(F.element_at(done, -1)["other"], s["other"]).alias("other"))))).otherwise(F.concat(done, F.array(s))))
    return per_doc.select("doc_id", F.explode(F.when(F.size("spans") > 0, grown)).alias("s")).select(
        "doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"),
        (F.col("s.end") - F.col("s.start")).alias("n_words"), F.col("s.other").alias("other_doc_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
