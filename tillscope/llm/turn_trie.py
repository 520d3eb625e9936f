"""Prefix trie of conversations, from ternary search trees over range shards.

Turns become numbers of a dictionary, conversations become sequences of them. The sequences are dealt by
range, so all conversations below a node lie in neighbouring shards. Each shard puts its sequences into a
ternary search tree, medians first, which keeps it balanced, and adds up members, leaves and savings from
the last node to the first. Only nodes on the way to the first or the last sequence of a shard can go on in
another shard; these boundary nodes, at most two paths a shard, are merged afterwards.

A sequence has at most `WIDTH` turns. What is longer goes on in a further round, below the node that it
has reached, if another conversation has reached it too; else its remaining nodes are a chain of one
member, one row each, and need no tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillscope.llm.common import kept, table

WIDTH, SHARD_ROWS, SLICE = 256, 20_000, 4096
FAMILY, HEADS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids of one piece of a boundary node's list.
PIECE = 400
TREE = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("side", pa.int32()), ("parent_side", pa.int32()), ("depth", pa.int64()),
    ("path", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends", pa.string())])
TREE_DDL = ("kind int, shard int, side int, parent_side int, depth long, path array<long>, conv_id long, parent_conv_id long, "
            "n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, in the order of turn, NULL first; ties by the digest), digest of role and
    text, size of the text in bytes. Long conversations are ordered in slices of their turn numbers."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.floor(F.col("turn") / SLICE).alias("slice"), F.octet_length(text).cast("long").alias("size"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"))
    slices = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("conv_id", F.col("slice").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(F.asc_nulls_first("turn"), "digest"))
    rows = rows.withColumn("inside", inside).alias("r").join(slices.alias("s"), (F.col("r.conv_id") == F.col("s.conv_id")) & F.col("slice").eqNullSafe(F.col("of")))
    return rows.select("r.conv_id", (F.col("before") + F.col("inside")).alias("pos"), "digest", "size")


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, pos, code (number of the turn in the dictionary of distinct turns), size."""
    turns = kept(numbered(turns), "turns")
    dictionary = kept(turns.groupBy("digest").agg(F.count("*").alias("n")).select("digest", F.monotonically_increasing_id().alias("code")), "dictionary")
    return kept(turns.join(dictionary, "digest").select("conv_id", "pos", "code", "size"), "encoded")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, code, size) of the rebuilt conversations, and (conv_id, total) of all.

    Conversation c gets the first h turns of c - c % 5 and its own turns after its first h; h is the
    crc32 of its number, modulo 9.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    ask = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    first = ask.join(heads, "base").where("pos <= h").select("conv_id", "pos", "code", "size")
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    ask = ask.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    rest = turns.join(ask.select("conv_id", "h", "m"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "code", "size")
    return first.unionByName(rest), ask.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))


def segments(turns: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """conv_id, seg (from 0; each conversation has that one), codes, sizes, more: whether it goes on."""
    at = F.floor((F.col("pos") - 1) / width)
    cut = turns.groupBy("conv_id", at.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "code", "size"))).alias("t"))
    cut = cut.select("conv_id", "seg", F.col("t.code").alias("codes"), F.col("t.size").alias("sizes"))
    none = totals.where("total = 0").select("conv_id", F.lit(0).cast("long").alias("seg"), F.array().cast("array<long>").alias("codes"), F.array().cast("array<long>").alias("sizes"))
    return cut.unionByName(none).join(totals, "conv_id").withColumn("more", F.col("total") > (F.col("seg") + 1) * width)


class Tree:
    """A ternary search tree of sequences, which is at once their trie: `equal` leads to the children of
    a node, `lower` and `higher` to its siblings. Nodes are numbered as they are made, parents first."""

    def __init__(self) -> None:
        self.code, self.lower, self.higher, self.equal = [-1], [0], [0], [0]
        self.parent, self.depth, self.size = [-1], [-1], [0]
        self.n, self.least = [0], [0]

    def walk(self, codes: list[int], sizes: list[int], n: int, least: int) -> list[int]:
        """The nodes of a sequence that n members have, made where they are missing."""
        at, way = 0, []
        code, lower, higher, equal = self.code, self.lower, self.higher, self.equal
        for depth, c in enumerate(codes):
            links, i = equal, at
            now = equal[at]
            while now and code[now] != c:
                links, i = (lower, now) if c < code[now] else (higher, now)
                now = links[now]
            if not now:
                now = links[i] = len(code)
                code.append(c)
                lower.append(0)
                higher.append(0)
                equal.append(0)
                self.parent.append(at)
                self.depth.append(depth)
                self.size.append(sizes[depth])
                self.n.append(0)
                self.least.append(least)
            self.n[now] += n
            self.least[now] = min(self.least[now], least)
            way.append(now)
            at = now
        return way


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the median of each range before its halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += [(a, mid), (mid + 1, b)]


def shard_nodes(shard: int, rows: list[tuple], base: int) -> list[tuple]:
    """Rows of TREE from the sorted rows (prefix, codes, sizes, conv_id, more, children, leaves, saved) of
    a shard. kind 0: a node that is whole here; 1: what the shard has of a boundary node; 2: a piece
    of its list of ended members. The first symbol of a sequence is its prefix, at depth `base`."""
    groups: list[tuple] = []
    for prefix, codes, sizes, conv_id, more, *hang in rows:
        key = [prefix, *codes]
        if not groups or groups[-1][0] != key:
            groups.append((key, [0, *sizes], [], [], [0, 0, 0]))
        groups[-1][2].append(conv_id)
        if not more:
            groups[-1][3].append(conv_id)
        for i, v in enumerate(hang):
            groups[-1][4][i] += v or 0
    tree, ends, below, ways = Tree(), {}, {}, {}
    for i in medians(len(groups)):
        key, sizes, members, ended, hang = groups[i]
        way = tree.walk(key, sizes, len(members), members[0])
        if ended:
            ends[way[-1]] = ended
        below[way[-1]] = hang
        if i in (0, len(groups) - 1):
            ways[i] = way
    side = {node: 1 for node in ways[len(groups) - 1]} | {node: 0 for node in ways[0]}
    size = len(tree.code)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    out = []
    for node in range(size - 1, 0, -1):  # children before parents
        more = below.get(node, (0, 0, 0))
        children[node] += more[0]
        leaves[node] += more[1]
        saved[node] += more[2]
        depth, parent = tree.depth[node] + base, tree.parent[node]
        conv_id = tree.least[node] if depth > base or not base else tree.code[node]
        listed = ends.get(node, [])
        if node in side:
            path = []
            at = node
            while at:
                path.append(tree.code[at])
                at = tree.parent[at]
            path.reverse()
            out.append((1, shard, side[node], None, depth, path, conv_id, None, tree.n[node], children[node], leaves[node], saved[node], tree.size[node], None))
            for a in range(0, len(listed), PIECE):
                ids = listed[a:a + PIECE]
                out.append((2, shard, None, None, depth, path, ids[0], None, None, None, None, None, None, ",".join(map(str, ids))))
            continue
        leaves[node] += not children[node]
        saved[node] += (tree.n[node] - 1) * tree.size[node]
        if parent:
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        known = parent and parent not in side
        above = (tree.least[parent] if tree.depth[parent] or not base else tree.code[parent]) if known else None
        out.append((0, shard, None, side.get(parent), depth, None, conv_id, above, tree.n[node], children[node], leaves[node], saved[node], None, sha(listed)))
    return out


def trees(level: DataFrame, base: int, shard_rows: int) -> DataFrame:
    """Rows of TREE for a round. Equal sequences are dealt by conv_id, so copies spread over shards."""
    order = ["prefix", "codes", "conv_id"]
    shards = max(int(level.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-level.count() // shard_rows))
    rows = level.select("prefix", "codes", "sizes", "conv_id", "more", "children", "leaves", "saved")
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        out = shard_nodes(TaskContext.get().partitionId(), got, base) if got else []
        for a in range(0, len(out), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a:a + 5000]), TREE)], schema=TREE)
    return kept(rows.mapInArrow(run, TREE_DDL), "trees")


def hashed_lists(pieces: DataFrame) -> DataFrame:
    """path and sha256 of the joined pieces of each path, in order; a task reads them one after another."""
    rows = pieces.select("path", "conv_id", "ends").repartition("path").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            for p, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if p == path:
                    state.update(b"," + text.encode())
                    continue
                if path is not None:
                    yield pa.RecordBatch.from_pydict({"path": [path], "ends_sha256": [state.hexdigest()]})
                path, state = p, hashlib.sha256(text.encode())
        if path is not None:
            yield pa.RecordBatch.from_pydict({"path": [path], "ends_sha256": [state.hexdigest()]})
    return rows.mapInArrow(run, "path array<long>, ends_sha256 string")


def merged(found: DataFrame) -> DataFrame:
    """Whole nodes (COLUMNS and `path`, NULL but for boundary nodes) from the rows of all shards."""
    parts = found.where("kind = 1")
    whole = kept(parts.groupBy("path").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.first("size").alias("size")), "boundary")
    above = F.slice("path", 1, F.size("path") - 1)
    kids = whole.where(F.size("path") > 1).groupBy(above.alias("path")).agg(F.count("*").alias("kids"))
    whole = whole.join(kids, "path", "left").withColumn("n_children", F.col("inner") + F.coalesce("kids", F.lit(0)))
    own = whole.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("path"),
                       (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
                       (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    sums = own.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    names = whole.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = whole.select("path", "depth", "conv_id", "n_convs", "n_children", above.alias("above")).join(sums, "path").join(names, "above", "left")
    whole = whole.join(hashed_lists(found.where("kind = 2")), "path", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    # Children of boundary nodes that are whole in a shard learn the number of their parent.
    ids = kept(parts.select("path", "shard", "side", "depth").join(names.withColumnRenamed("above", "path"), "path").select(
        "shard", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("parent_conv_id").alias("told")), "parents")
    inner = found.where("kind = 0").join(ids, ["shard", "parent_side", "depth"], "left").withColumn("parent_conv_id", F.coalesce("told", "parent_conv_id"))
    inner = inner.withColumnRenamed("ends", "ends_sha256").select(*COLUMNS, "path")
    return inner.unionByName(whole.select(*COLUMNS, "path"))


def trie(turns: DataFrame, totals: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the trie of the sequences (conv_id, pos, code, size); totals: the length of each."""
    cut = kept(segments(turns, totals, width), "segments")
    level = cut.where("seg = 0").withColumn("prefix", F.lit(0).cast("long"))
    levels, chains = [], None
    while True:  # forward: who goes on below which node
        full = level.where(F.size("codes") == width)
        ends = full.groupBy("prefix", "codes").agg(F.count("*").alias("n"), F.min("conv_id").alias("node"), F.max("more").alias("on")).where("on")
        on = kept(full.where("more").join(ends, ["prefix", "codes"]).select("conv_id", "n", "node"), "further")
        levels.append((level, on))
        if on.isEmpty():
            break
        depth = len(levels) * width
        alone = cut.where(F.col("seg") >= len(levels)).join(on.where("n = 1").select("conv_id"), "conv_id")
        chain = alone.select("conv_id", "total", F.posexplode("codes").alias("i", "code"), (F.col("seg") * width + 1).alias("from")).select(
            "conv_id", (F.col("from") + F.col("i")).alias("depth"), "total")
        ended = F.when(F.col("depth") == F.col("total"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING))
        chain = chain.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                             (F.col("depth") < F.col("total")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                             F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256"))
        chains = chain if chains is None else chains.unionByName(chain)
        level = kept(cut.where(F.col("seg") == len(levels)).join(on.where("n > 1").select("conv_id", F.col("node").alias("prefix")), "conv_id"), f"level-{depth}")
        if level.isEmpty():
            break
    out, tops = chains, None
    for i in range(len(levels) - 1, -1, -1):  # backward: sums go up
        level, on = levels[i]
        hang = on.where("n = 1").select("conv_id", F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if tops is not None:
            hang = hang.unionByName(tops)
        level = level.join(hang, "conv_id", "left").na.fill(0, ["children", "leaves", "saved"])
        nodes = merged(trees(kept(level, "hung"), i * width, shard_rows))
        if i:
            nodes = kept(nodes, "nodes")
            tops = nodes.where(F.col("depth") == i * width).select("conv_id", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            nodes = nodes.where(F.col("depth") > i * width)
        nodes = nodes.select(*COLUMNS)
        out = nodes if out is None else out.unionByName(nodes)
    return out


def conversation_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    NULL roles and texts are empty; a NULL turn comes first; turns with one number are ordered by a
    digest of role and text; repeated rows are turns of their own; rows without conv_id belong to no
    conversation and are left out. A very long text counts by its digest and its size. An empty table has
    no root and gives no rows. Other columns are not read.
    """
    turns, totals = rebuilt(encoded(conversations))
    return trie(turns, totals, width, shard_rows)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `conversations`. Cases: see `conversation_trie`."""
    return conversation_trie(table(spark, sf_dir, "conversations"))
