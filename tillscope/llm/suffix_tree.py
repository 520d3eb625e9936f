"""Language model: probabilistic suffix trees over words and, inside rare words, over bytes.

A text is its words (A-Z in lower case) and one text end. A suffix tree holds contexts, the symbols
before a place. A candidate context is retained if the counts of its next symbols diverge from the
distribution of its suffix by `divergence` nats (count times Kullback-Leibler distance). Next-symbol
distributions are smoothed along the suffixes (Witten-Bell), and a place is scored by the state of
its longest retained suffix.

Word tree: symbols are the text end, the words with a share of 2^-13 or more, and, for all other
words, the classes of their first two bytes with such a share (one further class for the rest).
Short contexts are single symbols with a share of 2^-10 or more and pairs whose shares multiply to
2^-12; they are bounded, and every task has them. Long contexts are as many as the corpus gives: all
runs of `gram` to `window` symbols that `least` places of the training texts have. A long context is
retained by `long_divergence` from its longest retained short suffix, and smoothed with it; a place has
the longest retained one of all its suffixes. Places are compared in two rounds: all of them by contexts
of up to `reach` symbols, those that share one of `reach` by the longer ones. They are dealt by the least
pair of the symbols before them that each context of the round has (pairs with few frequent symbols are
less than others), so all places with a context meet. Neighbours with one such pair go together, with the
symbols before them that the round needs, each such stretch once per piece of input with the places that
have it; what they gain is added up per text.

A word of a class is drawn by its count, smoothed with the byte tree, which spells the rest of
the word and its end in contexts of up to `depth` bytes with a share of `least_share` or more.

For spelling, the byte tree becomes an automaton: the retained contexts and their prefixes are
states, and the state after a symbol is the longest suffix that is a state. A batch of words is cut
into lanes that run in step; a lane starts `depth` bytes early, which is all a state can depend on.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import PRIME, dropped, kept, mixed, owners, pieces_of, remainder, sliding, table, window_hashes

END = b"\n"  # the text end as a token; no word has white space
FOLDS, HELD_OUT = 7, 2
LANES = 4096
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
#: Places of a stretch.
MOST_PLACES = 64
#: Pairs of context and symbol that a task counts in one array; more are sorted.
TALLY = 1 << 22


@dataclass(frozen=True)
class Settings:
    depth: int = 5
    least_share: float = 1e-4
    divergence: float = 50.0
    #: Bounds of the symbols, of the single and of the paired contexts, of the words counted one by one.
    symbols: int = 1 << 13
    contexts: int = 1 << 10
    pairs: int = 1 << 12
    head: int = 1 << 20
    #: Long contexts: symbols of the shortest one, places it needs, nats it needs, symbols of the
    #: longest one, of the longest one that all places are compared by, bytes of text per part.
    gram: int = 3
    least: int = 2
    long_divergence: float = 6.0
    window: int = 18
    reach: int = 6
    per_part: int = 4 << 20


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their counts."""
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_codes)
    all_codes, all_counts = all_codes[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_codes[1:] != all_codes[:-1]])[: len(all_codes)])
    return all_codes[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def counted(kind: int, code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(code), 200_000):
        part = code[i:i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)),
                                          pa.array(n[i:i + 200_000])], ["kind", "code", "n"])


def first_two(word: bytes) -> int:
    """The first two bytes of a word and its end."""
    return int.from_bytes((word + b"  ")[:2], "big")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Like `kept`; the shuffle files of the job go when it has ended."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return kept(df, tag)
    finally:
        spark.conf.set(setting, before)


def word_counts(docs: DataFrame) -> DataFrame:
    """(kind, word, n): how often each token occurs, by its hash (kind 0), and each pair of first
    bytes (kind 1). Tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            yield from counted(0, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),
                               np.fromiter(words.values(), np.int64, len(words)))
            code, n = add_up([np.fromiter(map(first_two, words), np.uint64, len(words))], [np.fromiter(words.values(), np.int64, len(words))])
            yield from counted(1, code, n)
            words.clear()
        for _, texts in pieces_of(batches):
            words.update(itertools.chain.from_iterable(map(tokens, texts)))
            if len(words) > 400_000:
                yield from flush()
        yield from flush()
    found = docs.select("text").mapInArrow(run, "kind int, code long, n long")
    return stored(found.groupBy("kind", F.col("code").alias("word")).agg(F.sum("n").alias("n")), "words")


class Words:
    """What tasks know of words: symbol numbers, counts of the head, candidate contexts."""

    def __init__(self, counted_words: DataFrame, s: Settings):
        words = counted_words.where("kind = 0")
        r = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0))).first()
        self.total, self.kinds, self.once = (int(x or 0) for x in r)
        #: Words that occur less often are spelled.
        self.least = max(2, -(-self.total // s.head))
        top = words.where(F.col("n") >= self.least).orderBy(F.desc("n"), "word").toPandas()
        hashes, counts = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
        self.counts: dict[int, int] = dict(zip(hashes.tolist(), counts.tolist()))
        chosen = hashes[counts * s.symbols >= max(1, self.total)].tolist()
        end = xxhash.xxh3_64_intdigest(END)
        chosen = [end, *[h for h in chosen if h != end]]  # symbol 0: text end, also before the first word
        self.symbol = {h: i for i, h in enumerate(chosen)}
        #: Symbols from here on are classes of words.
        self.other = len(chosen)
        starts = counted_words.where(F.col("kind") == 1).where(F.col("n") * s.symbols >= max(1, self.total)).orderBy("word").toPandas()
        self.classes = {int(w): self.other + 1 + i for i, w in enumerate(starts["word"])}
        self.plain = np.array([self.counts.get(h, 0) for h in chosen], np.int64)
        shares = np.concatenate([self.plain, [0], starts["n"].to_numpy(np.int64)]) / max(1, self.total)
        #: Number of each symbol as a context, from 1; 0: no candidate.
        self.single = np.zeros(len(shares), np.int64)
        frequent = np.flatnonzero(shares * s.contexts >= 1)
        self.single[frequent] = np.arange(1, len(frequent) + 1)
        a = np.concatenate([[0], shares[frequent]])
        #: Number of a pair of contexts (earlier, later), after the single ones; 0: no candidate.
        wanted = np.outer(a, a) * s.pairs >= 1
        self.pair = np.where(wanted, np.cumsum(wanted.ravel()).reshape(wanted.shape) + len(frequent), 0)
        self.suffix = np.zeros(1 + len(frequent) + int(wanted.sum()), np.int64)
        self.suffix[self.pair[wanted]] = np.nonzero(wanted)[1]

    def states(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single and paired candidate before each place; texts begin at `starts`."""
        before = np.concatenate([[0], symbols[:-1]])
        before[starts] = 0
        one = self.single[before]
        earlier = np.concatenate([[0], one[:-1]])
        earlier[starts] = 0
        return one, self.pair[earlier, one]


class Lexicon(dict):
    """Numbers words as they come and holds arrays of what is known of each: hash, symbol, count in
    the head or 0. Forgets all when it has grown to the limit."""

    limit = 400_000

    def __init__(self, words: Words):
        super().__init__()
        self.words = words
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.hash, self.symbol, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        self.new.append(word)
        return value

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of all texts in one array, and where each text begins (and the last ends)."""
        if len(self) > self.limit:
            self.forget()
        parts = [tokens(t) for t in texts]
        bounds = np.cumsum([0] + [len(p) for p in parts])
        ids = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(parts)), np.int64, bounds[-1])
        if self.new:
            self.learn(self.new)
            self.new = []
        return ids, bounds

    def learn(self, new: list[bytes]) -> None:
        w = self.words
        hashes = [xxhash.xxh3_64_intdigest(x) for x in new]
        symbol = [w.symbol.get(h, -1) for h in hashes]
        symbol = [w.classes.get(first_two(x), w.other) if i < 0 else i for i, x in zip(symbol, new)]
        self.hash = np.concatenate([self.hash, np.array(hashes, np.uint64)])
        self.symbol = np.concatenate([self.symbol, np.array(symbol, np.int64)])
        self.count = np.concatenate([self.count, np.array([w.counts.get(h, 0) for h in hashes], np.int64)])


def spelled(words: list[bytes], depth: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Each word between `depth` word ends and one; where its own symbols begin and end."""
    ends = np.cumsum([depth + len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-1]]) + depth
    lead = b" " * depth
    return b"".join([lead + w + b" " for w in words]), begins, ends


def spelling_codes(words: list[bytes], tf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol (depth + 1 bytes as a number) at each place of the words, with counts."""
    symbols, begins, ends = spelled(words, depth)
    b = np.frombuffer(symbols, np.uint8).astype(np.uint64)
    code = np.zeros(len(b) - depth, np.uint64)
    for j in range(depth + 1):
        code = (code << np.uint64(8)) | b[j:j + len(code)]
    weight = np.zeros(len(b) + 1, np.int64)
    weight[begins] += tf
    weight[ends] -= tf
    weight = np.cumsum(weight)[depth:-1]
    return add_up([code[weight > 0]], [weight[weight > 0]])


def context_counts(docs: DataFrame, words: Words, s: Settings) -> DataFrame:
    """(kind, code, n): kind -1 has context * 2^20 + symbol of the word tree, kind d from 0 on the
    contexts of d bytes and their next byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Lexicon(words)
        pairs: tuple[list, list] = ([], [])
        rare: Counter = Counter()
        wide = words.other + 1 + len(words.classes)
        tally = np.zeros(len(words.suffix) * wide if len(words.suffix) * wide <= TALLY else 0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(tally)
            yield from counted(-1, *add_up([*pairs[0], (used // max(1, wide) << 20 | used % max(1, wide)).astype(np.uint64)], [*pairs[1], tally[used]]))
            tally[:] = 0
            some = list(rare)
            tf = np.fromiter(rare.values(), np.int64, len(some))
            for i in range(0, len(some), 100_000):
                code, n = spelling_codes(some[i:i + 100_000], tf[i:i + 100_000], s.depth)
                for depth in range(s.depth, -1, -1):
                    yield from counted(depth, code, n)
                    code, n = add_up([code & np.uint64((1 << 8 * depth) - 1)], [n])
            for held in (*pairs, rare):
                held.clear()
        for _, texts in pieces_of(batches):
            ids, bounds = memory.read(texts)
            symbols = memory.symbol[ids]
            one, two = words.states(symbols, bounds[:-1])
            for state, used in ((np.zeros_like(one), slice(None)), (one, one > 0), (two, two > 0)):
                if len(tally):
                    tally += np.bincount(state[used] * wide + symbols[used], minlength=len(tally))
                    continue
                code, n = np.unique((state[used] << 20 | symbols[used]).astype(np.uint64), return_counts=True)
                pairs[0].append(code)
                pairs[1].append(n)
            tf = np.bincount(ids, minlength=len(memory))
            wanted = (tf > 0) & (memory.symbol >= words.other) & (memory.count == 0)
            rare.update(dict(zip(itertools.compress(memory, wanted.tolist()), tf[wanted].tolist())))
            if len(rare) > 300_000 or sum(map(len, pairs[0])) > 4_000_000:
                yield from flush()
        yield from flush()
    found = docs.select("text").mapInArrow(run, "kind int, code long, n long")
    return stored(found.groupBy("kind", "code").agg(F.sum("n").alias("n")), "contexts")


@dataclass
class Automaton:
    """Next state and log10 probability by state and symbol class; class of each byte."""

    classes: np.ndarray
    step: np.ndarray
    logs: np.ndarray
    depth: int

    def spell(self, words: list[bytes], known: np.ndarray) -> np.ndarray:
        """log10 probability of each word and its end, given its first `known` symbols."""
        symbols, begins, ends = spelled(words, self.depth)
        n, lead = len(symbols), self.depth
        data = self.classes[np.frombuffer(b" " * lead + symbols, np.uint8)]
        lanes = min(LANES, n)
        width = -(-n // lanes)
        data = np.concatenate([data, np.zeros(lanes * width - n, data.dtype)])
        # Row t holds the symbols that the lanes read at step t.
        starts = np.arange(lanes) * width
        state = np.zeros(lanes, np.int64)
        wide = self.step.shape[1]
        step, logs = self.step.ravel(), self.logs.ravel()
        out = np.empty((lanes, width), np.float32)
        for t in range(lead):
            state = step[state * wide + data[starts + t]].astype(np.int64)
        for t in range(width):
            at = state * wide + data[starts + (lead + t)]
            out[:, t] = logs[at]
            state = step[at].astype(np.int64)
        flat = out.ravel()[:n].astype(np.float64)
        running = np.concatenate([[0.0], np.cumsum(flat)])
        return running[ends] - running[np.minimum(begins + known, ends)]


def byte_tree(rows, s: Settings) -> Automaton:
    """Automaton of the (depth, code, n) rows of the candidate contexts."""
    by_context: dict[bytes, dict[int, int]] = {b"": {}}
    for depth, code, n in rows:
        raw = int(code).to_bytes(8, "big")[8 - depth - 1:]
        by_context.setdefault(raw[:-1], {})[raw[-1]] = int(n)
    used = sorted({x for c in by_context for x in c} | {x for some in by_context.values() for x in some} | {0x20})
    classes = np.full(256, len(used), np.int16)  # one class for the bytes never seen
    classes[used] = np.arange(len(used))
    wide = len(used) + 1
    root = np.zeros(wide)
    for x, n in by_context[b""].items():
        root[classes[x]] = n
    root = (root + 1) / (root.sum() + 256)  # the spare bytes: one count each, for a single byte
    smooth = {b"": root}
    retained = {b""}
    for context in sorted(by_context, key=lambda c: (len(c), c)):
        if not context:
            continue
        parent = next(context[i:] for i in range(1, len(context) + 1) if context[i:] in smooth)
        counts = np.zeros(wide)
        for x, n in by_context[context].items():
            counts[classes[x]] = n
        size, kinds = counts.sum(), np.count_nonzero(counts)
        seen = counts > 0
        share = counts[seen] / size
        if (counts[seen] * np.log(share / smooth[parent][seen])).sum() >= s.divergence:
            smooth[context] = (counts + kinds * smooth[parent]) / (size + kinds)
            retained.add(context)
    states = sorted({c[:i] for c in retained for i in range(len(c) + 1)}, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(states)}
    step = np.zeros((len(states), wide), np.int32)
    logs = np.empty((len(states), wide), np.float32)
    for c, i in number.items():  # shorter ones first: a state inherits the moves of its suffix
        holder = next(c[k:] for k in range(len(c) + 1) if c[k:] in smooth)
        logs[i] = np.log10(smooth[holder])
        if c:
            step[i] = step[number[next(c[k:] for k in range(1, len(c) + 1) if c[k:] in number)]]
        for x in used:
            child = number.get(c + bytes([x]))
            if child is not None:
                step[i, classes[x]] = child
    return Automaton(classes, step, logs, s.depth)


def train_bytes(counts: DataFrame, s: Settings) -> Automaton:
    """The driver gets the candidate contexts only: at most depth / least_share of them, with at
    most 256 next symbols each."""
    contexts = counts.where("kind >= 0").withColumn("context", F.shiftrightunsigned("code", 8))
    total = counts.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    sizes = contexts.groupBy("kind", "context").agg(F.sum("n").alias("size")).where(F.col("size") >= max(1, total * s.least_share))
    rows = contexts.join(sizes.select("kind", "context"), ["kind", "context"]).select("kind", "code", "n").toPandas()
    return byte_tree(rows.itertuples(index=False), s)


@dataclass
class WordTree:
    """State of each candidate context (the state of its longest retained suffix), and log10
    probabilities by state and symbol."""

    state: np.ndarray
    logs: np.ndarray
    counts: np.ndarray


def word_tree(counts: DataFrame, words: Words, s: Settings) -> WordTree:
    """The driver gets at most 2 * contexts + 1 candidates with their next symbols."""
    rows = counts.where("kind = -1").select("code", "n").toPandas()
    wide, at = words.other + 1 + len(words.classes), rows["code"].to_numpy(np.int64)
    table_ = np.zeros((len(words.suffix), wide))
    table_[at >> 20, at & ((1 << 20) - 1)] = rows["n"].to_numpy(float)
    root = (table_[0] + 1) / (table_[0].sum() + wide)
    smooth, state = [root], np.zeros(len(words.suffix), np.int64)
    for context in range(1, len(words.suffix)):  # the single ones come before the pairs
        n = table_[context]
        parent = state[words.suffix[context]]
        state[context] = parent
        size, seen = n.sum(), n > 0
        if size and (n[seen] * np.log(n[seen] / size / smooth[parent][seen])).sum() >= s.divergence:
            kinds = np.count_nonzero(seen)
            state[context] = len(smooth)
            smooth.append((n + kinds * smooth[parent]) / (size + kinds))
    return WordTree(state, np.log10(np.array(smooth)).astype(np.float32), table_[0])


@dataclass
class Model:
    words: Words
    tree: WordTree
    spelling: Automaton


def train(docs: DataFrame, s: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model, and the counts of all tokens of the documents."""
    counts = word_counts(docs)
    words = Words(counts, s)
    contexts = context_counts(docs, words, s)
    model = Model(words, word_tree(contexts, words, s), train_bytes(contexts, s))
    dropped(contexts)
    return model, counts


class Scored(Lexicon):
    """Also by word: `own`, log10 of its probability within its class (0 for symbols), and `spelled`.

    Within a class: (count + r * size * spelling) / (size * (1 + r)), r: the share of words seen once.
    For words under the head's least count `own` is minus the log of size * (1 + r) only, and `spelled`
    that of r * size * spelling; the count comes by the join.
    """

    def __init__(self, model: Model):
        self.model, w = model, model.words
        others = model.tree.counts[w.other:]
        self.ratio = (w.once + 1) / (others.sum() + 1)
        self.size = np.maximum(others, 1)
        super().__init__(w)

    def forget(self) -> None:
        super().forget()
        self.own, self.spelled = np.zeros(0), np.zeros(0)

    def learn(self, new: list[bytes]) -> None:
        super().learn(new)
        place, count = self.symbol[-len(new):] - self.words.other, self.count[-len(new):]
        own, spelled_ = np.zeros(len(new)), np.zeros(len(new))
        some = np.flatnonzero(place >= 0)
        if len(some):
            place, count = place[some], count[some]
            log = self.model.spelling.spell([new[i] for i in some], np.where(place > 0, 2, 0)) + np.log10(self.ratio * self.size[place])
            spelled_[some] = log
            own[some] = np.where(count > 0, np.log10(count + 10**log), 0) - np.log10(self.size[place] * (1 + self.ratio))
        self.own, self.spelled = np.concatenate([self.own, own]), np.concatenate([self.spelled, spelled_])


class Runs:
    """Hashes of runs of symbols, by sums that all runs share."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (PRIME, INVERSE))
        self.sums = np.append(np.uint64(0), np.cumsum(mixed(symbols.astype(np.uint64) + np.uint64(1)) * up[:n]))
        self.down = down

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


@dataclass
class Paths:
    """Stretches of neighbouring places: the hash that deals them, their text, the first place, the
    number of symbols known before it (`window` at most), the number of places; all symbols."""

    gram: np.ndarray
    text: np.ndarray
    start: np.ndarray
    lead: np.ndarray
    size: np.ndarray
    symbols: np.ndarray

    def hashes(self) -> np.ndarray:
        run = Runs(self.symbols).of(self.start - self.lead, self.start + self.size)
        return mixed(run * PRIME + self.lead.astype(np.uint64))

    def of(self, some: np.ndarray) -> Paths:
        return Paths(self.gram[some], self.text[some], self.start[some], self.lead[some], self.size[some], self.symbols)

    def own_symbols(self) -> np.ndarray:
        """The symbols of each stretch and those known before it, one stretch after the other."""
        length = self.lead + self.size
        shift = self.start + self.size - np.cumsum(length)
        return self.symbols[np.arange(length.sum()) + np.repeat(shift, length)].astype(np.uint16)


def paths_of(symbols: np.ndarray, bounds: np.ndarray, words: Words, s: Settings, gram: int = 0, window: int = 0,
             some: np.ndarray | None = None) -> Paths:
    """All places (or `some` of them, ascending) with `gram` symbols of their text before them; equal contexts
    are dealt alike wherever they stand."""
    gram, window = gram or s.gram, window or s.window
    text = owners(bounds)
    before = np.arange(len(symbols)) - bounds[text]
    at = np.flatnonzero(before >= gram) if some is None else some
    frequent = (words.single[symbols] > 0).astype(np.uint64)
    pairs = window_hashes(mixed(symbols.astype(np.uint64) + np.uint64(1)), 2)
    order = pairs >> np.uint64(2) | (frequent[:-1] + frequent[1:]) << np.uint64(62)
    least = sliding(order, gram - 1, np.minimum)[at - gram] if len(at) else order[:0]
    begins = np.append(True, (np.diff(at) != 1) | (least[1:] != least[:-1]))[:len(at)]
    first = np.flatnonzero(begins)
    # A long repetition of one pair is cut.
    begins |= (np.arange(len(at)) - first[np.cumsum(begins) - 1]) % MOST_PLACES == 0
    first = np.flatnonzero(begins)
    start = at[first]
    return Paths(mixed(least[first]), text[start], start, np.minimum(before[start], window), np.diff(np.append(first, len(at))), symbols)


def packed(values: np.ndarray) -> bytes:
    """The values by byte planes, compressed, after their number of bytes."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def steps(values: np.ndarray) -> np.ndarray:
    """First value and differences, which pack better than ascending numbers."""
    return np.diff(values, prepend=0).astype(np.int32)


def alike(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct hash, and the number of each place's hash among them."""
    order = np.argsort(hashes)
    begins = np.append(True, np.diff(hashes[order]) != 0)[:len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(begins) - 1
    return np.minimum.reduceat(order, np.flatnonzero(begins)) if len(order) else order, place


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (`size` of them) of each, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


#: Columns of stretches, by part and piece of the input: of each occurrence the first place and the text within the
#: piece, and if it is learned; of each distinct stretch its occurrences, its symbols and what its places gain so far.
STRETCHES = {"at": np.int32, "text": np.int32, "learned": np.uint8, "many": np.int32, "lead": np.uint8, "size": np.uint8, "symbols": np.uint16, "gain": np.int64}
SCHEMA = "part int, piece long, " + ", ".join(f"{x} binary" for x in STRETCHES)


def dealt(p: Paths, piece: int, learned: np.ndarray, parts: int, gain: np.ndarray | None = None) -> pa.Table:
    """Distinct stretches of a piece of the input, a row per part of the pairs' hash range. learned: by text; gain: by
    place of the piece."""
    first, place = alike(p.hashes())
    part = (p.gram[first] >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int32)
    order = np.lexsort((first, part))
    # Number of each occurrence's stretch in the order of the parts.
    number = np.argsort(order)[place]
    by = np.argsort(number, kind="stable")
    some, part, many = p.of(first[order]), part[order], np.bincount(number, minlength=len(first))
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
    cut = lambda size: np.append(0, np.cumsum(size))[np.append(begin, len(part))].tolist()
    one, each, place_, symbol = (cut(x) for x in (np.ones_like(many), many, some.size, some.lead + some.size))
    columns = {"at": (p.start[by], each), "text": (p.text[by], each), "learned": (learned[p.text[by]], each), "many": (many, one),
               "lead": (some.lead, one), "size": (some.size, one), "symbols": (some.own_symbols(), symbol),
               "gain": (gain[spans(some.start, some.size)], place_) if gain is not None else (np.zeros(0), [0] * len(place_))}
    blobs = {name: pa.array([packed(steps(values[a:b]) if name in ("at", "text") else values[a:b].astype(STRETCHES[name]))
                             for a, b in zip(ends, ends[1:])], pa.binary()) for name, (values, ends) in columns.items()}
    return pa.table({"part": part[begin], "piece": np.full(len(begin), piece, np.int64), **blobs})


def gathered(table: pa.Table) -> tuple[dict[str, np.ndarray], Paths, np.ndarray]:
    """The columns of the stretches of some rows, one after the other, with the row of each occurrence (`row`) and its
    stretch (`which`); the stretches; how many of each are learned."""
    x = {"row": []}
    for name, kind in STRETCHES.items():
        some = [unpacked(b, kind) for b in table.column(name).to_pylist()]
        some = [np.cumsum(v) for v in some] if name in ("at", "text") else some
        x[name] = np.concatenate([np.zeros(0, kind), *some])
        if name == "at":
            x["row"] = np.repeat(np.arange(len(some)), [len(v) for v in some])
    x["which"] = np.repeat(np.arange(len(x["many"])), x["many"])
    lead, size = x["lead"].astype(np.int64), x["size"].astype(np.int64)
    start = np.cumsum(lead + size) - size
    learned = np.bincount(x["which"], x["learned"], len(size)).astype(np.int64)
    return x, Paths(start, start, start, lead, size, x["symbols"]), learned


def by_text(x: dict[str, np.ndarray], gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and text of the occurrences that gain something (gain: by occurrence), and what each text gains."""
    used = np.flatnonzero(gain)
    code, of = np.unique(x["row"][used].astype(np.int64) << 32 | x["text"][used], return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, of, gain[used])
    return code >> 32, code & 0xFFFFFFFF, total


def place_gains(p: Paths, n: np.ndarray, model: Model, s: Settings, shortest: int, longest: int,
                gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each place of the stretches (n: learned ones) gains by its longest retained context of `shortest` to
    `longest` symbols, log10 in whole numbers of 1e-9 (else `gain`); the places that share one of `longest`."""
    at = spans(p.start, p.size)
    known, n = (at - np.repeat(p.start - p.lead, p.size)).astype(np.uint8), np.repeat(n, p.size)
    w, tree, symbols = model.words, model.tree, p.symbols
    one = w.single[symbols[at - 1]]
    two = w.pair[w.single[symbols[at - 2]], one]
    short = tree.logs[np.where(two > 0, tree.state[two], tree.state[one]), symbols[at]]
    del one, two
    gain, live = gain.copy(), np.flatnonzero(known >= shortest)
    # A context's number and the symbol before it number the longer context.
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    context, width = np.zeros(len(live), np.int64), 0

    def longer(back: int) -> None:
        nonlocal context, width
        if width + 2 * bits > 63:
            context = np.unique(context, return_inverse=True)[1]
            width = int(context.max(initial=0)).bit_length()
        context, width = context << bits | symbols[at[live] - back], width + bits
    for back in range(1, shortest):
        longer(back)
    for length in range(shortest, longest + 1):
        some = known[live] >= length
        live, context = live[some], context[some]
        longer(length)
        # Places by context, those of one by the next symbol.
        both = context << bits | symbols[at[live]]
        order = np.argsort(both)
        live, both = live[order], both[order]
        context = both >> bits
        begins = np.append(True, context[1:] != context[:-1])[:len(live)]
        group = np.cumsum(begins) - 1
        some = np.bincount(group, n[live])[group] >= s.least
        live, both, begins = live[some], both[some], begins[some]
        if not len(live):
            break
        group = np.cumsum(begins) - 1
        context, width = group, int(group[-1]).bit_length()
        pair = np.append(True, both[1:] != both[:-1])
        first, pair = np.flatnonzero(pair), np.cumsum(pair) - 1
        seen = np.bincount(group, n[live])
        count, of, log = np.bincount(pair, n[live]), group[first], short[live[first]].astype(np.float64)
        kinds = np.bincount(of, count > 0)
        apart = np.where(count > 0, count * (np.log(np.maximum(count, 1) / seen[of]) - log * np.log(10)), 0)
        retained = np.bincount(of, apart)[of] >= s.long_divergence
        more = np.rint((np.log10((count + kinds[of] * 10**log) / (seen + kinds)[of]) - log) * 1e9).astype(np.int64)
        gain[live] = np.where(retained[pair], more[pair], gain[live])
    shared = np.zeros(len(at), bool)
    shared[live] = True
    return gain, shared


def gains(p: Paths, n: np.ndarray, model: Model, s: Settings) -> np.ndarray:
    """What the places of each stretch gain by long contexts of any length, added up."""
    if not len(p.size):
        return np.zeros(0, np.int64)
    gain = place_gains(p, n, model, s, s.gram, s.window, np.zeros(p.size.sum(), np.int64))[0]
    return np.add.reduceat(gain, np.cumsum(p.size) - p.size)


def path_gains(pieces: DataFrame, model: Model, s: Settings) -> DataFrame:
    """row, gain (whole numbers of 1e-9) of the texts whose places gain something. pieces: the number of the
    first of some texts, the symbols of all of them, their sizes, which are learned, bytes of text."""
    size, parts = pieces.agg(F.sum("bytes")).first()[0] or 0, 64
    while parts * s.per_part < size:
        parts *= 2
    # Tasks need no counts of words.
    words = SimpleNamespace(single=model.words.single, pair=model.words.pair)
    known = SimpleNamespace(words=words, tree=SimpleNamespace(state=model.tree.state, logs=model.tree.logs))
    reach = min(max(s.reach, s.gram), s.window)

    def piece_of(symbols: bytes, sizes: bytes, learned: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpacked(symbols, np.uint16).astype(np.int64), np.append(0, np.cumsum(unpacked(sizes, np.int32), dtype=np.int64)), unpacked(learned, np.uint8)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, *blobs in zip(*(batch.column(x).to_pylist() for x in ("row", "symbols", "sizes", "learned"))):
                symbols, bounds, learned = piece_of(*blobs)
                yield from dealt(paths_of(symbols, bounds, words, s, s.gram, reach), piece, learned, parts).to_batches()

    def near(table: pa.Table) -> pa.Table:
        """What places gain by contexts of up to `reach` symbols; summed by text where no longer one can be shared."""
        x, p, n = gathered(table)
        gain, shared = place_gains(p, n, known, s, s.gram, reach, np.zeros(p.size.sum(), np.int64))
        shared &= reach < s.window
        first, which = np.cumsum(p.size) - p.size, x["which"]
        row, text, total = by_text(x, np.add.reduceat(np.where(shared, 0, gain), first)[which])
        place = spans(first[which], p.size[which])
        open_ = np.flatnonzero(shared[place])
        at = np.repeat(x["row"], p.size[which])[open_] << 32 | spans(x["at"].astype(np.int64), p.size[which])[open_]
        order = np.argsort(at)
        at, gain = at[order], gain[place[open_[order]]]
        cut = lambda of: np.searchsorted(of, np.arange(len(table) + 1)).tolist()
        blob = lambda values, ends: pa.array([packed(values[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
        gaps = lambda values, ends: pa.array([packed(steps(values[a:b])) for a, b in zip(ends, ends[1:])], pa.binary())
        texts, places = cut(row), cut(at >> 32)
        return pa.table({"piece": table.column("piece"), "text": gaps(text, texts), "total": blob(total, texts),
                         "at": gaps(at & 0xFFFFFFFF, places), "gain": blob(gain, places)})

    def go_on(piece: pa.Table, found: pa.Table) -> pa.Table:
        """Stretches of the places that share a context of `reach` symbols; what the texts gain otherwise."""
        number, *blobs = (piece.column(x)[0].as_py() for x in ("row", "symbols", "sizes", "learned"))
        symbols, bounds, learned = piece_of(*blobs)
        column = lambda name, kind, how=lambda v: v: np.concatenate([np.zeros(0, kind), *(how(unpacked(b, kind)) for b in found.column(name).to_pylist())])
        total, gain = np.zeros(len(learned), np.int64), np.zeros(len(symbols), np.int64)
        np.add.at(total, column("text", np.int32, np.cumsum), column("total", np.int64))
        at = column("at", np.int32, np.cumsum)
        gain[at] = column("gain", np.int64)
        text = np.searchsorted(bounds, at, "right") - 1
        whole = at - bounds[text] == reach  # no longer context
        np.add.at(total, text[whole], gain[at[whole]])
        out = dealt(paths_of(symbols, bounds, words, s, reach + 1, s.window, np.sort(at[~whole])), number, learned, parts, gain)
        some = np.flatnonzero(total)
        part = int(mixed(np.array([number], np.uint64))[0]) % parts
        last = {name: [b""] for name in STRETCHES} | {"part": [part], "piece": [number], "text": [packed(steps(some))], "gain": [packed(total[some])]}
        return pa.concat_tables([out, pa.table({x.name: pa.array(last[x.name], x.type) for x in out.schema}, out.schema)])

    def far(table: pa.Table) -> pa.Table:
        """What places gain by contexts of more than `reach` symbols, else by shorter ones; sums pass through."""
        ended = pc.equal(pc.binary_length(table.column("at")), 0)
        sums, table = table.filter(ended), table.filter(pc.invert(ended))
        rows, totals = [], []
        for piece, text, total in zip(*(sums.column(x).to_pylist() for x in ("piece", "text", "gain"))):
            rows.append(piece + np.cumsum(unpacked(text, np.int32), dtype=np.int64))
            totals.append(unpacked(total, np.int64))
        if len(table):
            x, p, n = gathered(table)
            gain = place_gains(p, n, known, s, reach + 1, s.window, x["gain"])[0]
            row, text, total = by_text(x, np.add.reduceat(gain, np.cumsum(p.size) - p.size)[x["which"]])
            rows.append(table.column("piece").to_numpy()[row] + text)
            totals.append(total)
        return pa.table({"row": np.concatenate(rows), "gain": np.concatenate(totals)})

    first = pieces.select("row", "symbols", "sizes", "learned").mapInArrow(begin, SCHEMA)
    first = first.groupBy("part").applyInArrow(near, "piece long, text binary, total binary, at binary, gain binary")
    first = stored(first, "near")
    then = pieces.groupBy("row").cogroup(first.groupBy("piece")).applyInArrow(go_on, SCHEMA)
    found = then.groupBy("part").applyInArrow(far, "row long, gain long")
    return found.groupBy("row").agg(F.sum("gain").alias("gain"))


def score(docs: DataFrame, model: Model, counts: DataFrame, learned: Column, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs; `learned` marks the
    rows whose long contexts count.

    Words of the head are looked up in the tasks; the rarer words of each text are joined with the
    counts, its text with what its long contexts gain, and what they add is summed per row.
    """
    words, tree = model.words, model.tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        memory = Scored(model)
        for rows, texts in pieces_of(batches):
            ids, bounds = memory.read(texts)
            symbols, starts = memory.symbol[ids], bounds[:-1]
            one, two = words.states(symbols, starts)
            state = np.where(two > 0, tree.state[two], tree.state[one])
            logs = np.add.reduceat(tree.logs[state, symbols] + memory.own[ids], starts)
            base = np.add.reduceat(np.log10(memory.count + 1.0)[ids], starts)
            known = np.add.reduceat((memory.count > 0).astype(np.int64)[ids], starts)
            rare = ((memory.symbol >= words.other) & (memory.count == 0))[ids]
            tail, tf = np.unique(owners(bounds)[rare] << 32 | ids[rare], return_counts=True)
            word = tail & 0xFFFFFFFF
            m, k = len(tail), len(texts)
            flags = rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            tails = [serial + (tail >> 32), memory.hash[word].view(np.int64), tf.astype(np.int32), memory.spelled[word].astype(np.float32)]
            each = [serial + np.arange(k), rows.column(0).cast(pa.int64()), np.diff(bounds), known, base, logs]
            whole = [[x] for x in (serial, packed(symbols.astype(np.uint16)), packed(np.diff(bounds).astype(np.int32)), packed(flags), sum(map(len, texts)))]
            for size, some in ((m, dict(zip(["row", "word", "tf", "spelled"], tails))), (k, dict(zip(["row", "doc_id", "n_tokens", "known", "base", "score"], each))),
                               (1, dict(zip(["row", "symbols", "sizes", "learned", "bytes"], whole)))):
                yield pa.RecordBatch.from_arrays([pa.array(some[x.name], x.type) if x.name in some else pa.nulls(size, x.type) for x in fields], schema=fields)
            serial += k
    fields = pa.schema([("row", pa.int64()), ("word", pa.int64()), ("tf", pa.int32()), ("spelled", pa.float32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                        ("base", pa.float64()), ("score", pa.float64()), ("symbols", pa.binary()), ("sizes", pa.binary()), ("learned", pa.binary()), ("bytes", pa.int64())])
    schema = "row long, word long, tf int, spelled float, doc_id long, n_tokens long, known long, base double, score double, symbols binary, sizes binary, learned binary, bytes long"
    # Rare words of a text, texts, and pieces of the input with the symbols of all their texts.
    both = kept(docs.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("learned")).mapInArrow(run, schema), "scored")
    tail = both.where("word is not null").select("row", "word", "tf", F.col("spelled").cast("double").alias("spelled"))
    tail = tail.join(counts.where("kind = 0").select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Whole numbers of 1e-9 add up alike in any order.
    exact = lambda x: F.sum(F.round(F.col("tf") * x * 1e9).cast("long"))
    own = F.when(F.col("n") > 0, F.log10(F.col("n") + F.pow(F.lit(10.0), "spelled"))).otherwise(F.col("spelled"))
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more"),
                                   exact(F.log10(F.col("n") + 1)).alias("plus"), exact(own).alias("own"))
    tail = stored(tail, "tails")
    gained = path_gains(both.where("symbols is not null").select("row", "symbols", "sizes", "learned", "bytes"), model, s)
    texts = both.where("n_tokens is not null").select("row", "doc_id", "n_tokens", "known", "base", "score")
    texts = texts.join(tail, "row", "left").join(gained, "row", "left")
    rest = F.col("n_tokens") * F.lit(float(np.log10(words.total + words.kinds + 1)))
    zero = F.lit(0)
    return texts.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
                        F.lit(words.total).cast("long").alias("train_tokens"),
                        (F.col("base") + F.coalesce("plus", zero) / 1e9 - rest).alias("base_score"),
                        (F.col("score") + (F.coalesce("own", zero) + F.coalesce("gain", zero)) / 1e9).alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the model of the documents outside the held-out fold.

    NULL and empty texts are one text end. Equal texts score alike; repeated rows give repeated
    rows. Very long texts are one piece of work. Other columns are not read. Empty table: no rows. No
    training documents: even odds for every symbol.
    """
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    model, counts = train(docs.where(~held))
    found = score(docs, model, counts, ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
