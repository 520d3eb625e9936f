"""Language of a text by unigrams of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word, led by the
mark of a word start, has the probability of all ways to cut it into pieces, which the forward
algorithm sums: a[j] = sum_i a[i] * p(word[i:j]). Words are independent, so the score of a text is
the sum over its words. Piece probabilities are shares of the pieces into which the vocabulary's
tokenizer cuts the words of a language.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import pieces_of, remainder, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
FOLDS, HELD_OUT = 4, 2
#: Longest word scored in one go; longer ones are cut into such parts.
PART = 48
UNKNOWN = 1e-7


def words_of(text: bytes) -> list[str]:
    """Lower-case words of letters, cut at PART letters."""
    found = WORD.findall(text.decode("utf-8", "replace").lower())
    if max(map(len, found), default=0) > PART:
        found = [w[i:i + PART] for w in found for i in range(0, len(w), PART)]
    return found


def load(vocabulary: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary)


def forward(words: list[str], model: Model) -> np.ndarray:
    """log probability of each word in each language, summed over all segmentations.

    Words of equal length go through the recursion together; a sign that is no piece counts as one
    with a small fixed probability.
    """
    out = np.empty((len(words), len(model.langs)))
    by_length: dict[int, list[int]] = defaultdict(list)
    for at, word in enumerate(words):
        by_length[len(word) + 1].append(at)
    find, longest = model.ids.get, model.longest
    for n, places in by_length.items():
        marked = [MARK + words[at] for at in places]
        a = [np.ones((len(places), len(model.langs)))]
        for j in range(1, n + 1):
            total = np.zeros_like(a[0])
            for i in range(max(0, j - longest), j):
                ids = np.fromiter((find(w[i:j], 0) for w in marked), np.int32, len(marked))
                if i == j - 1:
                    total += a[i] * np.where(ids[:, None] > 0, model.probabilities[ids], UNKNOWN)
                elif ids.any():
                    some = np.flatnonzero(ids)
                    total[some] += a[i][some] * model.probabilities[ids[some]]
            a.append(total)
        out[places] = np.log(np.maximum(a[n], 1e-300))
    return out


class Model:
    """Languages, piece numbers (from 1), and by number the probabilities in each language."""

    def __init__(self, langs: list[str], ids: dict[str, int], probabilities: np.ndarray):
        self.langs, self.ids, self.probabilities = langs, ids, probabilities
        self.longest = max(map(len, ids), default=1)


def _counts(docs: DataFrame, vocabulary: str) -> dict[str, dict[int, int]]:
    """How often each piece of the vocabulary occurs in the words of each language.

    Tasks add up before the shuffle; the driver gets one row per language and piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = load(vocabulary)
        words: dict[str, Counter] = defaultdict(Counter)
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(sp.get_piece_size()))

        def flush() -> None:
            for lang, some in words.items():
                found = sp.encode(list(some), out_type=int, num_threads=1)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
                weights = np.repeat(np.fromiter(some.values(), np.float64, len(some)), sizes)
                sums[lang] += np.bincount(flat, weights, sp.get_piece_size())
            words.clear()
        for rows, texts in pieces_of(batches):
            for lang, t in zip(rows.column(0).to_pylist(), texts):
                words[lang].update(words_of(t))
            if sum(map(len, words.values())) > 200_000:
                flush()
        flush()
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], ["lang", "piece", "n"])
    out: dict[str, dict[int, int]] = defaultdict(dict)
    counted = docs.select("lang", "text").mapInArrow(run, "lang string, piece int, n long")
    for r in counted.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
        out[r.lang][r.piece] = r.n
    return out


def train(docs: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """Model of the documents with a language: each piece's share of the pieces into which the
    public vocabulary cuts the language's words, with a tenth of a count added for every piece.

    The driver holds a number per language and piece: at most the vocabulary times the languages.
    """
    counts = _counts(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), vocabulary)
    langs, sp = sorted(counts), load(vocabulary)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    used = sorted({i for some in counts.values() for i in some} & set(usable))
    table_ = np.array([[counts[lang].get(i, 0) for lang in langs] for i in used], np.float64).reshape(len(used), len(langs))
    shares = (table_ + 0.1) / (table_.sum(axis=0) + 0.1 * len(usable))
    return Model(langs, {sp.id_to_piece(i): k for k, i in enumerate(used, 1)}, np.vstack([np.zeros((1, len(langs))), shares]))


class WordScores:
    """Scores of the words met, as rows of one matrix; forgets all at the limit."""

    limit = 300_000

    def __init__(self, model: Model):
        self.model, self.rows, self.scores = model, {}, np.zeros((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.rows.keys())
        if len(self.rows) + len(new) > self.limit:
            self.rows, self.scores, new = {}, self.scores[:0], sorted(words)
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.scores = np.vstack([self.scores, forward(new, self.model)])

    def judge(self, words: Counter) -> tuple[str, float]:
        """Most likely language and its share of the probability; `und`, 0 without a letter."""
        langs = self.model.langs
        if not words or not langs:
            return "und", 0.0
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        total = np.fromiter(words.values(), np.float64, len(words)) @ self.scores[rows]
        best = int(np.argmax(total))
        return langs[best], 1 / float(np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each whole text. Ties: first name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordScores(model)
        for rows, texts in pieces_of(batches):
            counts = [Counter(words_of(t)) for t in texts]
            memory.learn(set().union(*counts))
            found = [memory.judge(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned outside the held-out fold.

    NULL text or a text without letters, and a table that teaches no language: `und`, score 0.
    Equal texts get equal predictions. Empty table: no rows.
    """
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    found = identify(docs, train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
