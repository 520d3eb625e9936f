"""Long contexts of the language model against naive counts, and what they do to scores."""

import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import some_words
from tillscope.llm.suffix_tree import Paths, Settings, gains, paths_of, score, train

SYMBOLS = 9


def toy():
    """Short contexts: none, or the symbol before if it is 1 or 2."""
    rng = np.random.default_rng(3)
    single = np.zeros(SYMBOLS, np.int64)
    single[[1, 2]] = 1, 2
    share = rng.random((3, SYMBOLS)) + 0.1
    words = SimpleNamespace(single=single, pair=np.zeros((3, 3), np.int64))
    tree = SimpleNamespace(state=np.arange(3), logs=np.log10(share / share.sum(1, keepdims=True)))
    return SimpleNamespace(words=words, tree=tree)


def test_gains_match_naive_contexts():
    rng = random.Random(9)
    s, model = Settings(window=8, long_divergence=1.5), toy()
    chunk = [[rng.randrange(1, SYMBOLS) for _ in range(30)] for _ in range(4)]
    texts = [[*sum(rng.sample(chunk, 2), []), *(rng.randrange(1, SYMBOLS) for _ in range(rng.randrange(12))), 0] for _ in range(40)] + [[0], [3, 0]]
    learned = [i % 5 > 0 for i in range(len(texts))]
    contexts = defaultdict(Counter)
    suffixes = lambda text, t: [tuple(text[t - n:t]) for n in range(s.gram, min(t, s.window) + 1)]
    for i, text in enumerate(texts):
        for t in range(len(text) if learned[i] else 0):
            for context in suffixes(text, t):
                contexts[context][text[t]] += 1
    wanted, used = [0.0] * len(texts), Counter()
    for i, text in enumerate(texts):
        for t, x in enumerate(text):
            for context in reversed(suffixes(text, t)):
                n = contexts.get(context, Counter())
                short = 10 ** model.tree.logs[model.words.single[context[-1]]]
                size = sum(n.values())
                if size >= s.least and sum(c * math.log(c / size / short[y]) for y, c in n.items()) >= s.long_divergence:
                    wanted[i] += math.log10((n[x] + len(n) * short[x]) / (size + len(n)) / short[x])
                    used[len(context)] += 1
                    break
    bounds = np.cumsum([0] + [len(x) for x in texts])
    p = paths_of(np.array(sum(texts, [])), bounds, model.words, s)
    key, first, place = np.unique(p.hashes(), return_index=True, return_inverse=True)
    gain = gains(p.of(first), np.bincount(place, np.array(learned)[p.text]), model, s)
    assert np.allclose(np.bincount(p.text, gain[place] / 1e9, len(texts)), wanted, atol=1e-7)
    assert len(used) == s.window - s.gram + 1 and sum(used.values()) > 500


def test_no_anchor_in_short_texts():
    s, model = Settings(), toy()
    p = paths_of(np.zeros(0, np.int64), np.array([0]), model.words, s)
    assert isinstance(p, Paths) and len(p.gram) == len(p.hashes()) == 0
    p = paths_of(np.array([1, 2, 0, 0]), np.array([0, 3, 4]), model.words, s)
    assert len(p.gram) == 0


def test_texts_that_occur_twice_score_apart_however_dealt(spark):
    rng = random.Random(12)
    texts = [some_words(rng, 80) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:10] + [texts[20]])] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("held", F.col("doc_id").isin(20, 30))
    scores = []
    for n in (1, 7):
        dealt = docs.repartition(n)
        model, counts = train(dealt.where("not held"))
        scores.append({r.doc_id: r.score / r.n_tokens for r in score(dealt, model, counts, ~F.col("held")).collect()})
    assert all(math.isclose(scores[0][d], scores[1][d], abs_tol=1e-6) for d in scores[0])
    got = scores[0]
    once, twice = [got[d] for d in range(21, 60)], [got[d] for d in range(10)]
    assert min(twice) > max(once) + 0.2
    assert all(got[60 + i] == got[i] for i in range(10))
    # A held-out text with one learned copy is no context that two places have.
    assert got[20] == got[70] < min(twice)
    assert got[90] == got[91] < 0


def test_all_places_of_short_texts_have_long_contexts(spark):
    """Texts of fewer symbols than the longest context, alike but for one or two words in front."""
    rng = random.Random(5)
    shared = some_words(rng, 8)
    texts = [f"{some_words(rng, 1 + i % 2)} {shared}" for i in range(12)] + [some_words(rng, 9) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held", F.col("doc_id") == 3)
    model, counts = train(docs.where("not held"))
    apart = [{r.doc_id: r.score for r in score(docs, model, counts, x).collect()} for x in (~F.col("held"), F.lit(False))]
    assert all(apart[0][d] > apart[1][d] + 3 for d in range(12))


def test_stretches_are_stored_packed():
    """Symbols of few bits take little more than those bits, and come back as they were."""
    from tillscope.llm.suffix_tree import packed, unpacked

    rng = np.random.default_rng(1)
    symbols = np.minimum(rng.zipf(1.3, 40_000), 8000).astype(np.uint16)
    for values in (symbols, symbols[:1], symbols[:0], symbols.astype(np.int32), symbols.astype(np.uint64) << np.uint64(40), symbols.astype(np.uint8)):
        assert (unpacked(packed(values), values.dtype) == values).all() and unpacked(packed(values), values.dtype).dtype == values.dtype
    assert len(packed(symbols)) < 0.7 * symbols.nbytes


def test_gains_in_two_rounds_match_gains_at_once(spark):
    """Places that share no context of `reach` symbols are done in the first round, the others in the second."""
    from tillscope.llm.suffix_tree import packed, path_gains

    rng = random.Random(21)
    s, model = Settings(window=9, reach=4, long_divergence=1.5), toy()
    chunk = [[rng.randrange(1, SYMBOLS) for _ in range(30)] for _ in range(4)]
    line = [3, 4, 5, 6, 7, 8, 3, 4, 6]
    texts = [[*sum(rng.sample(chunk, 2), []), *(rng.randrange(1, SYMBOLS) for _ in range(rng.randrange(40))), *line * (i % 3), 0] for i in range(60)]
    texts += [[0], [3, 0], *texts[:9], [5] * 300 + [0], [1, 2] * 90 + [0]]
    learned = np.array([i % 5 > 0 for i in range(len(texts))])
    bounds = np.cumsum([0] + [len(x) for x in texts])
    p = paths_of(np.array(sum(texts, [])), bounds, model.words, s)
    wanted = np.bincount(p.text, gains(p, learned[p.text], model, s), len(texts))
    blob = lambda values, kind: bytearray(packed(np.array(values, kind)))
    for many in (1, 7, len(texts)):
        cuts = np.linspace(0, len(texts), many + 1).astype(int).tolist()
        rows = [(1000 * a, blob(sum(texts[a:b], []), np.uint16), blob([len(x) for x in texts[a:b]], np.int32), blob(learned[a:b], np.uint8), 9)
                for a, b in zip(cuts, cuts[1:])]
        pieces = spark.createDataFrame(rows, "row long, symbols binary, sizes binary, learned binary, bytes long").repartition(3)
        got = {r.row: r.gain for r in path_gains(pieces, model, s).collect()}
        assert {k: v for k, v in got.items() if v} == {1000 * a + i - a: int(wanted[i]) for a, b in zip(cuts, cuts[1:]) for i in range(a, b) if wanted[i]}
