"""Each operator against a brute-force version or a property, on awkward and on empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import documents
from tillscope.llm.registry import QUERIES

ROWS, ITEM = documents()
PER_DOCUMENT = [n for n in QUERIES if n.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op7", "op9")]


def result(spark, folder, n, cache={}):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    if (folder, n) not in cache:
        cache[folder, n] = QUERIES[name](spark, folder).collect()
    return cache[folder, n]


def by_id(rows):
    return {r.doc_id: r for r in rows}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, odd, name):
    got = result(spark, odd, name[2:].split("_")[0])
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_base_score_counts(spark, odd):
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    count = Counter(w for r in ROWS if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    texts = {r[0]: r[1] for r in ROWS}
    for r in result(spark, odd, 1):
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(count[w] > 0 for w in own), n, held(r.doc_id))
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), abs_tol=1e-5)
        assert r.score < 0


def test_next_symbols_sum_to_one():
    import numpy as np

    from tillscope.llm.suffix_tree import Settings, byte_tree, spelling_codes

    s = Settings(depth=3, divergence=1.0)
    code, n = spelling_codes([b"banana", b"bandana"] * 20, np.ones(40, np.int64), 3)
    rows = []
    for depth in (3, 2, 1, 0):
        part = code & np.uint64((1 << 8 * (depth + 1)) - 1)
        rows += [(depth, int(c), int(n[part == c].sum())) for c in np.unique(part)]
    model = byte_tree(rows, s)
    spare = 256 - (model.logs.shape[1] - 1)
    weights = np.ones(model.logs.shape[1])
    weights[-1] = spare
    assert np.allclose((10 ** model.logs.astype(float)) @ weights, 1, atol=1e-4)
    a, b = model.spell([b"banana", b"nabxna"], np.zeros(2, np.int64))
    assert b < a < 0


def test_shards_slots_and_growth(spark, odd):
    rows = result(spark, odd, 2)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)


def test_weights_move_rows_only_into_what_grows(spark):
    from pyspark.sql import functions as F

    from tillscope.llm.sharding import LEVELS, Leaf, descend, even_tree

    tree = even_tree(8)
    heavier = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    df = descend(spark.range(3000), F.col("id").cast("string"), tree, LEVELS)
    rows = descend(df, F.col("id").cast("string"), heavier, ("r2", "k2", "s2")).collect()
    home = next(x for x in tree if x.shard == 5)
    assert all(r.s2 == r.shard or r.r2 == home.region for r in rows)
    assert all(r.rack == r.k2 or r.k2 == home.rack for r in rows if r.region == r.r2)
    assert all(r.s2 == r.shard or r.s2 == 5 for r in rows if r.rack == r.k2)
    assert min(Counter(r.shard for r in rows).values()) > 250


def test_removed_words_match_brute_force(spark, odd):
    first = {}
    words = {}
    for r in ROWS:
        if r[0] is not None:
            w = words[r[0]] = (r[1] or "").encode().split()
            for i in range(len(w) - 12):
                key = tuple(w[i:i + 13])
                first[key] = min(first.get(key, r[0]), r[0])
    for r in result(spark, odd, 4):
        w = words.get(r.doc_id, b"no id here".split())
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < r.doc_id:
                gone.update(range(i, i + 13))
        rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(rest).hexdigest())


def test_longer_levels_agree_with_brute_force(spark, odd):
    from tillscope.llm.common import table
    from tillscope.llm.doubling import levels, remove_repeats

    assert levels(40) == [10, 20, 40]
    got = by_id(remove_repeats(table(spark, odd, "documents"), 40).collect())
    assert got[61].n_removed == 90 and got[60].n_removed == 0
    assert [got[66 + i].n_removed for i in range(5)] == [0, 60, 60, 60, 60]


def test_one_doc_id_with_a_copy_and_another_text(spark):
    import random

    from tests.llm.conftest import some_words
    from tillscope.llm.doubling import remove_repeats

    rng = random.Random(6)
    base, own, part = some_words(rng, 40), some_words(rng, 30), some_words(rng, 20)
    docs = [(1, base), (2, base), (2, f"{own} {part}"), (3, f"{part} tail"), (4, own)]
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 40, 0), (2, 40, 40), (2, 50, 0), (3, 21, 20), (4, 30, 30)]


def test_edited_texts_and_likeness(spark, odd):
    ids = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    following = {a[0]: b[1] or "" for a, b in zip(ids, ids[1:]) if a[0] != 3}
    got = defaultdict(list)
    for r in result(spark, odd, 6):
        got[r.doc_id].append(r)
    for d, after in following.items():
        text = next(r[1] for r in ids if r[0] == d) or ""
        cut = len(text) // 4
        want = hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()
        r = got[d][0]
        assert (r.n_chars, r.edited_sha256) == (len(text), want)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if len(set(text)) > 5 and len(text) > 200:
            assert r.near_edited > 0.5
    assert got[60][0].fingerprint == got[61][0].fingerprint and got[60][0].near_next == 1
    assert got[75][0].fingerprint == ""


def test_components_match_brute_force(spark, odd):
    sets = {}
    for r in ROWS:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if None not in (a, b) and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {d: x if v == y else v for d, v in label.items()}
    for r in result(spark, odd, 7):
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id])
    assert label[64] == label[65] == label[60] == 60


def test_large_columns_lose_no_link(spark, tmp_path):
    """Twenty near copies of two texts that share half their words: columns over the small limit."""
    import random

    from tests.llm.conftest import some_words
    from tillscope.llm.jaccard import similar_groups

    rng = random.Random(8)
    half, ends = some_words(rng, 60), [some_words(rng, 60), some_words(rng, 60)]
    rows = []
    for i in range(40):
        words = f"{half} {ends[i % 2]}".split()
        words[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i % 2) for i in range(40)}


def test_items_are_found_and_nothing_else(spark, odd):
    found = {(r.doc_id, r.item_id) for r in result(spark, odd, 8)}
    assert found == {(71, 0), (71, 1), (72, 0), (72, 1), (77, 4), (78, 4)}


def test_edited_items_are_found(spark):
    import random

    from tests.llm.conftest import some_words
    from tillscope.llm.decontaminate import contaminated

    rng = random.Random(2)
    items = [(i, some_words(rng, 40 + i)) for i in range(15)]
    docs = []
    for i, text in items:
        words = text.split()
        words[10 + i] = "changed"
        docs.append((i, f"{some_words(rng, 7 * i)} {' '.join(words)} {some_words(rng, 30)}"))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i, _ in items}


def test_passages_across_documents(spark, odd):
    spans = defaultdict(list)
    for r in result(spark, odd, 10):
        assert r.n_words >= 50 and r.other_doc_id != r.doc_id
        spans[r.doc_id].append((r.start_word, r.end_word))
    assert all(spans[d] == [(30, 90)] for d in range(66, 71))
    assert all(spans[d] == [(0, 90)] for d in (60, 61, 62, 63, 65))
    # Document 64 has 40 and 49 words in common with its neighbours.
    assert set(spans) == {*range(60, 71)} - {64}


def brute_similarity(docs, items):
    """(doc_id, item_id): (similarity, first place) of the best item-sized window, from 0.8 on."""
    cut = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    spread = Counter(x for _, t in items for x in cut(t.split()))
    out = {}
    for i, t in items:
        own, n = cut(t.split()), len(t.split())
        for d, text in docs:
            words = text.split()
            best = max((sum(1 / spread[x] for x in own & cut(words[a:a + n])) / sum(1 / spread[x] for x in own), -a) for a in range(len(words)))
            if best[0] >= 0.8 - 1e-9:
                out[d, i] = (round(best[0], 6), -best[1])
    return out


def edited_items(rng, sizes):
    """Items, and documents with an item in which one word is changed, gone or new, at every alignment."""
    from tests.llm.conftest import some_words

    items, docs = [(n, some_words(rng, n)) for n in sizes], []
    for n, text in items:
        for place in (0, 1, n // 2, n - 2, n - 1):
            for kind in range(4):
                words = text.split()
                words[place:place + (kind != 2)] = [["changed"], [], ["new"], [words[place] + "?"]][kind]
                docs.append((len(docs), f"{some_words(rng, 9 + len(docs) % 16)} {' '.join(words)} {some_words(rng, 30)}"))
    return docs, items


@pytest.mark.parametrize("sizes", [range(5, 15), range(15, 23)])
def test_short_items_are_found_like_by_brute_force(spark, sizes):
    import random

    from tillscope.llm.decontaminate import Settings, contaminated

    docs, items = edited_items(random.Random(4), sizes)
    sides = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_similarity(docs, items)
    assert len(want) > len(items)
    for s in (Settings(), Settings(broadcast_rows=0)):
        got = contaminated(*sides, s).collect()
        assert {(r.doc_id, r.item_id): (round(r.similarity, 6), r.start_word) for r in got} == want


def shared_windows(docs, length):
    """Words of each document in windows of `length` words that another document has too."""
    has = defaultdict(set)
    for d, text in docs:
        words = text.split()
        for i in range(len(words) - length + 1):
            has[tuple(words[i:i + length])].add(d)
    out = defaultdict(set)
    for d, text in docs:
        words = text.split()
        for i in range(len(words) - length + 1):
            if len(has[tuple(words[i:i + length])]) > 1:
                out[d] |= set(range(i, i + length))
    return dict(out)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_passages_repeated_in_one_document_and_among_variants(spark, partitions):
    import random

    from tests.llm.conftest import some_words
    from tillscope.llm.suffixes import repeated_passages

    rng = random.Random(8)
    line, block, footer, base = some_words(rng, 60), some_words(rng, 55), some_words(rng, 60), some_words(rng, 75).split()
    docs = [(0, " ".join([line] * 12)), (1, f"{some_words(rng, 9)} {line} {some_words(rng, 9)}"),
            (2, " ".join([f"{block} {footer}"] * 30)), (3, f"{some_words(rng, 9)} {block} {some_words(rng, 9)}")]
    # Parts of one passage, between words of their own: each pair shares another stretch of it.
    for i in range(150):
        a = rng.randint(0, 30)
        docs.append((10 + i, f"{some_words(rng, 12)} {' '.join(base[a:a + rng.randint(40, 60)])} {some_words(rng, 12)}"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = defaultdict(set)
    for r in got:
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.other_doc_id != r.doc_id
    assert found == shared_windows(docs, 50)


def test_toxic_words_are_learned_held_out(spark):
    from tillscope.llm.common import table
    from tillscope.llm.toxicity import op5

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    held = [r for r in op5(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum((r.predicted == 1) == (labels[r.doc_id] == 1) for r in held) / len(held) > 0.9  # forty positive labels


def test_pairs_weigh_more_than_their_parts():
    """Toxic only where both terms meet: the machine learns an interaction, not just two weights."""
    import numpy as np

    from tillscope.llm.toxicity import Settings, fit

    rows = [(np.array(sorted(x), np.int32), y) for x, y in (({1}, 0), ({2}, 0), ({1, 2}, 1), ({3}, 0))] * 60
    m = fit(rows, Settings(bits=5, epochs=40, rate=1.0))
    raw = lambda *x: m.raw(m.slots_of(np.array(x, np.int32)))
    assert raw(1, 2) > 0 > max(raw(1), raw(2), raw(3))
    assert raw(1, 2) - raw(1) - raw(2) + m.bias > 1


def test_languages_held_out(spark):
    from tillscope.llm.common import table
    from tillscope.llm.language import op9

    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, folder, "documents").select("doc_id", "lang").collect()}
    held = [r for r in op9(spark, folder).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.9


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np

    from tillscope.llm.language import MARK, UNKNOWN, Model, forward

    ids = {MARK: 1, MARK + "a": 2, "a": 3, "b": 4, "ab": 5, "bab": 6}
    p = np.array([[0], [0.1], [0.2], [0.15], [0.25], [0.2], [0.1]])
    for word in ("abab", "a", "abcb"):
        w, total = MARK + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            total += np.prod([p[ids[s]][0] if s in ids else UNKNOWN if len(s) == 1 else 0 for s in (w[a:b] for a, b in zip(at, at[1:]))])
        assert math.isclose(forward([word], Model(["x"], ids, p))[0, 0], math.log(total), rel_tol=1e-9)


def test_no_letters_is_und(spark, odd):
    got = by_id(result(spark, odd, 9))
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {74, 75, 76, 79}


def test_mix_meets_budgets(spark, odd):
    rows = result(spark, odd, 3)
    taken, budget, largest = Counter(), {}, Counter()
    for r in rows:
        leaf = (r.domain, r.lang, r.source)
        taken[leaf] += r.n_tokens
        budget[leaf] = r.leaf_budget
        largest[leaf] = max(largest[leaf], r.n_tokens)
    # A prefix passes its budget by less than its last document.
    assert all(budget[x] <= taken[x] < budget[x] + max(1, largest[x]) for x in taken)
    assert max(Counter((r.doc_id, r.epoch) for r in rows).values()) <= 2


def test_mix_matches_sql(spark):
    from tests.harness import compare, connect
    from tillscope.llm.registry import ORACLES

    folder = "/root/testdata/sf0.01"
    name = "op3_hierarchical_mix"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == []


def test_pipeline_stages(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, odd)
        assert docs.columns == columns, name
        after = Counter(r.doc_id for r in docs.select("doc_id").collect())
        assert set(after) <= before
        if name == "near_duplicates":
            assert before - set(after) == {61, 62, 63, 64, 65, 78} and max(after.values()) == 1
        if name == "decontamination":
            assert before - set(after) == {71, 72, 77}
    assert sorted(corpus_pipeline.STAGES[4][1](spark, docs, odd).columns) == sorted({*columns, "region", "rack", "slot"})


def test_native_stages_run_no_python(spark, odd):
    from tillscope.llm import decontaminate, mixing

    for op in (decontaminate.op8, mixing.op3):
        plan = op(spark, odd)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pairs_of_a_group_under_the_similarity_do_not_grow_with_its_square(spark):
    """Near copies with some changed words each: no two reach the similarity, and the bounds say so
    before the pairs are made."""
    import random

    from pyspark.sql import functions as F

    from tests.llm.conftest import some_words
    from tillscope.llm.jaccard import Settings, _products, columns_of, entries, frequent_grams, similar_groups, with_shared

    rng, s, made = random.Random(3), Settings(), []
    base = some_words(rng, 120).split()
    for size in (40, 80):
        rows = []
        for i in range(size):
            words = list(base)
            for j in rng.sample(range(10, 110), 4):
                words[j] = f"w{i}x{j}"
            rows.append((i, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        product = entries(docs, frequent_grams(docs, s), s).where("gram is not null")
        often = product.where("often").select("gram", "doc_id", "n", "place")
        totals = often.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
        columns = columns_of(product.where("not often")).unionByName(often.join(totals, "gram"))
        many = with_shared(columns, s)
        made.append(_products(many, many, "x.doc_id < y.doc_id", 1, s, True).count())
        assert {r.component_id for r in similar_groups(docs).collect()} == set(range(size))
        assert many.where(F.col("shared") > F.col("place")).count() == 0
    assert made[1] <= 2 * made[0] + size


def test_unconnected_pairs_enter_once(spark):
    """Pairs that share twenty entries enter by the first one if they are similar, else not at all; a
    doc_id with several sets loses none."""
    import numpy as np
    from pyspark.sql import functions as F

    from tillscope.llm.jaccard import SKETCH, Settings, entering, sketch, with_earlier

    rng, s, docs = np.random.default_rng(2), Settings(), 12
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for common, expected in ((97, docs * (docs - 1) // 2), (55, 0)):
        shared = draw(common)
        own = [sketch(np.concatenate([shared, draw(100 - common)])).tolist() for _ in range(docs)]
        many = spark.createDataFrame([(int(g >> np.uint64(1)), i, 100, p, p, 100, i) for i in range(docs) for p, g in enumerate(shared[:20])],
                                     "gram long, doc_id long, n int, place int, shared int, free long, label long")
        sketches = spark.createDataFrame([(i, *bits) for i, bits in enumerate(own)], "doc_id long" + "".join(f", {x} long" for x in SKETCH))
        assert entering(with_earlier(many, sketches, s), s).count() == expected
        one = sketches.where("doc_id > 0")
        found = entering(with_earlier(many, one, s), s).where("x.doc_id = 0 or y.doc_id = 0")
        pairs = found.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        assert pairs.distinct().count() == docs - 1


def test_texts_are_split_once_for_all_kinds_of_items(spark, tmp_path):
    """Items of both tile lengths and short ones are looked for in one pass over the texts."""
    import random

    from tests.llm.conftest import some_words
    from tillscope.llm.decontaminate import Settings, candidates, contaminated, prepared_items

    rng = random.Random(6)
    items = [(n, some_words(rng, n)) for n in (6, 15, 22, 23, 40, 63, 80)]
    # É is no letter that is lowered, and counts in texts of either kind.
    docs = [(i, f"{some_words(rng, 9 + i)} {text.upper() if i % 2 else text} {'É' if i % 3 else 'e'} {some_words(rng, 30)}") for i, text in items]
    docs.append((100, some_words(rng, 15) + " É" * 6))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sides = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([*items, (101, "é é é é é é")], "item_id long, text string")
    plan = candidates(sides[0], prepared_items(sides[1], Settings()), Settings())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert {(r.doc_id, r.item_id) for r in contaminated(*sides).collect()} == {(i, i) for i, _ in items}
