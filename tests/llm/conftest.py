"""Small document folders for the tests of the subpackage."""

import itertools
import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for their own columns.
    T.StructField("score", T.StringType()), T.StructField("block", T.StringType()), T.StructField("shard", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("n", T.StringType()),
])
WORDS = [a + b + c for a, b, c in itertools.product("lmnrst", "aeiou", "bdgkp")]


def some_words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    """Nulls, empty and very long texts, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    texts = [some_words(rng, rng.randint(1, 120)) for _ in range(60)]
    base, passage, item = some_words(rng, 90), some_words(rng, 60), some_words(rng, 20)
    texts += [base] * 4 + [base.replace(base.split()[40], "changed", 1), base.upper()]
    texts += [f"{some_words(rng, 30)} {passage} {some_words(rng, 30)}" for _ in range(5)]
    texts += [f"{some_words(rng, 25)} {item} {some_words(rng, 9)}", item, some_words(rng, 20000)]
    texts += [None, "", "   \n", "one two", "one two", "1234 !!", "É" * 300, "you worthless scum " + some_words(rng, 20)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a1", "b2", None, "a1"][i % 4], None if t is None else len(t), "x", "y", "z", "l", "m")
            for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here", None, None, 10, "x", "y", "z", "l", "m")], item


def vectors():
    """Short vectors of eighths with copies, NULL, non-finite and unfit ones: (vec_id, embedding, label, n)."""
    rng = random.Random(8)
    points = [[rng.randint(-40, 40) / 8 + 0.001 * j for j in range(6)] for _ in range(70)]
    points += [points[3]] * 9
    rows = [(i, p, i % 3, "x") for i, p in enumerate(points)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [nan] * 6, [0.0, inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [1e30] * 6]
    return [*rows, *((100 + i, v, 1, "x") for i, v in enumerate(odd)), rows[5], (None, points[7], 1, "x")]


def conversations():
    """(conv_id, turn, role, text, depth): copies, NULLs, ties, gaps, missing and negative ids, a long one."""
    rng = random.Random(4)
    say = ["hello", "what is it", "an answer", "", "É", "thanks"]
    rows = []
    for c in [*range(40), 53, 54, 61, -3, -10]:
        rows += [(c, t, "user" if t % 2 else "bot", say[rng.randint(0, 3 if t < 4 else 5)], "x") for t in range(rng.randint(1, 12))]
    for c in (70, 71, 72, 75, 76):
        rows += [(c, t, "user", f"step {t // 2}", "x") for t in range(30 + c % 2)]
    rows += [(80, t, "user", "z" * t, "x") for t in range(60)]
    rows += [(90, None, None, None, "x"), (90, 3, "bot", None, "x"), (90, 3, "bot", "b", "x"), (90, 3, "bot", "b", "x"), (None, 1, "user", "nobody", "x")]
    return rows


def pages():
    """(page_id, url, html, text): two sites with a template each that nothing names, copies, odd pages."""
    rng = random.Random(6)
    rows = []
    for i in range(30):
        site = "http://One.example/a" if i % 2 else "https://two.example:80/b?x"
        body = "".join(f"<p>{some_words(rng, 12)}.</p>" for _ in range(3))
        quoted = "<p>A line that many articles quote, word for word.</p>" if i % 5 < 2 else ""
        rows.append((i, f"{site}{i}", f"<html><body><div class=menu>Menu {i}</div><article><h1>Page {i}</h1>{body}{quoted}"
                     f"<div>Read our <a href=/x{i}>magazine &amp; more</a></div><p>All rights of this site.</p></article><footer>f</footer></body></html>", "x"))
    rows += [(100 + i, "http://one.example/copy", "<article><p>Copied once.</p><div>and <i>again</i></div></article>", "x") for i in range(12)]
    rows += [(200, None, None, "x"), (201, "http://one.example/", "", "x"), (202, "no url", "plain &lt;text", "x"), (None, "http://one.example/n", "<p>a<p>b<nav>c", "x")]
    return [*rows, rows[0]]


def write_others(spark, folder, vectors, conversations, pages):
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, n string").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string, depth string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def write(spark, folder, rows, items, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    rows, item = documents()
    labels = [(i, 1, int("worthless" in (r[1] or ""))) for i, r in enumerate(rows[:80])] + [(None, 1, None), (500, 1, 1)]
    items = [(0, item), (1, item), (2, None), (3, ""), (4, "one two")]
    folder = write(spark, tmp_path_factory.mktemp("odd") / "t", rows, items, labels)
    return write_others(spark, folder, vectors(), conversations(), pages())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write_others(spark, write(spark, tmp_path_factory.mktemp("empty") / "t", [], [], []), [], [], [])
