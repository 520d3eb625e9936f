"""Whitening, the trie of conversations and the text of pages against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import conversations, pages, vectors
from tillscope.llm.markup import Page
from tillscope.llm.registry import QUERIES
from tillscope.llm.site_templates import main_text
from tillscope.llm.turn_trie import conversation_trie
from tillscope.llm.whitening import whiten


def fixed(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def test_whitening_against_numpy(spark, odd):
    rows = [(i, fixed(v)) for i, v, *_ in vectors() if v and len(v) == 6 and all(c is not None and abs(c) < 1e9 for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov((fit - sums / n).T, bias=True)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    got = defaultdict(list)
    for r in QUERIES["op11_block_whitening"](spark, odd).collect():
        got[r.vec_id, r.component].append(r)
    assert Counter({k: len(g) for k, g in got.items()}) == Counter((i, c) for i, _ in rows for c in range(1, 7))
    signs = {}
    for i, x in rows:
        for c in range(6):
            r = got[i, c + 1][0]
            want = float((np.array(x) - sums / n) @ axes[:, c] / math.sqrt(values[c]))
            if abs(want) > 1e-6:
                signs.setdefault(c, math.copysign(1, want * r.whitened))
            assert math.isclose(r.whitened, signs.get(c, 1) * want, abs_tol=1e-8)
            assert r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)) and r.n == n
            assert math.isclose(r.explained, values[c] / values.sum(), rel_tol=1e-9) and 0 <= r.identity_error < 1e-9


def test_whitening_of_many_blocks_is_the_same(spark, odd, monkeypatch):
    from tillscope.llm import whitening

    few = {(r.vec_id, r.component): r.whitened for r in QUERIES["op11_block_whitening"](spark, odd).collect()}
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    for r in whiten(spark.read.parquet(f"{odd}/embeddings.parquet")).collect():
        assert math.isclose(r.whitened, few[r.vec_id, r.component], abs_tol=1e-8)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None), (2, [])]])
def test_whitening_without_variance_has_no_rows(spark, rows):
    assert whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_leaves_out_flat_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1} and math.isclose(got[0].explained, 1)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i % 2) * 2**40, float(i)]) for i in range(300)]
    assert {r.deviation for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == {None}


def nodes(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((t is not None, t or 0, tie), (role, text)))
    turns = {c: [turn for _, turn in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                children[tuple(s[:d - 1])].add(tuple(s[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def test_trie_against_brute_force(spark, odd):
    assert sorted(map(tuple, QUERIES["op12_turn_trie"](spark, odd).collect())) == nodes(conversations())


@pytest.mark.parametrize("width,shard_rows", [(4, 3), (7, 1), (16, 1000)])
def test_trie_in_small_shards_and_rounds(spark, odd, width, shard_rows):
    got = conversation_trie(spark.read.parquet(f"{odd}/conversations.parquet"), width, shard_rows)
    assert sorted(map(tuple, got.collect())) == nodes(conversations())


def test_trie_of_a_conversation_that_most_copy(spark):
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(300) for t in range(9)]
    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 4, 11)
    assert sorted(map(tuple, got.collect())) == nodes(rows)


def test_long_conversations_are_numbered_in_slices(spark, monkeypatch):
    from tillscope.llm import turn_trie

    monkeypatch.setattr(turn_trie, "SLICE", 8)
    rows = [(5, t, "u", f"turn {t}") for t in range(100)] + [(5, None, "u", "first"), (6, -20, "u", "a"), (6, 99, "u", "b")]
    got = conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 16)
    assert sorted(map(tuple, got.collect())) == nodes(rows)


def test_pages_of_two_sites(spark, odd):
    got = defaultdict(list)
    for r in QUERIES["op13_site_templates"](spark, odd).collect():
        got[r.page_id].append((r.url, r.text, r.n_chars))
    assert Counter({k: len(v) for k, v in got.items()}) == Counter(p[0] for p in pages())
    for i, url, html, _ in pages():
        own, text, n = got[i][0]
        assert own == url and n == len(text) and len(set(got[i])) == 1
        if i is not None and i < 100:
            want = [f"Page {i}", *(p for p in Page(html).text().split("\n")[1:4])]
            if i % 5 < 2:  # on less than half of the site's pages, so it stays
                want.append("A line that many articles quote, word for word.")
            assert text.split("\n") == want
    assert [got[100 + i][0][1] for i in range(12)] == ["Copied once.\nand again"] * 12
    assert [got[k][0][1] for k in (200, 201, 202, None)] == ["", "", "plain <text", "a\nb"]


def test_templates_need_their_number_of_pages(spark, odd):
    table = spark.read.parquet(f"{odd}/pages.parquet")
    everything = {r.page_id: r.text for r in main_text(table, least_pages=10**6).collect()}
    assert everything[1].split("\n")[-2:] == ["Read our magazine & more", "All rights of this site."]


@pytest.mark.parametrize("html,text", [
    ("<header><h1>Site</h1></header><article class='post with-comments'><header><h1>A &amp; b</h1><i>by X</i></header><p>One <b>bold<p>two&nbsp;x<br>y</article>",
     "A & b\nOne bold\ntwo x y"),
    ("<body class=has-sidebar><form><main><p>kept</p><form>gone</form><aside>x</aside></main></form>", "kept"),
    ("<article><ul><li>a<li>b <span class='ad'>buy</span> c</ul><div id='commentList'>no</div><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb c\n1\n2\n3"),
    ("<article></article><article><p>second</p><article class=comment><p>nice</article></article><p>outside</p>", "second"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>x</p> --><p>only", "only"),
    ("<div role=navigation>m</div><div role=main>t &eacute;&#233;&amp</div>", "t éé&"),
    ("a < b <a title='x>y'>z</a>", "a < b z"),
    ("<p>a</p>b<p>c", "a\nb\nc"),
    ("<div class='cookie-notice'>we use</div><div class='notice'><article><p>text</p></article></div>", "text"),
    ("<article><div class=article-header><h2>T</h2><p>byline</p></div><p>x", "T\nx"),
])
def test_parts_of_a_page(html, text):
    assert Page(html).text() == text


def test_a_very_long_page_is_read_whole():
    body = "".join(f"<p>word {i} &amp; <b>more</b></p>" for i in range(30_000))
    text = Page(f"<article>{body}</article>").text()
    assert text.count("\n") == 29_999 and text.endswith("word 29999 & more")
