"""Fingerprints: reused parts of an edited text, task borders, and the definition by brute force."""

import hashlib
import random

import numpy as np
import pytest

from tillscope.llm import digest as d

INFO = d.information(np.random.default_rng(1).integers(0, 100, d.PAIRS))


def some_text(rng):
    return "".join(rng.choice("abcdé fgh") for _ in range(rng.choice([0, 3, 17, 60, 200, 900])))


def brute_features(text):
    """The rarest of each stretch of windows, one by one."""
    if len(text) <= d.WINDOW:
        return [text] if text else []
    windows = [text[i:i + d.WINDOW] for i in range(len(text) - d.WINDOW + 1)]
    rarity = [sum(int(INFO[a * 256 + b]) for a, b in zip(w, w[1:])) for w in windows]
    width = min(d.STRETCH, len(windows))
    places = {max(range(i, i + width), key=lambda p: (rarity[p], -p)) for i in range(len(windows) - width + 1)}
    return list(dict.fromkeys(windows[p] for p in sorted(places)))


def test_features_are_the_rarest_of_each_stretch():
    rng = random.Random(3)
    for _ in range(60):
        text = some_text(rng).encode()
        assert list(d.features(text, INFO)) == brute_features(text)


def test_features_of_an_edited_text_are_those_of_the_whole():
    rng = random.Random(4)
    for _ in range(400):
        a, b = some_text(rng), some_text(rng)
        cut = len(a) // 4
        begin = a[:len(a) - cut].encode()
        edited = begin + b[:cut].encode()
        assert list(d.features_after_edit(d.features(a.encode(), INFO), edited, len(begin), INFO)) == list(d.features(edited, INFO))


def test_a_feature_far_in_a_long_text_is_found():
    text = b"ab" * (9 << 20) + b"rare window here" + b"ab" * 40
    assert any(b"rare" in f for f in d.features(text, INFO))


@pytest.mark.parametrize("parts", [1, 7, 400])
def test_rows_at_the_borders_of_tasks_meet_their_next(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 3, some_text(rng)) for i in range(150)] + [(None, "first of all"), (9, "a second row"), (12, None)]
    rng.shuffle(rows)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = d.compare(spark.createDataFrame(rows, "doc_id long, text string"), INFO).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    ids = {i for i, _ in rows if [r[0] for r in rows].count(i) == 1}
    assert len(got) == len(rows)
    order = sorted(((i is not None, i or 0), t or "") for i, t in rows)
    answers = {r.doc_id: r for r in got}
    for n, ((known, i), text) in enumerate(order):
        (_, after), following = order[(n + 1) % len(order)]
        i = i if known else None
        if i in ids and after in ids:
            cut = len(text) // 4
            edited = text[:len(text) - cut] + following[:cut]
            r = answers[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            chains = [d.digest(d.features(t.encode(), INFO), d.Probes()) for t in (text, edited, following)]
            assert (r.fingerprint, r.edited_fingerprint) == (d.as_text(chains[0]), d.as_text(chains[1]))
            assert (r.near_edited, r.near_next) == (d.likeness(chains[0], chains[1]), d.likeness(chains[0], chains[2]))
