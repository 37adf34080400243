"""Substring and suffix-array deduplication against brute force, and the sort they rest on."""

import os
import random

import pytest

from hushframe.llm import anchors
from hushframe.llm.substring_dedup import drop_repeats
from hushframe.llm.suffix_dedup import drop_repeated_bytes
from hushframe.llm.suffix_sort import common_prefix, deep_shallow


def brute_words(docs, window):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(docs, window):
    count = {}
    for _, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            count[b[k:k + window]] = count.get(b[k:k + window], 0) + 1
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if count[b[k:k + window]] > 1:
                gone[k:k + window] = [True] * window
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = word()
            parts.insert(rng.randrange(len(parts)), " ".join(p))
        docs.append((i * 3, "\n".join(parts)))
    docs += [(1000, docs[0][1]), (1001, None), (1002, ""), (1003, "a " * 300), (1004, "a " * 250), (1005, "ab cd " * 90)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id bigint, text string, key string, spots string").repartition(3)


@pytest.mark.parametrize("hot", [anchors.HOT, 1])
@pytest.mark.parametrize("window", [12, 50])
def test_words_match_brute_force(spark, window, hot):
    docs = corpus(window)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in drop_repeats(frame(spark, docs), window, hot=hot).collect()}
    assert got == brute_words(docs, window)


@pytest.mark.parametrize("hot", [anchors.HOT, 1])
@pytest.mark.parametrize("window", [60, 200])
def test_bytes_match_brute_force(spark, window, hot):
    docs = corpus(window) + [(0, "repeated id " * 3)]
    got = sorted(((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in drop_repeated_bytes(frame(spark, docs), window, hot=hot).collect()), key=repr)
    assert got == brute_bytes(docs, window)


def test_pieces_of_long_texts(spark, monkeypatch):
    """Texts above the size of a piece give what they give whole."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdef ", k=900))
    docs = [(i, "".join(rng.choices("abcdef ", k=1500)) + passage + "".join(rng.choices("abcdef ", k=700))) for i in range(4)]
    monkeypatch.setattr(anchors, "PIECE", 512)
    scheme = __import__("hushframe.llm.suffix_dedup", fromlist=["bytes_of"]).bytes_of(200)
    seen = [set(), set()]
    for size, out in zip((512, 1 << 19), seen):
        monkeypatch.setattr(anchors, "PIECE", size)
        for d, (_, t) in enumerate(docs):
            for r in anchors.runs([scheme.units(t.encode())], scheme):
                out.update((d, s) for s in range(r.first, r.last + 1))
    assert seen[0] == seen[1] == {(d, s) for d in range(4) for s in range(3100 - 199)}


def test_empty_and_nulls(spark):
    for f in (drop_repeats, drop_repeated_bytes):
        assert f(frame(spark, [])).count() == 0
        rows = f(frame(spark, [(None, None), (None, "w " * 120), (None, "w " * 120), (3, "w " * 120)])).collect()
        assert sorted(r.n_removed for r in rows) == ([0, 0, 120, 120] if f is drop_repeats else [0, 240, 240, 240])


def test_deep_shallow_orders_bytes():
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(300)]
    strings += [b"a" * 40 + s for s in strings[:150]] + strings[:40]
    order, shared = deep_shallow(strings)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    assert shared[1:] == [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(order, order[1:])]
    assert common_prefix(b"abc", b"abd") == 2
