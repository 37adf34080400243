"""Packing: validity, exact round trip of ids, few bins.  Mixing: targets by iteration, sums, bounds."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hushframe.llm.mixing import mix_documents, mixed, water_filling
from hushframe.llm.packing import Capacity, best_fit, cut_points, encoder, pack_documents

TEXTS = ["", "hello world", "a<|endoftext|>b", "  x\n\ny", "é" * 50, "It's 3 o'clock!!", "中文 mixed \U0001f600"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(spark, sf, tokenizer):
    encode = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    assert [encode(t).tolist() for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_cut_points():
    assert cut_points(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert cut_points(1024, 1024) == [(0, 1024)] and cut_points(1, 1024) == [(0, 1)] and cut_points(0, 1024) == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(), Capacity(1024, 3, 500_000)])
def test_best_fit_keeps_every_capacity(rule, capacity):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 700, 3000))[::-1]
    bins = best_fit(lengths, capacity, rule, (1.0, 0.5, 0.5))
    n = bins.max() + 1
    assert sorted(set(bins)) == list(range(n))
    assert np.bincount(bins, lengths).max() <= capacity.tokens and np.bincount(bins).max() <= capacity.documents
    assert np.bincount(bins, lengths.astype(float) ** 2).max() <= capacity.cost
    bound = max(lengths.sum() / capacity.tokens, len(lengths) / capacity.documents, (lengths.astype(float) ** 2).sum() / capacity.cost)
    assert n <= (1.05 if capacity == Capacity() else 1.25) * bound + 2  # several capacities that bind cost more than any one alone


def test_best_fit_matches_plain_best_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 1025, 800))[::-1]
    left = []
    for x in lengths.tolist():
        fits = [i for i, r in enumerate(left) if r >= x]
        if fits:
            left[min(fits, key=lambda i: (left[i], i))] -= x
        else:
            left.append(1024 - x)
    assert best_fit(lengths, Capacity()).max() + 1 == len(left)


def test_round_trip(spark, tokenizer):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "word " * 3000), (None, None), (50, "word " * 3000), (51, "tail")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, piece int, row int").repartition(3)
    rows = pack_documents(df, with_ids=True).collect()
    whole = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert sum(r.length for r in rows) == sum(len(whole(t)) for _, t in docs)
    by_id = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
        by_id.setdefault((r.id, r.piece), r.ids)
    for i, t in docs:
        joined = [x for (k, _), ids in sorted(by_id.items(), key=lambda x: (x[0][0] is None, x[0])) if k == i for x in ids]
        assert joined == whole(t)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    assert len(places) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert pack_documents(df.limit(0)).count() == 0


def by_rounds(sizes, weights, share, epochs):
    """Water-filling as it is told: clamp, share the excess out again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, clamped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in clamped]
        level = (budget - sum(clamped.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if level * weight[s] > epochs * sizes[s]]
        if not above:
            return {**clamped, **{s: level * weight[s] for s in rest}}
        clamped.update({s: epochs * sizes[s] for s in above})


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 400, "é": 30, None: 77}, {"x": 5}, {"a": 0, "b": 9}, {str(i): (i * 37) % 101 for i in range(40)}])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in water_filling(df, [5, 2, 1], 1.5, 2.0).collect()}
    assert got == pytest.approx(by_rounds(sizes, [5, 2, 1], 1.5, 2.0))


def test_mix_meets_its_targets(spark):
    docs = [(i, f"s{i % 3}" if i % 11 else None, "w " * (i % 40), 0, "k") for i in range(900)] + [(None, "s0", None, 0, "k"), (5, "s0", "w w", 0, "k"), (5, "s0", "w w", 0, "k")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, size int, key string").repartition(4)
    rows = mixed(df).collect()
    assert len(rows) == len(docs) and all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = mixed(df.repartition(7))
    assert sorted((str(r.id), r.size, r.taken) for r in again.collect()) == sorted((str(r.id), r.size, r.taken) for r in rows)
    out = mix_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert all(abs(words[s] - target[s]) <= 120 for s in target)  # rows of a repeated id, and one whole document, more
    assert mixed(df.limit(0)).count() == mix_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("id", [None, 7])
def test_rows_without_an_id_of_their_own_do_not_overshoot(spark, id):
    docs = [(id, "s", f"w{i} " + "w " * 9, i) for i in range(600)] + [(i, "t", "w " * 10, i) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, row int").repartition(4)
    out = mix_documents(df)
    assert out.columns == df.columns
    target = {r.source: r.target for r in mixed(df).select("source", "target").distinct().collect()}
    words, times = {}, {}
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        times[r.source, r.row] = times.get((r.source, r.row), 0) + 1
    assert all(0 <= words[s] - target[s] <= 10 for s in target)
    assert {n for (s, _), n in times.items() if s == "t"} <= {1, 2}
