"""Exact and SimHash deduplication against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.llm.bktree import shard_links
from hushframe.llm.components import components
from hushframe.llm.exact_dedup import exact_dedup, exact_groups
from hushframe.llm.heavy import heavy_keys, merged
from hushframe.llm.simhash import block_masks, fingerprint, link_prints, near_groups, signed, simhash_dedup

SCHEMA = "doc_id bigint, text string, digest string, top string, component string, `a.b` array<int>"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "d", "t", "c", [1]) for i, t in docs], SCHEMA).repartition(3)


def closure(prints, radius):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ordered = sorted(prints)
    for i, x in enumerate(ordered):
        for y in ordered[:i]:
            if (x ^ y).bit_count() <= radius and find(x) != find(y):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {p: find(p) for p in prints}


def classes_of(links, prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {p: find(p) for p in prints}


def test_summaries_never_miss_a_heavy_key():
    rng = random.Random(1)
    keys = ["hot"] * 400 + [f"k{i}" for i in range(600)] + ["warm"] * 120
    rng.shuffle(keys)
    counts = {}
    for at in range(0, len(keys), 50):
        batch = {}
        for k in keys[at:at + 50]:
            batch[k] = batch.get(k, 0) + 1
        counts = merged(counts, batch, 10)
    assert {"hot", "warm"} <= set(counts) and len(counts) <= 10


def test_heavy_keys_are_verified(spark):
    df = spark.createDataFrame([("hot",)] * 50 + [(f"k{i}",) for i in range(100)] + [(None,)] * 9, "key string").repartition(5)
    assert [(r.key, r.n) for r in heavy_keys(df, "key", 8).collect()] == [("hot", 50)]
    assert heavy_keys(df.limit(0), "key", 8).count() == 0


@pytest.mark.parametrize("counters", [2, 256])
def test_exact_groups(spark, counters):
    docs = [(i, "hot") for i in range(40)] + [(100 + i, f"t{i % 7}") for i in range(20)] + [(200, None), (201, ""), (None, "hot"), (None, "x"), (39, "hot"), (300, " hot")]
    best, size = {}, {}
    for i, t in docs:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    df = frame(spark, docs)
    rows = exact_groups(df, counters=counters).collect()
    assert len(rows) == len(docs)
    by_digest = {r.digest: (r.keep_id, r.group_size) for r in rows}
    expected = {spark.range(1).select(F.sha2(F.lit(t), 256)).first()[0]: (b if b >= 0 else None, size[t]) for t, b in best.items()}
    assert by_digest == expected
    assert sorted(r.digest for r in rows if r.kept) == sorted(expected)  # one of each, ties too
    left = exact_dedup(df, counters=counters)
    assert left.columns == df.columns
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in left.collect()) == sorted(best.items())


def test_exact_dedup_of_nothing(spark):
    df = frame(spark, [])
    assert exact_groups(df).count() == exact_dedup(df).count() == 0


def test_fingerprint_votes():
    assert fingerprint(None) == fingerprint(" \t\n") == 0
    assert fingerprint("A b") == fingerprint("a\x0bB ") != fingerprint("b a")
    assert fingerprint("É a") != fingerprint("é a")  # A-Z only
    assert fingerprint("a b c d e") == fingerprint("A B C D E\n")


def test_fingerprint_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0] == signed(fingerprint("one two three four"))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for distinct in (10, 10**7, 10**10):
        masks = block_masks(distinct, 4)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_tree_links_join_what_pairs_join():
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    links = shard_links(prints, [], 4)
    assert classes_of(links, prints) == closure(prints, 4)
    assert len(links) < len(prints) and all((a ^ b).bit_count() <= 4 for a, b in links)


@pytest.mark.parametrize("block", [5, 50_000])
def test_links_of_shards(spark, block):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 1, 3, 2**64 - 1}
    for p in list(prints)[:30]:
        for _ in range(4):
            x = p
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    df = spark.createDataFrame([(signed(p),) for p in prints], "print bigint")
    links = [(r.u % 2**64, r.v % 2**64) for r in link_prints(df, 4, block).collect()]
    assert classes_of(links, prints) == closure(prints, 4)


@pytest.mark.parametrize("chunk", [500_000, 10])
def test_components(spark, chunk):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (200, 200)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), chunk).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 90 for i in (90, 95, 100)}, **{500 + i: 500 for i in range(40)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_groups(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9001, None), (9000, ""), (9002, " "), (None, rows[0][1]), (9003, rows[1][1])]
    prints = {i: fingerprint(t) for i, t in rows}
    roots = closure(set(prints.values()), 4)
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    got = near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.print % 2**64, r.component) for r in got} == {i: (p, least[roots[p]]) for i, p in prints.items()}
    left = simhash_dedup(frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted(least.values())
    assert left.columns == frame(spark, []).columns and simhash_dedup(frame(spark, [])).count() == 0
