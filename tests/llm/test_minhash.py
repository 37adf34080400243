"""MinHash near-duplicates: the pigeonhole guarantee, classes against brute force, undefined-looking rows."""

import random

import numpy as np
import pytest

from hushframe.llm import minhash
from hushframe.llm.minhash import chunk_keys, chunks_of, hash_functions, member_links, near_classes, radius_of, signature
from tests.llm.test_near_copies import classes, likeness, words_of

SCHEMA = "doc_id bigint, text string, root string, n int, `a.b` int, `key` string, `set` string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "r", k, k, "x", "y") for k, (i, t) in enumerate(docs)], SCHEMA).repartition(5)


def expected(docs, least=0.85):
    worded = lambda t: bool((t or "").split())
    apart = {ord("Ä"): "1"}  # only A-Z are lower-cased
    roots = classes([(t or "").translate(apart) for _, t in docs], lambda a, b: worded(a) and worded(b) and likeness(a, b) >= least)
    smallest = {}
    for (i, _), r in zip(docs, roots):
        smallest[r] = min(x for x in (smallest.get(r), i) if x is not None) if (smallest.get(r), i) != (None, None) else None
    return [(i, smallest[r]) for (i, _), r in zip(docs, roots)]


def fixture():
    rng = random.Random(11)
    docs = []
    for k in range(15):
        base = words_of(rng, 304)  # 300 shingles
        docs.append((100 * k, " ".join(base)))
        for j, new in enumerate((24, 25, 10, 40)):  # 276 of 324 shared: 0.85 and more; 275 of 325: below
            docs.append((100 * k + j + 1, " ".join(base[:304 - new] + words_of(rng, new))))
    chain = words_of(rng, 104)
    docs += [(2000 - k, " ".join(chain[5 * k:] + words_of(rng, 5 * k))) for k in range(8)]
    hot = words_of(rng, 90)
    docs += [(3000 + k, " ".join(hot[:k] + words_of(rng, 1) + hot[k:])) for k in range(60)]
    same = " ".join(words_of(rng, 50))
    docs += [(7, same), (7, same), (None, same), (None, "null id"), (None, "Null  ID"), (8, ""), (9, None), (10, " \t"), (11, "a b"), (12, "A B"), (13, "ä b"), (14, "Ä b")]
    docs += [(15, "word " * 3000), (16, "word " * 2000)]
    return docs


def test_pairs_at_the_threshold_are_in_the_fixture():
    docs = fixture()
    values = {round(likeness(docs[0][1], docs[j][1]), 4) for j in (1, 2)}
    assert min(values) < 0.85 <= max(values)


@pytest.mark.parametrize("part,block", [(minhash.PART, minhash.BLOCK), (7, 3_000)])
def test_classes_against_brute_force(spark, part, block):
    docs = fixture()
    got = near_classes(frame(spark, docs), part=part, block=block).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((r.id, r.component) for r in got), key=key) == sorted(expected(docs), key=key)
    assert all(r.kept == (r.id == r.component) for r in got)
    sizes = {i: len({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))}) if (w := (t or "").lower().split()) else 0 for i, t in docs if i is not None}
    assert all(r.n == sizes[r.id] for r in got if r.id is not None)


def test_empty_table(spark):
    assert near_classes(frame(spark, fixture()[:1]).limit(0)).count() == 0


def test_signatures_within_the_radius_share_a_key():
    rng = np.random.default_rng(2)
    for positions, least in ((65, 0.85), (65, 0.8), (20, 0.9)):
        radius = radius_of(positions, least)
        chunks = chunks_of(positions, radius)
        assert sorted(p for c in chunks for p in c) == list(range(positions))
        one = rng.integers(0, 2**16, (300, positions)).astype("<u2")
        two = one.copy()
        for row in two:
            row[rng.permutation(positions)[:radius]] += 1
        a, b = chunk_keys(one, chunks), chunk_keys(two, chunks)
        assert (a == b).any(axis=1).all()
        assert not (chunk_keys(one, chunks) == chunk_keys(rng.integers(0, 2**16, one.shape).astype("<u2"), chunks)).any()


def test_radius_holds_the_promised_share():
    rng = np.random.default_rng(3)
    functions = hash_functions(65, 42)
    radius, over = radius_of(65, 0.85), 0
    distances = []
    for _ in range(400):
        s = rng.integers(0, 2**63, 460).astype(np.uint64)
        a, b = signature(s[:425], functions), signature(s[35:], functions)  # 390 of 460 are shared
        distances.append(int((a != b).sum()))
        over += distances[-1] > radius
    assert over == 0 and abs(np.mean(distances) - 65 * 70 / 460) < 0.5
    # the binomial bound itself
    assert (rng.random((200_000, 65)) < 0.15).sum(axis=1).max() <= radius


def test_member_links_give_the_classes_of_all_pairs():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 3, (120, 20)).astype("<u2")
    prints[40:80] = prints[0]
    prints[np.arange(40, 80), rng.integers(0, 20, 40)] += 5
    nodes, radius = np.arange(120) * 10, 8
    links = member_links(nodes[:90], prints[:90], nodes[90:], prints[90:], radius)
    near = lambda a, b: (prints[a] != prints[b]).sum() <= radius and min(a, b) < 90
    assert all(near(u // 10, v // 10) for u, v in links) and len(links) < 250
    every = list(range(120))
    pairs = {(u // 10, v // 10) for u, v in links} | {(v // 10, u // 10) for u, v in links}
    mine, all_ = classes(every, lambda a, b: (a, b) in pairs), classes(every, near)
    assert [[mine[a] == mine[b] for b in range(a)] for a in every] == [[all_[a] == all_[b] for b in range(a)] for a in every]


def test_candidates_do_not_grow_faster_than_documents(spark, tmp_path):
    """Unrelated texts with a few common passages give no candidates at any size; near copies a fixed number each."""
    rng = random.Random(5)
    passages = [" ".join(words_of(rng, 12)) for _ in range(6)]
    for n in (200, 400, 800):
        docs = []
        for k in range(n // 2):
            words = words_of(rng, 120)
            docs += [(2 * k, " ".join([*words, passages[k % 6]])), (2 * k + 1, " ".join([*words[:116], *words_of(rng, 4), passages[k % 6]]))]
        sets = minhash.signed_sets(frame(spark, docs), 5, 65, 42, "text", "doc_id").selectExpr("monotonically_increasing_id() as node", "signature")
        stored = minhash.written(sets, "test-sets")
        links = minhash.candidate_links(stored, 0.8, 65, minhash.written)
        assert n // 2 <= links.count() <= n
