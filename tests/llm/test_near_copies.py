"""Near copies by whole sets of shingles, and SimHash classes by row, against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from hushframe.llm import minhash
from hushframe.llm.near_copies import near_dedup
from hushframe.llm.shingle_sets import Cluster, prefix_length, shingles
from hushframe.llm.simhash import fingerprint, simhash_dedup

SCHEMA = "doc_id bigint, text string, root string, row string, id int, `a.b` array<int>"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "r", "w", k, [k]) for k, (i, t) in enumerate(docs)], SCHEMA).repartition(5)


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def likeness(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a or "", b or ""))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def classes(texts, alike):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            if find(a) != find(b) and alike(texts[a], texts[b]):
                root[find(a)] = find(b)
    return [find(x) for x in range(len(texts))]


def fixture():
    """Near copies at 0.80, 0.90 and 0.95 and just below 0.80, a common passage, null and repeated ids, chains."""
    rng = random.Random(7)
    docs, common = [], words_of(rng, 12)
    for k in range(12):
        base = words_of(rng, 364) + common  # 372 shingles
        docs.append((10 * k if k % 4 else None, " ".join(base)))
        for j, new in enumerate((42, 20, 9, 46)):  # of 372 + new shingles 372 - new are shared: just above 0.79, 0.89, 0.95; below 0.78
            changed = base[:len(base) - new] + words_of(rng, new)
            docs.append((10 * k + j + 1 if (k + j) % 5 else None, " ".join(changed)))
    for k in range(8):
        base = words_of(rng, 364)  # 360 shingles, 320 of them in both of 400: 0.80 exactly
        docs += [(300 + k, " ".join(base)), (400 + k, " ".join(words_of(rng, 40) + base[40:]))]
    docs += [(7, " ".join(words_of(rng, 30))), (7, " ".join(words_of(rng, 30))), (None, "a b c"), (None, "A b  C"), (None, None), (900, " "), (None, "lone text"), (901, "x")]
    chain = words_of(rng, 104)
    for k in range(10):  # each is alike to the next one only
        docs.append((500 - k, " ".join(chain[6 * k:] + words_of(rng, 6 * k))))
    hot = words_of(rng, 80)
    docs += [(600 + k, " ".join(hot[:k % 70] + words_of(rng, 2) + hot[k % 70:])) for k in range(40)]
    return docs


def brute(docs, alike):
    roots, best = classes([t for _, t in docs], alike), {}
    for k, (i, _) in enumerate(docs):
        best.setdefault(roots[k], []).append((i is None, i))
    kept = {r: min(x)[1] for r, x in best.items() if not min(x)[0]}
    return roots, kept


def holds(docs, rows, roots, kept):
    """One row of each class, the one with its smallest id; any of the rows where all ids of the class are null."""
    got = [r.id for r in rows]
    assert sorted(roots[k] for k in got) == sorted(set(roots))
    assert all(docs[k][0] == kept.get(roots[k]) for k in got)


@pytest.mark.parametrize("block", [24_000_000, 6_000])
def test_stage_keeps_one_row_of_each_class_of_alike_texts(spark, block):
    docs = fixture()
    values = sorted(likeness(a, b) for k, (_, a) in enumerate(docs) for _, b in docs[:k])
    assert 0.8 in values and any(0.75 < v < 0.8 for v in values) and any(0.8 < v < 0.85 for v in values)
    roots, kept = brute(docs, lambda a, b: likeness(a, b) >= 0.8)
    assert 20 < len(set(roots)) < len(docs)
    df = frame(spark, docs)
    left = near_dedup(df, block=block)
    assert left.columns == df.columns
    holds(docs, left.collect(), roots, kept)
    assert near_dedup(df.limit(0)).count() == 0


def test_pipeline_near_stage_against_brute_force(spark, sf):
    docs = fixture()
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    holds(docs, stage(spark, frame(spark, docs), sf).collect(), *brute(docs, lambda a, b: likeness(a, b) >= 0.8))


def test_fingerprints_find_candidates_and_whole_sets_decide(spark, sf, monkeypatch):
    """Without candidates from signatures the near stage joins what fingerprints within four bits link, if it is alike."""
    monkeypatch.setattr(minhash, "candidate_links", lambda *a: spark.createDataFrame([], "u bigint, v bigint"))
    rng, texts = random.Random(11), []
    for _ in range(12):
        base = words_of(rng, 300)
        texts += [base, base[:-1] + words_of(rng, 1), base[:-12] + words_of(rng, 12)]
    line = words_of(rng, 20)
    texts += [line * 200 + words_of(rng, 20), line * 200 + words_of(rng, 20), line * 200]  # 0.5 and less, within four bits
    texts += [line[:8], line[:8], words_of(rng, 2)]
    docs = [(1000 - k, " ".join(t)) for k, t in enumerate(texts)]
    bits = lambda a, b: (fingerprint(a) ^ fingerprint(b)).bit_count()
    pairs = [(bits(a, b), likeness(a, b)) for k, (_, a) in enumerate(docs) for _, b in docs[:k]]
    assert any(0 < d <= 4 and x >= 0.8 for d, x in pairs) and any(d <= 4 and x < 0.8 for d, x in pairs) and any(d > 4 and x >= 0.8 for d, x in pairs)
    roots, kept = brute(docs, lambda a, b: bits(a, b) <= 4 and likeness(a, b) >= 0.8)
    assert len(set(roots)) < len(docs) - 5
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    holds(docs, stage(spark, frame(spark, docs), sf).collect(), roots, kept)


def test_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sets = {t: set(shingles(t).tolist()) for _, t in docs}
    roots, kept = brute(docs, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    holds(docs, near_dedup(frame(spark, docs)).collect(), roots, kept)


@pytest.mark.parametrize("members", [1.0, 0.5])
def test_cluster_links_are_the_classes_of_all_pairs(members):
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.8:  # sets that share much, on both sides of 0.8
            s = sets[rng.integers(len(sets))]
            s = np.concatenate([rng.permutation(s)[rng.integers(0, len(s) // 6 + 1):], rng.integers(0, 10**9, rng.integers(0, 6))])
        else:
            s = rng.integers(0, 10**9, rng.integers(1, 60))
        sets.append(np.unique(s.astype(np.uint64)))
    first = int(len(sets) * members)
    cluster = Cluster(0.8)
    for k, s in enumerate(sets):
        (cluster.add if k < first else cluster.ask)(k, s)
    alike = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) and (a < first or b < first)
    links = set(cluster.found())
    assert all(alike(a, b) for a, b in links)
    same = lambda roots: [[roots[a] == roots[b] for b in range(a)] for a in range(len(roots))]
    every = range(len(sets))
    assert same(classes(every, alike)) == same(classes(every, lambda a, b: (a, b) in links))


def test_prefix_always_meets():
    assert [prefix_length(n, 0.8) for n in (1, 4, 5, 10, 11)] == [1, 1, 2, 3, 3]


def test_simhash_dedup_decides_by_row(spark):
    rng = random.Random(3)
    docs = [(None, " ".join(words_of(rng, 60))) for _ in range(20)]  # a third without an id, all different
    docs += [(k, " ".join(words_of(rng, 60))) for k in range(30)]
    docs += [(5, " ".join(words_of(rng, 60))), (40, docs[20][1]), (40, " ".join(words_of(rng, 60))), (None, docs[0][1]), (None, docs[21][1])]
    roots, kept = brute(docs, lambda a, b: (fingerprint(a) ^ fingerprint(b)).bit_count() <= 4)
    assert len(set(roots)) == 52
    holds(docs, simhash_dedup(frame(spark, docs)).collect(), roots, kept)
