"""Cross-tokenizer alignment against the tokenizers themselves and a plain walk over shared ends."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hushframe.llm.alignment import align_documents, shared_cuts

TEXTS = ["plain words of a text", "two  spaces", " leading", "trailing ", "", None, "日本語のテキスト 😀 é", "a\nb\tc", "<s> a </s> <|endoftext|> z", "▁x", "aaaaaaaa" * 300,
         "x", "naïve café—“quoted”", "the the the", "ﬁne", "plain words of a text", "1234567890 3.14", "é", "Ünï" * 50, "<0x41>"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_alphabet():
    """The byte-level alphabet by its rule: printable bytes are themselves, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(text, a, b):
    """Ids of both sides and groups, by walking over the tokens' ends."""
    alphabet = byte_alphabet()
    if not text:
        return [], [], []
    x = a.encode(" " + text, add_special_tokens=False)
    y = b.encode(text)
    left = [bytes(alphabet[c] for c in t) for t in x.tokens]
    pieces = [b.id_to_piece(i) for i in y]
    right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(y, pieces)]
    whole = (" " + text).encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return [], [], []
    groups, i, j, at, bt = [([], [])], 0, 0, 0, 0
    while i < len(left) or j < len(right):
        if at <= bt and i < len(left):
            groups[-1][0].append(x.ids[i])
            at, i = at + len(left[i]), i + 1
        else:
            groups[-1][1].append(y[j])
            bt, j = bt + len(right[j]), j + 1
        if at == bt:
            groups.append(([], []))
    return x.ids, y, groups[:-1]


def brute(texts, a, b):
    found = [plain(t, a, b) for t in texts]
    links = [[(g[0][-1], g[1][-1]) for g in groups] for _, _, groups in found]
    counts = Counter(p for pairs in links for p in pairs)
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (x, y, groups), pairs in zip(found, links):
        written = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(x), len(y), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "p", 0, 0) for i, t in docs], "doc_id bigint, text string, pairs string, row int, `a.b` int").repartition(4)


@pytest.mark.parametrize("frequent", [1 << 16, 3, 0])
def test_against_a_plain_walk(spark, encoders, frequent):
    docs = [(k if k % 3 else None, t) for k, t in enumerate(TEXTS)] + [(1, TEXTS[1])]
    got = align_documents(frame(spark, docs), frequent=frequent, with_groups=True)
    want = sorted(zip([str(i) for i, _ in docs], brute([t for _, t in docs], *encoders)))
    rows = got.collect()
    assert sorted((str(r.id), tuple(r[c] for c in COLUMNS)) for r in rows) == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows if r.groups)
    assert sum(r.n_a == 0 for r in rows) >= 3 and any(r.n_groups < min(r.n_a, r.n_b) for r in rows)


def test_given_documents(spark, sf, encoders):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in align_documents(frame(spark, docs)).collect()}
    assert got == dict(zip([i for i, _ in docs], brute([t for _, t in docs], *encoders)))


def test_empty_table(spark):
    assert align_documents(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_cuts_of_random_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        spans, a, b, base = [], [], [], 0
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(1, 60))
            x, y = (sorted({*rng.integers(1, n + 1, rng.integers(0, n + 1)).tolist(), n}) for _ in range(2))
            spans.append((len(a), len(a) + len(x), len(b), len(b) + len(y)))
            a, b, base = a + [base + e for e in x], b + [base + e for e in y], base + n
        got = shared_cuts(np.array(a), np.array(b), np.array(spans))
        assert [a[g[1] - 1] for g in got] == sorted(set(a) & set(b)) == [b[g[3] - 1] for g in got]
        assert got[0][0] == got[0][2] == 0 and (got[1:, 0] == got[:-1, 1]).all() and (got[1:, 2] == got[:-1, 3]).all()


def test_no_shared_end_inside(spark):
    a, b = np.array([*range(2, 4000, 2), 4000]), np.array([*range(3, 3999, 2), 4000])
    assert len(shared_cuts(a, b, np.array([[0, len(a), 0, len(b)]]))) == 1
