"""Cross-tokenizer alignment by divide and conquer at shared cuts.

A text is encoded by two tokenizers.  The byte offsets where tokens of both end are its cuts; between two neighbouring
cuts lies a group of tokens of both.  An interval is split at a shared end near its middle: the end of A's middle token
is looked up by bisect among the ends of B, then those around it, nearest first in rings that double, and both halves go on.  An interval without a shared end inside is a leaf, that is a group.  All open intervals
of a batch of texts are split at once, so the depth is the logarithm of the longest text.

Two tokens are linked where their bytes end together, which is at the end of a group, since no token is without bytes.
Links are counted over the corpus by pair of ids.  The most frequent pairs (``FREQUENT`` at most, whatever the corpus)
reach every task; all others are joined by pair, so that a pair held by every document is no one task's work.

Defined results: null and empty texts, and texts whose tokens do not spell a space and the text, byte for byte (a
tokenizer that normalises white space or characters), have no tokens: zeros and an empty string.  Strings of special
tokens inside a text are plain text.  Repeated rows and ids are rows of their own; an empty table gives an empty table;
columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.llm.scratch import Scratch
from hushframe.session import written

FREQUENT = 1 << 16  # pairs that reach every task
SLICE = 1 << 20  # bytes of text aligned at a time, or one text
HELD = 1 << 21  # pairs that a task adds up before it hands them on


class Side:
    """One tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, spell: list[bytes], encode):
        self.spell, self.encode = spell, encode
        self.sizes = np.array([len(x) for x in spell], np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spell.__getitem__, ids))


@cache
def byte_level(ranks_path: str) -> Side:
    """Byte-level pair encoding of a space and the text; the rank file is the same vocabulary for a faster implementation."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
    spell = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spell[rank] = token
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(spell, lambda texts: [encoding.encode_ordinary(" " + t) for t in texts])


@cache
def pieces_of(model_path: str) -> Side:
    """Pieces with byte fallback; the model puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    spell = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode("utf-8")
             for i in range(model.get_piece_size())]
    return Side(spell, lambda texts: model.encode(texts, num_threads=1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before - starts, lengths)


def shared_cuts(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Groups as (a0, a1, b0, b1), in order: tokens a0 … a1 - 1 of A and b0 … b1 - 1 of B.

    ``a`` and ``b`` are growing byte ends; ``spans`` has the same four numbers per text, whose last tokens end together.
    """
    leaves, spans = [], np.asarray(spans, np.int64).reshape(-1, 4)
    while len(spans):
        short = (spans[:, 1] - spans[:, 0] < 2) | (spans[:, 3] - spans[:, 2] < 2)
        leaves.append(spans[short])
        spans = spans[~short]
        a0, a1, b0, b1 = spans.T
        cut = (a0 + a1 - 1) >> 1
        other = np.searchsorted(b, a[cut])
        shared = b[other] == a[cut]
        if not shared.all():
            around(a, b, spans, np.flatnonzero(~shared), cut, other, shared)
        if not shared.all():
            leaves.append(spans[~shared])
            a0, a1, b0, b1, cut, other = (x[shared] for x in (a0, a1, b0, b1, cut, other))
        spans = np.stack([a0, cut + 1, b0, other + 1, cut + 1, a1, other + 1, b1], 1).reshape(-1, 4)  # halves stay in order
    found = np.concatenate(leaves) if leaves else spans
    return found[np.argsort(found[:, 0], kind="stable")]


def around(a: np.ndarray, b: np.ndarray, spans: np.ndarray, todo: np.ndarray, cut: np.ndarray, other: np.ndarray, shared: np.ndarray) -> None:
    """For the intervals ``todo``, whose middle is no shared end, the shared end nearest to it: sets cut, other and shared."""
    middle, inner, outer = cut.copy(), 1, 3
    while len(todo):
        m, first, last = middle[todo], spans[todo, 0], spans[todo, 1] - 2
        left, right = np.maximum(first, m - outer + 1), np.minimum(last, m + outer - 1)
        lengths = np.maximum(0, np.concatenate([m - inner - left + 1, right - m - inner + 1]))
        at, owner = ranges(np.concatenate([left, m + inner]), lengths), np.repeat(np.concatenate([todo, todo]), lengths)
        found = np.searchsorted(b, a[at])
        there = b[found] == a[at]
        at, owner, found = at[there], owner[there], found[there]
        nearest = np.lexsort((np.abs(at - middle[owner]), owner))
        owner, one = np.unique(owner[nearest], return_index=True)
        cut[owner], other[owner], shared[owner] = at[nearest][one], found[nearest][one], True
        todo = todo[~shared[todo] & ((left > first) | (right < last))]
        inner, outer = outer, outer * 2


class Aligned:
    """Alignment of some texts, one after the other: ids, groups and the groups' first and last text."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        have = [t for t in texts if t]
        ids = list(zip(a.encode(have), b.encode(have))) if have else []
        pairs = iter(zip(have, ids))
        none: tuple[list, list] = ([], [])
        own = [none] * len(texts)
        for k, t in enumerate(texts):
            if t:
                text, (x, y) = next(pairs)
                whole = b" " + text.encode("utf-8", "surrogatepass")
                own[k] = (x, y) if a.bytes_of(x) == whole and b.bytes_of(y) == whole else none
        self.n_a, self.n_b = (np.array([len(o[s]) for o in own], np.int64) for s in (0, 1))
        self.a, self.b = (np.fromiter(chain.from_iterable(o[s] for o in own), np.int64) for s in (0, 1))
        stop_a, stop_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        spans = np.stack([stop_a - self.n_a, stop_a, stop_b - self.n_b, stop_b], 1)
        self.groups = shared_cuts(np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b]), spans[self.n_a > 0])
        self.edges = np.searchsorted(self.groups[:, 0], np.concatenate(([0], stop_a)))
        self.n_groups = np.diff(self.edges)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B that end together, one pair per group."""
        return self.a[self.groups[:, 1] - 1], self.b[self.groups[:, 3] - 1]

    def written_out(self, names: list[str]) -> list[str]:
        """Per text ``a1,a2|b1;a3|b2,b3``; ``names`` has three spellings of each id: before a comma, a bar and a semicolon."""
        a0, a1, b0, b1 = self.groups.T
        code = np.empty(len(self.a) + len(self.b), np.int64)
        kind_a, kind_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        kind_a[a1 - 1], kind_b[b1 - 1] = 1, 2
        code[np.arange(len(self.a)) + np.repeat(b0, a1 - a0)] = self.a * 3 + kind_a
        code[np.arange(len(self.b)) + np.repeat(a1, b1 - b0)] = self.b * 3 + kind_b
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        spelled = list(map(names.__getitem__, code.tolist()))
        return ["".join(spelled[x:y])[:-1] for x, y in zip([0, *stops], stops)]


def slices(texts: pa.Array) -> Iterator[tuple[int, list]]:
    at, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= SLICE or k == len(texts) - 1:
            yield at, held
            at, held, size = k + 1, [], 0


def per_text(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    whole = np.concatenate(([0], np.cumsum(values)))
    return whole[edges[1:]] - whole[edges[:-1]]


def list_of(edges: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int64()))


def aligned(docs: DataFrame, ranks_path: str, model_path: str, text: str = "text", id: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, groups_sha256, its linked pairs (a * vocabulary of B + b) and how often; ``groups`` if asked for."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * with_groups]
    schema = f"id {docs.schema[id].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(ranks_path), pieces_of(model_path)
        spelled = [f"{i}{mark}" for i in range(max(len(a.spell), len(b.spell))) for mark in ",|;"]
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                got = Aligned(texts, a, b)
                out = got.written_out(spelled)
                x, y = got.links()
                owner = np.repeat(np.arange(len(texts)), got.n_groups)
                order = np.lexsort((code := x * len(b.spell) + y, owner))
                code, owner = code[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))[: len(code)])
                edges = np.searchsorted(owner[first], np.arange(len(texts) + 1))
                times = np.diff(np.concatenate((first, [len(code)])))
                columns = [batch.column(0).slice(at, len(texts)), *[pa.array(v, pa.int64()) for v in (got.n_a, got.n_b, got.n_groups, got.n_groups)],
                           pa.array([hashlib.sha256(o.encode()).hexdigest() if o else "" for o in out]), list_of(edges, code[first]), list_of(edges, times)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out)] * with_groups, names)

    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema + ", groups string" * with_groups)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Edges and values of a list column."""
    edges = column.offsets.to_numpy()
    return edges - edges[0], column.flatten().to_numpy()


def pair_counts(rows: DataFrame, second: int) -> DataFrame:
    """(pair, n, top): links of each pair over the corpus, and whether no other pair of its B id has more.

    ``second`` is the size of B's vocabulary.  Pairs are added up per task before they are shuffled.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append((flat(b.column(0))[1], flat(b.column(1))[1]))
            if sum(len(x[0]) for x in held) > HELD:
                held = [added(held)]
                if len(held[0][0]) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(held)], ["pair", "n"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return pair, np.bincount(at, np.concatenate([x[1] for x in held]), len(pair)).astype(np.int64)

    counted = rows.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("b", F.col("pair") % second)
    best = counted.groupBy("b").agg(F.max("n").alias("most"))  # a row per id of B at most
    return counted.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def counted_links(rows: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``rows`` without pairs and times, with n_best and count_sum; ``rows`` has a column ``row`` that numbers them."""
    often = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()  # at most ``frequent`` rows
    order = np.argsort(often.column("pair").to_numpy())
    known, many, top = (often.column(c).to_numpy()[order] for c in ("pair", "n", "top"))
    fields = [f for f in rows.schema.fields if f.name not in ("pairs", "times")]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges, pair = flat(b.column(len(names)))
            times = flat(b.column(len(names) + 1))[1]
            place = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            have = known[place] == pair if len(known) else np.zeros(len(pair), bool)
            n, best = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            n[have], best[have] = many[place[have]] * times[have], top[place[have]] * times[have]
            left = np.concatenate(([0], np.cumsum(~have)))[edges]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(per_text(edges, best)), pa.array(per_text(edges, n)),
                                              list_of(left, pair[~have]), list_of(left, times[~have])], [*names, "n_best", "count_sum", "pairs", "times"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    known_rows = written(rows.select(*names, "pairs", "times").mapInArrow(run, schema), "align-rows")
    rare = known_rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    rare = rare.join(counts, rare["pairs"] == counts["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("best_"), F.sum(F.col("n") * F.col("times")).alias("sum_"))
    both = known_rows.drop("pairs", "times").join(rare, "row", "left")
    return both.withColumns({"n_best": F.col("n_best") + F.coalesce("best_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_", F.lit(0))}).drop("best_", "sum_")


def align_documents(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, text: str = "text", id: str = "doc_id",
                    with_groups: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, groups_sha256 (and groups), n_best, count_sum."""
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    with Scratch(docs.sparkSession) as held:
        rows = held(aligned(docs, ranks_path, model_path, text, id, with_groups).withColumn("row", F.monotonically_increasing_id()), "align-pairs")
        counts = written(pair_counts(rows, len(pieces_of(model_path).spell)), "align-counts")
        return counted_links(rows, counts, frequent).drop("row")


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens (A) against pieces (B) of every document."""
    return align_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
