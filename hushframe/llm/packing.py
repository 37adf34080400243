"""Vector best-fit packing of tokenized documents into sequences.

A document is its token ids and an end id.  One longer than a sequence is cut into pieces of full length, the
first piece takes what is left over.  Pieces are dealt by hash into chunks of bounded size, whatever the corpus;
a chunk packs its pieces by decreasing length, each into the open bin chosen by the residual capacities of tokens,
documents and attention cost (sum of squared lengths), among the bins that can hold it under every one of them.
A chunk leaves a few unfilled bins among tens of thousands, so chunks cost well under a thousandth of the bins.

Defined results: null text counts as empty and gives its end id alone; equal rows are packed like any others;
an empty table gives an empty table.  Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.session import written

CHUNK = 65_536  # pieces packed by one task
WEIGHTS = (1.0, 1.0, 1.0)  # of the residual tokens, documents and attention cost


@dataclass(frozen=True)
class Capacity:
    """Of one sequence.  ``cost`` bounds the sum of squared piece lengths, what attention within documents costs."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024

    def admits(self, longest: int) -> bool:
        return self.documents >= 1 and longest <= self.tokens and longest * longest <= self.cost


@cache
def encoder(ranks_path: str, tokenizer_path: str):
    """Text to ids as the ``tokenizers`` file gives them, without added special tokens.

    The ranks are the same vocabulary for a faster implementation; texts that spell out a special token, which
    the file maps to its id, take the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(tokenizer_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def cut_points(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % longest
    return ([(0, first)] if first else []) + [(at, longest) for at in range(first, n, longest)]


def pieces(docs: DataFrame, ranks_path: str, tokenizer_path: str, longest: int = 1024, end_id: int = 2,
           text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"id {docs.schema[id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks_path, tokenizer_path), np.array([end_id], "<u4")
        for b in batches:
            source, rows, ids = [], [], []
            for i, t in enumerate(b.column(1)):
                whole = np.concatenate([encode(t.as_py() or ""), end])
                for k, (at, n) in enumerate(cut_points(len(whole), longest)):
                    part = whole[at:at + n]
                    source.append(i)
                    rows.append((k, at, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = list(zip(*rows)) or [()] * 4
            arrays = [b.column(0).take(pa.array(source, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Bin of each piece; ``lengths`` come in decreasing order.

    ``norm``: the bin whose capacities left over, as parts of the whole, have the least weighted norm.
    ``dot``: the bin whose residual capacities have the largest weighted dot product with the piece.
    Ties go to the bin opened first.
    """
    sizes = np.array([capacity.tokens, capacity.documents, capacity.cost], float)
    scale = np.sqrt(np.array(weights, float)) / sizes
    n, smallest = len(lengths), int(lengths[-1]) if len(lengths) else 0
    left, open_bins, used = np.empty((3, n + 1), np.int64), np.empty(n + 1, np.int64), 0
    bins, made = np.empty(n, np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length])
        fits = np.flatnonzero((left[0, :used] >= length) & (left[1, :used] >= 1) & (left[2, :used] >= need[2]))
        if len(fits):
            residual = left[:, fits]
            if rule == "norm":
                best = np.argmin((((residual - need[:, None]) * scale[:, None]) ** 2).sum(axis=0))
            else:
                best = np.argmax((residual * (scale * scale * need)[:, None]).sum(axis=0))
            at = fits[best]
        else:
            at, used = used, used + 1
            left[:, at], open_bins[at], made = sizes, made, made + 1
        left[:, at] -= need
        bins[i] = open_bins[at]
        if left[0, at] < smallest or left[1, at] < 1 or left[2, at] < smallest * smallest:  # closed: order is kept, so ties are as before
            left[:, at:used - 1], open_bins[at:used - 1], used = left[:, at + 1:used].copy(), open_bins[at + 1:used].copy(), used - 1
    return bins


def packed(cut: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, chunk: int = CHUNK) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    chunks = max(1, -(-rows.count() // chunk))
    slim = rows.drop("ids").withColumn("chunk", F.pmod(F.xxhash64("id", "piece", "row"), F.lit(chunks)))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "chunk"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        if not capacity.admits(int(pdf["length"].iloc[0])):
            raise ValueError("a piece is above the capacity of a sequence")
        bins = best_fit(pdf["length"].to_numpy(), capacity, rule, weights)
        pdf = pdf.assign(sequence_id=(pdf["chunk"].to_numpy() << 32) + bins)
        pdf["offset"] = pdf.groupby("sequence_id", sort=False)["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="chunk")

    places = slim.groupBy("chunk").applyInPandas(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
    if "ids" in rows.columns:
        places = places.join(rows.select("row", "ids"), "row")
    return places.drop("row")


def pack_documents(docs: DataFrame, ranks_path: str | None = None, tokenizer_path: str | None = None, end_id: int = 2,
                   capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
                   text: str = "text", id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return packed(pieces(docs, ranks_path, tokenizer_path, capacity.tokens, end_id, text, id, with_ids), capacity, rule, weights)


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
