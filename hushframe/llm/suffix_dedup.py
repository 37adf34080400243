"""Suffix-array deduplication: bytes covered by a string of ``window`` bytes that starts anywhere else as well.

A suffix array of the corpus is sparse here: only suffixes at winnowed anchors are sorted (``anchors``), each bucket
being the suffixes of one anchor, in both directions.  Deep-shallow sorting orders a bucket's suffixes to the right
of the anchor and, reversed, to its left; the common prefixes of neighbours then say which suffixes agree to any
depth, and a window repeats where its part before the anchor and its part after it agree with another suffix.

Defined results: null text counts as empty; matches never cross texts; a text shorter than the window loses
nothing; equal rows are repeats of each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.anchors import HOT, Context, Scheme, covered, doc_key, repeats, with_spots
from hushframe.llm.catalog import query, table
from hushframe.llm.suffix_sort import deep_shallow

GRAM = 32


def bytes_of(window: int) -> Scheme:
    return Scheme(lambda text: np.frombuffer(text, np.uint8), window, min(GRAM, 1 << (window.bit_length() - 2)), earlier=False)


def sorted_suffixes(held: list[Context], part) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of every bucket and their common prefixes with the one before, -1 between buckets."""
    order, shared, at = [], [], 0
    while at < len(held):
        end = at + 1
        while end < len(held) and held[end].gram == held[at].gram:
            end += 1
        places, depths = deep_shallow([part(c) for c in held[at:end]])
        depths[0] = -1
        order += [at + p for p in places]
        shared += depths
        at = end
    return np.array(order), np.array(shared)


def suffix_classes(window: int, gram: int):
    """Decision over contexts of whole grams: windows that occur twice or more."""
    def decide(held: list[Context]) -> list[np.ndarray]:
        lead, windows, times = (np.array([getattr(c, k) for c in held]) for k in ("lead", "windows", "n"))
        right, right_shared = sorted_suffixes(held, lambda c: c.data[c.lead:])
        left, left_shared = sorted_suffixes(held, lambda c: c.data[:c.lead][::-1])
        masks = [np.zeros(w, bool) for w in windows]
        after, before = np.empty(len(held), np.int64), np.empty(len(held), np.int64)
        for o in range(window - gram + 1):  # bytes of the window before its anchor
            at = np.flatnonzero((lead - windows < o) & (o <= lead))
            if not len(at):
                continue
            after[right] = np.cumsum(right_shared < window - o)
            before[left] = np.cumsum(left_shared < o)
            _, same = np.unique(after[at] * (len(held) + 1) + before[at], return_inverse=True)
            total = np.bincount(same, weights=times[at])[same]
            for i in at[total >= 2]:
                masks[i][lead[i] - o] = True
        return masks

    return decide


def drop_repeated_bytes(docs: DataFrame, window: int = 200, text: str = "text", id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): what is left of each text, and the maximal removed byte ranges."""
    scheme = bytes_of(window)
    rows = docs.select(doc_key(id, text).alias("key"), F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spots = repeats(rows.select("key", "text"), scheme, suffix_classes(window, scheme.gram), hot)
    names = ["id", "n_bytes", "n_removed", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for i, packed, spots in zip(*[b.column(c) for c in ("id", "packed", "spots")]):
                data = np.frombuffer(expand(packed.as_py()), np.uint8)
                gone = covered(data, spots.as_py(), scheme) if spots.is_valid else np.zeros(len(data), bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                out.append((i.as_py(), len(data), int(gone.sum()), [{"start": a, "end": z} for a, z in edges], data[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    return with_spots(rows, spots).select("id", "packed", "spots").mapInArrow(
        run, "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


@query("op4_suffix_array")
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
