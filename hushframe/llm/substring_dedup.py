"""Substring deduplication by seed and extend: words of a repeat stay only where they come first.

Documents meet on winnowed anchors (``anchors``).  The occurrences of an anchor are extended word by word to the
right and to the left, all at once: occurrences that still agree share a class, a step splits the classes that
disagree.  A left and a right extension that add up to the threshold are a repeated window; what such windows
cover is the union of the maximal repeats over the threshold.

Defined results: words are split at ASCII white space and compared unchanged, by 64-bit hashes; null text has no
words; documents below the threshold lose nothing; a window that repeats only inside one document, or only in rows
of the same id, stays; null ids come after all others; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.anchors import HOT, Context, Scheme, covered, doc_key, repeats, with_spots
from hushframe.llm.catalog import query, table

GRAM = 8


def word_hashes(text: bytes) -> np.ndarray:
    words, digest = text.split(), xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def words_of(window: int) -> Scheme:
    return Scheme(word_hashes, window, min(GRAM, 1 << (window.bit_length() - 2)) if window > 1 else 1, earlier=True)


def refined(classes: np.ndarray, words: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Classes split by the next word; -1 where the extension has ended."""
    out = np.full(len(classes), -1, np.int64)
    at = np.flatnonzero(live)
    order = at[np.lexsort((words[at], classes[at]))]
    new = (np.diff(classes[order]) != 0) | (words[order][1:] != words[order][:-1])
    out[order] = np.concatenate(([0], np.cumsum(new))) if len(order) else []
    return out


def extend(window: int, gram: int):
    """Decision over contexts of whole grams: windows that a smaller id has as well."""
    reach = window - gram

    def decide(held: list[Context]) -> list[np.ndarray]:
        n = len(held)
        words = np.zeros((n, reach + window), np.uint64)
        lead, windows, low = (np.array([getattr(c, k) for c in held]) for k in ("lead", "windows", "low"))
        for i, c in enumerate(held):
            x = np.frombuffer(c.data, np.uint64)
            words[i, reach - c.lead:reach - c.lead + len(x)] = x
        right_end = windows + window - 1 - lead
        seed = np.unique([c.gram for c in held], return_inverse=True)[1].astype(np.int64)
        right, left = [seed], [seed]
        for j in range(window):
            right.append(refined(right[-1], words[:, reach + j], right_end > j))
        for j in range(reach):
            left.append(refined(left[-1], words[:, reach - 1 - j], lead > j))
        masks = [np.zeros(w, bool) for w in windows]
        for o in range(reach + 1):  # words of the window before its anchor
            at = np.flatnonzero((lead - windows < o) & (o <= lead))
            if not len(at):
                continue
            a, b = left[o][at], right[window - o][at]
            order = np.lexsort((low[at], b, a))
            a, b, lows = a[order], b[order], low[at][order]
            first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))
            least = np.repeat(lows[first], np.diff(np.append(first, len(order))))
            for i in at[order[least < lows]]:
                masks[i][lead[i] - o] = True
        return masks

    return decide


def drop_repeats(docs: DataFrame, window: int = 50, text: str = "text", id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(key, n_words, n_removed, spans, kept): what is left of each document, and the removed word ranges."""
    scheme = words_of(window)
    rows = docs.select(doc_key(id, text).alias("key"), F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spots = repeats(rows.select("key", "text"), scheme, extend(window, scheme.gram), hot)
    names = ["id", "n_words", "n_removed", "spans", "kept"]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for i, packed, spots in zip(*[b.column(c) for c in ("id", "packed", "spots")]):
                words = (data := expand(packed.as_py())).split()
                gone = covered(word_hashes(data), spots.as_py(), scheme) if spots.is_valid else np.zeros(len(words), bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((i.as_py(), len(words), int(gone.sum()), [{"start": a, "end": z} for a, z in edges], kept.decode("utf-8", "replace")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), spans_type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    return with_spots(rows, spots).select("id", "packed", "spots").mapInArrow(
        run, "id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept string")


SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from d),
s as (select doc_id, word, i, n, case when i + 49 <= n then string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 49 following) end as win from t),
f as (select doc_id, word, i, n, case when win is not null and min(doc_id) over (partition by win) < doc_id then 1 else 0 end as hit from s),
g as (select doc_id, word, i, n, max(hit) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from f),
r as (select doc_id, sum(gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '') as kept from g group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)
"""


@query("op7_seed_extend", SQL)
def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
