"""Repeated windows by winnowed anchors: the part that substring and suffix-array deduplication share.

Every window of ``window`` units has one anchor, the gram of ``gram`` units with the least hash in it (the leftmost
of equals), so equal windows have equal anchors at equal places.  Consecutive windows with one anchor are a run; a
run's context is the text its windows span.  Work then goes by gram:

1. grams that occur once cannot repeat a window: an aggregation that combines map-side leaves the repeated ones;
2. a repeated gram with one context is settled: that context repeats whole;
3. grams with several contexts are compared by content, one row per distinct context however often it occurs;
   a block of grams is compared in memory, a gram with more than ``hot`` contexts by hashes of its windows instead,
   one row per window, aggregated with partial results;
4. every document gets its settled contexts back and finds their places by running over its text again.

Nothing but hashes is shuffled for texts that repeat nothing, apart from the texts themselves on their way to
their decisions, compressed.  Ids are integers; null ids count as larger than all others, in the order of a hash
of their text; rows that share an id are told apart by their text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.session import written

PLACE_BITS = 20
PLACE = np.uint64((1 << PLACE_BITS) - 1)
PIECE = 1 << (PLACE_BITS - 1)  # units of a long text handled at a time
BLOCK = 20_000  # contexts compared in memory at a time
HOT = 100_000  # contexts of one gram beyond which its windows are hashed
FACTOR = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Scheme:
    """What a unit is and how long a repeat must be.  ``gram`` is a power of two below ``window``."""

    units: Callable[[bytes], np.ndarray]
    window: int
    gram: int
    earlier: bool  # a repeat counts if a smaller id has it; else wherever it is


@dataclass
class Context:
    gram: int
    ctx: int
    lead: int  # units before the anchor
    windows: int
    n: int  # times it occurs
    low: int  # smallest id that has it
    data: bytes  # its units, eight or one bytes each


def grams(x: np.ndarray, length: int) -> np.ndarray:
    """Mixed polynomial hash of every gram, by doubling."""
    h, width, factor = x.astype(np.uint64), 1, FACTOR
    while width < length:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = width * 2, factor * factor & (2**64 - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span:]) if width > span else x


@dataclass
class Run:
    doc: int
    first: int  # first unit of the first window
    last: int  # first unit of the last window
    lead: int
    gram: int
    ctx: int
    data: memoryview


def runs(docs: Iterable[np.ndarray], scheme: Scheme) -> Iterator[Run]:
    """Runs of all texts, given as arrays of units; short texts are handled together, long ones in pieces."""
    pieces, size = [], 0
    for i, x in enumerate(docs):
        for at in range(0, max(1, len(x) - scheme.window + 1), PIECE - scheme.window + 1):
            part = x[at:at + PIECE]
            if len(part) < scheme.window:
                continue
            if size + len(part) > 1 << PLACE_BITS:
                yield from _runs(pieces, scheme)
                pieces, size = [], 0
            pieces.append((i, at, part))
            size += len(part)
    if pieces:
        yield from _runs(pieces, scheme)


def _runs(pieces: list[tuple[int, int, np.ndarray]], scheme: Scheme) -> Iterator[Run]:
    x = np.concatenate([p for _, _, p in pieces])
    lengths = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(lengths)
    h = grams(x, scheme.gram)
    least = sliding_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), scheme.window - scheme.gram + 1) & PLACE
    inside = np.zeros(len(least) + 1, np.int8)  # windows that do not cross into the next text
    np.add.at(inside, ends - lengths, 1)
    np.add.at(inside, ends - scheme.window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    anchors = least[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (np.diff(starts) != 1))))
    first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
    anchor = anchors[new]
    piece = np.searchsorted(ends, first, side="right")
    data, width, digest = memoryview(np.ascontiguousarray(x)).cast("B"), x.itemsize, xxhash.xxh64_intdigest
    columns = (piece, first, last, anchor - first, h[anchor])
    for k, a, b, lead, gram in zip(*[c.tolist() for c in columns]):
        doc, at, _ = pieces[k]
        view, shift = data[a * width:(b + scheme.window) * width], at - int(ends[k] - lengths[k])
        yield Run(doc, a + shift, b + shift, lead, signed(gram), signed(digest(view, lead)), view)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def doc_key(id: str, text: str) -> Column:
    spare = F.lit(1 << 62) + F.shiftright(F.xxhash64(F.lit(0), F.coalesce(F.col(f"`{text}`"), F.lit(""))), 2).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(f"`{id}`").cast("bigint"), spare)


def _units(batch: pa.Array, scheme: Scheme) -> list[np.ndarray]:
    return [scheme.units(t) for t in batch.cast(pa.binary()).to_pylist()]


def occurrences(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, text) to one row per document and distinct context: gram, ctx, key, n."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys = part.column(0).to_pylist()
                found = Counter((r.gram, r.ctx, keys[r.doc]) for r in runs(_units(part.column(1), scheme), scheme))
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*columns, list(found.values()))], ["gram", "ctx", "key", "n"])

    return docs.mapInArrow(run, "gram bigint, ctx bigint, key bigint, n bigint")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(key, text, …) with the text as ``packed``: a shuffled text takes a third of its size."""
    names = [f.name for f in docs.schema.fields]
    place = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "text" else "packed binary" for f in docs.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            columns = list(b.columns)
            columns[place] = pa.array([squeeze(t) for t in columns[place].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, [n if n != "text" else "packed" for n in names])

    return docs.mapInArrow(run, schema)


def contents(needs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The named contexts of each document with their units: gram, ctx, lead, windows, n, low, data."""
    names = ["gram", "ctx", "lead", "windows", "n", "low", "data"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for packed, wanted in zip(b.column(0), b.column(1)):
                want = {(w["gram"], w["ctx"]): (w["n"], w["low"]) for w in wanted.as_py()}
                rows = []
                for r in runs([scheme.units(expand(packed.as_py()))], scheme):
                    if got := want.pop((r.gram, r.ctx), None):
                        rows.append((r.gram, r.ctx, r.lead, r.last - r.first + 1, *got, bytes(r.data)))
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    joined = packed_texts(docs).join(needs, "key").select("packed", "wanted")
    return joined.mapInArrow(run, "gram bigint, ctx bigint, lead bigint, windows bigint, n bigint, low bigint, data binary")


def compared(rows: DataFrame, decide: Callable[[list[Context]], list[np.ndarray]]) -> DataFrame:
    """Contexts to (gram, ctx, mask): packed bits of the windows that repeat; whole grams are compared together."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Context] = []
        for b in batches:
            for values in zip(*[c.to_pylist() for c in b.columns]):
                if len(held) >= BLOCK and values[0] != held[-1].gram:
                    yield masks(held)
                    held = []
                held.append(Context(*values))
        if held:
            yield masks(held)

    def masks(held: list[Context]) -> pa.RecordBatch:
        found = [(c.gram, c.ctx, np.packbits(m).tobytes()) for c, m in zip(held, decide(held)) if m.any()]
        columns = list(zip(*found)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["gram", "ctx", "mask"])

    return rows.repartition("gram").sortWithinPartitions("gram", "ctx").mapInArrow(run, "gram bigint, ctx bigint, mask binary")


def hashed(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """The same as ``compared`` for hot grams: one row per window, so a gram's size bounds no task."""
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, ctx, _, windows, n, low, data in zip(*[c.to_pylist() for c in b.columns]):
                width = len(data) // (windows + scheme.window - 1)
                prints = [xxhash.xxh128_digest(data[i * width:(i + scheme.window) * width]) for i in range(windows)]
                same = [pa.array([v] * windows, pa.int64()) for v in (gram, ctx)]
                rest = [pa.array([v] * windows, pa.int64()) for v in (windows, n, low)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(windows), pa.int64()), *rest, pa.array(prints, pa.binary())],
                                                 ["gram", "ctx", "at", "windows", "n", "low", "print"])

    wide = rows.mapInArrow(spread, "gram bigint, ctx bigint, at bigint, windows bigint, n bigint, low bigint, print binary")
    total = wide.groupBy("gram", "print").agg(F.sum("n").alias("all"), F.min("low").alias("least"))
    again = wide.join(total, ["gram", "print"]).filter(F.col("least") < F.col("low") if scheme.earlier else F.col("all") >= 2)
    bits = again.groupBy("gram", "ctx", "windows").agg(F.collect_list("at").alias("at"))
    flags = F.transform(F.sequence(F.lit(0), ((F.col("windows") + 7) / 8).cast("int") * 8 - 1), lambda i: F.array_contains("at", i.cast("bigint")).cast("int").cast("string"))
    text = F.array_join(flags, "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(text), F.lit(8)), lambda i: F.lpad(F.conv(F.substr(text, i, F.lit(8)), 2, 16), 2, "0"))
    return bits.select("gram", "ctx", F.unhex(F.array_join(pairs, "")).alias("mask"))


def repeats(docs: DataFrame, scheme: Scheme, decide: Callable[[list[Context]], list[np.ndarray]], hot: int = HOT) -> DataFrame:
    """(key, text) to (key, spots): the contexts of each document that repeat, whole (no mask) or in part."""
    rows = occurrences(docs, scheme)
    several = F.min("key") < F.max("key") if scheme.earlier else F.sum("n") >= 2
    by_gram = rows.groupBy("gram").agg(several.alias("several"), F.min("key").alias("least"), (F.min("ctx") == F.max("ctx")).alias("single"))
    hits = written(rows.join(by_gram.filter("several").drop("several"), "gram"), "anchor-hits")
    settled = hits.filter(F.col("single") & ((F.col("key") > F.col("least")) if scheme.earlier else F.lit(True))).select("key", "gram", "ctx", F.lit(None).cast("binary").alias("mask"))
    open_ = hits.filter(~F.col("single"))
    by_ctx = written(open_.groupBy("gram", "ctx").agg(F.sum("n").alias("n"), F.min("key").alias("low")), "anchor-contexts")
    needs = by_ctx.groupBy(F.col("low").alias("key")).agg(F.collect_list(F.struct("gram", "ctx", "n", "low")).alias("wanted"))
    rows = written(contents(needs, docs, scheme), "anchor-contents")
    crowded = rows.groupBy("gram").count().filter(F.col("count") > hot).select("gram")
    if crowded.isEmpty():
        masks = compared(rows, decide)
    else:
        masks = compared(rows.join(crowded, "gram", "left_anti").select(rows.columns), decide).unionByName(hashed(rows.join(crowded, "gram", "left_semi").select(rows.columns), scheme))
    verdicts = written(by_ctx.join(masks, ["gram", "ctx"], "left"), "anchor-masks")
    whole = F.col("key") > F.col("low") if scheme.earlier else F.col("total") >= 2
    found = open_.join(verdicts.withColumnRenamed("n", "total"), ["gram", "ctx"]).withColumn("whole", whole).filter("whole or mask is not null")
    found = found.select("key", "gram", "ctx", F.when(~F.col("whole"), F.col("mask")).alias("mask"))
    return settled.unionByName(found).groupBy("key").agg(F.collect_list(F.struct("gram", "ctx", "mask")).alias("spots"))


def covered(x: np.ndarray, spots: list[dict] | None, scheme: Scheme) -> np.ndarray:
    """Which units of a text lie in a repeated window, from the spots of its id."""
    marks = np.zeros(len(x) + 1, np.int64)
    known = {(s["gram"], s["ctx"]): s["mask"] for s in spots or ()}
    for r in runs([x], scheme) if known else ():
        mask = known.get((r.gram, r.ctx), b"")
        if mask is None:
            marks[r.first] += 1
            marks[r.last + scheme.window] -= 1
        elif mask:
            hit = r.first + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))[: r.last - r.first + 1])
            np.add.at(marks, hit, 1)
            np.add.at(marks, hit + scheme.window, -1)
    return np.cumsum(marks[:-1]) > 0


def with_spots(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """(key, text, …) to (key, packed, …, spots), for the last pass over the texts."""
    return packed_texts(docs).join(spots, "key", "left")
