"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by BK-trees of shards.

Two fingerprints within ``radius`` bits agree on at least m - radius of m blocks of bits.  Each choice of
m - radius blocks is a table of shards, keyed by the bits of those blocks; a shard's fingerprints form a BK-tree
in the task that holds the shard, and are linked along edges within the radius only.  Trees of all fingerprints
grow with the corpus, so they go to the tasks of their shard and not to every executor.  m follows the number of
distinct fingerprints, so that a shard has a few hundred on average at any size.  A shard of more than ``BLOCK``
fingerprints is cut into trees of at most about that size; the whole shard then queries every one of its trees.

Links are enough to join classes, never all pairs.  Equal fingerprints are one from the start.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any
other; null ids are larger than any other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.bktree import shard_links
from hushframe.llm.catalog import query, table
from hushframe.llm.components import components
from hushframe.session import written

BITS = 64
SHARD = 256  # mean fingerprints of a shard
BLOCK = 50_000  # fingerprints of one tree
CHUNK = 1 << 16  # shingles whose bits are counted at a time
MAP = 1 << 19  # words of a map of rows
HOT = 1024  # a fingerprint with this part of all rows is hot; there are at most so many


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 hashes of the word shingles, A-Z lower-cased; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    votes, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", words: int = 4, seed: int = 42, row: str | None = None) -> DataFrame:
    """(id, print) and, if named, (row): one row per document, the fingerprint as a signed long."""
    kind = docs.schema[id].dataType
    more = [] if row is None else ["row"]
    schema = f"id {kind.simpleString()}, print bigint" + ", row bigint" * len(more)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([signed(fingerprint(t.as_py(), words, seed)) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints, *b.columns[2:]], ["id", "print", *more])

    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{row}`").alias(m) for m in more]).mapInArrow(run, schema)


def block_masks(distinct: int, radius: int) -> list[int]:
    """Bit masks, one per table of shards, of at least log2(distinct / SHARD) bits each."""
    m = radius + 1
    while True:
        edges = [BITS * i // m for i in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(blocks, m - radius)]
        if m >= radius + 4 or distinct <= SHARD << min(x.bit_count() for x in masks):
            return masks
        m += 1


def link_prints(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Distinct ``print`` values to links (u, v) whose classes are those of all pairs within the radius."""
    masks = block_masks(prints.count(), radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    sharded = prints.select("print", F.explode(tables).alias("s")).select("s.t", "s.bits", "print")
    large = sharded.groupBy("t", "bits").count().filter(F.col("count") > block).withColumn("trees", F.ceil(F.col("count") / block).cast("int"))
    sharded = sharded.join(large.select("t", "bits", "trees"), ["t", "bits"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    home = F.pmod(F.xxhash64("print", "t"), F.col("trees")).cast("int")
    # Every fingerprint builds the tree of its home block and queries the later ones.
    placed = sharded.withColumn("home", home).withColumn("tree", F.explode(F.sequence(F.col("home"), F.col("trees") - 1)))
    placed = placed.withColumn("asks", (F.col("tree") != F.col("home")).cast("int")).select("t", "bits", "tree", "asks", "print")
    placed = placed.repartition("t", "bits", "tree").sortWithinPartitions("t", "bits", "tree", "asks", "print")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, queries = None, [], []
        for b in batches:
            keys, asks, values = list(zip(*(b.column(i).to_pylist() for i in range(3)))), b.column(3).to_pylist(), b.column(4).to_pylist()
            links = []
            for k, a, v in zip(keys, asks, values):
                if k != key:
                    links += shard_links(members, queries, radius) if len(members) + len(queries) > 1 else []
                    key, members, queries = k, [], []
                (queries if a else members).append(v & ((1 << BITS) - 1))
            yield batch_of(links)
        yield batch_of(shard_links(members, queries, radius))

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([signed(x[i]) for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    return placed.mapInArrow(run, "u bigint, v bigint")


def print_roots(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """Distinct ``print`` values to (print, root)."""
    roots = components(link_prints(prints.select("print"), radius, block))
    return prints.join(roots, prints["print"] == roots["node"], "left").withColumn("root", F.coalesce("root", "print")).drop("node")


def near_groups(docs: DataFrame, radius: int = 4, words: int = 4, text: str = "text", id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document: id, print, component (smallest id reachable over links, its own included)."""
    slim = written(fingerprints(docs, text, id, words), "simhash")
    groups = written(slim.groupBy("print").agg(F.min("id").alias("lo"), F.count("*").alias("n")), "simhash-groups")
    rooted = print_roots(groups, radius, block)
    least = rooted.groupBy("root").agg(F.min("lo").alias("component"))
    labels = written(rooted.select("print", "root", "n").join(least, "root").select("print", "component", "n"), "simhash-labels")
    hot = written(labels.filter(F.col("n") * HOT >= slim.count()).select("print", "component"), "simhash-hot")
    direct = slim.join(F.broadcast(hot), "print", "left")  # at most HOT rows are broadcast
    rest = direct.filter(F.col("component").isNull()).drop("component").join(labels.select("print", "component"), "print")
    return direct.filter(F.col("component").isNotNull()).unionByName(rest)


def with_rows(docs: DataFrame) -> DataFrame:
    """(d, row): the rows of ``docs`` as structs, each with a number of its own; stored, so that it keeps it."""
    d = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    return written(docs.select(d, F.monotonically_increasing_id().alias("row")), "dedup-rows")


def perhaps_in(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``perhaps``: false only if the row's number is not in ``rows``.  A map of ``MAP`` words at most is broadcast."""
    bit = F.pmod(F.xxhash64("row"), F.lit(64 * MAP))
    flag = F.expr("shiftleft(1L, cast(__bit % 64 as int))")
    words = rows.select(bit.alias("__bit")).groupBy(F.floor(F.col("__bit") / 64).alias("__word")).agg(F.bit_or(flag).alias("__bits"))
    found = df.withColumn("__bit", bit).withColumn("__word", F.floor(F.col("__bit") / 64)).join(F.broadcast(words), "__word", "left")
    return found.withColumn("perhaps", F.coalesce(F.col("__bits").bitwiseAND(flag) != 0, F.lit(False))).drop("__bit", "__word", "__bits")


def first_of_class(stored: DataFrame, labelled: DataFrame, columns: list[str]) -> DataFrame:
    """The row of each ``root`` with the smallest (id, row), null ids last; ``labelled`` has row, id and root of the rows that may leave.

    Rows of ``stored`` that ``labelled`` does not name stay.  Of all rows only those that may leave are shuffled.
    """
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    stays = labelled.groupBy("root").agg(best.alias("best")).select("root", F.col("best.row").alias("stays"))
    leaves = written(labelled.join(stays, "root").filter("row <> stays").select("row"), "dedup-leaves")
    flagged = perhaps_in(stored, leaves)
    sure = flagged.filter("not perhaps").select("d")
    rest = flagged.filter("perhaps").join(leaves, "row", "left_anti").select("d")
    return sure.unionByName(rest).select(*[F.col(f"d.`{c}`") for c in columns])


def simhash_dedup(docs: DataFrame, radius: int = 4, words: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each group stays, the one with the smallest id, with all its columns.

    Rows decide for themselves: null and repeated ids take no row of another group along.  Of a group's rows without
    an id, or with the same smallest id, the first one as stored stays.
    """
    stored = with_rows(docs)
    slim = fingerprints(stored.select("row", F.col(f"d.`{id}`").alias("id"), F.col(f"d.`{text}`").alias("text")), "text", "id", words, row="row")
    slim = written(slim, "simhash")
    groups = written(slim.select("print").distinct(), "simhash-groups")
    labelled = slim.join(print_roots(groups, radius, BLOCK), "print").select("row", "id", "root")
    return first_of_class(stored, labelled, docs.columns)


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
