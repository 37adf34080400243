"""Sets of word shingles compared whole: which texts of a group are alike, without listing the pairs of a class.

Two sets of similarity t share one of the first n - ceil(t * n) + 1 of their n shingles under any one order of
shingles, so members of a group meet on those, rarest first by the group's own counts.  A text is compared until it
has one link to each class that it touches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
BLOCK = 24_000_000  # bytes of text of one part of a group
BATCH = 16  # sets compared at first; four times as many each time none is alike


def shingles(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64))


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(n * least - 1e-9) + 1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


class Cluster:
    """Sets of one part of a cluster, linked to each other and then to those that ask."""

    def __init__(self, least: float):
        self.least, self.rows, self.sets, self.equal, self.links = least, [], [], {}, []
        self.near: list[int] = []  # members known to be alike to one pivot: one class from the start
        self.built = False

    def add(self, row: int, s: np.ndarray, pivot: int | None = None) -> None:
        at = self.equal.setdefault(s.tobytes(), len(self.rows))
        if pivot is not None:
            self.links.append((row, pivot))
            if at == len(self.rows):
                self.near.append(at)
        if at < len(self.rows):
            self.links.append((row, self.rows[at]))
        else:
            self.rows.append(row)
            self.sets.append(s)

    def build(self) -> None:
        self.built, k = True, len(self.rows)
        if not k:
            return
        self.size = np.array([len(s) for s in self.sets])
        self.words, local, counts = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        order = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.sets = [np.sort(x) for x in np.split(self.rank[local], np.cumsum(self.size)[:-1])]  # rarest first
        heads = [s[: prefix_length(len(s), self.least)] for s in self.sets]
        key, who = np.concatenate(heads), np.repeat(np.arange(k), [len(x) for x in heads])
        self.who = who[np.argsort(key, kind="stable")]
        self.edges = np.concatenate(([0], np.cumsum(np.bincount(key, minlength=len(order)))))
        self.mark, self.label, self.classes = np.zeros(len(order), bool), np.arange(k), {}
        for x in self.near[1:]:
            self.join(self.near[0], x)
        for x in range(k):
            self.probe(self.rows[x], self.sets[x], self.sets[x], len(self.sets[x]), x)

    def ask(self, row: int, s: np.ndarray) -> None:
        if not self.built:
            self.build()
        if not self.rows:
            return
        at = np.minimum(np.searchsorted(self.words, s), len(self.words) - 1)
        have = np.sort(self.rank[at[self.words[at] == s]])
        # Shingles that no member has come first in the order.
        self.probe(row, have, have[: max(0, prefix_length(len(s), self.least) - (len(s) - len(have)))], len(s), None)

    def probe(self, row: int, have: np.ndarray, head: np.ndarray, n: int, x: int | None) -> None:
        """Links to one member of each class that is alike; a member itself looks at those before it only."""
        head = head[: prefix_length(n, self.least)]
        met = [self.who[self.edges[h]:self.edges[h + 1]] for h in head.tolist()]
        if not met:
            return
        found = np.unique(np.concatenate(met))
        found = found[: np.searchsorted(found, x)] if x is not None else found
        size = self.size[found]
        found = found[(size >= self.least * n - 1e-9) & (n >= self.least * size - 1e-9)]
        mine, batch = x, BATCH
        if mine is not None:
            found = found[self.label[found] != self.label[mine]]
        self.mark[have] = True
        while len(found):
            now = found[:batch]
            sets = [self.sets[c] for c in now.tolist()]
            both = np.add.reduceat(self.mark[np.concatenate(sets)], np.concatenate(([0], np.cumsum(self.size[now])[:-1])), dtype=np.int64)
            alike = now[both >= self.least * (n + self.size[now] - both) - 1e-9]
            found, batch = found[batch:], batch * 4
            while len(alike):
                one = int(alike[0])
                self.links.append((row, self.rows[one]))
                mine = one if mine is None else self.join(mine, one)
                alike = alike[self.label[alike] != self.label[one]]
            if mine is not None:
                found = found[self.label[found] != self.label[mine]]
        self.mark[have] = False

    def join(self, a: int, b: int) -> int:
        p, q = int(self.label[a]), int(self.label[b])
        if p != q:
            small, large = sorted((self.classes.pop(p, [p]), self.classes.pop(q, [q])), key=len)
            into = int(self.label[large[0]])
            self.label[small] = into
            self.classes[into] = large + small
        return b

    def found(self) -> list[tuple[int, int]]:
        if not self.built:
            self.build()
        return self.links


def alike_links(texts: DataFrame, words: int, least: float, block: int = BLOCK) -> DataFrame:
    """(root, node, text) to (u, v): links whose classes are those of all alike pairs within a root.

    A root of more than ``block`` bytes is cut into parts.  Its smallest node goes to all of them as their pivot: what
    is alike to it is one class already and asks no other part, so a large group around one text stays linear.  The
    others ask every part.
    """
    held = texts.select("root", "node", "text", F.octet_length("text").alias("bytes"))
    large = held.groupBy("root").agg(F.ceil(F.sum("bytes") / block).cast("int").alias("parts"), F.min_by("text", "node").alias("pivot"),
                                     F.min("node").alias("first")).filter("parts > 1")
    home = F.pmod(F.xxhash64("node", "root"), F.col("parts")).cast("int")
    cut = held.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("home", home)

    def near_pivot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for b in batches:
            near = []
            for root, t, p in zip(b.column(0).to_pylist(), b.column(2), b.column(4)):
                if p.as_py() is None:
                    near.append(False)
                    continue
                if known[0] != root:
                    known = root, shingles(p.as_py(), words)
                near.append(similar(shingles(t.as_py(), words), known[1], least))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in (0, 1, 2, 3, 5, 6)], pa.array(near)], ["root", "node", "text", "parts", "first", "home", "near"])

    # Only roots in parts have a pivot; texts of all others pass through.
    placed = cut.select("root", "node", "text", "parts", "pivot", "first", "home").mapInArrow(
        near_pivot, "root bigint, node bigint, text string, parts int, first bigint, home int, near boolean")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    placed = placed.withColumn("part", F.explode(F.when(F.col("near"), F.array("home")).otherwise(everywhere)))
    placed = placed.withColumn("asks", (F.col("part") != F.col("home")).cast("int")).withColumn("pivot", F.when(F.col("near"), F.col("first")))
    placed = placed.select("root", "part", "asks", "node", "text", "pivot").repartition("root", "part").sortWithinPartitions("root", "part", "asks", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cluster = None, Cluster(least)
        for b in batches:
            roots, parts, asks, nodes, pivots = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            for k, a, node, t, p in zip(zip(roots, parts), asks, nodes, b.column(4), pivots):
                if k != key:
                    yield batch_of(cluster.found())
                    key, cluster = k, Cluster(least)
                if a:
                    cluster.ask(node, shingles(t.as_py(), words))
                else:
                    cluster.add(node, shingles(t.as_py(), words), p)
        yield batch_of(cluster.found())

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    return placed.mapInArrow(run, "u bigint, v bigint")
