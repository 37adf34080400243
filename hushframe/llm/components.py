"""Connected components of a link table: bounded chunks by union-find, what is left by alternating star contraction.

Links never leave the cluster, and no task holds more than about ``CHUNK`` of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.bktree import Classes
from hushframe.session import written

CHUNK = 500_000


def contracted(links: DataFrame, parts: int) -> DataFrame:
    """Each of ``parts`` chunks of links replaced by stars around the smallest node of its classes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                classes.join(u, v)
        nodes = list(classes.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([classes.find(n) for n in nodes], pa.int64())], ["u", "v"])

    return links.repartition(parts, F.xxhash64("u", "v")).mapInArrow(run, "u bigint, v bigint")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Each node's neighbours are linked to the smallest of them and the node; partial minima come before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")).withColumnRenamed("u", "w")
    return keep(pairs.join(least, F.col("u") == F.col("w")))


def _large(pairs: DataFrame) -> DataFrame:
    return pairs.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(pairs: DataFrame) -> DataFrame:
    around = pairs.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return around.unionByName(pairs.select("u", F.col("m").alias("v")))


def components(links: DataFrame, chunk: int = CHUNK, store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(u, v) to (node, root): every node of a link with the smallest node it reaches.

    Links that fit one chunk are settled there.  More are contracted chunk by chunk and then star by star until
    nothing changes; rounds are few (about the square of the logarithm of the nodes at worst).  Each is stored in
    the shared folder, which cuts the lineage and survives lost executors.  A star's centre may hold most links: its
    minimum is combined map-side, and the join on it is one that adaptive execution splits.  ``store`` writes a round's table.
    """
    down = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links = store(links.select("u", "v"), "links")
    parts = -(-links.count() // chunk)
    links = store(contracted(links, max(1, parts)), "links")
    if parts > 1:
        before, now = None, _mark(links)
        while before != now:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = store(down(_star(both, _large)), "links")
            links = store(down(_star(large, _small)), "links")
            before, now = now, _mark(links)
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
