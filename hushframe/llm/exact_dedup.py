"""Exact deduplication with a heavy-hitter split.

Digests that hold a large share of the rows are found by Misra-Gries summaries; their verified winners are a
table of at most ``heavy.COUNTERS`` rows, broadcast, so copies of a hot text are decided where they are read.
All other digests hold less than 1/COUNTERS of the rows each and are grouped by an ordinary shuffle.

Defined results: null text counts as empty; of equal texts the row with the largest id stays, a null id is
smaller than any other; of rows equal in id and text the one stays whose hash of all columns is least; an empty table gives an empty table.  Further
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.llm.heavy import COUNTERS, heavy_keys
from hushframe.session import written


def text_digest(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def winners(slim: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Of the heavy digests of ``slim`` (id, row, digest): (digest, top, size), at most ``counters`` rows, stored."""
    heavy = heavy_keys(slim, "digest", counters).select("digest")
    best = F.max(F.struct("id", "row")).alias("top")
    return written(slim.join(F.broadcast(heavy), "digest").groupBy("digest").agg(best, F.count("*").alias("size")), "dedup-winners")


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, row, digest, keep_id, group_size, kept.

    Texts are read once, into a stored table of digests; the rest of the work moves 64-digit digests only.
    """
    slim = docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), text_digest(text).alias("digest"))
    slim = written(slim, "dedup-digests")
    hot = F.broadcast(winners(slim, counters))
    split = slim.join(hot, "digest", "left")
    rest = slim.join(hot, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("size"))
    both = split.filter(F.col("size").isNotNull()).unionByName(rest.join(groups, "digest"))
    return both.select("id", "row", "digest", F.col("top.id").alias("keep_id"), F.col("size").alias("group_size"),
                       (F.col("row") == F.col("top.row")).alias("kept"))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    A copy of a hot text leaves in the task that reads it; only texts of ordinary digests are shuffled.
    """
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    plain = [F.col(f"d.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    tie = F.xxhash64(*plain)
    slim = docs.select(F.col(id).alias("id"), F.lit(0).alias("row"), text_digest(text).alias("digest"))
    hot = F.broadcast(winners(slim, counters))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), text_digest(f"`{text}`").alias("digest"))
    best = rows.join(hot, "digest").filter(F.col(f"d.`{id}`").eqNullSafe(F.col("top.id"))).groupBy("digest").agg(F.min_by("d", tie).alias("d"))
    order = Window.partitionBy("digest").orderBy(F.col(f"d.`{id}`").desc_nulls_last(), tie)
    rest = rows.join(hot, "digest", "left_anti").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return best.select(*columns).unionByName(rest.select(*columns))


SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(text) as text_sha256
from d window g as (partition by text)
"""


@query("op1_exact_dedup", SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
