"""Near copies: one row stays of each class of texts whose sets of word shingles have a Jaccard similarity of ``least`` or more.

Candidates are all pairs of SimHash fingerprints within ``radius`` bits, linked by BK-trees of shards (``simhash``).  Pairs
of similarity ``least`` may differ in more bits than trees can search, so all pairs of MinHash signatures within the radius
that belongs to ``least`` are candidates too (``minhash``).  Whole sets then decide, so nothing below ``least`` is linked.
Rows are named by id and md5 of the text: only names, fingerprints and signatures are stored, never the corpus, and of the
texts only those of candidates are shuffled.

Of a class the row with the smallest id stays, null ids last; of equal ids the one whose md5 is smaller; of rows equal in
id and text one.  Every row decides for itself, whatever its id.

Defined results: A-Z are lower-cased, words are parted by ASCII white space; a text of fewer words than a shingle is one
shingle; null counts as empty, and texts without words are equal to each other; an empty table gives an empty table.
Further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.minhash import PART, POSITIONS, near_sets, text_key
from hushframe.llm.scratch import Scratch
from hushframe.llm.shingle_sets import BLOCK, WORDS
from hushframe.llm.simhash import perhaps_in
from hushframe.session import written

LEAST = 0.8
RADIUS = 4  # differing bits of two fingerprints


def near_dedup(docs: DataFrame, words: int = WORDS, least: float = LEAST, positions: int = POSITIONS, seed: int = 42, text: str = "text",
               id: str = "doc_id", block: int = BLOCK, part: int = PART, radius: int = RADIUS) -> DataFrame:
    """One row of each class of near copies, with all its columns."""
    with Scratch(docs.sparkSession) as held:
        rows, found = near_sets(docs, least, words, positions, seed, text, id, block, part, held, radius)
        name = F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("name")
        group = F.coalesce(F.col("root").cast("string"), F.hex("set"), F.lit("")).alias("group")
        named = rows.join(found, "set", "left").select(group, name)
        counted = held(named.groupBy("group", "name").agg(F.count("*").alias("n")), "near-names")
        best = counted.groupBy("group").agg(F.min("name").alias("best"), F.sum("n").alias("size")).filter("size > 1")
        fate = counted.join(best, "group").withColumn("stays", F.col("name") == F.col("best"))
        fate = fate.filter("not stays or n > 1").select(F.col("name.id").alias("id"), F.col("name.key").alias("key"), "stays")
        fate = written(fate, "near-fate")  # names that leave, and names of several rows that stay as one
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(f"`{id}`").alias("id"), text_key(text).alias("key"))
    flagged = perhaps_in(whole.withColumn("row", F.xxhash64("key")), fate.select(F.xxhash64("key").alias("row")))
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("key") == F.col("its_key"))
    named = fate.select(F.col("id").alias("its_id"), F.col("key").alias("its_key"), "stays")
    rest = flagged.filter("perhaps").join(named, same, "left").select("d", "id", "key", "stays")
    out = flagged.filter("not perhaps").select("d").unionByName(rest.filter("stays is null").select("d"))
    if not fate.filter("stays").isEmpty():
        out = out.unionByName(rest.filter("stays").groupBy("id", "key").agg(F.first("d").alias("d")).select("d"))
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns])
