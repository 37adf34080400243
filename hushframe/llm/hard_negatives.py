"""Hard-negative mining by a BOND vertical scan.

Vectors are integers.  Rows are dealt into blocks of bounded size, and a block is held by columns, one per dimension.
For an anchor, dimensions are read in descending order of the anchor's magnitude.  After each few dimensions a candidate's
score lies between its partial score plus the least and plus the largest contribution that the dimensions left can
give, by the block's minimum and maximum of each.  Candidates that cannot matter leave the bitmap; those left at the
end have their exact score.  Anchors come to a block one after the other, so a task holds one block and a batch of them.

Two scans: the first keeps the ``positives`` best rows of the anchor's own label, whose best over all blocks give the
windows; the second keeps rows of other labels that may lie in any window, and of each window the first
``negatives``.  A block hands on a few rows per anchor and window, whatever its size.

Defined results: rows without id, label or vector, or with a null or non-finite component take no part.  Shorter vectors
count as zero beyond their end.  Repeated rows and ids are rows of their own; an anchor is never its own positive, an
equal row may be.  Ties go to the smaller id.  A negative positive score has an empty window.  Scores that a long cannot
hold are an error.  An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.llm.scratch import Scratch
from hushframe.session import written

BLOCK = 65_536  # rows of a block
STEP = 8  # dimensions between two looks at the bitmap
POSITIVES = 5
NEGATIVES = 10
LEAST, MOST = 30, 90  # percent of the positive's score
SCALE = 256


class Block:
    """Rows of one block by columns, in order of label, id and row."""

    def __init__(self, row: np.ndarray, id: np.ndarray, label: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((row, id, label))
        self.row, self.id, self.label = row[order], id[order], label[order]
        self.columns = np.ascontiguousarray(vectors[order].T)  # dimension by dimension
        self.low, self.high = (self.columns.min(axis=1), self.columns.max(axis=1)) if len(row) else (None, None)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Candidates left of the bitmap ``alive`` and their exact scores; ``keep`` tells from bounds which stay."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[:, None] * np.stack([self.low, self.high], 1)
        least, most = ends.min(axis=1)[order], ends.max(axis=1)[order]
        at, score = np.flatnonzero(alive), None
        score = np.zeros(len(at), self.columns.dtype)
        for k in range(0, len(order), STEP):
            dims = order[k:k + STEP]
            score += anchor[dims] @ self.columns[np.ix_(dims, at)]
            stay = keep(score + least[k + STEP:].sum(), score + most[k + STEP:].sum())
            if not stay.all():
                at, score = at[stay], score[stay]
            if not len(at):
                break
        return at, score

    def first(self, at: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Places in ``at`` of the ``n`` highest scores, ties by id and row."""
        if len(at) > n:
            cut = np.partition(score, len(score) - n)[len(score) - n]
            some = np.flatnonzero(score >= cut)
        else:
            some = np.arange(len(at))
        return some[np.lexsort((self.row[at[some]], self.id[at[some]], -score[some]))][:n]


def best_of_label(block: Block, anchor: np.ndarray, row: int, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    alive = (block.label == label) & (block.row != row)

    def keep(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= n:
            return np.ones(len(least), bool)
        return most >= np.partition(least, len(least) - n)[len(least) - n]

    at, score = block.scan(anchor, alive, keep)
    some = block.first(at, score, n)
    return at[some], score[some]


def windowed(block: Block, anchor: np.ndarray, label: int, scores: np.ndarray, least: int, most: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per positive score: its place, and the first rows of other labels in its window."""
    low, high = -(-scores * least // 100), scores * most // 100
    open_ = np.flatnonzero(low <= high)
    if not len(open_):
        return
    bottom, top = low[open_].min(), high[open_].max()
    at, score = block.scan(anchor, block.label != label, lambda a, b: (b >= bottom) & (a <= top))
    exact = score.astype(np.int64)
    for k in open_.tolist():
        inside = np.flatnonzero((exact >= low[k]) & (exact <= high[k]))
        some = inside[block.first(at[inside], exact[inside], n)]
        yield k, at[some], exact[some]


def usable(rows: DataFrame, anchors: Column, label: str | Column, id: str, vector: str, scale: int) -> DataFrame:
    """(row, id, label, vector, asks): rows that take part, components as whole numbers of 1 / ``scale``."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    value, name = F.col(f"`{vector}`"), F.col(f"`{id}`")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(value, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    return rows.filter(name.isNotNull() & label.isNotNull() & value.isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"), name.cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"))


def blocks_of(rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """Every row in its block, and after them each asking anchor in every block."""
    home = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<bigint>")
    held = rows.select(home.alias("block"), F.lit(0).alias("asks"), "row", "id", "label", "vector", none.alias("scores"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = asked.select(every.alias("block"), F.lit(1).alias("asks"), "row", "id", "label", "vector", "scores")
    return held.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks", "row")


def padded(column: pa.Array, size: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def scanned(placed: DataFrame, size: int, exact_doubles: bool, found: str, answer) -> DataFrame:
    """Rows of ``answer(block, anchor vector, row, label, scores)`` for every anchor in every block."""
    kind = np.float64 if exact_doubles else np.int64
    names = [x.split()[0] for x in found.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, key = [], None, None
        for b in batches:
            blocks, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
                if x == y:
                    continue
                some = b.slice(x, y - x)
                if blocks[x] != key:
                    parts, held, key = [], None, blocks[x]
                row, id, label = (some.column(i).to_numpy() for i in (2, 3, 4))
                vectors = padded(some.column(5), size).astype(kind)
                if not asks[x]:
                    parts.append((row, id, label, vectors))
                    continue
                if not parts and held is None:
                    continue  # a block without rows
                if held is None:
                    held, parts = Block(*[np.concatenate(c) for c in zip(*parts)]), []
                out = [r for k, s in enumerate(some.column(6).to_pylist()) for r in answer(held, vectors[k], int(row[k]), int(label[k]), s)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names)

    return placed.mapInArrow(run, found)


def hard_negatives(rows: DataFrame, anchors: Column, label: str | Column = "label", id: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the given rows.  A negative is a row of another label whose score is ``least`` to
    ``most`` percent of the positive's.
    """
    spark = rows.sparkSession
    with Scratch(spark) as held:
        vectors = held(usable(rows, anchors, label, id, vector, scale), "bond-rows")
        largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
        count, size, peak = vectors.agg(F.count("*"), F.max(F.size("vector")), largest).first()
        bound = (size or 0) * (peak or 0) ** 2
        if bound * max(100, most) >= 2**63:
            raise ValueError("scores do not fit a long")
        blocks = max(-(-count // block), 2 * spark.sparkContext.defaultParallelism)
        asking = vectors.filter("asks")

        def nearest(b: Block, v: np.ndarray, row: int, own: int, _) -> list[tuple]:
            at, score = best_of_label(b, v, row, own, positives)
            return [(row, int(b.row[i]), int(b.id[i]), int(x)) for i, x in zip(at, score)]

        def inside(b: Block, v: np.ndarray, row: int, own: int, scores: list[int]) -> list[tuple]:
            got = windowed(b, v, own, np.array(scores, np.int64), least, most, negatives)
            return [(row, k, int(b.row[i]), int(b.id[i]), int(x)) for k, at, score in got for i, x in zip(at, score)]

        exact = bound < 2**53  # products and sums of doubles are whole numbers then
        first = blocks_of(vectors, asking.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks)
        first = scanned(first, size or 0, exact, "anchor bigint, row bigint, id bigint, score bigint", nearest)
        place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")) - 1
        best = held(first.withColumn("place", place).filter(F.col("place") < positives), "bond-positives")
        scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"])  # ``positives`` at most
        second = asking.join(best.groupBy(F.col("anchor").alias("row")).agg(scores.alias("scores")), "row")
        second = scanned(blocks_of(vectors, second, blocks), size or 0, exact, "anchor bigint, place bigint, row bigint, id bigint, score bigint", inside)
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row"))
        found = second.withColumn("rank", rank).filter(F.col("rank") <= negatives)
        found = found.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = best.join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        named = named.select("anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return written(out, "bond-negatives")


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
      from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.anchor_id, positive_id, positive_score, other as negative_id, score as negative_score,
      row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank
      from p join s on s.anchor_id = p.anchor_id where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100; every seventh id has the next label, as the contract sets it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
