"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A budget is shared over sources by weight; no source gives more than ``max_epochs`` times its own size, what it
cannot give is shared over the others by weight until none is above.  That fixed point has a closed form: with
sources in order of size / weight, the first ones are clamped, and all others get weight times one common level.

The target of a source is then drawn from its documents: with q = target / size, every document is repeated
floor(q) times whole, and a seeded order of the source's documents picks those that are taken once more, the
document at the cut in part.  Ties and hot sources: the order is by md5 of (seed, id), then id, and is summed in
two levels (buckets of the order, then documents of the one bucket that holds the cut), so a source with a third
of all rows is no single task's work.

Defined results: null text has size 0; rows without an id are told apart by their text, equal ones in ``mix_documents`` by their row; null sources are one source, the last; documents of
size 0 take 0 words; an empty table gives an empty table.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.llm.catalog import query, table
from hushframe.llm.simhash import with_rows
from hushframe.session import written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3  # 16^3 buckets of a source's order


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_filling(sizes: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source in and out.

    Weights are given by rank of the source name, repeating.  If even the caps give less than the budget, every
    target is its cap.  The windows run over one row per source, never over documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    listed = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("rank", rank).withColumn("weight", F.element_at(listed, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "budget": F.sum("source_size").over(whole) * F.lit(float(share)),
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("budget") - F.col("clamped")) / F.col("open_weight"))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)["level"]
    return filled.withColumn("common", level).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("common") * F.col("weight")), F.col("cap")).alias("target"))


def mixed(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0,
          text: str = "text", id: str = "doc_id", source: str = "source", row: str | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, whole (repetitions), part (words of one more), taken.

    ``row`` names a column that numbers the rows.  It is then kept as ``row`` and ends the order.  Rows without an id are
    ordered by a hash of their text, which spreads them over the buckets.
    """
    more = [] if row is None else ["row"]
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), name))
    slim = written(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
                               key.alias("key"), *[F.col(f"`{row}`").alias(m) for m in more]), "mix-sizes")
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    buckets = slim.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    filled = water_filling(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), list(weights), share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = filled.withColumn("whole", F.floor(rate).cast("bigint")).withColumn(
        "extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
    start = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    marks = buckets.withColumn("start", F.coalesce(start, F.lit(0))).withColumnRenamed("source", "of").join(plan, F.col("of").eqNullSafe(F.col("source"))).drop("of")
    marks = written(marks.withColumnRenamed("bucket", "b"), "mix-buckets")  # sources x 16^BUCKET_DIGITS rows at most
    rows = slim.withColumnRenamed("source", "s").withColumn("bucket", bucket)
    # Whole buckets before or after the cut are decided by their totals; one bucket per source is ordered by document.
    rows = rows.join(marks, F.col("s").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    state = F.when(F.col("start") + F.col("words") <= F.col("extra"), 1).when(F.col("start") >= F.col("extra"), -1).otherwise(0)
    rows = rows.withColumn("state", state)
    order = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.filter("state = 0").withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = cut.withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("extra") - F.col("at"))))
    sure = rows.filter("state <> 0").withColumn("part", F.when(F.col("state") > 0, F.col("size")).otherwise(F.lit(0)))
    columns = ["id", "source", "size", "source_size", "target", "whole", F.col("part").cast("bigint").alias("part"), *more]
    out = sure.select(*columns).unionByName(cut.select(*columns))
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mix_documents(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0,
                  text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken.

    A document taken in part once more appears whole, so a source overshoots its target by less than one document.
    Copies are equal rows.  Every row has its own number of copies, whatever its id.
    """
    stored = with_rows(docs)
    plan = mixed(stored.select("row", *[F.col(f"d.`{c}`").alias(n) for c, n in ((text, "text"), (id, "id"), (source, "source"))]),
                 weights, share, max_epochs, seed, "text", "id", "source", "row")
    times = plan.select("row", (F.col("whole") + (F.col("part") > 0).cast("bigint")).alias("times")).filter("times > 0")
    taken = stored.join(times, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return taken.select(*[F.col(f"d.`{c}`") for c in docs.columns])


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
       md5(concat_ws('|', '0', coalesce(doc_id::varchar, '|' || md5(coalesce(text, ''))))) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source is null, encode(source)) as rank, source_size * 2.0::double as cap from s),
w as (select *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::int]::double as weight, (select sum(source_size) from s)::double * 1.5::double as budget from r),
o as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) /
       sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from w),
l as (select arg_min(level, (cap / weight, rank)) filter (level * weight <= cap) as common from o),
t as (select source, source_size, coalesce(least(cap, common * weight), cap) as target from w, l),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
q as (select *, round(target - whole * source_size)::bigint as extra from p),
c as (select d.doc_id, d.size, q.source_size, q.target, q.whole, q.extra,
       coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as place
      from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, round(target, 6) as target, (whole * size + least(size, greatest(0, extra - place)))::bigint as taken from c
"""


@query("op9_mixing", SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.5 times all words, weights 5, 2, 1 by rank of the source, at most 2 epochs of a source."""
    plan = mixed(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")
