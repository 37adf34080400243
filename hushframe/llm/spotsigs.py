"""SpotSigs fingerprints: chains of content words after common words, compared by Jaccard likeness.

Common words are the corpus's own: those in the most documents.  Every common word, and the start of the text, is an
anchor; after ``GAP`` content words in a row the next word is one too, for lists and tables without common words.  A
signature is the anchor and the next ``chain`` content words, common words in between skipped; a text too short for a
chain has its words as signatures, an empty text one of its own.  Equal texts always have equal fingerprints.  Sets of signatures of likeness t differ in length by a factor of
1/t at most: the join deals sets by length class, meets them on their rarest signatures only, and drops a pair by its
lengths before it is compared.

Only DataFrame functions are used.  Words are runs of letters and digits, lower-cased.  Null text counts as empty; null
ids come last in the order of ids, ties are ordered by a hash of the text; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.ranges import edges_at_or_below
from hushframe.llm.catalog import query, table
from hushframe.session import written

COMMON = 100  # common words of a corpus
CHAIN = 2
GAP = 4
MARK = "\u0001"
WIDTH = 8  # hex digits of a signature
ROWS = 2_000  # documents of a range of ids
RANGES = 100_000  # ranges at most
QUANTILES = 31


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def common_words(docs: DataFrame, text: str = "text", size: int = COMMON) -> list[str]:
    """The words that are in the most documents; ``size`` strings reach the driver."""
    words = docs.select(F.explode(F.array_distinct(F.split(normalised(F.col(f"`{text}`")), " "))).alias("w")).filter("w <> ''")
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def with_signatures(df: DataFrame, text: str, name: str, common: list[str], chain: int = CHAIN) -> DataFrame:
    """Adds the sorted distinct signatures of a text as longs of ``WIDTH`` hex digits; ``df`` has no column ``__…``.

    Each step is a column of its own, so that Spark computes it once per text.
    """
    word, skip = f"[^ {MARK}][^ ]*+", f"(?: {MARK}[^ ]++)*+"
    pattern = f"{MARK}(?=([^ ]++" + (skip + f" {word}") * chain + "))"
    marked = F.col("__norm")
    if common:  # common words are runs of letters and digits: nothing in them to escape
        marked = F.regexp_replace(marked, "(?<![^ ])(?:" + "|".join(sorted(common)) + ")(?![^ ])", MARK + "$0")
    df = df.withColumn("__norm", normalised(F.col(text))).withColumn("__marked", F.concat(F.lit(MARK + ". "), marked))
    # The extra anchor stands before its word, which stays a content word of other chains.
    df = df.withColumn("__marked", F.regexp_replace("__marked", f"((?: {word}){{{GAP}}}+)(?= [^{MARK}])", f"$1 {MARK}-"))
    df = df.withColumn("__chains", F.regexp_extract_all("__marked", F.lit(pattern), F.lit(1)))
    found = F.transform("__chains", lambda c: _number(F.regexp_replace(c, f" {MARK}[^ ]+", "")))
    signs = F.when(F.size("__chains") > 0, found).otherwise(F.transform(F.split("__norm", " "), _number))
    df = df.withColumn("__signs", signs).withColumn(name, F.sort_array(F.array_distinct("__signs")))
    return df.drop("__norm", "__marked", "__chains", "__signs")


def _number(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 4 * WIDTH) - 1))


def fingerprint(signs: Column) -> Column:
    """The whole set as text."""
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s)), WIDTH, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without comparing where their lengths rule out ``least``."""
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both).cast("double")
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(short < F.lit(float(least)) * long, F.lit(0.0)).otherwise(exact)


def spot_sets(docs: DataFrame, common: list[str] | None = None, text: str = "text", id: str = "doc_id", chain: int = CHAIN) -> DataFrame:
    """(id, print, signs): the fingerprint of every document."""
    common = common_words(docs, text) if common is None else common
    rows = with_signatures(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", "signs", common, chain)
    return rows.select("id", F.sha2(fingerprint(F.col("signs")), 256).alias("print"), "signs")


def similar_documents(docs: DataFrame, least: float = 0.8, common: list[str] | None = None, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, print) of every document, and (print_a, print_b, likeness) of distinct fingerprints.

    Of a set of n signatures the n - ceil(least * n) + 1 rarest meet at least one of any set that is alike enough.
    """
    sets = written(spot_sets(docs, common, text, id), "spot-sets")
    distinct = written(sets.groupBy("print").agg(F.first("signs").alias("signs")), "spot-distinct")
    signs = distinct.select("print", F.size("signs").alias("n"), F.explode("signs").alias("s"))
    often = signs.groupBy("s").agg(F.count("*").alias("often"))
    ranked = signs.join(often, "s").withColumn("rank", F.row_number().over(Window.partitionBy("print").orderBy("often", "s")))
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    step = math.log(1 / least) if least < 1 else 1.0
    prefix = prefix.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
    left = prefix.select(F.col("print").alias("print_a"), F.col("n").alias("na"), "s", F.explode(F.array("class", F.col("class") + 1)).alias("class"))
    right = prefix.select(F.col("print").alias("print_b"), F.col("n").alias("nb"), "s", "class")
    near = (F.col("nb") > F.col("na")) | (F.col("nb") == F.col("na")) & (F.col("print_a") < F.col("print_b"))
    pairs = left.join(right, ["s", "class"]).filter(near & (F.col("na") >= F.col("nb") * least - 1e-9)).select("print_a", "print_b").distinct()
    a, b = (distinct.select(F.col("print").alias(f"print_{x}"), F.col("signs").alias(x)) for x in "ab")
    alike = pairs.join(a, "print_a").join(b, "print_b").withColumn("likeness", likeness(F.col("a"), F.col("b"), least)).filter(F.col("likeness") >= least)
    return sets.select("id", "print"), alike.select("print_a", "print_b", "likeness")


def with_next(docs: DataFrame, text: str = "text", id: str = "doc_id", add: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(id, text, next_text, what ``add`` adds to a text and its next_ columns) of every document and the one after it by descending id; after the last comes the first.

    Texts are shuffled once, by ranges of ids; a range also gets the first document of the next one as a guest.
    """
    key = F.col(f"`{id}`").cast("bigint")
    rows = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marks = rows.agg(F.count("*").alias("n"), F.count("id").alias("known"), F.min("id").alias("least"), F.max("id").alias("most"),
                     F.percentile_approx("id", [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)], 10_000).alias("cuts")).first()
    cuts = sorted(set(marks["cuts"] or []))
    share = max(1, math.ceil(min(marks["known"] / ROWS, RANGES) / (len(cuts) + 1)))  # ranges of equal width between two cuts
    nameless = max(1, math.ceil(min((marks["n"] - marks["known"]) / ROWS, RANGES)))  # ranges of rows without an id, by a hash of the text
    lows, highs = [marks["least"] or 0, *cuts], [*cuts, (marks["most"] or 0) + 1]
    at = edges_at_or_below(F.col("id"), cuts) if cuts else F.lit(0)
    low, width = (F.element_at(F.array(*[F.lit(int(v)) for v in vs]), at + 1) for vs in (lows, [max(1, -(-(b - a) // share)) for a, b in zip(lows, highs)]))
    by_id = at.cast("bigint") * share + F.least(F.floor((F.col("id") - low) / width), F.lit(share - 1))
    by_text = F.lit(-1) - F.least(F.floor((F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(float(nameless))), F.lit(nameless - 1))
    ranged = F.when(F.col("id").isNull(), by_text).otherwise(by_id).cast("bigint")
    first_of = F.struct(F.bitwise_not("id").alias("low"), F.when(F.col("id").isNull(), F.xxhash64("text")).alias("hash"))  # by descending id, then by hash
    tops = rows.withColumn("range", ranged).groupBy("range").agg(F.min(first_of).alias("top"))
    ring = Window.orderBy(F.desc("range"))
    first = F.first("top").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.lead("range").over(ring).isNull()
    guests = tops.select(F.when(last, first).otherwise(F.lead("top").over(ring)).alias("guest"), F.col("range").alias("host"))
    guests = written(guests, "spot-guests")  # one row per range, a few times RANGES at most
    hosts = F.broadcast(guests.groupBy("guest").agg(F.collect_list("host").alias("hosts")))
    placed = rows.withColumn("__first", first_of)
    same = F.col("__first.low").eqNullSafe(F.col("guest.low")) & F.col("__first.hash").eqNullSafe(F.col("guest.hash"))
    invited = placed.join(hosts, same).select("id", "text", F.explode("hosts").alias("range"))
    # of rows that share an id, or the text where there is none, one is the guest
    invited = invited.groupBy("range", "id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "range", F.lit(1).alias("guest"))
    placed = rows.select("id", "text", ranged.alias("range"), F.lit(0).alias("guest")).unionByName(invited)
    order = [F.col("guest"), F.col("id").desc_nulls_last(), F.xxhash64("text")]
    dealt = placed.repartition("range").sortWithinPartitions("range", *order)  # texts are dealt first, what is added is not shuffled
    added = add(dealt)
    window = Window.partitionBy("range").orderBy(*order)
    names = ["text", *[c for c in added.columns if c not in dealt.columns]]
    return added.withColumns({f"next_{n}": F.lead(n).over(window) for n in names}).filter("guest = 0").drop("range", "guest")


@query("op3_spotsigs")
def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    common = common_words(docs)
    rows = with_next(docs, add=lambda df: with_signatures(df, "text", "signs", common))
    n = F.char_length("text").cast("bigint")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third)))
    rows = with_signatures(rows, "edited", "edited_signs", common)
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"), likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))
