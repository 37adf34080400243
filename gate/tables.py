"""Sources, cleaning, transformers and post-processing on the given tables."""

from __future__ import annotations

from datetime import datetime
from zlib import crc32

from pyspark.sql import functions as F

from gate.aggregates import _quantile, _quantile_sql
from gate.core import (
    CUSTOMER, FLAGS, LINEITEM, MODE, ORDERS, PRIORITIES, SEGMENTS, clamp, digest_sql, exact, lap, out, query, rounded, table, uni, unit, values,
)

from hushframe.functions.transform import Anonymize, Bins, Chain, Clamp, DaysSince, Label, MinMax, OneHot
from hushframe.metadata import TableMeta
from hushframe.ml.base import noisy_sums, unit_scaled
from hushframe.operators import clean as C
from hushframe.operators import post as P
from hushframe.operators.aggregate import private_agg
from hushframe.operators.measure import Measure
from hushframe.operators.order_stats import exact_quantiles
from hushframe.plans.primitives import avg, count, std
from hushframe.session import fresh_path, shared_dir
from hushframe.sources.dummy import CHARACTERS, dummy_like
from hushframe.sources.release import read_release, write_release
from hushframe.sources.tables import conformance, from_frame, iso_datetimes, read_private, split_lines, typed_decode

# -- sources ---------------------------------------------------------------------------------------------------

_ORDERS_FILE = TableMeta.from_dict({"columns": {
    "o_orderkey": {"type": "int", "precision": 64, "lower": 0, "upper": 2**40},
    "o_orderdate": {"type": "datetime", "lower": "1992-01-01", "upper": "2002-01-01"},
    "o_totalprice": {"type": "float", "precision": 64, "lower": 0, "upper": 500000},
    "o_orderpriority": {"type": "string"},
}})


@query("read_csv", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate, o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    path = fresh_path(spark, "orders") + ".csv"
    table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate").write.option("header", True).csv(path)
    return iso_datetimes(read_private(spark, _ORDERS_FILE, path))


@query("read_parquet", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate, o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return iso_datetimes(read_private(spark, _ORDERS_FILE, f"{sf}/orders.parquet"))


@query("from_frame", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf):
    return from_frame(CUSTOMER, table(spark, sf, "customer"))


@query("conformance", """select 'l_quantity' as "column", count(*) filter (where l_quantity > 40 or l_quantity < 5) as out_of_bounds, 0::bigint as out_of_domain,
 0::bigint as unexpected_nulls from lineitem union all select 'l_returnflag', 0, count(*) filter (where l_returnflag not in ('A', 'N')), 0 from lineitem
 union all select 'l_discount', count(*) filter (where l_discount > 0.05), 0, count(*) filter (where l_linenumber = 3) from lineitem where true""".replace(
    "count(*) filter (where l_discount > 0.05)", "count(*) filter (where l_discount > 0.05 and l_linenumber <> 3)"))
def _(spark, sf):
    meta = TableMeta.from_dict({"columns": {
        "l_quantity": {"type": "float", "precision": 64, "lower": 5.0, "upper": 40.0},
        "l_returnflag": {"type": "string", "cardinality": 2, "categories": ["A", "N"]},
        "l_discount": {"type": "float", "precision": 64, "lower": 0.0, "upper": 0.05}}})
    holes = table(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))
    return conformance(holes, meta)


_DUMMY = TableMeta.from_dict({"columns": {
    "kind": {"type": "string", "cardinality": 3, "categories": ["x", "y", "z"]}, "letter": {"type": "string"},
    "flag": {"type": "boolean", "nullable": True}, "small": {"type": "float", "precision": 64, "lower": 10.0, "upper": 20.0},
    "big": {"type": "int", "precision": 64, "lower": 100, "upper": 120},
    "day": {"type": "datetime", "lower": "2000-01-01", "upper": "2010-01-01"}}})


def _drawn(tag: str) -> str:
    return uni(tag, ["id"], seed=42)


_HOLES = " or ".join(f"id = floor({uni('flag|null', [], chr(39) + str(i) + chr(39), seed=42)} * n)" for i in range(5))


@query("dummy_table", f"""with r as (select c_custkey as id, n from customer, (select count(*) as n from customer) c)
 select id, ['x','y','z'][floor({_drawn('kind')} * 3)::int + 1] as kind, substr('{CHARACTERS}', floor({_drawn('letter')} * 62)::int + 1, 1) as letter,
 case when not ({_HOLES}) then {_drawn('flag')} < 0.5 end as flag, {out(f'10::double + 10::double * {_drawn('small')}', 'small')},
 (100 + floor({_drawn('big')} * 21))::bigint as big, strftime(timestamp '2000-01-01' + to_days(floor({_drawn('day')} * 3654)::int), '%Y-%m-%dT%H:%M:%S') as day from r""")
def _(spark, sf):
    customers = table(spark, sf, "customer")
    return iso_datetimes(rounded(dummy_like(customers, "c_custkey", _DUMMY, 42, customers.count())))


@query("read_mounted", "select c_mktsegment, count(*)::bigint as n, round(sum(c_acctbal), 2) as total from customer group by 1")
def _(spark, sf):
    """The table by a path that only Spark's file systems know, and a release written and read there."""
    shared, conf = shared_dir(spark), spark._jsc.hadoopConfiguration()
    name = f"gate{crc32(f'{sf} {shared}'.encode())}"  # mounts are kept by name
    for link, path in (("in", sf), ("out", shared)):
        conf.set(f"fs.viewfs.mounttable.{name}.link./{link}", path if "://" in path else f"file://{path}")
    release = f"viewfs://{name}/out/{fresh_path(spark, 'mounted').rsplit('/', 1)[-1]}"
    columns = {"c_mktsegment": {"type": "string"}, "c_acctbal": {"type": "float", "precision": 64, "lower": -1000, "upper": 10000}}
    rows = read_private(spark, TableMeta.from_dict({"columns": columns}), f"viewfs://{name}/in/customer.parquet")
    write_release(rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")), release)
    return read_release(spark, release)


@query("split_lines", "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def _(spark, sf):
    lines = table(spark, sf, "customer").select(F.concat_ws(";", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    return split_lines(lines, ";", ["c_custkey", "c_name", "c_mktsegment"])


@query("typed_decode", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate, o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    text = table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in _ORDERS_FILE.columns])
    return iso_datetimes(typed_decode(text, _ORDERS_FILE))


@query("iso_datetimes", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from events")
def _(spark, sf):
    return iso_datetimes(table(spark, sf, "events").select("event_id", "ts"))


@query("release_sink", f"with n as (select l_linestatus, count(*)::double + {lap('sink|count_rows', ['l_linestatus'], 1.0)} as c from lineitem group by 1) select l_linestatus, {out('c', 'n')} from n")
def _(spark, sf):
    noisy = private_agg(table(spark, sf, "lineitem"), LINEITEM, [count().alias("n")], epsilon=1.0, by=["l_linestatus"], noise=MODE, tag="sink")
    path = fresh_path(spark, "release")
    write_release(noisy, path)
    return rounded(read_release(spark, path))


# -- projection and cleaning ---------------------------------------------------------------------------------


@query("select_columns", "select c_custkey, c_mktsegment from customer")
def _(spark, sf):
    return C.select_cols(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"])


@query("single_column", "select l_discount from lineitem")
def _(spark, sf):
    return Measure(table(spark, sf, "lineitem")).column("l_discount").df


_MIXED = "case when c_custkey % 7 = 0 then null when c_custkey % 11 = 0 then 0 else c_custkey * 1.5::double end"


@query("cast_default", f"select c_custkey, coalesce({_MIXED}, 0::double) as value from customer")
def _(spark, sf):
    k = F.col("c_custkey")
    text = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit("n/a")).otherwise((k * 1.5).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", C.cast_default(text, "double").alias("value"))


@query("clamp", f"select c_custkey, {clamp('case when c_custkey % 5 <> 0 then c_acctbal end', 0.0, 5000.0)} as value from customer")
def _(spark, sf):
    from hushframe.operators.domain import clamped
    holes = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", clamped(holes, 0.0, 5000.0).alias("value"))


@query("resize_pad", f"select {clamp('c_acctbal', 0.0, 5000.0)} as c_acctbal from customer union all select 100::double from range((select count(*) // 3 from customer))")
def _(spark, sf):
    customers = table(spark, sf, "customer")
    n = customers.count()
    return Measure(customers, row_key=("c_custkey",)).column("c_acctbal").clamp(0.0, 5000.0).resize(n + n // 3, 100.0).resized()


@query("resize_truncate", (
    f"select {clamp('c_acctbal', 0.0, 5000.0)} as c_acctbal from (select *, row_number() over (order by {digest_sql(0, 'bound', ['c_custkey'])}, c_custkey) as r "
    f"from customer) where r <= (select count(*) // 3 from customer)"))
def _(spark, sf):
    customers = table(spark, sf, "customer")
    return Measure(customers, row_key=("c_custkey",)).column("c_acctbal").clamp(0.0, 5000.0).resize(customers.count() // 3, 100.0).resized()


@query("filtered_count", f"select {out(f'count(*)::double + {lap('since|count_rows', [], 1.0)}', 'n')} from lineitem where l_shipdate >= timestamp '1998-01-01'")
def _(spark, sf):
    return rounded(private_agg(table(spark, sf, "lineitem"), LINEITEM, [count().alias("n")], epsilon=1.0, where="l_shipdate >= timestamp '1998-01-01'",
                               noise=MODE, tag="since"))


# missing values made by the key, since the given tables hold none
_H = ("h as (select c_custkey, case when c_custkey % 5 <> 0 then c_acctbal end as c_acctbal, case when c_custkey % 3 <> 0 then c_nationkey end as c_nationkey, "
      "case when c_custkey % 4 <> 0 then c_mktsegment end as c_mktsegment from customer)")


def _holes(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(k % 3 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


def _mode(c: str) -> str:
    return f"(select {c} from h where {c} is not null group by 1 order by count(*) desc, {c} limit 1)"


@query("impute_drop", f"with {_H} select * from h where c_acctbal is not null and c_nationkey is not null and c_mktsegment is not null")
def _(spark, sf):
    return C.impute(_holes(spark, sf), "drop")


@query("impute_mean", (
    f"with {_H} select c_custkey, round(coalesce(c_acctbal, (select avg(c_acctbal) from h)), 4) as c_acctbal, "
    f"coalesce(c_nationkey, trunc((select avg(c_nationkey) from h))::int) as c_nationkey, coalesce(c_mktsegment, {_mode('c_mktsegment')}) as c_mktsegment from h"))
def _(spark, sf):
    return rounded(C.impute(_holes(spark, sf), "mean"), 4)


@query("impute_median", (
    f"with {_H} select c_custkey, round(coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from h)), 4) as c_acctbal, "
    f"coalesce(c_nationkey, trunc((select quantile_cont(c_nationkey, 0.5) from h))::int) as c_nationkey, coalesce(c_mktsegment, {_mode('c_mktsegment')}) as c_mktsegment from h"))
def _(spark, sf):
    return rounded(C.impute(_holes(spark, sf), "median"), 4)


@query("impute_most_frequent", (
    f"with {_H} select c_custkey, coalesce(c_acctbal, {_mode('c_acctbal')}) as c_acctbal, coalesce(c_nationkey, {_mode('c_nationkey')}) as c_nationkey, "
    f"coalesce(c_mktsegment, {_mode('c_mktsegment')}) as c_mktsegment from h"))
def _(spark, sf):
    return C.impute(_holes(spark, sf), "most_frequent")


_BAL = clamp("c_acctbal", -1000.0, 10000.0)


@query("impute_private", (
    f"with {_H}, m as (select ({exact(_BAL, 1e4)} + {lap('fill|sum_c_acctbal', [], 1e4)}) / (count(c_acctbal)::double + {lap('fill|count_c_acctbal', [], 1.0)}) as v from h) "
    f"select c_custkey, round(coalesce(c_acctbal, (select v from m)), 4) as c_acctbal from h"))
def _(spark, sf):
    return rounded(C.impute_private(_holes(spark, sf), CUSTOMER, ["c_acctbal"], 1.0, MODE, "fill").select("c_custkey", "c_acctbal"), 4)


@query("exact_quantiles", (
    "select 'l_extendedprice' as \"column\", round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(quantile_cont(l_extendedprice, 0.5), 6) as q50, "
    "round(quantile_cont(l_extendedprice, 0.9), 6) as q90 from lineitem union all select 'l_quantity', quantile_cont(l_quantity, 0.25), "
    "quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.9) from lineitem"))
def _(spark, sf):
    found = exact_quantiles(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.9])
    return rounded(spark.createDataFrame([(c, *q) for c, q in found.items()], "column string, q25 double, q50 double, q90 double"))


_REL = (f"with e as (select * from {values('o_orderpriority', [*PRIORITIES, '6-NEVER'])}), c as (select o_orderpriority, count(*) as n, "
        f"{exact(clamp('o_totalprice', 0.0, 5e5), 5e5)} as s from orders group by 1), "
        f"r as (select e.o_orderpriority, case when n is not null then o_orderpriority end as label, coalesce(n, 0) as n, s / n as mean from e left join c using (o_orderpriority))")


def _sparse_release(spark, sf):
    full = spark.createDataFrame([(p,) for p in [*PRIORITIES, "6-NEVER"]], "o_orderpriority string")
    c = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return full.join(c, "o_orderpriority", "left").select(
        "o_orderpriority", F.when(F.col("n").isNotNull(), F.col("o_orderpriority")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("fill_release", f"{_REL} select o_orderpriority, coalesce(label, '') as label, n, round(mean, 4) as mean from r")
def _(spark, sf):
    return rounded(C.fill_release(_sparse_release(spark, sf)), 4)


@query("release_defects", (
    f"{_REL} select count(*) as n_rows, count(*) - count(o_orderpriority) as missing_o_orderpriority, count(*) - count(label) as missing_label, "
    f"count(*) - count(n) as missing_n, count(*) - count(mean) as missing_mean from r"))
def _(spark, sf):
    return C.release_defects(_sparse_release(spark, sf))


@query("checked_release", "select o_orderpriority, count(*) as n from orders group by 1")
def _(spark, sf):
    stored = write_release(table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")))
    return C.check_release(stored)


# -- joins, order, split ---------------------------------------------------------------------------------------


@query("merge_releases", (
    f"with e as (select l_returnflag, count(*) as n, count(l_quantity) as c, {exact(clamp('l_quantity', 0.0, 50.0), 50.0)} as s from lineitem group by 1) "
    f"select l_returnflag, {out(f'n + {lap('mr1|count_rows', ['l_returnflag'], 1.0)}', 'n_size', 4)}, "
    f"{out(f'(s + {lap('mr2|sum_l_quantity', ['l_returnflag'], 50.0)}) / (c + {lap('mr2|count_l_quantity', ['l_returnflag'], 1.0)})', 'mean_quantity', 4)} from e"))
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    size = private_agg(li, LINEITEM, [count().alias("n")], epsilon=1.0, by=["l_returnflag"], noise=MODE, tag="mr1")
    mean = private_agg(li, LINEITEM, [avg("l_quantity").alias("mean")], epsilon=1.0, by=["l_returnflag"], noise=MODE, tag="mr2")
    return rounded(P.merge_releases({"size": size, "quantity": mean}, ["l_returnflag"]), 4)


@query("top_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _(spark, sf):
    return P.top(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query("train_test_split", f"select o_orderkey, {uni('split', ['o_orderkey'], seed=4)} < 0.2::double as is_test from orders")
def _(spark, sf):
    train, test = P.split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 4)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("explode_column", "select l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1))::int as draw from lineitem")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sequence(F.lit(1), "l_linenumber").alias("draw"))
    return P.explode_col(rows, "draw")


@query("append_by_name", "select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return P.append_rows(a, table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


@query("users_with_archive", "select distinct c_custkey from customer where c_custkey in (select o_custkey from orders)")
def _(spark, sf):
    return P.rows_with(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders"), {"c_custkey": "o_custkey"})


# -- transformers ----------------------------------------------------------------------------------------------

_CATS = "['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']"


@query("label_codes", f"with {_H} select c_custkey, coalesce(list_position({_CATS}, c_mktsegment) - 1, 5)::int as code, c_mktsegment as back from h")
def _(spark, sf):
    t = Label(tuple(SEGMENTS), nullable=True)
    coded = _holes(spark, sf).select("c_custkey", t.encode(F.col("c_mktsegment")).alias("code"))
    return coded.withColumn("back", t.decode(F.col("code")))


@query("one_hot_codes", f"select c_custkey, array_to_string(list_transform({_CATS}, lambda x: (x = c_mktsegment)::int), ',') as hot, c_mktsegment as back from customer")
def _(spark, sf):
    t = Chain((Label(tuple(SEGMENTS)), OneHot(len(SEGMENTS))))
    coded = table(spark, sf, "customer").select("c_custkey", t.encode(F.col("c_mktsegment")).alias("hot"))
    return coded.select("c_custkey", F.array_join(F.col("hot").cast("array<string>"), ",").alias("hot"), t.decode(F.col("hot")).alias("back"))


@query("min_max_scale", f"select c_custkey, round(({clamp('c_acctbal', 0.0, 8000.0)} - 0) * 0.00025::double - 1::double, 9) + 0.0::double as scaled, round({clamp('c_acctbal', 0.0, 8000.0)}, 6) as back from customer")
def _(spark, sf):
    t = MinMax(0.0, 8000.0)
    coded = table(spark, sf, "customer").select("c_custkey", t.encode(F.col("c_acctbal")).alias("scaled"))
    return coded.select("c_custkey", (F.round("scaled", 9) + 0.0).alias("scaled"), F.round(t.decode(F.col("scaled")), 6).alias("back"))


_BIN = f"least(9, floor(({_BAL} - -1000::double) / 11000::double * 10::double)::int)"


@query("bin_codes", f"select c_custkey, {_BIN} as code, round(-1000::double + ({_BIN} + 0.5::double) * 1100::double, 6) as middle from customer")
def _(spark, sf):
    t = Bins(-1000.0, 10000.0, 10)
    coded = table(spark, sf, "customer").select("c_custkey", t.encode(F.col("c_acctbal")).alias("code"))
    return coded.withColumn("middle", F.round(t.decode(F.col("code")), 6))


@query("days_since", "select event_id, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01'))::double / 86400000000::double, 6) as days, strftime(ts, '%Y-%m-%dT%H:%M:%S') as back from events")
def _(spark, sf):
    t = DaysSince(datetime(2024, 1, 1))
    coded = table(spark, sf, "events").select("event_id", t.encode(F.col("ts")).alias("days"))
    return iso_datetimes(coded.select("event_id", F.round("days", 6).alias("days"), t.decode(F.col("days")).alias("back")))


@query("anonymize", "select c_custkey, md5(concat_ws('|', '3', 'anonymize', c_custkey::varchar, '0')) as alias from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", Anonymize(3).encode(F.col("c_custkey")).alias("alias"))


@query("anonymize_fresh", "select c_mktsegment, count(*) as n, count(*) as n_aliases, count(*) as n_random_ids from customer group by 1")
def _(spark, sf):
    """Fresh ids differ from run to run: what is compared is that each row has one of its own, of random-uuid shape."""
    rows = table(spark, sf, "customer").select("c_mktsegment", Anonymize().encode(F.col("c_custkey")).alias("alias"))
    shaped = F.col("alias").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("alias").alias("n_aliases"), F.count_if(shaped).alias("n_random_ids"))


@query("clamp_transformer", f"select c_custkey, {clamp('c_acctbal', 0.0, 9000.0)} as c_acctbal from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", Clamp(0.0, 9000.0).encode(F.col("c_acctbal")).alias("c_acctbal"))


# -- errors, intervals, tests -----------------------------------------------------------------------------------

_MOM = (
    "e as (select l_returnflag, count(l_extendedprice) as c, {s} as s, {q} as q from lineitem group by 1), "
    "m as (select l_returnflag, c + {nc} as n, s + {ns} as s, q + {nq} as q from e), "
    "r as (select l_returnflag, n, s / n as mean, sqrt(greatest(0, q / n - (s / n) * (s / n))) as deviation from m)"
).format(
    s=exact(clamp("l_extendedprice", 0.0, 1e5), 1e5), q=exact(f"{clamp('l_extendedprice', 0.0, 1e5)} * {clamp('l_extendedprice', 0.0, 1e5)}", 1e10),
    nc=lap("stat|count_l_extendedprice", ["l_returnflag"], 1.0), ns=lap("stat|sum_l_extendedprice", ["l_returnflag"], 1e5),
    nq=lap("stat|sumsq_l_extendedprice", ["l_returnflag"], 1e10))


def _stats(spark, sf):
    aggs = [count("l_extendedprice").alias("n"), avg("l_extendedprice").alias("mean"), std("l_extendedprice").alias("deviation")]
    return private_agg(table(spark, sf, "lineitem"), LINEITEM, aggs, epsilon=1.0, by=["l_returnflag"], noise=MODE, tag="stat")


@query("confidence_interval", (
    f"with {_MOM} select l_returnflag, {out('deviation / sqrt(n)', 'error', 4)}, {out('mean - 1.96::double * deviation / sqrt(n)', 'low', 3)}, "
    f"{out('mean + 1.96::double * deviation / sqrt(n)', 'high', 3)}, {out('sqrt(deviation * deviation / n)', 'error_of_variance', 4)} from r"))
def _(spark, sf):
    s = _stats(spark, sf)
    error = P.std_error(F.col("deviation"), F.col("n"))
    low, high = P.confidence_interval(F.col("mean"), error)
    again = P.std_error_of_variance(F.col("deviation") * F.col("deviation"), F.col("n"))
    return s.select("l_returnflag", (F.round(error, 4) + 0.0).alias("error"), (F.round(low, 3) + 0.0).alias("low"), (F.round(high, 3) + 0.0).alias("high"),
                    (F.round(again, 4) + 0.0).alias("error_of_variance"))


_POOLED = ("(a.mean - b.mean) / sqrt(((a.n - 1) * a.deviation * a.deviation + (b.n - 1) * b.deviation * b.deviation) / (a.n + b.n - 2) "
           "* (1::double / a.n + 1::double / b.n))")


@query("t_tests", (
    f"with {_MOM} select a.l_returnflag as group_a, b.l_returnflag as group_b, {out(_POOLED, 't')}, {out('a.n + b.n - 2', 'degrees', 4)} "
    f"from r a join r b on a.l_returnflag < b.l_returnflag"))
def _(spark, sf):
    t = P.t_tests(_stats(spark, sf), "l_returnflag", ["A", "N", "R"], "mean", "deviation", "n")
    return t.select("group_a", "group_b", (F.round("t", 6) + 0.0).alias("t"), (F.round("degrees", 4) + 0.0).alias("degrees"))


_SLOPE = {"x": "q", "y": "p", "xx": "q * q", "xy": "q * p", "yy": "p * p"}
_SLOPE_Q, _SLOPE_P = unit("l_quantity", 0.0, 50.0), unit("l_extendedprice", 0.0, 100000.0)


@query("slope_test", (
    f"with u as (select l_returnflag, {_SLOPE_Q} as q, {_SLOPE_P} as p from lineitem), "
    f"e as (select l_returnflag, count(*)::double as n, {', '.join(f'{exact(x, 1.0)} as {k}' for k, x in _SLOPE.items())} from u group by 1), "
    f"s as (select l_returnflag, {', '.join(f'{k} + {lap(f'slope|{k}', ['l_returnflag'], 3.0)} as {k}' for k in ['n', *_SLOPE])} from e), "
    "m as (select l_returnflag, n, (xx - x * x / n) / (n - 1) as vx, (yy - y * y / n) / (n - 1) as vy, (xy - x * y / n) / (n - 1) as c from s) "
    "select l_returnflag, round(sqrt((1::double - c * c / (vx * vy)) * vy / (vx * (n - 2))), 6) as error, "
    "round(c / vx / sqrt((1::double - c * c / (vx * vy)) * vy / (vx * (n - 2))), 4) as t from m"))
def _(spark, sf):
    """From a release of noisy moments on the unit scale, not from the rows."""
    u = unit_scaled({"l_quantity": (0.0, 50.0), "l_extendedprice": (0.0, 100000.0)})
    q, p = u["l_quantity"], u["l_extendedprice"]
    sums = {k: (c, 1.0) for k, c in {"x": q, "y": p, "xx": q * q, "xy": q * p, "yy": p * p}.items()}
    s = noisy_sums(table(spark, sf, "lineitem"), sums, 2.0, MODE, "slope", by={"l_returnflag": FLAGS}, counts=("n",))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    m = s.select("l_returnflag", "n", ((F.col("xx") - x * x / n) / (n - 1)).alias("vx"), ((F.col("yy") - y * y / n) / (n - 1)).alias("vy"), ((F.col("xy") - x * y / n) / (n - 1)).alias("c"))
    m = m.withColumns({"r2": F.col("c") * F.col("c") / (F.col("vx") * F.col("vy")), "b": F.col("c") / F.col("vx")})
    error, t = P.slope_test(F.col("r2"), F.col("vy"), F.col("vx"), F.col("n"), F.col("b"))
    return m.select("l_returnflag", F.round(error, 6).alias("error"), F.round(t, 4).alias("t"))


@query("recode", "select c_custkey, case c_nationkey % 4 when 0 then 'north' when 1 then 'south' when 2 then 'east' end as side from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", P.recode(F.col("c_nationkey") % 4, {0: "north", 1: "south", 2: "east"}).alias("side"))


_FAN = ", ".join(f"{c} as ({_quantile_sql(q)})" for c, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)))


@query("quantile_fan", (
    f"with {_FAN}, q as (select l_returnflag, lo.quantile as lo, mid.quantile as mid, hi.quantile as hi from lo join mid using (l_returnflag) join hi using (l_returnflag)), "
    f"d as (select *, range::int as draw from q, range(100)), u as (select *, {uni('fan', ['l_returnflag'], 'draw::varchar')} as u from d) "
    f"select l_returnflag, draw, round(case when draw < 50 then lo + u * (mid - lo) else mid + u * (hi - mid) end, 6) as value from u"))
def _(spark, sf):
    """From released quantiles, not from the rows."""
    lo, mid, hi = (_quantile(spark, sf, q).withColumnRenamed("quantile", n) for n, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)))
    return rounded(P.quantile_fan(lo.join(mid, "l_returnflag").join(hi, "l_returnflag"), ["l_returnflag"], "lo", "mid", "hi", 7))
