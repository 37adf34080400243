"""Private aggregates, quantiles, marginals and noise mechanisms, with SQL that draws the same noise."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gate.core import (
    CUSTOMER, FLAGS, LINEITEM, MODE, ORDERS, PRIORITIES, SEGMENTS, SHORT_GROUPS, STATUSES, clamp, digest_sql, exact, gauss, gum, lap, num, out, query,
    rounded, table, uni, values,
)
from hushframe.functions.noise import Noise, add_discrete_laplace, add_gaussian, add_laplace, add_noise, select_noisy_max, threshold
from hushframe.operators.aggregate import PrivateQuery, compose, private_agg
from hushframe.operators.bounding import bound_contributions, bound_partition_length, bound_partitions
from hushframe.operators.marginals import margins, private_histogram, private_marginals, private_quantile
from hushframe.operators.measure import Measure
from hushframe.plans.accounting import gaussian_sigma
from hushframe.plans.primitives import avg, count, std, sum_, var

LI = "lineitem"
Q = clamp("l_quantity", 0.0, 50.0)
P = clamp("l_extendedprice", 0.0, 100000.0)


def _grouped(select: str, prims: dict[str, str], tag: str, epsilon: float, bounds: dict[str, float], rows: str = "lineitem",
             by: str = "l_returnflag", domain: list = FLAGS, max_ids: int = 1, where: str = "", final: str = "") -> str:
    """SQL of a grouped private query: exact primitives, public keys, Laplace noise, derived columns."""
    inner = ", ".join(f"{e} as {n}" for n, e in prims.items())
    noisy = ", ".join(f"coalesce({n}, 0)::double + {lap(f'{tag}|{n}', [f'd.{by}'], max_ids * bounds[n] / epsilon)} as {n}" for n in prims)
    return (
        f"with e as (select {by}, {inner} from {rows} {where} group by {by}), "
        f"n as (select d.{by}, {noisy} from (select * from {values(by, domain)}) d left join e on d.{by} = e.{by}) "
        f"select {by}, {select} from n {final}"
    )


# -- counts, sums, averages, deviations ------------------------------------------------------------------------


@query("private_count", f"select {out(f'count(*)::double + {lap('all|count_rows', [], 2.0)}', 'n')} from lineitem")
def _(spark, sf):
    return rounded(private_agg(table(spark, sf, LI), LINEITEM, [count().alias("n")], epsilon=0.5, noise=MODE, tag="all"))


@query("private_count_column", f"select {out(f'count(l_quantity)::double + {lap('col|count_l_quantity', [], 1.0)}', 'n')} from lineitem")
def _(spark, sf):
    return rounded(private_agg(table(spark, sf, LI), LINEITEM, [count("l_quantity").alias("n")], epsilon=1.0, noise=MODE, tag="col"))


@query("private_sum", (
    f"select {out(f'{exact(Q, 50.0)} + {lap('sums|sum_l_quantity', [], 50.0)}', 'quantity', 4)}, "
    f"{out(f'''{exact(clamp('l_linenumber', 1, 7), 7.0)} + {lap('sums|sum_l_linenumber', [], 7.0)}''', 'lines', 4)} from lineitem"))
def _(spark, sf):
    aggs = [sum_("l_quantity").alias("quantity"), sum_("l_linenumber").alias("lines")]
    return rounded(private_agg(table(spark, sf, LI), LINEITEM, aggs, epsilon=1.0, noise=MODE, tag="sums"), 4)


@query("private_avg", (
    f"with n as (select count(l_quantity)::double + {lap('avg|count_l_quantity', [], 1.0)} as c, "
    f"{exact(Q, 50.0)} + {lap('avg|sum_l_quantity', [], 50.0)} as s from lineitem) select {out('s / c', 'mean')} from n"))
def _(spark, sf):
    return rounded(private_agg(table(spark, sf, LI), LINEITEM, [avg("l_quantity").alias("mean")], epsilon=1.0, noise=MODE, tag="avg"))


def _moments_sql(tag: str, last: str, name: str) -> str:
    return (
        f"with n as (select count(l_extendedprice)::double + {lap(f'{tag}|count_l_extendedprice', [], 1.0)} as c, "
        f"{exact(P, 1e5)} + {lap(f'{tag}|sum_l_extendedprice', [], 1e5)} as s, "
        f"{exact(f'{P} * {P}', 1e10)} + {lap(f'{tag}|sumsq_l_extendedprice', [], 1e10)} as q from lineitem) "
        f"select {out(last, name, 3)} from n")


@query("private_std", _moments_sql("std", "sqrt(greatest(0, q / c - (s / c) * (s / c)))", "deviation"))
def _(spark, sf):
    return rounded(private_agg(table(spark, sf, LI), LINEITEM, [std("l_extendedprice").alias("deviation")], epsilon=1.0, noise=MODE, tag="std"), 3)


@query("private_var", _moments_sql("var", "greatest(0, q / c - (s / c) * (s / c)) / 1000000", "variance_millions"))
def _(spark, sf):
    df = private_agg(table(spark, sf, LI), LINEITEM, [var("l_extendedprice").alias("v")], epsilon=1.0, noise=MODE, tag="var")
    return rounded(df.select((F.col("v") / 1e6).alias("variance_millions")), 3)


@query("private_group_by", _grouped(
    f"{out('count_rows', 'n', 4)}, {out('case when count_l_quantity > 0 then sum_l_quantity / count_l_quantity end', 'mean', 4)}",
    {"count_rows": "count(*)", "count_l_quantity": "count(l_quantity)", "sum_l_quantity": exact(Q, 50.0)}, "flags", 0.5,
    {"count_rows": 1.0, "count_l_quantity": 1.0, "sum_l_quantity": 50.0}, domain=[*FLAGS, "X"]))
def _(spark, sf):
    df = private_agg(table(spark, sf, LI), LINEITEM, [count().alias("n"), avg("l_quantity").alias("mean")], epsilon=0.5,
                     by=["l_returnflag"], domains={"l_returnflag": [*FLAGS, "X"]}, noise=MODE, tag="flags")
    return rounded(df, 4)


@query("private_group_by_censored", (
    f"with e as (select o_orderdate::date as k, count(*)::double as c from orders group by 1), "
    f"n as (select strftime(k, '%Y-%m-%d') as day, c from e), "
    f"m as (select day, c + {lap('days|count_rows', ['day'], 1.0 / 0.05)} as n from n) "
    f"select day, {out('n', 'n', 4)} from m where n >= {num(1.0 - math.log(2.0 - 2.0 * (1.0 - 0.05)) / 0.05)}"))
def _(spark, sf):
    days = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    meta = type(LINEITEM).from_dict({"max_ids": 1, "rows": 15000, "row_privacy": True, "columns": {"day": {"type": "string"}}})
    return rounded(private_agg(days, meta, [count().alias("n")], epsilon=0.05, delta=0.05, by=["day"], censor=True, noise=MODE, tag="days"), 4)


_SHARED = {
    "count_l_extendedprice": ("count(l_extendedprice)", 1.0), "sum_l_extendedprice": (exact(P, 1e5), 1e5),
    "sumsq_l_extendedprice": (exact(f"{P} * {P}", 1e10), 1e10),
}


@query("private_shared_primitives", _grouped(
    "round(count_l_extendedprice, 3) + 0.0::double as n, round(sum_l_extendedprice / count_l_extendedprice, 3) + 0.0::double as mean, "
    "round(sqrt(greatest(0, sumsq_l_extendedprice / count_l_extendedprice - (sum_l_extendedprice / count_l_extendedprice) * "
    "(sum_l_extendedprice / count_l_extendedprice))), 3) + 0.0::double as deviation",
    {k: v[0] for k, v in _SHARED.items()}, "shared", 1.0, {k: v[1] for k, v in _SHARED.items()}))
def _(spark, sf):
    aggs = [count("l_extendedprice").alias("n"), avg("l_extendedprice").alias("mean"), std("l_extendedprice").alias("deviation")]
    return rounded(private_agg(table(spark, sf, LI), LINEITEM, aggs, epsilon=1.0, by=["l_returnflag"], noise=MODE, tag="shared"), 3)


# -- contribution bounding -------------------------------------------------------------------------------------

_ORDER = digest_sql(0, "bound", ["o_orderkey"])


@query("bound_contributions", (
    f"select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by {_ORDER}, o_orderkey) as r "
    f"from orders) where r <= 5"))
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return bound_contributions(rows, "o_custkey", 5, ["o_orderkey"])


_PAIRS = (
    f"with a as (select *, row_number() over (partition by o_custkey, o_orderpriority order by {_ORDER}, o_orderkey) as r from orders), "
    f"b as (select *, dense_rank() over (partition by o_custkey order by {digest_sql(0, 'group', ['o_custkey', 'o_orderpriority'])}, "
    f"o_orderpriority) as g from a where r <= 2)")


@query("bound_partitions", f"{_PAIRS} select o_orderkey, o_custkey, o_orderpriority from b where g <= 2")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return bound_partitions(rows, "o_custkey", ["o_orderpriority"], 2, 2, ["o_orderkey"])


@query("bound_partition_length", (
    f"select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by {_ORDER}, o_orderkey) as r "
    f"from orders) where r <= 1500"))
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return bound_partition_length(rows, "o_orderpriority", 1500, ["o_orderkey"])


_TP = clamp("o_totalprice", 0.0, 500000.0)
_UNIT_ROWS = (
    f"{_PAIRS}, u as (select * from (select *, row_number() over (partition by o_custkey order by {_ORDER}, o_orderkey) as k from b "
    f"where g <= 2) where k <= 4)")


@query("private_sum_by_unit", (
    f"{_UNIT_ROWS}, e as (select o_orderpriority, count(*) as c, {exact(_TP, 5e5)} as s from u group by 1), "
    f"n as (select d.o_orderpriority, coalesce(c, 0)::double + {lap('unit|count_rows', ['d.o_orderpriority'], 4.0)} as c, "
    f"coalesce(s, 0) + {lap('unit|sum_o_totalprice', ['d.o_orderpriority'], 4 * 5e5)} as s "
    f"from (select * from {values('o_orderpriority', PRIORITIES)}) d left join e using (o_orderpriority)) "
    f"select o_orderpriority, {out('c', 'n', 3)}, {out('s', 'total', 3)} from n"))
def _(spark, sf):
    df = private_agg(table(spark, sf, "orders"), ORDERS, [count().alias("n"), sum_("o_totalprice").alias("total")], epsilon=1.0,
                     by=["o_orderpriority"], row_key=["o_orderkey"], noise=MODE, tag="unit")  # the unit is the declared private id
    return rounded(df, 3)


@query("private_count_bounded_length", (
    f"with u as (select * from (select *, row_number() over (partition by o_orderpriority order by {_ORDER}, o_orderkey) as r from orders) where r <= 1500), "
    f"e as (select o_orderpriority, count(*) as c, {exact(clamp('o_totalprice', 1000.0, 500000.0), 5e5)} as s from u group by 1), "
    f"n as (select d.o_orderpriority, coalesce(c, 0)::double + {lap('length|count_rows', ['d.o_orderpriority'], 1.0)} as c, "
    f"coalesce(s, 0) + {lap('length|sum_o_totalprice', ['d.o_orderpriority'], 5e5)} as s "
    f"from (select * from {values('o_orderpriority', PRIORITIES)}) d left join e using (o_orderpriority)) "
    f"select o_orderpriority, {out('c', 'n', 3)}, {out('s', 'total', 3)} from n"))
def _(spark, sf):
    df = private_agg(table(spark, sf, "orders"), SHORT_GROUPS, [count().alias("n"), sum_("o_totalprice").alias("total")], epsilon=1.0,
                     by=["o_orderpriority"], row_key=["o_orderkey"], noise=MODE, tag="length")
    return rounded(df, 3)


# A third of the prices missing, as null or NaN.
_GAPS = "(select l_returnflag, case when l_linenumber = 1 then null when l_linenumber = 2 then 'nan'::double else l_extendedprice end as l_extendedprice from lineitem) as lineitem"


def _with_gaps(spark, sf):
    price = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") != 1, F.col("l_extendedprice"))
    return table(spark, sf, LI).select("l_returnflag", price.alias("l_extendedprice"))


_GAP_PARTS = {"count_l_extendedprice": f"count({P})", "sum_l_extendedprice": exact(P, 1e5), "sumsq_l_extendedprice": exact(f"{P} * {P}", 1e10)}
_GAP_MEAN = "sum_l_extendedprice / count_l_extendedprice"


@query("private_moments_with_gaps", _grouped(
    f"{out(_GAP_MEAN, 'mean', 4)}, {out(f'greatest(0, sumsq_l_extendedprice / count_l_extendedprice - ({_GAP_MEAN}) * ({_GAP_MEAN}))', 'variance', 2)}, "
    f"{out(f'sqrt(greatest(0, sumsq_l_extendedprice / count_l_extendedprice - ({_GAP_MEAN}) * ({_GAP_MEAN})))', 'deviation', 4)}",
    _GAP_PARTS, "gaps", 1.0, {"count_l_extendedprice": 1.0, "sum_l_extendedprice": 1e5, "sumsq_l_extendedprice": 1e10}, rows=_GAPS))
def _(spark, sf):
    aggs = [avg("l_extendedprice").alias("mean"), var("l_extendedprice").alias("variance"), std("l_extendedprice").alias("deviation")]
    df = private_agg(_with_gaps(spark, sf), LINEITEM, aggs, epsilon=1.0, by=["l_returnflag"], noise=MODE, tag="gaps")
    return df.select("l_returnflag", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("variance", 2) + 0.0).alias("variance"), (F.round("deviation", 4) + 0.0).alias("deviation"))


# -- step-by-step measurements ---------------------------------------------------------------------------------


@query("measure_count", f"select {out(f'count(*)::double + {lap('m_count', [], 1.0)}'.replace('m_count', 'm_count|value'), 'value')} from lineitem")
def _(spark, sf):
    return rounded(Measure(table(spark, sf, LI), tag="m_count").column("l_quantity").count().laplace(1.0).noisy(MODE))


@query("measure_count_by_categories", (
    f"with e as (select case when c_mktsegment in ('BUILDING', 'FURNITURE', 'MACHINERY') then c_mktsegment else '__unknown__' end as category, "
    f"count(*) as c from customer group by 1), d as (select * from (values (0, 'BUILDING'), (1, 'FURNITURE'), (2, 'MACHINERY'), "
    f"(3, '__unknown__')) as t(position, category)) select d.position, d.category, "
    f"{out(f'''coalesce(c, 0)::double + {lap('m_cats|value', ['d.category'], 2.0)}''', 'value')} from d left join e using (category)"))
def _(spark, sf):
    m = Measure(table(spark, sf, "customer"), tag="m_cats").column("c_mktsegment")
    return rounded(m.count_by_categories(["BUILDING", "FURNITURE", "MACHINERY"]).laplace(2.0).noisy(MODE))


@query("measure_count_by_keys", (
    f"with e as (select n_name as key, count(*)::double as c from customer join nation on c_nationkey = n_nationkey group by 1), "
    f"n as (select key, c + {lap('m_keys|value', ['key'], 3.0)} as value from e) select key, {out('value', 'value')} from n where value >= 50::double"))
def _(spark, sf):
    named = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(Measure(named, tag="m_keys").column("n_name").count_by().laplace_threshold(3.0, 50.0).noisy(MODE))


_N_PAD, _N_CUT = "(select count(*) + 1000 from orders)", "(select count(*) // 2 from orders)"


@query("measure_sized_mean", (
    f"with k as (select {_TP} as x, row_number() over (order by {_ORDER}, o_orderkey) as r from orders), "
    f"s as (select {exact('x', 5e5)} as s1 from k where r <= {_N_CUT}) "
    f"select {out(f'''s1 / {_N_CUT} + {lap('m_mean|value', [], 10.0)}''', 'value', 4)} from s"))
def _(spark, sf):
    orders = table(spark, sf, "orders")
    m = Measure(orders, row_key=("o_orderkey",), tag="m_mean").column("o_totalprice").clamp(0.0, 500000.0)
    return rounded(m.resize(orders.count() // 2, 250000.0).mean().laplace(10.0).noisy(MODE), 4)


@query("measure_sized_variance", (
    f"with s as (select count(*)::double as k, {exact(_TP, 5e5)} as s1, {exact(f'{_TP} * {_TP}', 2.5e11)} as s2 from orders), "
    f"p as (select {_N_PAD}::double as n, s1 + ({_N_PAD} - k) * 250000::double as s1, s2 + ({_N_PAD} - k) * 62500000000::double as s2 from s) "
    f"select {out(f'''((s2 - s1 * s1 / n) / (n - 1) + {lap('m_var|value', [], 5e6)}) / 1000000''', 'value_millions', 3)} from p"))
def _(spark, sf):
    orders = table(spark, sf, "orders")
    m = Measure(orders, row_key=("o_orderkey",), tag="m_var").column("o_totalprice").clamp(0.0, 500000.0)
    df = m.resize(orders.count() + 1000, 250000.0).variance().laplace(5e6).noisy(MODE)
    return rounded(df.select((F.col("value") / 1e6).alias("value_millions")), 3)


@query("measure_filtered_sum", (
    f"select {out(f'''{exact(Q, 50.0)} + {lap('m_where|value', [], 25.0)}''', 'value', 4)} from lineitem where l_shipdate >= timestamp '1998-01-01'"))
def _(spark, sf):
    m = Measure(table(spark, sf, LI), tag="m_where").where("l_shipdate >= timestamp '1998-01-01'").column("l_quantity")
    return rounded(m.clamp(0.0, 50.0).sum().laplace(25.0).noisy(MODE), 4)


# -- quantiles, histograms, marginals ---------------------------------------------------------------------------

_CANDIDATES = [1000.0 * i for i in range(0, 101, 2)]


def _quantile_sql(alpha: float) -> str:
    return (
        f"with c as (select * from (values {', '.join(f'({i}, {num(v)})' for i, v in enumerate(_CANDIDATES))}) as t(i, q)), "
        f"s as (select l_returnflag, i, any_value(q) as q, sum((l_extendedprice < q)::int) as lt, sum((l_extendedprice > q)::int) as gt "
        f"from lineitem, c group by 1, 2), "
        f"n as (select *, -abs({num(1 - alpha)} * lt - {num(alpha)} * gt) + {gum(f'q{alpha}|__noisy', ['l_returnflag', 'i'], 20.0)} as score from s) "
        f"select l_returnflag, arg_max(q, score) as quantile from n group by 1")


def _quantile(spark, sf, alpha):
    return private_quantile(table(spark, sf, LI), "l_extendedprice", _CANDIDATES, alpha, 20.0, MODE, {"l_returnflag": FLAGS}, tag=f"q{alpha}")


@query("private_quantile", _quantile_sql(0.5))
def _(spark, sf):
    return _quantile(spark, sf, 0.5)


@query("private_quartile_low", _quantile_sql(0.25))
def _(spark, sf):
    return _quantile(spark, sf, 0.25)


@query("public_margins", (
    "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag, l_linestatus)::bigint as grouping "
    "from lineitem group by cube (l_returnflag, l_linestatus)"))
def _(spark, sf):
    return margins(table(spark, sf, LI), ["l_returnflag", "l_linestatus"])


@query("composed_measurements", (
    f"with e as (select l_linestatus, count(*) as c, count(l_discount) as cd, {exact(clamp('l_discount', 0.0, 0.1), 0.1)} as sd from lineitem group by 1), "
    f"n as (select l_linestatus, c + {lap('size|size__count_rows', ['l_linestatus'], 2.0)} as a, "
    f"cd + {lap('disc|disc__count_l_discount', ['l_linestatus'], 1.0)} as b, "
    f"sd + {lap('disc|disc__sum_l_discount', ['l_linestatus'], 0.1)} as s from e) "
    f"select l_linestatus, {out('a', 'size_n')}, {out('s / b', 'disc_mean')} from n"))
def _(spark, sf):
    both = compose([
        PrivateQuery(LINEITEM, (count().alias("n"),), 0.5, by=("l_linestatus",), tag="size"),
        PrivateQuery(LINEITEM, (avg("l_discount").alias("mean"),), 1.0, by=("l_linestatus",), tag="disc"),
    ])
    return rounded(both.noisy(table(spark, sf, LI), MODE))


@query("private_histogram", (
    f"with e as (select least(9, floor(({clamp('c_acctbal', -1000.0, 10000.0)} - -1000::double) / 11000::double * 10::double)::int) as bin, count(*) as c "
    f"from customer group by 1), d as (select range::int as bin from range(10)) "
    f"select d.bin, {out('-1000::double + d.bin * 1100::double', 'lower')}, {out('-1000::double + (d.bin + 1) * 1100::double', 'upper')}, "
    f"{out(f'''coalesce(c, 0)::double + {lap('hist|n', ['d.bin'], 2.0)}''', 'n')} from d left join e using (bin)"))
def _(spark, sf):
    return rounded(private_histogram(table(spark, sf, "customer"), "c_acctbal", -1000.0, 10000.0, 0.5, MODE, tag="hist"))


@query("private_marginals", (
    f"with c as (select 'l_returnflag' as marginal, l_returnflag, null::varchar as l_linestatus, l_linenumber, n from "
    f"(select l_returnflag, null::int as l_linenumber, count(*) as n from lineitem group by 1) union all "
    f"select 'l_returnflag,l_linestatus', l_returnflag, l_linestatus, null, count(*) from lineitem group by 2, 3 union all "
    f"select 'l_linestatus,l_linenumber', null, l_linestatus, l_linenumber, count(*) from lineitem group by 3, 4) "
    f"select marginal, l_returnflag, l_linestatus, l_linenumber::varchar as l_linenumber, "
    f"{out(f'''n + {lap('marg|n', ['marginal', 'l_returnflag', 'l_linestatus', 'l_linenumber'], 3.0)}''', 'n')} from c"))
def _(spark, sf):
    domains = {"l_returnflag": FLAGS, "l_linestatus": STATUSES, "l_linenumber": list(range(1, 8))}
    sets = [("l_returnflag",), ("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber")]
    noisy = private_marginals(table(spark, sf, LI), domains, sets, 1.0, MODE, tag="marg")
    return rounded(noisy.withColumn("l_linenumber", F.col("l_linenumber").cast("string")))


# -- mechanisms -----------------------------------------------------------------------------------------------


def _segments(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("m"))


_SEG = "with e as (select c_mktsegment, count(*) as n, count(*) filter (where c_acctbal < 0) as m from customer group by 1)"


@query("noise_laplace", f"{_SEG} select c_mktsegment, m, {out(f'n + {lap('lap|n', ['c_mktsegment'], 4.0)}', 'n')} from e")
def _(spark, sf):
    return rounded(add_laplace(_segments(spark, sf), "n", 4.0, ["c_mktsegment"], MODE, "lap"))


@query("noise_vector", (
    f"{_SEG} select c_mktsegment, {out(f'n + {lap('vec|n', ['c_mktsegment'], 4.0)}', 'n')}, {out(f'm + {lap('vec|m', ['c_mktsegment'], 4.0)}', 'm')} from e"))
def _(spark, sf):
    return rounded(add_laplace(_segments(spark, sf), ["n", "m"], 4.0, ["c_mktsegment"], MODE, "vec"))


@query("noise_gaussian", f"{_SEG} select c_mktsegment, m, {out(f'n + {gauss('gau|n', ['c_mktsegment'], 5.0)}', 'n')} from e")
def _(spark, sf):
    return rounded(add_gaussian(_segments(spark, sf), "n", 5.0, ["c_mktsegment"], MODE, "gau"))


@query("noise_discrete", (
    f"{_SEG} select c_mktsegment, m, n::double + floor(-3::double * ln({uni('dis|n', ['c_mktsegment'])})) "
    f"- floor(-3::double * ln({uni('dis|n', ['c_mktsegment'], chr(39) + '1' + chr(39))})) as n from e"))
def _(spark, sf):
    return add_discrete_laplace(_segments(spark, sf), "n", 3.0, ["c_mktsegment"], MODE, "dis")


_SIGMA = gaussian_sigma(1.0, 1.0, 5e-6)


@query("mechanism_choice", (
    f"with e as (select l_linestatus, count(*) as c, count(l_quantity) as k, {exact(Q, 50.0)} as s from lineitem group by 1), "
    f"n as (select l_linestatus, c + {gauss('mech|count_rows', ['l_linestatus'], _SIGMA)} as c, "
    f"s + {lap('mech|sum_l_quantity', ['l_linestatus'], 50.0)} as s from e) select l_linestatus, {out('c', 'n', 4)}, {out('s', 'total', 4)} from n"))
def _(spark, sf):
    df = private_agg(table(spark, sf, LI), LINEITEM, [count().alias("n"), sum_("l_quantity").alias("total")], epsilon=1.0, delta=1e-5,
                     by=["l_linestatus"], mechanisms={"count": "gaussian", "sum_float": "laplace"}, noise=MODE, tag="mech")
    return rounded(df, 4)


@query("noisy_max", (
    f"with e as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2), "
    f"s as (select *, n + {gum('max|__noisy', ['c_nationkey', 'c_mktsegment'], 3.0)} as score from e) "
    f"select c_nationkey, arg_max(c_mktsegment, score) as c_mktsegment from s group by 1"))
def _(spark, sf):
    scores = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return select_noisy_max(scores, ["c_nationkey"], "c_mktsegment", "n", 3.0, MODE, "max")


@query("noisy_threshold", (
    f"with n as (select o_custkey, count(*)::double + {lap('tau|n', ['o_custkey'], 2.0)} as n from orders group by o_custkey) "
    f"select o_custkey, {out('n', 'n')} from n where n >= 12::double"))
def _(spark, sf):
    sizes = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return rounded(threshold(add_noise(sizes, [Noise("n", "laplace", 2.0)], ["o_custkey"], MODE, "tau"), "n", 12.0))


@query("positional_names", (
    f"with n as (select l_linestatus, count(*)::double + {lap('pos|count_rows', ['l_linestatus'], 1.0)} as c from lineitem group by 1) "
    f"select l_linestatus as res_0, {out('c', 'res_1')} from n"))
def _(spark, sf):
    df = private_agg(table(spark, sf, LI), LINEITEM, [count()], epsilon=1.0, by=["l_linestatus"], postprocess=False, noise=MODE, tag="pos")
    return rounded(df)
