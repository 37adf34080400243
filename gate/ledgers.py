"""Budgets, admission, archive and registry maintenance on tables derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gate.core import query, table
from hushframe.operators import ledger as L
from hushframe.operators import registry as R
from hushframe.operators.archive_log import ArchiveLog
from hushframe.operators.post import top
from hushframe.plans.accounting import invalid_requests, price
from hushframe.session import fresh_path

# A request per event: user and dataset from the event, cost from its value.  A user holds every dataset they
# asked for except the one whose number equals their own modulo five; the last dataset is not registered.
DATASETS = ["click", "error", "purchase", "signup", "view"]


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_name"),
        F.col("event_type").alias("dataset_name"), F.col("value").alias("cost_epsilon"), F.round(F.col("value") / 1e6, 8).alias("cost_delta"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, DATASETS)), F.col("event_type")).cast("int") - 1
    held = table(spark, sf, "events").select("user_id", "event_type").distinct().filter(F.col("user_id") % 5 != number)
    grant = F.struct(
        F.col("event_type").alias("dataset_name"), (F.col("user_id") % 12).cast("double").alias("initial_epsilon"),
        ((F.col("user_id") % 15) / 1000.0).alias("initial_delta"), F.lit(0.0).alias("total_spent_epsilon"), F.lit(0.0).alias("total_spent_delta"))
    return held.groupBy("user_id").agg(F.sort_array(F.collect_list(grant)).alias("datasets_list")).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), (F.col("user_id") % 7 != 0).alias("may_query"), "datasets_list")


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type <> 'view'").select(F.col("event_type").alias("dataset_name")).distinct()


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type <> 'click'").groupBy(F.col("event_type").alias("dataset_name")).agg(F.count("*").alias("rows"))


def archive(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    family = F.element_at(F.array(*map(F.lit, L.FAMILY_SCHEMAS)), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.col("event_type").alias("dataset_name"), F.col("value").alias("epsilon"), F.lit(1e-5).alias("delta"),
        F.concat(F.lit("SELECT COUNT(*) AS n FROM df WHERE k = "), F.col("event_id")).alias("query_str"),
        F.when(F.col("event_id") % 8 == 1, F.lit("mst")).otherwise("aim").alias("synth_name"), (F.col("event_id") % 100).cast("int").alias("nb_samples"),
        F.array(F.lit("a"), F.col("event_type")).alias("feature_columns"), F.lit(0.2).alias("test_size"), F.lit(1e-6).alias("fixed_delta")))
    return e.select(
        F.col("event_id").alias("entry_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), F.col("event_type").alias("dataset_name"),
        family.alias("dp_librairy"), body.alias("client_input"), F.unix_micros("ts").alias("timestamp"),
        F.col("value").alias("spent_epsilon"), (F.col("value") * 1e-6).alias("spent_delta"))


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return asked.select(F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), F.col("event_type").alias("dataset_name"),
                        F.lit(250.0).alias("epsilon"), F.when(F.col("user_id") % 3 == 0, 0.000125).otherwise(0.001).alias("delta"))


_NUM = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1"
_GRANTS = (
    f"g as (select distinct 'u' || user_id as user_name, event_type as dataset_name, (user_id % 12)::double as initial_epsilon, "
    f"(user_id % 15)::double / 1000::double as initial_delta, user_id from events where user_id % 5 <> {_NUM})")
_SPENT = (
    "s as (select 'u' || user_id as user_name, event_type as dataset_name, sum(round(value * 100)::hugeint)::double / 100::double as se, "
    "sum(round(value * 100)::hugeint)::double / 100000000::double as sd from events group by 1, 2)")


# -- pricing ---------------------------------------------------------------------------------------------------


def priced_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request table made from orders: family, aggregates, scales and deltas follow the order's columns."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")

    def choose(options):
        return F.element_at(F.array(*[F.lit(v) for v in options]), (F.floor(k / 3) % len(options)).cast("int") + 1)

    def agg(function, column):
        return F.struct(F.lit(function).alias("function"), F.lit(column).cast("string").alias("column"))

    menus = F.array(
        F.array(agg("count", None)), F.array(agg("avg", "x")), F.array(agg("std", "x")), F.array(agg("count", "x"), agg("avg", "x"), agg("std", "x")),
        F.array(agg("count", None), agg("avg", "x"), agg("sum", "y")), F.array(agg("median", "x")))
    family = F.element_at(F.array(*map(F.lit, ["sql", "measurement", "ml", "synth", "other"])), (k % 5).cast("int") + 1)
    steps = F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("step"), i).alias("name"), (i * 0.25).alias("epsilon")))
    return o.select(
        k.alias("request_id"), family.alias("family"), F.when(k % 7 != 0, F.col("o_custkey") % 10 / 10.0 + 0.1).otherwise(F.lit(0.0)).alias("epsilon"),
        F.lit(1e-5).alias("delta"), F.element_at(menus, (F.floor(k / 5) % 6).cast("int") + 1).alias("aggs"), steps.alias("steps"),
        choose(["max_divergence", "zero_concentrated", "smoothed_max", "fixed_smoothed_max", None]).alias("measure"),
        F.when(k % 11 == 0, "text").otherwise("dataset").alias("input_kind"), (F.col("o_custkey") % 4 + 1).cast("double").alias("sensitivity"),
        (F.col("o_totalprice") / 1000.0 + 1.0).alias("scale"), F.when(k % 13 != 0, 1e-6).alias("fixed_delta"), choose(["mwem", "mst", "aim", "pacsynth"]).alias("synthesizer"))


_PRICED = """p as (select o_orderkey as request_id, ['sql','measurement','ml','synth','other'][o_orderkey % 5 + 1] as family,
 case when o_orderkey % 7 <> 0 then (o_custkey % 10)::double / 10::double + 0.1::double else 0::double end as epsilon, 1e-5::double as delta,
 (o_orderkey // 5) % 6 as menu, o_orderkey % 3 + 1 as n_steps,
 ['max_divergence','zero_concentrated','smoothed_max','fixed_smoothed_max',null][(o_orderkey // 3) % 5 + 1] as measure,
 o_orderkey % 11 = 0 as is_text, (o_custkey % 4 + 1)::double as sens, o_totalprice / 1000::double + 1::double as scale,
 case when o_orderkey % 13 <> 0 then 1e-6::double end as fixed_delta, ['mwem','mst','aim','pacsynth'][(o_orderkey // 3) % 4 + 1] as synthesizer from orders),
 r as (select *, case
 when family = 'other' then 'unknown family'
 when family = 'measurement' and measure is null then 'not a measurement'
 when family = 'measurement' and is_text then 'input is not a dataset'
 when family = 'measurement' and measure in ('zero_concentrated','smoothed_max') and fixed_delta is null then 'fixed delta required'
 when family in ('sql','synth') and epsilon <= 0 then 'epsilon must be positive'
 when family = 'sql' and menu = 5 then 'unsupported aggregate'
 when family = 'synth' and synthesizer = 'mwem' then 'mwem takes no delta'
 when family = 'synth' and synthesizer = 'pacsynth' then 'synthesizer not supported' end as reason,
 [1, 2, 3, 3, 4, 0][menu + 1] as k, (sens / scale) * (sens / scale) / 2::double as rho from p)"""


@query("price_requests", f"""with {_PRICED} select request_id,
 round(case when reason is null then case family when 'sql' then k * epsilon when 'ml' then 0.125::double * n_steps * (n_steps + 1) when 'synth' then epsilon
 else case measure when 'max_divergence' then sens / scale when 'zero_concentrated' then rho + 2::double * sqrt(rho * -ln(fixed_delta)) else epsilon end end end, 9) + 0.0::double as cost_epsilon,
 round(1000000::double * case when reason is null then case family when 'sql' then 1::double - (1::double - delta) * power(1::double - delta / 2::double, k) when 'ml' then 0::double
 when 'synth' then delta else case measure when 'max_divergence' then 0::double when 'fixed_smoothed_max' then delta else fixed_delta end end end, 6) + 0.0::double as cost_delta_millionths from r""")
def _(spark, sf):
    p = price(priced_requests(spark, sf))
    return p.select("request_id", (F.round("cost_epsilon", 9) + 0.0).alias("cost_epsilon"),
                    (F.round(F.col("cost_delta") * 1e6, 6) + 0.0).alias("cost_delta_millionths"))


@query("invalid_requests", f"with {_PRICED} select request_id, reason from r where reason is not null")
def _(spark, sf):
    return invalid_requests(priced_requests(spark, sf))


# -- budgets ---------------------------------------------------------------------------------------------------


@query("initial_budget", f"with {_GRANTS} select user_name, dataset_name, initial_epsilon, initial_delta from g")
def _(spark, sf):
    return L.initial_budget(users(spark, sf))


@query("spent_budget", f"with {_SPENT} select user_name, dataset_name, round(se, 6) as spent_epsilon, round(sd, 10) as spent_delta from s")
def _(spark, sf):
    s = L.spent_budget(archive(spark, sf))
    return s.select(*L.KEYS, F.round("spent_epsilon", 6).alias("spent_epsilon"), F.round("spent_delta", 10).alias("spent_delta"))


@query("remaining_budget", (
    f"with {_GRANTS}, {_SPENT} select user_name, dataset_name, round(initial_epsilon - coalesce(se, 0), 6) + 0.0::double as remaining_epsilon, "
    f"round(initial_delta - coalesce(sd, 0), 9) + 0.0::double as remaining_delta from g left join s using (user_name, dataset_name)"))
def _(spark, sf):
    r = L.remaining_budget(users(spark, sf), archive(spark, sf))
    return r.select(*L.KEYS, (F.round("remaining_epsilon", 6) + 0.0).alias("remaining_epsilon"), (F.round("remaining_delta", 9) + 0.0).alias("remaining_delta"))


@query("budget_timeline", (
    "select event_id as entry_id, 'u' || user_id as user_name, event_type as dataset_name, "
    "round(sum(round(value * 100)::hugeint) over w::double / 100::double, 6) as running_epsilon from events "
    "window w as (partition by user_id, event_type order by ts, event_id)").replace("over w::double", "over w ::double"))
def _(spark, sf):
    timeline = L.budget_timeline(archive(spark, sf), ["timestamp", "entry_id"])
    return timeline.select("entry_id", *L.KEYS, F.round("running_epsilon", 6).alias("running_epsilon"))


@query("over_limit", f"with {_GRANTS} select user_name, dataset_name, initial_epsilon, initial_delta from g where initial_epsilon > 10 or initial_delta > 0.01::double")
def _(spark, sf):
    return L.over_limit(users(spark, sf))


ADMIT_SQL = """with recursive q as (select event_id as request_id, 'u' || user_id as user_name, event_type as dataset_name, round(value * 100)::bigint as c,
 row_number() over (partition by user_id, event_type order by event_id) as rn, case when user_id % 3 = 0 then 12500 else 25000 end as b from events),
 f as (select request_id, user_name, dataset_name, c, rn, b, c <= b as admitted, case when c <= b then c else 0 end as spent from q where rn = 1
 union all select q.request_id, q.user_name, q.dataset_name, q.c, q.rn, q.b, f.spent + q.c <= q.b, case when f.spent + q.c <= q.b then f.spent + q.c else f.spent end
 from f join q on q.user_name = f.user_name and q.dataset_name = f.dataset_name and q.rn = f.rn + 1)
 select request_id, user_name, dataset_name, admitted from f"""


@query("admit_requests", ADMIT_SQL)
def _(spark, sf):
    return L.admit(requests(spark, sf), budgets(spark, sf)).select("request_id", *L.KEYS, "admitted")


@query("authorize_requests", f"""with {_GRANTS}, r as (select event_id as request_id, 'u' || (user_id * (case when event_id % 50 = 0 then 1000003 else 1 end)) as user_name,
 event_type as dataset_name from events), k as (select distinct user_name, user_id % 7 <> 0 as may from g)
 select request_id, r.user_name, r.dataset_name, case when k.user_name is null then 'unknown user' when r.dataset_name = 'view' then 'unknown dataset'
 when g.user_name is null then 'no access to dataset' when not may then 'user may not query' end as reason
 from r left join k on k.user_name = r.user_name left join g on g.user_name = r.user_name and g.dataset_name = r.dataset_name""")
def _(spark, sf):
    stray = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("u"), F.col("user_id") * F.when(F.col("event_id") % 50 == 0, 1000003).otherwise(1)).alias("user_name"),
        F.col("event_type").alias("dataset_name"))
    return L.authorize(stray, users(spark, sf), datasets(spark, sf))


# -- archive ---------------------------------------------------------------------------------------------------


@query("previous_queries", (
    "select event_id as entry_id, 'u' || user_id as user_name, event_type as dataset_name, value as spent_epsilon from events "
    "where user_id = 8 and event_type = 'error'"))
def _(spark, sf):
    return L.previous_queries(archive(spark, sf), "u8", "error").select("entry_id", *L.KEYS, "spent_epsilon")


@query("archive_append", (
    "select event_type as dataset_name, count(*)::bigint as n, count(distinct user_id)::bigint as n_users from events group by 1"))
def _(spark, sf):
    path, entries = fresh_path(spark, "archive"), archive(spark, sf)
    L.append_archive(entries.filter("dp_librairy = 'opendp'"), path)
    L.append_archive(entries.filter("dp_librairy <> 'opendp'"), path)
    stored = spark.read.schema(entries.schema).parquet(path)
    return stored.groupBy("dataset_name").agg(F.count("*").alias("n"), F.countDistinct("user_name").alias("n_users"))


@query("archive_log", (
    "select ['smartnoise_sql','smartnoise_synth','opendp','diffprivlib'][event_id % 4 + 1] as family, event_type as dataset_name, count(*)::bigint as n, "
    "count(distinct user_id)::bigint as n_users, round(sum(value), 4) as spent_epsilon from events group by 1, 2"))
def _(spark, sf):
    """A bulk commit per family, folded into parts on the way; what the log then holds."""
    entries = archive(spark, sf)
    log = ArchiveLog(spark, fresh_path(spark, "archive-log"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields), every=2)
    for family in L.FAMILY_SCHEMAS:
        log.commit_frame(entries.filter(F.col("dp_librairy") == family))
    rows = log.read()[1].groupBy(F.col("dp_librairy").alias("family"), "dataset_name")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("user_name").alias("n_users"), F.round(F.sum(L.amount("spent_epsilon", "epsilon")), 4).cast("double").alias("spent_epsilon"))


@query("decode_archive", """select event_id as entry_id, ['smartnoise_sql','smartnoise_synth','opendp','diffprivlib'][event_id % 4 + 1] as family, event_type as dataset_name,
 case when event_id % 4 = 0 then 'SELECT COUNT(*) AS n FROM df WHERE k = ' || event_id end as query_str,
 case when event_id % 4 = 1 then case when event_id % 8 = 1 then 'mst' else 'aim' end end as synth_name,
 case when event_id % 4 = 1 then (event_id % 100)::varchar end as nb_samples, case when event_id % 4 = 2 then 1e-6::double end as fixed_delta,
 case when event_id % 4 = 3 then 'a,' || event_type end as features, case when event_id % 4 < 2 then value end as epsilon from events""")
def _(spark, sf):
    d = L.decode_archive(archive(spark, sf))
    return d.select(
        "entry_id", F.col("dp_librairy").alias("family"),
        F.coalesce(*[F.col(f"{f}.dataset_name") for f in L.FAMILY_SCHEMAS]).alias("dataset_name"), F.col("smartnoise_sql.query_str").alias("query_str"),
        F.col("smartnoise_synth.synth_name").alias("synth_name"), F.col("smartnoise_synth.nb_samples").cast("string").alias("nb_samples"),
        F.col("opendp.fixed_delta").alias("fixed_delta"), F.when(F.col("diffprivlib").isNotNull(), F.array_join("diffprivlib.feature_columns", ",")).alias("features"),
        F.coalesce("smartnoise_sql.epsilon", "smartnoise_synth.epsilon").alias("epsilon"))


@query("latest_query", """select 'u' || user_id as user_name, arg_max(event_id, (ts, event_id)) as entry_id, arg_max(event_type, (ts, event_id)) as dataset_name
 from events group by user_id""")
def _(spark, sf):
    return L.latest_query(archive(spark, sf), ["timestamp", "entry_id"]).select("user_name", "entry_id", "dataset_name")


# -- registry --------------------------------------------------------------------------------------------------


def _users_flat(df: DataFrame) -> DataFrame:
    return df.select("user_name", "may_query", F.explode_outer("datasets_list").alias("d")).select("user_name", "may_query", "d.dataset_name", "d.initial_epsilon")


def _incoming(spark, sf) -> DataFrame:
    """Users of a second registry: every third known user with one new grant, and as many unknown ones."""
    held = F.array(F.struct(F.lit("census").alias("dataset_name"), F.lit(3.0).alias("initial_epsilon"), F.lit(0.001).alias("initial_delta"),
                            F.lit(0.0).alias("total_spent_epsilon"), F.lit(0.0).alias("total_spent_delta")))
    ids = table(spark, sf, "events").select("user_id").distinct().filter("user_id % 3 = 0")
    both = ids.select(F.concat(F.lit("u"), F.col("user_id")).alias("user_name")).unionByName(ids.select(F.concat(F.lit("v"), F.col("user_id")).alias("user_name")))
    return both.select("user_name", F.lit(True).alias("may_query"), held.alias("datasets_list"))


_FLAT = f"{_GRANTS}, f as (select user_name, user_id % 7 <> 0 as may_query, dataset_name, initial_epsilon, user_id from g)"
_NEW = ("(select 'u' || user_id as user_name, true as may_query, 'census' as dataset_name, 3.0::double as initial_epsilon from (select distinct user_id from events where user_id % 3 = 0) "
        "union all select 'v' || user_id, true, 'census', 3.0::double from (select distinct user_id from events where user_id % 3 = 0))")


@query("upsert_users_keep", f"with {_FLAT}, n as {_NEW} select user_name, may_query, dataset_name, initial_epsilon from f union all select * from n where user_name not in (select user_name from f)")
def _(spark, sf):
    return _users_flat(R.upsert_users(users(spark, sf), _incoming(spark, sf)))


@query("upsert_users_overwrite", f"with {_FLAT}, n as {_NEW} select user_name, may_query, dataset_name, initial_epsilon from f where user_name not in (select user_name from n) union all select * from n")
def _(spark, sf):
    return _users_flat(R.upsert_users(users(spark, sf), _incoming(spark, sf), overwrite=True))


@query("upsert_datasets", """with d as (select distinct event_type as dataset_name, 'old' as origin from events where event_type <> 'view'),
 m as (select event_type as dataset_name, count(*)::bigint as rows from events where event_type <> 'click' group by 1),
 nd as (select distinct event_type as dataset_name, 'new' as origin from events where event_type in ('view', 'click')),
 nm as (select event_type as dataset_name, 1::bigint as rows from events where event_type in ('view', 'click') group by 1)
 select kind, dataset_name, origin, rows::varchar as rows from (select 'dataset' as kind, dataset_name, origin, null::bigint as rows from d union all select 'dataset', dataset_name, origin, null from nd where dataset_name not in (select dataset_name from d)
 union all select 'metadata', dataset_name, null, rows from nm union all select 'metadata', dataset_name, null, rows from m where dataset_name not in (select dataset_name from nm))""")
def _(spark, sf):
    fresh = table(spark, sf, "events").filter("event_type in ('view', 'click')").select(F.col("event_type").alias("dataset_name")).distinct()
    d, m = R.upsert_datasets(
        datasets(spark, sf).withColumn("origin", F.lit("old")), metadata(spark, sf), fresh.withColumn("origin", F.lit("new")),
        fresh.withColumn("rows", F.lit(1).cast("bigint")), overwrite_metadata=True)
    return d.select(F.lit("dataset").alias("kind"), "dataset_name", "origin", F.lit(None).cast("bigint").alias("rows")).unionByName(
        m.select(F.lit("metadata").alias("kind"), "dataset_name", F.lit(None).cast("string").alias("origin"), "rows")).withColumn("rows", F.col("rows").cast("string"))


_ALL = "(select distinct 'u' || user_id as user_name, event_type as dataset_name, user_id from events)"


@query("grant_datasets", (
    f"with {_FLAT} select user_name, may_query, dataset_name, initial_epsilon from f union all select user_name, user_id % 7 <> 0, dataset_name, 1.5::double from {_ALL} a "
    f"where not exists (select 1 from g where g.user_name = a.user_name and g.dataset_name = a.dataset_name) and user_name in (select user_name from g)"))
def _(spark, sf):
    asked = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), F.col("event_type").alias("dataset_name"))
    grants = asked.select("*", F.lit(1.5).alias("initial_epsilon"), F.lit(0.002).alias("initial_delta"))
    return _users_flat(R.grant(users(spark, sf), grants))


@query("revoke_datasets", (
    f"with {_FLAT}, x as (select distinct 'u' || user_id as user_name, event_type as dataset_name from events where value > 100), "
    f"k as (select * from f where not exists (select 1 from x where x.user_name = f.user_name and x.dataset_name = f.dataset_name)) "
    f"select user_name, may_query, dataset_name, initial_epsilon from k union all "
    f"select distinct user_name, may_query, null, null::double from f where user_name not in (select user_name from k)"))
def _(spark, sf):
    gone = table(spark, sf, "events").filter("value > 100").select(F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), F.col("event_type").alias("dataset_name"))
    return _users_flat(R.revoke(users(spark, sf), gone))


@query("set_budgets", (
    f"with {_FLAT}, x as (select 'u' || user_id as user_name, event_type as dataset_name, max(round(value)) as v from events where value > 60 group by 1, 2) "
    f"select user_name, may_query, dataset_name, coalesce(v, initial_epsilon) as initial_epsilon from f left join x using (user_name, dataset_name)"))
def _(spark, sf):
    updates = table(spark, sf, "events").filter("value > 60").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), F.col("event_type").alias("dataset_name"), F.round("value").alias("initial_epsilon"),
        F.lit(None).cast("double").alias("initial_delta"))
    return _users_flat(R.set_budget(users(spark, sf), updates))


@query("set_may_query", (
    f"with {_GRANTS}, u as (select distinct user_name, user_id, user_id % 7 <> 0 as may from g), x as (select user_id, min(value > 0.5) as m from events group by 1) "
    f"select user_name, coalesce(m, may) as may_query from u left join x using (user_id)"))
def _(spark, sf):
    updates = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("user_name"), (F.col("value") > 0.5).alias("may_query"))
    return R.set_may_query(users(spark, sf), updates).select("user_name", "may_query")


@query("delete_users", f"with {_GRANTS} select distinct user_name from g where user_name not in (select 'u' || user_id from events where value > 250)")
def _(spark, sf):
    names = table(spark, sf, "events").filter("value > 250").select(F.concat(F.lit("u"), F.col("user_id")).alias("user_name"))
    return R.delete_users(users(spark, sf), names).select("user_name")


@query("delete_datasets", (
    "select distinct 'dataset' as kind, event_type as dataset_name from events where event_type not in ('view', 'error') "
    "union all select distinct 'metadata', event_type from events where event_type not in ('click', 'error')"))
def _(spark, sf):
    names = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_type").alias("dataset_name")).distinct()
    d, m = R.delete_datasets(datasets(spark, sf), metadata(spark, sf), names)
    return d.select(F.lit("dataset").alias("kind"), "dataset_name").unionByName(m.select(F.lit("metadata").alias("kind"), "dataset_name"))


@query("list_users", f"with {_GRANTS} select user_name, user_id % 7 <> 0 as may_query, count(*)::int as n_datasets from g group by user_name, user_id")
def _(spark, sf):
    return R.list_users(users(spark, sf))


@query("list_datasets", "select distinct event_type as dataset_name from events where event_type <> 'view'")
def _(spark, sf):
    return R.list_datasets(datasets(spark, sf))


@query("list_user_datasets", f"with {_GRANTS} select user_name, dataset_name, initial_epsilon, initial_delta from g where user_name = 'u8'")
def _(spark, sf):
    return R.list_user_datasets(users(spark, sf), "u8")


@query("list_archives", "select event_id as entry_id, event_type as dataset_name from events where user_id = 8")
def _(spark, sf):
    return R.list_archives(archive(spark, sf), "u8").select("entry_id", "dataset_name")


@query("check_registry", (
    f"with {_GRANTS} select distinct 'dataset without metadata' as problem, event_type as name from events where event_type = 'click' "
    f"union all select distinct 'metadata without dataset', event_type from events where event_type = 'view' "
    f"union all select distinct 'grant of unknown dataset', dataset_name from g where dataset_name = 'view'"))
def _(spark, sf):
    return R.check_registry(users(spark, sf), datasets(spark, sf), metadata(spark, sf))


@query("top_spenders", (
    f"with {_SPENT} select user_name, dataset_name, round(se, 6) as spent_epsilon from s order by se desc, user_name, dataset_name limit 20"))
def _(spark, sf):
    s = L.spent_budget(archive(spark, sf)).select(*L.KEYS, F.round("spent_epsilon", 6).alias("spent_epsilon"))
    return top(s, [F.desc("spent_epsilon"), "user_name", "dataset_name"], 20)
