"""Budgets, admission and the query archive as tables.

Table shapes: ``users(user_name, may_query, datasets_list array<struct<dataset_name, initial_epsilon,
initial_delta, total_spent_epsilon, total_spent_delta>>)``, ``archive(user_name, dataset_name, dp_librairy,
client_input, response, timestamp, spent_epsilon, spent_delta)``, ``requests(request_id, user_name,
dataset_name, cost_epsilon, cost_delta)`` and ``budgets(user_name, dataset_name, epsilon, delta)``.

Amounts are compared as decimals, so that the answer does not depend on the order of a floating sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.errors import InvalidQuery
from hushframe.operators.prefix import chunk_edges, running_sums
from hushframe.session import Scratch, written

# Most a user may hold per dataset.
EPSILON_LIMIT = 10.0
DELTA_LIMIT = 0.01

# Amounts with room for a sum of two of a type, so that no digit is lost in adding; costs below the last digit count as one of it.
AMOUNTS = {"epsilon": "decimal(36,20)", "delta": "decimal(36,28)"}
KEYS = ["user_name", "dataset_name"]
HOT_REQUESTS = 20_000

# The fields of a user's grants.
BUDGET_STRUCT = (
    "array<struct<dataset_name: string, initial_epsilon: double, initial_delta: double, "
    "total_spent_epsilon: double, total_spent_delta: double>>"
)

# Names of the request families in archived rows, with the fields each request carries.
FAMILY_SCHEMAS = {
    "smartnoise_sql": "query_str string, dataset_name string, epsilon double, delta double, "
                      "mechanisms map<string,string>, postprocess boolean",
    "smartnoise_synth": "dataset_name string, synth_name string, epsilon double, delta double, "
                        "select_cols array<string>, nullable boolean, nb_samples int, condition string",
    "opendp": "dataset_name string, opendp_json string, fixed_delta double",
    "diffprivlib": "dataset_name string, diffprivlib_json string, feature_columns array<string>, "
                   "target_columns array<string>, test_size double, test_train_split_seed int, imputer_strategy string",
}


def amount(column: Column | str, kind: str) -> Column:
    """A cost or budget as an exact decimal; a positive one is never rounded to nothing."""
    value = F.col(column) if isinstance(column, str) else column
    exact = value.cast(AMOUNTS[kind])
    least = F.lit("1e-" + AMOUNTS[kind].split(",")[1].rstrip(")")).cast(AMOUNTS[kind])
    return F.when((value > 0) & (exact < least), least).otherwise(exact)


# -- budgets -------------------------------------------------------------------------------------------------


def initial_budget(users: DataFrame) -> DataFrame:
    return users.select("user_name", F.explode("datasets_list").alias("d")).select(
        "user_name", "d.dataset_name", "d.initial_epsilon", "d.initial_delta")


def spent_budget(archive: DataFrame) -> DataFrame:
    return archive.groupBy(*KEYS).agg(*[F.sum(amount(f"spent_{x}", x)).cast("double").alias(f"spent_{x}") for x in AMOUNTS])


def remaining_budget(users: DataFrame, archive: DataFrame) -> DataFrame:
    """Initial minus spent; a user without queries keeps all of it."""
    left = [
        (amount(f"initial_{x}", x) - amount(F.coalesce(F.col(f"spent_{x}"), F.lit(0.0)), x)).cast("double").alias(f"remaining_{x}")
        for x in AMOUNTS
    ]
    return initial_budget(users).join(spent_budget(archive), KEYS, "left").select(*KEYS, *left)


def budget_timeline(archive: DataFrame, order: list[str]) -> DataFrame:
    """Spend so far after every archived query, in ``order``."""
    sums = {f"running_{x}": amount(f"spent_{x}", x) for x in AMOUNTS}
    out = running_sums(archive, KEYS, order, sums)
    return out.withColumns({n: F.col(n).cast("double") for n in sums})


def over_limit(users: DataFrame, epsilon: float = EPSILON_LIMIT, delta: float = DELTA_LIMIT) -> DataFrame:
    """Grants above the per-user, per-dataset caps."""
    return initial_budget(users).filter((F.col("initial_epsilon") > epsilon) | (F.col("initial_delta") > delta))


# -- admission -----------------------------------------------------------------------------------------------


def admit(requests: DataFrame, budgets: DataFrame, hot_requests: int = HOT_REQUESTS) -> DataFrame:
    """In request order, admit a request when both remaining amounts cover it; only admitted ones spend.

    Rejections do not spend, so a running total is not the answer.  Keys with at most ``hot_requests``
    affordable requests are folded in one expression; larger keys are settled in phases, see ``_settle_hot``.
    Requests that alone exceed the whole budget, or have none, are rejected before any grouping.
    """
    budget = budgets.select(*KEYS, amount("epsilon", "epsilon").alias("__be"), amount("delta", "delta").alias("__bd"))
    priced = requests.join(budget, KEYS, "left").withColumns(
        {"__e": amount("cost_epsilon", "epsilon"), "__d": amount("cost_delta", "delta")})
    affordable = F.coalesce((F.col("__e") <= F.col("__be")) & (F.col("__d") <= F.col("__bd")), F.lit(False))
    with Scratch(requests.sparkSession) as held:
        open_ = held(priced.filter(affordable).select(*KEYS, "request_id", "__e", "__d", "__be", "__bd"), "admission-open")  # priced once
        sizes = open_.groupBy(*KEYS).agg(F.count("*").alias("__n"))
        hot_keys = sizes.filter(F.col("__n") > hot_requests).select(*KEYS)
        has_hot = not hot_keys.isEmpty()
        cold = open_.join(hot_keys, KEYS, "left_anti") if has_hot else open_
        accepted = _fold(cold)
        if has_hot:
            accepted = accepted.unionByName(_settle_hot(open_.join(hot_keys, KEYS, "left_semi"), hot_requests, held))
        accepted = written(accepted, "admission-accepted")  # all that is kept of the phases
    marked = accepted.withColumn("__in", F.lit(True))
    return requests.join(marked, [*KEYS, "request_id"], "left").select(
        *requests.columns, F.coalesce("__in", F.lit(False)).alias("admitted"))


def _fold(requests: DataFrame) -> DataFrame:
    """Admitted requests of keys whose requests fit one array."""
    zero = [F.lit(0).cast(t).alias(n) for n, t in zip("ed", AMOUNTS.values())]
    start = F.struct(*zero, F.lit("").alias("taken"))

    def step(acc: Column, r: Column) -> Column:
        e, d = (acc["e"] + r["e"]).cast(AMOUNTS["epsilon"]), (acc["d"] + r["d"]).cast(AMOUNTS["delta"])
        fits = (e <= F.col("__be")) & (d <= F.col("__bd"))
        return F.when(fits, F.struct(e.alias("e"), d.alias("d"), F.concat(acc["taken"], F.lit("1")).alias("taken"))).otherwise(
            F.struct(acc["e"].alias("e"), acc["d"].alias("d"), F.concat(acc["taken"], F.lit("0")).alias("taken")))

    grouped = requests.groupBy(*KEYS, "__be", "__bd").agg(
        F.sort_array(F.collect_list(F.struct(F.col("request_id").alias("id"), F.col("__e").alias("e"), F.col("__d").alias("d")))).alias("r"))
    folded = grouped.withColumn("taken", F.aggregate("r", start, step)["taken"])  # one byte a request: a fold copies little
    flags = F.filter("r", lambda r, i: F.substr("taken", i + 1, F.lit(1)) == "1")
    return folded.select(*KEYS, F.explode(F.transform(flags, lambda r: r["id"])).alias("request_id"))


def _settle_hot(requests: DataFrame, hot_requests: int, held: Scratch) -> DataFrame:
    """Admitted requests of large keys, by phases of halving budgets.

    In a phase with (E, D) left, call a request small when it costs at most E/2 and at most D/2.  Until one
    of the amounts falls below half, every small request is admitted; the first larger request that fits
    ends the phase, and so does the small one that crosses a half.  Everything else is rejected.  A phase
    is a running sum over spread-out chunks and a minimum, and halves an amount, so the number of phases is
    logarithmic in budget over cost.  Keys whose affordable later requests fit one array leave for the fold.
    """
    edges = chunk_edges(requests, "request_id")
    rows = held(requests, "admission-requests")
    state = rows.groupBy(*KEYS).agg(
        F.first("__be").alias("e"), F.first("__bd").alias("d"), F.lit(None).cast("bigint").alias("after"))
    none_e, none_d = (F.lit(0).cast(t) for t in AMOUNTS.values())
    accepted = []
    while True:
        state = held(state, "admission-state")
        live = rows.select(*KEYS, "request_id", "__e", "__d").join(state, KEYS).filter(
            (F.col("after").isNull() | (F.col("request_id") > F.col("after"))) & (F.col("__e") <= F.col("e")) & (F.col("__d") <= F.col("d")))
        sizes = held(live.groupBy(*KEYS).agg((F.count("*") > hot_requests).alias("large")), "admission-sizes")
        settled = sizes.filter(~F.col("large")).select(*KEYS)
        accepted.append(_fold(live.join(settled, KEYS, "left_semi").withColumnsRenamed({"e": "__be", "d": "__bd"})))
        if sizes.filter("large").isEmpty():
            break
        small = (F.col("__e") + F.col("__e") <= F.col("e")) & (F.col("__d") + F.col("__d") <= F.col("d"))
        large = live.join(sizes.filter("large").select(*KEYS), KEYS, "left_semi").withColumn("__small", small)
        summed = running_sums(large, KEYS, ["request_id"], {
            "__se": F.when(F.col("__small"), F.col("__e")).otherwise(none_e),
            "__sd": F.when(F.col("__small"), F.col("__d")).otherwise(none_d)}, edges)
        left_e, left_d = (F.col("e") - F.col("__se")).cast(AMOUNTS["epsilon"]), (F.col("d") - F.col("__sd")).cast(AMOUNTS["delta"])
        crossing = F.col("__small") & ((left_e + left_e < F.col("e")) | (left_d + left_d < F.col("d")))
        fits = ~F.col("__small") & (F.col("__e") <= left_e) & (F.col("__d") <= left_d)
        after_e = F.when(F.col("__small"), left_e).otherwise(left_e - F.col("__e")).cast(AMOUNTS["epsilon"]).alias("e")
        after_d = F.when(F.col("__small"), left_d).otherwise(left_d - F.col("__d")).cast(AMOUNTS["delta"]).alias("d")
        # the first request that ends the phase; without one every small request of the key was admitted
        stop = F.min(F.when(crossing | fits, F.struct("request_id", after_e, after_d)))
        stops = held(summed.groupBy(*KEYS).agg(stop.alias("stop")), "admission-stop")
        at = F.coalesce(F.col("stop.request_id"), F.lit(2**63 - 1))
        taken = large.join(stops, KEYS).filter((F.col("__small") & (F.col("request_id") < at)) | (F.col("request_id") == at))
        accepted.append(taken.select(*KEYS, "request_id"))
        state = stops.filter(F.col("stop").isNotNull()).select(
            *KEYS, F.col("stop.e").alias("e"), F.col("stop.d").alias("d"), F.col("stop.request_id").alias("after"))
    out = accepted[0]
    for part in accepted[1:]:
        out = out.unionByName(part)
    return out


def authorize(requests: DataFrame, users: DataFrame, datasets: DataFrame) -> DataFrame:
    """Append ``reason``: null when the user exists, may query, and holds the existing dataset."""
    known = users.select("user_name", F.col("may_query").alias("__may"), F.lit(True).alias("__user"))
    exists = datasets.select("dataset_name", F.lit(True).alias("__dataset"))
    grants = initial_budget(users).select(*KEYS, F.lit(True).alias("__grant"))
    reason = (
        F.when(F.col("__user").isNull(), "unknown user")
        .when(F.col("__dataset").isNull(), "unknown dataset")
        .when(F.col("__grant").isNull(), "no access to dataset")
        .when(~F.col("__may"), "user may not query")
    )
    return (
        requests.join(known, "user_name", "left").join(exists, "dataset_name", "left").join(grants, KEYS, "left")
        .select(*requests.columns, reason.alias("reason"))
    )


# -- archive -------------------------------------------------------------------------------------------------


def append_archive(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def previous_queries(archive: DataFrame, user: str, dataset: str) -> DataFrame:
    return archive.filter((F.col("user_name") == user) & (F.col("dataset_name") == dataset))


def decode_archive(archive: DataFrame) -> DataFrame:
    """Parse ``client_input`` by family into one nullable struct column per family; unknown families fail."""
    known = F.col("dp_librairy").isin(*FAMILY_SCHEMAS)
    parsed = {
        family: F.when(F.col("dp_librairy") == family, F.from_json("client_input", T.StructType.fromDDL(schema)))
        for family, schema in FAMILY_SCHEMAS.items()
    }
    checked = F.when(known, F.col("dp_librairy")).otherwise(F.raise_error(F.lit("unknown request family in archive")))
    return archive.withColumn("dp_librairy", checked).withColumns(parsed)


def latest_query(archive: DataFrame, order: list[str]) -> DataFrame:
    """The last archived row of each user, by partial aggregation."""
    rest = [c for c in archive.columns if c != "user_name"]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return archive.groupBy("user_name").agg(last).select("user_name", "last.*")


def require_budget(remaining: DataFrame, user: str, dataset: str, epsilon: float, delta: float) -> None:
    """Raise unless the remaining budget of one user and dataset covers a cost."""
    row = remaining.filter((F.col("user_name") == user) & (F.col("dataset_name") == dataset)).first()
    if row is None or row["remaining_epsilon"] < epsilon or row["remaining_delta"] < delta:
        raise InvalidQuery("not enough budget left")
