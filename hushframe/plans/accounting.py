"""Privacy cost of requests: closed forms for one plan and column arithmetic for a table of requests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.plans.primitives import PARTS


@dataclass(frozen=True)
class Cost:
    epsilon: float
    delta: float = 0.0

    def __add__(self, other: Cost) -> Cost:
        return Cost(self.epsilon + other.epsilon, self.delta + other.delta)


def check_budget(epsilon: float, delta: float = 0.0) -> None:
    if not epsilon > 0:
        raise InvalidQuery("epsilon must be positive")
    if not 0 <= delta < 1:
        raise InvalidQuery("delta must lie in [0, 1)")


def grouped_cost(n_primitives: int, epsilon: float, delta: float) -> Cost:
    """Aggregate query: epsilon per distinct primitive; delta for the threshold, delta/2 per primitive."""
    return Cost(n_primitives * epsilon, 1.0 - (1.0 - delta) * (1.0 - delta / 2.0) ** n_primitives)


def pure_cost(sensitivity: float, scale: float) -> Cost:
    return Cost(sensitivity / scale)


def zcdp_cost(sensitivity: float, sigma: float, delta: float | None) -> Cost:
    """rho = (sensitivity/sigma)^2/2, then epsilon = rho + 2 sqrt(rho ln(1/delta)) (Bun, Steinke 2016)."""
    if delta is None or not 0 < delta < 1:
        raise InvalidQuery("Gaussian noise needs a fixed delta in (0, 1)")
    rho = (sensitivity / sigma) ** 2 / 2.0
    return Cost(rho + 2.0 * math.sqrt(rho * math.log(1.0 / delta)), delta)


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    """Smallest sigma whose zCDP cost is (epsilon, delta); inverse of ``zcdp_cost``, valid for every epsilon."""
    if not 0 < delta < 1:
        raise InvalidQuery("Gaussian noise needs delta in (0, 1)")
    log_inverse = math.log(1.0 / delta)
    root = math.sqrt(log_inverse + epsilon) - math.sqrt(log_inverse)
    return sensitivity / (math.sqrt(2.0) * root)


# Families of requests and privacy measures, as named in request tables.
FAMILIES = ("sql", "measurement", "ml", "synth")
MEASURES = ("max_divergence", "zero_concentrated", "smoothed_max", "fixed_smoothed_max")

REQUEST_SCHEMA = (
    "request_id bigint, family string, epsilon double, delta double, "
    "aggs array<struct<function: string, column: string>>, steps array<struct<name: string, epsilon: double>>, "
    "measure string, input_kind string, sensitivity double, scale double, fixed_delta double, synthesizer string"
)


def _primitive_count() -> Column:
    """Distinct (kind, column) pairs behind the aggregates of one request, without a shuffle."""
    parts = F.create_map(*[x for f, kinds in PARTS.items() for x in (F.lit(f), F.array(*map(F.lit, kinds)))])
    per_aggregate = F.transform(
        F.col("aggs"),
        lambda a: F.transform(parts[a["function"]], lambda k: F.concat_ws(" ", k, F.coalesce(a["column"], F.lit("*")))),
    )
    return F.size(F.array_distinct(F.flatten(per_aggregate)))


def price(requests: DataFrame) -> DataFrame:
    """Append ``cost_epsilon`` and ``cost_delta``; both null where ``invalid_requests`` would refuse."""
    n = _primitive_count()
    rho = F.pow(F.col("sensitivity") / F.col("scale"), F.lit(2.0)) / 2.0
    zcdp = rho + 2.0 * F.sqrt(rho * -F.ln("fixed_delta"))
    pure = F.col("sensitivity") / F.col("scale")
    measured_eps = (
        F.when(F.col("measure") == "max_divergence", pure)
        .when(F.col("measure") == "zero_concentrated", zcdp)
        .otherwise(F.col("epsilon"))
    )
    measured_delta = (
        F.when(F.col("measure") == "max_divergence", F.lit(0.0))
        .when(F.col("measure") == "fixed_smoothed_max", F.col("delta"))
        .otherwise(F.col("fixed_delta"))
    )
    steps = F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["epsilon"])
    eps = (
        F.when(F.col("family") == "sql", n * F.col("epsilon"))
        .when(F.col("family") == "measurement", measured_eps)
        .when(F.col("family") == "ml", steps)
        .when(F.col("family") == "synth", F.col("epsilon"))
    )
    delta = (
        F.when(F.col("family") == "sql", 1.0 - (1.0 - F.col("delta")) * F.pow(1.0 - F.col("delta") / 2.0, n.cast("double")))
        .when(F.col("family") == "measurement", measured_delta)
        .when(F.col("family") == "ml", F.lit(0.0))
        .when(F.col("family") == "synth", F.when(F.col("synthesizer") == "mwem", F.lit(0.0)).otherwise(F.col("delta")))
    )
    valid = _reason().isNull()
    return requests.withColumns({"cost_epsilon": F.when(valid, eps), "cost_delta": F.when(valid, delta)})


def _reason() -> Column:
    """Why a request cannot be priced; null when it can."""
    is_measure = F.col("family") == "measurement"
    needs_delta = F.col("measure").isin("zero_concentrated", "smoothed_max") & (
        F.col("fixed_delta").isNull() | ~F.col("fixed_delta").between(F.lit(1e-300), F.lit(1.0 - 1e-15))
    )
    noisy_scale = F.col("measure").isin("max_divergence", "zero_concentrated")
    positive = F.coalesce(F.col("epsilon") > 0, F.lit(False))
    delta_ok = F.coalesce((F.col("delta") >= 0) & (F.col("delta") < 1), F.lit(False))
    known = F.array(*[F.lit(f) for f in PARTS])
    bad_aggregate = F.exists(F.col("aggs"), lambda a: ~F.array_contains(known, a["function"]))
    return (
        F.when(~F.coalesce(F.col("family").isin(*FAMILIES), F.lit(False)), F.lit("unknown family"))
        .when(is_measure & F.col("measure").isNull(), F.lit("not a measurement"))
        .when(is_measure & ~F.col("measure").isin(*MEASURES), F.lit("unknown measure"))
        .when(is_measure & ~F.coalesce(F.col("input_kind") == "dataset", F.lit(False)), F.lit("input is not a dataset"))
        .when(is_measure & needs_delta, F.lit("fixed delta required"))
        .when(is_measure & noisy_scale & ~F.coalesce(F.col("scale") > 0, F.lit(False)), F.lit("no noise scale"))
        .when(F.col("family").isin("sql", "synth") & ~positive, F.lit("epsilon must be positive"))
        .when((F.col("family") == "sql") & ~delta_ok, F.lit("delta must lie in [0, 1)"))
        .when((F.col("family") == "sql") & (F.coalesce(F.size("aggs"), F.lit(0)) <= 0), F.lit("no aggregate"))
        .when((F.col("family") == "sql") & bad_aggregate, F.lit("unsupported aggregate"))
        .when((F.col("family") == "ml") & (F.coalesce(F.size("steps"), F.lit(0)) <= 0), F.lit("no step"))
        .when((F.col("family") == "synth") & (F.col("synthesizer") == "mwem") & (F.coalesce(F.col("delta"), F.lit(0.0)) != 0),
              F.lit("mwem takes no delta"))
        .when((F.col("family") == "synth") & (F.col("synthesizer") == "pacsynth"), F.lit("synthesizer not supported"))
    )


def invalid_requests(requests: DataFrame) -> DataFrame:
    """Requests that cannot be priced, with the reason."""
    return requests.withColumn("reason", _reason()).filter(F.col("reason").isNotNull()).select("request_id", "reason")
