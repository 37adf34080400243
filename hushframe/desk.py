"""One place to price, run and rehearse requests of one user against one dataset.

The order is: access, price (no data), budget, debit, release, so that a failure never leaves a release
unpaid.  Many requests at once are admitted by ``operators.ledger.admit`` or ``streaming.admission`` instead.
"""

from __future__ import annotations

import json
import threading
import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.errors import AccessDenied, InternalFailure, InvalidQuery, LibraryFailure, PrivacyEngineError
from hushframe.functions.noise import Secure, Seeded
from hushframe.metadata import TableMeta
from hushframe.ml.chain import DPPipeline
from hushframe.operators.aggregate import PrivateQuery
from hushframe.operators.archive_log import ArchiveLog
from hushframe.operators.ledger import latest_query, previous_queries, remaining_budget, require_budget
from hushframe.operators.measure import Measure
from hushframe.plans.accounting import Cost
from hushframe.session import fresh_path, written
from hushframe.sources.dummy import DEFAULT_ROWS, DEFAULT_SEED, dummy
from hushframe.synth.aim import aim
from hushframe.synth.factors import sample
from hushframe.synth.mst import fit_mst
from hushframe.synth.prepare import DEFAULT_SAMPLES, check_request
from hushframe.synth.weights import mwem

ARCHIVE = (
    "entry_id bigint, user_name string, dataset_name string, dp_librairy string, client_input string, response string, "
    "timestamp double, spent_epsilon double, spent_delta double"
)


class Request(Protocol):
    family: str

    def cost(self, meta: TableMeta, spark: SparkSession) -> Cost: ...

    def run(self, df: DataFrame, meta: TableMeta, mode: Secure | Seeded) -> DataFrame: ...

    def describe(self) -> dict: ...


@dataclass(frozen=True)
class AggregateRequest:
    """Grouped aggregates; options are those of ``PrivateQuery``."""

    aggs: tuple
    options: dict = field(default_factory=dict)
    family = "smartnoise_sql"

    def _query(self, meta: TableMeta) -> PrivateQuery:
        return PrivateQuery(meta=meta, aggs=tuple(self.aggs), **self.options)

    def cost(self, meta, spark):
        return self._query(meta).cost()

    def run(self, df, meta, mode):
        return self._query(meta).noisy(df, mode)

    def describe(self):
        return {"aggregates": [a.label for a in self.aggs], **{k: str(v) for k, v in self.options.items()}}


@dataclass(frozen=True)
class MeasureRequest:
    """A measurement built from a table, e.g. ``lambda m: m.column("x").clamp(0, 1).sum().laplace(2.0)``."""

    build: Callable[[Measure], Measure]
    row_key: tuple[str, ...] = ()
    fixed_delta: float | None = None
    family = "opendp"

    def _measure(self, df: DataFrame, meta: TableMeta) -> Measure:
        return self.build(Measure(df, max_ids=meta.max_ids, row_key=self.row_key))

    def cost(self, meta, spark):
        return self._measure(spark.createDataFrame([], meta.to_struct()), meta).cost(self.fixed_delta)

    def run(self, df, meta, mode):
        return self._measure(df, meta).noisy(mode)

    def describe(self):
        return {"row_key": list(self.row_key), "fixed_delta": self.fixed_delta}


@dataclass(frozen=True)
class ModelRequest:
    """Train a chain of private steps; the release is its parameters and, with a budget for it, its score."""

    chain: DPPipeline
    features: tuple[str, ...]
    target: str | None
    key: tuple[str, ...]
    score_epsilon: float | None = None
    test_size: float = 0.2
    split_seed: int = 1
    imputer: str = "drop"
    family = "diffprivlib"

    def cost(self, meta, spark):
        # models are trained with noise for single rows; a unit of several rows pays for each of them
        rows = self.chain.cost() + Cost(self.score_epsilon or 0.0)
        return Cost(rows.epsilon * meta.max_ids)

    def run(self, df, meta, mode):
        fitted = self.chain.fit(df, list(self.features), self.target, list(self.key), mode, self.test_size, self.split_seed, self.imputer)
        rows = fitted.model.to_frame(df.sparkSession)
        if self.score_epsilon:
            scored = fitted.score(self.score_epsilon, mode)
            rows = rows.unionByName(scored.select(
                F.lit(f"score_{scored.columns[0]}").alias("name"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.col(scored.columns[0]).alias("value")))
        return rows

    def describe(self):
        return {"steps": [type(s).__name__ for s in self.chain.steps], "feature_columns": list(self.features), "target_columns": [self.target],
                "test_size": self.test_size, "test_train_split_seed": self.split_seed, "imputer_strategy": self.imputer}


@dataclass(frozen=True)
class SynthRequest:
    """Synthetic rows, or with ``return_model`` the model's own table."""

    synthesizer: str
    epsilon: float
    delta: float | None = None
    select_cols: tuple[str, ...] = ()
    nullable: bool = False
    constraints: dict = field(default_factory=dict)
    params: dict = field(default_factory=dict)
    nb_samples: int = DEFAULT_SAMPLES
    condition: str | None = None
    return_model: bool = False
    family = "smartnoise_synth"

    def cost(self, meta, spark):
        check_request(self.synthesizer, self.epsilon, self.delta, self.return_model)
        return Cost(self.epsilon, self.delta or 0.0)

    def run(self, df, meta, mode):
        common = dict(nullable=self.nullable, overrides=self.constraints, max_ids=meta.max_ids, **self.params)
        columns = list(self.select_cols) or None
        if self.synthesizer == "mwem":
            model = mwem(df, meta, columns, self.epsilon, mode, **common)
        else:
            model = {"mst": fit_mst, "aim": aim}[self.synthesizer](df, meta, columns, self.epsilon, self.delta, mode, **common)
        return model.to_frame(df.sparkSession) if self.return_model else sample(model, df.sparkSession, self.nb_samples, self.condition)

    def describe(self):
        return {"synth_name": self.synthesizer, "epsilon": self.epsilon, "delta": self.delta, "select_cols": list(self.select_cols),
                "nullable": self.nullable, "nb_samples": self.nb_samples, "condition": self.condition}


@dataclass
class QueryDesk:
    """Users and datasets as tables, private tables by name, and an append-only archive that is the ledger.

    Several desks may share an archive: a debit is committed only on the archive that it was decided on, and decided
    again if another desk was faster.  Within a desk, a user's requests are served one after the other.
    """

    spark: SparkSession
    users: DataFrame
    tables: dict[str, tuple[TableMeta, Callable[[], DataFrame]]]
    archive_path: str

    def __post_init__(self):
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._log = ArchiveLog(self.spark, self.archive_path, ARCHIVE)

    # -- looking --------------------------------------------------------------------------------------------

    def archive(self) -> DataFrame:
        return self._log.read()[1]

    def remaining(self, user: str, dataset: str) -> tuple[float, float]:
        self._access(user, dataset)
        mine = self.users.filter(F.col("user_name") == user)
        row = remaining_budget(mine, self.archive()).filter(F.col("dataset_name") == dataset).first()
        return row["remaining_epsilon"], row["remaining_delta"]

    def previous(self, user: str, dataset: str) -> DataFrame:
        self._access(user, dataset)
        return previous_queries(self.archive(), user, dataset)

    def latest(self) -> DataFrame:
        return latest_query(self.archive(), ["timestamp", "entry_id"])

    def cost(self, user: str, dataset: str, request: Request) -> Cost:
        """The price; touches no private row."""
        meta = self._access(user, dataset)
        return _guarded(lambda: request.cost(meta, self.spark))

    # -- doing ----------------------------------------------------------------------------------------------

    def rehearse(self, user: str, dataset: str, request: Request, rows: int = DEFAULT_ROWS, seed: int = DEFAULT_SEED) -> DataFrame:
        """The same request on a dummy table: free, not archived."""
        meta = self._access(user, dataset)
        table = dummy(self.spark, meta, rows, seed)
        _guarded(lambda: request.cost(meta, self.spark))
        return _guarded(lambda: written(request.run(table, meta, Secure()), "rehearsal"))

    def query(self, user: str, dataset: str, request: Request) -> DataFrame:
        """Debit, then release: the stored rows of one draw."""
        meta = self._access(user, dataset)
        with self._locks[user]:
            price = _guarded(lambda: request.cost(meta, self.spark))
            mine, path = self.users.filter(F.col("user_name") == user), fresh_path(self.spark, "release")

            def debit(archive: DataFrame) -> list[tuple]:
                require_budget(remaining_budget(mine, archive), user, dataset, price.epsilon, price.delta)
                told = json.dumps({"dataset_name": dataset, **request.describe()})
                return [(time.time_ns(), user, dataset, request.family, told, path, time.time(), price.epsilon, price.delta)]

            self._log.append(debit)
            return _guarded(lambda: written(request.run(self.tables[dataset][1](), meta, Secure()), "release", path))

    def _access(self, user: str, dataset: str) -> TableMeta:
        row = self.users.filter(F.col("user_name") == user).select(
            "may_query", F.exists("datasets_list", lambda d: d["dataset_name"] == dataset).alias("holds")).first()
        if row is None:
            raise AccessDenied(f"unknown user {user}")
        if dataset not in self.tables:
            raise InvalidQuery(f"unknown dataset {dataset}")
        if not row["holds"]:
            raise AccessDenied(f"{user} has no access to {dataset}")
        if not row["may_query"]:
            raise AccessDenied(f"{user} may not query")
        return self.tables[dataset][0]


def _guarded(step: Callable):
    """Own errors pass; wrong arguments become a library failure; anything else says nothing of the data."""
    try:
        return step()
    except PrivacyEngineError:
        raise
    except (TypeError, ValueError, KeyError) as err:
        raise LibraryFailure(f"{type(err).__name__}: {err}") from None
    except Exception:
        raise InternalFailure("the query failed; ask the data owner") from None
