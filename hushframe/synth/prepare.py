"""Private rows to small integer codes, and checks shared by all synthesizers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.errors import InvalidQuery
from hushframe.functions.transform import Chain, Clamp, decode, default_plan, encode
from hushframe.metadata import TableMeta
from hushframe.plans.accounting import check_budget

# Synthesizers by name.
SYNTHESIZERS = ("aim", "mwem", "mst")
DEFAULT_SAMPLES = 200


@dataclass(frozen=True)
class Encoded:
    """Codes of the selected columns; ``sizes`` is the public number of codes per column."""

    codes: DataFrame
    plan: dict
    meta: TableMeta

    @property
    def sizes(self) -> dict[str, int]:
        return {c: t.codes for c, t in self.plan.items()}

    @property
    def domains(self) -> dict[str, list[int]]:
        return {c: list(range(k)) for c, k in self.sizes.items()}

    def decode(self, codes: DataFrame) -> DataFrame:
        return decode(codes, self.plan, self.meta)


def synth_encode(df: DataFrame, meta: TableMeta, columns: list[str] | None = None, nullable: bool = False,
                 overrides: dict | None = None) -> Encoded:
    """Discrete codes by the default plan; rows with a code outside the public domain are left out."""
    plan = default_plan(meta, columns, "cube", nullable, overrides)
    for name, step in plan.items():
        last = step.steps[-1] if isinstance(step, Chain) else step
        if isinstance(last, Clamp) or not hasattr(last, "codes"):
            raise InvalidQuery(f"{name}: a marginal synthesizer needs codes, add bins or labels")
    return Encoded(encode(df, plan).na.drop("any"), plan, meta)


def check_request(synthesizer: str, epsilon: float, delta: float | None, return_model: bool = False) -> None:
    if synthesizer not in SYNTHESIZERS:
        raise InvalidQuery(f"synthesizer {synthesizer!r} is not supported")
    if synthesizer == "mst" and return_model:
        raise InvalidQuery("mst returns samples only")
    if synthesizer == "mwem" and delta:
        raise InvalidQuery("mwem takes no delta")
    if synthesizer != "mwem" and not delta:
        raise InvalidQuery(f"{synthesizer} needs a positive delta")
    check_budget(epsilon, delta or 0.0)


def pair_cells(exact: DataFrame, columns: list[str]) -> DataFrame:
    """Marginal table in long form: ``marginal``, codes ``i`` and ``j`` (null for one column), ``n``."""
    codes = F.array_compact(F.array(*[F.col(c).cast("int") for c in columns]))
    return exact.select("marginal", codes[0].alias("i"), F.get(codes, F.lit(1)).alias("j"), "n")
