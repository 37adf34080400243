"""Declared facts about a private table: types, public bounds, categories and contribution limits.

Everything here runs on the driver and never looks at data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from hushframe.errors import InvalidQuery

_SPARK_TYPES = {
    ("string", None): T.StringType(),
    ("boolean", None): T.BooleanType(),
    ("datetime", None): T.TimestampType(),
    ("int", 32): T.IntegerType(),
    ("int", 64): T.LongType(),
    ("float", 32): T.FloatType(),
    ("float", 64): T.DoubleType(),
}

# Names of the declared limits.
_LIMITS = ("max_partition_length", "max_influenced_partitions", "max_partition_contributions")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    precision: int | None = None
    lower: Any = None
    upper: Any = None
    categories: tuple | None = None
    nullable: bool = False
    private_id: bool = False
    max_partition_length: int | None = None
    max_influenced_partitions: int | None = None
    max_partition_contributions: int | None = None

    def __post_init__(self):
        if self.type not in {"string", "int", "float", "boolean", "datetime"}:
            raise InvalidQuery(f"{self.name}: unknown column type {self.type!r}")
        if self.type in {"int", "float"} and self.precision not in (32, 64):
            raise InvalidQuery(f"{self.name}: precision must be 32 or 64")
        if self.bounded and (self.lower is None or self.upper is None):
            raise InvalidQuery(f"{self.name}: lower and upper bounds are required")
        if self.lower is not None and self.upper is not None and self.lower > self.upper:
            raise InvalidQuery(f"{self.name}: lower bound above upper bound")
        for limit in _LIMITS:
            value = getattr(self, limit)
            if value is not None and value <= 0:
                raise InvalidQuery(f"{self.name}: {limit} must be positive")

    @property
    def bounded(self) -> bool:
        return self.type in {"float", "datetime"} or (self.type == "int" and self.categories is None)

    @property
    def kind(self) -> str:
        """Role in synthesis: categorical, continuous or datetime."""
        if self.type == "datetime":
            return "datetime"
        return "continuous" if self.bounded else "categorical"

    @property
    def statistic(self) -> str:
        """Name under which a sum of this column picks its noise mechanism."""
        if self.type == "float":
            return "sum_float"
        return "sum_large_int" if self.precision == 64 else "sum_int"

    @property
    def max_abs(self) -> float:
        if self.type not in {"int", "float"} or self.lower is None:
            raise InvalidQuery(f"{self.name}: a sum needs numeric bounds")
        return float(max(abs(self.lower), abs(self.upper)))

    @property
    def domain(self) -> list:
        """Public values of a groupable column."""
        if self.categories is not None:
            return list(self.categories)
        if self.type == "boolean":
            return [False, True]
        raise InvalidQuery(f"{self.name}: no public categories declared")

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPES[(self.type, self.precision if self.type in {"int", "float"} else None)]

    def to_dict(self) -> dict:
        out = {k: v for k, v in self.__dict__.items() if k != "name" and v is not None}
        if self.categories is not None:
            out["categories"], out["cardinality"] = list(self.categories), len(self.categories)
        return out


@dataclass(frozen=True)
class TableMeta:
    columns: dict[str, Column]
    max_ids: int = 1
    rows: int = 1
    row_privacy: bool = True
    censor_dims: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.max_ids <= 0 or self.rows <= 0:
            raise InvalidQuery("max_ids and rows must be positive")

    @classmethod
    def from_dict(cls, doc: dict) -> TableMeta:
        """Validate a metadata document (the parsed YAML or JSON mapping)."""
        columns = {}
        for name, spec in doc["columns"].items():
            spec = dict(spec)
            cardinality = spec.pop("cardinality", None)
            if cardinality is None:
                spec.pop("categories", None)
            elif len(spec.get("categories", ())) != cardinality:
                raise InvalidQuery(f"{name}: {cardinality} categories declared, {len(spec.get('categories', ()))} listed")
            else:
                spec["categories"] = tuple(spec["categories"])
            if spec.get("type") == "datetime":
                for bound in ("lower", "upper"):
                    if isinstance(spec.get(bound), str):
                        spec[bound] = datetime.fromisoformat(spec[bound])
            try:
                columns[name] = Column(name=name, **spec)
            except TypeError as err:
                raise InvalidQuery(f"{name}: {err}") from None
        known = {"max_ids", "rows", "row_privacy", "censor_dims"}
        return cls(columns=columns, **{k: v for k, v in doc.items() if k in known and v is not None})

    @property
    def private_id(self) -> str | None:
        """The declared column of privacy units, if there is one."""
        return next((c.name for c in self.columns.values() if c.private_id), None)

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise InvalidQuery(f"unknown column {name!r}")
        return self.columns[name]

    def to_struct(self, names: list[str] | None = None) -> T.StructType:
        """Schema that honours the declared precision; bounds travel as field metadata."""
        return T.StructType(
            [
                T.StructField(c.name, c.spark_type, True, {"privacy": json.dumps(c.to_dict(), default=str)})
                for c in (self.column(n) for n in names or self.columns)
            ]
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per declared column: the metadata as a table."""
        rows = [
            (c.name, c.type, c.precision, _text(c.lower), _text(c.upper),
             None if c.categories is None else [str(v) for v in c.categories], c.nullable, c.private_id)
            for c in self.columns.values()
        ]
        return spark.createDataFrame(
            rows,
            "column string, type string, precision int, lower string, upper string, "
            "categories array<string>, nullable boolean, private_id boolean",
        )


def _text(value) -> str | None:
    return None if value is None else str(value)
