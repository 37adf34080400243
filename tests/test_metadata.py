import pytest
from pyspark.sql import types as T

from hushframe.errors import InvalidQuery
from hushframe.metadata import TableMeta


def meta(**column):
    return TableMeta.from_dict({"max_ids": 1, "rows": 10, "row_privacy": True, "columns": {"x": column}})


@pytest.mark.parametrize("column", [
    {"type": "string"},
    {"type": "string", "cardinality": 2, "categories": ["a", "b"]},
    {"type": "int", "precision": 32, "lower": 0, "upper": 5},
    {"type": "int", "precision": 64, "cardinality": 2, "categories": [1, 2]},
    {"type": "float", "precision": 32, "lower": 0.0, "upper": 0.0},
    {"type": "boolean", "nullable": True},
    {"type": "datetime", "lower": "2000-01-01", "upper": "2010-01-01"},
])
def test_accepts(column):
    assert meta(**column).columns["x"].type == column["type"]


@pytest.mark.parametrize("column", [
    {"type": "decimal"},
    {"type": "string", "cardinality": 3, "categories": ["a", "b"]},
    {"type": "int", "precision": 16, "lower": 0, "upper": 5},
    {"type": "int", "precision": 32, "lower": 6, "upper": 5},
    {"type": "float", "precision": 64, "lower": 0.0},
    {"type": "datetime", "lower": "2010-01-01", "upper": "2000-01-01"},
    {"type": "string", "max_partition_length": 0},
    {"type": "string", "surprise": 1},
])
def test_rejects(column):
    with pytest.raises(InvalidQuery):
        meta(**column)


@pytest.mark.parametrize("limits", [{"max_ids": 0}, {"rows": 0}])
def test_rejects_table_limits(limits):
    with pytest.raises(InvalidQuery):
        TableMeta.from_dict({"columns": {}, **limits})


def test_schema_and_kinds(spark):
    m = TableMeta.from_dict({"columns": {
        "a": {"type": "float", "precision": 32, "lower": 0, "upper": 1}, "b": {"type": "int", "precision": 64, "lower": 0, "upper": 1},
        "c": {"type": "string", "cardinality": 1, "categories": ["q"]}, "d": {"type": "datetime", "lower": "2000-01-01", "upper": "2001-01-01"}}})
    assert [f.dataType for f in m.to_struct().fields] == [T.FloatType(), T.LongType(), T.StringType(), T.TimestampType()]
    assert [c.kind for c in m.columns.values()] == ["continuous", "continuous", "categorical", "datetime"]
    assert m.to_frame(spark).count() == 4
