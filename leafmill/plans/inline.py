"""Small inline relations: the same rows for Spark and, as VALUES, for its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


class Inline:
    """Rows with a DDL schema."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [f.split()[0] for f in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
        body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {kinds[f.split()[1]]}) AS {n}" for n, f in zip(self.names, self.schema.split(", "), strict=True))
        return f"(SELECT {casts} FROM (VALUES {body}) AS v({', '.join(self.names)}))"
