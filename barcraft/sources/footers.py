"""Row counts of Parquet tables from file footers: no row and no column is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barcraft.session import settings

#: Parquet by the second data-source interface, which takes over counts.
_FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The count of one table; to be planned within ``settings(spark, **_FROM_FOOTERS)``."""
    return spark.read.parquet(path).groupBy().count()


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n) of the tables at ``paths``: tasks read footers, the driver gets one number a table.
    Raises where a table can only be counted by its rows."""
    rows = []
    with settings(spark, **_FROM_FOOTERS):
        for name, path in paths.items():
            df = counted(spark, path)
            if "PushedAggregation: [COUNT(*)]" not in df._jdf.queryExecution().executedPlan().toString():
                raise ValueError(f"{path} can't be counted from footers")
            rows.append((name, df.first()[0] or 0))  # a table without files has no footer
    return spark.createDataFrame(rows, "name string, n long")
