"""SQL over one table: rows as dictionaries, errors as a row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .sources.files import data_table


class SqlTool:
    """query(sql) over a data file that stands as the view data (hscode for a code lookup)."""

    def __init__(self, spark: SparkSession, source: str | DataFrame, view: str = "data"):
        self.spark = spark
        self.frame = data_table(spark, source) if isinstance(source, str) else source
        self.frame.createOrReplaceTempView(view)

    def frame_of(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def query(self, sql: str) -> list[dict[str, Any]]:
        """The result's rows, which the caller asked for; an error of any kind is one row with the key error."""
        try:
            return [r.asDict(recursive=True) for r in self.frame_of(sql).collect()]
        except Exception as e:  # noqa: BLE001  the tool answers with the error
            return [{"error": str(e)}]
