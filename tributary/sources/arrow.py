"""Arrow IPC files as a Spark data source: spark.read.format("arrow_ipc").load(path)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class ArrowPart(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ArrowReader(DataSourceReader):
    """A partition for each run of record batches of a file; the file is memory-mapped, other batches aren't touched."""

    def __init__(self, paths: list[str], schema: StructType, batches: int):
        self.paths, self.names, self.batches = paths, [f.name for f in schema.fields], batches

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with pa.memory_map(path) as f:
                n = pa.ipc.open_file(f).num_record_batches
            out += [ArrowPart(path, i, min(n, i + self.batches)) for i in range(0, n, self.batches)]
        return out

    def read(self, partition: ArrowPart) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.path) as f:
            file = pa.ipc.open_file(f)
            for i in range(partition.first, partition.last):
                yield file.get_batch(i).select(self.names)


class ArrowSource(DataSource):
    """path: one file, or several separated by commas, in a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    @property
    def paths(self) -> list[str]:
        return [p for p in self.options["path"].split(",") if p]

    def schema(self) -> StructType:
        with pa.memory_map(self.paths[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.paths, schema, int(self.options.get("batches", "16")))


def read_arrow(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_ipc").load(",".join(paths))
