"""Arrow IPC (Feather) files as a Spark data source: one partition per record batch."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


@dataclass
class BatchPartition(InputPartition):
    path: str
    batch: int


def arrow_files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "*.feather")))
    return sorted(glob.glob(path))


class ArrowFileSource(DataSource):
    """Reads files on storage that every executor mounts under the same path."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self):
        import pyarrow as pa

        with pa.memory_map(arrow_files(self.options["path"])[0]) as source:
            return from_arrow_schema(pa.ipc.open_file(source).schema)

    def reader(self, schema) -> DataSourceReader:
        return ArrowFileReader(self.options["path"])


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import pyarrow as pa

        parts: list[InputPartition] = []
        for name in arrow_files(self.path):
            with pa.memory_map(name) as source:
                count = pa.ipc.open_file(source).num_record_batches
            parts += [BatchPartition(name, i) for i in range(count)]
        return parts

    def read(self, partition: BatchPartition) -> Iterator:
        import pyarrow as pa

        with pa.memory_map(partition.path) as source:
            yield pa.ipc.open_file(source).get_batch(partition.batch)


def register_arrow_source(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFileSource)
