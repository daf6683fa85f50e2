"""A data source of trial files: text files whose lines are an id and samples, separated by commas. Files are
listed and read through the Hadoop-compatible readers of Arrow, one partition a file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TrialReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _system(self):
        from pyarrow import fs

        uri = self.folder if ":/" in self.folder else f"file://{self.folder}"
        return fs.FileSystem.from_uri(uri)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self._system()
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple[int, list[float]]]:
        system, _ = self._system()
        with system.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                if line:
                    first, *rest = line.split(",")
                    yield int(first), [float(x) for x in rest]


class TrialSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trial_csv"

    def schema(self) -> str:
        return "trial_id long, samples array<double>"

    def reader(self, schema) -> DataSourceReader:
        return TrialReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrialSource)
