"""Named sources: a Parquet folder per table, or any DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Sources:
    """Tables by name.  A folder is opened when its table is first used."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str]) -> Sources:
        sources = cls(spark)
        for name in names:
            sources._paths[name] = f"{folder}/{name}.parquet"
        return sources

    def register(self, name: str, df: DataFrame) -> None:
        self._frames[name] = df

    def names(self) -> list[str]:
        return sorted({*self._frames, *self._paths})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._paths:
                raise KeyError(f"unknown source {name!r}; registered: {', '.join(self.names())}")
            self._frames[name] = self.spark.read.parquet(self._paths[name])
        return self._frames[name]

    def frames(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        return {n: self[n] for n in (names or self.names())}

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream of files, with the batch schema."""
        if name not in self._paths:
            raise KeyError(f"{name!r} was not registered from a path")
        path = self._paths[name]
        # As a glob the path may name one file or a folder of files.
        return self.spark.readStream.schema(self[name].schema).parquet(f"{path[:-1]}[{path[-1]}]")
