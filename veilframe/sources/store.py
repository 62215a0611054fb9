"""Where physical tables live: in the session, or as snapshots of Parquet in a folder that all executors share."""

from __future__ import annotations

from typing import Protocol
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from veilframe.names import normal


class TableStore(Protocol):
    """``token`` names an append: one that has been made under a token is not made again."""

    def names(self) -> list[str]: ...
    def read(self, name: str) -> DataFrame | None: ...
    def replace(self, name: str, df: DataFrame) -> None: ...
    def append(self, name: str, df: DataFrame, token: str | None = None) -> None: ...
    def fingerprint(self) -> str: ...


class SessionStore:
    """Tables as DataFrames of the session; nothing is written."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        self.tables = {normal(k): v for k, v in (tables or {}).items()}
        self.made: set[tuple[str, str]] = set()

    def names(self) -> list[str]:
        return list(self.tables)

    def read(self, name: str) -> DataFrame | None:
        return self.tables.get(normal(name))

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[normal(name)] = df

    def append(self, name: str, df: DataFrame, token: str | None = None) -> None:
        if token is not None:
            if (normal(name), token) in self.made:
                return
            self.made.add((normal(name), token))
        before = self.read(name)
        self.replace(name, df if before is None else before.unionByName(df, allowMissingColumns=True))

    def fingerprint(self) -> str:
        return "session"


class SnapshotStore:
    """Parquet snapshots root/table/v<n>, and what was appended to one in folders v<n>.<token> beside it. A folder counts once its
    _SUCCESS is there and is never written to afterwards, so readers see no half of a write, and an append that is repeated under its
    token after a failure is there once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._path(self.root))] if fs.exists(self._path(self.root)) else []

    def _folders(self, name: str) -> list[tuple[int, str]]:
        """(version, folder) of all that is complete."""
        fs, folder = self._fs(), self._path(f"{self.root}/{normal(name)}")
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder) if fs.exists(self._path(f"{s.getPath()}/_SUCCESS"))]
        return sorted((int(x[1:].partition(".")[0]), x) for x in found)

    def read(self, name: str) -> DataFrame | None:
        found = self._folders(name)
        return self.spark.read.parquet(*[f"{self.root}/{normal(name)}/{x}" for v, x in found if v == found[-1][0]]) if found else None

    def replace(self, name: str, df: DataFrame) -> None:
        found = self._folders(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{normal(name)}/v{found[-1][0] + 1 if found else 0}")

    def append(self, name: str, df: DataFrame, token: str | None = None) -> None:
        found = self._folders(name)
        token = token or uuid4().hex
        if any(x.partition(".")[2] == token for _, x in found):
            return
        df.write.mode("overwrite").parquet(f"{self.root}/{normal(name)}/v{found[-1][0] if found else 0}.{token}")

    def fingerprint(self) -> str:
        return self.root
