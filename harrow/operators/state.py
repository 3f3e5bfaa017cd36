"""Tables in hash partitions, changed a partition at a time, under one manifest.

    <path>/v<version>/<table>/__part=<p>/...    the rows of a partition as that version wrote them
    <path>/manifest/v<version>                  for each table and partition the version that counts, and notes

A change reads and writes the partitions that it touches and no others. Nothing counts
before commit() has written the manifest, whole, for all tables at once; a reader of the
version before it still finds its files, those of older versions go.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.sources.scratch import names_in, removed

PARTS = 64


class PartitionedState:
    """The tables under path, as of the last commit and with what was changed since."""

    def __init__(self, spark: SparkSession, path: str, n_parts: int = PARTS):
        self.spark, self.path, self.n_parts = spark, path.rstrip("/"), n_parts
        self._load()

    def _load(self) -> None:
        """The last manifest that was written whole; what later versions left behind goes."""
        self.version, self.tables, self.notes, self.old = 0, {}, {}, []
        for version in sorted((int(n[1:]) for n in names_in(self.spark, f"{self.path}/manifest")), reverse=True):
            if "_SUCCESS" in names_in(self.spark, f"{self.path}/manifest/v{version}"):
                found = json.loads(self.spark.read.text(f"{self.path}/manifest/v{version}", wholetext=True).first()[0])
                self.version, self.n_parts, self.tables, self.notes, self.old = version, found["n_parts"], found["tables"], found["notes"], found["old"]
                break
        for name in names_in(self.spark, self.path):
            if name.startswith("v") and int(name[1:]) > self.version:
                removed(self.spark, f"{self.path}/{name}")
        self.committed = dict(self.tables)

    def discard(self) -> None:
        """Forget what was changed since the last commit."""
        self._load()

    def _part(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.n_parts)).cast("int")

    def _written(self, name: str, key: str, df: DataFrame) -> list[str]:
        """Write rows under the next version; the partitions that have some."""
        path = f"{self.path}/v{self.version + 1}/{name}"
        if names_in(self.spark, path):
            raise RuntimeError(f"{name} has been changed since the last commit")
        df.withColumn("__part", self._part(key)).repartition("__part").write.partitionBy("__part").parquet(path)
        return [n.removeprefix("__part=") for n in names_in(self.spark, path) if n.startswith("__part=")]

    def put(self, name: str, key: str, df: DataFrame) -> None:
        """Replace a table, or make it."""
        parts = dict.fromkeys(self._written(name, key, df), self.version + 1)
        self.tables[name] = {"key": key, "schema": df.schema.json(), "parts": parts}

    def table(self, name: str, parts: list[str] | None = None) -> DataFrame:
        """A table, or some partitions of it."""
        at = self.tables[name]
        paths = [f"{self.path}/v{v}/{name}/__part={p}" for p, v in at["parts"].items() if parts is None or p in parts]
        schema = StructType.fromJson(json.loads(at["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merge(self, name: str, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Put combine(old rows, changes) in place of the partitions that hold keys of changes; gives these partitions.

        changes is read more than once: a stored table. combine must not change keys.
        """
        at = self.tables[name]
        touched = [str(r[0]) for r in changes.select(self._part(at["key"])).distinct().collect()]  # n_parts numbers at most
        if touched:
            schema = StructType.fromJson(json.loads(at["schema"]))
            out = combine(self.table(name, touched), changes).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
            new = self._written(name, at["key"], out)
            parts = {p: v for p, v in at["parts"].items() if p not in touched}
            self.tables[name] = at | {"parts": parts | dict.fromkeys(new, self.version + 1)}
        return touched

    def commit(self, **notes) -> None:
        """Make the changes count, with notes beside them; partitions that nobody needs any more go."""
        live = {(v, n, p) for n, t in self.tables.items() for p, v in t["parts"].items()}
        gone = [[v, n, p] for n, t in self.committed.items() for p, v in t["parts"].items() if (v, n, p) not in live]
        found = {"n_parts": self.n_parts, "tables": self.tables, "notes": notes, "old": gone}
        self.spark.createDataFrame([(json.dumps(found),)], "manifest string").coalesce(1).write.text(f"{self.path}/manifest/v{self.version + 1}")
        for v, name, part in self.old:
            removed(self.spark, f"{self.path}/v{v}/{name}/__part={part}")
        removed(self.spark, f"{self.path}/manifest/v{self.version - 1}")
        self.version, self.notes, self.old, self.committed = self.version + 1, notes, gone, dict(self.tables)
