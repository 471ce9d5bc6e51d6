"""Folders that appear whole, and tables kept up to date batch by batch.

All paths go through Hadoop's file systems, so they may lie in any store Spark writes to. Publishing needs a
store that renames folders atomically.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

HIDDEN = "_unfinished"


def _store(spark: SparkSession, path: str):
    inner = spark._jvm.org.apache.hadoop.fs.Path(path)
    return inner.getFileSystem(spark._jsc.hadoopConfiguration()), inner


def exists(spark: SparkSession, path: str) -> bool:
    store, inner = _store(spark, path)
    return store.exists(inner)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder in order, without hidden ones; none if there is no folder."""
    store, inner = _store(spark, folder)
    if not store.exists(inner):
        return []
    found = [f.getPath().getName() for f in store.listStatus(inner)]
    return sorted(n for n in found if not n.startswith(("_", ".")))


def publish(spark: SparkSession, hidden: str, final: str) -> None:
    """Give a finished folder its name; who looks for it sees all of it or nothing."""
    store, target = _store(spark, final)
    store.mkdirs(target.getParent())
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(hidden), target):
        raise OSError(f"cannot publish {final}")


def make_folder(spark: SparkSession, path: str) -> None:
    store, inner = _store(spark, path)
    store.mkdirs(inner)


def remove(spark: SparkSession, path: str) -> None:
    store, inner = _store(spark, path)
    store.delete(inner, True)


class KeptTable:
    """Rows of batches that merge: a snapshot of all batches up to one, and the batches since.

    ``merge`` combines rows of any batches into one row per key and may be applied again to its own
    result. After ``every`` batches the snapshot is renewed, so a read opens at most one snapshot and ``every``
    deltas however long the stream runs. The newest snapshot's name is the pointer: it appears by one rename,
    and what it replaces stays until the next one, so that readers under way are not disturbed. A batch that
    is given again after a failure is not counted twice.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], schema: str, every: int = 16) -> None:
        self.spark, self.path, self.merge, self.schema, self.every = spark, path, merge, schema, every

    def folders(self) -> list[str]:
        """What a read opens."""
        upto, deltas = self._since()
        return ([f"{self.path}/snapshots/{upto:012d}"] if upto >= 0 else []) + [f"{self.path}/deltas/{d:012d}" for d in deltas]

    def _snapshots(self) -> list[int]:
        return [int(n) for n in names(self.spark, f"{self.path}/snapshots")]

    def _since(self) -> tuple[int, list[int]]:
        upto = max(self._snapshots(), default=-1)
        return upto, [d for d in map(int, names(self.spark, f"{self.path}/deltas")) if d > upto]

    def read(self) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f) for f in self.folders()]
        return self.merge(reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], self.schema)))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        upto, deltas = self._since()
        if batch_id <= upto or batch_id in deltas:
            return
        self._write(self.merge(rows), "deltas", batch_id)
        if len(deltas) + 1 >= self.every:
            self.compact()

    def compact(self) -> None:
        """Fold all deltas into a new snapshot, and clear what the last one had replaced."""
        before, deltas = self._since()
        if not deltas:
            return
        self._write(self.read(), "snapshots", max(deltas))
        for kind, last in (("deltas", before + 1), ("snapshots", before)):
            for name in names(self.spark, f"{self.path}/{kind}"):
                if int(name) < last:
                    remove(self.spark, f"{self.path}/{kind}/{name}")

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        hidden = f"{self.path}/{HIDDEN}/{kind}-{number:012d}"
        rows.write.mode("overwrite").parquet(hidden)
        publish(self.spark, hidden, f"{self.path}/{kind}/{number:012d}")
