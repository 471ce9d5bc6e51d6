"""Stored forests: one folder per version with nodes, scaler and metadata as Parquet.

A :class:`ModelStore` keeps versions and says which one is in use. A version appears whole, by one rename, and
is never changed. Which one is in use is the newest entry of a journal; making an entry is one step, so a
reader gets the old version or the new one, never parts of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowhunt.operators.forest import ROLLED, Forest, fit_forest, roll_forest
from flowhunt.schemas import FOREST_NODE
from flowhunt.sources.store import HIDDEN, make_folder, names, publish, remove

_PARTS = ("nodes", "scaling", "meta")


def save_model(forest: Forest, path: str) -> None:
    """Write a new version; an existing path is an error."""
    for part in _PARTS:
        getattr(forest, part).write.parquet(f"{path}/{part}")


def load_model(spark: SparkSession, path: str) -> Forest:
    return Forest(
        nodes=spark.read.schema(FOREST_NODE).parquet(f"{path}/nodes"),
        scaling=spark.read.schema("feature STRING, mean DOUBLE, std DOUBLE").parquet(f"{path}/scaling"),
        meta=spark.read.parquet(f"{path}/meta"),
    )


def retrain(flows: DataFrame, path: str, **params) -> Forest:
    """Fit on new flows, store the model under ``path`` and return the stored one."""
    save_model(fit_forest(flows, **params), path)
    return load_model(flows.sparkSession, path)


class ModelStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        return [int(n) for n in names(self.spark, f"{self.path}/versions")]

    def current(self) -> int | None:
        """The version in use."""
        journal = names(self.spark, f"{self.path}/journal")
        return int(journal[-1].split("-")[1]) if journal else None

    def load(self, version: int | None = None) -> Forest:
        version = self.current() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no model in {self.path}")
        return load_model(self.spark, f"{self.path}/versions/{version:06d}")

    def publish(self, forest: Forest) -> int:
        """Store a new version and put it in use."""
        version = max(self.versions(), default=0) + 1
        hidden = f"{self.path}/{HIDDEN}/{version:06d}"
        remove(self.spark, hidden)  # of a writer that failed
        save_model(forest, hidden)
        publish(self.spark, hidden, f"{self.path}/versions/{version:06d}")
        self.use(version)
        return version

    def use(self, version: int) -> None:
        """Switch to a stored version, an older one too."""
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        journal = names(self.spark, f"{self.path}/journal")
        entry = f"{int(journal[-1].split('-')[0]) + 1 if journal else 1:09d}-{version:06d}"
        make_folder(self.spark, f"{self.path}/journal/{entry}")

    def fit(self, flows: DataFrame, **params) -> Forest:
        """A first generation, or one from scratch."""
        return self.load(self.publish(fit_forest(flows, **params)))

    def roll(self, flows: DataFrame, share: float = ROLLED) -> Forest:
        """The next generation of the version in use, see ``operators.forest.roll_forest``."""
        return self.load(self.publish(roll_forest(self.load(), flows, share)[0]))
