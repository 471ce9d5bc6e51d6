"""CSV, JSON and Parquet readers and writers with fixed schemas.

Parquet is the format between stages. CSV and JSON exist for exchange: CSV and JSON Lines split
into tasks; a JSON array file is one task per file and suits reports, not tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowhunt.functions.columns import nan_to_null
from flowhunt.schemas import ALERT, CAMPAIGN, EXPLANATION, FLOW, INCIDENT

ENRICHED = T.StructType(
    FLOW.fields
    + [T.StructField(f"flag_{n}", T.BooleanType())
       for n in ("high_packet", "long_duration", "high_dns_entropy", "deep_dns")]
    + [T.StructField("suspicion_score", T.IntegerType())]
)


_CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def text_times(schema: T.StructType) -> T.StructType:
    """The schema with timestamps as text, to accept any number of fraction digits."""
    return T.StructType(
        [T.StructField(f.name, T.StringType()) if f.dataType == T.TimestampType() else f for f in schema.fields]
    )


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def read_flows_csv(spark: SparkSession, path: str, schema: T.StructType = FLOW) -> DataFrame:
    """Flow CSV with a header; NaN cells become NULL."""
    raw = spark.read.schema(text_times(schema)).option("header", True).option("enforceSchema", False)
    return nan_to_null(cast_to(raw.csv(path), schema))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("timestampFormat", _CSV_TIME).csv(path)


def _read_json(spark: SparkSession, path: str, schema: T.StructType, array_file: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", array_file).json(path)


def read_alerts_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Alerts as JSON Lines, or as array files with ``array_file=True``."""
    return _read_json(spark, path, ALERT, array_file)


def read_incidents_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    return _read_json(spark, path, INCIDENT, array_file)


def read_campaigns_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    return _read_json(spark, path, CAMPAIGN, array_file)


def read_explanations_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    return _read_json(spark, path, EXPLANATION, array_file)


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines."""
    df.write.json(path)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet table in Parquet."""
    return spark.read.parquet(path)


def number_from_alert_id(alerts: DataFrame) -> DataFrame:
    """Alerts read from a file, with the ``alert_no`` that orders timelines."""
    return alerts.withColumn("alert_no", F.regexp_extract("alert_id", r"(\d+)$", 1).cast("bigint"))
