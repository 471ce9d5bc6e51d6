"""Small column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MICROS = 1_000_000


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up rounding as plain floating-point arithmetic.

    Stays in generated code (the built-in ``round`` goes through arbitrary-precision decimals) and
    gives the same bits in any engine that does the same multiply, floor and divide.
    """
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def micros_to_seconds(micros: Column) -> Column:
    """Microseconds to seconds at microsecond resolution (six decimals)."""
    return F.floor(micros + F.lit(0.5)) / F.lit(float(MICROS))


def col_or_default(df: DataFrame, name: str, default) -> Column:
    """The column if the input has it, else a literal. A NULL cell stays NULL."""
    return F.col(name) if name in df.columns else F.lit(default)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Comparisons with NaN are true for ``>`` in Spark; rules expect them to be false."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def one_row(df: DataFrame, **values: Column) -> dict:
    """Dataset-wide aggregates as plain numbers: one job, one row.

    This is the fitting half of an operator. Its numbers enter the applying half as literals, so
    fitted stages do not nest inside each other's plans and nothing is joined. ``df`` is read for
    it: pass a stored table.
    """
    return df.agg(*[c.alias(n) for n, c in values.items()]).first().asDict()


def flow_key_string(prefix: str = "") -> Column:
    """``src:port_dst:port_proto``, the key form used by label files."""
    return F.format_string(
        "%s:%d_%s:%d_%s",
        *[F.col(prefix + c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")],
    )


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with microseconds and a ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_time(text: Column) -> Column:
    """ISO-8601 text, with or without fraction and ``Z``, to a UTC timestamp."""
    return F.to_timestamp(F.regexp_replace(text, "Z$", ""))


def anonymize_ip(ip: Column) -> Column:
    """Mask the last two octets of an IPv4 address."""
    return F.regexp_replace(ip, r"\.\d+\.\d+$", ".xxx.xxx")
