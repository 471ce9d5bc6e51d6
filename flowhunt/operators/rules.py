"""Declarative detection rules: a rule is a named predicate over the columns of a flow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowhunt.functions.columns import col_or_default


@dataclass(frozen=True)
class Rule:
    """``condition`` is SQL text, or a function from the input table to a boolean column."""

    name: str
    condition: str | Callable[[DataFrame], Column]
    boost: float
    indicator: str

    def matches(self, df: DataFrame) -> Column:
        return F.expr(self.condition) if isinstance(self.condition, str) else self.condition(df)


def _port_scan(df: DataFrame) -> Column:
    return col_or_default(df, "dst_port_count", 0) >= 20


def _flag(df: DataFrame, name: str) -> Column:
    return col_or_default(df, name, False).cast("boolean")


def _dns_beaconing(df: DataFrame) -> Column:
    to_resolver = (F.upper(col_or_default(df, "protocol", "")) == "UDP") & (
        col_or_default(df, "dst_port", -1) == 53
    )
    random_name = (col_or_default(df, "dns_entropy", 0.0) > 3.5) | _flag(df, "flag_high_dns_entropy")
    deep_name = (col_or_default(df, "dns_subdomain_depth", 0) >= 3) | _flag(df, "flag_deep_dns")
    return to_resolver & (col_or_default(df, "packets_per_second", 0.0) > 5) & random_name & deep_name


# Names, boosts, indicator texts and thresholds of the standard rules, in registry order.
STANDARD_RULES = (
    Rule("PORT_SCAN", _port_scan, 0.25, "high destination port diversity"),
    Rule("DNS_BEACONING", _dns_beaconing, 0.2, "suspicious high-entropy, repetitive DNS queries"),
)

# The rule set as the documentation words it; timing and throughput limits follow the pattern texts.
DOCUMENTED_RULES = (
    Rule("PORT_SCAN", "dst_port_count > 20 AND packets_per_second > 50", 0.25,
         "high destination port diversity"),
    Rule("DNS_ABUSE", "dns_entropy > 4.5 OR dns_subdomain_depth > 4", 0.2,
         "high entropy or deep subdomains"),
    Rule("C2_BEACONING", "packet_count >= 5 AND std_iat < 0.01", 0.2,
         "low inter-arrival variability"),
    Rule("DATA_EXFILTRATION", "bytes_per_second > 10000 AND bytes_sent >= 5000000", 0.2,
         "high throughput"),
)


def register_rule(rule: Rule, rules: tuple[Rule, ...] = STANDARD_RULES) -> tuple[Rule, ...]:
    """A rule set with ``rule`` added at the end, replacing one of the same name."""
    return tuple(r for r in rules if r.name != rule.name) + (rule,)


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = STANDARD_RULES) -> DataFrame:
    """Add ``triggered_rules``, ``rule_boost`` and ``rule_indicators``, in registry order.

    All rules are evaluated in one projection.
    """
    hits = [
        F.when(
            r.matches(df),
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(float(r.boost)).alias("boost"),
                F.lit(r.indicator).alias("indicator"),
            ),
        )
        for r in rules
    ]
    fired = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return df.withColumn("_fired", fired).select(
        *df.columns,
        F.transform("_fired", lambda h: h["rule"]).alias("triggered_rules"),
        F.aggregate("_fired", F.lit(0.0), lambda total, h: total + h["boost"]).alias("rule_boost"),
        F.transform("_fired", lambda h: h["indicator"]).alias("rule_indicators"),
    )


def rule_hits(df: DataFrame, name: str, rules: tuple[Rule, ...] = STANDARD_RULES) -> DataFrame:
    """Flows on which one rule fires."""
    rule = next(r for r in rules if r.name == name)
    return df.filter(rule.matches(df))
