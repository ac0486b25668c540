"""Severity, confidence and criticality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered severity levels and the spellings accepted for them.
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_SYNONYMS = {
    "INFORMATIONAL": "INFO",
    "INFORMATION": "INFO",
    "NOTICE": "INFO",
    "DEBUG": "INFO",
    "NONE": "INFO",
    "WARN": "MEDIUM",
    "WARNING": "MEDIUM",
    "MODERATE": "MEDIUM",
    "ERROR": "HIGH",
    "IMPORTANT": "HIGH",
    "SEVERE": "HIGH",
    "CRIT": "CRITICAL",
    "ALERT": "CRITICAL",
    "EMERGENCY": "CRITICAL",
    "EMERG": "CRITICAL",
}
CONFIDENCE_LABELS = {"LOW": 0.3, "MEDIUM": 0.6, "MED": 0.6, "HIGH": 0.9, "CONFIRMED": 1.0, "CERTAIN": 1.0}
CRITICALITIES = ["low", "medium", "high", "critical"]


def lookup(key: Column, table: dict) -> Column:
    """``table[key]`` or null, as a CASE that stays inside codegen."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def severity_name(rank: Column) -> Column:
    return lookup(rank, dict(enumerate(SEVERITIES)))


def severity_from_score(score: Column) -> Column:
    """CVSS-like number to a level."""
    return (
        F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW")
        .otherwise("INFO")
    )


def severity_from_text(text: Column) -> Column:
    """Level for a spelled severity; null when the spelling is unknown, INFO when it is missing."""
    upper = F.upper(F.trim(text))
    named = F.when(upper.isin(SEVERITIES), upper).otherwise(lookup(upper, SEVERITY_SYNONYMS))
    return F.when(text.isNull(), F.lit("INFO")).otherwise(named)


def confidence_from_number(number: Column) -> Column:
    scaled = F.when((number > 1) & (number <= 100), number / 100.0).otherwise(number)
    return F.when(scaled.between(0, 1), F.round(scaled, 4))


def confidence_from_text(text: Column, default: float = 0.8) -> Column:
    upper = F.upper(F.trim(text))
    return (
        F.when(text.isNull() | (text == ""), F.lit(default))
        .when(upper.isin(list(CONFIDENCE_LABELS)), lookup(upper, CONFIDENCE_LABELS))
        .otherwise(confidence_from_number(upper.try_cast("double")))
    )


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def criticality_rank(criticality: Column) -> Column:
    return lookup(criticality, {c: i for i, c in enumerate(CRITICALITIES)})


def criticality(metadata_value: Column, tags: Column) -> Column:
    named = F.lower(F.trim(metadata_value))
    return F.when(metadata_value.isNotNull(), F.when(named.isin(CRITICALITIES), named)).when(
        F.array_contains(tags, "critical"), F.lit("critical")
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")
