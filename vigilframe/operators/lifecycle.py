"""Comparing a stored set with a newly produced one: findings, keys, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.levels import SEVERITIES

# Statuses an analyst set by hand, which a re-run never overwrites.
STICKY = ["ACKNOWLEDGED", "FALSE_POSITIVE", "SUPPRESSED"]


def count_by_severity(findings: DataFrame) -> DataFrame:
    """Findings per level, levels without findings included."""
    levels = findings.sparkSession.createDataFrame(list(enumerate(SEVERITIES)), "severity_rank int, severity string")
    counted = findings.groupBy("severity_rank").agg(F.count("*").alias("c"))
    return F.broadcast(levels).join(counted, "severity_rank", "left").select(
        "severity", F.coalesce("c", F.lit(0).cast("long")).alias("n")
    )


def compare_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of two states once, as added, removed or common: one full outer join."""
    a = before.select(*keys).withColumn("in_a", F.lit(True))
    b = after.select(*keys).withColumn("in_b", F.lit(True))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("common")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def transition(stored: DataFrame, produced: DataFrame, candidates: Column | None = None) -> DataFrame:
    """Findings after a re-run.

    ``stored(id, status)`` and ``produced(id)``. Produced findings open or stay open unless an analyst decided
    otherwise; open ones that were not produced again resolve, within ``candidates`` only.
    """
    old = stored.select("id", F.col("status").alias("was"))
    new = produced.select("id").withColumn("present", F.lit(True))
    j = old.join(new, "id", "full_outer")
    was, present = F.col("was"), F.col("present").isNotNull()
    may_resolve = F.lit(True) if candidates is None else candidates
    gone = ~present & (was == "OPEN") & may_resolve
    status = (
        F.when(was.isNull(), "OPEN").when(present, F.when(was.isin(STICKY), was).otherwise("OPEN"))
        .when(gone, "RESOLVED").otherwise(was)
    )
    change = (
        F.when(was.isNull(), "created")
        .when(present, F.when(was == "RESOLVED", "reopened").otherwise("updated"))
        .when(gone, "resolved").otherwise("kept")
    )
    moved = was.isNotNull() & (status != was)
    history = F.when(moved, F.concat(was, F.lit(">"), status))
    return j.select("id", "was", status.alias("status"), change.alias("change"), history.alias("history"))
