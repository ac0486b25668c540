"""Joins by address range and by name suffix, written as equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import netaddr


def most_specific(rows: DataFrame, address: str, networks: DataFrame, value: str, cidr: str = "cidr") -> DataFrame:
    """``value`` of the smallest network around each address, of either address family; null where there is none.

    Distinct addresses are expanded to their enclosing network at each prefix length of their family and joined by equality; a repeated address
    costs one lookup.
    """
    base, bits = F.substring_index(F.col(cidr), "/", 1), F.when(F.instr(cidr, "/") > 0, F.substring_index(F.col(cidr), "/", -1).try_cast("int"))
    nets = networks.select(F.col(value), netaddr.address_key(base).alias("a"), bits.alias("bits")).where("a IS NOT NULL")
    nets = nets.select(value, F.col("a.family").alias("family"), "a.hi", "a.lo", F.coalesce("bits", F.when(F.col("a.family") == 4, 32).otherwise(128)).alias("len"))
    nets = nets.withColumn("n", netaddr.network_key(F.col("family"), F.col("hi"), F.col("lo"), F.col("len"))).groupBy("family", "len", "n.hi", "n.lo").agg(F.min(value).alias(value))
    ips = rows.select(F.col(address)).distinct().withColumn("a", netaddr.address_key(F.col(address))).where("a IS NOT NULL")
    ips = ips.select(address, F.col("a.family").alias("family"), F.col("a.hi").alias("h"), F.col("a.lo").alias("l"))
    spread = ips.withColumn("len", F.explode(F.sequence(F.lit(0), F.when(F.col("family") == 4, 32).otherwise(128))))
    spread = spread.withColumn("n", netaddr.network_key(F.col("family"), F.col("h"), F.col("l"), F.col("len"))).select(address, "family", "len", "n.hi", "n.lo")
    best = spread.join(nets, ["family", "len", "hi", "lo"]).groupBy(address).agg(F.max_by(value, "len").alias(value))
    return rows.join(best, address, "left")


def most_specific_suffix(rows: DataFrame, name: str, suffixes: DataFrame, value: str, suffix: str = "suffix") -> DataFrame:
    """``value`` of the longest authorized suffix of each name (the name itself or a parent)."""
    labels = F.split(F.col(name), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = rows.select(name).distinct().withColumn("suffix_", F.explode(parents))
    table = suffixes.select(F.lower(F.col(suffix)).alias("suffix_"), F.col(value))
    best = spread.join(table, "suffix_").groupBy(name).agg(F.max_by(value, F.length("suffix_")).alias(value))
    return rows.join(best, name, "left")
