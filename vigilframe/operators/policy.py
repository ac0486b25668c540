"""Network rule tables: decisions on single ports, anomalies, revisions.

Rules are rows (policy_id, rule_id, ord, effect, src_cidr, dst_cidr, proto, lo, hi, enabled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions import netaddr
from vigilframe.operators.decisions import matches


def numbered(rules: DataFrame) -> DataFrame:
    """Rules with address ranges as numbers."""
    out = rules.where("enabled") if "enabled" in rules.columns else rules
    for side in ("src", "dst"):
        low, length = netaddr.network_low(F.col(f"{side}_cidr")), netaddr.prefix_length(F.col(f"{side}_cidr"))
        out = out.withColumns({f"{side}_len": length, f"{side}_low": low, f"{side}_high": low + F.pow(F.lit(2), 32 - length).cast("long") - 1})
    return out


def decide_flows(flows: DataFrame, rules: DataFrame, default: str = "deny") -> DataFrame:
    """The first matching rule of each distinct (src_ip, dst_ip, proto, port), else the default. Addresses and rules of either family."""
    keys = ["src_ip", "dst_ip", "proto", "port"]
    f = flows.select(*keys).distinct()
    hit = f.join(matches(f, rules, ("proto", "lo", "hi")).withColumnRenamed("proto", "rule_proto"), ["src_ip", "dst_ip"])
    hit = hit.where(F.col("port").between(F.col("lo"), F.col("hi")) & ((F.col("rule_proto") == "any") | (F.col("rule_proto") == F.col("proto"))))
    best = hit.groupBy(*keys).agg(F.min_by(F.struct("rule_id", "effect"), "ord").alias("b"))
    return f.join(best, keys, "left").select(*keys, F.coalesce("b.rule_id", F.lit("default")).alias("rule_id"), F.coalesce("b.effect", F.lit(default)).alias("effect"))


def anomalies(rules: DataFrame) -> DataFrame:
    """Pairs of a rule and an earlier one that makes it pointless or contradicts it, in first-match order.

    Candidates share a network: each rule is listed under its own source network and its enclosing ones, so pairs whose sources do
    not touch are never formed.
    """
    r = numbered(rules)
    lengths = sorted(x[0] for x in r.select("src_len").distinct().collect())
    own = r.select("policy_id", F.col("src_len").alias("len"), F.col("src_low").alias("low"), F.struct(*r.columns).alias("a"))
    up = r.withColumn("len", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"))).where("len <= src_len")
    up = up.select("policy_id", "len", netaddr.prefix_of(F.col("src_low"), F.col("len")).alias("low"), F.struct(*r.columns).alias("b"))
    pair = own.join(up, ["policy_id", "len", "low"])
    both = pair.select("policy_id", F.when(F.col("a.ord") < F.col("b.ord"), F.col("a")).otherwise(F.col("b")).alias("x"),
                       F.when(F.col("a.ord") < F.col("b.ord"), F.col("b")).otherwise(F.col("a")).alias("y")).where("x.ord < y.ord").distinct()

    def inside(side: str) -> Column:
        return (F.col(f"x.{side}_low") <= F.col(f"y.{side}_low")) & (F.col(f"y.{side}_high") <= F.col(f"x.{side}_high"))

    def touch(side: str) -> Column:
        return (F.col(f"x.{side}_low") <= F.col(f"y.{side}_high")) & (F.col(f"y.{side}_low") <= F.col(f"x.{side}_high"))

    proto_in = (F.col("x.proto") == "any") | (F.col("x.proto") == F.col("y.proto"))
    proto_touch = proto_in | (F.col("y.proto") == "any")
    covers = inside("src") & inside("dst") & proto_in & (F.col("x.lo") <= F.col("y.lo")) & (F.col("y.hi") <= F.col("x.hi"))
    overlap = touch("src") & touch("dst") & proto_touch & (F.col("x.lo") <= F.col("y.hi")) & (F.col("y.lo") <= F.col("x.hi"))
    same = F.col("x.effect") == F.col("y.effect")
    kind = F.when(covers & ~same, "shadowed").when(covers & same, "redundant").when(overlap & ~same, "conflicting")
    return both.select("policy_id", F.col("y.rule_id").alias("rule_id"), F.col("x.rule_id").alias("because"), kind.alias("kind")).where("kind IS NOT NULL")


def broad_rules(rules: DataFrame) -> DataFrame:
    """Allow rules from or to anywhere, or for every port."""
    wide = F.array_compact(F.array(
        F.when(F.col("src_cidr").endswith("/0"), "any source"), F.when(F.col("dst_cidr").endswith("/0"), "any destination"),
        F.when((F.col("lo") == 0) & (F.col("hi") == 65535), "any port")))
    b = rules.where("effect = 'allow'").withColumn("why", wide).where(F.size("why") > 0)
    return b.select("policy_id", "rule_id", F.array_join("why", ",").alias("why"), F.when(F.size("why") >= 3, "HIGH").when(F.size("why") == 2, "MEDIUM").otherwise("LOW").alias("severity"))


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules added, removed, changed or moved, and whether access grew or shrank.

    A rule has moved if its place among the rules of both revisions is another, so an inserted rule moves none. Where both ends, the protocol and the ports of
    one version hold those of the other, a changed rule is wider or narrower.
    """
    content = ["effect", "src_cidr", "dst_cidr", "proto", "lo", "hi", "enabled"]
    sides = [f"{side}_{x}" for side in ("src", "dst") for x in ("low", "high")]

    def version(rules: DataFrame, name: str) -> DataFrame:
        full = rules if "enabled" in rules.columns else rules.withColumn("enabled", F.lit(True))
        spans = numbered(full.withColumn("on", F.col("enabled")).withColumn("enabled", F.lit(True))).withColumn("enabled", F.col("on"))
        return spans.select("policy_id", "rule_id", "ord", F.struct(*content).alias(name), F.struct(*sides).alias(f"{name}_span"))

    a, b = version(old, "a"), version(new, "b")
    common = a.withColumnRenamed("ord", "oa").join(b.withColumnRenamed("ord", "ob"), ["policy_id", "rule_id"])
    place = lambda c: F.row_number().over(Window.partitionBy("policy_id").orderBy(c, "rule_id"))
    live = common.where("a.enabled AND b.enabled").select("policy_id", "rule_id", place("oa").alias("was_at"), place("ob").alias("is_at"))
    j = a.drop("ord").join(b.drop("ord"), ["policy_id", "rule_id"], "full_outer").join(live, ["policy_id", "rule_id"], "left")
    change = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").when(F.col("was_at") != F.col("is_at"), "moved"))

    def holds(x: str, y: str) -> Column:
        inside = [(F.col(f"{x}_span.{side}_low") <= F.col(f"{y}_span.{side}_low")) & (F.col(f"{y}_span.{side}_high") <= F.col(f"{x}_span.{side}_high")) for side in ("src", "dst")]
        same_proto = (F.col(f"{x}.proto") == "any") | (F.col(f"{x}.proto") == F.col(f"{y}.proto"))
        return inside[0] & inside[1] & same_proto & (F.col(f"{x}.lo") <= F.col(f"{y}.lo")) & (F.col(f"{y}.hi") <= F.col(f"{x}.hi"))

    ea, eb = F.col("a.effect"), F.col("b.effect")
    grows = lambda c: F.when(c, "access-expanded").otherwise("access-reduced")
    switched = (F.col("b.enabled") & (eb == "allow")) | (F.col("a.enabled") & (ea == "deny"))
    impact = (
        F.when(F.col("a").isNull(), grows(eb == "allow")).when(F.col("b").isNull(), grows(ea != "allow")).when(F.col("a.enabled") != F.col("b.enabled"), grows(switched))
        .when(ea != eb, grows(eb == "allow")).when(holds("b", "a") & ~holds("a", "b"), grows(eb == "allow")).when(holds("a", "b") & ~holds("b", "a"), grows(eb != "allow")).otherwise("changed"))
    return j.withColumn("change", change).where("change IS NOT NULL").select("policy_id", "rule_id", "change", impact.alias("impact"), "was_at", "is_at")


def findings(rules: DataFrame, policies: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(policy_id, rule_id, finding, detail): anomalies, broad rules, allowing defaults of ``policies(policy_id, default)``, and references of ``refs`` (array of
    object ids of a rule) to objects that ``known(id)`` lacks."""
    live = rules.where("enabled") if "enabled" in rules.columns else rules
    odd = anomalies(live).select("policy_id", "rule_id", F.col("kind").alias("finding"), F.col("because").alias("detail"))
    wide = broad_rules(live).select("policy_id", "rule_id", F.lit("overly-broad").alias("finding"), F.col("why").alias("detail"))
    out = odd.unionByName(wide)
    if policies is not None:
        out = out.unionByName(policies.where("default = 'allow'").select("policy_id", F.lit(None).cast("string").alias("rule_id"), F.lit("default-allow").alias("finding"), F.lit("default").alias("detail")))
    if known is not None and "refs" in rules.columns:
        named = live.select("policy_id", "rule_id", F.explode("refs").alias("detail"))
        real = named.where(F.contains("detail", F.lit(":")) & ~F.col("detail").startswith("cidr:") & ~F.contains("detail", F.lit("*")) & ~F.split_part("detail", F.lit(":"), F.lit(2)).startswith("arn"))
        gone = real.join(known.select(F.col("id").alias("detail")), "detail", "left_anti")
        out = out.unionByName(gone.select("policy_id", "rule_id", F.lit("stale-reference").alias("finding"), "detail"))
    return out


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of two revisions that only one has: ``introduced`` and ``resolved``."""
    keys = ["policy_id", "rule_id", "finding", "detail"]
    tagged = before.distinct().withColumn("side", F.lit(1)).unionByName(after.distinct().withColumn("side", F.lit(2)))
    g = tagged.groupBy(*keys).agg(F.sum("side").alias("sides"))
    return g.where("sides < 3").select(*keys, F.when(F.col("sides") == 2, "introduced").otherwise("resolved").alias("status"))
