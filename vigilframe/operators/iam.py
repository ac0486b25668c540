"""Identity and access: memberships, roles, holders, access paths and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import semantics as sem
from vigilframe.operators.graph import closure, union_all
from vigilframe.operators.loops import cut
from vigilframe.operators.propagate import propagate, propagation_arcs

# Relationships that grant, relationships that give access, resource types.
GRANTS = ["MEMBER_OF", "HAS_ROLE", "HAS_PERMISSION", "CAN_ACCESS", "ADMIN_OF", "CAN_ASSUME", "HAS_IDENTITY", "CONTAINS",
          "DEPLOYS_TO"]
ACCESS = GRANTS + ["USES", "LOGGED_INTO", "CONTAINS_SECRET", "AUTHENTICATES_AS", "TRUSTS", "RUNS", "OWNS"]
RESOURCES = ["host", "service", "cloud_resource", "container", "identity", "secret", "project", "repository", "database",
             "application"]
MAX_CHAIN = 10


def accounts(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type").isin("user", "identity")).select(F.col("id").alias("start"))


def memberships(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, chain): groups a principal is in, directly or through groups, with the shortest chain."""
    keep = (F.col("type") == "MEMBER_OF") & F.col("dst").startswith("group:")
    return closure(edges, starts, MAX_CHAIN, keep).where("hops > 0")


def roles(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, role, chain): roles held directly or through groups; the shortest chain of each."""
    held = edges.where("type = 'HAS_ROLE'").select(F.col("src").alias("node"), F.col("dst").alias("role"))
    own = starts.select("start", F.col("start").alias("node"), F.array("start").alias("chain"))
    holders = own.unionByName(memberships(edges, starts).select("start", "node", "chain"))
    with_role = holders.join(held, "node").select("start", "role", F.concat("chain", F.array("role")).alias("chain"))
    return with_role.groupBy("start", "role").agg(F.min_by("chain", F.struct(F.size("chain"), F.col("chain"))).alias("chain"))


def members(edges: DataFrame, holders: DataFrame) -> DataFrame:
    """(holder, member): accounts of a group, transitively; any other holder is its own member."""
    groups = holders.where(F.col("holder").startswith("group:"))
    keep = (F.col("type") == "MEMBER_OF")
    down = closure(edges, groups.select(F.col("holder").alias("start")), 50, keep, frm="dst", to="src")
    inside = down.where(F.substring_index("node", ":", 1).isin("user", "identity")).select(
        F.col("start").alias("holder"), F.col("node").alias("member"))
    alone = holders.where(~F.col("holder").startswith("group:")).select("holder", F.col("holder").alias("member"))
    return inside.unionByName(alone).distinct()


def role_holders(edges: DataFrame, roles_df: DataFrame | None = None) -> DataFrame:
    """(role, member) for every role."""
    held = edges.where("type = 'HAS_ROLE'").select(F.col("src").alias("holder"), F.col("dst").alias("role"))
    if roles_df is not None:
        held = held.join(roles_df.select("role"), "role", "left_semi")
    return held.join(members(edges, held.select("holder").distinct()), "holder").select("role", "member").distinct()


def access_holders(edges: DataFrame) -> DataFrame:
    """(resource, member): accounts granted access or administration directly, through groups or through roles."""
    grants = edges.where("type IN ('CAN_ACCESS', 'ADMIN_OF')").select(F.col("dst").alias("resource"), F.col("src").alias("holder"))
    grants = cut(grants.distinct())
    by_role = grants.where(F.col("holder").startswith("role:")).join(
        role_holders(edges).withColumnRenamed("role", "holder"), "holder").select("resource", "member")
    groups = grants.where(F.col("holder").startswith("group:"))
    by_group = groups.join(members(edges, groups.select("holder").distinct()), "holder").select("resource", "member")
    direct = grants.where(F.substring_index("holder", ":", 1).isin("user", "identity")).select(
        "resource", F.col("holder").alias("member"))
    return union_all([by_role, by_group, direct]).distinct()


def effective_access(edges: DataFrame, objects: DataFrame, starts: DataFrame | None = None, max_depth: int = 8) -> DataFrame:
    """(start, node, conf, depth, admin): resources a principal is entitled to over the grant graph."""
    granted = edges.where(F.col("type").isin(GRANTS))
    steps = propagation_arcs(granted, objects).withColumn("credential", F.col("rel") == "ADMIN_OF")
    reached = propagate(steps, accounts(objects) if starts is None else starts, max_depth, 0.2, held=True)
    out = reached.where(F.substring_index("node", ":", 1).isin(RESOURCES))
    return out.select("start", "node", F.round("conf", 3).alias("confidence"), "depth", F.col("credential").alias("admin"))


def privilege_paths(
    edges: DataFrame, objects: DataFrame, source: str, target: str, max_depth: int = 10, limit: int = 3
) -> DataFrame:
    """Best access paths from one principal to control of an object, and the alternatives found by leaving out one
    relationship of the best path at a time; all alternatives are searched in one job."""
    spark = edges.sparkSession
    steps = cut(propagation_arcs(edges.where(F.col("type").isin(ACCESS)), objects))

    def search(variants: list[tuple[str, list[str]]]) -> DataFrame:
        starts = spark.createDataFrame(
            [(name, source, banned) for name, banned in variants], "start string, node string, banned array<string>")
        got = propagate(steps, starts, max_depth, 0.01, keep_path=True)
        return got.where((F.col("node") == target) & (F.col("mode") != sem.REACH)).select(
            "start", "conf", "depth", F.array_join("path", " > ").alias("path"))

    first = cut(search([("best", [])]))
    best = first.first()  # one row
    if best is None:
        return first.select("path", F.round("conf", 3).alias("confidence"), "depth")
    hops = best["path"].split(" > ")

    def both_ways(hop: str) -> list[str]:
        frm, rel, to = hop.split("|")
        return [hop, f"{to}|{rel}|{frm}"]

    more = search([(f"without {i}", both_ways(h)) for i, h in enumerate(hops)])
    found = first.unionByName(more).groupBy("path").agg(F.max("conf").alias("conf"), F.min("depth").alias("depth"))
    return found.orderBy(F.desc("conf"), "depth", "path").limit(limit).select(
        "path", F.round("conf", 3).alias("confidence"), "depth")


def holds_privileged_role(edges: DataFrame, objects: DataFrame, who: DataFrame) -> DataFrame:
    """(id): principals that reach a privileged role over memberships and roles."""
    privileged = objects.where("type = 'role' AND privileged").select(F.col("id").alias("node"))
    reach = closure(edges, who.select(F.col("id").alias("start")), 1 << 30, F.col("type").isin("MEMBER_OF", "HAS_ROLE"))
    return reach.where("hops > 0").join(privileged, "node", "left_semi").select(F.col("start").alias("id")).distinct()


def privileged_principals(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(start): accounts that are privileged themselves, hold a privileged role, or own a privileged identity."""
    flagged = objects.where("privileged").select("id")
    own = accounts(objects).join(flagged, F.col("start") == F.col("id"), "left_semi")
    by_role = roles(edges, accounts(objects)).join(flagged, F.col("role") == F.col("id"), "left_semi").select("start")
    by_identity = edges.where("type = 'HAS_IDENTITY'").join(flagged, F.col("dst") == F.col("id"), "left_semi").select(
        F.col("src").alias("start"))
    return union_all([own, by_role, by_identity]).distinct()


# ---------------------------------------------------------------- rules: (rule, subject, severity, detail)


def _rule(rows: DataFrame, rule: str, subject, severity, detail) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), subject.alias("subject"), severity.alias("severity"),
                       detail.cast("string").alias("detail"))


def excessive_privilege(edges: DataFrame, objects: DataFrame, minimum: int = 3) -> DataFrame:
    """Privileged accounts that control many important assets or hold a wildcard role."""
    who = cut(privileged_principals(edges, objects))
    important = objects.where(
        "criticality IN ('high', 'critical') AND type IN ('host', 'service', 'cloud_resource', 'database')"
    ).select(F.col("id").alias("node"))
    n = effective_access(edges, objects, who).join(important, "node", "left_semi").groupBy("start").agg(F.count("*").alias("n"))
    wild = roles(edges, who).join(
        objects.where("wildcard").select(F.col("id").alias("role")), "role", "left_semi").select("start").distinct().withColumn(
        "wild", F.lit(True))
    j = who.join(n, "start", "left").join(wild, "start", "left").select(
        "start", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wild", F.lit(False)).alias("wild"))
    j = j.where((F.col("n") >= minimum) | F.col("wild"))
    return _rule(j, "excessive-privilege", F.col("start"), F.when(F.col("wild") | (F.col("n") >= 5), "HIGH").otherwise("MEDIUM"),
                 F.col("n"))


def dormant_privileged(edges: DataFrame, objects: DataFrame, activity: DataFrame, days: int = 90) -> DataFrame:
    """Privileged accounts without activity for ``days`` before the newest event; ``activity(start, last_us)``."""
    newest = activity.agg(F.max("last_us").alias("m"))
    age = F.floor((newest.scalar() - F.col("last_us")) / F.lit(86_400_000_000))
    j = privileged_principals(edges, objects).join(activity, "start", "left").withColumn("age", age)
    j = j.where((F.col("age") >= days) | F.col("last_us").isNull())
    return _rule(j, "dormant-privileged", F.col("start"), F.lit("MEDIUM"), F.coalesce(F.col("age").cast("string"), F.lit("none")))


def inherited_privilege(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Privileged roles that come through two or more groups."""
    r = roles(edges, accounts(objects)).where(F.size("chain") >= 4)
    flagged = objects.where("privileged").select(F.col("id").alias("role"), "wildcard")
    j = r.join(flagged, "role")
    return _rule(j, "inherited-privilege", F.concat_ws("|", "start", "role"), F.when(F.col("wildcard"), "HIGH").otherwise("MEDIUM"),
                 F.array_join("chain", ">"))


def broad_roles(edges: DataFrame, objects: DataFrame, threshold: int = 5) -> DataFrame:
    """Privileged roles with a wildcard or many holders."""
    flagged = objects.where("type = 'role' AND privileged").select(F.col("id").alias("role"), "wildcard")
    n = role_holders(edges, flagged).groupBy("role").agg(F.count("*").alias("n"))
    j = flagged.join(n, "role", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(
        (F.col("n") >= threshold) | F.col("wildcard"))
    return _rule(j, "broad-role", F.col("role"), F.when(F.col("wildcard"), "HIGH").otherwise("MEDIUM"), F.col("n"))


def credential_exposure(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Credentials of privileged accounts on hosts that others can use."""
    uses = edges.where("type = 'USES' AND src LIKE 'host:%'").select(F.col("src").alias("host"), F.col("dst").alias("identity")).where(
        F.substring_index("identity", ":", 1).isin("identity", "user"))
    uses = uses.join(privileged_principals(edges, objects).withColumnRenamed("start", "identity"), "identity", "left_semi")
    sessions = edges.where("type = 'LOGGED_INTO'").select(F.col("dst").alias("host"), F.col("src").alias("member")).where(
        F.substring_index("member", ":", 1).isin("user", "identity"))
    can_use = sessions.unionByName(access_holders(edges).withColumnRenamed("resource", "host")).distinct()
    j = uses.join(can_use, "host").where("member <> identity").groupBy("host", "identity").agg(F.count("*").alias("n"))
    return _rule(j, "credential-exposure-path", F.concat_ws("|", "host", "identity"), F.lit("MEDIUM"), F.col("n"))


def risky_trust(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Trusts into an external realm, or trusts that continue onward."""
    trusts = edges.where("type = 'TRUSTS'").select("src", "dst")
    onward = trusts.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    ext = objects.where("external").select(F.col("id").alias("dst"), F.lit(True).alias("ext"))
    hop = trusts.join(onward, "dst").where("next <> src").groupBy("src", "dst").agg(F.min("next").alias("next"))
    j = trusts.join(hop, ["src", "dst"], "left").join(ext, "dst", "left").where("ext OR next IS NOT NULL")
    detail = F.when(F.col("ext"), "external").otherwise("transitive")
    return _rule(j, "risky-trust", F.concat_ws("|", "src", "dst"), F.lit("MEDIUM"), detail)


def privileged_without_mfa(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Privileged accounts whose second factor is recorded as off; service accounts are left out."""
    off = objects.where("nomfa AND tag <> 'service'").select(F.col("id").alias("start"))
    j = privileged_principals(edges, objects).join(off, "start", "left_semi")
    return _rule(j, "privileged-without-mfa", F.col("start"), F.lit("MEDIUM"), F.lit("no-mfa"))
