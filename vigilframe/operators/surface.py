"""External surface: severity ladders, certificates, DNS, ownership, exposed services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import netaddr
from vigilframe.functions.levels import SEVERITIES, severity_name
from vigilframe.operators.graph import closure, union_all
from vigilframe.operators.loops import cut
from vigilframe.operators.network import most_specific_suffix

# Ports that should not face the Internet.
SENSITIVE_PORTS: dict[int, tuple[str, str]] = {
    21: ("FTP", "MEDIUM"), 22: ("SSH", "MEDIUM"), 23: ("Telnet", "HIGH"), 135: ("MS-RPC", "HIGH"), 139: ("NetBIOS", "HIGH"), 161: ("SNMP", "MEDIUM"),
    445: ("SMB", "HIGH"), 623: ("IPMI", "HIGH"), 1433: ("SQL Server", "HIGH"), 1521: ("Oracle Database", "HIGH"), 2049: ("NFS", "HIGH"),
    2375: ("Docker API", "CRITICAL"), 2376: ("Docker API", "HIGH"), 3306: ("MySQL", "HIGH"), 3389: ("RDP", "HIGH"), 5432: ("PostgreSQL", "HIGH"),
    5900: ("VNC", "HIGH"), 5984: ("CouchDB", "HIGH"), 5985: ("WinRM", "HIGH"), 5986: ("WinRM", "HIGH"), 6379: ("Redis", "HIGH"), 9042: ("Cassandra", "HIGH"),
    9200: ("Elasticsearch", "HIGH"), 11211: ("memcached", "HIGH"), 27017: ("MongoDB", "HIGH"),
}
DAY_US = 86_400_000_000


def ladder(base: str, steps: Column, ceiling: str = "CRITICAL") -> Column:
    """Severity after moves up and down from a baseline, each clamped between LOW and the ceiling."""
    top = SEVERITIES.index(ceiling)

    def move(level: Column, step: Column) -> Column:
        return F.when(step > 0, F.least(F.lit(top), level + step)).when(step < 0, F.greatest(F.lit(1), level + step)).otherwise(level)

    return severity_name(F.aggregate(steps, F.lit(SEVERITIES.index(base)), move))


def name_covers(pattern: Column, name: Column) -> Column:
    """Certificate names: equal, or a wildcard for exactly one label."""
    wild = pattern.startswith("*.") & (F.substring_index(name, ".", 1) != "") & F.contains(name, F.lit("."))
    rest = F.substring(name, F.instr(name, ".") + 1, F.length(name))
    return (pattern == name) | (wild & (rest == F.substring(pattern, 3, F.length(pattern))))


def certificates(certs: DataFrame, now_us: int | Column, soon_days: int = 30) -> DataFrame:
    """Expired and soon expiring certificates ``(id, not_after_us)``."""
    now = now_us if isinstance(now_us, Column) else F.lit(now_us)
    days = F.floor((F.col("not_after_us") - now) / DAY_US)
    rule = F.when(F.col("not_after_us") < now, "expired-certificate").when(days <= soon_days, "expiring-certificate")
    severity = F.when(rule == "expired-certificate", "HIGH").when(days <= 7, "MEDIUM").otherwise("LOW")
    return certs.withColumn("rule", rule).where("rule IS NOT NULL").select("rule", F.col("id").alias("subject"), severity.alias("severity"))


def name_mismatch(endpoints: DataFrame, names: DataFrame) -> DataFrame:
    """Endpoints ``(endpoint, name, cert)`` whose certificate covers none of its names ``(cert, pattern)``.

    A pattern can only cover a name when it equals the name or its one-label wildcard, so the test is an equi join.
    """
    parent = F.substring(F.col("name"), F.instr("name", ".") + 1, F.length("name"))
    options = endpoints.withColumn("pattern", F.explode(F.array(F.col("name"), F.concat(F.lit("*."), parent))))
    good = options.join(names.distinct(), ["cert", "pattern"], "left_semi").select("endpoint", "name").distinct()
    return endpoints.join(good, ["endpoint", "name"], "left_anti").select(
        F.lit("certificate-name-mismatch").alias("rule"), F.concat_ws("|", "endpoint", "name").alias("subject"), F.lit("MEDIUM").alias("severity"))


def resolve_names(dns: DataFrame, hops: int = 1 << 30) -> DataFrame:
    """(name, node): everything a name leads to over CNAME chains, addresses included; ``dns(name, type, value)``."""
    edges = dns.where("type IN ('CNAME', 'A', 'AAAA')").select(F.col("name").alias("src"), F.col("value").alias("dst"))
    starts = dns.select(F.col("name").alias("start")).distinct()
    return closure(edges, starts, hops).where("hops > 0").select(F.col("start").alias("name"), "node", "hops")


def dangling(dns: DataFrame, live: DataFrame) -> DataFrame:
    """Names whose chain ends in nothing that answers; ``live(node)``."""
    ends = resolve_names(dns).join(live.select("node").distinct().withColumn("ok", F.lit(True)), "node", "left")
    g = ends.groupBy("name").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"))
    return g.where("NOT ok").select(F.lit("dangling-dns").alias("rule"), F.col("name").alias("subject"), F.lit("MEDIUM").alias("severity"))


def exposed_services(services: DataFrame) -> DataFrame:
    """Services on sensitive ports that face the Internet: ``(service, port, internet)``."""
    name, level = None, None
    for port, (label, sev) in SENSITIVE_PORTS.items():
        c = F.col("port") == port
        name = F.when(c, label) if name is None else name.when(c, label)
        level = F.when(c, sev) if level is None else level.when(c, sev)
    s = services.withColumns({"product": name, "severity": level}).where("product IS NOT NULL AND internet")
    return s.select(F.lit("exposed-sensitive-service").alias("rule"), F.col("service").alias("subject"), "severity", "product")


def nearest_marked(marked: DataFrame, parents: DataFrame) -> DataFrame:
    """(asset, value, hops): for all that lies below something ``marked(asset, value)``, the value of the nearest such thing up ``parents(asset, parent)``; the
    smallest among equally near ones.

    Marks go down level by level, and what has one takes no other, so every link is followed once and circles end; no asset is left half way.
    """
    links = cut(parents.select("asset", "parent").distinct())
    frontier = cut(marked.groupBy("asset").agg(F.min("value").alias("value")).withColumn("hops", F.lit(0)))
    levels = [frontier]
    while not frontier.isEmpty():
        below = links.join(frontier.withColumnRenamed("asset", "parent"), "parent").groupBy("asset").agg(F.min("value").alias("value"), (F.max("hops") + 1).alias("hops"))
        frontier = cut(below.join(union_all([x.select("asset") for x in levels]), "asset", "left_anti"))
        levels.append(frontier)
    return union_all(levels)


def ownership(assets: DataFrame, owners: DataFrame, parents: DataFrame) -> DataFrame:
    """(asset, owner, via, hops): its own owner, else that of the nearest owned thing it runs on or lies in, at any distance."""
    found = nearest_marked(owners.select("asset", F.col("owner").alias("value")), parents)
    via = F.when(F.col("hops") == 0, "direct").when(F.col("hops") > 0, "inherited")
    return assets.select("asset").join(found, "asset", "left").select("asset", F.col("value").alias("owner"), via.alias("via"), "hops")


def heads(links: DataFrame) -> DataFrame:
    """(node, head, unfinished) of ``links(node, up)``, one upward link per node: where the links of a node end. Pointers double in every round, so a chain of
    n links takes log n rounds. Nodes of a circle, and those that lead into one, are returned as unfinished."""
    state = cut(links.select("node", "up"))
    rounds = max(1, state.count()).bit_length() + 1
    moving = True
    while moving and rounds:
        nxt = state.withColumnsRenamed({"node": "n", "up": "u"})
        state = cut(state.join(nxt, F.col("up") == F.col("n"), "left").select("node", F.coalesce("u", "up").alias("up"), F.col("u").isNotNull().alias("moved")))
        moving = not state.where("moved").isEmpty()
        state, rounds = state if not moving else state.select("node", "up"), rounds - 1
    if not moving:
        return state.select("node", F.col("up").alias("head"), F.lit(False).alias("unfinished"))
    ends = state.join(links.select(F.col("node").alias("up")).distinct().withColumn("more", F.lit(True)), "up", "left")
    return ends.select("node", F.col("up").alias("head"), F.col("more").isNotNull().alias("unfinished"))


def out_of_scope(names: DataFrame, scopes: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(rule, subject, members): names (``name``) that no authorized suffix of ``scopes(suffix)`` covers, one row per group. A name joins the closest parent name that
    is out of scope itself, other assets (``name`` too) the flagged thing that ``parents(name, parent)`` gives; ``members`` are the group's names, the subject first."""
    tagged = most_specific_suffix(names.select("name").distinct(), "name", scopes.select("suffix").distinct().withColumn("scope", F.lit(True)), "scope")
    flagged = cut(tagged.where("scope IS NULL").select("name"))
    labels = F.split("name", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.struct(i.alias("skip"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("up")))
    ups = flagged.where(F.contains("name", F.lit("."))).select("name", F.inline(above)).join(flagged.select(F.col("name").alias("up")), "up").groupBy("name").agg(F.min_by("up", "skip").alias("up"))
    if parents is not None:
        other = parents.join(flagged, "name", "left_semi").join(flagged.select(F.col("name").alias("parent")), "parent", "left_semi").groupBy("name").agg(F.min("parent").alias("up"))
        ups = other.unionByName(ups.join(other, "name", "left_anti"))
    top = heads(ups.select(F.col("name").alias("node"), "up")).select(F.col("node").alias("name"), "head")
    grouped = flagged.join(top, "name", "left").withColumn("head", F.coalesce("head", "name"))
    g = grouped.groupBy("head").agg(F.array_sort(F.collect_set(F.when(F.col("name") != F.col("head"), F.col("name")))).alias("rest"))
    return g.select(F.lit("out-of-scope-asset").alias("rule"), F.col("head").alias("subject"), F.concat(F.array("head"), "rest").alias("members"))


def unowned(assets: DataFrame, owned: DataFrame) -> DataFrame:
    """Assets without any owner: LOW, one up when internet-facing, one up when important."""
    lost = assets.join(owned.where("owner IS NOT NULL").select("asset"), "asset", "left_anti")
    steps = F.array(F.col("internet").cast("int"), F.col("criticality").isin("high", "critical").cast("int"))
    return lost.select(F.lit("unowned-asset").alias("rule"), F.col("asset").alias("subject"), ladder("LOW", steps, "HIGH").alias("severity"))


def internal_addresses(dns: DataFrame) -> DataFrame:
    """Public names that resolve to an internal address."""
    hit = dns.where((F.col("type") == "A") & netaddr.ip_scope(F.col("value")).isin("internal", "loopback", "link-local"))
    return hit.select(F.lit("internal-address-in-dns").alias("rule"), F.col("name").alias("subject"), F.lit("LOW").alias("severity")).distinct()


def shadow(found: DataFrame, inventory: DataFrame) -> DataFrame:
    """Assets that answer but are in no inventory."""
    return found.join(inventory.select("asset"), "asset", "left_anti").select(
        F.lit("shadow-asset").alias("rule"), F.col("asset").alias("subject"), F.lit("MEDIUM").alias("severity"))


def public_storage(buckets: DataFrame) -> DataFrame:
    steps = F.array(F.col("sensitive").cast("int"), F.col("writable").cast("int"))
    return buckets.where("public").select(F.lit("public-cloud-storage").alias("rule"), F.col("asset").alias("subject"), ladder("MEDIUM", steps).alias("severity"))
