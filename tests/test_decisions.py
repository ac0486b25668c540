"""Policy decisions on hand-made cases: both address families, port sets, selectors, pivots, and rule changes."""

from __future__ import annotations

import fnmatch
import ipaddress
import itertools

from pyspark.sql import functions as F

from vigilframe.functions import ports
from vigilframe.operators import decisions as dc
from vigilframe.operators import policy as pol

FLAT = "policy_id string, rule_id string, ord int, effect string, src_cidr string, dst_cidr string, proto string, lo int, hi int, enabled boolean"


def rules(spark, rows):
    return spark.createDataFrame(rows, FLAT).withColumn("ports", dc.port_range(F.col("proto"), F.col("lo"), F.col("hi"))).drop("proto", "lo", "hi")


def test_matches_both_families(spark):
    nets = ["any", "0.0.0.0/0", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "::/0", "2001:db8::/32", "2001:db8::8000:0:0:0/65", "2001:db8::1", "::ffff:10.1.2.3", "nonsense", "10.1.2.0/99x"]
    ips = ["10.1.2.3", "10.1.3.9", "10.2.0.1", "192.0.2.1", "2001:db8::1", "2001:db8::8000:0:0:5", "2001:db9::", "::ffff:10.1.2.3", "no address"]

    def parsed(net):
        if net == "any":
            return "any"
        try:
            n = ipaddress.ip_network(net.replace("::ffff:", "") if net.startswith("::ffff:") else net)
        except ValueError:
            return None
        return n

    def inside(ip, net):
        try:
            a = ipaddress.ip_address(ip.replace("::ffff:", "") if ip.startswith("::ffff:") else ip)
        except ValueError:
            return False
        n = parsed(net)
        if n is None:
            return False
        if n == "any":
            return True
        if str(n) == "::/0":
            return True  # every address is one of 128 bits; IPv4 lies inside ::ffff:0:0/96
        return a.version == n.version and a in n

    table = rules(spark, [("p", f"{a}>{b}", k, "allow", a, b, "any", 0, 65535, True) for k, (a, b) in enumerate(itertools.product(nets, nets))])
    pairs = spark.createDataFrame(list(itertools.product(ips, ips)), "src_ip string, dst_ip string")
    found = {(r.src_ip, r.dst_ip, r.rule_id) for r in dc.matches(pairs, table).collect()}
    assert found == {(s, d, f"{a}>{b}") for s, d in itertools.product(ips, ips) for a, b in itertools.product(nets, nets) if inside(s, a) and inside(d, b)}


def test_rules_decide_on_the_ports_that_are_left(spark):
    table = rules(spark, [
        ("p", "a", 1, "allow", "any", "10.0.0.1", "tcp", 20, 30, True), ("p", "b", 2, "deny", "any", "10.0.0.0/24", "tcp", 0, 100, True),
        ("p", "c", 3, "allow", "any", "any", "tcp", 90, 200, True), ("p", "d", 4, "allow", "any", "any", "any", 0, 65535, False)])
    policies = spark.createDataFrame([("p", "deny", []), ("far", "allow", ["192.0.2.0/24"])], "policy_id string, default string, scope array<string>")
    asked = spark.createDataFrame([("10.9.9.9", "10.0.0.1")], "src_ip string, dst_ip string").withColumn("wanted", ports.parse(F.array(F.lit("tcp/25-150"))))
    row = dc.decide_ports(asked, table, policies).collect()
    assert len(row) == 1 and row[0].decision == "allow"
    assert [(d.rule_id, d.effect, [(p.lo, p.hi) for p in d.ports]) for d in row[0].decided] == [("a", "allow", [(25, 30)]), ("b", "deny", [(31, 100)]), ("c", "allow", [(101, 150)])]
    assert [(p.lo, p.hi) for p in row[0].allowed] == [(25, 30), (101, 150)]


def test_selectors_match_like_file_patterns(spark):
    names = ["host:s1", "host:s15", "host:web-1", "db:web", "cloud:prod-a", "cloud:a-prod", "host:a.b", "host:aXb", "app:[x]", "db:1"]
    wanted = ["*", "host:*", "host:s?", "*prod*", "*b", "h*:s1*", "host:a.b", "cloud:[pa]*", "*-[!a]*", "??:1", "[hd]*:*1", "host:s1"]
    resources = spark.createDataFrame([(n,) for n in names], "resource string")
    ancestors = resources.select("resource", F.col("resource").alias("parent")).union(spark.createDataFrame([("host:s1", "cloud:prod-a")], "resource string, parent string"))
    statements = spark.createDataFrame([(str(k), "allow", "*", "*", s) for k, s in enumerate(wanted)], "rule_id string, effect string, principal string, action string, resource string")
    found = {tuple(r) for r in dc.reached_resources(resources, ancestors, statements).collect()}

    def fits(n, s):
        if s.endswith(":*") and "*" not in s[:-1] and "[" not in s and "?" not in s:
            return n.startswith(s[:-1])
        return any(fnmatch.fnmatchcase(x, s) for x in ([n, "cloud:prod-a"] if n == "host:s1" else [n]))

    assert found == {(n, s) for n in names for s in wanted if fits(n, s)}


def test_denied_request_goes_through_one_more_host(spark):
    edges = spark.createDataFrame([("user:u", "OWNS", "host:pc"), ("user:u", "LOGGED_INTO", "host:jump"), ("user:u", "LOGGED_INTO", "host:far"), ("user:u", "HAS_IDENTITY", "identity:i")], "src string, type string, dst string")
    hosts = spark.createDataFrame([("host:pc", "10.0.0.1"), ("host:jump", "10.0.0.2"), ("host:far", "10.0.0.3"), ("host:db", "10.0.0.9"), ("host:six", "2001:db8::1")], "host string, ip string")
    table = rules(spark, [("p", "j", 1, "allow", "10.0.0.1", "10.0.0.2", "tcp", 22, 22, True), ("p", "k", 2, "allow", "10.0.0.2", "10.0.0.9", "tcp", 5432, 5432, True), ("p", "f", 3, "allow", "10.0.0.3", "any", "any", 0, 65535, True)])
    policies = spark.createDataFrame([("p", "deny", [])], "policy_id string, default string, scope array<string>")
    statements = spark.createDataFrame([("s", "allow", "identity:i", "postgres", "host:*")], "rule_id string, effect string, principal string, action string, resource string")
    asked = spark.createDataFrame([("user:u", "postgres", "host:db"), ("user:u", "ssh", "host:jump"), ("user:u", "reach", "host:six"), ("host:jump", "postgres", "host:db"), ("user:u", "postgres", "service:none"), ("user:none", "reach", "host:db")], "subject string, verb string, target string")
    got = {(r.subject, r.verb, r.target): r for r in dc.decide(asked, edges, hosts, table, policies, statements).collect()}
    via = got["user:u", "postgres", "host:db"]
    assert (via.decision, via.kind, via.network, via.identity, via.as_principal) == ("deny", "pivot", "deny", "allow", "identity:i")
    assert [(p.pivot, p.source, p.rules1, p.rules2) for p in via.pivots] == [("host:jump", "host:pc", ["p:j"], ["p:k"])]  # the far host cannot be reached first
    assert (got["user:u", "ssh", "host:jump"].decision, got["user:u", "ssh", "host:jump"].network, got["user:u", "ssh", "host:jump"].identity) == ("deny", "allow", "deny")
    assert (got["user:u", "reach", "host:six"].decision, got["user:u", "reach", "host:six"].kind) == ("deny", "none")
    assert got["host:jump", "postgres", "host:db"].decision == "allow"
    assert got["user:none", "reach", "host:db"].decision == "not-evaluated"
    assert got["user:u", "postgres", "service:none"].network is None


def test_any_action_is_denied_only_if_nothing_is_left(spark):
    st = spark.createDataFrame([("a", "allow", "u", "read", "r:*"), ("b", "deny", "g", "rea*", "r:1"), ("c", "allow", "*", "write", "r:2"), ("d", "deny", "u", "*", "r:3")], "rule_id string, effect string, principal string, action string, resource string")
    q = spark.createDataFrame([("u", a, f"r:{k}") for a in ("read", None) for k in (1, 2, 3, 4)], "principal string, action string, resource string")
    acts = spark.createDataFrame([("u", "u"), ("u", "g")], "principal string, holder string")
    out = dc.decide_access(q, st, acts, q.select("resource", F.col("resource").alias("parent")))
    got = {(r.action, r.resource): (r.decision, r.rules, r.by_default) for r in out.collect()}
    assert got == {
        ("read", "r:1"): ("deny", ["b"], False), ("read", "r:2"): ("allow", ["a"], False), ("read", "r:3"): ("deny", ["d"], False), ("read", "r:4"): ("allow", ["a"], False),
        (None, "r:1"): ("deny", ["b"], False), (None, "r:2"): ("allow", ["a", "c"], False), (None, "r:3"): ("deny", ["d"], False), (None, "r:4"): ("allow", ["a"], False)}


def test_regions_leave_out_what_is_filled(spark):
    ends = spark.createDataFrame([("10.0.0.0/30",), ("10.0.0.0/8",), ("2001:db8::/32",), ("any",)], "cidr string")
    nets = spark.createDataFrame([("10.0.0.0/31",), ("10.0.0.2/31",), ("10.0.0.2",), ("192.0.2.0/24",), ("2001:db8::/33",), ("10.0.0.0/8",)], "cidr string")
    got = {}
    for r in dc.regions(ends, nets).collect():
        got.setdefault(r.cidr, set()).add(r.region)
    assert got["10.0.0.0/30"] == {"10.0.0.0/31", "10.0.0.2/31", "10.0.0.2"}  # two halves leave nothing of the whole
    assert got["10.0.0.0/8"] == {"10.0.0.0/8", "10.0.0.0/31", "10.0.0.2/31", "10.0.0.2"}
    assert got["2001:db8::/32"] == {"2001:db8::/32", "2001:db8::/33"}
    assert got["any"] == {"any", "10.0.0.0/8", "10.0.0.0/31", "10.0.0.2/31", "10.0.0.2", "192.0.2.0/24", "2001:db8::/33"}


def test_an_inserted_rule_moves_none(spark):
    old = spark.createDataFrame([("p", f"r{k}", k, "allow", f"10.0.{k}.0/24", "0.0.0.0/0", "tcp", 80, 80, True) for k in range(4)], FLAT)
    new = old.withColumn("ord", F.col("ord") + 1).unionByName(spark.createDataFrame([("p", "n", 0, "deny", "10.0.0.0/16", "0.0.0.0/0", "tcp", 80, 80, True)], FLAT))
    got = [(r.rule_id, r.change, r.impact) for r in pol.revision_diff(old, new).collect()]
    assert got == [("n", "added", "access-reduced")]
    added = {(r.rule_id, r.finding, r.detail, r.status) for r in pol.findings_diff(pol.findings(old), pol.findings(new)).collect()}
    assert {("r1", "shadowed", "n", "introduced"), ("r3", "shadowed", "n", "introduced")} <= added
    swapped = old.withColumn("ord", F.when(F.col("rule_id") == "r1", 2).when(F.col("rule_id") == "r2", 1).otherwise(F.col("ord")))
    assert {(r.rule_id, r.change) for r in pol.revision_diff(old, swapped).collect()} == {("r1", "moved"), ("r2", "moved")}
