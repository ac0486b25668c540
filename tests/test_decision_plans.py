"""Plans of decisions: inputs are written once, so the driver does not hold them again in every leg."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import ports
from vigilframe.operators import decisions as dc


def test_the_last_plan_holds_no_rules(spark):
    requests = spark.createDataFrame([("user:u", "ssh", "host:b")], "subject string, verb string, target string")
    edges = spark.createDataFrame([("user:u", "OWNS", "host:a")], "src string, type string, dst string")
    hosts = spark.createDataFrame([("host:a", "10.0.0.1"), ("host:b", "10.0.0.2")], "host string, ip string")
    rules = spark.createDataFrame([("p", "r", 1, "allow", "10.0.0.0/24", "any")], "policy_id string, rule_id string, ord int, effect string, src_cidr string, dst_cidr string").withColumn(
        "ports", ports.parse(F.array(F.lit("tcp/22"))))
    policies = spark.createDataFrame([("p", "deny", [])], "policy_id string, default string, scope array<string>")
    statements = spark.createDataFrame([("s", "allow", "user:u", "ssh", "host:*")], "rule_id string, effect string, principal string, action string, resource string")
    out = dc.decide(requests, edges, hosts, rules, policies, statements)
    assert "regexp_replace" not in out._jdf.queryExecution().analyzed().toString().lower()
    row = out.first()
    assert (row.decision, row.kind, row.net_rules, row.identity_rules) == ("allow", "direct", ["p:r"], ["s"])
