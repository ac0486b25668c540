"""Control paths of incident accounts, told by the incident's own events."""

from __future__ import annotations

from vigilframe.operators import observed as ob
from vigilframe.operators.propagate import propagation_arcs


def test_path_with_most_observed_steps_wins(spark):
    objects = spark.createDataFrame(
        [("user:u", "user", None, False), ("user:quiet", "user", None, False), ("host:a", "host", "low", False), ("host:b", "host", "critical", False), ("host:c", "host", "high", False), ("identity:i", "identity", None, False)],
        "id string, type string, criticality string, disabled boolean").selectExpr("*", "false AS privileged", "CAST(NULL AS double) AS cvss")
    edges = spark.createDataFrame(
        [("user:u", "LOGGED_INTO", "host:a"), ("host:a", "USES", "identity:i"), ("identity:i", "ADMIN_OF", "host:b"), ("user:u", "ADMIN_OF", "host:c"), ("user:quiet", "ADMIN_OF", "host:b")],
        "src string, type string, dst string").selectExpr("*", "CAST(1.0 AS double) AS conf")
    events = spark.createDataFrame(
        [("i1", "e1", 10, "auth.login", "user:u"), ("i1", "e2", 20, "process.start", "identity:i"), ("i1", "e3", 5, "auth.login", "user:x"), ("i2", "e4", 1, "auth.login", "user:quiet"), ("i3", "e5", 1, "scan", "ip:1")],
        "incident_id string, event_id string, us long, event_type string, actor_id string")
    involved = spark.createDataFrame(
        [("e1", "user:u"), ("e1", "host:a"), ("e3", "host:a"), ("e3", "user:x"), ("e2", "identity:i"), ("e2", "host:b"), ("e4", "user:quiet")], "event_id string, object_id string")
    got = {r.incident_id: r for r in ob.incident_paths(events, involved, propagation_arcs(edges, objects), objects).collect()}
    assert set(got) == {"i1", "i2"}
    best = got["i1"]
    # both ends of the first hop stand together in e1, though e3 shows the host before
    assert (best.start, best.node, best.observed_steps) == ("user:u", "host:b", 3)
    assert [(h.source, h.rel, h.target, h.event_id) for h in best.hops] == [
        ("user:u", "LOGGED_INTO", "host:a", "e1"), ("host:a", "USES", "identity:i", "e2"), ("identity:i", "ADMIN_OF", "host:b", "e2")]
    assert (got["i2"].start, got["i2"].observed_steps, got["i2"].hops[0].event_id) == ("user:quiet", 0, None)


def test_only_the_most_active_accounts_count(spark):
    rows = [("i", f"e{u}{k}", k, "t", f"user:{u}") for u in "abcdef" for k in range(ord(u) - 96)]
    events = spark.createDataFrame(rows, "incident_id string, event_id string, us long, event_type string, actor_id string")
    assert sorted((r.start, r.activity) for r in ob.active_actors(events).collect()) == [("user:c", 3), ("user:d", 4), ("user:e", 5), ("user:f", 6)]
