"""Hand-built tables and brute-force references for the operators whose semantics are easy to get wrong."""

import random

from pyspark.sql import functions as F

from vigilframe.functions import netaddr, ports, text, versions
from vigilframe.operators import merge, policy
from vigilframe.operators import timeline as tl
from vigilframe.operators.filters import EventFilter
from vigilframe.operators.graph import closure, connected_components
from vigilframe.operators.lifecycle import transition
from vigilframe.operators.propagate import exploitable, propagate, propagation_arcs

OBJ = "id string, type string, disabled boolean, privileged boolean, cvss double"
REL = "src string, type string, dst string, conf double, to_us bigint"


def graph(spark, objects, edges):
    o = spark.createDataFrame([(i, i.split(":")[0], d, False, c) for i, d, c in objects], OBJ)
    r = spark.createDataFrame([(a, t, b, c, None) for a, t, b, c in edges], REL)
    return o, r


def test_short_weak_path_still_extends(spark):
    """The longer, stronger way to b must not hide the shorter one that still has room to go on to d."""
    names = ["host:a", "host:m", "host:b", "host:d"]
    o, r = graph(spark, [(n, False, None) for n in names], [
        ("host:a", "ADMIN_OF", "host:b", 0.4), ("host:a", "ADMIN_OF", "host:m", 1.0), ("host:m", "ADMIN_OF", "host:b", 1.0), ("host:b", "ADMIN_OF", "host:d", 1.0)])
    starts = spark.createDataFrame([("host:a",)], "start string")
    got = {x.node: (round(x.conf, 4), x.depth) for x in propagate(propagation_arcs(r, o), starts, 2, 0.2).collect()}
    assert got == {"host:b": (1.0, 2), "host:m": (1.0, 1), "host:d": (0.7, 2)}


def test_upgrade_and_disabled(spark):
    o, r = graph(spark, [("network:n", False, None), ("host:h", False, None), ("user:u", True, None), ("user:v", False, None), ("vulnerability:x", False, 8.0)], [
        ("network:n", "CAN_REACH", "host:h", 1.0), ("vulnerability:x", "AFFECTS", "host:h", 1.0), ("host:h", "USES", "user:u", 1.0), ("host:h", "USES", "user:v", 1.0)])
    starts = spark.createDataFrame([("network:n",)], "start string")
    got = {x.node: (x.mode, round(x.conf, 4), x.depth, x.vulnerability) for x in propagate(
        propagation_arcs(r, o), starts, 4, 0.05, "reach", exploitable(r, o)).collect()}
    assert got == {"host:h": ("control", 0.432, 1, "vulnerability:x"), "user:v": ("control", 0.3456, 2, "vulnerability:x")}


def test_closure_ends_in_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = {(x.node, x.hops) for x in closure(e, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_components_of_a_long_chain(spark):
    n = 40
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n)] + [("z1", "z2")], "a string, b string")
    got = connected_components(links).groupBy("component").count().collect()
    assert {x.component: x["count"] for x in got} == {"n000": n + 1, "z1": 2}


def fold_end(records):
    v = records[0][0]
    for to, last in records[1:]:
        if to is not None and (v is None or to > v):
            v = to
        if v is not None and to is None and last is not None and last > v:
            v = None
    return v


def test_end_times_equal_the_sequential_fold(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(200):
        recs = [(rng.choice([None, rng.randint(1, 20)]), rng.choice([None, rng.randint(1, 20)])) for _ in range(rng.randint(1, 8))]
        want[f"id{i}"] = fold_end(recs)
        # arrivals are far apart, so the folds also cross blocks
        rows += [(f"id{i}", s * 70_000, to, last) for s, (to, last) in enumerate(recs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, seq bigint, to_us bigint, last_us bigint")
    got = {x.id: x.to_us for x in merge.end_times(df).collect()}
    assert {k: got.get(k) for k in want} == want


def test_max_window_on_one_hot_key(spark):
    """One key holds everything; ties in time and a window across block borders."""
    rng = random.Random(3)
    times = sorted(rng.randint(0, 2000) for _ in range(400))
    df = spark.createDataFrame([("k", t, f"e{i:04d}") for i, t in enumerate(times)], "k string, us bigint, id string").repartition(7)
    w, best, queue = 90, (0, 0, 0), []
    for t in times:
        queue = [x for x in queue if x >= t - w] + [t]
        if len(queue) > best[0]:
            best = (len(queue), queue[0], t)
    # the reference walks tied instants one by one, the result is the same window
    x = tl.max_window(df, ["k"], w).first()
    assert (x.n, x.start_us, x.end_us) == best


def test_runs_across_blocks(spark):
    rng = random.Random(5)
    steps = [(f"e{i:04d}", i * 10, rng.choice("ab")) for i in range(300)]
    want, last = [], None
    for _, us, v in steps:
        if v == last:
            want[-1][1] += 1
        else:
            want.append([v, 1, us])
        last = v
    df = spark.createDataFrame([("k", *s) for s in steps], "k string, id string, us bigint, v string").repartition(5)
    got = [[x.v, x.n, x.start_us] for x in tl.collapse_runs(df, ["k"], ["v"], 100).orderBy("start_us").collect()]
    assert got == want


def test_histogram_boundary_goes_to_the_later_bucket(spark):
    s = 1_000_000
    df = spark.createDataFrame([(0,), (5 * s,), (10 * s,)], "us bigint")
    got = {x.bucket: x.n for x in tl.histogram(df, 2).collect()}
    assert got == {0: 1, 1: 1, 2: 1}
    one = spark.createDataFrame([(7,)], "us bigint")
    assert sum(x.n for x in tl.histogram(one, 60).collect()) == 1


def test_order_statistic(spark):
    rng = random.Random(11)
    vals = [rng.randint(0, 10_000_000) for _ in range(777)]
    got = tl.order_statistic(spark.createDataFrame([("k", v) for v in vals], "k string, v bigint"), ["k"], "v", 0.9).first().v
    assert got == sorted(vals)[min(len(vals) - 1, int(0.9 * len(vals)))]


def test_narrow_contradiction():
    a = EventFilter(actor="user:a").narrow(EventFilter(actor="user:b"))
    assert a.nothing
    b = EventFilter(event_types=("auth",)).narrow(EventFilter(event_types=("auth.login", "file")))
    assert b.event_types == ("auth.login",) and not b.nothing


def test_ports(spark):
    one = spark.range(1)

    def labels(col):
        return one.select(ports.labels(col).alias("x")).first().x

    p = ports.parse(F.array(F.lit("tcp/1-10"), F.lit("8-20"), F.lit("ssh")))
    assert labels(p) == ["tcp/1-20", "tcp/22"]
    assert labels(ports.subtract(p, ports.parse(F.array(F.lit("tcp/5-6"))))) == ["tcp/1-4", "tcp/7-20", "tcp/22"]
    assert labels(ports.parse(F.array(F.lit("any")))) == ["any"]


def test_versions_in_order(spark):
    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1", "1!0.1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").repartition(4)
    got = [x.i for x in df.orderBy(versions.version_key(F.lit("pypi"), F.col("v"))).collect()]
    assert got == list(range(len(order)))
    sem = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.0.1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sem)], "i int, v string").repartition(4)
    assert [x.i for x in df.orderBy(versions.version_key(F.lit("npm"), F.col("v"))).collect()] == list(range(len(sem)))


def test_ip_scope(spark):
    cases = {"10.1.2.3": "internal", "8.8.8.8": "public", "127.0.0.1": "loopback", "169.254.1.1": "link-local", "224.0.0.1": "multicast", "0.0.0.0": "unspecified",
             "250.1.1.1": "reserved", "::1": "loopback", "fe80::1%eth0": "link-local", "fd00::1": "internal", "2001:db8::1": "public", "[::ffff:10.0.0.1]": "internal", "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {x.ip: x.s for x in df.select("ip", netaddr.ip_scope(F.col("ip")).alias("s")).collect()} == cases


def test_redaction(spark):
    cases = {
        "token=abcd": "token=****", "password: 'hunter2'": "password: '*******'", "key sk-abcdefghijklmnopqrst here": "key sk-****qrst here",
        "postgres://u:secretpw@db/x": "postgres://u:****@db/x", "nothing here": "nothing here",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {x.t: x.r for x in df.select("t", text.redact_text(F.col("t")).alias("r")).collect()} == cases


def test_finding_lifecycle(spark):
    stored = spark.createDataFrame([("a", "OPEN"), ("b", "RESOLVED"), ("c", "FALSE_POSITIVE"), ("d", "OPEN")], "id string, status string")
    got = {x.id: (x.status, x.change) for x in transition(stored, spark.createDataFrame([("b",), ("c",), ("d",), ("e",)], "id string")).collect()}
    assert got == {"a": ("RESOLVED", "resolved"), "b": ("OPEN", "reopened"), "c": ("FALSE_POSITIVE", "updated"), "d": ("OPEN", "updated"), "e": ("OPEN", "created")}


def test_first_match_policy(spark):
    rules = spark.createDataFrame([
        ("p", "r1", 1, "deny", "10.0.0.0/24", "0.0.0.0/0", "tcp", 22, 22, True), ("p", "r2", 2, "allow", "10.0.0.0/8", "0.0.0.0/0", "any", 0, 65535, True),
        ("p", "r3", 3, "deny", "10.0.0.0/16", "0.0.0.0/0", "tcp", 22, 22, True)],
        "policy_id string, rule_id string, ord int, effect string, src_cidr string, dst_cidr string, proto string, lo int, hi int, enabled boolean")
    flows = spark.createDataFrame([("10.0.0.5", "1.1.1.1", "tcp", 22), ("10.0.0.5", "1.1.1.1", "tcp", 80), ("11.0.0.1", "1.1.1.1", "tcp", 22)], "src_ip string, dst_ip string, proto string, port int")
    got = {(x.src_ip, x.port): (x.rule_id, x.effect) for x in policy.decide_flows(flows, rules).collect()}
    assert got == {("10.0.0.5", 22): ("r1", "deny"), ("10.0.0.5", 80): ("r2", "allow"), ("11.0.0.1", 22): ("default", "deny")}
    kinds = {(x.rule_id, x.because): x.kind for x in policy.anomalies(rules).collect()}
    assert kinds == {("r3", "r2"): "shadowed", ("r2", "r1"): "conflicting"} or kinds == {("r3", "r2"): "shadowed", ("r2", "r1"): "conflicting", ("r3", "r1"): "conflicting"}


def test_zones_of_both_address_families(spark):
    from vigilframe.operators.network import most_specific

    nets = [("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("2001:db8::/32", "c"), ("2001:db8:0:1::/64", "d"), ("fe80::/10", "e"), ("2001:db8::1", "f")]
    wanted = {"10.1.2.3": "b", "10.9.9.9": "a", "8.8.8.8": None, "2001:db8::5": "c", "2001:DB8:0:1::9": "d", "fe80::1%eth0": "e", "2001:db8::1": "f", "ff02::1": None, "bad": None, "1::2::3": None}
    out = most_specific(spark.createDataFrame([(i,) for i in wanted], "ip string"), "ip", spark.createDataFrame(nets, "cidr string, zone string"), "zone")
    assert {r.ip: r.zone for r in out.collect()} == wanted


def test_windows_by_running_sums(spark):
    import random

    from vigilframe.operators.timeline import max_window

    rng = random.Random(2)
    events = [(k, rng.randrange(-5000, 5000), f"e{i:04d}") for i in range(600) for k in ("a", None)]
    out = {r.k: tuple(r)[1:] for r in max_window(spark.createDataFrame(events, "k string, us long, id string"), ["k"], 700).collect()}
    for key, best in out.items():
        mine = [(us, i) for k, us, i in events if k == key]
        n, end = max(((sum(t - 700 <= us <= t for us, _ in mine), -t) for t, _ in mine))
        inside = sorted((us, i) for us, i in mine if -end - 700 <= us <= -end)
        assert best == (n, inside[0][0], -end, inside[0][1], max(i for us, i in mine if us == -end))


def test_one_crowded_window(spark):
    from pyspark.sql import functions as F

    from vigilframe.operators.timeline import max_window

    events = spark.range(200_000).select(F.lit("k").alias("k"), F.col("id").alias("us"), F.col("id").cast("string").alias("id"))
    assert max_window(events, ["k"], 1_000_000).first().n == 200_000


def test_newest_before(spark):
    import random

    from vigilframe.operators.timeline import latest_before

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(3000), i) for i in range(200)]
    facts = [(rng.choice("ab"), rng.randrange(3000), f"v{i}") for i in range(60)]
    out = latest_before(spark.createDataFrame(rows, "k string, us long, no int"), spark.createDataFrame(facts, "k string, us long, v string"), ["k"], ["v"], 250)
    found = {r.no: (r.latest.us, r.latest.v) for r in out.collect()}
    wanted = {no: max(m) for k, us, no in rows if (m := [(u, v) for f, u, v in facts if f == k and us - 250 <= u <= us])}
    assert found == wanted


def test_many_sources_of_one_fact(spark):
    from vigilframe.operators.trace import corroborate

    rows = [("a", "b", "R", 1, 0.9 if i == 1499 else 0.001, f"e{i:05d}", f"s{i}") for i in range(1500)]
    out = corroborate(spark.createDataFrame(rows, "cause string, effect string, relation string, us long, confidence double, event_id string, source string"), cap=1.0).first()
    assert out.sources == 1500 and out.confidence > 0.94  # the last source counts too


def test_references_short_unknown_and_by_alias(spark):
    from vigilframe.operators.search import resolve

    objects = spark.createDataFrame([("host:db1", "DB One"), ("host:db2", "db two"), ("user:al", "Al")], "id string, name string")
    aliases = spark.createDataFrame([("host:db2", "billing")], "id string, alias string")
    refs = spark.createDataFrame([("db",), ("al",), ("host:db1",), ("nothing",), ("Billing",), ("o",)], "ref string")
    out = {r.ref: (r.id, r.candidates) for r in resolve(refs, objects, aliases).collect()}
    assert out == {"db": ("host:db1", 2), "al": ("user:al", 1), "host:db1": ("host:db1", 1), "nothing": (None, 0), "Billing": ("host:db2", 1), "o": ("host:db1", 2)}


def test_key_block_without_end_is_masked(spark):
    from pyspark.sql import functions as F

    from vigilframe.functions.text import redact_text

    text = "before -----BEGIN RSA PRIVATE KEY-----\nMIIabc\ndef\n"
    assert spark.range(1).select(redact_text(F.lit(text))).first()[0] == "before [REDACTED]"
