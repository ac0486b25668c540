"""Snapshots, differences, what-if models, policies and flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import semantics as sem
from vigilframe.functions.netaddr import cidr_range
from vigilframe.operators import flows as fl
from vigilframe.operators import policy as pol
from vigilframe.operators import snapshot as sn
from vigilframe.operators import whatif as wi
from vigilframe.operators.filters import filter_packets
from vigilframe.operators.loops import cut
from vigilframe.operators.propagate import propagate, propagation_arcs
from vigilframe.plans.registry import query

A, B = 852076800000000, 915148800000000  # 1997-01-01 and 1999-01-01


def customer_state(t, at):
    """Customers as hosts whose metadata follows their orders up to an instant."""
    o = t.orders.withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).where(F.col("us") < at)
    g = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("us", "o_orderkey")).alias("st"), F.max("o_totalprice").alias("top"))
    meta = F.create_map(F.lit("status"), F.col("st"), F.lit("criticality"), F.when(F.col("top") > 450000, "high").otherwise("low"))
    s = g.select(F.concat(F.lit("host:c"), F.col("o_custkey").cast("string")).alias("id"), F.lit("host").alias("type"), meta.alias("meta"))
    it = sn.items(s, "object", "id", F.struct("type", sn.canonical_map(F.col("meta")).alias("meta")))
    return it.select("kind", "item_id", "content_hash", "body").join(s.withColumnRenamed("id", "item_id"), "item_id")


def state_sql(at):
    return (f"(SELECT 'host:c' || o_custkey AS id, st, CASE WHEN top > 450000 THEN 'high' ELSE 'low' END AS cr FROM (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, "
            f"o_orderkey)) AS st, max(o_totalprice) AS top FROM orders WHERE epoch_us(o_orderdate) < {at} GROUP BY 1))")


BODY = """'{"type":"host","meta":{"criticality":"' || cr || '","status":"' || st || '"}}'"""


@query("snapshot_items", "", f"SELECT id AS item_id, sha256({BODY}) AS content_hash FROM {state_sql(B)}")
def snapshot_items(t):
    return customer_state(t, B).select("item_id", "content_hash")


@query("new_blobs", "", f"SELECT DISTINCT sha256({BODY}) AS hash FROM {state_sql(B)} WHERE sha256({BODY}) NOT IN (SELECT sha256({BODY}) FROM {state_sql(A)} WHERE st = 'F')")
def new_blobs(t):
    stored = customer_state(t, A).where(F.col("meta")["status"] == "F").select(F.col("content_hash").alias("hash"))
    return sn.new_blobs(customer_state(t, B), stored).select("hash")


@query("orphan_blobs", "", f"SELECT sha256({BODY}) AS content_hash FROM {state_sql(A)} EXCEPT SELECT sha256({BODY}) FROM {state_sql(B)} WHERE st = 'F'")
def orphan_blobs(t):
    return sn.orphan_blobs(customer_state(t, A), customer_state(t, B).where(F.col("meta")["status"] == "F"))


@query("snapshot_restore", "", f"SELECT id AS item_id, 'host' AS type, st AS status FROM {state_sql(B)}")
def snapshot_restore(t):
    s = cut(customer_state(t, B).select("kind", "item_id", "content_hash", "body"))
    blobs = sn.new_blobs(s, s.limit(0).select(F.col("content_hash").alias("hash")))
    r = sn.restore(s.select("kind", "item_id", "content_hash"), blobs, "type string, meta map<string,string>")
    return r.select("item_id", "type", F.col("meta")["status"].alias("status"))


DIFF = f"""SELECT coalesce(a.id, b.id) AS item_id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.id IS NULL OR b.id IS
 NULL THEN 'hosts' WHEN a.cr <> b.cr THEN 'exposure' ELSE 'objects' END AS category, CASE WHEN b.id IS NULL THEN 'LOW' WHEN a.id IS NULL THEN CASE b.cr WHEN 'high' THEN 'HIGH' ELSE
 'MEDIUM' END WHEN a.cr <> b.cr THEN 'MEDIUM' ELSE 'LOW' END AS importance, CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' WHEN a.cr <> b.cr AND a.st <> b.st THEN
 'criticality,status' WHEN a.cr <> b.cr THEN 'criticality' ELSE 'status' END AS fields FROM {state_sql(A)} a FULL OUTER JOIN {state_sql(B)} b ON a.id = b.id WHERE a.id IS NULL OR b.id
 IS NULL OR a.cr <> b.cr OR a.st <> b.st"""


@query("diff_objects", "", DIFF)
def diff_objects(t):
    return sn.diff_objects(customer_state(t, A), customer_state(t, B))


@query("diff_summary", "", f"SELECT category, importance, change, count(*) AS n FROM ({DIFF}) GROUP BY ALL")
def diff_summary(t):
    return sn.summary(sn.diff_objects(customer_state(t, A), customer_state(t, B)))


def edge_state(t, at):
    from vigilframe.operators.filters import edges_as_of

    e = edges_as_of(t.rel, at).select("src", "type", "dst").distinct()
    return e.withColumn("item_id", F.concat_ws("|", "src", "type", "dst")).withColumn("content_hash", F.sha2("item_id", 256))


def edge_sql(at):
    return f"(SELECT DISTINCT src, type, dst FROM rel WHERE (first_us IS NULL OR first_us <= {at}) AND (to_us IS NULL OR to_us > {at}))"


@query("diff_relationships", "obj rel",
       f"""WITH c AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.type, b.type) AS type, coalesce(a.dst, b.dst) AS dst, CASE WHEN a.src IS NULL THEN 'added' ELSE 'removed' END AS
       change FROM {edge_sql(A)} a FULL OUTER JOIN {edge_sql(B)} b ON a.src = b.src AND a.type = b.type AND a.dst = b.dst WHERE a.src IS NULL OR b.src IS NULL) SELECT src || '|' || type ||
       '|' || dst AS item_id, change, CASE type WHEN 'LOGGED_INTO' THEN 'activity' WHEN 'RUNS' THEN 'relationships' ELSE '?' END AS category, 'LOW' AS importance FROM c""")
def diff_relationships(t):
    return sn.diff_relationships(edge_state(t, A), edge_state(t, B), t.obj)


@query("diff_findings", "ev",
       """WITH a AS (SELECT actor_id AS item_id, max(severity_rank) AS r FROM ev WHERE event_type = 'auth.failure' AND us < 1704844800000000 GROUP BY 1), b AS (SELECT actor_id AS item_id,
       max(severity_rank) AS r FROM ev WHERE event_type = 'auth.failure' AND us >= 1705708800000000 GROUP BY 1) SELECT coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN a.r IS NULL
       THEN 'added' WHEN b.r IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a.r IS NULL THEN 'new finding' WHEN b.r IS NULL THEN 'no longer present' WHEN b.r > a.r THEN
       'severity raised' ELSE 'severity lowered' END AS reason FROM a FULL OUTER JOIN b ON a.item_id = b.item_id WHERE a.r IS DISTINCT FROM b.r""")
def diff_findings(t):
    f = t.ev.where("event_type = 'auth.failure'")

    def at(cond):
        g = f.where(cond).groupBy(F.col("actor_id").alias("item_id")).agg(F.max("severity_rank").alias("severity_rank"))
        return g.withColumn("status", F.lit("OPEN")).withColumn("content_hash", F.sha2(F.col("severity_rank").cast("string"), 256))

    return sn.diff_findings(at("us < 1704844800000000"), at("us >= 1705708800000000"))


# ---------------------------------------------------------------- what-if


def _state(t):
    return wi.State(cut(t.rel), cut(t.obj))


def _counts(before, after):
    return wi.compare(before, after)


def whatif(name, build, removed_sql, added_sql="SELECT '' AS type WHERE 1 = 0"):
    sql = f"SELECT type, 'removed' AS status, count(*) AS n FROM ({removed_sql}) GROUP BY type UNION ALL SELECT type, 'added', count(*) FROM ({added_sql}) GROUP BY type"

    @query(name, "obj rel", sql)
    def run(t, build=build):
        s = _state(t)
        return _counts(s, wi.apply(s, build(s)))

    return run


whatif("whatif_basic", lambda s: wi.remove_relationships(s, (F.col("type") == "LOGGED_INTO") & (F.col("dst") == "host:s1")),
       "SELECT DISTINCT src, type, dst FROM rel WHERE type = 'LOGGED_INTO' AND dst = 'host:s1'")
whatif("whatif_roles", lambda s: wi.change_role(s, "group:g0", "role:p0", "role:r0"),
       "SELECT type FROM rel WHERE src = 'group:g0' AND type = 'HAS_ROLE' AND dst = 'role:p0'", "SELECT 'HAS_ROLE' AS type FROM obj WHERE id = 'role:r0'")
whatif("whatif_segment", lambda s: wi.segment(s, "network:n0", "network:n5"),
       "SELECT type FROM rel WHERE type = 'CAN_REACH' AND src = 'network:n0' AND dst = 'network:n5'")
whatif("whatif_isolate", lambda s: wi.isolate(s, "host:s3"),
       "SELECT type FROM rel WHERE (src = 'host:s3' AND type = 'MEMBER_OF' AND dst LIKE 'network:%')")
whatif("whatif_patch", lambda s: wi.remove_relationships(s, (F.col("type") == "AFFECTS") & F.col("src").startswith("vulnerability:v50")),
       "SELECT type FROM rel WHERE type = 'AFFECTS' AND src LIKE 'vulnerability:v50%'")


@query("whatif_exposure", "obj rel",
       """WITH x AS (SELECT id FROM obj WHERE type = 'network' AND internet AND id = 'network:n0'), m AS (SELECT r.src, r.dst FROM rel r WHERE r.src = (SELECT min(src) FROM rel WHERE type =
       'MEMBER_OF' AND dst = 'network:n5') AND r.type = 'MEMBER_OF' AND r.dst IN (SELECT dst FROM rel WHERE type = 'CAN_REACH' AND src IN (SELECT id FROM x))) SELECT 'MEMBER_OF' AS type,
       'removed' AS status, count(*) AS n FROM m HAVING count(*) > 0 UNION ALL SELECT 'MEMBER_OF', 'added', count(*) FROM m HAVING count(*) > 0 UNION ALL SELECT 'CAN_REACH', 'added',
       count(*) FROM (SELECT dst FROM rel WHERE type = 'CAN_REACH' AND src IN (SELECT dst FROM m) UNION ALL SELECT src FROM rel WHERE type = 'CAN_REACH' AND dst IN (SELECT dst FROM m) AND
       src NOT IN (SELECT id FROM x)) HAVING count(*) > 0""")
def whatif_exposure(t):
    s = _state(t)
    host = s.edges.where("type = 'MEMBER_OF' AND dst = 'network:n5'").agg(F.min("src")).first()[0]
    external = s.objects.where("id = 'network:n0'").select("id")
    return _counts(s, wi.apply(s, wi.remove_exposure(s, host or "", external)))


@query("whatif_apply", "obj", "SELECT id, disabled OR id IN ('user:c1', 'user:c2', 'identity:i3') AS disabled FROM obj")
def whatif_apply(t):
    s = _state(t)
    return wi.apply(s, wi.disable_identity(s, ["user:c1", "user:c2", "identity:i3", "host:s1"])).objects.select("id", "disabled")


@query("whatif_compare", "obj rel")
def whatif_compare(t):
    """Assets that roles and groups lose control of when one administrative right goes away."""
    s = _state(t)
    after = wi.apply(s, wi.remove_relationships(s, F.col("type") == "ADMIN_OF"))
    starts = s.objects.where("type IN ('role', 'group')").select(F.col("id").alias("start"))

    def control(state):
        return propagate(propagation_arcs(state.edges, state.objects), starts, 3, 0.2).where(F.col("mode") != sem.REACH)

    return wi.compare_control(control(s), control(after))


# ---------------------------------------------------------------- policy

RULES = [
    ("p", "r1", 1, "deny", "10.1.0.0/26", "10.2.0.0/24", "any", 0, 65535, True),
    ("p", "r2", 2, "allow", "10.1.0.0/24", "10.2.0.0/24", "tcp", 443, 443, True),
    ("p", "r3", 3, "allow", "10.1.0.0/25", "10.2.0.0/25", "tcp", 443, 443, True),
    ("p", "r4", 4, "deny", "10.1.0.0/24", "10.2.0.128/25", "tcp", 443, 443, True),
    ("p", "r5", 5, "allow", "0.0.0.0/0", "10.2.0.0/24", "udp", 53, 53, True),
    ("p", "r6", 6, "deny", "10.1.0.0/16", "0.0.0.0/0", "tcp", 80, 80, True),
    ("p", "r7", 7, "allow", "0.0.0.0/0", "0.0.0.0/0", "any", 0, 65535, False),
    ("p", "r8", 8, "allow", "10.1.0.64/26", "10.2.0.0/24", "tcp", 0, 1023, True),
]
RULE_SCHEMA = "policy_id string, rule_id string, ord int, effect string, src_cidr string, dst_cidr string, proto string, lo int, hi int, enabled boolean"


def rules(t):
    return t.spark.createDataFrame(RULES, RULE_SCHEMA)


def _octets(expr):
    return (F.expr(f"CAST({expr} % 250 AS STRING)"), F.expr(f"CAST({expr} DIV 250 % 250 AS STRING)"))


def packets(t):
    """Lineitems as packets between supplier and part addresses."""
    s, sh = _octets("l_suppkey")
    p, _ = _octets("l_partkey")
    port = F.expr("element_at(array(53, 80, 443), CAST(l_partkey % 3 + 1 AS INT))")
    base = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 1_000_000).alias("us"),
        F.concat(F.lit("10.1."), sh, F.lit("."), s).alias("src_ip"), F.concat(F.lit("10.2.0."), p).alias("dst_ip"),
        F.when(F.col("l_partkey") % 3 == 0, 17).otherwise(6).alias("ip_proto"), (1024 + F.col("l_partkey") % 1000).cast("int").alias("src_port"),
        port.alias("dst_port"), F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 18).otherwise(16).alias("tcp_flags"),
        (F.col("l_quantity") * 100).cast("long").alias("ip_bytes"),
        F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("ip"), F.lit("udp"), F.lit("udp"))).otherwise(F.array(F.lit("ip"), F.lit("tcp"))).alias("protocols"),
        F.col("l_returnflag").alias("rf"))
    back = base.where("rf = 'N'").select(
        "number", "us", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), "ip_proto", F.col("dst_port").alias("src_port"),
        F.col("src_port").alias("dst_port"), "tcp_flags", "ip_bytes", "protocols", "rf")
    return base.where("rf <> 'N'").unionByName(back).drop("rf")


PK = """(SELECT l_orderkey * 10 + l_linenumber AS number, epoch_us(l_shipdate) + l_linenumber * 1000000 AS us, '10.1.' || (l_suppkey // 250 % 250) || '.' || (l_suppkey % 250) AS cip, '10.2.0.' ||
 (l_partkey % 250) AS sip, CASE WHEN l_partkey % 3 = 0 THEN 17 ELSE 6 END AS ip_proto, CAST(1024 + l_partkey % 1000 AS INT) AS cport, CAST([53, 80, 443][l_partkey % 3 + 1] AS INT) AS sport,
 CAST(l_quantity * 100 AS BIGINT) AS ip_bytes, l_returnflag AS rf FROM lineitem)"""


@query("packet_flows", "",
       f"""SELECT cip AS a_ip, cport AS a_port, sip AS b_ip, sport AS b_port, ip_proto, count(*) FILTER (rf <> 'N') AS a_packets, count(*) FILTER (rf = 'N') AS b_packets,
       CAST(coalesce(sum(ip_bytes) FILTER (rf <> 'N'), 0) AS BIGINT) AS a_bytes, CAST(coalesce(sum(ip_bytes) FILTER (rf = 'N'), 0) AS BIGINT) AS b_bytes, min(us) AS first_us, max(us) AS
       last_us FROM {PK} GROUP BY ALL""")
def packet_flows(t):
    return fl.assemble(packets(t)).select("a_ip", "a_port", "b_ip", "b_port", "ip_proto", "a_packets", "b_packets", "a_bytes", "b_bytes", "first_us", "last_us")


@query("flow_orientation", "",
       f"""SELECT evidence, application, count(*) AS n FROM (SELECT CASE WHEN bool_or(rf = 'A') THEN 'syn' WHEN bool_or(rf = 'N') THEN 'syn-ack' ELSE 'service port' END AS evidence, CASE
       max(sport) WHEN 53 THEN 'dns' WHEN 80 THEN 'http' ELSE 'tls' END AS application FROM {PK} GROUP BY cip, cport, sip, sport, ip_proto) GROUP BY ALL""")
def flow_orientation(t):
    return fl.assemble(packets(t)).groupBy("evidence", "application").agg(F.count("*").alias("n"))


@query("flow_events", "",
       f"""SELECT min(us) AS us, 'ip:' || cip AS actor_id, 'ip:' || sip AS target_id, sport AS server_port, CAST(coalesce(sum(ip_bytes) FILTER (rf <> 'N'), 0) AS BIGINT) AS bytes_out FROM {PK}
       GROUP BY cip, cport, sip, sport, ip_proto""")
def flow_events(t):
    return fl.flow_events(fl.assemble(packets(t))).select("us", "actor_id", "target_id", "server_port", "bytes_out")


@query("flow_summary", "", f"SELECT sport AS server_port, count(*) AS flows, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT sport, sum(ip_bytes) AS b FROM {PK} GROUP BY cip, cport, sip, sport, ip_proto) GROUP BY sport ORDER BY bytes DESC LIMIT 10")
def flow_summary(t):
    g = fl.assemble(packets(t)).groupBy("server_port").agg(F.count("*").alias("flows"), F.sum(F.col("a_bytes") + F.col("b_bytes")).alias("bytes"))
    return g.orderBy(F.desc("bytes"), "server_port").limit(10)


@query("protocol_counts", "", f"SELECT p AS protocol, count(*) AS packets, CAST(sum(ip_bytes) AS BIGINT) AS bytes FROM (SELECT 'ip' AS p, ip_bytes FROM {PK} UNION ALL SELECT CASE ip_proto WHEN 17 THEN 'udp' ELSE 'tcp' END, ip_bytes FROM {PK}) GROUP BY p")
def protocol_counts(t):
    return fl.protocol_counters(packets(t))


@query("flt_packets", "", f"SELECT number, us FROM {PK} WHERE ip_proto = 6 AND (cport = 443 OR sport = 443) AND us >= {B}")
def flt_packets(t):
    return filter_packets(packets(t), protocol="tcp", port=443, start_us=B).select("number", "us")


@query("fragment_ports", "", f"SELECT count(*) AS n, count(DISTINCT cport) AS ports FROM {PK}")
def fragment_ports(t):
    """Every packet again as a first and a later fragment; the later one gets its ports back."""
    p = packets(t).where("src_port >= 1024").unionByName(packets(t).where("src_port < 1024").select(
        "number", "us", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), "ip_proto", F.col("dst_port").alias("src_port"), F.col("src_port").alias("dst_port"),
        "tcp_flags", "ip_bytes", "protocols"))
    first = p.withColumns({"ip_id": F.col("number"), "fragment_offset": F.lit(0), "more_fragments": F.lit(True)})
    later = first.withColumns({"src_port": F.lit(None).cast("int"), "dst_port": F.lit(None).cast("int"), "fragment_offset": F.lit(8), "more_fragments": F.lit(False)})
    return fl.fill_fragments(first.unionByName(later)).where("fragment_offset > 0").agg(F.count("*").alias("n"), F.countDistinct("src_port").alias("ports"))


@query("dns_pairs", "ev",
       "SELECT src_ip AS client, k, min(us) FILTER (event_type = 'http.request') AS query_us, min(us) FILTER (event_type = 'file.read') AS response_us, count(*) FILTER (event_type = "
       "'http.request') AS queries FROM ev WHERE event_type IN ('http.request', 'file.read') GROUP BY ALL")
def dns_pairs(t):
    m = t.ev.where("event_type IN ('http.request', 'file.read')").select(
        F.col("src_ip").alias("client"), F.lit("10.0.0.53").alias("server"), F.lit(5000).alias("client_port"), F.lit(53).alias("server_port"), F.col("k").alias("txid"),
        F.lit("a.example").alias("name"), F.lit("A").alias("qtype"), (F.col("event_type") == "file.read").alias("response"), "us")
    return fl.dns_pairs(m).select("client", F.col("txid").alias("k"), "query_us", "response_us", "queries")


@query("http_pairs", "ev",
       "WITH m AS (SELECT target_id, event_type = 'file.read' AS res, us, row_number() OVER (PARTITION BY target_id, event_type ORDER BY us, id) AS n FROM ev WHERE event_type IN "
       "('http.request', 'file.read')) SELECT a.target_id AS flow_id, CAST(a.n AS INT) AS n, a.us AS request_us, b.us AS response_us FROM m a LEFT JOIN m b ON b.target_id = a.target_id AND b.n = a.n "
       "AND b.res WHERE NOT a.res")
def http_pairs(t):
    m = t.ev.where("event_type IN ('http.request', 'file.read')").select(
        F.col("target_id").alias("flow_id"), (F.col("event_type") == "file.read").alias("response"), "us", F.col("id").alias("number"))
    return fl.ordered_pairs(m)


@query("tls_pairs", "ev",
       "SELECT s.target_id AS flow_id, s.us AS server_us, max(c.us) AS client_us FROM (SELECT * FROM ev WHERE event_type = 'file.read') s LEFT JOIN ev c ON c.event_type = 'http.request' AND "
       "c.target_id = s.target_id AND c.us < s.us GROUP BY s.id, s.target_id, s.us")
def tls_pairs(t):
    m = t.ev.where("event_type IN ('http.request', 'file.read')").select(
        F.col("target_id").alias("flow_id"), F.when(F.col("event_type") == "file.read", "server").otherwise("client").alias("role"), "us", F.col("id").alias("number"))
    return fl.handshakes(m)


RV = "(VALUES " + ", ".join(
    "('{}', {}, '{}', {}, {}, {}, {}, '{}', {}, {})".format(
        r[1], r[2], r[3], *cidr_range(r[4])[:2], *cidr_range(r[5])[:2], r[6], r[7], r[8])
    for r in RULES if r[9]
) + ") AS r(rule_id, ord, effect, sl, sh, dl, dh, proto, lo, hi)"
FLOWN = f"""(SELECT DISTINCT cip AS src_ip, sip AS dst_ip, CASE ip_proto WHEN 17 THEN 'udp' ELSE 'tcp' END AS proto, sport AS port, 167837696 + CAST(split_part(cip, '.', 3) AS BIGINT) * 256 +
 CAST(split_part(cip, '.', 4) AS BIGINT) AS s, 167903232 + CAST(split_part(sip, '.', 4) AS BIGINT) AS d FROM {PK})"""


@query("policy_flows", "",
       f"""SELECT src_ip, dst_ip, proto, port, coalesce(rid, 'default') AS rule_id, coalesce(eff, 'deny') AS effect FROM (SELECT f.src_ip, f.dst_ip, f.proto, f.port, arg_min(r.rule_id, r.ord) AS rid,
       arg_min(r.effect, r.ord) AS eff FROM {FLOWN} f LEFT JOIN {RV} ON f.s BETWEEN sl AND sh AND f.d BETWEEN dl AND dh AND (r.proto = 'any' OR r.proto = f.proto) AND f.port BETWEEN lo AND hi
       GROUP BY ALL)""")
def policy_flows(t):
    p = packets(t)
    c = p.where("src_port >= 1024").select("src_ip", "dst_ip", "ip_proto", F.col("dst_port").alias("port")).unionByName(
        p.where("src_port < 1024").select(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), "ip_proto", F.col("src_port").alias("port")))
    f = c.select("src_ip", "dst_ip", F.when(F.col("ip_proto") == 17, "udp").otherwise("tcp").alias("proto"), "port")
    return pol.decide_flows(f, rules(t))


def supplier_rules(t):
    """One rule per supplier: its own address to everywhere, every third one for its whole /24."""
    s, sh = _octets("s_suppkey")
    wide = F.col("s_suppkey") % 3 == 0
    return t.supplier.select(
        F.lit("s").alias("policy_id"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("rule_id"), F.col("s_suppkey").cast("int").alias("ord"),
        F.when(F.col("s_suppkey") % 2 == 0, "allow").otherwise("deny").alias("effect"),
        F.concat(F.lit("10.1."), sh, F.lit("."), s, F.when(wide, "/28").otherwise("/32")).alias("src_cidr"), F.lit("0.0.0.0/0").alias("dst_cidr"), F.lit("tcp").alias("proto"),
        F.lit(0).alias("lo"), F.when(F.col("s_suppkey") % 5 == 0, 65535).otherwise(443).alias("hi"), F.lit(True).alias("enabled"))


@query("policy_anomalies", "",
       """WITH r AS (SELECT s_suppkey AS o, 'r' || s_suppkey AS id, s_suppkey % 2 AS e, n - CASE WHEN s_suppkey % 3 = 0 THEN n % 16 ELSE 0 END AS lo, n - CASE WHEN s_suppkey % 3 = 0 THEN n % 16 - 15 ELSE 0
       END AS hi, CASE WHEN s_suppkey % 5 = 0 THEN 65535 ELSE 443 END AS p FROM (SELECT s_suppkey, (s_suppkey // 250 % 250) * 256 + s_suppkey % 250 AS n FROM supplier)) SELECT 's' AS policy_id, y.id AS
       rule_id, x.id AS because, CASE WHEN x.lo <= y.lo AND y.hi <= x.hi AND y.p <= x.p THEN CASE WHEN x.e <> y.e THEN 'shadowed' ELSE 'redundant' END ELSE 'conflicting' END AS kind FROM r x JOIN r y ON
       x.o < y.o AND x.lo <= y.hi AND y.lo <= x.hi WHERE (x.lo <= y.lo AND y.hi <= x.hi AND y.p <= x.p) OR x.e <> y.e""")
def policy_anomalies(t):
    return pol.anomalies(supplier_rules(t))


@query("policy_broad", "",
       "SELECT 's' AS policy_id, 'r' || s_suppkey AS rule_id, CASE WHEN s_suppkey % 5 = 0 THEN 'any destination,any port' ELSE 'any destination' END AS why, CASE WHEN s_suppkey % 5 = 0 THEN 'MEDIUM' ELSE "
       "'LOW' END AS severity FROM supplier WHERE s_suppkey % 2 = 0")
def policy_broad(t):
    return pol.broad_rules(supplier_rules(t))


# revisions of the supplier rules: some removed, some added, some turned round, one network widened, two pairs swapped, one switched off
REVISED = """r AS (SELECT s_suppkey AS k, s_acctbal AS b, s_suppkey % 2 = 0 AS allow, n - CASE WHEN s_suppkey % 3 = 0 THEN n % 16 ELSE 0 END AS lo, n - CASE WHEN s_suppkey % 3 = 0 THEN n % 16 - 15 ELSE 0 END AS hi,
 CASE WHEN s_suppkey % 5 = 0 THEN 65535 ELSE 443 END AS p FROM (SELECT s_suppkey, s_acctbal, (s_suppkey // 250 % 250) * 256 + s_suppkey % 250 AS n FROM supplier)),
o AS (SELECT k, k AS ord, allow, lo, hi, p, true AS live FROM r WHERE b <= 9000),
w AS (SELECT k, CASE WHEN k % 50 = 7 THEN k + 1 WHEN k % 50 = 8 THEN k - 1 ELSE k END AS ord, CASE WHEN b BETWEEN 4000 AND 5000 THEN NOT allow ELSE allow END AS allow, lo, hi, CASE WHEN k % 11 = 0 THEN 8080 ELSE p END AS p,
 k % 13 <> 0 AS live FROM r WHERE b >= 1000)"""


def revisions(t):
    r = supplier_rules(t).join(t.supplier.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("rule_id"), "s_acctbal", "s_suppkey"), "rule_id")
    flipped = F.when(F.col("s_acctbal").between(4000, 5000), F.when(F.col("effect") == "allow", "deny").otherwise("allow")).otherwise(F.col("effect"))
    k = F.col("s_suppkey")
    new = r.where("s_acctbal >= 1000").withColumns({
        "effect": flipped, "ord": F.when(k % 50 == 7, F.col("ord") + 1).when(k % 50 == 8, F.col("ord") - 1).otherwise(F.col("ord")), "hi": F.when(k % 11 == 0, 8080).otherwise(F.col("hi")), "enabled": k % 13 != 0})
    return r.where("s_acctbal <= 9000").drop("s_acctbal", "s_suppkey"), new.drop("s_acctbal", "s_suppkey")


@query("policy_diff", "",
       f"""WITH {REVISED}, live AS (SELECT o.k, row_number() OVER (ORDER BY o.ord, 'r' || o.k) AS was_at, row_number() OVER (ORDER BY w.ord, 'r' || o.k) AS is_at FROM o JOIN w USING (k) WHERE o.live AND w.live),
       j AS (SELECT coalesce(o.k, w.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' WHEN (o.allow, o.p, o.live) <> (w.allow, w.p, w.live) THEN 'changed' WHEN was_at <> is_at THEN 'moved' END AS change,
       CASE WHEN o.k IS NULL THEN w.allow WHEN w.k IS NULL THEN NOT o.allow WHEN o.live <> w.live THEN (w.live AND w.allow) OR (o.live AND NOT o.allow) WHEN o.allow <> w.allow THEN w.allow WHEN w.p > o.p THEN w.allow WHEN w.p < o.p
       THEN NOT w.allow END AS grows, was_at, is_at FROM o FULL JOIN w USING (k) LEFT JOIN live USING (k))
       SELECT 's' AS policy_id, 'r' || k AS rule_id, change, CASE WHEN grows THEN 'access-expanded' WHEN NOT grows THEN 'access-reduced' ELSE 'changed' END AS impact, CAST(was_at AS INT) AS was_at, CAST(is_at AS INT) AS is_at FROM j WHERE change IS NOT NULL""")
def policy_diff(t):
    return pol.revision_diff(*revisions(t))


def _findings_sql(name: str, version: str) -> str:
    return f"""{name} AS (SELECT 'r' || y.k AS rule_id, CASE WHEN x.lo <= y.lo AND y.hi <= x.hi AND y.p <= x.p THEN CASE WHEN x.allow <> y.allow THEN 'shadowed' ELSE 'redundant' END ELSE 'conflicting' END AS finding, 'r' || x.k AS detail
 FROM {version} x JOIN {version} y ON x.ord < y.ord AND x.lo <= y.hi AND y.lo <= x.hi WHERE x.live AND y.live AND ((x.lo <= y.lo AND y.hi <= x.hi AND y.p <= x.p) OR x.allow <> y.allow)
 UNION SELECT 'r' || k, 'overly-broad', CASE WHEN p = 65535 THEN 'any destination,any port' ELSE 'any destination' END FROM {version} WHERE allow AND live
 UNION SELECT 'r' || k, 'stale-reference', 'host:s' || (k + 20) FROM {version} WHERE live AND k + 20 > (SELECT max(s_suppkey) FROM supplier))"""


@query("policy_revision_findings", "obj", f"""WITH {REVISED}, {_findings_sql('fo', 'o')}, {_findings_sql('fw', 'w')} SELECT 's' AS policy_id, rule_id, finding, detail, 'introduced' AS status FROM (SELECT * FROM fw EXCEPT SELECT * FROM fo)
       UNION ALL SELECT 's', rule_id, finding, detail, 'resolved' FROM (SELECT * FROM fo EXCEPT SELECT * FROM fw) UNION ALL SELECT 's', NULL, 'default-allow', 'default', 'introduced'""")
def policy_revision_findings(t):
    """What a revision newly makes pointless, contradictory, broad or stale, and what it mends; its default becomes allow."""
    refs = F.array(F.concat(F.lit("host:s"), (F.substring("rule_id", 2, 9).cast("long") + 20).cast("string")), F.lit("cidr:10.0.0.0/8"))
    old, new = (r.withColumn("refs", refs) for r in revisions(t))
    default = lambda d: t.spark.createDataFrame([("s", d)], "policy_id string, default string")
    known = t.obj.select("id")
    return pol.findings_diff(pol.findings(old, default("deny"), known), pol.findings(new, default("allow"), known))
