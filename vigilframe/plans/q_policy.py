"""Combined policy decisions, access decisions with selectors, and what-ifs on rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import ports
from vigilframe.functions.netaddr import cidr_range
from vigilframe.operators import decisions as dc
from vigilframe.operators.loops import cut
from vigilframe.plans.registry import query
from vigilframe.plans.sqltext import closure_ctes

# policy, rule, order, effect, source, destination, protocol, low, high, enabled
NET_RULES = [
    ("edge", "e1", 1, "deny", "10.1.0.0/28", "any", "tcp", 22, 22, True),
    ("edge", "e2", 2, "allow", "10.1.0.0/24", "10.1.0.0/26", "tcp", 22, 22, True),
    ("edge", "e3", 3, "allow", "10.1.0.32/27", "any", "tcp", 1, 1023, True),
    ("edge", "e4", 4, "allow", "any", "10.1.0.80/28", "tcp", 3389, 3389, True),
    ("edge", "e5", 5, "deny", "any", "any", "udp", 0, 65535, True),
    ("edge", "e6", 6, "allow", "10.1.0.48/28", "10.1.0.64/26", "tcp", 5985, 5985, True),
    ("edge", "e7", 7, "allow", "any", "any", "any", 0, 65535, False),
    ("edge", "e8", 8, "allow", "10.1.1.0/24", "10.1.0.0/16", "any", 0, 65535, True),
    ("lab", "l1", 1, "deny", "any", "10.1.0.96/27", "any", 0, 65535, True),
    ("lab", "l2", 2, "deny", "10.1.0.16/28", "any", "tcp", 22, 22, True),
    ("lab", "l3", 3, "allow", "10.1.0.64/26", "10.1.0.64/26", "tcp", 0, 65535, True),
]
POLICIES = [("edge", "deny", []), ("lab", "allow", ["10.1.0.64/26"])]
STATEMENTS = [
    ("s1", "allow", "*", "ssh", "host:s1*"), ("s2", "deny", "group:n3", "*", "host:*"), ("s3", "allow", "group:g1", "ss*", "host:s?5"),
    ("s4", "allow", "role:r2", "admin", "cloud_resource:c2"), ("s5", "deny", "*", "rdp", "*s[34]*"), ("s6", "allow", "role:p0", "*", "*"),
    ("s7", "allow", "group:n7", "login", "host:s7"), ("s8", "allow", "identity:i8", "ssh", "organization:*"), ("s9", "allow", "group:n9", "rdp", "host:s40"),
    ("s10", "deny", "group:n10", "ssh", "*"), ("s11", "allow", "*", "connect", "*loud_resource:c?"), ("s12", "allow", "group:n12", "rdp", "*_res*:c[0-1]"),
]
RANGES = {"any": [("tcp", 65535), ("udp", 65535), ("icmp", 255)]}
TO = "(VALUES ('tcp', 65535), ('udp', 65535), ('icmp', 255)) AS protos(proto, top)"


def net_rules(t):
    flat = t.spark.createDataFrame(NET_RULES, "policy_id string, rule_id string, ord int, effect string, src_cidr string, dst_cidr string, proto string, lo int, hi int, enabled boolean")
    return flat.withColumn("ports", dc.port_range(F.col("proto"), F.col("lo"), F.col("hi"))).drop("proto", "lo", "hi")


def policies(t):
    return t.spark.createDataFrame(POLICIES, "policy_id string, default string, scope array<string>")


def statements(t):
    return t.spark.createDataFrame(STATEMENTS, "rule_id string, effect string, principal string, action string, resource string")


def host_addresses(t):
    """Suppliers are hosts with an address each."""
    k = "s_suppkey"
    return t.supplier.select(F.concat(F.lit("host:s"), F.col(k).cast("string")).alias("host"), F.expr(f"concat('10.1.', CAST({k} DIV 250 % 250 AS STRING), '.', CAST({k} % 250 AS STRING))").alias("ip"))


def policy_requests(t):
    """Every user with a verb and a host, and every host with the next one."""
    last = t.supplier.agg(F.max("s_suppkey").alias("last"))
    users = t.customer.join(last).select(
        F.concat(F.lit("user:c"), F.col("c_custkey").cast("string")).alias("subject"), F.expr("element_at(array('ssh', 'rdp', 'access', 'reach'), CAST(c_custkey % 4 + 1 AS INT))").alias("verb"),
        F.concat(F.lit("host:s"), (F.col("c_custkey") * 7 % F.col("last") + 1).cast("string")).alias("target"))
    machines = t.supplier.join(last).select(
        F.concat(F.lit("host:s"), F.col("s_suppkey").cast("string")).alias("subject"), F.lit("connect").alias("verb"), F.concat(F.lit("host:s"), (F.col("s_suppkey") * 3 % F.col("last") + 1).cast("string")).alias("target"))
    return users.unionByName(machines)


def _numbers(cidr: str) -> str:
    low, high, _ = (0, 2**32 - 1, 0) if cidr == "any" else cidr_range(cidr)
    return f"{low}, {high}"


RULE_SQL = "(VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, '{r[3]}', {_numbers(r[4])}, {_numbers(r[5])}, '{r[6]}', {r[7]}, {r[8]})" for r in NET_RULES if r[9]) + ") AS r(policy_id, rule_id, ord, effect, sl, sh, dl, dh, proto, lo, hi)"
STATEMENT_SQL = "(VALUES " + ", ".join(str(s) for s in STATEMENTS) + ") AS st(rule_id, effect, principal, action, resource)"


def _regex(selector: str) -> str:
    return "^" + selector.replace(".", "\\.").replace("*", ".*").replace("?", ".") + "$"


# selectors as (selector, regular expression, whether they see the resource alone)
SELECTOR_SQL = "(VALUES " + ", ".join(f"('{s}', '{_regex(s)}', {str(s.endswith(':*')).lower()})" for s in sorted({x[4] for x in STATEMENTS})) + ") AS sel(resource, rx, alone)"
REQUEST_SQL = """SELECT 'user:c' || c_custkey AS subject, ['ssh', 'rdp', 'access', 'reach'][c_custkey % 4 + 1] AS verb, 'host:s' || (c_custkey * 7 % (SELECT max(s_suppkey) FROM supplier) + 1) AS target
FROM customer UNION SELECT 'host:s' || s_suppkey, 'connect', 'host:s' || (s_suppkey * 3 % (SELECT max(s_suppkey) FROM supplier) + 1) FROM supplier"""
HOST_SQL = "SELECT 'host:s' || s_suppkey AS host, 167837696 + (s_suppkey // 250 % 250) * 256 + s_suppkey % 250 AS n FROM supplier"
# one point of every stretch of ports on which all rules agree
POINT_SQL = f"""SELECT DISTINCT proto, pt FROM (SELECT p.proto, unnest([0, lo, hi + 1]) AS pt, top FROM {RULE_SQL}, {TO.replace('AS protos', 'AS p')}) WHERE pt <= top"""


def _verdict_sql(name: str, legs: str) -> str:
    """CTEs ``<name>(src, dst, want, ok, rules)`` for ``legs(src, dst, want)``: rules by the first match at every point of the ports asked for."""
    return f"""{name}p AS (SELECT l.*, a.n AS s, b.n AS d FROM ({legs}) l JOIN hst a ON a.host = l.src JOIN hst b ON b.host = l.dst),
{name}g AS (SELECT l.*, 'edge' AS policy_id, 'deny' AS def FROM {name}p l UNION ALL SELECT l.*, 'lab', 'allow' FROM {name}p l WHERE s BETWEEN {_numbers('10.1.0.64/26').replace(',', ' AND')} OR d BETWEEN {_numbers('10.1.0.64/26').replace(',', ' AND')}),
{name}m AS (SELECT g.src, g.dst, g.want, g.policy_id, def, w.proto, w.pt, arg_min(r.rule_id, r.ord) AS rule_id, arg_min(r.effect, r.ord) AS effect FROM {name}g g JOIN wants w ON w.want = g.want
 LEFT JOIN {RULE_SQL} ON r.policy_id = g.policy_id AND s BETWEEN sl AND sh AND d BETWEEN dl AND dh AND (r.proto = 'any' OR r.proto = w.proto) AND w.pt BETWEEN lo AND hi GROUP BY ALL),
{name}d AS (SELECT src, dst, want, policy_id, bool_or(coalesce(effect, def) = 'allow') AS allowed FROM {name}m GROUP BY ALL),
{name} AS (SELECT src, dst, want, bool_and(allowed) AS ok, list_sort(list(DISTINCT policy_id || ':' || coalesce(rule_id, 'default')) FILTER ((coalesce(effect, def) = 'allow') = allowed)) AS rules
 FROM {name}m JOIN {name}d USING (src, dst, want, policy_id) GROUP BY ALL)"""


def _access_sql(name: str, asked: str) -> str:
    """CTEs ``<name>(principal, action, resource, decision, rules, by_default)`` for ``asked(principal, action, resource)``; needs ``acts``, ``anc``."""
    return f"""{name}q AS MATERIALIZED (SELECT DISTINCT * FROM ({asked})),
{name}h AS (SELECT q.principal, q.action, q.resource, st.rule_id, st.effect, st.action AS granted FROM {name}q q JOIN acts a ON a.principal = q.principal JOIN {STATEMENT_SQL} ON st.principal IN ('*', a.holder)
 JOIN anc ON anc.resource = q.resource JOIN {SELECTOR_SQL} ON sel.resource = st.resource AND regexp_matches(anc.parent, rx) AND (NOT alone OR anc.parent = q.resource)
 WHERE q.action IS NULL OR st.action IN ('*', 'admin', q.action) OR (st.action LIKE '%*' AND starts_with(q.action, rtrim(st.action, '*')))),
{name}s AS (SELECT principal, action, resource, count(*) FILTER (effect = 'deny') AS denies, count(*) FILTER (effect = 'allow') AS allows, bool_or(effect = 'allow' AND NOT covered) AS survives,
 list_sort(list(DISTINCT rule_id) FILTER (effect = 'deny')) AS dr, list_sort(list(DISTINCT rule_id) FILTER (effect = 'allow')) AS ar
 FROM (SELECT h.*, EXISTS (SELECT 1 FROM {name}h x WHERE x.principal = h.principal AND x.action IS NOT DISTINCT FROM h.action AND x.resource = h.resource AND x.effect = 'deny' AND (x.granted IN ('*', h.granted)
 OR (x.granted LIKE '%*' AND starts_with(h.granted, rtrim(x.granted, '*'))))) AS covered FROM {name}h h) GROUP BY ALL),
{name} AS (SELECT q.principal, q.action, q.resource, CASE WHEN denies > 0 AND (q.action IS NOT NULL OR NOT survives) THEN 'deny' WHEN allows > 0 THEN 'allow' ELSE 'deny' END AS decision,
 CASE WHEN denies > 0 AND (q.action IS NOT NULL OR NOT survives) THEN dr WHEN allows > 0 THEN ar ELSE [] END AS rules, denies IS NULL AS by_default
 FROM {name}q q LEFT JOIN {name}s s ON s.principal = q.principal AND s.resource = q.resource AND s.action IS NOT DISTINCT FROM q.action)"""


ACTS_SQL = f"""{closure_ctes("grp", "SELECT id AS start FROM obj WHERE type IN ('user', 'identity', 'group')", "e.type = 'MEMBER_OF'", 4)},
acts AS MATERIALIZED (SELECT start AS principal, node AS holder FROM grp UNION SELECT start, e.dst FROM grp JOIN rel e ON e.src = node AND e.type = 'HAS_ROLE'),
{closure_ctes("up", "SELECT id AS start FROM obj WHERE type = 'host'", "e.type IN ('CONTAINS', 'RUNS')", 4, "dst", "src")},
anc AS MATERIALIZED (SELECT start AS resource, node AS parent FROM up)"""


@query("policy_access", "obj rel", f"""WITH {ACTS_SQL}, {_access_sql("acc", '''SELECT o.id AS principal, a.action, 'host:s' || ((CAST(regexp_extract(o.id, '([0-9]+)$', 1) AS BIGINT) * 3 + a.n) % (SELECT max(s_suppkey) FROM supplier) + 1) AS resource
 FROM obj o, (VALUES ('ssh', 0), ('rdp', 1), (NULL, 2)) AS a(action, n) WHERE o.type IN ('user', 'identity')''')} SELECT principal, action, resource, decision, array_to_string(rules, ',') AS rules, by_default FROM acc""")
def policy_access(t):
    """Every account asks for logins and for anything at all, on exact, prefix, glob and open statements."""
    actions = F.posexplode(F.array(F.lit("ssh"), F.lit("rdp"), F.lit(None))).alias("k", "action")
    who = t.obj.where("type IN ('user', 'identity')").select(F.col("id").alias("principal"), actions)
    n = F.regexp_extract("principal", "([0-9]+)$", 1).cast("long") * 3 + F.col("k")
    q = who.join(t.supplier.agg(F.max("s_suppkey").alias("last"))).select("principal", "action", F.concat(F.lit("host:s"), (n % F.col("last") + 1).cast("string")).alias("resource"))
    rel = cut(t.rel)
    out = dc.decide_access(q, statements(t), dc.acting_as(rel, q), dc.lies_in(rel, q))
    return out.withColumn("rules", F.array_join("rules", ","))


@query("policy_ports", "", f"""WITH hst AS ({HOST_SQL}), req AS ({REQUEST_SQL}), pts AS ({POINT_SQL}), wants AS (SELECT 'all' AS want, proto, pt FROM pts), {_verdict_sql("v", "SELECT subject AS src, target AS dst, 'all' AS want FROM req WHERE verb = 'connect'")}
SELECT src, dst, policy_id, CASE WHEN allowed THEN 'allow' ELSE 'deny' END AS decision, (SELECT array_to_string(list_sort(list(DISTINCT coalesce(rule_id, 'default'))), ',') FROM vm m WHERE m.src = d.src AND m.dst = d.dst AND
 m.policy_id = d.policy_id) AS decided FROM vd d""")
def policy_ports(t):
    """Decisive rules of every port, host to host, under each policy that governs them."""
    ip = host_addresses(t)
    q = policy_requests(t).where("verb = 'connect'").join(ip.select(F.col("host").alias("subject"), F.col("ip").alias("src_ip")), "subject").join(ip.select(F.col("host").alias("target"), F.col("ip").alias("dst_ip")), "target")
    d = dc.decide_ports(q.withColumn("wanted", ports.everything()), net_rules(t), policies(t))
    j = q.join(d, ["src_ip", "dst_ip"])
    return j.select(F.col("subject").alias("src"), F.col("target").alias("dst"), "policy_id", "decision", F.array_join(F.array_sort(F.transform("decided", lambda x: F.coalesce(x["rule_id"], F.lit("default")))), ",").alias("decided"))


DECISION_SQL = f"""WITH {ACTS_SQL}, hst AS ({HOST_SQL}), req AS MATERIALIZED ({REQUEST_SQL}), pts AS ({POINT_SQL}),
wants AS (SELECT 'all' AS want, proto, pt FROM pts UNION ALL VALUES ('ssh', 'tcp', 22), ('rdp', 'tcp', 3389), ('pivot', 'tcp', 22), ('pivot', 'tcp', 3389), ('pivot', 'tcp', 5985)),
rq AS (SELECT *, CASE WHEN verb IN ('ssh', 'rdp') THEN verb ELSE 'all' END AS want, split_part(subject, ':', 1) = 'user' AS person FROM req),
ar0 AS (SELECT src AS subject, dst AS host, min(CASE type WHEN 'OWNS' THEN 0 ELSE 1 END) AS rank FROM rel WHERE type IN ('OWNS', 'LOGGED_INTO') AND src LIKE 'user:%' AND dst LIKE 'host:%' GROUP BY ALL),
ar AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY rank, host) AS place, min(rank) OVER (PARTITION BY subject) AS best FROM ar0 WHERE subject IN (SELECT subject FROM req)),
fr AS MATERIALIZED (SELECT subject, host AS src, place FROM ar WHERE CASE WHEN best = 0 THEN rank = 0 ELSE place <= 5 END UNION ALL SELECT DISTINCT subject, subject, 1 FROM rq WHERE NOT person),
{_verdict_sql("v", "SELECT DISTINCT src, target AS dst, want FROM rq JOIN fr USING (subject)")},
seen AS (SELECT rq.subject, rq.verb, rq.target, place, fr.src, v.ok, v.rules FROM rq JOIN fr USING (subject) JOIN hst a ON a.host = fr.src JOIN hst b ON b.host = rq.target LEFT JOIN v ON v.src = fr.src AND v.dst = rq.target AND v.want = rq.want),
net AS MATERIALIZED (SELECT subject, verb, target, src AS source, ok AS net_ok, rules AS net_rules FROM (SELECT *, row_number() OVER (PARTITION BY subject, verb, target ORDER BY coalesce(ok, false) DESC, place) AS n FROM seen) WHERE n = 1),
ask AS (SELECT subject, verb, subject AS principal, CASE WHEN verb = 'access' THEN NULL ELSE verb END AS action, target AS resource FROM rq WHERE person AND verb NOT IN ('reach', 'connect')),
askall AS MATERIALIZED (SELECT * FROM ask UNION ALL SELECT a.subject, a.verb, e.dst, a.action, a.resource FROM ask a JOIN rel e ON e.src = a.subject AND e.type = 'HAS_IDENTITY'),
{_access_sql("acc", "SELECT principal, action, resource FROM askall")},
ide AS MATERIALIZED (SELECT * FROM (SELECT k.subject, k.verb, k.resource AS target, k.principal AS as_principal, acc.decision AS identity, acc.rules AS identity_rules, row_number() OVER (PARTITION BY k.subject, k.verb, k.resource ORDER BY
 CASE WHEN k.principal = k.subject AND decision = 'allow' THEN 0 WHEN decision = 'allow' THEN 1 WHEN k.principal = k.subject THEN 2 ELSE 3 END, k.principal) AS n
 FROM askall k JOIN acc ON acc.principal = k.principal AND acc.resource = k.resource AND acc.action IS NOT DISTINCT FROM k.action) WHERE n = 1),
blk AS MATERIALIZED (SELECT rq.* FROM rq JOIN net USING (subject, verb, target) WHERE person AND NOT net_ok),
may AS (SELECT DISTINCT a.principal AS subject, st.resource AS host, 1000000 AS place FROM acts a JOIN {STATEMENT_SQL} ON st.principal IN ('*', a.holder) WHERE st.effect = 'allow' AND st.action IN ('*', 'ssh', 'rdp', 'admin', 'login') AND
 st.resource LIKE 'host:%' AND st.resource NOT LIKE '%*%'),
piv AS MATERIALIZED (SELECT subject, host, min(place) AS place FROM (SELECT subject, host, place FROM ar UNION ALL SELECT * FROM may) c WHERE subject IN (SELECT subject FROM blk) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.subject = c.subject
 AND fr.src = c.host) GROUP BY ALL),
{_verdict_sql("w", "SELECT DISTINCT fr.src, piv.host AS dst, 'pivot' AS want FROM piv JOIN fr USING (subject)")},
leg AS MATERIALIZED (SELECT piv.subject, piv.host, piv.place, arg_min(fr.src, fr.place) AS src FROM piv JOIN fr USING (subject) JOIN w ON w.src = fr.src AND w.dst = piv.host AND w.ok GROUP BY ALL),
{_verdict_sql("z", "SELECT DISTINCT host AS src, target AS dst, want FROM blk JOIN leg USING (subject) WHERE host <> target")},
way AS (SELECT subject, verb, target, string_agg(p, ' ' ORDER BY place, host) AS pivots FROM (SELECT blk.subject, blk.verb, blk.target, leg.host, leg.place, leg.src || '>' || leg.host || '[' || array_to_string(w.rules, ',') || ';' ||
 array_to_string(z.rules, ',') || ']' AS p, row_number() OVER (PARTITION BY blk.subject, blk.verb, blk.target ORDER BY leg.place, leg.host) AS n FROM blk JOIN leg USING (subject) JOIN z ON z.src = leg.host AND z.dst = blk.target AND z.want = blk.want
 AND z.ok JOIN w ON w.src = leg.src AND w.dst = leg.host) WHERE n <= 5 GROUP BY ALL)
SELECT subject, verb, target, CASE WHEN net_ok IS NULL AND identity IS NULL THEN 'not-evaluated' WHEN coalesce(net_ok, true) AND coalesce(identity, 'allow') = 'allow' THEN 'allow' ELSE 'deny' END AS decision,
 CASE WHEN (net_ok IS NOT NULL OR identity IS NOT NULL) AND coalesce(net_ok, true) AND coalesce(identity, 'allow') = 'allow' THEN 'direct' WHEN pivots IS NOT NULL THEN 'pivot' ELSE 'none' END AS kind,
 CASE WHEN net_ok THEN 'allow' WHEN NOT net_ok THEN 'deny' END AS network, source, array_to_string(net_rules, ',') AS net_rules, identity, as_principal, array_to_string(identity_rules, ',') AS identity_rules, pivots
FROM rq LEFT JOIN net USING (subject, verb, target) LEFT JOIN ide USING (subject, verb, target) LEFT JOIN way USING (subject, verb, target)"""


@query("policy_decision", "obj rel", DECISION_SQL)
def policy_decision(t):
    d = dc.decide(policy_requests(t), t.rel, host_addresses(t), net_rules(t), policies(t), statements(t))
    way = F.transform("pivots", lambda p: F.concat(p["source"], F.lit(">"), p["pivot"], F.lit("["), F.array_join(p["rules1"], ","), F.lit(";"), F.array_join(p["rules2"], ","), F.lit("]")))
    return d.withColumns({"net_rules": F.array_join("net_rules", ","), "identity_rules": F.array_join("identity_rules", ","), "pivots": F.when(F.size("pivots") > 0, F.array_join(way, " "))})


# ---------------------------------------------------------------- what-ifs

INSERTED = ("10.1.0.0/27", "any", ["tcp/22", "tcp/3000-4000"])
DISABLED = ("edge", "e3")
EXTRA = [("edge", "x1", 9, "allow", "any", "10.1.0.36/30", "tcp", 8080, 8090, True), ("edge", "x2", 10, "allow", "any", "any", "tcp", 443, 443, True), ("edge", "x3", 0, "deny", "10.1.0.44/31", "any", "tcp", 443, 443, True)]
LABELS = [["any"], ["tcp/22", "tcp/443"], ["tcp/0-1023"]]


@query("whatif_policy", "", f"""WITH rl AS (SELECT * FROM {RULE_SQL} UNION ALL VALUES {", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, '{r[3]}', {_numbers(r[4])}, {_numbers(r[5])}, '{r[6]}', {r[7]}, {r[8]})" for r in EXTRA)}),
rb AS (SELECT 'b' AS v, * FROM rl UNION ALL SELECT 'a', * FROM rl WHERE rule_id <> '{DISABLED[1]}' UNION ALL VALUES ('a', 'edge', 'i1', -1, 'deny', {_numbers(INSERTED[0])}, {_numbers("any")}, 'tcp', 22, 22),
 ('a', 'edge', 'i2', -1, 'deny', {_numbers(INSERTED[0])}, {_numbers("any")}, 'tcp', 3000, 4000)),
ed AS (SELECT 'host:s' || s_suppkey AS src, 'host:s' || (s_suppkey * 3 % (SELECT max(s_suppkey) FROM supplier) + 1) AS dst, s_suppkey % 3 AS kind FROM supplier
 UNION ALL SELECT 'network:n' || a.n_nationkey, 'network:n' || b.n_nationkey, a.n_nationkey % 3 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
spot AS (SELECT 'host:s' || s_suppkey AS id, 167837696 + (s_suppkey // 250 % 250) * 256 + s_suppkey % 250 AS n FROM supplier UNION ALL SELECT 'network:n' || n_nationkey, 167837696 + n_nationkey % 16 * 16 + unnest(range(16)) FROM nation),
pts AS (SELECT proto, pt, coalesce(lead(pt) OVER (PARTITION BY proto ORDER BY pt), top + 1) - pt AS width FROM (SELECT DISTINCT p.proto, pt, top FROM {TO.replace('AS protos', 'AS p')},
 (SELECT unnest([0, lo, hi + 1, 22, 23, 443, 444, 1024]) AS pt FROM rb) WHERE pt <= top)),
cell AS (SELECT DISTINCT a.n AS s, b.n AS d FROM ed JOIN spot a ON a.id = ed.src JOIN spot b ON b.id = ed.dst),
gov AS (SELECT *, 'edge' AS policy_id, 'deny' AS def FROM cell UNION ALL SELECT *, 'lab', 'allow' FROM cell WHERE s BETWEEN {_numbers('10.1.0.64/26').replace(',', ' AND')} OR d BETWEEN {_numbers('10.1.0.64/26').replace(',', ' AND')}),
dec AS (SELECT s, d, v, proto, pt, width, bool_and(e = 'allow') AS ok FROM (SELECT g.s, g.d, w.v, p.proto, p.pt, p.width, g.policy_id, coalesce(arg_min(r.effect, r.ord), any_value(def)) AS e FROM gov g, pts p, (VALUES ('a'), ('b')) AS w(v)
 LEFT JOIN rb r ON r.v = w.v AND r.policy_id = g.policy_id AND g.s BETWEEN sl AND sh AND g.d BETWEEN dl AND dh AND (r.proto = 'any' OR r.proto = p.proto) AND p.pt BETWEEN lo AND hi GROUP BY ALL) GROUP BY ALL),
ba AS (SELECT s, d, proto, pt, width, bool_or(ok) FILTER (v = 'b') AS was, bool_or(ok) FILTER (v = 'a') AS now FROM dec GROUP BY ALL),
per AS (SELECT ed.src, ed.dst, s, d, proto, pt, width, kind = 0 OR (kind = 1 AND proto = 'tcp' AND pt IN (22, 443)) OR (kind = 2 AND proto = 'tcp' AND pt <= 1023) AS mine, was AND NOT now AS gone, now AND NOT was AS new
 FROM ed JOIN spot a ON a.id = ed.src JOIN spot b ON b.id = ed.dst JOIN ba ON s = a.n AND d = b.n),
pe AS (SELECT src, dst, proto, pt, width, bool_or(mine AND NOT gone) AS stays, bool_or(new) AS new, bool_or(mine AND gone) AS hurt FROM per GROUP BY ALL)
SELECT src, dst, CASE WHEN NOT bool_or(stays) THEN 'lost' WHEN NOT bool_or(hurt) THEN 'kept' ELSE 'narrowed' END AS status, CAST(sum(CASE WHEN stays THEN width ELSE 0 END) AS BIGINT) AS left_ports,
 CAST(sum(CASE WHEN new THEN width ELSE 0 END) AS BIGINT) AS gained_ports FROM pe GROUP BY src, dst""")
def whatif_policy(t):
    """Reachability of hosts and zones after a deny is put first and an allow is disabled, under rules from anywhere and networks inside zones."""
    wanted = F.create_map(*[x for k, labels in enumerate(LABELS) for x in (F.lit(k), ports.parse(F.array(*[F.lit(p) for p in labels])))])
    ip = host_addresses(t)
    kind = F.regexp_extract("src", "([0-9]+)$", 1).cast("int") % 3
    machines = policy_requests(t).where("verb = 'connect'").select(F.col("subject").alias("src"), F.col("target").alias("dst"))
    near = ip.select(F.col("host").alias("src"), F.col("ip").alias("src_cidr"))
    hosts = machines.join(near, "src").join(near.withColumnsRenamed({"src": "dst", "src_cidr": "dst_cidr"}), "dst")
    zone = t.nation.select(F.concat(F.lit("network:n"), F.col("n_nationkey").cast("string")).alias("src"), F.expr("concat('10.1.0.', CAST(n_nationkey % 16 * 16 AS STRING), '/28')").alias("src_cidr"))
    between = t.rel.where("type = 'CAN_REACH'").select("src", "dst").join(zone, "src").join(zone.withColumnsRenamed({"src": "dst", "src_cidr": "dst_cidr"}), "dst")
    edges = hosts.unionByName(between).withColumn("ports", wanted[kind])
    extra = t.spark.createDataFrame(EXTRA, "policy_id string, rule_id string, ord int, effect string, src_cidr string, dst_cidr string, proto string, lo int, hi int, enabled boolean")
    before = net_rules(t).unionByName(extra.withColumn("ports", dc.port_range(F.col("proto"), F.col("lo"), F.col("hi"))).drop("proto", "lo", "hi"))
    after = dc.insert_deny(dc.disable_rule(before, *DISABLED), "edge", *INSERTED)
    out = dc.reach_after(edges, before, after, policies(t))
    return out.select("src", "dst", "status", ports.size(F.col("left")).alias("left_ports"), ports.size(F.col("gained")).alias("gained_ports"))
