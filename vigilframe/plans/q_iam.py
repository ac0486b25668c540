"""Identity and access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import iam
from vigilframe.operators.loops import cut
from vigilframe.plans.registry import query
from vigilframe.plans.sqltext import ARC_SQL, closure_ctes, propagate_ctes

ACCOUNTS = "SELECT id AS start FROM obj WHERE type IN ('user', 'identity')"
MEM = closure_ctes("mem", ACCOUNTS, "e.type = 'MEMBER_OF' AND e.dst LIKE 'group:%'", 3)
ROLES = f"""{MEM}, rol AS MATERIALIZED (SELECT start, role, chain FROM (SELECT m.start, e.dst AS role, list_append(m.chain, e.dst) AS chain,
 row_number() OVER (PARTITION BY m.start, e.dst ORDER BY len(m.chain), m.chain) AS rn FROM mem m JOIN rel e ON e.src = m.node AND e.type =
 'HAS_ROLE') WHERE rn = 1)"""
DOWN = closure_ctes("dn", "SELECT DISTINCT id AS start FROM obj WHERE type = 'group'", "e.type = 'MEMBER_OF'", 3, "dst", "src")
HOLDERS = f"""{DOWN}, mb AS (SELECT start AS holder, node AS member FROM dn WHERE split_part(node, ':', 1) IN ('user', 'identity') UNION ALL
 SELECT id, id FROM obj WHERE type <> 'group'), rh AS (SELECT DISTINCT e.dst AS role, m.member FROM rel e JOIN mb m ON m.holder = e.src WHERE
 e.type = 'HAS_ROLE'), ah AS MATERIALIZED (SELECT e.dst AS resource, r.member FROM rel e JOIN rh r ON r.role = e.src WHERE e.type IN
 ('CAN_ACCESS', 'ADMIN_OF') UNION SELECT e.dst, m.member FROM rel e JOIN mb m ON m.holder = e.src WHERE e.type IN ('CAN_ACCESS', 'ADMIN_OF')
 AND e.src LIKE 'group:%' UNION SELECT dst, src FROM rel WHERE type IN ('CAN_ACCESS', 'ADMIN_OF') AND split_part(src, ':', 1) IN ('user',
 'identity'))"""
PRIV = f"""{ROLES}, flag AS (SELECT id FROM obj WHERE privileged), prv AS MATERIALIZED (SELECT start FROM ({ACCOUNTS}) WHERE start IN (SELECT id
 FROM flag) UNION SELECT start FROM rol WHERE role IN (SELECT id FROM flag) UNION SELECT src FROM rel WHERE type = 'HAS_IDENTITY' AND dst IN
 (SELECT id FROM flag))"""
GRANTS = ", ".join(f"'{x}'" for x in iam.GRANTS)


@query("memberships", "obj rel", f"WITH {MEM} SELECT start, node, hops, array_to_string(chain, '>') AS chain FROM mem WHERE hops > 0")
def memberships(t):
    return iam.memberships(t.rel, iam.accounts(t.obj)).select("start", "node", "hops", F.array_join("chain", ">").alias("chain"))


@query("roles", "obj rel", f"WITH {ROLES} SELECT start, role, array_to_string(chain, '>') AS chain FROM rol")
def roles(t):
    return iam.roles(t.rel, iam.accounts(t.obj)).select("start", "role", F.array_join("chain", ">").alias("chain"))


@query("access_holders", "obj rel", f"WITH {HOLDERS} SELECT resource, member FROM ah")
def access_holders(t):
    return iam.access_holders(cut(t.rel))


EA = propagate_ctes("ea", ACCOUNTS, 8, 0.2, rels=GRANTS)
EA_ROWS = """SELECT start, node, round(conf, 3) AS confidence, depth FROM ea WHERE mode <> 'reach' AND split_part(node, ':', 1) IN ('host',
 'service', 'cloud_resource', 'container', 'identity', 'secret', 'project', 'repository', 'database', 'application')"""


@query("effective_access", "obj rel", f"WITH {ARC_SQL}, {EA} {EA_ROWS}")
def effective_access(t):
    return iam.effective_access(cut(t.rel), t.obj).drop("admin")


@query("privilege_paths", "obj rel",
       """WITH x AS (SELECT src, type, dst, conf FROM rel) SELECT path, round(c, 3) AS confidence, depth FROM (
       SELECT a.src || '|' || a.type || '|' || a.dst || ' > ' || b.src || '|' || b.type || '|' || b.dst || ' > ' || c.src || '|' || c.type ||
       '|' || c.dst AS path, (0.5 + 0.5 * a.conf) * (0.5 + 0.5 * b.conf) * (0.9 * (0.5 + 0.5 * c.conf)) AS c, 3 AS depth FROM x a JOIN x b ON
       b.src = a.dst AND b.type = 'HAS_ROLE' JOIN x c ON c.src = b.dst AND c.type = 'CAN_ACCESS' WHERE a.src = 'user:c1' AND a.type =
       'MEMBER_OF') ORDER BY c DESC LIMIT 1""")
def privilege_paths(t):
    """The best way from one user to the host its role may access (the alternatives are left out of this check)."""
    edges = cut(t.rel)
    goal = (
        edges.where("src = 'user:c1' AND type = 'MEMBER_OF'").select(F.col("dst").alias("g"))
        .join(edges.where("type = 'HAS_ROLE'").select(F.col("src").alias("g"), F.col("dst").alias("r")), "g")
        .join(edges.where("type = 'CAN_ACCESS'").select(F.col("src").alias("r"), "dst"), "r").agg(F.min("dst")).first()[0]
    )
    return iam.privilege_paths(edges, t.obj, "user:c1", goal or "", max_depth=4, limit=1)


@query("privilege_path_alternatives", "obj rel")
def privilege_path_alternatives(t):
    edges = cut(t.rel)
    host = edges.where("src = 'role:p0' AND type = 'ADMIN_OF'").agg(F.min("dst")).first()[0]
    return iam.privilege_paths(edges, t.obj, "group:g0", host or "", max_depth=6)


@query("privileged_principals", "obj rel", f"WITH {PRIV} SELECT start FROM prv")
def privileged_principals(t):
    return iam.privileged_principals(cut(t.rel), t.obj)


RULE_OUT = "SELECT '{rule}' AS rule, {subject} AS subject, {severity} AS severity, CAST({detail} AS VARCHAR) AS detail"


@query("iam_excessive", "obj rel",
       f"""WITH {ARC_SQL}, {PRIV}, {propagate_ctes('ea', 'SELECT start FROM prv', 8, 0.2, rels=GRANTS)}, n AS (SELECT e.start, count(*) AS n FROM
       ea e JOIN obj o ON o.id = e.node WHERE e.mode <> 'reach' AND o.criticality IN ('high', 'critical') AND o.type IN ('host', 'service',
       'cloud_resource', 'database') GROUP BY 1), w AS (SELECT DISTINCT start FROM rol JOIN obj o ON o.id = role WHERE o.wildcard), j AS (SELECT
       p.start, coalesce(n.n, 0) AS n, w.start IS NOT NULL AS wild FROM prv p LEFT JOIN n ON n.start = p.start LEFT JOIN w ON w.start = p.start)
       {RULE_OUT.format(rule='excessive-privilege', subject='start', severity="CASE WHEN wild OR n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END", detail='n')}
       FROM j WHERE n >= 3 OR wild""")
def iam_excessive(t):
    return iam.excessive_privilege(cut(t.rel), cut(t.obj))


ACTIVITY = "SELECT 'user:c' || CAST(o_custkey AS VARCHAR) AS start, max(epoch_us(o_orderdate)) AS last_us FROM orders GROUP BY o_custkey"


@query("iam_dormant", "obj rel",
       f"""WITH {PRIV}, act AS ({ACTIVITY}), m AS (SELECT max(last_us) AS m FROM act) {RULE_OUT.format(rule='dormant-privileged', subject='p.start',
       severity="'MEDIUM'", detail="coalesce(CAST((m.m - a.last_us) // 86400000000 AS VARCHAR), 'none')")} FROM prv p LEFT JOIN act a ON a.start =
       p.start, m WHERE a.last_us IS NULL OR (m.m - a.last_us) // 86400000000 >= 90""")
def iam_dormant(t):
    activity = t.orders.groupBy(F.concat(F.lit("user:c"), F.col("o_custkey").cast("string")).alias("start")).agg(
        F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("last_us"))
    return iam.dormant_privileged(cut(t.rel), cut(t.obj), activity)


@query("iam_inherited", "obj rel",
       f"""WITH {ROLES} {RULE_OUT.format(rule='inherited-privilege', subject="start || '|' || role", severity="CASE WHEN o.wildcard THEN 'HIGH' ELSE "
       "'MEDIUM' END", detail="array_to_string(chain, '>')")} FROM rol JOIN obj o ON o.id = role WHERE o.privileged AND len(chain) >= 4""")
def iam_inherited(t):
    return iam.inherited_privilege(cut(t.rel), t.obj)


@query("iam_broad_role", "obj rel",
       f"""WITH {HOLDERS}, n AS (SELECT role, count(*) AS n FROM rh GROUP BY role) {RULE_OUT.format(rule='broad-role', subject='o.id',
       severity="CASE WHEN o.wildcard THEN 'HIGH' ELSE 'MEDIUM' END", detail='coalesce(n.n, 0)')} FROM obj o LEFT JOIN n ON n.role = o.id
       WHERE o.type = 'role' AND o.privileged AND (coalesce(n.n, 0) >= 5 OR o.wildcard)""")
def iam_broad_role(t):
    return iam.broad_roles(cut(t.rel), t.obj)


@query("iam_credential_exposure", "obj rel",
       f"""WITH {PRIV}, {HOLDERS}, us AS (SELECT src AS host, dst AS ident FROM rel WHERE type = 'USES' AND dst IN (SELECT start FROM prv)), cu AS
       (SELECT dst AS host, src AS member FROM rel WHERE type = 'LOGGED_INTO' UNION SELECT resource, member FROM ah)
       {RULE_OUT.format(rule='credential-exposure-path', subject="us.host || '|' || us.ident", severity="'MEDIUM'", detail='count(*)')} FROM us JOIN
       cu ON cu.host = us.host AND cu.member <> us.ident GROUP BY us.host, us.ident""")
def iam_credential_exposure(t):
    return iam.credential_exposure(cut(t.rel), cut(t.obj))


@query("iam_trust", "obj rel",
       f"""WITH tr AS (SELECT src, dst FROM rel WHERE type = 'TRUSTS') {RULE_OUT.format(rule='risky-trust', subject="tr.src || '|' || tr.dst",
       severity="'MEDIUM'", detail="CASE WHEN o.external THEN 'external' ELSE 'transitive' END")} FROM tr JOIN obj o ON o.id = tr.dst WHERE o.external
       OR EXISTS (SELECT 1 FROM tr n WHERE n.src = tr.dst AND n.dst <> tr.src)""")
def iam_trust(t):
    return iam.risky_trust(t.rel, t.obj)


@query("iam_mfa", "obj rel",
       f"""WITH {PRIV} {RULE_OUT.format(rule='privileged-without-mfa', subject='start', severity="'MEDIUM'", detail="'no-mfa'")} FROM prv JOIN obj o ON
       o.id = start WHERE o.nomfa AND o.tag <> 'service'""")
def iam_mfa(t):
    return iam.privileged_without_mfa(cut(t.rel), cut(t.obj))
