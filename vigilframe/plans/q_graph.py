"""Graph traversal, propagation, blast radius and exposure queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilframe.functions import semantics as sem
from vigilframe.operators import graph as g
from vigilframe.operators import observed as ob
from vigilframe.operators import risk
from vigilframe.operators.loops import cut
from vigilframe.operators.propagate import exploitable, propagate, propagation_arcs
from vigilframe.plans.registry import query
from vigilframe.plans.sqltext import ARC_SQL, closure_ctes, propagate_ctes

EXPOSURE_DEPTH = 5

# ---------------------------------------------------------------- traversal


@query("neighborhood", "obj rel",
       """WITH n0 AS (SELECT id FROM obj WHERE type = 'role'), n1 AS (SELECT DISTINCT v AS id FROM (SELECT dst AS v FROM rel WHERE src
       IN (SELECT id FROM n0) UNION SELECT src FROM rel WHERE dst IN (SELECT id FROM n0)) WHERE v NOT IN (SELECT id FROM n0)),
       n2 AS (SELECT DISTINCT v AS id FROM (SELECT dst AS v FROM rel WHERE src IN (SELECT id FROM n1) UNION SELECT src FROM rel WHERE dst
       IN (SELECT id FROM n1)) WHERE v NOT IN (SELECT id FROM n0) AND v NOT IN (SELECT id FROM n1)),
       e AS (SELECT DISTINCT src, type, dst FROM rel WHERE (src IN (SELECT id FROM n0 UNION ALL SELECT id FROM n1) OR dst IN
       (SELECT id FROM n0 UNION ALL SELECT id FROM n1)) AND src IN (SELECT id FROM n0 UNION ALL SELECT id FROM n1 UNION ALL SELECT id
       FROM n2) AND dst IN (SELECT id FROM n0 UNION ALL SELECT id FROM n1 UNION ALL SELECT id FROM n2))
       SELECT 'node' AS kind, id AS item, 0 AS depth FROM n0 UNION ALL SELECT 'node', id, 1 FROM n1 UNION ALL SELECT 'node', id, 2 FROM
       n2 UNION ALL SELECT 'edge', src || '|' || type || '|' || dst, -1 FROM e""")
def neighborhood(t):
    edges = cut(t.rel.select("src", "type", "dst"))
    nodes, inside, _ = g.neighborhood(edges, t.obj.where("type = 'role'").select("id"), depth=2)
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("item"), "depth")
    e = inside.select(F.lit("edge").alias("kind"), F.concat_ws("|", "src", "type", "dst").alias("item"), F.lit(-1).alias("depth"))
    return n.unionByName(e)


@query("neighbors", "rel",
       "SELECT DISTINCT v AS id FROM (SELECT dst AS v FROM rel WHERE src = 'host:s1' UNION ALL SELECT src FROM rel WHERE dst = 'host:s1') "
       "WHERE v LIKE 'user:%' OR v LIKE 'network:%'")
def neighbors(t):
    root = t.spark.createDataFrame([("host:s1",)], "id string")
    nodes, _, _ = g.neighborhood(t.rel.select("src", "type", "dst"), root, node_types=["user", "network"])
    return nodes.where("depth = 1").select("id")


@query("neighborhood_budget", "rel",
       "WITH c AS (SELECT v AS id, min(k) AS k FROM (SELECT dst AS v, src || chr(1) || type || chr(1) || dst AS k FROM rel WHERE src = "
       "'network:n1' UNION ALL SELECT src, src || chr(1) || type || chr(1) || dst FROM rel WHERE dst = 'network:n1') GROUP BY v) "
       "SELECT id FROM (SELECT id FROM c ORDER BY k, id LIMIT 3)")
def neighborhood_budget(t):
    root = t.spark.createDataFrame([("network:n1",)], "id string")
    nodes, _, _ = g.neighborhood(t.rel.select("src", "type", "dst"), root, max_nodes=4)
    return nodes.where("depth = 1").select("id")


@query("induced_subgraph", "obj rel",
       "SELECT src, type, dst FROM rel WHERE src IN (SELECT id FROM obj WHERE type IN ('host', 'network', 'identity')) AND dst IN "
       "(SELECT id FROM obj WHERE type IN ('host', 'network', 'identity'))")
def induced_subgraph(t):
    ids = t.obj.where("type IN ('host', 'network', 'identity')").select("id")
    return g.induced_subgraph(t.rel, ids).select("src", "type", "dst")


SP_PAIRS = "SELECT a.id AS start, b.id AS goal FROM obj a JOIN obj b ON a.type = 'role' AND b.type = 'organization'"
_SP = ["s0 AS (SELECT DISTINCT start, start AS node, [start] AS path FROM p)"]
for _d in range(1, 9):
    _known = " UNION ALL ".join(f"SELECT start, node FROM s{i}" for i in range(_d))
    _SP.append(
        f"s{_d} AS MATERIALIZED (SELECT l.start, a.nxt AS node, min(l.path || [a.rl, a.nxt]) AS path FROM s{_d - 1} l JOIN a ON a.frm = "
        f"l.node WHERE NOT EXISTS (SELECT 1 FROM ({_known}) k WHERE k.start = l.start AND k.node = a.nxt) GROUP BY 1, 2)")
SP_SQL = (
    f"WITH p AS ({SP_PAIRS}), a AS MATERIALIZED (SELECT frm, nxt, min(rl) AS rl FROM (SELECT src AS frm, dst AS nxt, type AS rl FROM rel "
    f"UNION ALL SELECT dst, src, type FROM rel) GROUP BY 1, 2), {', '.join(_SP)}, every AS ("
    + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(9))
    + ") SELECT p.start, p.goal, CAST((len(e.path) - 1) // 2 AS INT) AS hops, array_to_string(e.path, '>') AS path FROM p JOIN every e ON "
    "e.start = p.start AND e.node = p.goal"
)


@query("shortest_path", "obj rel", SP_SQL)
def shortest_path(t):
    roles = t.obj.where("type = 'role'").select(F.col("id").alias("start"), F.lit(1).alias("one"))
    goals = t.obj.where("type = 'organization'").select(F.col("id").alias("goal"), F.lit(1).alias("one"))
    pairs = roles.join(F.broadcast(goals), "one").drop("one")
    out = g.shortest_paths(t.rel.select("src", "type", "dst"), pairs)
    return out.select("start", "goal", "hops", F.array_join("path", ">").alias("path"))


@query("incident_graph", "ev eo inc",
       """WITH i AS (SELECT incident_id, event_id FROM inc), o AS (SELECT DISTINCT i.incident_id, eo.object_id FROM i JOIN eo USING (event_id)),
       e AS (SELECT DISTINCT actor_id AS src, 'LOGGED_INTO' AS type, target_id AS dst FROM ev WHERE event_type = 'auth.login')
       SELECT o.incident_id AS incident_id, e.src, e.type, e.dst FROM e JOIN o ON o.object_id = e.src JOIN o p ON p.incident_id =
       o.incident_id AND p.object_id = e.dst UNION ALL SELECT incident_id, incident_id, 'INVOLVES', object_id FROM o""")
def incident_graph(t):
    """Induced edges per incident plus a virtual edge to every involved object."""
    involved = t.inc.select("incident_id", "event_id").join(t.eo, "event_id").select("incident_id", "object_id").distinct()
    logins = t.ev.where("event_type = 'auth.login'").select(
        F.col("actor_id").alias("src"), F.lit("LOGGED_INTO").alias("type"), F.col("target_id").alias("dst")).distinct()
    left = involved.withColumnRenamed("object_id", "src")
    right = involved.withColumnRenamed("object_id", "dst")
    inside = logins.join(left, "src").join(right, ["incident_id", "dst"]).select("incident_id", "src", "type", "dst")
    virtual = involved.select("incident_id", F.col("incident_id").alias("src"), F.lit("INVOLVES").alias("type"),
                              F.col("object_id").alias("dst"))
    return inside.unionByName(virtual)


@query("job_graph", "ev eo",
       """WITH o AS (SELECT DISTINCT e.source AS job, eo.object_id FROM ev e JOIN eo ON eo.event_id = e.id), e AS (SELECT DISTINCT actor_id
       AS src, target_id AS dst FROM ev WHERE event_type = 'file.read') SELECT o.job, count(*) AS edges FROM e JOIN o ON o.object_id =
       e.src JOIN o p ON p.job = o.job AND p.object_id = e.dst GROUP BY o.job""")
def job_graph(t):
    """Objects of an import job (here: a source) and the edges among them."""
    objects = t.ev.select(F.col("id").alias("event_id"), F.col("source").alias("job")).join(t.eo, "event_id").select(
        "job", "object_id").distinct()
    reads = t.ev.where("event_type = 'file.read'").select(F.col("actor_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    j = reads.join(objects.withColumnRenamed("object_id", "src"), "src").join(
        objects.withColumnRenamed("object_id", "dst"), ["job", "dst"], "left_semi")
    return j.groupBy("job").agg(F.count("*").alias("edges"))


@query("graph_stats", "obj rel",
       "SELECT 'objects' AS part, type AS key, count(*) AS n FROM obj GROUP BY type UNION ALL SELECT 'relationships', type, count(*) FROM "
       "rel GROUP BY type UNION ALL SELECT 'degree', node, n FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM rel UNION ALL "
       "SELECT dst FROM rel) GROUP BY node ORDER BY n DESC, node LIMIT 10)")
def graph_stats(t):
    def part(name, df, key, n):
        return df.select(F.lit(name).alias("part"), F.col(key).alias("key"), F.col(n).alias("n"))

    return g.union_all([
        part("objects", t.obj.groupBy("type").agg(F.count("*").alias("n")), "type", "n"),
        part("relationships", t.rel.groupBy("type").agg(F.count("*").alias("n")), "type", "n"),
        part("degree", g.degree_ranking(t.rel, 10), "node", "degree"),
    ])


@query("components", "obj rel",
       f"WITH {closure_ctes('c', '''SELECT id AS start FROM obj WHERE type IN ('host', 'cloud_resource')''', '''e.type IN ('RUNS', 'CONTAINS')''', 4)} "
       "SELECT start, node FROM c")
def components(t):
    starts = t.obj.where("type IN ('host', 'cloud_resource')").select(F.col("id").alias("start"))
    return risk.components(t.rel, starts)


# ---------------------------------------------------------------- propagation

GROUP_STARTS = "SELECT id AS start FROM obj WHERE type IN ('group', 'role', 'organization')"
ZONES = "SELECT id AS start FROM obj WHERE type = 'network'"


def _starts(t, cond):
    return t.obj.where(cond).select(F.col("id").alias("start"))


@query("traversal_rules", "obj rel",
       f"WITH {ARC_SQL} SELECT rl AS rel, mode, s AS state, count(*) AS n, round(sum(f), 4) AS total FROM arc GROUP BY ALL")
def traversal_rules(t):
    a = propagation_arcs(t.rel, t.obj)
    return a.groupBy("rel", "mode", "state").agg(F.count("*").alias("n"), F.round(F.sum("factor"), 4).alias("total"))


@query("propagation_edges", "rel",
       "SELECT type, count(*) AS n FROM rel WHERE type IN ('LOGGED_INTO', 'ADMIN_OF', 'MEMBER_OF', 'HAS_ROLE', 'CAN_ACCESS', "
       "'HAS_IDENTITY', 'USES', 'RUNS', 'CONTAINS', 'CONTAINS_SECRET', 'AUTHENTICATES_AS', 'TRUSTS', 'OWNS', 'CAN_REACH', 'AFFECTS') "
       "GROUP BY type")
def propagation_edges(t):
    return sem.propagation_edges(t.rel).groupBy("type").agg(F.count("*").alias("n"))


@query("hop_explain", "obj rel",
       "SELECT r.src, r.dst, s.name || ' is permitted to access ' || d.name || ' (policy: conf ' || r.type || ')' AS why FROM rel r "
       "JOIN obj s ON s.id = r.src JOIN obj d ON d.id = r.dst WHERE r.type = 'CAN_ACCESS'")
def hop_explain(t):
    e = sem.with_rules(t.rel.where("type = 'CAN_ACCESS'").select("src", "type", "dst"))
    named = e.join(t.obj.select(F.col("id").alias("src"), F.col("name").alias("frm_name")), "src").join(
        t.obj.select(F.col("id").alias("dst"), F.col("name").alias("to_name")), "dst")
    meta = F.create_map(F.lit("policy"), F.concat(F.lit("conf "), F.col("type")), F.lit("via"), F.lit("scan"))
    return named.select("src", "dst", sem.explain(F.col("why"), F.col("frm_name"), F.col("to_name"), meta).alias("why"))


PROP_OUT = "SELECT start, node, mode, round(conf + 1e-10, 6) AS conf, depth, priv AS privileged, coalesce(vid, '') AS vulnerability FROM pr"


def _show(df):
    return df.select("start", "node", "mode", F.round(F.col("conf") + 1e-10, 6).alias("conf"), "depth", "privileged",
                     F.coalesce("vulnerability", F.lit("")).alias("vulnerability"))


@query("propagate", "obj rel", f"WITH {ARC_SQL}, {propagate_ctes('pr', GROUP_STARTS, 5, 0.2)} {PROP_OUT}")
def q_propagate(t):
    steps = propagation_arcs(t.rel, t.obj)
    return _show(propagate(steps, _starts(t, "type IN ('group', 'role', 'organization')"), 5, 0.2))


@query("propagate_upgrade", "obj rel", f"WITH {ARC_SQL}, {propagate_ctes('pr', ZONES, 4, 0.2, 'reach', True)} {PROP_OUT}")
def propagate_upgrade(t):
    steps = propagation_arcs(t.rel, t.obj)
    return _show(propagate(steps, _starts(t, "type = 'network'"), 4, 0.2, sem.REACH, exploitable(t.rel, t.obj)))


BLAST_CTES = f"{ARC_SQL}, {propagate_ctes('pr', GROUP_STARTS, 5, 0.2, 'control', True)}"
ASSET = "split_part(p.node, ':', 1) IN ('host', 'service', 'cloud_resource', 'container', 'network', 'project')"
CRITRANK = "CASE criticality WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"


def _blast_reach(t):
    steps = propagation_arcs(t.rel, t.obj)
    starts = _starts(t, "type IN ('group', 'role', 'organization')")
    return propagate(steps, starts, 5, 0.2, upgrades=exploitable(t.rel, t.obj)), starts


@query("blast", "obj rel",
       f"""WITH {BLAST_CTES}, r AS (SELECT p.*, o.criticality, {ASSET} AS asset, p.mode <> 'reach' AS held, split_part(p.node, ':', 1) AS ty
       FROM pr p LEFT JOIN obj o ON o.id = p.node), c AS (SELECT *, asset AND criticality IN ('high', 'critical') AS crit FROM r),
       k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY CASE WHEN crit AND held THEN 0 WHEN asset AND held THEN 1 WHEN crit
       THEN 2 WHEN asset THEN 3 ELSE 4 END, {CRITRANK} DESC, conf DESC, depth, node) AS rn FROM c)
       SELECT start, count(*) FILTER (asset) AS reachable_assets, count(*) FILTER (asset AND held) AS controllable_assets,
       count(*) FILTER (crit) AS critical_assets, count(*) FILTER (crit AND held AND priv) AS privileged_paths, max(depth) AS max_depth,
       count(*) FILTER (depth <= 1) AS direct, count(*) FILTER (depth > 1) AS indirect, count(*) FILTER (ty IN ('user', 'identity') AND
       held) AS identities, count(*) FILTER (NOT held) AS network, count(*) FILTER (trust) AS trusts, max(node) FILTER (rn = 1) AS
       primary_target, round(max(conf) FILTER (rn = 1), 3) AS primary_confidence FROM k GROUP BY start""")
def q_blast(t):
    reached, _ = _blast_reach(t)
    return risk.blast(reached, t.obj)


def fold_sql(subjects: str, factors: str) -> str:
    """SQL: factor rows (subject, rule, points) to score, level and text."""
    return (
        f"SELECT s.subject, CAST(greatest(0, least(100, coalesce(sum(f.points), 0))) AS INT) AS score, CASE WHEN coalesce(sum(f.points), 0)"
        f" >= 75 THEN 'CRITICAL' WHEN coalesce(sum(f.points), 0) >= 50 THEN 'HIGH' WHEN coalesce(sum(f.points), 0) >= 25 THEN 'MEDIUM' ELSE "
        f"'LOW' END AS level, coalesce(string_agg(f.rule || '=' || CAST(f.points AS VARCHAR), ';' ORDER BY f.points < 0, abs(f.points) DESC, "
        f"f.rule), '') AS factors FROM ({subjects}) s LEFT JOIN ({factors}) f ON f.subject = s.subject GROUP BY s.subject"
    )


@query("blast_risk", "obj rel",
       f"""WITH {BLAST_CTES}, c AS (SELECT p.start, count(*) FILTER ({ASSET} AND p.mode <> 'reach' AND criticality = 'critical') AS crit,
       count(*) FILTER ({ASSET} AND p.mode <> 'reach' AND criticality = 'high') AS high, count(*) FILTER ({ASSET} AND p.mode = 'reach' AND
       criticality IN ('high', 'critical')) AS ro, count(*) FILTER ({ASSET} AND p.mode <> 'reach' AND criticality IN ('high', 'critical') AND
       p.priv) AS pv, count(*) FILTER ({ASSET} AND p.mode <> 'reach') AS ctl, count(p.vid) AS v FROM pr p LEFT JOIN obj o ON o.id = p.node
       GROUP BY p.start)"""
       + fold_sql(GROUP_STARTS.replace("AS start", "AS subject"),
                  """SELECT start AS subject, 'blast.critical-control' AS rule, least(50, 25 * crit) AS points FROM c WHERE crit > 0
                  UNION ALL SELECT start, 'blast.high-control', least(30, 10 * high) FROM c WHERE high > 0
                  UNION ALL SELECT start, 'blast.critical-reach', least(15, 5 * ro) FROM c WHERE ro > 0
                  UNION ALL SELECT start, 'blast.privileged-paths', least(20, 10 * pv) FROM c WHERE pv > 0
                  UNION ALL SELECT start, 'blast.controllable', least(20, ctl) FROM c WHERE ctl > 0
                  UNION ALL SELECT start, 'blast.exploitable', 5 FROM c WHERE v > 0"""))
def q_blast_risk(t):
    reached, starts = _blast_reach(t)
    return risk.blast_risk(reached, t.obj, starts)


# ---------------------------------------------------------------- exposure

ENTRIES = """SELECT id AS start, 'internet' AS kind FROM obj WHERE type = 'network' AND internet UNION ALL SELECT start, 'workstation' FROM
 (SELECT id AS start FROM obj WHERE type = 'host' AND workstation UNION SELECT dst FROM rel WHERE type = 'OWNS' AND src LIKE 'user:%' AND
 dst LIKE 'host:%')"""
ASSETS = "SELECT id, type, criticality FROM obj WHERE type IN ('host', 'service', 'cloud_resource', 'container')"
ACCOUNTS = "SELECT id AS start FROM obj WHERE type IN ('user', 'identity')"


@query("exposure_inputs", "obj rel",
       f"SELECT kind, count(*) AS n FROM ({ENTRIES}) GROUP BY kind UNION ALL SELECT 'principal', count(*) FROM ({ACCOUNTS}) UNION ALL "
       f"SELECT 'asset', count(*) FROM ({ASSETS})")
def exposure_inputs(t):
    rows = g.union_all([
        risk.entry_points(t.rel, t.obj).select("kind"), risk.principals(t.obj).select(F.lit("principal").alias("kind")),
        risk.assets(t.obj).select(F.lit("asset").alias("kind")),
    ])
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


ENTRY_CTES = f"""entries AS MATERIALIZED ({ENTRIES}), assets AS MATERIALIZED ({ASSETS}), {ARC_SQL},
 {propagate_ctes('er', 'SELECT start FROM entries', EXPOSURE_DEPTH, 0.05, 'reach')}"""
CONTROL_CTES = f"{propagate_ctes('cr', ACCOUNTS, EXPOSURE_DEPTH, 0.2)}"
EXPLOIT_CTES = f"{propagate_ctes('xr', 'SELECT start FROM entries', EXPOSURE_DEPTH, 0.05, 'reach', True)}"


def model(t) -> risk.Exposure:
    """The exposure model of one query's tables; its searches are written once for that query."""
    own = vars(t)
    if "_exposure" not in own:
        own["_exposure"] = risk.Exposure(t.rel, t.obj, EXPOSURE_DEPTH)
    return own["_exposure"]


@query("entry_reach", "obj rel", f"WITH {ENTRY_CTES} SELECT start, node, round(conf + 1e-10, 6) AS conf, depth, net AS hops FROM er")
def entry_reach(t):
    return model(t).entry_reach().select("start", "node", F.round(F.col("conf") + 1e-10, 6).alias("conf"), "depth", F.col("net").alias("hops"))


@query("asset_vulns", "obj rel",
       f"""SELECT DISTINCT a.id AS asset, v.src AS vulnerability, o.cvss FROM ({ASSETS}) a JOIN (SELECT src AS a, dst AS target FROM rel WHERE
       type = 'RUNS' UNION ALL SELECT id, id FROM obj) t ON t.a = a.id JOIN rel v ON v.type = 'AFFECTS' AND v.dst = t.target AND v.to_us
       IS NULL JOIN obj o ON o.id = v.src""")
def asset_vulns(t):
    return risk.asset_vulnerabilities(t.rel, t.obj)


PARTS = closure_ctes("parts", "SELECT id AS start FROM assets", "e.type IN ('RUNS', 'CONTAINS')", 4)
HOLD = closure_ctes("hold", "SELECT DISTINCT dst AS start FROM rel WHERE type = 'USES'", "e.type IN ('MEMBER_OF', 'HAS_ROLE')", 4)
STEP_STARTS = "SELECT id AS start FROM assets WHERE type IN ('host', 'service', 'container')"
EXPO_CTES = f"""{ENTRY_CTES}, {CONTROL_CTES}, {EXPLOIT_CTES}, {PARTS}, {HOLD}, {propagate_ctes('sr', STEP_STARTS, EXPOSURE_DEPTH, 0.2)},
 pe AS MATERIALIZED (SELECT b.asset, n.start, n.kind, min(r.net) AS hops FROM (SELECT id AS asset, id AS node FROM assets UNION SELECT start, node
 FROM parts WHERE start LIKE 'cloud%' OR start LIKE 'container%') b JOIN er r ON r.node = b.node JOIN entries n ON n.start = r.start
 GROUP BY ALL), reach AS (SELECT asset, min(hops) FILTER (kind = 'internet') AS nh, count(*) FILTER (kind = 'workstation') AS ws FROM pe
 GROUP BY asset), base AS MATERIALIZED (SELECT a.*, nh, coalesce(ws, 0) AS ws, nh IS NOT NULL OR coalesce(ws, 0) > 0 AS ok FROM assets a
 LEFT JOIN reach r ON r.asset = a.id), va AS (SELECT asset, max(cvss) AS top, count(*) AS n FROM (SELECT DISTINCT a.id AS asset, v.src,
 o.cvss FROM assets a JOIN (SELECT src AS a, dst AS target FROM rel WHERE type = 'RUNS' UNION ALL SELECT id, id FROM obj) t ON t.a = a.id
 JOIN rel v ON v.type = 'AFFECTS' AND v.dst = t.target AND v.to_us IS NULL JOIN obj o ON o.id = v.src) GROUP BY asset),
 vb AS (SELECT b.id, b.ok, least(20, CAST(round_even(top * 2, 0) AS INT)) AS p, least(6, 2 * (n - 1)) AS more FROM va JOIN base b ON b.id =
 va.asset), ctl AS (SELECT node AS id, count(*) FILTER (start LIKE 'user:%') AS humans, count(*) FILTER (cred) AS creds FROM cr WHERE mode <>
 'reach' GROUP BY node), sid AS (SELECT src AS id, count(*) AS n FROM rel WHERE type = 'USES' AND (dst IN (SELECT id FROM obj WHERE
 privileged) OR dst IN (SELECT h.start FROM hold h JOIN obj o ON o.id = h.node AND o.type = 'role' AND o.privileged WHERE h.hops > 0)) GROUP
 BY src), sec AS (SELECT p.start AS id, count(*) AS n FROM parts p JOIN rel e ON e.src = p.node AND e.type = 'CONTAINS_SECRET' GROUP BY 1),
 hit AS MATERIALIZED (SELECT s.start, s.node FROM sr s JOIN assets a ON a.id = s.node AND a.criticality = 'critical' WHERE s.mode <> 'reach' AND NOT
 EXISTS (SELECT 1 FROM parts p WHERE p.start = s.start AND p.node = s.node)), hosts AS (SELECT dst, min(src) AS host FROM rel WHERE type =
 'RUNS' GROUP BY dst), stp AS (SELECT start AS id, count(*) AS n FROM hit h WHERE NOT (h.node LIKE 'service:%' AND EXISTS (SELECT 1 FROM
 hosts x JOIN hit k ON k.start = h.start AND k.node = x.host WHERE x.dst = h.node)) GROUP BY start)"""
EXPO_FACTORS = """SELECT id AS subject, 'exposure.criticality' AS rule, CASE criticality WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN
 'medium' THEN 5 END AS points FROM base WHERE criticality IN ('critical', 'high', 'medium') UNION ALL SELECT id, 'exposure.internet-direct',
 20 FROM base WHERE nh <= 1 UNION ALL SELECT id, 'exposure.internet-indirect', 8 FROM base WHERE nh > 1 UNION ALL SELECT id,
 'exposure.workstation-reach', least(10, 2 * ws) FROM base WHERE ws > 0 UNION ALL SELECT id, 'exposure.vulnerability', CASE WHEN ok THEN p
 ELSE p // 2 END FROM vb UNION ALL SELECT id, 'exposure.more-vulnerabilities', CASE WHEN ok THEN more ELSE more // 2 END FROM vb WHERE CASE
 WHEN ok THEN more ELSE more // 2 END > 0 UNION ALL SELECT c.id, 'exposure.controllers', least(15, 3 * humans) FROM ctl c JOIN assets USING
 (id) WHERE humans > 0 UNION ALL SELECT c.id, 'exposure.credential-path', 5 FROM ctl c JOIN assets USING (id) WHERE creds > 0 UNION ALL
 SELECT id, 'exposure.privileged-credentials', least(15, 10 * n) FROM sid UNION ALL SELECT id, 'exposure.secrets', least(10, 5 * n) FROM sec
 UNION ALL SELECT id, 'exposure.stepping-stone', least(15, 8 * n) FROM stp UNION ALL SELECT id, 'exposure.isolated', -15 FROM base WHERE NOT
 ok AND type IN ('host', 'service')"""
EXPO_SQL = f"WITH {EXPO_CTES} " + fold_sql("SELECT id AS subject FROM assets", EXPO_FACTORS)


@query("exposure", "obj rel", EXPO_SQL)
def exposure(t):
    return model(t).assessment().select("subject", "score", "level", "factors")


@query("exposure_metrics", "obj rel",
       f"""WITH {EXPO_CTES}, sc AS ({fold_sql("SELECT id AS subject FROM assets", EXPO_FACTORS)}), prs AS (SELECT start, node FROM er UNION
       SELECT start, node FROM cr WHERE mode <> 'reach' AND start LIKE 'user:%') SELECT 'entry_points' AS metric, (SELECT count(*) FROM entries)
       + (SELECT count(*) FROM obj WHERE type = 'user') AS value UNION ALL SELECT 'reachable_assets', count(DISTINCT node) FROM prs JOIN assets
       ON id = node UNION ALL SELECT 'exposed_critical_assets', count(*) FROM sc JOIN assets ON id = subject WHERE criticality IN ('high',
       'critical') AND level IN ('HIGH', 'CRITICAL') UNION ALL SELECT 'attack_paths', count(*) FROM prs JOIN assets ON id = node WHERE
       criticality IN ('high', 'critical') UNION ALL SELECT 'critical_paths', count(*) FROM (SELECT start, node FROM xr WHERE mode <> 'reach'
       UNION SELECT start, node FROM cr WHERE mode <> 'reach' AND start LIKE 'user:%') JOIN assets ON id = node WHERE criticality =
       'critical'""")
def exposure_metrics(t):
    return model(t).metrics()


@query("exposure_findings", "obj rel",
       f"""SELECT 'finding:exposure:asset-exposure:' || substr(sha256(subject || chr(31)), 1, 12) AS id, level AS severity, subject, score
       FROM ({EXPO_SQL}) WHERE level IN ('HIGH', 'CRITICAL')""")
def exposure_findings(t):
    return model(t).findings().select("id", "severity", "subject", "score")


# ---------------------------------------------------------------- paths that incidents show

# an incident: the failures of a fiftieth of the accounts against one host; logins of the graph are told by the hosts of the events
SEEN_HOST = "CASE WHEN {0} LIKE 'host:s%' THEN 'host:h' || CAST(CAST(substr({0}, 7) AS BIGINT) % 20 AS VARCHAR) ELSE {0} END"


@query("observed_path", "ev eo obj rel", f"""WITH own AS (SELECT target_id || '-' || CAST(CAST(substr(actor_id, 7) AS BIGINT) % 50 AS VARCHAR) AS incident_id, id AS event_id, us, event_type, actor_id FROM ev WHERE event_type = 'auth.failure'),
 act AS (SELECT * FROM (SELECT incident_id, actor_id AS start, count(*) AS activity, row_number() OVER (PARTITION BY incident_id ORDER BY count(*) DESC, actor_id) AS n FROM own GROUP BY incident_id, actor_id) WHERE n <= 4),
 one AS (SELECT * FROM (SELECT 'user:u' || substr(l.src, 7) AS start, a.dst AS node, o.criticality, l.conf AS confidence, l.dst AS mid, u.dst AS ident, row_number() OVER (PARTITION BY l.src, a.dst ORDER BY l.conf DESC, l.dst, u.dst) AS n
 FROM rel l JOIN rel u ON u.src = l.dst AND u.type = 'USES' JOIN rel a ON a.src = u.dst AND a.type = 'CAN_ACCESS' JOIN obj o ON o.id = a.dst AND o.criticality IN ('high', 'critical') WHERE l.type = 'LOGGED_INTO') WHERE n = 1),
 pth AS MATERIALIZED (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY start ORDER BY {CRITRANK} DESC, confidence DESC, node) AS n FROM one) WHERE n <= 5),
 hop AS (SELECT start, node, 0 AS pos, start AS source, 'LOGGED_INTO' AS rel, {SEEN_HOST.format("mid")} AS target FROM pth UNION ALL SELECT start, node, 1, {SEEN_HOST.format("mid")}, 'USES', ident FROM pth
 UNION ALL SELECT start, node, 2, ident, 'CAN_ACCESS', {SEEN_HOST.format("node")} FROM pth),
 inv AS MATERIALIZED (SELECT incident_id, own.event_id, own.us, object_id FROM own JOIN eo ON eo.event_id = own.event_id),
 mk AS (SELECT act.incident_id, act.start, act.activity, h.node, h.pos, h.target, CASE WHEN h.target <> act.start THEN (SELECT min({{'us': i.us, 'e': i.event_id}}) FROM inv i WHERE i.incident_id = act.incident_id AND i.object_id = h.target) END AS f1,
 (SELECT min({{'us': i.us, 'e': i.event_id}}) FROM inv i JOIN inv j ON j.incident_id = i.incident_id AND j.event_id = i.event_id AND j.object_id = h.source WHERE i.incident_id = act.incident_id AND i.object_id = h.target) AS f2
 FROM act JOIN hop h ON h.start = act.start),
 sc AS (SELECT incident_id, start, activity, node, count(f1) AS observed_steps, string_agg(target || '@' || CASE WHEN f1 IS NULL THEN '' ELSE coalesce(f2.e, f1.e) END, ' ' ORDER BY pos) AS steps FROM mk GROUP BY ALL),
 rk AS (SELECT sc.*, pth.criticality, pth.confidence, row_number() OVER (PARTITION BY incident_id ORDER BY observed_steps DESC, {CRITRANK} DESC, confidence DESC, activity DESC, start, node) AS n FROM sc JOIN pth USING (start, node))
 SELECT incident_id, start, node, criticality, confidence, activity, observed_steps, steps FROM rk WHERE n = 1""")
def observed_path(t):
    """The path from an account through a host it used to a critical one, whose steps the incident's events show best."""
    number = F.substring("actor_id", 7, 20).cast("long") % 50
    own = t.ev.where("event_type = 'auth.failure'").select(F.concat_ws("-", "target_id", number.cast("string")).alias("incident_id"), F.col("id").alias("event_id"), "us", "event_type", "actor_id")
    rel = cut(t.rel.where("type IN ('LOGGED_INTO', 'USES', 'CAN_ACCESS')").select("src", "type", "dst", "conf"))
    edge = lambda kind, a, b: rel.where(F.col("type") == kind).select(F.col("src").alias(a), F.col("dst").alias(b), F.col("conf").alias(f"{kind}_conf"))
    p = edge("LOGGED_INTO", "who", "mid").join(edge("USES", "mid", "ident"), "mid").join(edge("CAN_ACCESS", "ident", "node"), "ident").join(t.obj.select(F.col("id").alias("node"), "criticality"), "node")
    p = p.where("criticality IN ('high', 'critical')").withColumn("n", F.row_number().over(Window.partitionBy("who", "node").orderBy(F.desc("LOGGED_INTO_conf"), "mid", "ident"))).where("n = 1")
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("who").orderBy(F.desc(F.expr(CRITRANK)), F.desc("LOGGED_INTO_conf"), "node"))).where(F.col("n") <= ob.TOP_PATHS)
    seen = lambda c: F.when(F.col(c).startswith("host:s"), F.concat(F.lit("host:h"), (F.substring(c, 7, 20).cast("long") % 20).cast("string"))).otherwise(F.col(c))
    start = F.concat(F.lit("user:u"), F.substring("who", 7, 20))
    hops = F.array(*[F.struct(a.alias("source"), F.lit(kind).alias("rel"), b.alias("target")) for kind, a, b in (("LOGGED_INTO", start, seen("mid")), ("USES", seen("mid"), F.col("ident")), ("CAN_ACCESS", F.col("ident"), seen("node")))])
    paths = p.select(start.alias("start"), "node", "criticality", F.col("LOGGED_INTO_conf").alias("confidence"), hops.alias("hops"))
    out = ob.observed_paths(own, t.eo, paths)
    steps = F.array_join(F.transform("hops", lambda h: F.concat(h["target"], F.lit("@"), F.coalesce(h["event_id"], F.lit("")))), " ")
    return out.withColumn("steps", steps).drop("hops")
