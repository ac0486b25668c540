"""Trace, replay, secrets, dependencies and surface queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilframe.operators import deps, surface, trace
from vigilframe.operators import secrets as sec
from vigilframe.operators.loops import cut
from vigilframe.plans.registry import query

H, DAY = 3_600_000_000, 86_400_000_000
JAN20 = 1705708800000000


def events(t):
    return t.ev.withColumn("roles", F.create_map(F.lit("src_ip"), F.concat(F.lit("ip:"), "src_ip"), F.lit("none"), F.lit(None).cast("string")))


LINKS = """(SELECT 'ip:' || src_ip AS cause, actor_id AS effect, 'AUTHENTICATED_FROM' AS relation, us, round(confidence * 0.95, 3) AS confidence, id AS event_id, source FROM ev WHERE event_type =
 'auth.login' UNION ALL SELECT actor_id, target_id, 'LOGGED_INTO', us, round(confidence, 3), id, source FROM ev WHERE event_type = 'auth.login' UNION ALL SELECT actor_id, target_id,
 'CONNECTED_TO', us, round(confidence, 3), id, source FROM ev WHERE event_type = 'network.flow')"""


@query("trace_causes", "ev", f"SELECT effect, relation, count(*) AS n, count(DISTINCT cause) AS causes FROM {LINKS} GROUP BY ALL")
def trace_causes(t):
    return trace.observed_links(events(t)).groupBy("effect", "relation").agg(F.count("*").alias("n"), F.countDistinct("cause").alias("causes"))


@query("trace_effects", "ev", f"SELECT cause, effect, relation, us, event_id FROM {LINKS}")
def trace_effects(t):
    return trace.observed_links(events(t)).select("cause", "effect", "relation", "us", "event_id")


@query("trace_corroborate", "ev",
       f"""WITH l AS (SELECT cause, effect, relation, us // {30 * DAY} AS us, confidence, event_id, source FROM {LINKS}), s AS (SELECT cause, effect, relation, us, source, arg_min(confidence, event_id) AS c
       FROM l GROUP BY ALL) SELECT cause, effect, relation, count(*) AS sources FROM s GROUP BY cause, effect, relation, us""")
def trace_corroborate(t):
    links = trace.observed_links(events(t)).withColumn("us", F.expr(f"us div {30 * DAY}"))
    c = trace.corroborate(links)
    return c.select("cause", "effect", "relation", F.col("sources").cast("long").alias("sources"))


@query("trace_credential", "ev",
       f"""WITH r AS (SELECT actor_id AS reader, 'user:u' || (k + 20) AS ident, us FROM ev WHERE event_type = 'file.read') SELECT l.id AS login_id, l.actor_id AS identity, arg_max(reader, (r.us, reader)) AS
       reader, max(r.us) AS read_us FROM ev l JOIN r ON r.ident = l.actor_id AND r.us BETWEEN l.us - {DAY} AND l.us AND r.reader <> l.actor_id WHERE l.event_type = 'auth.login' GROUP BY l.id, l.actor_id""")
def trace_credential(t):
    """A file per event key; its credential belongs to the user with the same number."""
    reads = t.ev.where("event_type = 'file.read'").withColumn("target_id", F.concat(F.lit("file:f"), F.col("k").cast("string")))
    holds = t.ev.select(F.concat(F.lit("file:f"), F.col("k").cast("string")).alias("file"), F.concat(F.lit("user:u"), (F.col("k") + 20).cast("string")).alias("identity")).distinct()
    return trace.credential_exposure(reads, t.ev.where("event_type = 'auth.login'"), holds, DAY).select("login_id", "identity", "reader", "read_us")


@query("trace_session", "ev",
       f"""WITH s AS (SELECT * FROM ev WHERE event_type = 'auth.login'), e AS (SELECT * FROM ev WHERE event_type = 'auth.failure'), p AS (SELECT * FROM ev WHERE event_type = 'network.flow') SELECT p.id,
       arg_max(s.actor_id, (s.us, s.id)) AS other, count(*) AS open FROM p JOIN s ON s.target_id = p.target_id AND s.us BETWEEN p.us - {12 * H} AND p.us AND s.actor_id <> p.actor_id WHERE NOT EXISTS
       (SELECT 1 FROM e WHERE e.actor_id = s.actor_id AND e.target_id = s.target_id AND e.us > s.us AND e.us <= p.us) GROUP BY p.id""")
def trace_session(t):
    return trace.open_sessions(t.ev.where("event_type = 'auth.login'"), t.ev.where("event_type = 'auth.failure'"), t.ev.where("event_type = 'network.flow'"), 12 * H)


@query("trace_dns", "ev",
       f"""SELECT f.id, arg_max(a.name, (a.us, a.name)) AS name FROM (SELECT id, src_ip, us FROM ev WHERE event_type = 'auth.failure') f JOIN (SELECT src_ip, us, 'd' || k AS name FROM ev WHERE event_type =
       'file.read') a ON a.src_ip = f.src_ip AND a.us BETWEEN f.us - {H} AND f.us GROUP BY f.id""")
def trace_dns(t):
    from vigilframe.operators.detect import dns_before

    flows = t.ev.where("event_type = 'auth.failure'").select("id", F.col("src_ip").alias("dst_ip"), "us")
    answers = t.ev.where("event_type = 'file.read'").select(F.col("src_ip").alias("ip"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("name"), "us")
    return dns_before(flows, answers)


WALK = f"""WITH l AS ({LINKS[1:-1]}), s AS (SELECT DISTINCT target_id AS start FROM ev), one AS (SELECT *, row_number() OVER (PARTITION BY start, relation ORDER BY us DESC, cause) AS rn FROM (SELECT s.start,
 l.cause, l.relation, l.us FROM s JOIN l ON l.effect = s.start AND l.us <= {JAN20})), n1 AS (SELECT start, cause AS node, max(us) AS b FROM one WHERE rn <= 5 GROUP BY ALL), two AS (SELECT *, row_number()
 OVER (PARTITION BY start, node, relation ORDER BY us DESC, cause) AS rn FROM (SELECT n1.start, n1.node, l.cause, l.relation, l.us FROM n1 JOIN l ON l.effect = n1.node AND l.us <= n1.b WHERE n1.node <>
 n1.start)) SELECT start, start AS node, cause AS nxt, relation, us, 1 AS level FROM one WHERE rn <= 5 UNION ALL SELECT start, node, cause, relation, us, 2 FROM two WHERE rn <= 5"""


@query("trace_walk", "ev", WALK)
def trace_walk(t):
    starts = t.ev.select(F.col("target_id").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(JAN20).alias("bound_us"))
    return trace.walk(trace.observed_links(events(t)), starts, 2).select("start", "node", "nxt", "relation", "us", "level")


def _step(before: str, n: int) -> str:
    """SQL of the n-th link of every chain in ``before``: the three best that go on from its last object and time."""
    later = " AND ".join(f"l.cause <> b.o{k}" for k in range(n))
    events = "".join(f", b.e{k}" for k in range(1, n))
    kept = "".join(f", b.o{k}" for k in range(1, n)) + events
    support = "l.confidence" if n == 1 else "l.confidence / (1 + (b.us - l.us) / 60000000.0 / 15)"
    return (f"(SELECT * FROM (SELECT b.o0{kept}, l.cause AS o{n}, l.event_id AS e{n}, l.us, b.score + {support} AS score, row_number() OVER (PARTITION BY b.o0{events} ORDER BY {support} DESC, l.us DESC,"
            f" l.cause DESC, l.event_id DESC) AS rn FROM {before} b JOIN l ON l.effect = b.o{n - 1} AND l.us <= b.us AND {later} WHERE {support} >= 0.1) WHERE rn <= 3)")


STEPS = range(1, trace.CHAIN_LINKS + 1)
CHAIN_SQL = (f"WITH l AS MATERIALIZED (SELECT * FROM {LINKS} WHERE confidence >= 0.3), c0 AS (SELECT DISTINCT target_id AS o0, {JAN20} AS us, CAST(0 AS DOUBLE) AS score FROM ev)"
    + "".join(f", c{n} AS MATERIALIZED {_step(f'c{n - 1}', n)}" for n in STEPS) + ", u AS ("
    + " UNION ALL ".join(f"SELECT o0 AS start, {' || chr(62) || '.join(f'o{k}' for k in range(n, -1, -1))} AS chain, {' || chr(62) || '.join(f'o{k}' for k in range(n + 1))} AS way, score, {n} AS links FROM c{n}" for n in STEPS)
    + ") SELECT start, arg_max(chain, (score, way)) AS chain, round(max(score), 4) AS score, arg_max(links, (score, way)) AS links FROM u GROUP BY start")


@query("trace_chain", "ev", CHAIN_SQL)
def trace_chain(t):
    """The best chain of up to twelve causes into every host, from all observed links."""
    starts = t.ev.select(F.col("target_id").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(JAN20).alias("bound_us"))
    return trace.best_chains(trace.observed_links(events(t)), starts)


EDGE = "(SELECT id AS event_id, us, actor_id || '>' || target_id AS rel, event_type = 'auth.failure' AS ended FROM ev WHERE category = 'auth')"


@query("replay_steps", "ev eo",
       f"""WITH f AS (SELECT arg_min(event_id, (us, event_id)) AS id FROM eo GROUP BY object_id), a AS (SELECT id, count(*) AS n FROM f GROUP BY id), c AS (SELECT event_id AS id, ended, lag(ended) OVER (PARTITION
       BY rel ORDER BY us, event_id) AS was FROM {EDGE}) SELECT e.id, coalesce(a.n, 0) AS new_objects, CAST(coalesce(NOT c.ended AND (c.was IS NULL OR c.was), false) AS BIGINT) AS added_relationships,
       CAST(coalesce(c.ended AND c.was IS NOT NULL AND NOT c.was, false) AS BIGINT) AS removed_relationships FROM ev e LEFT JOIN a ON a.id = e.id LEFT JOIN c ON c.id = e.id""")
def replay_steps(t):
    edges = t.ev.where("category = 'auth'").select(F.col("id").alias("event_id"), "us", F.concat_ws(">", "actor_id", "target_id").alias("rel"), (F.col("event_type") == "auth.failure").alias("ended"))
    return trace.replay_steps(t.ev, t.eo, edges).drop("us", "event_type")


STATE = f"""(SELECT 'session' AS kind, actor_id || '@' || target_id AS key FROM (SELECT actor_id, target_id, arg_max(event_type, (us, id)) AS st FROM ev WHERE us <= {JAN20} AND event_type IN ('auth.login',
 'auth.failure') GROUP BY ALL) WHERE st = 'auth.login' UNION SELECT 'flow', actor_id || '>' || target_id FROM ev WHERE category = 'network' AND us <= {JAN20} AND us > {JAN20} - {DAY})"""


@query("replay_state", "ev", f"SELECT kind, key FROM {STATE}")
def replay_state(t):
    return trace.replay_state(t.ev, JAN20, DAY)


@query("replay_digest", "ev", f"SELECT kind, count(*) AS n FROM {STATE} GROUP BY kind")
def replay_digest(t):
    return trace.state_digest(trace.replay_state(t.ev, JAN20, DAY)).select("kind", "n")


@query("replay_changes", "eo",
       f"SELECT object_id, first_us FROM (SELECT object_id, min(us) AS first_us FROM eo GROUP BY object_id) WHERE first_us BETWEEN 1704412800000000 AND {JAN20}")
def replay_changes(t):
    from vigilframe.operators.timeline import object_activity

    return object_activity(t.eo).where(F.col("first_us").between(1704412800000000, JAN20)).select("object_id", "first_us")


@query("replay_context", "ev rel obj",
       "SELECT src, type, dst FROM rel WHERE (first_us IS NULL OR first_us <= 915148800000000) AND (to_us IS NULL OR to_us > 915148800000000) AND src IN (SELECT id FROM obj WHERE type IN ('user', 'host')) AND dst "
       "IN (SELECT id FROM obj WHERE type = 'host')")
def replay_context(t):
    from vigilframe.operators.filters import edges_as_of

    e = edges_as_of(t.rel, 915148800000000)
    a = t.obj.where("type IN ('user', 'host')").select(F.col("id").alias("src"))
    b = t.obj.where("type = 'host'").select(F.col("id").alias("dst"))
    return e.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "type", "dst")


@query("chain_verify", "",
       """SELECT o_custkey || '-' || year(o_orderdate) || '-' || quarter(o_orderdate) AS chain, seq, 'content' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate),
       quarter(o_orderdate) ORDER BY o_orderkey) AS seq FROM orders) WHERE o_totalprice > 490000""")
def chain_verify(t):
    """A custody chain per customer and quarter, hashed here; the largest orders were altered afterwards."""
    chain = F.concat_ws("-", "o_custkey", F.year("o_orderdate"), F.quarter("o_orderdate"))
    logs = t.orders.groupBy(chain.alias("chain")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("log"))

    def add(acc, x):
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1))["entry_hash"], F.lit(""))
        made = F.struct(x["o_orderkey"].alias("k"), x["o_totalprice"].alias("price"), prev.alias("prev_hash"),
                        F.sha2(F.concat_ws("\x1f", prev, x["o_orderkey"].cast("string"), F.lit("ok")), 256).alias("entry_hash"))
        return F.concat(acc, F.array(made))

    empty = F.array().cast("array<struct<k:bigint,price:double,prev_hash:string,entry_hash:string>>")
    e = logs.select("chain", F.posexplode(F.aggregate("log", empty, add)).alias("pos", "x")).select(
        "chain", (F.col("pos") + 1).cast("long").alias("seq"), "x.k", "x.prev_hash", "x.entry_hash", F.when(F.col("x.price") > 490000, "altered").otherwise("ok").alias("note"))
    return trace.verify_chain(e, ["k", "note"])


# ---------------------------------------------------------------- secrets

LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
ASSIGN_SQL = f"""(SELECT DISTINCT doc_id, line, substr(raw, 2, length(raw) - 2) AS value FROM (SELECT *, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'),
 '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\s_.\\-]+'), lambda p: p <> '') AS parts FROM (SELECT doc_id, line, unnest(regexp_extract_all(content, '{sec.ASSIGNED.replace("'", "''")}', 1)) AS name,
 unnest(regexp_extract_all(content, '{sec.ASSIGNED.replace("'", "''")}', 2)) AS raw FROM {LINES_SQL}))
 WHERE left(raw, 1) IN ('"', chr(39)) AND (list_contains({sec.SECRET_WORDS}, parts[-1]) OR regexp_matches(parts[-1], '({"|".join(sec.SECRET_ENDINGS)})$') OR list_contains({sec.SECRET_PAIRS}, array_to_string(parts[-2:], ' ')))
 AND NOT regexp_full_match(substr(raw, 2, length(raw) - 2), '[0-9]+'))"""


@query("secret_scan")
def secret_scan(t):
    """Every rule over all lines; tests compare it with a plain search."""
    return sec.scan(t.documents, "doc_id").select("doc_id", F.col("line").cast("long").alias("line"), "rule", "value")


@query("secret_assignments", "", f"SELECT doc_id, line, value FROM {ASSIGN_SQL}")
def secret_assignments(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "content")).select("doc_id", (F.col("n") + 1).cast("long").alias("line"), "content")
    return sec.assignments(lines, "doc_id").select("doc_id", "line", "value").distinct()


@query("secret_rules", "")
def secret_rules(t):
    return sec.scan(t.documents, "doc_id").groupBy("rule").agg(F.count("*").alias("n"))


@query("secret_placeholder", "", "SELECT p_partkey, p_partkey % 4 <> 0 AS placeholder FROM part")
def secret_placeholder(t):
    m = F.col("p_partkey") % 4
    v = F.when(m == 0, F.concat(F.lit("k9Q"), F.col("p_partkey").cast("string"), F.lit("zT7"))).when(m == 1, "${DB_PASSWORD}").when(m == 2, "your_key_here").otherwise("xxx")
    return t.part.select("p_partkey", sec.is_placeholder(v).alias("placeholder"))


@query("secret_confidence", "",
       "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 0.6 ELSE 0.95 END - CASE WHEN page_id % 3 = 0 THEN 0.3 ELSE 0 END AS c FROM pages".replace(" AS c", "").replace("SELECT page_id, ", "SELECT page_id, round(CAST(").replace("END FROM", "END AS DOUBLE), 4) AS confidence FROM"))
def secret_confidence(t):
    rule = F.when(F.col("page_id") % 2 == 0, "assignment").otherwise("github-token")
    path = F.when(F.col("page_id") % 3 == 0, "src/tests/a.py").otherwise("src/main.py")
    return t.pages.select("page_id", sec.confidence(rule, path).alias("confidence"))


@query("secret_fingerprint", "", f"SELECT count(*) AS places, CASE WHEN length(value) >= 12 THEN substr(value, 1, 3) || '****' || right(value, 4) ELSE repeat('*', least(length(value), 8)) END AS shown FROM {ASSIGN_SQL} GROUP BY value")
def secret_fingerprint(t):
    """One row per assigned secret, with the places it stands in."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "content")).select("doc_id", (F.col("n") + 1).alias("line"), "content")
    return sec.report(sec.assignments(lines, "doc_id").distinct(), "doc_id", "salt").select("places", "shown")


@query("secret_allowlist", "", "SELECT page_id, page_id % 5 = 0 OR page_id % 2 = 0 AS allowed FROM pages")
def secret_allowlist(t):
    rows = t.pages.select("page_id", F.when(F.col("page_id") % 5 == 0, "jwt").otherwise("assignment").alias("rule"),
                          F.when(F.col("page_id") % 2 == 0, "docs/a/readme.md").otherwise("src/x.py").alias("path"))
    return rows.select("page_id", sec.allowlisted(rows, ["jwt"], ["docs/*.md"]).alias("allowed"))


@query("secret_lifecycle", "",
       """SELECT p_partkey, CASE WHEN p_size <= 20 AND p_size > 10 THEN 'OPEN' WHEN p_size <= 10 AND p_type <> 'PROMO' THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM part WHERE p_size <= 30""")
def secret_lifecycle(t):
    """Stored secrets of parts up to size 20; the scan found sizes 11 to 30 and did not cover one part type."""
    from vigilframe.operators.lifecycle import transition

    stored = t.part.where("p_size <= 20").select(F.col("p_partkey").alias("id"), F.lit("OPEN").alias("status"))
    found = t.part.where("p_size > 10 AND p_size <= 30").select(F.col("p_partkey").alias("id"))
    covered = t.part.where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id"), F.lit(True).alias("covered"))
    j = transition(stored.join(covered, "id", "left_semi"), found).select("id", "status")
    rest = stored.join(covered, "id", "left_anti").join(j.select("id"), "id", "left_anti")
    return j.unionByName(rest).select(F.col("id").alias("p_partkey"), "status")


# ---------------------------------------------------------------- dependencies


def packages(t):
    eco = F.when(F.col("p_partkey") % 2 == 0, "npm").otherwise("pypi")
    return t.part.select("p_partkey", F.col("p_brand").alias("project"), eco.alias("ecosystem"), F.col("p_name").alias("name"),
                         F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".0")).alias("version"),
                         (F.col("p_type") == "PROMO").alias("direct"))


def advisories(t):
    """One advisory per package name: introduced at half of its largest size, fixed at its largest size."""
    g = packages(t).groupBy("ecosystem", "name").agg(F.max(F.split("version", r"\.")[0].cast("int")).alias("m"))
    return g.select(F.concat(F.lit("A-"), "name").alias("id"), "ecosystem", "name", F.concat(F.expr("m div 2").cast("string"), F.lit(".5")).alias("introduced"),
                    F.concat(F.col("m").cast("string"), F.lit(".0.0")).alias("fixed"), F.lit(None).cast("string").alias("last_affected"))


VULN = """(SELECT p.*, m FROM (SELECT *, p_partkey % 2 AS e FROM part) p JOIN (SELECT p_partkey % 2 AS e, p_name, max(p_size) AS m FROM part GROUP BY ALL) a ON a.e = p.e AND a.p_name = p.p_name WHERE (p_size > m // 2
 OR (p_size = m // 2 AND p_partkey % 10 >= 5)) AND p_size < m)"""


@query("vuln_exact", "", f"SELECT p_partkey, 'A-' || p_name AS id FROM {VULN}")
def vuln_exact(t):
    return deps.vulnerable_exact(packages(t), advisories(t)).select("p_partkey", "id")


# constraints of six kinds, with their bounds as numbers; the last cannot be read
DECLARED_SQL = """(SELECT p.*, CASE k WHEN 0 THEN '^' || p_size || '.0.0' WHEN 1 THEN '~' || p_size || '.3' WHEN 2 THEN CASE e WHEN 0 THEN '>=' || p_size || '.1.0 <' || (p_size + 2) || '.0.0' ELSE '>=' || p_size || '.1, <' || (p_size + 2) END
 WHEN 3 THEN '^0.0.' || (p_size % 5) WHEN 4 THEN CASE e WHEN 0 THEN p_size || '.x' ELSE '==' || p_size || '.*' END ELSE 'latest' END AS "constraint",
 CASE k WHEN 0 THEN p_size * 1000000 WHEN 1 THEN p_size * 1000000 + 3000 WHEN 2 THEN p_size * 1000000 + 1000 WHEN 3 THEN p_size % 5 WHEN 4 THEN p_size * 1000000 END AS lo,
 CASE k WHEN 0 THEN (p_size + 1) * 1000000 WHEN 1 THEN p_size * 1000000 + 4000 WHEN 2 THEN (p_size + 2) * 1000000 WHEN 3 THEN p_size % 5 + 1 WHEN 4 THEN (p_size + 1) * 1000000 END AS hi FROM (SELECT *, p_partkey % 2 AS e, p_partkey // 2 % 6 AS k FROM part) p)"""
ADVISED_SQL = """(SELECT p_partkey % 2 AS e, p_name, 'A-' || p_name AS id, max(p_size) // 2 * 1000000 + 5000 AS alo, max(p_size) * 1000000 AS ahi FROM part GROUP BY ALL UNION ALL SELECT DISTINCT p_partkey % 2, p_name, 'Z-' || p_name, 0, 3 FROM part)"""
LOOSE_SQL = f"(SELECT p.*, a.id FROM {DECLARED_SQL} p JOIN {ADVISED_SQL} a ON a.e = p.e AND a.p_name = p.p_name AND lo < ahi AND hi > alo AND alo < ahi)"


def declared(t):
    size = F.col("p_size").cast("string")
    npm = F.col("p_partkey") % 2 == 0
    more = (F.col("p_size") + 2).cast("string")
    text = F.array(
        F.concat(F.lit("^"), size, F.lit(".0.0")), F.concat(F.lit("~"), size, F.lit(".3")),
        F.when(npm, F.concat(F.lit(">="), size, F.lit(".1.0 <"), more, F.lit(".0.0"))).otherwise(F.concat(F.lit(">="), size, F.lit(".1, <"), more)), F.concat(F.lit("^0.0."), (F.col("p_size") % 5).cast("string")),
        F.when(npm, F.concat(size, F.lit(".x"))).otherwise(F.concat(F.lit("=="), size, F.lit(".*"))), F.lit("latest"))
    return t.part.select("p_partkey", "p_type", F.when(npm, "npm").otherwise("pypi").alias("ecosystem"), F.col("p_name").alias("name"), F.get(text, (F.expr("p_partkey DIV 2 % 6")).cast("int")).alias("constraint"))


def all_advisories(t):
    early = packages(t).select(F.concat(F.lit("Z-"), "name").alias("id"), "ecosystem", "name", F.lit("0").alias("introduced"), F.lit("0.0.3").alias("fixed"), F.lit(None).cast("string").alias("last_affected")).distinct()
    return advisories(t).unionByName(early)


@query("vuln_constraint", "", f"SELECT p_partkey, id FROM {LOOSE_SQL}")
def vuln_constraint(t):
    return deps.vulnerable_constraint(declared(t).drop("p_type"), all_advisories(t)).select("p_partkey", "id")


@query("constraint_forms", "", f"""SELECT CASE e WHEN 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, lo IS NOT NULL AS parsed, count(DISTINCT "constraint") AS n FROM {DECLARED_SQL} GROUP BY ALL""")
def constraint_forms(t):
    return deps.constraint_ranges(declared(t)).groupBy("ecosystem", "parsed").agg(F.countDistinct("constraint").alias("n"))


@query("vulnerable_packages", "",
       f"""SELECT 'package:' || p_partkey AS target, 'exact' AS basis, p_size || '.' || (p_partkey % 10) || '.0' AS version, NULL AS "constraint", 0.9::DOUBLE AS confidence, 'A-' || p_name AS advisories FROM {VULN}
       WHERE p_type <> 'LARGE' AND p_partkey % 3 <> 0 UNION ALL SELECT 'dependency:' || p_partkey, 'constraint', NULL, any_value("constraint"), 0.5, string_agg(id, ',' ORDER BY id) FROM {LOOSE_SQL} WHERE p_type = 'LARGE' AND p_partkey % 3 <> 0
       GROUP BY p_partkey""")
def vulnerable_packages(t):
    """Installed and merely declared packages that projects use, with their advisories."""
    installed = packages(t).join(t.part.where("p_type <> 'LARGE'").select("p_partkey"), "p_partkey").withColumn("target", F.concat(F.lit("package:"), F.col("p_partkey").cast("string")))
    wanted = declared(t).where("p_type = 'LARGE'").withColumn("target", F.concat(F.lit("dependency:"), F.col("p_partkey").cast("string")))
    uses = t.part.where("p_partkey % 3 <> 0").select(F.explode(F.array(*[F.concat(F.lit(k), F.col("p_partkey").cast("string")) for k in ("package:", "dependency:")])).alias("target"))
    z = F.col("id").startswith("Z-")
    ranges = all_advisories(t)
    exact = deps.vulnerable(installed, wanted.limit(0), ranges.where(~z), uses)
    loose = deps.vulnerable(installed.limit(0), wanted, ranges, uses)
    return exact.unionByName(loose).withColumn("advisories", F.array_join("advisories", ","))


@query("dep_projects", "",
       f"""SELECT p.p_brand AS project, count(*) AS packages, count(*) FILTER (p_type = 'PROMO') AS direct, coalesce(max(v.n), 0) AS open_findings FROM part p LEFT JOIN (SELECT p_brand, count(*) AS n FROM {VULN} GROUP
       BY 1) v ON v.p_brand = p.p_brand GROUP BY p.p_brand""")
def dep_projects(t):
    return deps.project_summary(packages(t), deps.vulnerable_exact(packages(t), advisories(t)))


@query("osv_intervals", "", "SELECT 'A' || p_partkey AS id, lower(p_brand) AS ecosystem, p_name AS name, '0' AS introduced, p_size || '.0' AS fixed FROM part UNION ALL SELECT 'A' || p_partkey, lower(p_brand), p_name, p_size || '.5', '' FROM part")
def osv_intervals(t):
    ver = F.col("p_size").cast("string")

    def ev(**k):
        return F.struct(*[F.coalesce(k.get(n, F.lit(None)).cast("string")).alias(n) for n in ("introduced", "fixed", "last_affected")])

    evs = F.array(ev(introduced=F.lit("0")), ev(fixed=F.concat(ver, F.lit(".0"))), ev(introduced=F.concat(ver, F.lit(".5"))))
    doc = F.to_json(F.struct(
        F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("id"),
        F.array(F.struct(F.struct(F.col("p_brand").alias("ecosystem"), F.col("p_name").alias("name")).alias("package"), F.array(F.struct(F.lit("SEMVER").alias("type"), evs.alias("events"))).alias("ranges"))).alias("affected")))
    return deps.osv_intervals(t.part.select(doc.alias("line"))).select("id", "ecosystem", "name", "introduced", F.coalesce("fixed", F.lit("")).alias("fixed"))


# the parts of a brand are the packages of a project; each depends on two later ones, and odd brands name what their root depends on
PLACED = "(SELECT p_brand, p_name, p_size, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, CAST(substr(p_brand, -1, 1) AS INT) % 2 = 1 AS odd FROM part)"
NODE_SQL = "'npm:' || p_name || '@' || p_partkey || '.' || p_size"


def sboms(t):
    """One document per brand: CycloneDX for odd ones, SPDX for even ones."""
    placed = t.part.withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    i = F.col("i")
    ref = lambda n: F.concat(F.lit("p"), n.cast("string"))
    version = F.concat_ws(".", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    purl = F.concat(F.lit("pkg:npm/"), F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")), F.lit("@"), version)
    comp = F.array_sort(F.collect_list(F.struct(ref(i).alias("bom-ref"), F.lit("library").alias("type"), purl.alias("purl"))))
    needs = F.array_sort(F.collect_list(F.struct(ref(i).alias("ref"), F.array(ref(2 * i), ref(2 * i + 1)).alias("dependsOn"))))
    odd = F.substring("p_brand", -1, 1).isin("1", "3", "5", "7", "9")
    root = F.array(F.struct(F.lit("root").alias("ref"), F.array(F.lit("p1"), F.lit("p6")).alias("dependsOn")))
    head = F.struct(F.struct(F.lit("root").alias("bom-ref"), F.lit("app").alias("name")).alias("component"))
    c = placed.where(odd).groupBy(F.col("p_brand").alias("doc")).agg(comp.alias("components"), needs.alias("needs"))
    c = c.select("doc", F.to_json(F.struct(head.alias("metadata"), "components", F.concat(root, "needs").alias("dependencies"))).alias("line"))
    pack = F.array_sort(F.collect_list(F.struct(ref(i).alias("SPDXID"), F.array(F.struct(F.lit("purl").alias("referenceType"), purl.alias("referenceLocator"))).alias("externalRefs"))))
    link = lambda a, kind, b: F.struct(a.alias("spdxElementId"), F.lit(kind).alias("relationshipType"), b.alias("relatedSpdxElement"))
    links = F.flatten(F.collect_list(F.array(link(ref(i), "DEPENDS_ON", ref(2 * i)), link(ref(2 * i + 1), "DEPENDENCY_OF", ref(i)))))
    x = placed.where(~odd).groupBy(F.col("p_brand").alias("doc")).agg(pack.alias("packages"), links.alias("relationships"))
    return c.unionByName(x.select("doc", F.to_json(F.struct("packages", "relationships")).alias("line")))


@query("sbom_packages", "", f"SELECT p_brand AS doc, 'npm' AS ecosystem, p_name AS name, p_partkey || '.' || p_size AS version, i = 1 OR (odd AND i = 6) AS direct FROM {PLACED}")
def sbom_packages(t):
    return deps.sbom_tables(sboms(t), "doc")[0]


@query("sbom_edges", "", f"WITH n AS (SELECT *, {NODE_SQL} AS node FROM {PLACED}) SELECT a.p_brand AS doc, a.node AS parent, b.node AS child FROM n a JOIN n b ON a.p_brand = b.p_brand AND b.i // 2 = a.i")
def sbom_edges(t):
    return deps.sbom_tables(sboms(t), "doc")[1]


@query("dep_graph", "", f"""WITH RECURSIVE n AS (SELECT *, {NODE_SQL} AS node FROM {PLACED}), w AS (SELECT p_brand, node, i, node AS via, 1 AS depth FROM n WHERE i = 1 OR (odd AND i = 6)
       UNION ALL SELECT n.p_brand, n.node, n.i, w.via, w.depth + 1 FROM w JOIN n ON n.p_brand = w.p_brand AND n.i // 2 = w.i), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, node ORDER BY depth, via) AS rn FROM w) WHERE rn = 1)
       SELECT n.p_brand AS doc, n.node, n.i = 1 OR (odd AND n.i = 6) AS direct, b.depth, b.via, CASE WHEN n.p_size >= 30 THEN 'A' || (n.p_size % 7) || ',B' ELSE '' END AS vulnerabilities FROM n JOIN b ON b.p_brand = n.p_brand AND b.node = n.node""")
def dep_graph(t):
    """Every package of every project with its distance, the direct dependency that brings it in, and its advisories."""
    packs, edges = deps.sbom_tables(cut(sboms(t)), "doc")
    packs = cut(packs)
    size = F.substring_index("version", ".", -1).cast("int")
    hits = packs.where(size >= 30).select("ecosystem", "name", "version", F.explode(F.array(F.concat(F.lit("A"), (size % 7).cast("string")), F.lit("B"))).alias("id"))
    return deps.dependency_graph(packs, edges, hits, "doc").withColumn("vulnerabilities", F.array_join("vulnerabilities", ","))


@query("pair_versions", "",
       """WITH a AS (SELECT p_name AS package, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC) AS rn FROM (SELECT DISTINCT p_name, p_size FROM part WHERE p_type = 'PROMO')), b AS (SELECT p_name AS
       package, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC) AS rn FROM (SELECT DISTINCT p_name, p_size FROM part WHERE p_type = 'LARGE')) SELECT coalesce(a.package, b.package) AS package,
       CAST(coalesce(a.rn, b.rn) AS INT) AS rn, a.p_size || '.0.0' AS from_version, b.p_size || '.0.0' AS to_version FROM a FULL OUTER JOIN b ON a.package = b.package AND a.rn = b.rn""")
def pair_versions(t):
    v = t.part.select(F.col("p_name").alias("package"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version"), "p_type").distinct()
    return deps.pair_versions(v.where("p_type = 'PROMO'").drop("p_type"), v.where("p_type = 'LARGE'").drop("p_type"))


# ---------------------------------------------------------------- surface


def hosts(t):
    return t.pages.select(F.regexp_extract("url", r"://([^/?#:]+)", 1).alias("name")).distinct()


def dns(t):
    """Hosts as names: blog names are aliases of their parent, the rest have an address."""
    h = hosts(t)
    parent = F.expr("substr(name, instr(name, '.') + 1)")
    a = F.when(F.col("name").endswith(".net"), F.lit("10.9.8.7")).otherwise(F.lit("203.0.113.9"))
    return h.select("name", F.when(F.col("name").startswith("blog."), "CNAME").otherwise("A").alias("type"), F.when(F.col("name").startswith("blog."), parent).otherwise(a).alias("value"))


HOSTS = "(SELECT DISTINCT regexp_extract(url, '://([^/?#:]+)', 1) AS name FROM pages)"


@query("surf_internal", "", f"SELECT 'internal-address-in-dns' AS rule, name AS subject, 'LOW' AS severity FROM {HOSTS} WHERE name LIKE '%.net' AND name NOT LIKE 'blog.%'")
def surf_internal(t):
    return surface.internal_addresses(dns(t))


@query("surf_dangling", "", f"SELECT 'dangling-dns' AS rule, h.name AS subject, 'MEDIUM' AS severity FROM {HOSTS} h LEFT JOIN {HOSTS} p ON p.name = substr(h.name, 6) WHERE h.name LIKE 'blog.%' AND p.name IS NULL")
def surf_dangling(t):
    live = t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "10.9.8.7").otherwise("203.0.113.9").alias("node"))
    return surface.dangling(dns(t), live)


DNS_SQL = f"(SELECT name, CASE WHEN name LIKE 'blog.%' THEN substr(name, 6) WHEN name LIKE '%.net' THEN '10.9.8.7' ELSE '203.0.113.9' END AS value FROM {HOSTS})"


@query("surface_assets", "", f"WITH RECURSIVE w AS (SELECT name, value AS node, 1 AS hops FROM {DNS_SQL} UNION ALL SELECT w.name, d.value, hops + 1 FROM w JOIN {DNS_SQL} d ON d.name = w.node) SELECT name, node, hops FROM w")
def surface_assets(t):
    """Everything each name leads to, at any distance."""
    return surface.resolve_names(dns(t)).select("name", "node", "hops")


@query("surf_names", "", f"SELECT 'certificate-name-mismatch' AS rule, 'e|' || name AS subject, 'MEDIUM' AS severity FROM {HOSTS} WHERE NOT (name LIKE '%.example.com' AND length(name) - length(replace(name, '.', '')) = 2)")
def surf_names(t):
    e = hosts(t).select(F.lit("e").alias("endpoint"), "name", F.lit("c").alias("cert"))
    names = t.region.where("r_regionkey = 0").select(F.lit("c").alias("cert"), F.lit("*.example.com").alias("pattern"))
    return surface.name_mismatch(e, names)


@query("surf_certs", "",
       """SELECT CASE WHEN us < n THEN 'expired-certificate' ELSE 'expiring-certificate' END AS rule, CAST(o_orderkey AS VARCHAR) AS subject, CASE WHEN us < n THEN 'HIGH' WHEN (us - n) // 86400000000 <= 7 THEN 'MEDIUM'
       ELSE 'LOW' END AS severity FROM (SELECT o_orderkey, epoch_us(o_orderdate) AS us, 915148800000000 AS n FROM orders) WHERE us < n OR (us - n) // 86400000000 <= 30""")
def surf_certs(t):
    c = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("not_after_us"))
    return surface.certificates(c, 915148800000000)


@query("surf_services", "",
       "SELECT 'exposed-sensitive-service' AS rule, CAST(p_partkey AS VARCHAR) AS subject, CASE p_size WHEN 23 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE p_size WHEN 21 THEN 'FTP' WHEN 22 THEN 'SSH' ELSE 'Telnet' END AS "
       "product FROM part WHERE p_size IN (21, 22, 23) AND p_type <> 'SMALL'")
def surf_services(t):
    return surface.exposed_services(t.part.select(F.col("p_partkey").cast("string").alias("service"), F.col("p_size").alias("port"), (F.col("p_type") != "SMALL").alias("internet")))


def surf_parts(t):
    """Some hosts and some networks have owners; services run on hosts, hosts lie in networks, networks in a region's organization."""
    hosts_owned = t.supplier.where("s_acctbal > 6000").select(F.concat(F.lit("host:s"), F.col("s_suppkey").cast("string")).alias("asset"), F.col("s_name").alias("owner"))
    nets_owned = t.nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("network:n"), F.col("n_nationkey").cast("string")).alias("asset"), F.col("n_name").alias("owner"))
    orgs_owned = t.region.where("r_regionkey = 1").select(F.concat(F.lit("organization:o"), F.col("r_regionkey").cast("string")).alias("asset"), F.col("r_name").alias("owner"))
    owners = hosts_owned.unionByName(nets_owned).unionByName(orgs_owned)
    lies_in = t.nation.select(F.concat(F.lit("network:n"), F.col("n_nationkey").cast("string")).alias("asset"), F.concat(F.lit("organization:o"), F.col("n_regionkey").cast("string")).alias("parent"))
    parents = t.rel.where("type = 'RUNS'").select(F.col("dst").alias("asset"), F.col("src").alias("parent")).unionByName(
        t.rel.where("type = 'MEMBER_OF' AND src LIKE 'host:%'").select(F.col("src").alias("asset"), F.col("dst").alias("parent"))).unionByName(lies_in)
    assets = t.obj.where("type IN ('host', 'service')").select(F.col("id").alias("asset"), (F.col("type") == "service").alias("internet"), "criticality")
    return assets, owners, parents


OWN = """(WITH ow AS (SELECT 'host:s' || s_suppkey AS id, s_name AS owner FROM supplier WHERE s_acctbal > 6000 UNION ALL SELECT 'network:n' || n_nationkey, n_name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
 SELECT 'organization:o' || r_regionkey, r_name FROM region WHERE r_regionkey = 1), up AS (SELECT dst AS id, src AS parent FROM rel WHERE type = 'RUNS' UNION ALL SELECT src, dst FROM rel WHERE type = 'MEMBER_OF' AND src LIKE 'host:%'
 UNION ALL SELECT 'network:n' || n_nationkey, 'organization:o' || n_regionkey FROM nation), l0 AS (SELECT id AS asset, id AS node, 0 AS hops FROM obj WHERE type IN ('host', 'service')),
 l1 AS (SELECT DISTINCT asset, parent AS node, 1 AS hops FROM l0 JOIN up ON up.id = node), l2 AS (SELECT DISTINCT asset, parent AS node, 2 AS hops FROM l1 JOIN up ON up.id = node),
 l3 AS (SELECT DISTINCT asset, parent AS node, 3 AS hops FROM l2 JOIN up ON up.id = node), best AS (SELECT asset, min({'h': hops, 'o': owner}) AS b FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2
 UNION ALL SELECT * FROM l3) l JOIN ow ON ow.id = l.node GROUP BY asset) SELECT a.id AS asset, a.type, a.criticality, b.o AS owner, CASE WHEN b.h = 0 THEN 'direct' WHEN b.h > 0 THEN 'inherited' ELSE '' END AS via, b.h AS hops
 FROM obj a LEFT JOIN best ON best.asset = a.id WHERE a.type IN ('host', 'service'))"""


@query("surface_owner", "obj rel", f"SELECT asset, coalesce(owner, '') AS owner, via, hops FROM {OWN}")
def surface_owner(t):
    o = surface.ownership(*surf_parts(t))
    return o.select("asset", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("via", F.lit("")).alias("via"), "hops")


@query("surf_unowned", "obj rel",
       f"SELECT 'unowned-asset' AS rule, asset AS subject, CASE (CASE type WHEN 'service' THEN 1 ELSE 0 END) + (CASE WHEN criticality IN ('high', 'critical') THEN 1 ELSE 0 END) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' "
       f"END AS severity FROM {OWN} WHERE owner IS NULL")
def surf_unowned(t):
    assets, owners, parents = surf_parts(t)
    return surface.unowned(assets, surface.ownership(assets, owners, parents))


@query("surf_shadow", "obj rel", "SELECT DISTINCT 'shadow-asset' AS rule, dst AS subject, 'MEDIUM' AS severity FROM rel WHERE type = 'RUNS' AND dst NOT IN (SELECT id FROM obj WHERE type = 'service' AND criticality <> 'low')")
def surf_shadow(t):
    found = t.rel.where("type = 'RUNS'").select(F.col("dst").alias("asset")).distinct()
    return surface.shadow(found, t.obj.where("type = 'service' AND criticality <> 'low'").select(F.col("id").alias("asset")))


@query("surf_storage", "",
       "SELECT 'public-cloud-storage' AS rule, CAST(c_custkey AS VARCHAR) AS subject, CASE (CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) + (CASE WHEN c_nationkey < 5 THEN 1 ELSE 0 END) WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' ELSE "
       "'CRITICAL' END AS severity FROM customer WHERE c_mktsegment = 'BUILDING'")
def surf_storage(t):
    b = t.customer.select(F.col("c_custkey").cast("string").alias("asset"), (F.col("c_mktsegment") == "BUILDING").alias("public"), (F.col("c_acctbal") > 5000).alias("sensitive"), (F.col("c_nationkey") < 5).alias("writable"))
    return surface.public_storage(b)


@query("surf_scope", "", f"""WITH fl AS (SELECT name FROM {HOSTS} WHERE name NOT LIKE '%.example.com'), hd AS (SELECT name, coalesce((SELECT min({{'n': length(p.name), 'p': p.name}}) FROM fl p WHERE fl.name LIKE '%.' || p.name).p, name) AS head FROM fl)
       SELECT 'out-of-scope-asset' AS rule, head AS subject, head || coalesce(',' || string_agg(name, ',' ORDER BY name) FILTER (name <> head), '') AS members FROM hd GROUP BY head""")
def surf_scope(t):
    """Names outside the scope, each group under its uppermost name."""
    scopes = t.region.where("r_regionkey = 0").select(F.lit("example.com").alias("suffix"))
    return surface.out_of_scope(hosts(t), scopes).withColumn("members", F.array_join("members", ","))
