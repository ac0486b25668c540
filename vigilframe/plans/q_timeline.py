"""Event filters, aggregations, windows, pages: one query per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import netaddr
from vigilframe.functions.folds import newest
from vigilframe.operators import timeline as tl
from vigilframe.operators.filters import EventFilter, edges_as_of, filter_findings, filter_objects
from vigilframe.plans.registry import query

JAN10, JAN20 = 1704844800000000, 1705708800000000
DAY_US = 86_400_000_000
HALF_DAY_US = DAY_US // 2


def _ids(df):
    return df.select("id")


# ---------------------------------------------------------------- filters


@query("flt_time", "ev", f"SELECT id FROM ev WHERE us BETWEEN {JAN10} AND {JAN20}")
def flt_time(t):
    return _ids(EventFilter(start_us=JAN10, end_us=JAN20).apply(t.ev))


@query("flt_time_strict", "ev",
       "SELECT id FROM ev WHERE us > (SELECT min(us) FROM ev) AND us < 1705708800000000")
def flt_time_strict(t):
    lo = t.ev.agg(F.min("us")).first()[0]
    return _ids(EventFilter().after(lo).before(JAN20).apply(t.ev)) if lo is not None else _ids(t.ev)


@query("flt_type", "ev",
       "SELECT id, event_type FROM ev WHERE event_type = 'auth' OR event_type LIKE 'auth.%' OR event_type = 'file.read'")
def flt_type(t):
    return EventFilter(event_types=("auth.*", "file.read")).apply(t.ev).select("id", "event_type")


@query("flt_category", "ev", "SELECT id FROM ev WHERE category IN ('http', 'network')")
def flt_category(t):
    return _ids(EventFilter(categories=("http", "network")).apply(t.ev))


@query("flt_objects", "ev eo",
       "SELECT id FROM ev WHERE id IN (SELECT event_id FROM eo WHERE object_id IN ('host:h3', 'host:h4')) "
       "AND id IN (SELECT event_id FROM eo WHERE object_id IN ('ip:198.51.100.3', 'user:u8', 'user:u5'))")
def flt_objects(t):
    f = EventFilter(object_groups=(("host:h3", "host:h4"), ("ip:198.51.100.3", "user:u8", "user:u5")))
    return _ids(f.apply(t.ev, t.eo))


@query("flt_equal", "ev", "SELECT id FROM ev WHERE target_id = 'host:h9' AND outcome = 'failure'")
def flt_equal(t):
    return _ids(EventFilter(target="host:h9").narrow(EventFilter(outcome="failure")).apply(t.ev))


@query("flt_incident", "ev inc",
       "SELECT id FROM ev WHERE id IN (SELECT event_id FROM inc WHERE incident_id = "
       "(SELECT min(incident_id) FROM inc))")
def flt_incident(t):
    first = t.inc.agg(F.min("incident_id")).first()[0]
    return _ids(EventFilter(incident_id=first or "").apply(t.ev, t.eo, t.inc))


@query("flt_severity", "ev", "SELECT id, severity FROM ev WHERE severity IN ('LOW', 'MEDIUM')")
def flt_severity(t):
    return EventFilter(min_severity="LOW", max_severity="MEDIUM").apply(t.ev).select("id", "severity")


@query("flt_confidence", "ev", "SELECT id FROM ev WHERE confidence > 0.6 AND confidence <= 0.8")
def flt_confidence(t):
    return _ids(EventFilter(min_confidence=0.6 + 1e-6, max_confidence=0.8).apply(t.ev))


@query("flt_source", "ev", "SELECT id FROM ev WHERE source ILIKE '%RC3%'")
def flt_source(t):
    return _ids(EventFilter(source="RC3").apply(t.ev))


@query("flt_text", "ev",
       "SELECT id FROM ev WHERE (lower(message) LIKE '%on h7%' OR lower(event_type) LIKE '%on h7%' OR "
       "lower(actor_id) LIKE '%on h7%' OR lower(target_id) LIKE '%on h7%') AND (lower(message) LIKE '%auth%' OR "
       "lower(event_type) LIKE '%auth%' OR lower(actor_id) LIKE '%auth%' OR lower(target_id) LIKE '%auth%')")
def flt_text(t):
    return _ids(EventFilter(texts=("On H7", "AUTH")).apply(t.ev))


@query("flt_narrow", "ev",
       f"SELECT id FROM ev WHERE us BETWEEN {JAN10} AND {JAN20} AND event_type = 'auth.failure' AND severity_rank >= 2")
def flt_narrow(t):
    scope = EventFilter(start_us=JAN10, event_types=("auth",), min_severity="LOW")
    wanted = EventFilter(end_us=JAN20, event_types=("auth.failure", "file"), min_severity="MEDIUM")
    return _ids(scope.narrow(wanted).apply(t.ev))


@query("flt_contradiction", "ev", "SELECT id FROM ev WHERE 1 = 0")
def flt_contradiction(t):
    return _ids(EventFilter(actor="user:u1").narrow(EventFilter(actor="user:u2")).apply(t.ev))


AS_OF = 915148800000000  # 1999-01-01


@query("edges_as_of", "rel",
       f"SELECT src, type, dst FROM rel WHERE (first_us IS NULL OR first_us <= {AS_OF}) "
       f"AND (to_us IS NULL OR to_us > {AS_OF})")
def q_edges_as_of(t):
    return edges_as_of(t.rel, AS_OF).select("src", "type", "dst")


@query("edges_open", "rel", "SELECT type, count(*) AS n FROM rel WHERE to_us IS NULL GROUP BY type")
def q_edges_open(t):
    return edges_as_of(t.rel).groupBy("type").agg(F.count("*").alias("n"))


@query("flt_objects_list", "obj",
       "SELECT id, name FROM obj WHERE type IN ('host', 'service') AND tag = 'promo' "
       "AND (lower(name) LIKE '%ring%' OR lower(id) LIKE '%ring%')")
def flt_objects_list(t):
    objects = t.obj.withColumn("tags", F.array("tag"))
    return filter_objects(objects, types=["host", "service"], tag="promo", text="RING").select("id", "name")


FINDINGS_SQL = """SELECT concat('finding:detect:auth:', substr(actor_id, 6)) AS id, 'detect' AS product,
 'auth' AS rule_id, concat('Failures of ', actor_id) AS title, max(severity_rank) AS severity_rank,
 round(CAST(sum(k % 50) AS DOUBLE) / count(*) / 100 + 0.5, 4) AS confidence, actor_id
 FROM ev WHERE event_type = 'auth.failure' GROUP BY actor_id"""


def findings(t):
    """One finding per user with failures."""
    f = t.ev.where("event_type = 'auth.failure'").groupBy("actor_id").agg(
        F.max("severity_rank").alias("severity_rank"),
        F.round(F.sum(F.col("k") % 50).cast("double") / F.count("*") / 100 + 0.5, 4).alias("confidence"),
    )
    return f.select(
        F.concat(F.lit("finding:detect:auth:"), F.expr("substr(actor_id, 6)")).alias("id"),
        F.lit("detect").alias("product"), F.lit("auth").alias("rule_id"),
        F.concat(F.lit("Failures of "), "actor_id").alias("title"), "severity_rank", "confidence",
        F.when(F.col("severity_rank") == 3, "OPEN").otherwise("RESOLVED").alias("status"),
        F.array("actor_id").alias("affected"), "actor_id",
    )


@query("flt_findings", "ev",
       f"SELECT id, severity_rank, confidence FROM ({FINDINGS_SQL}) WHERE severity_rank >= 3 AND lower(title) LIKE '%u1%'")
def flt_findings(t):
    f = filter_findings(findings(t), product="detect", min_severity="HIGH", statuses=["OPEN"], text="U1")
    return f.select("id", "severity_rank", "confidence")


@query("flt_findings_object", "ev", f"SELECT id, severity_rank FROM ({FINDINGS_SQL}) WHERE actor_id = 'user:u8'")
def flt_findings_object(t):
    return filter_findings(findings(t), object_id="user:u8", rule_id="auth").select("id", "severity_rank")


@query("finding_severity", "ev",
       "SELECT s.severity, count(f.id) AS n FROM (VALUES ('INFO', 0), ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), "
       f"('CRITICAL', 4)) s(severity, r) LEFT JOIN ({FINDINGS_SQL}) f ON f.severity_rank = s.r GROUP BY s.severity")
def finding_severity(t):
    from vigilframe.operators.lifecycle import count_by_severity

    return count_by_severity(findings(t))


@query("ip_scope", "ev",
       """SELECT scope, count(*) AS n FROM (SELECT CASE WHEN src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' THEN 'internal'
       ELSE 'public' END AS scope FROM ev) GROUP BY scope""")
def q_ip_scope(t):
    return t.ev.groupBy(netaddr.ip_scope(F.col("src_ip")).alias("scope")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- aggregations


@query("event_count", "ev", "SELECT count(*) AS n FROM ev WHERE event_type LIKE 'auth.%'")
def event_count(t):
    return EventFilter(event_types=("auth",)).apply(t.ev).agg(F.count("*").alias("n"))


@query("event_bounds", "ev", "SELECT min(us) AS first_us, max(us) AS last_us FROM ev WHERE category = 'file'")
def event_bounds(t):
    return tl.bounds(EventFilter(categories=("file",)).apply(t.ev))


@query("group_counts", "ev",
       "SELECT target_id AS key, count(*) AS n FROM ev GROUP BY target_id ORDER BY n DESC, key LIMIT 10")
def q_group_counts(t):
    return tl.group_counts(t.ev, "target_id", 10)


HIST_SQL = """WITH s AS (SELECT us FROM ev WHERE event_type = 'auth.failure'),
 b AS (SELECT min(us) AS lo, greatest(max(us) - min(us), 1000000) AS span FROM s),
 w AS (SELECT lo, span, greatest((span + {n} - 1) // {n}, 1000000) AS width FROM b),
 g AS (SELECT lo, width, unnest(generate_series(0, span // width)) AS bucket FROM w)
 SELECT g.bucket AS bucket, g.lo + g.bucket * g.width AS start_us,
 (SELECT count(*) FROM s WHERE (s.us - g.lo) // g.width = g.bucket) AS n FROM g"""


@query("histogram", "ev", HIST_SQL.format(n=60))
def q_histogram(t):
    return tl.histogram(EventFilter(event_types=("auth.failure",)).apply(t.ev), 60)


@query("object_counts", "eo",
       "SELECT object_id, count(DISTINCT event_id) AS n FROM eo GROUP BY object_id ORDER BY n DESC, object_id LIMIT 2000")
def q_object_counts(t):
    return tl.object_counts(t.eo)


@query("object_activity", "eo",
       "SELECT object_id, min(us) AS first_us, max(us) AS last_us, count(DISTINCT event_id) AS n FROM eo GROUP BY object_id")
def q_object_activity(t):
    return tl.object_activity(t.eo)


@query("type_counts", "obj rel",
       "SELECT 'object' AS kind, type, count(*) AS n FROM obj GROUP BY type UNION ALL "
       "SELECT 'relationship', type, count(*) FROM rel GROUP BY type")
def type_counts(t):
    o = t.obj.groupBy("type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("object"))
    r = t.rel.groupBy("type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("relationship"))
    return o.unionByName(r)


@query("incident_stats", "inc",
       "SELECT incident_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM inc GROUP BY incident_id")
def incident_stats(t):
    return t.inc.groupBy("incident_id").agg(
        F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


@query("rel_directions", "rel",
       "SELECT type, 'out' AS direction, count(*) AS n FROM rel WHERE src = 'host:s1' GROUP BY type UNION ALL "
       "SELECT type, 'in', count(*) FROM rel WHERE dst = 'host:s1' AND src <> 'host:s1' GROUP BY type")
def rel_directions(t):
    me = F.lit("host:s1")
    return (
        t.rel.where((F.col("src") == me) | (F.col("dst") == me))
        .groupBy("type", F.when(F.col("src") == me, "out").otherwise("in").alias("direction"))
        .agg(F.count("*").alias("n"))
    )


@query("involved_types", "ev eo",
       "SELECT split_part(object_id, ':', 1) AS type, count(DISTINCT object_id) AS objects FROM eo WHERE event_id IN "
       "(SELECT id FROM ev WHERE event_type = 'auth.failure') GROUP BY 1")
def involved_types(t):
    ids = t.ev.where("event_type = 'auth.failure'").select(F.col("id").alias("event_id"))
    return tl.object_counts(t.eo, ids, None).groupBy(F.substring_index("object_id", ":", 1).alias("type")).agg(
        F.count("*").alias("objects")
    )


@query("degree_rank", "rel",
       "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM rel UNION ALL SELECT dst FROM rel) "
       "GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def degree_rank(t):
    from vigilframe.operators.graph import degree_ranking

    return degree_ranking(t.rel, 10)


@query("object_window", "eo",
       "SELECT min(f) AS first_us, max(l) AS last_us, count(*) AS objects FROM (SELECT object_id, min(us) AS f, "
       "max(us) AS l FROM eo GROUP BY object_id)")
def object_window(t):
    return tl.object_activity(t.eo).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.count("*").alias("objects")
    )


@query("timeline", "ev",
       "WITH s AS (SELECT * FROM ev WHERE target_id = 'host:h5') "
       "SELECT 'total' AS part, 'events' AS key, count(*) AS n FROM s UNION ALL "
       "SELECT 'bounds', 'first', min(us) FROM s UNION ALL SELECT 'bounds', 'last', max(us) FROM s UNION ALL "
       "SELECT 'group', event_type, count(*) FROM s GROUP BY event_type UNION ALL "
       "SELECT 'page', id, us FROM (SELECT id, us FROM s ORDER BY us, id LIMIT 100)")
def q_timeline(t):
    selection = EventFilter(object_groups=(("host:h5",),)).apply(t.ev, t.eo)
    parts = tl.timeline(selection, t.eo, t.inc, 100)
    b = parts["bounds"]
    rows = [
        parts["total"].select(F.lit("total").alias("part"), F.lit("events").alias("key"), "n"),
        b.select(F.lit("bounds").alias("part"), F.lit("first").alias("key"), F.col("first_us").alias("n")),
        b.select(F.lit("bounds").alias("part"), F.lit("last").alias("key"), F.col("last_us").alias("n")),
        parts["groups"].select(F.lit("group").alias("part"), "key", "n"),
        parts["page"].select(F.lit("page").alias("part"), F.col("id").alias("key"), F.col("us").alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("events_with_objects", "ev eo inc",
       "SELECT e.id, o.objects, coalesce(i.incidents, '') AS incidents FROM (SELECT * FROM ev ORDER BY us, id LIMIT 50) e "
       "LEFT JOIN (SELECT event_id, string_agg(role || '=' || object_id, ',' ORDER BY role, object_id) AS objects FROM eo "
       "GROUP BY event_id) o ON o.event_id = e.id LEFT JOIN (SELECT event_id, string_agg(incident_id, ',' ORDER BY "
       "incident_id) AS incidents FROM inc GROUP BY event_id) i ON i.event_id = e.id")
def events_with_objects(t):
    d = tl.with_involvement(tl.page(t.ev, 50), t.eo, t.inc)
    text = F.array_join(F.transform("objects", lambda o: F.concat(o["role"], F.lit("="), o["object_id"])), ",")
    return d.select("id", text.alias("objects"), F.coalesce(F.array_join("incidents", ","), F.lit("")).alias("incidents"))


# ---------------------------------------------------------------- windows


@query("max_window", "ev",
       f"""WITH f AS (SELECT actor_id, us, count(*) OVER (PARTITION BY actor_id ORDER BY us RANGE BETWEEN {DAY_US}
       PRECEDING AND CURRENT ROW) AS n, min(us) OVER (PARTITION BY actor_id ORDER BY us RANGE BETWEEN {DAY_US} PRECEDING
       AND CURRENT ROW) AS start_us FROM ev WHERE event_type = 'auth.failure')
       SELECT actor_id, n, start_us, us AS end_us FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY n DESC,
       us) AS rn FROM f) WHERE rn = 1""")
def q_max_window(t):
    f = t.ev.where("event_type = 'auth.failure'")
    return tl.max_window(f, ["actor_id"], DAY_US).select("actor_id", "n", "start_us", "end_us")


@query("baseline_median", "ev",
       f"""WITH c AS (SELECT actor_id, us // {HALF_DAY_US} AS b, count(*) AS c FROM ev WHERE event_type = 'auth.failure'
       GROUP BY 1, 2), r AS (SELECT actor_id, unnest(generate_series(min(b), max(b))) AS b FROM c GROUP BY actor_id)
       SELECT r.actor_id, CAST(quantile_cont(coalesce(c.c, 0), 0.5) AS DOUBLE) AS median FROM r LEFT JOIN c
       ON c.actor_id = r.actor_id AND c.b = r.b GROUP BY r.actor_id""")
def baseline_median(t):
    return tl.bucket_median_with_zeros(t.ev.where("event_type = 'auth.failure'"), ["actor_id"], HALF_DAY_US)


@query("p90_disc", "ev",
       """SELECT event_type, bytes FROM (SELECT event_type, bytes, row_number() OVER (PARTITION BY event_type ORDER BY bytes)
       - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev) WHERE i = least(n - 1, CAST(floor(n * 0.9) AS BIGINT))""")
def p90_disc(t):
    return tl.order_statistic(t.ev, ["event_type"], "bytes", 0.9)


@query("first_seen_source", "ev",
       """SELECT actor_id, src_ip, id, us, earlier FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY us, id)
       - 1 AS earlier, row_number() OVER (PARTITION BY actor_id, src_ip ORDER BY us, id) AS use_no FROM ev
       WHERE event_type = 'auth.login') WHERE use_no = 1 AND earlier >= 3""")
def q_first_seen_source(t):
    return tl.first_seen_source(t.ev.where("event_type = 'auth.login'"))


@query("collapse_runs", "ev",
       """WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM ev
       WINDOW w AS (PARTITION BY target_id ORDER BY us, id)),
       r AS (SELECT *, sum(new) OVER (PARTITION BY target_id ORDER BY us, id) AS run FROM s)
       SELECT target_id, event_type, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM r
       GROUP BY target_id, run, event_type""")
def q_collapse_runs(t):
    return tl.collapse_runs(t.ev, ["target_id"], ["event_type"])


@query("latest_state", "ev",
       f"""SELECT actor_id, target_id, event_type, severity FROM (SELECT *, row_number() OVER (PARTITION BY actor_id, target_id
       ORDER BY us DESC, id DESC) AS rn FROM ev WHERE us <= {JAN20}) WHERE rn = 1""")
def q_latest_state(t):
    return tl.latest_state(t.ev, ["actor_id", "target_id"], ["event_type", "severity"], JAN20)


@query("nearest_n", "ev",
       f"""SELECT target_id, event_type, id, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id, event_type
       ORDER BY us DESC, id DESC) AS INT) AS rn FROM ev WHERE us <= {JAN20}) WHERE rn <= 5""")
def nearest_n(t):
    before = t.ev.where(F.col("us") <= JAN20)
    return tl.first_n_per_key(before, ["target_id", "event_type"], [F.desc("us"), F.desc("id")], 5).select(
        "target_id", "event_type", "id", "rn"
    )


# ---------------------------------------------------------------- pages, top-k


@query("page_asc", "ev",
       "SELECT id, us, (SELECT count(*) FROM ev WHERE (us, id) > (1704844800000000, 'event:000000000003')) > 25 AS more "
       "FROM ev WHERE us > 1704844800000000 OR (us = 1704844800000000 AND id > 'event:000000000003') ORDER BY us, id LIMIT 25")
def page_asc(t):
    return tl.page(t.ev, 25, (JAN10, "event:000000000003")).select("id", "us", "more")


@query("page_desc", "ev",
       "SELECT id, us FROM ev WHERE (us < 1704844800000000 OR (us = 1704844800000000 AND id < 'event:000000000003')) "
       "AND category = 'auth' ORDER BY us DESC, id DESC LIMIT 25")
def page_desc(t):
    return tl.page(EventFilter(categories=("auth",)).apply(t.ev), 25, (JAN10, "event:000000000003"), True).select("id", "us")


@query("ordered_scan", "ev", "SELECT id, us, event_type FROM ev ORDER BY us, id")
def ordered_scan(t):
    return t.ev.select("id", "us", "event_type").orderBy("us", "id")


@query("key_event", "ev inc",
       """SELECT incident_id, id FROM (SELECT i.incident_id, e.id, row_number() OVER (PARTITION BY i.incident_id ORDER BY
       e.severity_rank DESC, e.us DESC, e.id DESC) AS rn FROM inc i JOIN ev e ON e.id = i.event_id) WHERE rn = 1""")
def key_event(t):
    j = t.inc.select("incident_id", F.col("event_id").alias("id")).join(t.ev.select("id", "us", "severity_rank"), "id")
    return j.groupBy("incident_id").agg(
        newest(F.col("id"), F.col("severity_rank"), F.col("us"), F.col("id")).alias("id")
    )


@query("significant_events", "ev inc",
       """SELECT incident_id, id, severity, CAST(rn AS INT) AS rn FROM (SELECT i.incident_id, e.id, e.severity, row_number()
       OVER (PARTITION BY i.incident_id ORDER BY e.severity_rank DESC, e.us, e.id) AS rn FROM inc i JOIN ev e
       ON e.id = i.event_id) WHERE rn <= 3""")
def significant_events(t):
    j = t.inc.select("incident_id", F.col("event_id").alias("id")).join(
        t.ev.select("id", "us", "severity", "severity_rank"), "id")
    return tl.first_n_per_key(j, ["incident_id"], [F.desc("severity_rank"), F.asc("us"), F.asc("id")], 3).select(
        "incident_id", "id", "severity", "rn"
    )


# ---------------------------------------------------------------- set operations


@query("union_sources", "ev",
       "SELECT family, count(*) AS n, count(bytes) AS with_bytes FROM (SELECT 'auth' AS family, NULL AS bytes FROM ev WHERE "
       "category = 'auth' UNION ALL SELECT 'flow', bytes FROM ev WHERE category = 'network') GROUP BY family")
def union_sources(t):
    auth = t.ev.where("category = 'auth'").select(F.lit("auth").alias("family"), "actor_id", "outcome")
    flow = t.ev.where("category = 'network'").select(F.lit("flow").alias("family"), "src_ip", "bytes")
    return auth.unionByName(flow, allowMissingColumns=True).groupBy("family").agg(
        F.count("*").alias("n"), F.count("bytes").alias("with_bytes")
    )


@query("state_keys", "ev",
       f"""WITH a AS (SELECT DISTINCT actor_id, target_id FROM ev WHERE us < {JAN10}), b AS (SELECT DISTINCT actor_id,
       target_id FROM ev WHERE us >= {JAN20}) SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.actor_id IS NULL THEN
       'added' WHEN b.actor_id IS NULL THEN 'removed' ELSE 'common' END AS status FROM a FULL OUTER JOIN b
       ON a.actor_id = b.actor_id AND a.target_id = b.target_id) GROUP BY status""")
def state_keys(t):
    from vigilframe.operators.lifecycle import compare_keys

    a = t.ev.where(F.col("us") < JAN10).select("actor_id", "target_id").distinct()
    b = t.ev.where(F.col("us") >= JAN20).select("actor_id", "target_id").distinct()
    return compare_keys(a, b, ["actor_id", "target_id"]).groupBy("status").agg(F.count("*").alias("n"))


LIFE_SQL = f"""WITH old AS (SELECT concat('f:', actor_id) AS id, CASE max(severity_rank) WHEN 1 THEN 'FALSE_POSITIVE'
 WHEN 2 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM ev WHERE event_type = 'auth.failure' AND us < {JAN10} GROUP BY actor_id),
 new AS (SELECT DISTINCT concat('f:', actor_id) AS id FROM ev WHERE event_type = 'auth.failure' AND us >= {JAN20}
 AND severity_rank >= 2)
 SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'OPEN' WHEN new.id IS NOT NULL THEN CASE WHEN
 old.status IN ('ACKNOWLEDGED', 'FALSE_POSITIVE', 'SUPPRESSED') THEN old.status ELSE 'OPEN' END WHEN old.status = 'OPEN'
 THEN 'RESOLVED' ELSE old.status END AS status, CASE WHEN old.id IS NULL THEN 'created' WHEN new.id IS NOT NULL THEN CASE WHEN
 old.status = 'RESOLVED' THEN 'reopened' ELSE 'updated' END WHEN old.status = 'OPEN' THEN 'resolved' ELSE 'kept' END AS change
 FROM old FULL OUTER JOIN new ON old.id = new.id"""


@query("finding_lifecycle", "ev", LIFE_SQL)
def finding_lifecycle(t):
    from vigilframe.operators.lifecycle import transition

    f = t.ev.where("event_type = 'auth.failure'")
    ident = F.concat(F.lit("f:"), "actor_id").alias("id")
    rank = F.max("severity_rank")
    old = f.where(F.col("us") < JAN10).groupBy(ident).agg(
        F.when(rank == 1, "FALSE_POSITIVE").when(rank == 2, "RESOLVED").otherwise("OPEN").alias("status")
    )
    new = f.where((F.col("us") >= JAN20) & (F.col("severity_rank") >= 2)).select(ident).distinct()
    return transition(old, new).select("id", "status", "change")
