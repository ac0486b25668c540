"""Detection rules over events; each returns (rule, subject, severity, n, start_us, end_us).

Thresholds are parameters. Counting in sliding windows is done in time blocks, baselines and order statistics on
distributions, so no rule gathers the events of one actor or address in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import netaddr
from vigilframe.functions.levels import severity_name, severity_rank
from vigilframe.functions.text import sql_risks
from vigilframe.operators.graph import connected_components
from vigilframe.operators.search import containing
from vigilframe.operators.timeline import first_seen_source, latest_before, max_window, order_statistic

MINUTE_US, HOUR_US, DAY_US = 60_000_000, 3_600_000_000, 86_400_000_000
MB = 1_000_000
EVIDENCE = 40

# Paths scanners ask for, files that carry data, API and command families.
PROBE_PATH = (
    r"(?i)(?:^|/)(?:wp-admin|wp-login\.php|xmlrpc\.php|phpmyadmin|pma|adminer(?:\.php)?|\.git(?:/|$)|\.svn|\.hg|\.env(?:\.\w+)?$|\.aws|\.ssh|"
    r"actuator(?:/|$)|server-status|server-info|\.ds_store|config\.php|setup\.php|cgi-bin|boaform|hnap1|vendor/phpunit|solr/|jenkins|"
    r"manager/html|console(?:/|$)|\.well-known/security|id_rsa|backup(?:\.\w+)?$|dump\.sql|db\.sql|web\.config|owa/|autodiscover|telescope|"
    r"_profiler|debug/)"
)
ARTIFACT_PATH = (
    r"(?i)(?:\.(?:zip|tar|tgz|tar\.gz|gz|bz2|xz|7z|rar|bak|sql|dump|db|sqlite|env|pem|key|pfx|p12|kdbx|jks|log)$|"
    r"(?:^|/)(?:backups?|dumps?|exports?|diagnostics?|support-bundles?|artifacts?|debug|snapshots?)(?:/|$))"
)
SERVICE_IDENTITY = r"(?i)(?:^|[-_.:/])(?:svc|service|bot|ci|cd|deploy|pipeline|automation|robot|app)(?:$|[-_.:/])"
PERSISTENCE_APIS = [
    "CreateAccessKey", "CreateLoginProfile", "UpdateLoginProfile", "CreateUser", "AttachUserPolicy", "AttachRolePolicy", "AttachGroupPolicy",
    "PutUserPolicy", "PutRolePolicy", "PutGroupPolicy", "AddUserToGroup", "CreateRole", "UpdateAssumeRolePolicy",
    "CreateServiceSpecificCredential", "CreateServiceAccountKey", "SetIamPolicy",
]
TAMPER_APIS = [
    "StopLogging", "DeleteTrail", "UpdateTrail", "PutEventSelectors", "DeleteFlowLogs", "DeleteDetector", "DisableSecurityHub",
    "DeleteConfigurationRecorder", "StopConfigurationRecorder", "DisableAlarmActions",
]
CREDENTIAL_FILE = r"(?i)(?:\.env|id_(?:rsa|ed25519|ecdsa)|\.aws/credentials|\.git-credentials|\.pgpass|\.netrc|kubeconfig|\.kdbx|\.pem|\.key|/etc/shadow)$"
COMMANDS: dict[str, tuple[str, str]] = {
    "reverse shell": ("HIGH", r"(?i)/dev/tcp/|\bnc(?:at)?\b[^|]*\s-e\s|bash\s+-i\s*>&|\bsh\s+-i\b.*>&|socat\b.*exec:|python\d?\s+-c\s+.*socket.*connect"),
    "download and execute": ("HIGH", r"(?i)(?:curl|wget)\b[^|;]*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b|downloadstring\s*\(|iex\s*\(\s*new-object|invoke-expression.*(?:http|downloadstring)|certutil(?:\.exe)?\s+.*-urlcache|bitsadmin(?:\.exe)?\s+/transfer|mshta(?:\.exe)?\s+https?:|regsvr32(?:\.exe)?\s+/s\s+/n\s+/u\s+/i:https?"),
    "credential dumping": ("HIGH", r"(?i)mimikatz|sekurlsa|lsass(?:\.exe)?.*(?:dump|minidump)|procdump.*lsass|comsvcs\.dll.*minidump|reg(?:\.exe)?\s+save\s+hklm\\\\?(?:sam|system|security)|ntdsutil.*ifm|/etc/shadow"),
    "defense evasion": ("HIGH", r"(?i)history\s+-c\b|unset\s+histfile|wevtutil(?:\.exe)?\s+cl\b|clear-eventlog|auditctl\s+-D\b|setenforce\s+0|set-mppreference\s+.*-disable|systemctl\s+(?:stop|disable)\s+(?:auditd|falcon|wazuh)|iptables\s+-F\b"),
    "data upload": ("MEDIUM", r"(?i)\bcurl\b[^|;]*(?:\s-T\s|--upload-file|\s-F\s+\S*@|--data-binary\s+@|\s-d\s+@)|\bwget\b[^|;]*--post-file|\brclone\b\s+(?:copy|sync)\b|\bscp\b\s+\S+\s+\S+@[\w.-]+:"),
    "database export": ("MEDIUM", r"(?i)\bcopy\b.+\bto\s+'|\bpg_dump(?:all)?\b|\bmysqldump\b|\bmongodump\b|\binto\s+outfile\b|\bbcp\b.+\bout\b|\bexpdp\b"),
    "credential discovery": ("MEDIUM", r"(?i)\bfind\b.*-i?name\s+['\"]?\*?\.?(?:env|pem|key|kdbx|ovpn|ppk)\b|\bgrep\b.*-[a-z]*r[a-z]*\b.*\b(?:password|passwd|secret|token|api[_-]?key)\b|\b(?:cat|less|more|head|tail|type|get-content)\b\s+\S*(?:\.env\b|id_(?:rsa|ed25519|ecdsa)\b|\.aws/credentials|\.git-credentials|\.pgpass|\.netrc|kubeconfig)"),
    "control bypass": ("MEDIUM", r"(?i)--(?:skip|no|bypass)[-_](?:review|verify|approval|checks?|tests?|gates?|signing)\b|--force[-_]deploy\b"),
    "encoded PowerShell": ("MEDIUM", r"(?i)powershell(?:\.exe)?\b.*\s-(?:e|en|enc|encodedcommand)\s+[A-Za-z0-9+/=]{16,}"),
    "persistence": ("MEDIUM", r"(?i)schtasks(?:\.exe)?\s+/create|reg(?:\.exe)?\s+add\s+.*\\\\currentversion\\\\run|crontab\s+-[lr]?\s*<|>>\s*/etc/crontab|authorized_keys"),
}
ROUTINE_WHEN_SCHEDULED = ["database export", "data upload"]


def _out(rows: DataFrame, rule: str, subject: Column, severity: Column, n: str = "n") -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), subject.alias("subject"), severity.alias("severity"), F.col(n).cast("long").alias("n"),
                       "start_us", "end_us")


def public(address: Column) -> Column:
    return F.coalesce(netaddr.ip_scope(address) == "public", F.lit(False))


def web_recon(http: DataFrame, probes: int = 5, window_us: int = 15 * MINUTE_US, errors: int = 30, share: float = 0.7, paths: int = 10,
              bucket_us: int = 15 * MINUTE_US) -> DataFrame:
    """Many sensitive paths from one address, or a bucket of mostly client errors over many paths."""
    p = max_window(http.where(F.col("path").rlike(PROBE_PATH)), ["src_ip"], window_us).where(F.col("n") >= probes)
    probe = _out(p, "web-recon", F.concat(F.col("src_ip"), F.lit("|probe")), F.when(public(F.col("src_ip")), "MEDIUM").otherwise("LOW"))
    err = F.col("status").between(400, 499)
    per_path = http.groupBy("src_ip", F.expr(f"us div {bucket_us}").alias("b"), "path").agg(
        F.count("*").alias("c"), F.count_if(err).alias("e"), F.min("us").alias("a"), F.max("us").alias("z"))
    b = per_path.groupBy("src_ip", "b").agg(
        F.sum("c").alias("total"), F.sum("e").alias("n"), F.count_if(F.col("e") > 0).alias("paths"), F.min("a").alias("start_us"), F.max("z").alias("end_us"))
    b = b.where((F.col("n") >= errors) & (F.col("n") >= share * F.col("total")) & (F.col("paths") >= paths))
    scan = _out(b, "web-recon", F.concat(F.col("src_ip"), F.lit("|errors|"), F.col("b").cast("string")), F.lit("LOW"))
    return probe.unionByName(scan)


def exposed_artifacts(http: DataFrame) -> DataFrame:
    """Archives and dumps served to public addresses; records of one download are merged by request id first."""
    hit = http.where(F.col("path").rlike(ARTIFACT_PATH) & F.col("status").between(200, 299) & public(F.col("src_ip")))
    request = F.coalesce("request_id", "id") if "request_id" in http.columns else F.col("id")
    one = hit.groupBy(request.alias("r")).agg(F.min("path").alias("path"), F.min("src_ip").alias("src_ip"), F.min("us").alias("us"), F.max("us").alias("z"))
    g = one.groupBy("path", "src_ip").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("z").alias("end_us"))
    return _out(g, "exposed-artifact", F.concat_ws("|", "path", "src_ip"), F.lit("HIGH"))


def artifact_manifest(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifest entries of an artifact by request id, else by the trailing parts of its path (an equi join on suffixes)."""
    by_request = artifacts.join(manifests.where("request_id IS NOT NULL").select("request_id", "entry"), "request_id").select("path", "entry")
    parts = F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    spread = artifacts.select("path", F.explode(F.array_distinct(suffix)).alias("name"))
    by_name = spread.join(manifests.where("name IS NOT NULL").select("name", "entry"), "name").select("path", "entry")
    return by_request.unionByName(by_name).distinct()


def flagged_addresses(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(F.substring_index("subject", "|", -1).alias("src_ip")).distinct()


def cloud_credentials(calls: DataFrame, flagged: DataFrame, baseline: int = 20, internal_share: float = 0.8) -> DataFrame:
    """Credentials used from a public address although almost all calls are internal, or by a service identity, or from a flagged address."""
    inside = netaddr.ip_scope(F.col("src_ip")) == "internal"
    base = calls.agg(F.count("*").alias("c"), F.count_if(inside).alias("i"))
    mostly = (base.select((F.col("c") >= baseline) & (F.col("i") >= internal_share * F.col("c")))).scalar()
    g = calls.where(public(F.col("src_ip"))).groupBy("actor_id", "src_ip").agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    g = g.join(flagged.withColumn("flag", F.lit(True)), "src_ip", "left")
    why = mostly | F.col("actor_id").rlike(SERVICE_IDENTITY) | F.coalesce("flag", F.lit(False))
    return _out(g.where(why), "cloud-credential-public", F.concat_ws("|", "actor_id", "src_ip"),
                F.when(F.coalesce("flag", F.lit(False)), "CRITICAL").otherwise("HIGH"))


def bulk_storage_read(reads: DataFrame, objects: int = 5, size: int = 100 * MB) -> DataFrame:
    """Many objects or bytes of one bucket read by one actor from one address; bytes count once per request."""
    per = reads.groupBy("actor_id", "bucket", "src_ip", "path").agg(
        F.max("bytes").alias("bytes"), F.min("us").alias("a"), F.max("us").alias("z"))
    g = per.groupBy("actor_id", "bucket", "src_ip").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("total"), F.min("a").alias("start_us"), F.max("z").alias("end_us"))
    g = g.where((F.col("n") >= objects) | (F.col("total") >= size))
    return _out(g, "bulk-storage-read", F.concat_ws("|", "actor_id", "bucket", "src_ip"), F.when(public(F.col("src_ip")), "HIGH").otherwise("MEDIUM"))


def cloud_persistence(calls: DataFrame, flagged_actors: DataFrame) -> DataFrame:
    """Credentials or grants created by a public, flagged, service or refused caller."""
    c = calls.where(F.col("api").isin(PERSISTENCE_APIS)).join(flagged_actors.select("actor_id").distinct().withColumn("flag", F.lit(True)), "actor_id", "left")
    why = public(F.col("src_ip")) | F.coalesce("flag", F.lit(False)) | F.col("actor_id").rlike(SERVICE_IDENTITY) | (F.col("outcome") == "failure")
    g = c.where(why).groupBy("actor_id", "api").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return _out(g, "cloud-persistence", F.concat_ws("|", "actor_id", "api"), F.lit("HIGH"))


def transfer_threshold(flows: DataFrame) -> DataFrame:
    """One row: the size above which a transfer stands out."""
    n = flows.agg(F.count("*").alias("n"))
    p90 = order_statistic(flows.select(F.lit(0).alias("all"), "bytes"), ["all"], "bytes", 0.9).select("bytes")
    value = F.when(F.col("n") >= 30, F.greatest(F.lit(10 * MB), 20 * F.coalesce(p90.scalar(), F.lit(0)))).otherwise(F.lit(100 * MB))
    return n.select(value.cast("long").alias("threshold"))


def scheduled_context(events: DataFrame, jobs: DataFrame, writes: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Events (id, host, us, bytes) with the nearest scheduled job of their host in the hour before, and whether a file of about
    the same size was written between. Writes are met by host, hour and power of two of the size."""
    hour = F.expr(f"us div {HOUR_US}")
    known = latest_before(events.select("id", "host", "us", "bytes"), jobs.select("host", "us", F.col("id").alias("job_id")), ["host"], ["job_id"], HOUR_US)
    near = known.select("id", "host", "us", "bytes", F.col("latest.us").alias("job_us"), F.col("latest.job_id").alias("job_id"))

    def power(size):
        return F.floor(F.log2(F.greatest(size.cast("double"), F.lit(1.0)))).cast("int")

    sizes = F.sequence(power(F.col("bytes") * (1 - tolerance)), power(F.col("bytes") * (1 + tolerance)))
    w = writes.select("host", F.col("us").alias("w_us"), F.col("bytes").alias("w_bytes")).withColumn("h", F.expr(f"w_us div {HOUR_US}")).withColumn("power", power(F.col("w_bytes")))
    spread = near.withColumn("h", F.explode(F.array(hour, hour - 1))).withColumn("power", F.explode(sizes))
    fits = spread.join(w, ["host", "h", "power"]).where((F.col("w_us") >= F.col("job_us")) & (F.col("w_us") <= F.col("us")) & (
        F.abs(F.col("w_bytes") - F.col("bytes")) <= tolerance * F.col("bytes"))).select("id").distinct().withColumn("file", F.lit(True))
    return near.join(fits, "id", "left").select("id", "job_id", "job_us", F.coalesce("file", F.lit(False)).alias("file_written"))


def large_transfers(flows: DataFrame, explained: DataFrame | None = None) -> DataFrame:
    """Transfers above the threshold of this network, without those a schedule explains."""
    limit = transfer_threshold(flows).scalar()
    big = flows.where(F.col("bytes") >= limit)
    if explained is not None:
        big = big.join(explained.select("id"), "id", "left_anti")
    one = big.select("id", "src_ip", F.lit(1).alias("n"), F.col("us").alias("start_us"), F.col("us").alias("end_us"))
    return _out(one, "large-transfer", F.col("id"), F.when(public(F.col("src_ip")), "HIGH").otherwise("MEDIUM"))


def brute_force(failures: DataFrame, logins: DataFrame, window_us: int = 10 * MINUTE_US, minimum: int = 5, sure: int = 10,
                follow_us: int = 30 * MINUTE_US, bucket_us: int = 10 * MINUTE_US) -> DataFrame:
    """A burst of failures of one account far above its usual rate; a success that follows raises it."""
    burst = max_window(failures, ["actor_id"], window_us).where(F.col("n") >= minimum)
    usual = _median_over_span(failures, bucket_us)
    b = burst.join(usual, "actor_id").where(F.col("n") >= 3 * F.greatest("median", F.lit(1.0)))
    in_burst = failures.join(b.select("actor_id", "start_us", "end_us"), "actor_id").where("us BETWEEN start_us AND end_us")
    src = in_burst.groupBy("actor_id", "src_ip").agg(F.count("*").alias("c")).groupBy("actor_id").agg(
        F.max_by("src_ip", F.struct("c", "src_ip")).alias("main"), F.max("c").alias("main_n"))
    b = b.join(src, "actor_id")
    focused = (F.col("main_n") >= 0.8 * F.col("n")) & public(F.col("main"))
    b = b.where((F.col("n") >= sure) | focused)
    won = success_after(b.select("actor_id", "end_us", "main"), logins, follow_us)
    b = b.join(won.select("actor_id", "success_id", "same_source"), "actor_id", "left")
    return _out(b, "brute-force", F.concat(F.col("actor_id"), F.lit("|"), F.col("start_us").cast("string")),
                F.when(F.col("success_id").isNotNull(), "HIGH").otherwise("MEDIUM"))


def _median_over_span(failures: DataFrame, bucket_us: int) -> DataFrame:
    """Median failures per bucket of each account over the whole observed span, empty buckets counted."""
    span = failures.agg(F.floor((F.max("us") - F.min("us")) / bucket_us).cast("long") + 1)
    counts = failures.groupBy("actor_id", F.expr(f"us div {bucket_us}").alias("b")).agg(F.count("*").alias("c"))
    dist = counts.groupBy("actor_id", "c").agg(F.count("*").alias("f"))
    empty = counts.groupBy("actor_id").agg(F.count("*").alias("k")).withColumn("total", span.scalar()).select(
        "actor_id", F.lit(0).cast("long").alias("c"), (F.col("total") - F.col("k")).alias("f")).where("f > 0")
    return dist.unionByName(empty).groupBy("actor_id").agg(F.percentile("c", 0.5, F.col("f")).alias("median"))


def success_after(bursts: DataFrame, logins: DataFrame, follow_us: int) -> DataFrame:
    """First sign-in after each burst end within the follow-up time; one from the burst's own source is preferred."""
    near = logins.select("actor_id", F.col("id").alias("success_id"), F.col("us").alias("l_us"), F.col("src_ip").alias("l_src")).join(bursts, "actor_id")
    near = near.where(F.col("l_us").between(F.col("end_us"), F.col("end_us") + follow_us))
    same = F.coalesce(F.col("l_src") == F.col("main"), F.lit(False))
    pick = F.min_by(F.struct("success_id", same.alias("same_source")), F.struct(~same, F.col("l_us"), F.col("success_id")))
    return near.groupBy("actor_id", "end_us").agg(pick.alias("s")).select("actor_id", "end_us", "s.*")


def password_spray(failures: DataFrame, window_us: int = 10 * MINUTE_US, minimum: int = 10, accounts: int = 3) -> DataFrame:
    """Failures of several accounts from one address."""
    b = max_window(failures, ["src_ip"], window_us).where(F.col("n") >= minimum)
    who = failures.join(b.select("src_ip", "start_us", "end_us"), "src_ip").where("us BETWEEN start_us AND end_us")
    n = who.select("src_ip", "actor_id").distinct().groupBy("src_ip").agg(F.count("*").alias("accounts"))
    b = b.join(n, "src_ip").where(F.col("accounts") >= accounts)
    return _out(b, "password-spray", F.col("src_ip"), F.when(public(F.col("src_ip")), "HIGH").otherwise("MEDIUM"))


def mfa_fatigue(challenges: DataFrame, window_us: int = 10 * MINUTE_US, minimum: int = 5) -> DataFrame:
    b = max_window(challenges, ["actor_id"], window_us).where(F.col("n") >= minimum)
    return _out(b, "mfa-fatigue", F.col("actor_id"), F.lit("MEDIUM"))


def new_external_signin(signins: DataFrame, internal_before: int = 3, mfa: DataFrame | None = None) -> DataFrame:
    """The first public source of an account that signed in from inside often enough before."""
    first = signins.where(public(F.col("src_ip"))).groupBy("actor_id").agg(F.min(F.struct("us", "id", "src_ip")).alias("f")).select("actor_id", "f.*")
    inside = signins.where(netaddr.ip_scope(F.col("src_ip")) == "internal").select("actor_id", F.col("us").alias("i_us"))
    n = inside.join(first.select("actor_id", "us"), "actor_id").where("i_us < us").groupBy("actor_id").agg(F.count("*").alias("n"))
    g = first.join(n, "actor_id").where(F.col("n") >= internal_before).withColumns({"start_us": F.col("us"), "end_us": F.col("us")})
    severity = F.lit("MEDIUM")
    if mfa is not None:
        g = g.join(mfa.select("actor_id").distinct().withColumn("mfa", F.lit(True)), "actor_id", "left")
        severity = F.when(F.col("mfa"), "LOW").otherwise("MEDIUM")
    return _out(g, "new-external-signin", F.concat_ws("|", "actor_id", "src_ip"), severity)


def service_new_source(signins: DataFrame, earlier: int = 3) -> DataFrame:
    f = first_seen_source(signins.where(F.col("actor_id").rlike(SERVICE_IDENTITY)), min_earlier=earlier)
    f = f.withColumns({"n": F.col("earlier"), "start_us": F.col("us"), "end_us": F.col("us")})
    return _out(f, "service-account-new-source", F.concat_ws("|", "actor_id", "src_ip"), F.when(public(F.col("src_ip")), "HIGH").otherwise("MEDIUM"))


def change_cover(events: DataFrame, changes: DataFrame, step_us: int = DAY_US) -> DataFrame:
    """(id, change_id): the first approved change whose window holds the event and whose actor or service fits.

    Which names hold which wanted text is found over distinct names, by their pieces; events then meet the changes of their own actor or target on
    the days these touch.
    """
    c = changes.where(F.lower("status").isin("approved", "scheduled", "implemented", "in_progress", "in-progress", "implement", "authorized"))
    days = F.sequence(F.expr(f"from_us div {step_us}"), F.expr(f"until_us div {step_us}"))
    e = events.select("id", "us", F.lower("actor_id").alias("actor"), F.lower("target_id").alias("service")).withColumn("day", F.expr(f"us div {step_us}"))
    covered = []
    for side in ("actor", "service"):
        wanted = c.select("change_id", "from_us", "until_us", F.lower(F.col(side)).alias("wanted"), F.explode(days).alias("day")).where("wanted <> ''")
        pairs = containing(e.select(F.col(side).alias("name")), wanted.select("wanted")).withColumnRenamed("name", side)
        covered.append(e.join(pairs, side).join(wanted, ["wanted", "day"]).where("us BETWEEN from_us AND until_us").select("id", "change_id"))
    return covered[0].unionByName(covered[1]).groupBy("id").agg(F.min("change_id").alias("change_id"))


def destructive_changes(deletes: DataFrame, covered: DataFrame) -> DataFrame:
    """Destructive operations per actor outside any approved change."""
    g = deletes.join(covered.select("id"), "id", "left_anti").groupBy("actor_id").agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return _out(g, "destructive-change", F.col("actor_id"), F.when(F.col("n") >= 5, "HIGH").otherwise("MEDIUM"))


def log_tampering(events: DataFrame) -> DataFrame:
    hit = events.where(F.col("api").isin(TAMPER_APIS) | F.col("event_type").isin("audit.cleared", "log.cleared"))
    g = hit.groupBy("actor_id", "api").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return _out(g, "log-tampering", F.concat_ws("|", "actor_id", "api"), F.lit("HIGH"))


def credential_access(events: DataFrame) -> DataFrame:
    """Credential files read, per host and day."""
    hit = events.where(F.col("path").rlike(CREDENTIAL_FILE))
    g = hit.groupBy("target_id", F.expr(f"us div {DAY_US}").alias("day")).agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return _out(g, "credential-access", F.concat(F.col("target_id"), F.lit("|"), F.col("day").cast("string")), F.lit("MEDIUM"))


def security_alerts(alerts: DataFrame, minimum_rank: int = 2) -> DataFrame:
    g = alerts.where(F.col("severity_rank") >= minimum_rank).groupBy("signature", "actor_id", "target_id").agg(
        F.count("*").alias("n"), F.max("severity_rank").alias("r"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return _out(g, "security-alert", F.concat_ws("|", "signature", "actor_id", "target_id"), severity_name(F.col("r")))


def command_family(command: Column) -> Column:
    """The first family a command line belongs to, with its level."""
    expr = None
    for name, (level, pattern) in COMMANDS.items():
        value = F.struct(F.lit(name).alias("family"), F.lit(level).alias("severity"))
        expr = F.when(command.rlike(pattern), value) if expr is None else expr.when(command.rlike(pattern), value)
    return expr


def suspicious_commands(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections, explained): routine exports that a scheduler started are explained."""
    c = commands.drop("severity").withColumn("f", command_family(F.col("command"))).where("f IS NOT NULL").select("*", "f.*")
    routine = F.col("family").isin(ROUTINE_WHEN_SCHEDULED) & F.coalesce("scheduled", F.lit(False))
    g = c.where(~routine).groupBy("target_id", "actor_id", "family", "severity").agg(
        F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    found = _out(g, "suspicious-command", F.concat_ws("|", "target_id", "actor_id", "family"), F.col("severity"))
    return found, c.where(routine).select(F.lit("suspicious-command").alias("rule"), "id", F.lit("scheduled job").alias("reason"))


def risky_sql(statements: DataFrame) -> DataFrame:
    e = statements.select("actor_id", "us", F.explode(sql_risks(F.col("statement"))).alias("risk"))
    g = e.groupBy("actor_id", "risk").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return _out(g, "risky-sql", F.concat_ws("|", "actor_id", "risk"),
                F.when(F.col("risk").isin("command-execution", "file-export"), "HIGH").otherwise("MEDIUM"))


def dns_tunneling(queries: DataFrame, names: int = 30, label: int = 30, length: int = 100) -> DataFrame:
    """Many distinct long names under one base domain from one client."""
    labels = F.split("name", r"\.")
    base = F.array_join(F.slice(labels, -2, 2), ".")
    long = (F.length("name") >= length) | F.exists(labels, lambda x: F.length(x) >= label)
    d = queries.where((F.size(labels) > 2) & long).groupBy("client", base.alias("base"), "name").agg(F.min("us").alias("a"), F.max("us").alias("z"))
    g = d.groupBy("client", "base").agg(F.count("*").alias("n"), F.min("a").alias("start_us"), F.max("z").alias("end_us")).where(F.col("n") >= names)
    return _out(g, "dns-tunneling", F.concat_ws("|", "client", "base"), F.lit("HIGH"))


def large_exports(files: DataFrame, size: int = 100 * MB) -> tuple[DataFrame, DataFrame]:
    """(detections, explained): large file events without a ticket; those with one are explained."""
    big = files.where(F.col("bytes") >= size)
    ticket = F.coalesce("ticket", F.lit("")) != ""
    one = big.where(~ticket).select("id", F.lit(1).alias("n"), F.col("us").alias("start_us"), F.col("us").alias("end_us"))
    return _out(one, "large-export", F.col("id"), F.lit("MEDIUM")), big.where(ticket).select(F.lit("large-export").alias("rule"), "id", F.lit("ticket").alias("reason"))


def dns_before(flows: DataFrame, answers: DataFrame) -> DataFrame:
    """Flows (id, dst_ip, us) with the newest name that resolved to their address in the hour before."""
    found = latest_before(flows.select("id", "dst_ip", "us"), answers.select(F.col("ip").alias("dst_ip"), "us", "name"), ["dst_ip"], ["name"], HOUR_US)
    return found.groupBy("id").agg(F.max("latest").alias("l")).select("id", F.col("l.name").alias("name"))


def chains(detections: DataFrame, pivots: DataFrame, gap_us: int = 2 * HOUR_US) -> DataFrame:
    """(detection, chain): detections that share an entity within the gap, in groups of at least two with one HIGH.

    ``detections(id, start_us, end_us, severity)``, ``pivots(id, pivot)``. Per entity each detection is compared with the one before
    it; neighbours within a day block and the last of a block with the first of the next, so a shared entity does not fix one task.
    """
    p = pivots.join(detections.select("id", "start_us", "end_us"), "id").withColumn("block", F.expr(f"start_us div {DAY_US}"))
    from pyspark.sql import Window

    order = F.struct("start_us", "id")
    w = Window.partitionBy("pivot", "block").orderBy("start_us", "id")
    inner = p.withColumn("prev", F.lag(F.struct("id", "start_us", "end_us")).over(w))
    edges = p.groupBy("pivot", "block").agg(
        F.min_by(F.struct("id", "start_us", "end_us"), order).alias("first"), F.max_by(F.struct("id", "start_us", "end_us"), order).alias("last"))
    wb = Window.partitionBy("pivot").orderBy("block")
    across = edges.withColumn("prev", F.lag("last").over(wb)).select("first.*", "prev")
    near = (F.col("start_us") - F.col("prev.end_us") <= gap_us) & (F.col("prev.start_us") - F.col("end_us") <= gap_us)
    links = inner.select("id", "start_us", "end_us", "prev").unionByName(across).where(F.col("prev").isNotNull() & near).select(
        F.col("prev.id").alias("a"), F.col("id").alias("b"))
    comp = connected_components(links)
    sized = comp.join(detections.select("id", "severity"), "id").groupBy("component").agg(
        F.count("*").alias("size"), F.max(severity_rank(F.col("severity"))).alias("top"))
    return comp.join(sized.where("size >= 2 AND top >= 3"), "component").select("id", F.col("component").alias("chain"), "size")


def incidents(chain_rows: DataFrame, detections: DataFrame) -> DataFrame:
    """One incident per chain: level of the worst step, one higher from four steps on; mean confidence plus 0.1, at most 0.95."""
    d = chain_rows.join(detections, "id")
    rank = F.max(severity_rank(F.col("severity")))
    return d.groupBy("chain").agg(
        F.count("*").alias("steps"), severity_name(F.when(F.count("*") >= 4, F.least(rank + 1, F.lit(4))).otherwise(rank)).alias("severity"),
        F.round(F.least(F.lit(0.95), F.avg("confidence") + 0.1), 4).alias("confidence"), F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def to_findings(detections: DataFrame, product: str = "detect") -> DataFrame:
    from vigilframe.functions.ids import finding_id

    return detections.select(finding_id(F.lit(product), F.col("rule"), F.col("subject")).alias("id"), F.lit(product).alias("product"),
                             F.col("rule").alias("rule_id"), "severity", "subject", "n", "start_us", "end_us")


