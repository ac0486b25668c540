"""Identifiers, levels, merges and other model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import ids, levels, ports, text, times, versions
from vigilframe.functions.semantics import is_privileged
from vigilframe.operators import merge
from vigilframe.operators.risk import assess
from vigilframe.plans.registry import query


@query("make_ids", "ev",
       """SELECT id, 'host:' || lower(split_part(target_id, ':', 2)) AS object_id, 'rel:' || substr(sha256(actor_id || chr(31) || 'LOGGED_INTO'
       || chr(31) || target_id || chr(31)), 1, 24) AS rel_id, 'finding:detect:auth:' || substr(sha256(actor_id || chr(31)), 1, 12) AS
       finding_id FROM ev""")
def make_ids(t):
    key = F.concat(F.lit("  "), F.upper(ids.key_of(F.col("target_id"))), F.lit(" "))
    return t.ev.select(
        "id", ids.object_id(ids.object_type(F.lit("hostname")), key).alias("object_id"),
        ids.relationship_id(F.col("actor_id"), F.lit("LOGGED_INTO"), F.col("target_id")).alias("rel_id"),
        ids.finding_id(F.lit("detect"), F.lit("auth"), F.col("actor_id")).alias("finding_id"))


@query("normalize_url", "",
       "SELECT page_id, 'url:' || lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_replace(regexp_replace(url, "
       "'^[a-zA-Z]+://[^/?#]*', ''), '#.*$', '') AS object_id FROM pages")
def normalize_url(t):
    return t.pages.select("page_id", ids.object_id(F.lit("url"), F.col("url")).alias("object_id"))


@query("severity_parse", "",
       """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN
       '5-LOW' THEN 'LOW' ELSE 'unknown' END AS named, CASE WHEN o_totalprice / 50000 >= 9 THEN 'CRITICAL' WHEN o_totalprice / 50000 >= 7 THEN
       'HIGH' WHEN o_totalprice / 50000 >= 4 THEN 'MEDIUM' WHEN o_totalprice > 0 THEN 'LOW' ELSE 'INFO' END AS scored FROM orders""")
def severity_parse(t):
    word = F.regexp_replace(F.lower(F.substring("o_orderpriority", 3, 20)), "urgent", " emergency ")
    return t.orders.select(
        "o_orderkey", F.coalesce(levels.severity_from_text(word), F.lit("unknown")).alias("named"),
        levels.severity_from_score(F.col("o_totalprice") / 50000).alias("scored"))


@query("confidence_parse", "ev",
       "SELECT id, round((k + 1) / 100.0, 4)::DOUBLE AS pct, CASE WHEN k % 3 = 0 THEN 0.9 WHEN k % 3 = 1 THEN 0.6 ELSE 0.8 END::DOUBLE AS named, "
       "CASE WHEN (k + 1) / 100.0 >= 0.8 THEN 'HIGH' WHEN (k + 1) / 100.0 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM ev")
def confidence_parse(t):
    number = F.when(F.col("k") == 0, F.lit("0.01")).otherwise((F.col("k") + 1).cast("string"))
    pct = levels.confidence_from_text(number)
    named = F.when(F.col("k") % 3 == 0, "High").when(F.col("k") % 3 == 1, " med ").otherwise("")
    return t.ev.select("id", pct.alias("pct"), levels.confidence_from_text(named).alias("named"), levels.confidence_level(pct).alias("level"))


@query("content_hash", "obj",
       """SELECT id, sha256('{"active":true,"metadata":{"criticality":"' || coalesce(criticality, '') || '","disabled":"' || CAST(disabled AS
       VARCHAR) || '"},"name":"' || name || '","tags":["' || tag || '"],"type":"' || type || '"}') AS hash FROM obj""")
def content_hash(t):
    from vigilframe.operators.snapshot import canonical_map

    meta = canonical_map(F.create_map(
        F.lit("scanned_at"), F.lit("now"), F.lit("disabled"), F.col("disabled").cast("string"), F.lit("criticality"),
        F.coalesce("criticality", F.lit(""))))
    body = F.to_json(F.struct(F.lit(True).alias("active"), meta.alias("metadata"), "name", F.array("tag").alias("tags"), "type"))
    return t.obj.select("id", F.sha2(body, 256).alias("hash"))


@query("entropy", "",
       """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS c
       FROM c GROUP BY ALL), p AS (SELECT doc_id, c / sum(c) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(sum(-p * log2(p)), 6) AS
       bits FROM p GROUP BY doc_id""")
def entropy(t):
    """Entropy of each whole document."""
    return t.documents.select("doc_id", F.round(text.entropy(F.col("text")), 6).alias("bits"))


@query("port_sets", "",
       """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN hi < 1000 OR lo > 2000 THEN 0 ELSE least(hi, 2000) - greatest(lo, 1000) + 1 END AS
       common, (hi - lo + 1) - CASE WHEN hi < 1000 OR lo > 2000 THEN 0 ELSE least(hi, 2000) - greatest(lo, 1000) + 1 END AS rest, lo >= 1000 AND
       hi <= 2000 AS covered, 'tcp/' || lo || '-' || hi AS label FROM (SELECT *, CAST(l_partkey % 3000 AS INT) AS lo, CAST(l_partkey % 3000 +
       l_quantity AS INT) AS hi FROM lineitem)""")
def port_sets(t):
    lo = (F.col("l_partkey") % 3000).cast("int")
    hi = (F.col("l_partkey") % 3000 + F.col("l_quantity")).cast("int")
    mid = lo + 1
    # the same range written as two that touch, so the merge has work to do
    spec = F.array(F.concat(mid.cast("string"), F.lit("-"), hi.cast("string")), F.concat(F.lit("TCP/"), lo.cast("string")))
    # the fixed set is parsed once, not for every row
    wide = t.spark.range(1).select(ports.parse(F.array(F.lit("tcp/1000-2000"), F.lit("udp/53")))).scalar()
    a = ports.parse(spec)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), wide.alias("w")).select(
        "l_orderkey", "l_linenumber", "l_partkey", ports.size(ports.intersect(F.col("a"), F.col("w"))).alias("common"),
        ports.size(ports.subtract(F.col("a"), F.col("w"))).alias("rest"), ports.covers(F.col("w"), F.col("a")).alias("covered"),
        F.element_at(ports.labels(F.col("a")), 1).alias("label"))


@query("version_key", "",
       "SELECT p_partkey, p_size * 100 + p_partkey % 10 AS ord, CAST(p_size > 20 OR (p_size = 20 AND p_partkey % 10 > 4) AS BOOLEAN) AS newer, "
       "CAST(p_size > 20 OR (p_size = 20 AND p_partkey % 10 >= 4) AS BOOLEAN) AS at_least FROM part")
def version_key(t):
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".0"))
    eco = F.when(F.col("p_partkey") % 3 == 0, "pypi").when(F.col("p_partkey") % 3 == 1, "npm").otherwise("deb")
    base = versions.version_key(eco, F.lit("20.4"))
    key = versions.version_key(eco, v)
    return t.part.select(
        "p_partkey", (F.col("p_size") * 100 + F.col("p_partkey") % 10).alias("ord"), (key > base).alias("newer"), (key >= base).alias("at_least"))


@query("is_privileged", "obj", "SELECT id, privileged OR wildcard OR tag = 'machinery' AS privileged FROM obj")
def q_is_privileged(t):
    meta = F.create_map(F.lit("privileged"), F.col("privileged").cast("string"), F.lit("wildcard"), F.col("wildcard").cast("string"))
    tags = F.when(F.col("tag") == "machinery", F.array(F.lit("privileged"))).otherwise(F.array("tag"))
    return t.obj.select("id", is_privileged(meta, tags).alias("privileged"))


@query("risk_assess", "",
       """SELECT subject, score, CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS
       level FROM (SELECT CAST(c_custkey AS VARCHAR) AS subject, CAST(greatest(0, least(100, n * 2 - CASE WHEN c_acctbal > 5000 THEN 30 ELSE 0 END)) AS
       INT) AS score FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)""")
def risk_assess(t):
    sub = F.col("o_custkey").cast("string").alias("subject")
    up = t.orders.groupBy(sub).agg((F.count("*") * 2).cast("int").alias("points")).withColumn("rule", F.lit("orders"))
    down = t.customer.where("c_acctbal > 5000").select(
        F.col("c_custkey").cast("string").alias("subject"), F.lit(-30).alias("points"), F.lit("balance").alias("rule"))
    down = down.join(up.select("subject"), "subject", "left_semi")
    return assess(up.unionByName(down)).select("subject", "score", "level")


@query("severity_ladder", "",
       """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 250000 THEN 'HIGH' ELSE 'LOW' END ELSE CASE WHEN o_totalprice >
       250000 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity FROM orders""")
def severity_ladder(t):
    """Baseline MEDIUM; steps are applied in order and clamped each time, so the order matters."""
    from vigilframe.operators.surface import ladder

    steps = F.array(F.when(F.col("o_orderstatus") == "F", -1).otherwise(0), F.when(F.col("o_totalprice") > 250000, 2).otherwise(0))
    return t.orders.select("o_orderkey", ladder("MEDIUM", steps, "HIGH").alias("severity"))


@query("name_covers", "",
       """SELECT host, covers FROM (SELECT DISTINCT regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM pages), (SELECT 1) x,
       LATERAL (SELECT host LIKE '%.example.com' AND length(host) - length(replace(host, '.', '')) = 2 AS covers)""")
def name_covers(t):
    from vigilframe.operators.surface import name_covers as covers

    host = F.regexp_extract("url", r"://([^/?#:]+)", 1)
    return t.pages.select(host.alias("host")).distinct().select("host", covers(F.lit("*.example.com"), F.col("host")).alias("covers"))


@query("parse_ts", "ev",
       """SELECT id, CASE k % 8 WHEN 0 THEN us WHEN 4 THEN us // 1000 * 1000 ELSE us // 1000000 * 1000000 END AS parsed FROM ev""")
def parse_ts(t):
    """Each event time written in one of eight formats and read back."""
    ts = F.timestamp_micros("us")

    def fmt(pattern: str):
        return F.date_format(ts, pattern)

    written = (
        F.when(F.col("k") % 8 == 0, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(F.col("k") % 8 == 1, fmt("dd/MMM/yyyy:HH:mm:ss '+0000'"))
        .when(F.col("k") % 8 == 2, fmt("MMM d HH:mm:ss"))
        .when(F.col("k") % 8 == 3, F.expr("CAST(us div 1000000 AS STRING)"))
        .when(F.col("k") % 8 == 4, F.expr("CAST(us div 1000 AS STRING)"))
        .when(F.col("k") % 8 == 5, fmt("M/d/yyyy h:mm:ss a"))
        .when(F.col("k") % 8 == 6, fmt("EEE, dd MMM yyyy HH:mm:ss '+0000'"))
        .otherwise(fmt("yyyy/MM/dd HH:mm:ss"))
    )
    return t.ev.select("id", times.parse_micros(written, F.col("us") + 3_600_000_000).alias("parsed"))


# ---------------------------------------------------------------- merging

REC_SQL = """rec AS (SELECT target_id AS id, CAST(substr(id, 7) AS BIGINT) AS seq, 'H-' || parser || '-' || severity AS name, us AS first_us, us AS
 last_us, CASE WHEN k % 11 = 0 THEN us + 5000000000 END AS to_us, confidence, CASE WHEN source = 'src0' THEN 'unknown' ELSE source END AS source,
 k % 3 AS observations, k % 2 = 0 AS synthetic, event_type FROM ev)"""


def records(t):
    return t.ev.select(
        F.col("target_id").alias("id"), F.substring("id", 7, 20).cast("long").alias("seq"), F.concat_ws("-", F.lit("H"), "parser", "severity").alias("name"),
        F.col("us").alias("first_us"), F.col("us").alias("last_us"), F.lit(None).cast("long").alias("from_us"),
        F.when(F.col("k") % 11 == 0, F.col("us") + 5_000_000_000).alias("to_us"), "confidence",
        F.when(F.col("source") == "src0", "unknown").otherwise(F.col("source")).alias("source"), (F.col("k") % 3).alias("observations"),
        (F.col("k") % 2 == 0).alias("synthetic"), F.array("event_type").alias("tags"), F.col("actor_id").alias("src"), F.lit("USES").alias("type"),
        F.col("target_id").alias("dst"))


END_SQL = """SELECT {key}, max(to_us) AS to_us FROM (SELECT {key}, to_us, max(CASE WHEN to_us IS NULL THEN last_us END) OVER (PARTITION BY {key} ORDER BY
 seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM {src}) WHERE to_us IS NOT NULL AND (later IS NULL OR to_us >= later)
 GROUP BY {key}"""


@query("merge_objects", "ev",
       f"""WITH {REC_SQL}, e AS ({END_SQL.format(key='id', src='rec')}) SELECT r.id, arg_max(name, (confidence, -seq)) AS name, min(first_us) AS first_us,
       max(last_us) AS last_us, max(confidence) AS confidence, CAST(sum(observations) AS BIGINT) AS observations, coalesce(arg_min(source, seq) FILTER
       (source <> 'unknown'), 'unknown') AS source, arg_min(synthetic, seq) AND coalesce(bool_and(synthetic) FILTER (observations > 0), true) AS
       synthetic, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags, max(e.to_us) AS to_us FROM rec r LEFT JOIN e ON e.id = r.id GROUP BY
       r.id""")
def merge_objects(t):
    m = merge.merge_objects(records(t))
    return m.select("id", "name", "first_us", "last_us", "confidence", "observations", "source", "synthetic", F.array_join("tags", ",").alias("tags"), "to_us")


@query("merge_relationships", "ev",
       f"""WITH {REC_SQL.replace('target_id AS id', "actor_id || '>' || target_id AS id")}, e AS ({END_SQL.format(key='id', src='rec')}) SELECT r.id,
       max(confidence) AS confidence, min(first_us) AS first_us, CAST(sum(observations) AS BIGINT) AS observations, max(e.to_us) AS to_us FROM rec r LEFT
       JOIN e ON e.id = r.id GROUP BY r.id""")
def merge_relationships(t):
    r = records(t).withColumn("id", F.concat_ws(">", "src", "dst"))
    return merge.merge_relationships(r).select("id", "confidence", "first_us", "observations", "to_us")


@query("merge_metadata", "ev",
       """SELECT target_id AS id, key, max(value) AS value, max(items) AS items FROM (
       SELECT target_id, 'os.name' AS key, arg_max(parser, id) AS value, NULL AS items FROM ev GROUP BY 1 UNION ALL
       SELECT target_id, 'level.' || parser, arg_max(severity, id), NULL FROM ev GROUP BY target_id, parser UNION ALL
       SELECT target_id, 'addresses', NULL, string_agg(src_ip, ',' ORDER BY f) FROM (SELECT target_id, src_ip, min(id) AS f FROM ev GROUP BY ALL) GROUP BY 1
       UNION ALL SELECT target_id, 'recent', NULL, arg_max(source, id) FROM ev GROUP BY 1) GROUP BY ALL""")
def merge_metadata(t):
    r = t.ev.select(
        F.col("target_id").alias("id"), F.substring("id", 7, 20).cast("long").alias("seq"),
        F.create_map(F.lit("os.name"), F.col("parser"), F.concat(F.lit("level."), "parser"), F.col("severity")).alias("metadata"),
        F.create_map(F.lit("addresses"), F.array("src_ip"), F.lit("recent"), F.array("source")).alias("lists"))
    return merge.merge_metadata(r).select("id", "key", "value", F.array_join("items", ",").alias("items"))


@query("dedup_events", "ev",
       """WITH b AS (SELECT actor_id || '|' || target_id AS id, id AS seq, parser, us FROM ev), f AS (SELECT id, arg_min(parser, seq) AS parser, count(*) - 1
       AS batch_duplicates FROM b GROUP BY id), s AS (SELECT actor_id || '|' || target_id AS id, min(parser) AS parser FROM ev WHERE us < 1704844800000000
       GROUP BY 1) SELECT f.id, f.batch_duplicates, CASE WHEN s.id IS NULL THEN 'created' WHEN s.parser <> f.parser THEN 'reparsed' ELSE 'duplicate' END AS
       state FROM f LEFT JOIN s ON s.id = f.id""")
def dedup_events(t):
    batch = t.ev.select(F.concat_ws("|", "actor_id", "target_id").alias("id"), F.col("id").alias("seq"), "parser", "us")
    stored = batch.where("us < 1704844800000000").groupBy("id").agg(F.min("parser").alias("parser"))
    return merge.dedup_events(batch, stored, reparse=True).select("id", "batch_duplicates", "state")


@query("account_state", "ev",
       """SELECT actor_id AS object_id, arg_max(event_type, (us, id)) = 'auth.failure' AS disabled FROM ev WHERE event_type IN ('auth.failure', 'auth.login')
       GROUP BY actor_id""")
def account_state(t):
    e = t.ev.where("event_type IN ('auth.failure', 'auth.login')").select(
        "id", "us", F.when(F.col("event_type") == "auth.failure", "iam.user.disable").otherwise("iam.user.enable").alias("event_type"),
        F.lit("success").alias("outcome"), F.col("actor_id").alias("target_id"))
    return merge.account_state(e).select("object_id", "disabled")


@query("derive_edges", "ev",
       """SELECT src, type, dst, count(*) AS n, max(conf) AS confidence FROM (
       SELECT actor_id AS src, 'LOGGED_INTO' AS type, target_id AS dst, confidence AS conf FROM ev WHERE event_type = 'auth.login' UNION ALL
       SELECT 'ip:' || src_ip, 'CONNECTED_TO', target_id, least(confidence, 0.9) FROM ev WHERE event_type = 'auth.login' UNION ALL
       SELECT actor_id, 'READ', target_id, confidence FROM ev WHERE event_type = 'file.read' UNION ALL
       SELECT actor_id, 'CONNECTED_TO', target_id, confidence FROM ev WHERE event_type = 'network.flow' UNION ALL
       SELECT target_id, 'HAS_ADDRESS', 'ip:' || src_ip, least(confidence, 0.8) FROM ev WHERE event_type = 'network.flow' UNION ALL
       SELECT actor_id, 'REQUESTED', target_id, confidence FROM ev WHERE event_type = 'http.request') GROUP BY ALL""")
def derive_edges(t):
    e = t.ev.withColumn("roles", F.create_map(
        F.lit("src_ip"), F.concat(F.lit("ip:"), "src_ip"), F.lit("host"), F.when(F.col("category") == "network", F.col("target_id")))).withColumn(
        "attrs", F.create_map(F.lit("k"), F.col("k").cast("string")))
    d = merge.derive_edges(e)
    return d.groupBy("src", "type", "dst").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query("provenance_cap", "ev",
       "SELECT subject, max(n) AS kept FROM (SELECT target_id AS subject, least(row_number() OVER (PARTITION BY target_id ORDER BY id), 200) AS n FROM ev) "
       "GROUP BY subject")
def provenance_cap(t):
    r = t.ev.select(F.col("target_id").alias("subject"), F.col("id").alias("seq"))
    return merge.provenance(r).groupBy("subject").agg(F.count("*").alias("kept"))


@query("ingest_report", "ev",
       "SELECT source, CASE WHEN k % 9 = 0 THEN 'no timestamp' WHEN k % 10 = 0 THEN 'bad level' ELSE 'accepted' END AS status, count(*) AS n FROM ev GROUP BY ALL")
def ingest_report(t):
    bad = F.when(F.col("k") % 9 == 0, "no timestamp").when(F.col("k") % 10 == 0, "bad level")
    return merge.ingest_report(t.ev.withColumn("error", bad))


# ---------------------------------------------------------------- text


@query("redact_text", "",
       r"""SELECT doc_id, regexp_replace(text, '(?i)((?:api[_-]?key|apikey|secret|token|passw(?:or)?d|pwd|access[_-]?key)\s*[=:]\s*["'']?)([^\s"'',;]{3})'
       || '[^\s"'',;]{5,}([^\s"'',;]{4})', '\1\2****\3', 'g') AS redacted FROM documents WHERE regexp_matches(text, '(?i)token = "[0-9a-f]{40}"') AND NOT
       regexp_matches(text, '(?i)://[^:/\s@]+:[^@\s/]+@|\bsk-|\bAKIA|\bbearer|PRIVATE KEY')""")
def redact(t):
    d = t.documents.where(F.col("text").rlike(r'(?i)token = "[0-9a-f]{40}"') & ~F.col("text").rlike(r"(?i)://[^:/\s@]+:[^@\s/]+@|\bsk-|\bAKIA|\bbearer|PRIVATE KEY"))
    return d.select("doc_id", text.redact_text(F.col("text")).alias("redacted"))


@query("sql_risk", "",
       """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'DROP' WHEN 'O' THEN 'COPY' ELSE 'GRANT' END AS verb, CASE o_orderstatus WHEN 'F' THEN
       'destructive' WHEN 'O' THEN 'file-export' ELSE 'privilege-change' END AS risks, CASE o_orderstatus WHEN 'F' THEN 't' || o_custkey ELSE '' END AS tables
       FROM orders""")
def sql_risk(t):
    cust = F.col("o_custkey").cast("string")
    stmt = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("drop table t"), cust))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("/* x */ COPY orders TO '/tmp/"), cust, F.lit(".csv'")))
        .otherwise(F.concat(F.lit("grant select on t"), cust, F.lit(" to public"))))
    return t.orders.select("o_orderkey", text.sql_verb(stmt).alias("verb"), F.array_join(text.sql_risks(stmt), ",").alias("risks"),
                           F.array_join(text.sql_tables(stmt), ",").alias("tables"))


INJECTION = (
    "(?i)ignore (all |any )?(previous|prior|above) instructions|disregard (the )?(previous|above)|system prompt|you are now|new instructions|"
    "act as an?|do not cite|report that"
)


@query("injection_flag", "",
       f"SELECT conv_id, turn, regexp_matches(text, '{INJECTION}') AS flagged FROM conversations")
def injection_flag(t):
    return t.conversations.select("conv_id", "turn", F.col("text").rlike(INJECTION).alias("flagged"))
