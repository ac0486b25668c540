"""Merging partial records that share an id.

Everything is a commutative aggregate over an explicit arrival number, so records of one id combine map-side and no
task has to hold them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_BLOCK = 100_000
# Metadata keys whose lists are united instead of replaced.
UNION_KEYS = ["aliases", "sources", "addresses", "ports", "sans"]


def _common() -> list[Column]:
    counted = F.when(F.col("observations") > 0, F.col("synthetic"))
    return [
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.min("from_us").alias("from_us"),
        F.max("confidence").alias("confidence"), F.sum("observations").alias("observations"),
        F.coalesce(F.min_by("source", F.when(F.col("source") != "unknown", F.col("seq"))), F.lit("unknown")).alias("source"),
        (F.min_by("synthetic", "seq") & F.coalesce(F.bool_and(counted), F.lit(True))).alias("synthetic"),
    ]


def end_times(records: DataFrame) -> DataFrame:
    """(id, to_us) after all records: the largest end that no later open observation outlives.

    An end is void when a record that arrives later has no end and was seen after it. Later records are looked up
    inside blocks of arrivals first and then across blocks, of which each keeps two numbers.
    """
    rows = records.select("id", "seq", "to_us", F.when(F.col("to_us").isNull(), F.col("last_us")).alias("open_us"))
    rows = rows.where("to_us IS NOT NULL OR open_us IS NOT NULL").withColumn("block", F.expr(f"seq div {SEQ_BLOCK}"))
    later = Window.partitionBy("id", "block").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    alive = F.col("to_us") >= F.coalesce(F.max("open_us").over(later), F.col("to_us"))
    blocks = rows.withColumn("alive", F.when(alive, F.col("to_us"))).groupBy("id", "block").agg(
        F.max("alive").alias("end"), F.max("open_us").alias("open_us"))
    after = Window.partitionBy("id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("end") >= F.coalesce(F.max("open_us").over(after), F.col("end"))
    return blocks.withColumn("end", F.when(held, F.col("end"))).groupBy("id").agg(F.max("end").alias("to_us"))


def merge_objects(records: DataFrame) -> DataFrame:
    """One row per object id; ``records`` has seq, name, times, source, confidence, tags, observations, synthetic."""
    flat = records.groupBy("id").agg(
        # a name gives way only to a strictly more confident record
        F.max_by("name", F.struct("confidence", -F.col("seq"))).alias("name"), *_common(),
    )
    tags = records.select("id", F.explode("tags").alias("tag")).distinct().groupBy("id").agg(
        F.array_sort(F.collect_list("tag")).alias("tags"))
    return flat.join(tags, "id", "left").join(end_times(records), "id", "left")


def merge_relationships(records: DataFrame) -> DataFrame:
    """One row per relationship id, with ends and re-activations resolved."""
    flat = records.groupBy("id").agg(
        F.any_value("src").alias("src"), F.any_value("type").alias("type"), F.any_value("dst").alias("dst"), *_common())
    return flat.join(end_times(records), "id", "left")


def merge_metadata(records: DataFrame) -> DataFrame:
    """(id, key, value, items) from ``records(id, seq, metadata map, lists map of arrays)``.

    Keys are dotted paths, so nested maps merge by themselves. The newest value of a key wins; the listed keys unite
    their items in order of first appearance.
    """
    scalars = records.select("id", "seq", F.explode("metadata").alias("key", "value"))
    newest = scalars.groupBy("id", "key").agg(F.max_by("value", "seq").alias("value"))
    lists = records.select("id", "seq", F.explode("lists").alias("key", "values"))
    united = lists.where(F.col("key").isin(UNION_KEYS)).select("id", "seq", "key", F.posexplode("values").alias("pos", "item"))
    united = united.groupBy("id", "key", "item").agg(F.min(F.struct("seq", "pos")).alias("at"))
    united = united.groupBy("id", "key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("items"))
    replaced = lists.where(~F.col("key").isin(UNION_KEYS)).groupBy("id", "key").agg(F.max_by("values", "seq").alias("items"))
    return newest.unionByName(united, True).unionByName(replaced, True)


def dedup_events(batch: DataFrame, stored: DataFrame | None = None, reparse: bool = False) -> DataFrame:
    """New events of a batch with ``state``: created, duplicate or reparsed.

    The first arrival of an id counts. A stored id is a duplicate, unless ``reparse`` and another parser read it.
    """
    whole = F.struct(*batch.columns)
    first = batch.groupBy("id").agg(F.min_by(whole, "seq").alias("r"), F.count("*").alias("copies"))
    first = first.select("r.*", (F.col("copies") - 1).alias("batch_duplicates"))
    if stored is None:
        return first.withColumn("state", F.lit("created"))
    known = stored.select("id", F.col("parser").alias("stored_parser"))
    j = first.join(known, "id", "left")
    state = F.when(F.col("stored_parser").isNull(), "created").when(
        F.lit(reparse) & (F.col("stored_parser") != F.col("parser")), "reparsed").otherwise("duplicate")
    return j.withColumn("state", state).drop("stored_parser")


def account_state(events: DataFrame) -> DataFrame:
    """(id, disabled, changed_us): the last successful enable or disable of an account decides."""
    e = events.where("event_type IN ('iam.user.disable', 'iam.user.enable') AND outcome <> 'failure'")
    last = F.max_by("event_type", F.struct("us", "id"))
    return e.groupBy(F.col("target_id").alias("object_id")).agg(
        (last == "iam.user.disable").alias("disabled"), F.max("us").alias("changed_us"))


def provenance(records: DataFrame, cap: int = 200) -> DataFrame:
    """The first ``cap`` records of each subject; the cap is part of the feature."""
    w = Window.partitionBy("subject").orderBy("seq")
    return records.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)


def ingest_report(records: DataFrame) -> DataFrame:
    """Accepted and refused records per source with the count of each reason."""
    return records.groupBy("source", F.coalesce("error", F.lit("accepted")).alias("status")).agg(F.count("*").alias("n"))


def derive_edges(events: DataFrame) -> DataFrame:
    """Relationships that events imply: (event, src, type, dst, confidence, ended).

    ``events`` has event_type, outcome, actor_id, target_id, confidence and a map ``roles`` of further involved ids
    (role to id) plus a map ``attrs``. Failed events imply nothing, except addresses and process ends.
    """
    c = F.col
    ok = F.coalesce(c("outcome") != "failure", F.lit(True))
    t, actor, target = c("event_type"), c("actor_id"), c("target_id")
    kind_a, kind_t = F.substring_index(actor, ":", 1), F.substring_index(target, ":", 1)

    def role(name: str) -> Column:
        return c("roles")[name]

    def attr(name: str) -> Column:
        return c("attrs")[name]

    def edge(cond, src, rel, dst, weight=1.0, ended=F.lit(False)):
        rel_col = rel if isinstance(rel, Column) else F.lit(rel)
        return F.when(cond & src.isNotNull() & dst.isNotNull() & (src != dst), F.struct(
            src.alias("src"), rel_col.alias("type"), dst.alias("dst"),
            F.round(F.least(c("confidence"), F.lit(float(weight))), 4).alias("confidence"), ended.alias("ended")))

    file_rel = (F.when(t == "file.create", "CREATED").when(t == "file.modify", "MODIFIED").when(t == "file.delete", "DELETED")
                .when(t == "file.read", "READ"))
    api = F.lower(c("action"))
    obj_rel = F.when(api.isin("getobject", "headobject"), "READ").when(api.isin("putobject", "copyobject"), "CREATED").when(
        api == "deleteobject", "DELETED")
    is_file, is_net, is_dns = t.startswith("file."), t.isin("network.connection", "network.flow"), t == "dns.query"
    domain = F.when(kind_t == "domain", target).otherwise(role("domain"))
    cloud = t == "cloud.api"
    rejected = F.lower(F.coalesce(attr("error_code"), F.lit(""))).isin(
        "invalidclienttokenid", "signaturedoesnotmatch", "invalidaccesskeyid", "unrecognizedclientexception", "expiredtoken",
        "expiredtokenexception", "authfailure", "invalidtoken")
    admin = F.lower(F.coalesce(attr("as_user"), F.lit(""))).isin("root", "administrator", "system", "nt authority\\system", "admin")
    login = (t == "auth.login") & ok
    edges = [
        edge(login, actor, "LOGGED_INTO", target),
        edge(login & kind_t.isin("host", "ip"), role("src_ip"), "CONNECTED_TO", target, 0.9),
        edge((t == "auth.privilege") & ok & admin & (kind_t == "host"), actor, "ADMIN_OF", target, 0.9),
        edge((t == "process.start") & ok, role("parent"), "SPAWNED", target),
        edge((t == "process.start") & ok & kind_a.isin("user", "identity"), actor, "STARTED", target),
        edge((t == "process.start") & ok, target, "EXECUTED", role("image")),
        edge((t == "process.start") & ok, role("host"), "RUNS", target),
        edge(t == "process.end", role("host"), "RUNS", target, ended=F.lit(True)),
        edge(is_file & ok & file_rel.isNotNull(), F.coalesce(role("process"), actor), file_rel, target),
        edge(is_file & ok & file_rel.isNotNull(), role("host"), "CONTAINS", target, 0.9, t == "file.delete"),
        edge(is_file & ok & file_rel.isNotNull(), role("bucket"), "CONTAINS", target, 0.95),
        edge(is_net & ok & (F.coalesce(attr("blocked"), F.lit("false")) != "true"), actor, "CONNECTED_TO", target),
        edge(is_net & role("host").startswith("host:"), role("host"), "HAS_ADDRESS", role("src_ip"), 0.8),
        edge(is_dns, actor, "RESOLVED", domain),
        edge(is_dns, domain, "RESOLVES_TO", role("answer"), 0.95),
        edge(t == "http.request", actor, "REQUESTED", target),
        edge(t == "http.request", role("domain"), "RESOLVES_TO", role("dst_ip"), 0.8),
        edge((t == "tls.handshake") & ok, actor, "CONNECTED_TO", target),
        edge(t.isin("iam.role.assign", "iam.role.remove") & ok, target, "HAS_ROLE", role("role"), ended=t == "iam.role.remove"),
        edge(t.isin("iam.group.add", "iam.group.remove") & ok, target, "MEMBER_OF", role("group"), ended=t == "iam.group.remove"),
        edge(t.isin("iam.permission.grant", "iam.permission.revoke") & ok, target, "CAN_ACCESS", role("resource"),
             ended=t == "iam.permission.revoke"),
        edge((t == "service.access") & ok, actor, "CAN_ACCESS", target, 0.8),
        edge(~rejected, role("credential"), "AUTHENTICATES_AS", actor, 0.95),
        edge(role("credential").isNotNull(), role("src_ip"), "USES", role("credential"), 0.9),
        edge(cloud & ok & (kind_t == "role"), actor, "CAN_ASSUME", target),
        edge(cloud & ok & (kind_t != "role") & kind_a.isin("user", "identity", "group", "role"), actor, "CAN_ACCESS", target, 0.7),
        edge(cloud & ok, target, "CONTAINS", role("object"), 0.95),
        edge(cloud & ok & obj_rel.isNotNull(), actor, obj_rel, role("object")),
        edge((t == "db.query") & ok, actor, "CAN_ACCESS", target, 0.8),
        edge((t == "db.query") & ok, role("host"), "RUNS", target, 0.9),
        edge((t == "policy.change") & ok, actor, "MODIFIED", target),
    ]
    return events.select(c("id").alias("event_id"), "us", F.explode(F.array_compact(F.array(*edges))).alias("e")).select(
        "event_id", "us", "e.*")
