"""Packets to flows, and pairing of requests with responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "us div 3600000000"  # hours

# TCP flag bits and the applications of well-known server ports.
SYN, ACK = 0x02, 0x10
PORT_APPS = {53: "dns", 80: "http", 8080: "http", 443: "tls", 8443: "tls"}


def _side(c: str):
    return F.struct(F.col(f"{c}_ip").alias("ip"), F.col(f"{c}_port").alias("port"))


def fill_fragments(packets: DataFrame) -> DataFrame:
    """Later IP fragments take the ports of the first fragment of their datagram: one aggregate and one join per datagram key."""
    key = ["src_ip", "dst_ip", "ip_proto", "ip_id"]
    first = packets.where("fragment_offset = 0 AND more_fragments").groupBy(*key).agg(
        F.min("src_port").alias("p_src"), F.min("dst_port").alias("p_dst"))
    later = packets.where("fragment_offset > 0").join(first, key, "left")
    later = later.withColumns({"src_port": F.coalesce("src_port", "p_src"), "dst_port": F.coalesce("dst_port", "p_dst")}).drop("p_src", "p_dst")
    return packets.where("fragment_offset = 0").unionByName(later)


def assemble(packets: DataFrame) -> DataFrame:
    """One row per bidirectional flow: canonical end points, per-side counters, first and last time, flags, orientation.

    Counters, extremes and flag unions are all combined before the shuffle, so an elephant flow costs one row per task.
    """
    forward = _side("src") <= _side("dst")
    p = packets.withColumns({
        "a": F.when(forward, _side("src")).otherwise(_side("dst")), "b": F.when(forward, _side("dst")).otherwise(_side("src")), "fwd": forward})
    flags = F.coalesce("tcp_flags", F.lit(0))
    syn = (flags.bitwiseAND(F.lit(SYN)) > 0) & (flags.bitwiseAND(F.lit(ACK)) == 0)
    syn_ack = (flags.bitwiseAND(F.lit(SYN)) > 0) & (flags.bitwiseAND(F.lit(ACK)) > 0)

    def total(cond, col):
        return F.sum(F.when(cond, F.col(col)).otherwise(0))

    f = p.groupBy(F.col("a.ip").alias("a_ip"), F.col("a.port").alias("a_port"), F.col("b.ip").alias("b_ip"), F.col("b.port").alias("b_port"), "ip_proto").agg(
        F.count_if("fwd").alias("a_packets"), F.count_if(~F.col("fwd")).alias("b_packets"), total(F.col("fwd"), "ip_bytes").alias("a_bytes"),
        total(~F.col("fwd"), "ip_bytes").alias("b_bytes"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.bit_or(flags).alias("flags"),
        F.bool_or(F.col("fwd") & syn).alias("a_syn"), F.bool_or(~F.col("fwd") & syn).alias("b_syn"),
        F.bool_or(F.col("fwd") & syn_ack).alias("a_sa"), F.bool_or(~F.col("fwd") & syn_ack).alias("b_sa"),
        F.min_by("fwd", F.struct("us", "number")).alias("a_first"))
    a_service, b_service = F.col("a_port") < 1024, F.col("b_port") < 1024
    a_client = (
        F.when(F.col("a_syn") != F.col("b_syn"), F.col("a_syn")).when(F.col("a_sa") != F.col("b_sa"), F.col("b_sa"))
        .when(a_service != b_service, b_service).otherwise(F.col("a_first")))
    why = (F.when(F.col("a_syn") != F.col("b_syn"), "syn").when(F.col("a_sa") != F.col("b_sa"), "syn-ack")
           .when(a_service != b_service, "service port").otherwise("first packet"))
    f = f.withColumns({"a_is_client": a_client, "evidence": why, "server_port": F.when(a_client, F.col("b_port")).otherwise(F.col("a_port"))})
    app = F.lit("other")
    for port, name in PORT_APPS.items():
        app = F.when((F.col("server_port") == port) & F.col("ip_proto").isin(6, 17), name).otherwise(app)
    ident = F.substring(F.sha2(F.concat_ws("\x1f", F.col("ip_proto").cast("string"), "a_ip", F.col("a_port").cast("string"), "b_ip", F.col("b_port").cast("string")), 256), 1, 24)
    return f.withColumns({"application": app, "flow_id": ident})


def protocol_counters(packets: DataFrame) -> DataFrame:
    return packets.select(F.explode(F.array_distinct("protocols")).alias("protocol"), "ip_bytes").groupBy("protocol").agg(
        F.count("*").alias("packets"), F.sum("ip_bytes").alias("bytes"))


def dns_pairs(messages: DataFrame) -> DataFrame:
    """Queries with their responses by (client, server, ports, id, name, type): first query and first response."""
    key = ["client", "server", "client_port", "server_port", "txid", "name", "qtype"]
    return messages.groupBy(*key).agg(
        F.min(F.when(~F.col("response"), F.col("us"))).alias("query_us"), F.min(F.when(F.col("response"), F.col("us"))).alias("response_us"),
        F.count_if(~F.col("response")).alias("queries"))


def ordered_pairs(messages: DataFrame, key: str = "flow_id") -> DataFrame:
    """The n-th request of a flow with its n-th response.

    Messages are numbered inside hour blocks; a running sum over block counts turns that into the number within the flow, so a long flow
    is never ordered in one task.
    """
    m = messages.withColumn("block", F.expr(BLOCK))
    counts = m.groupBy(key, "response", "block").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy(key, "response").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    inside = m.withColumn("i", F.row_number().over(Window.partitionBy(key, "response", "block").orderBy("us", "number")))
    n = inside.join(counts, [key, "response", "block"]).withColumn("n", (F.col("before") + F.col("i")).cast("int"))
    req = n.where("NOT response").select(key, "n", F.col("us").alias("request_us"))
    res = n.where("response").select(key, "n", F.col("us").alias("response_us"))
    return req.join(res, [key, "n"], "left")


def handshakes(hellos: DataFrame, key: str = "flow_id") -> DataFrame:
    """Each server hello with the last client hello before it, looked up in its hour first and then in earlier hours."""
    client = F.when(F.col("role") == "client", F.col("us"))
    h = hellos.withColumn("block", F.expr(BLOCK))
    blocks = h.groupBy(key, "block").agg(F.max(client).alias("last_client"))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.max("last_client").over(earlier)).drop("last_client")
    w = Window.partitionBy(key, "block").orderBy("us", "number").rowsBetween(Window.unboundedPreceding, -1)
    near = h.withColumn("near", F.max(client).over(w)).where("role = 'server'").join(blocks, [key, "block"])
    return near.select(key, F.col("us").alias("server_us"), F.coalesce("near", "carried").alias("client_us"))


def flow_events(flows: DataFrame) -> DataFrame:
    """Flows as ``network.flow`` events from client to server."""
    client = F.when(F.col("a_is_client"), F.col("a_ip")).otherwise(F.col("b_ip"))
    server = F.when(F.col("a_is_client"), F.col("b_ip")).otherwise(F.col("a_ip"))
    out = F.when(F.col("a_is_client"), F.col("a_bytes")).otherwise(F.col("b_bytes"))
    return flows.select(
        F.concat(F.lit("event:"), "flow_id").alias("id"), F.col("first_us").alias("us"), F.lit("network.flow").alias("event_type"),
        F.concat(F.lit("ip:"), client).alias("actor_id"), F.concat(F.lit("ip:"), server).alias("target_id"), "server_port", out.alias("bytes_out"),
        (F.col("a_bytes") + F.col("b_bytes") - out).alias("bytes_in"), "application")
