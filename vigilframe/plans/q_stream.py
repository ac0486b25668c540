"""Streaming queries: each runs over all events with the availableNow trigger.

A sentinel event far in the future moves the watermark past every real window, so an append-mode stream emits them all.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators.filters import EventFilter
from vigilframe.operators.loops import cut
from vigilframe.plans.registry import query
from vigilframe.streaming import operators as st

H = 3_600_000_000
FAR = 4_000_000_000_000_000


def events(t, sentinel: bool = True):
    e = t.ev.select("id", "us", "event_type", "actor_id", "target_id", "severity_rank", F.timestamp_micros("us").alias("ts"))
    if not sentinel:
        return e
    end = t.region.where("r_regionkey = 0").select(
        F.lit("end").alias("id"), F.lit(FAR).alias("us"), F.lit("end").alias("event_type"), F.lit("end").alias("actor_id"), F.lit("end").alias("target_id"),
        F.lit(0).alias("severity_rank"), F.timestamp_micros(F.lit(FAR)).alias("ts"))
    return e.unionByName(end)


@query("st_dedup", "ev", "SELECT id FROM ev")
def st_dedup(t):
    e = events(t, False)
    return st.run_available(t.spark, st.dedup, e.unionByName(e), ["id"])


@query("st_tumbling", "ev", f"SELECT us // {H} * {H} AS start_us, event_type, count(*) AS n FROM ev GROUP BY ALL")
def st_tumbling(t):
    return st.run_available(t.spark, st.tumbling, events(t), ["start_us", "event_type", "n"])


@query("st_sliding", "ev",
       f"SELECT s AS start_us, actor_id, count(*) AS n FROM (SELECT actor_id, unnest([us // {H} * {H}, us // {H} * {H} - {H}]) AS s FROM ev) GROUP BY ALL")
def st_sliding(t):
    return st.run_available(t.spark, lambda s: st.sliding(s, "2 hours", "1 hour"), events(t), ["start_us", "actor_id", "n"])


@query("st_session", "ev",
       f"""SELECT actor_id, min(us) AS start_us, max(us) + {2 * H} AS end_us, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY actor_id ORDER BY us, id) AS grp FROM (SELECT *, CASE WHEN us - lag(us) OVER
       (PARTITION BY actor_id ORDER BY us, id) < {2 * H} THEN 0 ELSE 1 END AS nw FROM ev)) GROUP BY actor_id, grp""")
def st_session(t):
    return st.run_available(t.spark, lambda s: st.sessions(s, "2 hours"), events(t), ["actor_id", "start_us", "end_us", "n"])


@query("st_filter", "ev",
       """SELECT id, CASE WHEN src_ip LIKE '10.10.%' THEN CASE WHEN CAST(split_part(src_ip, '.', 3) AS INT) % 2 = 0 THEN 'net-' || split_part(src_ip, '.', 3) ELSE 'corp' END WHEN CAST(split_part(src_ip, '.', 4) AS INT) < 16 THEN
       'dmz' END AS zone FROM ev WHERE severity_rank >= 3 AND (event_type = 'auth' OR event_type LIKE 'auth.%')""")
def st_filter(t):
    """Alerts with the zone of their source, from a zone table of several prefix lengths."""
    wanted = EventFilter(event_types=("auth",), min_severity="HIGH")
    zones = t.ev.where("k < 80 AND k % 2 = 0").select(F.concat(F.lit("10.10."), (F.col("k") % 4).cast("string"), F.lit(".0/24")).alias("cidr"), F.concat(F.lit("net-"), (F.col("k") % 4).cast("string")).alias("zone")).distinct()
    fixed = t.spark.createDataFrame([("10.0.0.0/8", "corp"), ("198.51.100.0/28", "dmz"), ("2001:db8::/32", "six")], "cidr string, zone string")
    table = cut(zones.unionByName(fixed))
    e = t.ev.select("id", "us", "event_type", "actor_id", "target_id", "severity_rank", "src_ip", F.timestamp_micros("us").alias("ts"))
    return st.run_available(t.spark, lambda s: st.zoned(st.alerts(s, wanted), "src_ip", table), e, ["id", "zone"])


TIMEOUT = 10 * 365 * 86_400_000_000  # longer than the table: only what is open at its end expires


@query("st_state", "ev",
       f"""WITH c AS (SELECT actor_id, target_id, us, id, event_type = 'auth.login' AS login, lag(event_type = 'auth.login') OVER w AS was, lead(id) OVER w IS NULL AS last FROM ev WHERE event_type LIKE 'auth.%'
       WINDOW w AS (PARTITION BY actor_id, target_id ORDER BY us, id)), x AS (SELECT *, login AND (was IS NULL OR NOT was) AS op FROM c)
       SELECT actor_id, target_id, us, CASE WHEN login THEN 'opened' ELSE 'closed' END AS change FROM x WHERE op OR (NOT login AND was)
       UNION ALL SELECT actor_id, target_id, max(us) FILTER (op) + {TIMEOUT}, 'expired' FROM x GROUP BY ALL HAVING bool_or(last AND login)""")
def st_state(t):
    e = events(t).where("event_type LIKE 'auth.%' OR id = 'end'")
    return st.run_available(t.spark, lambda s: st.open_sessions(s, timeout_us=TIMEOUT), e, ["actor_id", "target_id", "us", "change"]).where("actor_id <> 'end'")
