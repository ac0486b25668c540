"""Streams in several micro-batches: late and out-of-order events, time-outs, state that goes away, and zones as in batch."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from vigilframe.operators.network import most_specific
from vigilframe.streaming import operators as st

SCHEMA = "id string, us long, event_type string, actor_id string, target_id string"
MINUTE, HOUR = 60_000_000, 3_600_000_000


def in_batches(spark, tmp_path, batches, build, schema=SCHEMA):
    """One micro-batch for each list of rows, in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        rows = []
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        for n in range(len(batches)):
            spark.read.parquet(f"{tmp_path}/in{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = (build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
            rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else None)
        return spark.read.parquet(f"{tmp_path}/out").collect(), rows
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def plain(events, timeout):
    out = []
    for (actor, target), group in itertools.groupby(sorted(events, key=lambda e: (e[3], e[4], e[1], e[0])), key=lambda e: (e[3], e[4])):
        since = None
        for _, us, kind, *_ in group:
            if since is not None and since + timeout <= us:
                out.append((actor, target, since + timeout, "expired"))
                since = None
            if kind == "auth.login" and since is None:
                since = us
                out.append((actor, target, us, "opened"))
            elif kind != "auth.login" and since is not None:
                since = None
                out.append((actor, target, us, "closed"))
        if since is not None:
            out.append((actor, target, since + timeout, "expired"))
    return sorted(out)


def test_sessions_out_of_order_across_batches(spark, tmp_path):
    rng = random.Random(3)
    base = 1_700_000_000_000_000
    events = [(f"e{k:04}", base + rng.randrange(40 * 60) * MINUTE // 3, rng.choice(["auth.login", "auth.logout", "auth.logout"]), f"u{rng.randrange(3)}", f"h{rng.randrange(2)}") for k in range(500)]
    late = sorted(events, key=lambda e: e[1] + rng.randrange(50) * MINUTE)  # arrives up to 50 minutes late
    cut = len(late) // 2
    end = [("z", base + 100 * HOUR, "auth.logout", "end", "end")]
    timeout = 5 * HOUR // 4
    found, kept = in_batches(spark, tmp_path, [late[:cut], late[cut:], end], lambda s: st.open_sessions(s, "1 hour", timeout))
    assert sorted(tuple(r) for r in found if r.actor_id != "end") == plain(events, timeout)
    assert {r.change for r in found} == {"opened", "closed", "expired"}
    assert kept[0] > 0 and kept[-1] <= 2  # the end's own waiting event and timer


def test_late_logout_closes_the_right_session(spark, tmp_path):
    t = 1_700_000_000_000_000
    first = [("a", t, "auth.login", "u", "h"), ("c", t + 20 * MINUTE, "auth.login", "u", "h")]
    second = [("b", t + 10 * MINUTE, "auth.logout", "u", "h")]
    end = [("z", t + 9 * HOUR, "auth.logout", "end", "end")]
    found, _ = in_batches(spark, tmp_path, [first, second, end], lambda s: st.open_sessions(s, "1 hour", HOUR))
    assert sorted((r.us - t, r.change) for r in found) == [(0, "opened"), (10 * MINUTE, "closed"), (20 * MINUTE, "opened"), (80 * MINUTE, "expired")]


def test_stream_zones_equal_batch_zones(spark, tmp_path):
    nets = spark.createDataFrame([("10.0.0.0/8", "corp"), ("10.1.0.0/16", "lab"), ("10.1.2.3/32", "one"), ("2001:db8::/32", "six"), ("2001:db8:1::/48", "sub"), ("0.0.0.0/0", "world")], "cidr string, zone string")
    ips = ["10.1.2.3", "10.1.9.9", "10.200.0.1", "8.8.8.8", "2001:db8::1", "2001:db8:1::5", "2001:dead::1", "::ffff:10.1.2.3", "nonsense", None]
    found = st.run_available(spark, lambda s: st.zoned(s, "src_ip", nets), spark.createDataFrame([(i,) for i in ips], "src_ip string"), ["src_ip", "zone"])
    batch = most_specific(spark.createDataFrame([(i,) for i in ips], "src_ip string"), "src_ip", nets, "zone").select("src_ip", "zone")
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert found.where("zone IS NOT NULL").count() == 7 and found.where(F.col("src_ip") == "2001:db8:1::5").first().zone == "sub"
