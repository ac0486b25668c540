"""Streaming forms of the event operators.

Each takes a streaming (or batch) DataFrame of events with a timestamp column ``ts`` and returns a DataFrame; ``run_available`` drives a
stream over everything that is there and writes the result as files, which is how the batch results are compared.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilframe.operators import decisions
from vigilframe.operators.filters import EventFilter
from vigilframe.operators.loops import shared_dir


def dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each event id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 hour", key: str = "event_type") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return w.select(F.unix_micros("window.start").alias("start_us"), key, "n")


def sliding(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", delay: str = "1 hour", key: str = "actor_id") -> DataFrame:
    """Counts in overlapping windows: the streaming approximation of the exact sliding maximum."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), key).agg(F.count("*").alias("n"))
    return w.select(F.unix_micros("window.start").alias("start_us"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", key: str = "actor_id") -> DataFrame:
    """Activity sessions: closed after a gap without events."""
    w = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return w.select(F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), key, "n")


def alerts(events: DataFrame, wanted: EventFilter) -> DataFrame:
    """Stateless alert filter."""
    return events.where(wanted.column())


def zoned(events: DataFrame, address: str, networks: DataFrame, zone: str = "zone", cidr: str = "cidr") -> DataFrame:
    """Events with the ``zone`` of the smallest network around an address of either family; null where there is none.

    One stream-static join for each prefix length in use when the stream starts (at most 129, most specific first), by the key of the enclosing network; there is
    no state, and the static side is read again in every micro-batch.
    """
    nets = networks.select(F.col(zone).alias("zone_"), decisions.network(cidr).alias("net")).where("net IS NOT NULL").groupBy("net").agg(F.min("zone_").alias("zone_"))
    lengths = sorted((r[0] for r in nets.select("net.len").distinct().collect()), reverse=True)
    out, found = events.withColumn("at_", decisions.network(address)), []
    for n in lengths:
        side = nets.where(F.col("net.len") == n).select(F.col("net").alias(f"net_{n}"), F.col("zone_").alias(f"zone_{n}"))
        out = out.join(side, decisions.enclosing("at_", n) == F.col(f"net_{n}"), "left").drop(f"net_{n}")
        found.append(F.when(F.col("at_.len") >= n, F.col(f"zone_{n}")))
    return out.withColumn(zone, F.coalesce(*found) if found else F.lit(None).cast("string")).drop("at_", *(f"zone_{n}" for n in lengths))


BUCKET_MS = 1_800_000
FLUSH = 16_384
SHARDS = 64
KEPT = 400_000


class OpenSessions(StatefulProcessor):
    """Sessions of all (actor, host) of one shard in event time: ``opened``, ``closed``, or ``expired`` when no logout came within the time-out.

    Events wait in buckets of half an hour until the watermark has passed the bucket; its timer then takes them in the order of their time, however they arrived.
    Every access to the state is a message to the JVM, so pairs share the buckets and timers of their shard, and the sessions of at most ``most`` pairs are kept from
    a shard's first timer in a batch to the last of its waiting buckets. Rows are read one by one; what is held of them is at most ``FLUSH`` rows and, later, one
    bucket. A pair without an open session and a waiting event has at
    most its place in the bucket of a time-out that is not over.
    """

    def __init__(self, timeout_us: int, most: int = KEPT):
        self.timeout_us, self.most = timeout_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getMapState("since", "actor_id string, target_id string", "us bigint")
        self.waiting = handle.getMapState("waiting", "until bigint", "events array<struct<actor_id:string,target_id:string,us:bigint,id:string,login:boolean>>")
        self.due = handle.getMapState("due", "until bigint", "sessions array<struct<actor_id:string,target_id:string,us:bigint>>")
        # per shard: buckets that this batch has still to take, and (session, session in the state) of pairs; shards that have no session in the state
        self.left: dict[int, set[int]] = {}
        self.kept: dict[int, dict[tuple, tuple]] = {}
        self.bare: set[int] = set()

    def _put(self, state, rows: dict[int, list[tuple]]) -> None:
        for until, found in rows.items():
            before = state.getValue((until,))
            if before is None:
                self.handle.registerTimer(until)
            else:
                found = [*(tuple(e) for e in before[0]), *found]
            state.updateValue((until,), (found,))

    def _take(self, state, at: int) -> list[tuple]:
        found = state.getValue((at,))
        if found is None:
            return []
        state.removeKey((at,))
        return [tuple(e) for e in found[0]]

    def handleInputRows(self, key, rows, timerValues):
        fresh: dict[int, list[tuple]] = {}
        n = 0
        for row in rows:
            until = (row["us"] // 1000 // BUCKET_MS + 1) * BUCKET_MS
            fresh.setdefault(until, []).append((row["actor_id"], row["target_id"], row["us"], row["id"], row["event_type"] == "auth.login"))
            n += 1
            if n % FLUSH == 0:
                self._put(self.waiting, fresh)
                fresh = {}
        self._put(self.waiting, fresh)
        return iter(())

    def _get(self, shard: int, pair: tuple) -> tuple:
        if pair in self.kept[shard]:
            return self.kept[shard][pair]
        found = None if shard in self.bare else self.since.getValue(pair)
        return (None, None) if found is None else (found[0], found[0])

    def _set(self, shard: int, pair: tuple, since: int | None, stored: int | None) -> None:
        if since == stored:
            self.kept[shard].pop(pair, None)
        else:
            self.kept[shard][pair] = (since, stored)
            if sum(map(len, self.kept.values())) > self.most:
                self._store(shard)

    def _store(self, shard: int) -> None:
        for pair, (since, _) in self.kept[shard].items():
            self.bare.discard(shard)
            if since is None:
                self.since.removeKey(pair)
            else:
                self.since.updateValue(pair, (since,))
        self.kept[shard] = {}

    def _taken(self, shard: int, at: int):
        """The events of a bucket, in the order of their time."""
        due: dict[int, list[tuple]] = {}
        for actor, target, us, _, login in sorted(self._take(self.waiting, at), key=lambda e: (e[2], e[3], e[4])):
            since, stored = self._get(shard, (actor, target))
            if since is not None and since + self.timeout_us <= us:
                yield Row(actor_id=actor, target_id=target, us=since + self.timeout_us, change="expired")
                since = None
            if login and since is None:
                since = us
                due.setdefault(-(-(us + self.timeout_us) // 1000 // BUCKET_MS) * BUCKET_MS, []).append((actor, target, us))
                yield Row(actor_id=actor, target_id=target, us=us, change="opened")
            elif not login and since is not None:
                since = None
                yield Row(actor_id=actor, target_id=target, us=us, change="closed")
            self._set(shard, (actor, target), since, stored)
        self._put(self.due, due)

    def _timed_out(self, shard: int, at: int):
        """Sessions whose time-out lies in a bucket and that are still open; everything before it has been taken."""
        for actor, target, us in self._take(self.due, at):
            since, stored = self._get(shard, (actor, target))
            if since == us:
                self._set(shard, (actor, target), None, stored)
                yield Row(actor_id=actor, target_id=target, us=us + self.timeout_us, change="expired")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, known, shard = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), key[0]
        first = shard not in self.left
        if first:
            self.left[shard] = {until for (until,) in list(self.waiting.keys()) if until <= known}
            self.kept[shard] = {}
            if not self.since.exists():
                self.bare.add(shard)
        left = self.left[shard]
        taken = at in left
        if taken:
            left.remove(at)
            yield from self._taken(shard, at)
        if left:
            yield from self._timed_out(shard, at)
        elif first or taken:
            # nothing is left to take: the watermark is as far as is known, also for time-outs whose timers are new
            for until in sorted(until for (until,) in list(self.due.keys()) if until <= known):
                yield from self._timed_out(shard, until)
            self._store(shard)

    def close(self) -> None:
        pass


def open_sessions(events: DataFrame, delay: str = "1 hour", timeout_us: int = 30 * 86_400_000_000, most: int = KEPT) -> DataFrame:
    """(actor_id, target_id, us, change): session changes of logins and logouts that may arrive up to ``delay`` late and out of order.

    A login while a session is open and a logout while none is are ignored. Needs the RocksDB state store. Later rows than the delay are dropped.
    """
    shard = F.pmod(F.xxhash64("actor_id", "target_id"), F.lit(SHARDS)).alias("shard")
    keyed = events.select("actor_id", "target_id", "us", "id", "event_type", shard, F.timestamp_micros("us").alias("at")).withWatermark("at", delay).groupBy("shard")
    return keyed.transformWithState(OpenSessions(timeout_us, most), "actor_id string, target_id string, us bigint, change string", "Append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(spark: SparkSession, build, source: DataFrame, schema_cols: list[str]) -> DataFrame:
    """Write ``source`` as files, stream them through ``build`` with the availableNow trigger, and read the output.

    The query keeps its state in RocksDB; the session's own setting is put back.
    """
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{base}/in")
    result = build(stream)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        q = (
            result.select(*schema_cols).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(setting, before)
    q.awaitTermination()
    return spark.read.schema(result.select(*schema_cols).schema).parquet(f"{base}/out")
