"""Which steps of a control path an incident's own events show, and the path that matters most in each incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions import semantics as sem
from vigilframe.functions.levels import criticality_rank
from vigilframe.operators.loops import cut
from vigilframe.operators.propagate import propagate

TOP_ACTORS, TOP_PATHS = 4, 5


def active_actors(events: DataFrame, limit: int = TOP_ACTORS) -> DataFrame:
    """(incident_id, start, activity): the accounts with most events of each incident; ties by name. ``events(incident_id, event_id, us, event_type, actor_id)``."""
    who = events.where(F.substring_index("actor_id", ":", 1).isin("user", "identity"))
    counts = who.groupBy("incident_id", F.col("actor_id").alias("start")).agg(F.count("*").alias("activity"))
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("activity"), "start"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def critical_paths(reached: DataFrame, objects: DataFrame, limit: int = TOP_PATHS) -> DataFrame:
    """(start, node, criticality, confidence, hops): paths that control high or critical assets, the best of each start. ``reached`` is kept with its paths."""
    rated = objects.select(F.col("id").alias("node"), "type", "criticality")
    held = reached.where(F.col("mode") != sem.REACH).join(rated, "node").where(F.col("type").isin(sem.ASSETS) & F.col("criticality").isin("high", "critical"))
    order = [F.desc(criticality_rank(F.col("criticality"))), F.desc("conf"), "depth", "node"]
    best = held.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(*order))).where(F.col("rank") <= limit)
    part = lambda h, k: F.split_part(h, F.lit("|"), F.lit(k))
    hops = F.transform("path", lambda h: F.struct(part(h, 1).alias("source"), part(h, 2).alias("rel"), part(h, 3).alias("target")))
    return best.select("start", "node", "criticality", F.round("conf", 3).alias("confidence"), hops.alias("hops"))


def observed_paths(events: DataFrame, involved: DataFrame, paths: DataFrame) -> DataFrame:
    """The most important path of each incident: (incident_id, start, node, criticality, confidence, activity, observed_steps, hops).

    ``involved(event_id, object_id)`` are the objects of events in any role, ``paths(start, node, criticality, confidence, hops)`` the control paths of accounts.
    A hop is observed by the incident's first event with both of its ends, else by the first with its target; hops back to the start are not. The path with
    most observed steps wins, then criticality, confidence, the account's activity, and the names. ``hops`` carry (source, rel, target, event_id, us, event_type).

    Pairs of objects are formed inside one event only, and only those kept that some hop of the incident asks for, so a host that is in every event costs no more
    than its events.
    """
    own = cut(events.select("incident_id", "event_id", "us", "event_type").distinct())
    actors = cut(active_actors(events))
    asked = actors.join(paths, "start").select("incident_id", "start", "activity", "node", "criticality", "confidence", F.posexplode("hops").alias("pos", "hop"))
    asked = cut(asked.select("*", "hop.source", "hop.rel", "hop.target").drop("hop"))
    seen = own.join(involved.select("event_id", "object_id").distinct(), "event_id")
    at = F.struct("us", "event_id", "event_type")
    targets = asked.select("incident_id", F.col("target").alias("object_id")).distinct()
    single = seen.join(targets, ["incident_id", "object_id"], "left_semi").groupBy("incident_id", F.col("object_id").alias("target")).agg(F.min(at).alias("first_one"))
    wanted = asked.select("incident_id", "source", "target").distinct()
    ends = seen.join(wanted.select("incident_id", F.explode(F.array("source", "target")).alias("object_id")).distinct(), ["incident_id", "object_id"], "left_semi")
    a = ends.select("incident_id", "event_id", "us", "event_type", F.col("object_id").alias("source"))
    b = ends.select("incident_id", "event_id", F.col("object_id").alias("target"))
    pair = a.join(b, ["incident_id", "event_id"]).join(wanted, ["incident_id", "source", "target"], "left_semi")
    double = pair.groupBy("incident_id", "source", "target").agg(F.min(at).alias("first_both"))
    marked = asked.join(single, ["incident_id", "target"], "left").join(double, ["incident_id", "source", "target"], "left")
    event = F.when((F.col("target") != F.col("start")) & F.col("first_one").isNotNull(), F.coalesce("first_both", "first_one"))
    step = F.struct("pos", "source", "rel", "target", event.alias("e"))
    g = marked.groupBy("incident_id", "start", "node", "criticality", "confidence", "activity").agg(F.count(event).alias("observed_steps"), F.array_sort(F.collect_list(step)).alias("steps"))
    rank = F.coalesce(criticality_rank(F.col("criticality")), F.lit(-1))
    order = F.struct(-F.col("observed_steps"), -rank, -F.col("confidence"), -F.col("activity"), F.col("start"), F.col("node"))
    best = F.min_by(F.struct("start", "node", "criticality", "confidence", "activity", "observed_steps", "steps"), order)
    hop = lambda s: F.struct(s["source"].alias("source"), s["rel"].alias("rel"), s["target"].alias("target"), s["e"]["event_id"].alias("event_id"), s["e"]["us"].alias("us"), s["e"]["event_type"].alias("event_type"))
    return g.groupBy("incident_id").agg(best.alias("b")).select("incident_id", "b.start", "b.node", "b.criticality", "b.confidence", "b.activity", "b.observed_steps", F.transform("b.steps", hop).alias("hops"))


def incident_paths(events: DataFrame, involved: DataFrame, steps: DataFrame, objects: DataFrame, max_depth: int = 6, min_confidence: float = 0.2, upgrades: DataFrame | None = None) -> DataFrame:
    """``observed_paths`` over the control paths of the incidents' most active accounts; only these are searched."""
    starts = cut(active_actors(events).select("start").distinct())
    reached = propagate(steps, starts, max_depth, min_confidence, upgrades=upgrades, keep_path=True)
    return observed_paths(events, involved, cut(critical_paths(reached, objects)))
