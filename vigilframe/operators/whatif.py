"""What-if models: an operation is removed edges, added edges, and patched objects; nothing is changed in place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["src", "type", "dst"]
NETWORK = ["CAN_REACH", "CONNECTED_TO", "MEMBER_OF"]


@dataclass
class State:
    edges: DataFrame
    objects: DataFrame


@dataclass
class Effects:
    removed: DataFrame | None = None  # (src, type, dst)
    added: DataFrame | None = None  # (src, type, dst)
    patched: DataFrame | None = None  # (id, column..., non-null values replace)
    new_objects: DataFrame | None = None


def apply(state: State, effects: Effects) -> State:
    edges, objects = state.edges, state.objects
    if effects.removed is not None:
        edges = edges.join(effects.removed.select(*KEY).distinct(), KEY, "left_anti")
    if effects.added is not None:
        fresh = effects.added.select(*KEY).distinct().join(edges.select(*KEY), KEY, "left_anti")
        edges = edges.unionByName(fresh.withColumn("conf", F.lit(1.0)), allowMissingColumns=True)
    if effects.new_objects is not None:
        objects = objects.unionByName(effects.new_objects, allowMissingColumns=True)
    if effects.patched is not None:
        columns = [c for c in effects.patched.columns if c != "id"]
        p = effects.patched.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
        objects = objects.join(p, "id", "left").select(
            *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in objects.columns])
    return State(edges, objects)


def remove_relationships(state: State, cond: Column) -> Effects:
    return Effects(removed=state.edges.where(cond).select(*KEY))


def disable_identity(state: State, ids: list[str]) -> Effects:
    hit = state.objects.where(F.col("id").isin(ids) & F.col("type").isin("user", "identity"))
    return Effects(patched=hit.select("id", F.lit(True).alias("disabled")))


def change_role(state: State, principal: str, old: str | None, new: str | None) -> Effects:
    """Take a role away, give one, or both."""
    removed = state.edges.where((F.col("src") == principal) & (F.col("type") == "HAS_ROLE") & (F.col("dst") == old)).select(*KEY) if old else None
    added = state.objects.where(F.col("id") == new).select(
        F.lit(principal).alias("src"), F.lit("HAS_ROLE").alias("type"), F.col("id").alias("dst")) if new else None
    return Effects(removed, added)


def segment(state: State, source: str, target: str) -> Effects:
    return remove_relationships(state, (F.col("type") == "CAN_REACH") & (F.col("src") == source) & (F.col("dst") == target))


def isolate(state: State, host: str) -> Effects:
    touches = (F.col("src") == host) | (F.col("dst") == host)
    net = F.col("type").isin("CAN_REACH", "CONNECTED_TO") | ((F.col("type") == "MEMBER_OF") & F.col("dst").startswith("network:"))
    return remove_relationships(state, touches & net)


def remove_exposure(state: State, host: str, external: DataFrame) -> Effects:
    """Move a host from every externally reachable zone to an internal twin that keeps all other reachability.

    ``external(id)`` names the external zones.
    """
    ext = external.select(F.col("id").alias("src"))
    reach = state.edges.where("type = 'CAN_REACH'").select(*KEY)
    from_outside = reach.join(ext, "src", "left_semi")
    direct = from_outside.where(F.col("dst") == host)
    home = state.edges.where((F.col("src") == host) & (F.col("type") == "MEMBER_OF") & F.col("dst").startswith("network:")).select(*KEY)
    moved = home.join(from_outside.select("dst").distinct(), "dst", "left_semi").select(*KEY)
    zone = moved.select(F.col("dst").alias("zone")).distinct()
    twin = F.concat("zone", F.lit("-internal"))
    out = reach.join(zone, F.col("src") == F.col("zone")).select(twin.alias("src"), "type", "dst")
    inward = reach.join(ext, "src", "left_anti").join(zone, F.col("dst") == F.col("zone")).select("src", "type", twin.alias("dst"))
    member = moved.select("src", "type", F.concat("dst", F.lit("-internal")).alias("dst"))
    names = zone.select(twin.alias("id"), F.lit("network").alias("type"), twin.alias("name"), F.lit(False).alias("internet"))
    return Effects(direct.unionByName(moved), out.unionByName(inward).unionByName(member), None, names)


def patch_vulnerability(state: State, vulnerability: str, asset: str | None = None) -> Effects:
    cond = (F.col("type") == "AFFECTS") & (F.col("src") == vulnerability)
    return remove_relationships(state, cond & (F.col("dst") == asset) if asset else cond)


def compare(before: State, after: State) -> DataFrame:
    """Edges added and removed between two states, per type."""
    from vigilframe.operators.lifecycle import compare_keys

    d = compare_keys(before.edges.select(*KEY).distinct(), after.edges.select(*KEY).distinct(), KEY)
    return d.where("status <> 'common'").groupBy("type", "status").agg(F.count("*").alias("n"))


def compare_control(before: DataFrame, after: DataFrame) -> DataFrame:
    """(start, lost, gained): assets each principal no longer or newly controls; inputs are (start, node)."""
    from vigilframe.operators.lifecycle import compare_keys

    d = compare_keys(before.select("start", "node"), after.select("start", "node"), ["start", "node"])
    return d.where("status <> 'common'").groupBy("start").agg(
        F.count_if(F.col("status") == "removed").alias("lost"), F.count_if(F.col("status") == "added").alias("gained"))
