"""Event, object, edge, finding and packet predicates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.levels import SEVERITIES

EPSILON = 1e-6  # step between a strict and an inclusive confidence bound
TICK_US = 1  # step between a strict and an inclusive time bound


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def type_matches(column: Column, wanted: list[str]) -> Column:
    """Exact dotted types; ``auth.*`` and bare ``auth`` match the type itself and everything under it."""
    parts = []
    for text in (w.strip() for w in wanted):
        stem = text.removesuffix(".*")
        if text.endswith(".*") or "." not in text:
            parts.append((column == stem) | column.startswith(stem + "."))
        else:
            parts.append(column == text)
    return _any(parts)


def type_overlap(a: str, b: str) -> str | None:
    """The narrower of two type patterns when one contains the other."""

    def stem(t: str) -> tuple[str, bool]:
        return t.removesuffix(".*"), t.endswith(".*") or "." not in t

    (sa, pa), (sb, pb) = stem(a), stem(b)
    if sa == sb:
        return a if not pa else b
    if pa and sb.startswith(sa + "."):
        return b
    if pb and sa.startswith(sb + "."):
        return a
    return None


@dataclass(frozen=True)
class EventFilter:
    """What to keep; every set field narrows the selection, and contradictions empty it."""

    start_us: int | None = None
    end_us: int | None = None
    event_types: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    object_groups: tuple[tuple[str, ...], ...] = ()
    actor: str | None = None
    target: str | None = None
    outcome: str | None = None
    synthetic: bool | None = None
    incident_id: str | None = None
    job_ids: tuple[str, ...] | None = None
    event_ids: tuple[str, ...] | None = None
    min_severity: str | None = None
    max_severity: str | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    source: str | None = None
    texts: tuple[str, ...] = ()
    nothing: bool = False

    def after(self, us: int) -> EventFilter:
        return replace(self, start_us=us + TICK_US)

    def before(self, us: int) -> EventFilter:
        return replace(self, end_us=us - TICK_US)

    def narrow(self, other: EventFilter) -> EventFilter:
        """Both filters at once."""
        out: dict = {"nothing": self.nothing or other.nothing}

        def pick(name, chooser):
            mine, theirs = getattr(self, name), getattr(other, name)
            out[name] = theirs if mine is None else mine if theirs is None else chooser(mine, theirs)

        def rank_max(a, b):
            return max(a, b, key=SEVERITIES.index)

        def rank_min(a, b):
            return min(a, b, key=SEVERITIES.index)

        for name, chooser in (
            ("start_us", max), ("end_us", min), ("min_confidence", max), ("max_confidence", min),
            ("min_severity", rank_max), ("max_severity", rank_min),
        ):
            pick(name, chooser)
        for name in ("categories", "job_ids", "event_ids"):
            pick(name, lambda a, b: tuple(x for x in a if x in set(b)))
            if getattr(self, name) is not None and out[name] == ():
                out["nothing"] = True

        def overlap(a, b):
            pairs = [type_overlap(x, y) for x in a for y in b]
            return tuple(dict.fromkeys(p for p in pairs if p))

        pick("event_types", overlap)
        if self.event_types and other.event_types and not out["event_types"]:
            out["nothing"] = True
        for name in ("actor", "target", "outcome", "synthetic", "incident_id", "source"):
            mine, theirs = getattr(self, name), getattr(other, name)
            if name == "source" and mine and theirs and mine != theirs:
                out[name] = mine if theirs.lower() in mine.lower() else theirs
                out["nothing"] = out["nothing"] or not (
                    theirs.lower() in mine.lower() or mine.lower() in theirs.lower()
                )
                continue
            if mine is not None and theirs is not None and mine != theirs:
                out["nothing"] = True
            out[name] = theirs if mine is None else mine
        out["object_groups"] = self.object_groups + other.object_groups
        out["texts"] = tuple(dict.fromkeys(self.texts + other.texts))
        return EventFilter(**out)

    def column(self) -> Column:
        """The part of the filter that looks at one event row only; reaches the Parquet scan."""
        if self.nothing:
            return F.lit(False)
        c, parts = F.col, []
        if self.start_us is not None:
            parts.append(c("us") >= self.start_us)
        if self.end_us is not None:
            parts.append(c("us") <= self.end_us)
        if self.event_types:
            parts.append(type_matches(c("event_type"), list(self.event_types)))
        for name, column in (("categories", "category"), ("job_ids", "job_id"), ("event_ids", "id")):
            values = getattr(self, name)
            if values is not None:
                parts.append(c(column).isin(list(values)) if values else F.lit(False))
        for name, column in (
            ("actor", "actor_id"), ("target", "target_id"), ("outcome", "outcome"), ("synthetic", "synthetic"),
        ):
            if getattr(self, name) is not None:
                parts.append(c(column) == F.lit(getattr(self, name)))
        if self.min_severity:
            parts.append(c("severity_rank") >= SEVERITIES.index(self.min_severity))
        if self.max_severity:
            parts.append(c("severity_rank") <= SEVERITIES.index(self.max_severity))
        if self.min_confidence is not None:
            parts.append(c("confidence") >= self.min_confidence)
        if self.max_confidence is not None:
            parts.append(c("confidence") <= self.max_confidence)
        if self.source:
            parts.append(F.contains(F.lower(c("source")), F.lit(self.source.lower())))
        return _all(parts)

    def apply(
        self, events: DataFrame, involvement: DataFrame | None = None, incidents: DataFrame | None = None
    ) -> DataFrame:
        out = events.where(self.column())
        searched = [x for x in ("message", "event_type", "actor_id", "target_id", "raw") if x in events.columns]
        for text in self.texts:
            out = out.where(_any([F.contains(F.lower(F.col(x)), F.lit(text.lower())) for x in searched]))
        for group in self.object_groups:
            ids = involvement.where(F.col("object_id").isin(list(group))).select(F.col("event_id").alias("id"))
            out = out.join(ids, "id", "left_semi")
        if self.incident_id is not None:
            ids = incidents.where(F.col("incident_id") == self.incident_id).select(F.col("event_id").alias("id"))
            out = out.join(ids, "id", "left_semi")
        return out


def edges_as_of(edges: DataFrame, at_us: int | None = None) -> DataFrame:
    """Edges that hold at an instant; without one, edges that have not ended."""
    if at_us is None:
        return edges.where(F.col("to_us").isNull())
    start = F.coalesce(F.col("from_us"), F.col("first_us")) if "from_us" in edges.columns else F.col("first_us")
    return edges.where((start.isNull() | (start <= at_us)) & (F.col("to_us").isNull() | (F.col("to_us") > at_us)))


def filter_objects(
    objects: DataFrame,
    types: list[str] | None = None,
    tag: str | None = None,
    text: str | None = None,
    ids: list[str] | None = None,
    synthetic: bool | None = None,
) -> DataFrame:
    out = objects
    if types:
        out = out.where(F.col("type").isin(types))
    if ids is not None:
        out = out.where(F.col("id").isin(ids))
    if synthetic is not None:
        out = out.where(F.col("synthetic") == synthetic)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if text:
        t = F.lit(text.lower())
        out = out.where(F.contains(F.lower("name"), t) | F.contains(F.lower("id"), t))
    return out


def filter_findings(
    findings: DataFrame,
    product: str | None = None,
    rule_id: str | None = None,
    min_severity: str | None = None,
    statuses: list[str] | None = None,
    object_id: str | None = None,
    text: str | None = None,
) -> DataFrame:
    out = findings
    if product:
        out = out.where(F.col("product") == product)
    if rule_id:
        out = out.where(F.col("rule_id") == rule_id)
    if min_severity:
        out = out.where(F.col("severity_rank") >= SEVERITIES.index(min_severity))
    if statuses:
        out = out.where(F.col("status").isin(statuses))
    if object_id:
        out = out.where(F.array_contains("affected", object_id))
    if text:
        t = F.lit(text.lower())
        out = out.where(F.contains(F.lower("title"), t) | F.contains(F.lower("id"), t))
    return out


def filter_packets(
    packets: DataFrame,
    protocol: str | None = None,
    host: str | None = None,
    port: int | None = None,
    flow_id: str | None = None,
    start_us: int | None = None,
    end_us: int | None = None,
) -> DataFrame:
    c, parts = F.col, []
    if protocol:
        parts.append(F.array_contains("protocols", protocol.lower()))
    if host:
        parts.append((c("src_ip") == host) | (c("dst_ip") == host))
    if port is not None:
        parts.append((c("src_port") == port) | (c("dst_port") == port))
    if flow_id:
        parts.append(c("flow_id") == flow_id)
    if start_us is not None:
        parts.append(c("us") >= start_us)
    if end_us is not None:
        parts.append(c("us") <= end_us)
    return packets.where(_all(parts))


__all__ = [
    "EventFilter", "edges_as_of", "filter_objects", "filter_findings", "filter_packets", "type_matches",
]
