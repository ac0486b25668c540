"""What control of one end of a relationship means for the other end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL, REACH, TRUST = "control", "reach", "trust"

# Type groups named by the rules.
PRINCIPALS = ["user", "identity", "group", "role", "permission"]
COMPUTE = ["host", "service", "container", "cloud_resource"]
ASSETS = ["host", "service", "cloud_resource", "container", "network", "project"]
EXPOSURE_ASSETS = ["host", "service", "cloud_resource", "container"]
EXCLUDED_TYPES = ["process"]

# One line per traversal rule:
# relationship, source types, target types ("*" any), direction, mode, factor, explanation.
RULES: list[tuple[str, str, str, str, str, float, str]] = [
    ("LOGGED_INTO", "*", "*", "forward", CONTROL, 0.8,
     "{frm} has authenticated to {to}; compromised credentials of {frm} can be used on {to}"),
    ("LOGGED_INTO", "*", "*", "reverse", CONTROL, 0.5,
     "{to} has had a session on {frm}; whoever controls {frm} may capture {to}'s credentials or session"),
    ("ADMIN_OF", "*", "*", "forward", CONTROL, 1.0, "{frm} has administrative rights on {to}"),
    ("MEMBER_OF", "principal", "*", "forward", CONTROL, 1.0, "{frm} is a member of {to} and inherits its access"),
    ("MEMBER_OF", "!principal", "network", "forward", REACH, 1.0, "{frm} is located in network {to}"),
    ("MEMBER_OF", "!principal", "network", "reverse", REACH, 1.0, "{to} is located in network {frm}"),
    ("HAS_ROLE", "*", "*", "forward", CONTROL, 1.0, "{frm} holds the role {to}"),
    ("HAS_PERMISSION", "*", "*", "forward", CONTROL, 1.0, "{frm} grants the permission {to}"),
    ("CAN_ACCESS", "*", "*", "forward", CONTROL, 0.9, "{frm} is permitted to access {to}"),
    ("CAN_ASSUME", "*", "*", "forward", CONTROL, 1.0, "{frm} can assume {to}"),
    ("HAS_IDENTITY", "*", "*", "forward", CONTROL, 1.0, "{frm} controls the account {to}"),
    ("USES", "*", "account", "forward", CONTROL, 0.8, "credentials of {to} are present on {frm}"),
    ("RUNS", "*", "workload", "forward", CONTROL, 0.9, "{frm} hosts {to}"),
    ("RUNS", "*", "workload", "reverse", CONTROL, 0.4,
     "{frm} runs on {to}; code execution in {frm} can extend to its host"),
    ("DEPLOYS_TO", "*", "*", "forward", CONTROL, 0.9, "{frm} deploys code to {to}"),
    ("CONTAINS", "container-like", "*", "forward", CONTROL, 0.9, "{to} is part of {frm}"),
    ("CONTAINS", "!container-like", "compute", "forward", CONTROL, 0.9, "{to} is part of {frm}"),
    ("CONTAINS", "storage", "stored", "forward", CONTROL, 1.0, "{to} is stored on {frm}"),
    ("CONTAINS_SECRET", "*", "*", "forward", CONTROL, 0.9, "the secret {to} is stored in {frm}"),
    ("AUTHENTICATES_AS", "*", "*", "forward", CONTROL, 1.0, "{frm} is a credential for {to}"),
    ("TRUSTS", "*", "*", "reverse", TRUST, 0.8, "{to} trusts {frm}; identities from {frm} are accepted by {to}"),
    ("OWNS", "principal", "*", "forward", CONTROL, 0.6,
     "{frm} owns {to}; ownership usually implies administrative access"),
    ("CAN_REACH", "*", "*", "forward", REACH, 0.9, "network policy allows traffic from {frm} to {to}"),
    ("CONNECTED_TO", "endpoint", "endpoint", "forward", REACH, 0.6, "{frm} has been observed connecting to {to}"),
    ("HAS_ADDRESS", "*", "*", "forward", REACH, 1.0, "{to} is an address of {frm}"),
    ("HAS_ADDRESS", "*", "*", "reverse", REACH, 1.0, "{frm} is an address of {to}"),
]
CLASSES = {
    "principal": PRINCIPALS,
    "account": ["identity", "user"],
    "workload": ["service", "container"],
    "container-like": ["cloud_resource", "organization"],
    "compute": COMPUTE,
    "storage": ["host", "directory"],
    "stored": ["file", "directory"],
    "endpoint": ["host", "ip"],
    "network": ["network"],
}
PROPAGATION_TYPES = sorted({r[0] for r in RULES} | {"AFFECTS"})
EXPOSED_SERVICES = "services of {frm} are exposed to whoever can reach it"
# Metadata keys shown after an explanation, in this order.
EXPLAIN_KEYS = ["access", "credential_location", "credential", "ports", "policy", "mechanism"]


def in_class(otype: Column, name: str) -> Column:
    if name == "*":
        return F.lit(True)
    if name.startswith("!"):
        return ~in_class(otype, name[1:])
    return otype.isin(CLASSES[name])


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a small table (fixed size)."""
    rows = [(i, *r) for i, r in enumerate(RULES)]
    return spark.createDataFrame(
        rows, "ord int, type string, src_class string, dst_class string, direction string, mode string, factor double, why string"
    )


def with_rules(edges: DataFrame) -> DataFrame:
    """Each edge once per rule that applies to it: columns ``direction, mode, factor, why`` added.

    The rules are a CASE inside one array expression, so this is a narrow projection: no join at all.
    """
    s, d, t = F.substring_index("src", ":", 1), F.substring_index("dst", ":", 1), F.col("type")
    options = [
        F.when(
            (t == rel) & in_class(s, sc) & in_class(d, dc),
            F.struct(F.lit(direction).alias("direction"), F.lit(mode).alias("mode"), F.lit(factor).alias("factor"),
                     F.lit(why).alias("why")),
        )
        for rel, sc, dc, direction, mode, factor, why in RULES
    ]
    return edges.withColumn("rule", F.explode(F.array_compact(F.array(*options)))).select("*", "rule.*").drop("rule")


def explain(template: Column, frm: Column, to: Column, metadata: Column | None = None) -> Column:
    """The explanation with names filled in and the details the metadata holds."""
    text = F.replace(F.replace(template, F.lit("{frm}"), frm), F.lit("{to}"), to)
    if metadata is None:
        return text
    details = F.array_compact(F.array(*[
        F.when(F.coalesce(metadata[k], F.lit("")) != "", F.concat(F.lit(k.replace("_", " ") + ": "), metadata[k]))
        for k in EXPLAIN_KEYS
    ]))
    return F.when(F.size(details) > 0, F.concat(text, F.lit(" ("), F.array_join(details, "; "), F.lit(")"))).otherwise(text)


def is_privileged(metadata: Column, tags: Column) -> Column:
    flagged = (F.coalesce(metadata["privileged"], F.lit("")) == "true") | (
        F.coalesce(metadata["wildcard"], F.lit("")) == "true"
    )
    return flagged | F.coalesce(F.array_contains(tags, "privileged"), F.lit(False))


def propagation_edges(edges: DataFrame) -> DataFrame:
    """The part of the graph that can matter to propagation."""
    return edges.where(
        F.col("type").isin(PROPAGATION_TYPES)
        & ~F.substring_index("src", ":", 1).isin(EXCLUDED_TYPES)
        & ~F.substring_index("dst", ":", 1).isin(EXCLUDED_TYPES)
    )
