"""Port sets: each value is looked at once, and texts at the edge of the pattern keep their reading."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import ports


@pytest.mark.parametrize("make", [ports.parse, ports.merge, ports.labels])
def test_a_value_is_evaluated_once(spark, make):
    """The plan holds the value, and for texts its clean form, a single time."""
    a = F.from_json("v", "array<string>" if make is ports.parse else f"array<{ports.RANGE}>")
    plan = spark.createDataFrame([("[]",)], "v string").select(make(a).alias("x"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("from_json(") == 1
    assert plan.count("lower(trim(") == (1 if make is ports.parse else 0)


def test_texts_at_the_edge(spark):
    texts = ["443\n", " 443 ", "tcp /\t443", "25-22", "70000", "any / 80 - 90", "SSH", "tcp,1,2", "1,2,3", "icmp", "", "80-", "0-65535", "any/any\n", "udp/*"]
    rows = spark.createDataFrame([(x,) for x in texts], "v string").select("v", ports.labels(ports.parse(F.array("v"))).alias("l")).collect()
    got = {r.v: r.l for r in rows}
    assert got == {
        "443\n": ["tcp/443"], " 443 ": ["tcp/443"], "tcp /\t443": ["tcp/443"], "25-22": [], "70000": [], "any / 80 - 90": ["tcp/80-90", "udp/80-90", "icmp/80-90"], "SSH": ["tcp/22"],
        "tcp,1,2": [], "1,2,3": [], "icmp": ["icmp"], "": [], "80-": [], "0-65535": ["tcp/all"], "any/any\n": ["any"], "udp/*": ["udp/all"]}
