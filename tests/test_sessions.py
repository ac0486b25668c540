"""Open sessions of others, against a search over all pairs."""

from __future__ import annotations

import random

from vigilframe.operators import trace

EVENT = "id string, actor_id string, target_id string, us long"


def test_open_sessions_equal_all_pairs(spark):
    rng = random.Random(5)

    def some(kind: str, n: int) -> list[tuple]:
        return [(f"{kind}{k:03d}", rng.choice(["a", "b", "c", "é", None]), rng.choice(["x", "y", None]), rng.randint(-20, 60)) for k in range(n)]

    starts, ends, probes, window = some("s", 90), some("e", 40), some("p", 120), 7
    want = {}
    for p, who, host, us in probes:
        seen = [(s_us, s, other) for s, other, at, s_us in starts if None not in (other, at, who) and at == host and us - window <= s_us <= us and other != who
                and not any((x, y) == (other, at) and s_us < e_us <= us for _, x, y, e_us in ends)]
        if seen:
            want[p] = (max(seen)[2], len(seen))
    got = trace.open_sessions(*(spark.createDataFrame(x, EVENT) for x in (starts, ends, probes)), window)
    assert len(want) > 20
    assert {r.id: (r.other, r.open) for r in got.collect()} == want


def test_open_sessions_make_no_pairs(spark):
    """A thousand sessions of one host and a thousand probes within the window: no step lists their million pairs."""
    rows = [spark.range(1000).selectExpr(f"concat('{k}', id) AS id", "concat('u', id % 50) AS actor_id", "'h' AS target_id", "id AS us") for k in "sep"]
    df = trace.open_sessions(*rows, 10_000)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg({"open": "max"}).first()[0] == 49 and df.count() == 999
