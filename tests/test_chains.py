"""Causal chains against a search over all of them."""

from __future__ import annotations

import random

from vigilframe.operators import trace


def every(subject, links, most):
    """Best summed support over all chains, tried one by one."""
    best = 0.0

    def go(node, bound, taken, support, n):
        nonlocal best
        best = max(best, support)
        if n == most:
            return
        fits = [x for x in links if x[1] == node and x[3] >= 0.3 and x[0] not in taken and (bound is None or x[2] <= bound)]
        if bound is None:
            fits = [x for x in fits if x[4]] or fits
        for x in fits:
            gain = x[3] if bound is None else x[3] / (1 + (bound - x[2]) / 60_000_000 / 15)
            if gain >= 0.1:
                go(x[0], x[2], taken | {x[0]}, support + gain, n + 1)

    go(subject, None, {subject}, 0.0, 0)
    return best


def test_best_chain_equals_all_chains():
    rng = random.Random(5)
    for _ in range(120):
        nodes = [f"n{k}" for k in range(7)]
        links = [(*rng.sample(nodes, 2), rng.randrange(90) * 60_000_000, rng.choice([0.2, 0.3, 0.6, 0.9]), rng.random() < 0.7, f"e{k}") for k in range(rng.randint(0, 14))]
        chain, score = trace.best_chain("n0", links, branches=99, budget=10**6)
        assert abs(score - every("n0", links, 12)) < 1e-9
        assert abs(score - sum(x[3] if not k else x[3] / (1 + (chain[k - 1][2] - x[2]) / 60_000_000 / 15) for k, x in enumerate(chain))) < 1e-9
        assert len({"n0", *(x[0] for x in chain)}) == len(chain) + 1


def test_chains_of_twelve_links_and_the_budget():
    line = [(f"n{k + 1}", f"n{k}", -k * 60_000_000, 0.9, True, None) for k in range(20)]
    chain, _ = trace.best_chain("n0", line)
    assert [x[0] for x in chain] == [f"n{k}" for k in range(1, 13)]
    assert len(trace.best_chain("n0", line, budget=4)[0]) == 4


def test_chains_of_many_starts(spark):
    rows = [("a", "x", "a", 100, 0.9, 1), ("a", "y", "x", 90, 0.8, 2), ("a", "z", "x", 95, 0.4, 2), ("b", "x", "b", 10, 0.2, 1), ("c", "x", "c", 10, 0.5, 1)]
    got = {r.start: (r.chain, r.links) for r in trace.best_chains(spark.createDataFrame(rows, "start string, cause string, effect string, us long, confidence double, level int")).collect()}
    assert got == {"a": ("y>x>a", 2), "c": ("x>c", 1)}


def test_chains_use_every_link(spark):
    """The cause that goes on lies behind ten newer links of its relation and a newer way to its object, and the start has over 400 links."""
    minute = 60_000_000
    links = [("x", "a", 1000 * minute, 0.9)] + [(f"late{k}", "x", (1000 - k) * minute, 0.3) for k in range(10)] + [("y", "x", 989 * minute, 0.9)]
    links += [("x", "y", 1100 * minute, 0.9)] + [(f"new{k}", "y", (1099 - k) * minute, 0.9) for k in range(10)] + [("z", "y", 988 * minute, 0.9), ("end", "z", 987 * minute, 0.9)]
    links += [(f"n{k}", "a", k * minute, 0.3) for k in range(450)]
    table = spark.createDataFrame([(*x, f"e{k}") for k, x in enumerate(links)], "cause string, effect string, us long, confidence double, event_id string")
    starts = spark.createDataFrame([("a", "a", 2000 * minute)], "start string, node string, bound_us long")
    (got,) = trace.best_chains(table, starts).collect()
    assert (got.chain, got.links) == ("end>z>y>x>a", 4)


def test_chains_equal_the_plain_search(spark):
    rng = random.Random(6)
    rows = []
    for start in range(25):
        nodes = [f"s{start}", *(f"n{k}" for k in range(6))]
        for k in range(rng.randint(0, 14)):
            rows.append((f"s{start}", *rng.sample(nodes, 2), rng.randrange(90) * 60_000_000, rng.choice([0.2, 0.3, 0.6, 0.9]), rng.choice(["observed", "correlated"]), f"e{k}"))
    table = spark.createDataFrame(rows, "start string, cause string, effect string, us long, confidence double, kind string, event_id string")
    got = {r.start: r.score for r in trace.best_chains(table).collect()}
    want = {s: trace.best_chain(s, [(c, e, us, conf, kind == "observed", ev) for w, c, e, us, conf, kind, ev in rows if w == s], budget=10**9) for s in {r[0] for r in rows}}
    assert got == {s: round(score, 4) for s, (chain, score) in want.items() if chain}


def test_query_equals_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from tools.check import TABLES, norm

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["trace_chain"]).fetchall()
    got = entry.queries()["trace_chain"](spark, sf_dir).select("start", "chain", "score", "links").collect()
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want)
