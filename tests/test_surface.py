"""Nearest owners, heads of chains and folded findings."""

from __future__ import annotations

from vigilframe.operators import surface


def test_nearest_owner_over_several_levels(spark):
    assets = spark.createDataFrame([(a,) for a in ("s1", "s2", "s3", "h1", "h2", "loop1", "loop2", "lone")], "asset string")
    owners = spark.createDataFrame([("h1", "near"), ("org", "far"), ("net", "mid"), ("h3", "b"), ("h4", "a")], "asset string, owner string")
    parents = spark.createDataFrame([("s1", "h1"), ("h1", "net"), ("net", "org"), ("s2", "h2"), ("h2", "net"), ("s3", "h3"), ("s3", "h4"), ("loop1", "loop2"), ("loop2", "loop1")], "asset string, parent string")
    got = {r.asset: (r.owner, r.via, r.hops) for r in surface.ownership(assets, owners, parents).collect()}
    assert got == {"s1": ("near", "inherited", 1), "s2": ("mid", "inherited", 2), "s3": ("a", "inherited", 1), "h1": ("near", "direct", 0), "h2": ("mid", "inherited", 1),
                   "loop1": (None, None, None), "loop2": (None, None, None), "lone": (None, None, None)}


def test_heads_of_long_chains_and_circles(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(300)]
    got = {r.node: (r.head, r.unfinished) for r in surface.heads(spark.createDataFrame(chain, "node string, up string")).collect()}
    assert got == {f"n{k}": ("n300", False) for k in range(300)}
    mixed = surface.heads(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("x", "y")], "node string, up string")).collect()
    assert {r.node: r.unfinished for r in mixed} == {"a": True, "b": True, "c": True, "x": False}


def test_names_fold_into_their_uppermost_flagged_parent(spark):
    names = spark.createDataFrame([(n,) for n in ("a.bad.org", "x.a.bad.org", "bad.org", "deep.y.other.org", "shop.good.com", "good.com", "1.2.3.4", "svc", "single")], "name string")
    scopes = spark.createDataFrame([("good.com",)], "suffix string")
    parents = spark.createDataFrame([("svc", "1.2.3.4"), ("shop.good.com", "bad.org")], "name string, parent string")
    got = {r.subject: r.members for r in surface.out_of_scope(names, scopes, parents).collect()}
    assert got == {"bad.org": ["bad.org", "a.bad.org", "x.a.bad.org"], "deep.y.other.org": ["deep.y.other.org"], "1.2.3.4": ["1.2.3.4", "svc"], "single": ["single"]}
