"""Graph traversal over edge tables ``(src, type, dst, ...)``; starts are always a set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.loops import cut


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def degree_ranking(edges: DataFrame, limit: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    if nodes is not None:
        ends = ends.join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    ranked = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return ranked if limit is None else ranked.orderBy(F.desc("degree"), "node").limit(limit)


def arcs(edges: DataFrame, direction: str = "both", rel_types: list[str] | None = None) -> DataFrame:
    """Edges as steps ``frm -> to``; ``forward`` says whether the step follows the edge."""
    e = edges if not rel_types else edges.where(F.col("type").isin(rel_types))
    out = e.select(F.col("src").alias("frm"), F.col("dst").alias("to"), "type", F.lit(True).alias("forward"))
    back = e.select(F.col("dst").alias("frm"), F.col("src").alias("to"), "type", F.lit(False).alias("forward"))
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionAll(back)


def neighborhood(
    edges: DataFrame,
    roots: DataFrame,
    depth: int = 1,
    direction: str = "both",
    rel_types: list[str] | None = None,
    node_types: list[str] | None = None,
    max_nodes: int | None = None,
) -> tuple[DataFrame, DataFrame, bool]:
    """Breadth-first layers around ``roots(id)``: (nodes(id, depth), edges inside, truncated).

    With ``max_nodes`` the layer that would exceed it is cut in (src, type, dst) order.
    """
    steps = arcs(edges, direction, rel_types)
    if node_types:
        wanted = F.substring_index("to", ":", 1).isin(node_types)
    else:
        wanted = F.lit(True)
    layers = [cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))]
    truncated = False
    for level in range(1, depth + 1):
        frontier, seen = layers[-1], union_all(layers)
        reached = (
            frontier.select(F.col("id").alias("frm")).join(steps, "frm").where(wanted)
            .withColumn("edge", F.when(F.col("forward"), F.array("frm", "type", "to")).otherwise(F.array("to", "type", "frm")))
            .groupBy(F.col("to").alias("id")).agg(F.min("edge").alias("edge"))
            .join(seen.select("id"), "id", "left_anti")
        )
        if max_nodes is not None:
            room = max_nodes - seen.count()
            reached = cut(reached)
            if reached.count() > room:
                truncated = True
                reached = reached.orderBy("edge", "id").limit(max(room, 0))
        layer = cut(reached.select("id", F.lit(level).alias("depth")))
        if layer.isEmpty():
            break
        layers.append(layer)
        if truncated:
            break
    nodes = union_all(layers)
    # an edge counts when it was touched from a layer that was expanded and both its ends are in
    expanded = union_all(layers[:-1] if len(layers) > depth or truncated else layers)
    e = edges if not rel_types else edges.where(F.col("type").isin(rel_types))
    inside = _both_ends(e, nodes)
    touched_by = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    hit = [inside.join(expanded.select(F.col("id").alias(x)), x, "left_semi") for x in touched_by]
    return nodes, (hit[0] if len(hit) == 1 else union_all(hit).distinct()), truncated


def _both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = edges
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return out


def induced_subgraph(edges: DataFrame, nodes: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """Every edge among ``nodes(id)``: two semi joins."""
    e = edges if not rel_types else edges.where(F.col("type").isin(rel_types))
    return _both_ends(e, nodes)


def shortest_paths(
    edges: DataFrame, pairs: DataFrame, directed: bool = False, rel_types: list[str] | None = None, max_depth: int = 8
) -> DataFrame:
    """One shortest path for each ``pairs(start, goal)``, all pairs in one loop.

    Among equally short ways the one whose nodes sort first is kept. The path is carried along (at most
    ``max_depth`` ids), so nothing is walked back.
    """
    steps = arcs(edges, "out" if directed else "both", rel_types).groupBy("frm", "to").agg(
        F.min("type").alias("type")
    )
    steps = cut(steps)
    goals = cut(pairs.select("start", "goal").distinct())
    key = ["start", "node"]
    frontier = cut(goals.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    seen, found = [frontier.select(*key)], []
    for _ in range(max_depth):
        nxt = (
            frontier.join(steps.withColumnRenamed("frm", "node"), "node")
            .select("start", F.col("to").alias("node"), F.concat("path", F.array("type", "to")).alias("path"))
            .groupBy(*key).agg(F.min("path").alias("path"))
            .join(union_all(seen), key, "left_anti")
        )
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        hit = frontier.join(goals, [F.col("node") == goals["goal"], frontier["start"] == goals["start"]]).select(
            goals["start"], "goal", "path"
        )
        found.append(hit)
        seen.append(frontier.select(*key))
        done = union_all(found)
        if goals.join(done.select("start", "goal"), ["start", "goal"], "left_anti").where("start <> goal").isEmpty():
            break
    zero = goals.where("start = goal").select("start", "goal", F.array("start").alias("path"))
    out = union_all([zero, *found])
    return out.withColumn("hops", ((F.size("path") - 1) / 2).cast("int"))


def closure(
    edges: DataFrame,
    starts: DataFrame,
    max_hops: int = 10,
    keep: Column | None = None,
    frm: str = "src",
    to: str = "dst",
) -> DataFrame:
    """Everything reachable from ``starts(start)`` along ``edges``: (start, node, hops, chain).

    ``chain`` is the shortest way, ties by node order; a node is expanded once per start, so cycles end.
    """
    steps = edges if keep is None else edges.where(keep)
    steps = cut(steps.select(F.col(frm).alias("node"), F.col(to).alias("nxt")).distinct())
    frontier = cut(starts.select("start").distinct().select(
        "start", F.col("start").alias("node"), F.array("start").alias("chain")))
    layers = [frontier]
    for _ in range(max_hops):
        nxt = (
            frontier.join(steps, "node")
            .select("start", F.col("nxt").alias("node"), F.concat("chain", F.array("nxt")).alias("chain"))
            .groupBy("start", "node").agg(F.min("chain").alias("chain"))
            .join(union_all([x.select("start", "node") for x in layers]), ["start", "node"], "left_anti")
        )
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        layers.append(frontier)
    return union_all(layers).withColumn("hops", F.size("chain") - 1)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for an undirected ``links(a, b)``: smallest id of the component.

    Alternates "everyone points to the smallest neighbour" with pointer doubling, so the rounds grow with the
    logarithm of the longest chain.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.least("id", "m").alias("component")))
    while True:
        # smallest label among the neighbours
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("nb")), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("nb").alias("nb"))
        hooked = label.join(near, "id").select("id", "component", F.least("component", "nb").alias("low"))
        # the old representative learns the lower label too, then one jump
        taught = hooked.where("low < component").groupBy(F.col("component").alias("id")).agg(F.min("low").alias("taught"))
        step = hooked.join(taught, "id", "left").select(
            "id", "component", F.least("low", F.coalesce("taught", "low")).alias("low"))
        jump = step.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        nxt = cut(step.join(jump, "low", "left").select(
            "id", "component", F.least("low", F.coalesce("lower", "low")).alias("new")))
        changed = not nxt.where("component <> new").isEmpty()
        label = nxt.select("id", F.col("new").alias("component"))
        if not changed:
            return label
