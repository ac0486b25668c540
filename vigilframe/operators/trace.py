"""Causal links between objects, walks over them, and replay of a time range."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.folds import newest
from vigilframe.operators.graph import union_all
from vigilframe.operators.loops import cut
from vigilframe.operators.timeline import latest_before

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
LINK = ["cause", "effect", "relation", "us"]


def observed_links(events: DataFrame) -> DataFrame:
    """(cause, effect, relation, us, confidence, event_id, source) from nine kinds of events.

    ``events`` has a map ``roles`` of further involved ids. The same table answers causes (by effect) and effects (by cause).
    """
    c = F.col
    t, a, x = c("event_type"), c("actor_id"), c("target_id")
    ok = F.coalesce(c("outcome") != "failure", F.lit(True))
    ka, kx = F.substring_index(a, ":", 1), F.substring_index(x, ":", 1)

    def role(name: str) -> Column:
        return c("roles")[name]

    def link(cond: Column, cause: Column, relation, effect: Column, weight: float = 1.0) -> Column:
        rel = relation if isinstance(relation, Column) else F.lit(relation)
        return F.when(cond & cause.isNotNull() & effect.isNotNull() & (cause != effect), F.struct(
            cause.alias("cause"), effect.alias("effect"), rel.alias("relation"), F.round(c("confidence") * weight, 3).alias("confidence")))

    person = ["user", "identity"]
    granting = t.startswith("iam.") & ~t.rlike(r"\.(remove|revoke|disable)$")
    links = [
        link((t == "process.start") & (kx == "process"), role("parent"), "SPAWNED", x),
        link((t == "process.start") & (kx == "process") & ka.isin(person), a, "STARTED", x),
        link(t.startswith("file.") & (kx == "file"), F.coalesce(role("process"), a), F.upper(F.split_part(t, F.lit("."), F.lit(2))), x),
        link(t.startswith("auth.") & ok & ka.isin(person), role("src_ip"), "AUTHENTICATED_FROM", a, 0.95),
        link(granting & kx.isin(person), a, "CHANGED_ACCESS", x),
        link(t.isin("auth.login", "auth.privilege") & ok & (kx == "host"), a, F.when(t == "auth.login", "LOGGED_INTO").otherwise("ELEVATED_ON"), x),
        link(t.startswith("network.") & ok & kx.isin("ip", "host"), a, "CONNECTED_TO", x),
        link((t == "dns.query") & (kx == "domain"), a, "QUERIED", x),
        link((t == "dns.query"), x, "RESOLVED_TO", role("answer")),
        link((t == "http.request") & (kx == "url"), a, "REQUESTED", x),
    ]
    return events.select(c("id").alias("event_id"), "us", "source", F.explode(F.array_compact(F.array(*links))).alias("l")).select(
        "l.cause", "l.effect", "l.relation", "us", "l.confidence", "event_id", "source")


def corroborate(links: DataFrame, cap: float = 0.95) -> DataFrame:
    """One row per fact (cause, effect, relation, time); each further source raises the confidence up to ``cap``.

    A source counts once, so the fold runs over the distinct sources of one fact at one instant.
    """
    per_source = links.groupBy(*LINK, "source").agg(F.min_by(F.struct("event_id", "confidence"), "event_id").alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("f.event_id", "f.confidence"))), lambda x: x["confidence"])
    g = per_source.groupBy(*LINK).agg(ordered.alias("c"), F.min("f.event_id").alias("event_id"))

    def add(acc: Column, x: Column) -> Column:
        return F.round(F.least(F.lit(cap), 1 - (1 - acc) * (1 - x)), 3)

    folded = F.aggregate(F.slice("c", 2, F.size("c")), F.col("c")[0], add)
    return g.select(*LINK, folded.alias("confidence"), "event_id", F.size("c").alias("sources"))


def credential_exposure(reads: DataFrame, logins: DataFrame, holds: DataFrame, window_us: int = 24 * HOUR_US) -> DataFrame:
    """A file that holds a credential was read before the identity signed in: (reader, identity, read_us, login_us).

    ``holds(file, identity)``; the newest read in the window before each sign-in counts.
    """
    r = reads.select(F.col("actor_id").alias("reader"), F.col("target_id").alias("file"), "us").join(holds, "file").where("reader <> identity")
    lg = logins.select(F.col("actor_id").alias("identity"), "us", F.col("id").alias("login_id"))
    found = latest_before(lg, r.select("identity", "us", "reader"), ["identity"], ["reader"], window_us)
    return found.select("login_id", "identity", F.col("us").alias("login_us"), "latest.reader", F.col("latest.us").alias("read_us"))


def _sweep(window_us: int):
    """Goes through rows (host, b, us, kind, who, id) in that order: ends (0), starts (1), probes (2) of one host and block.

    An end closes what its principal opened before it, so of one principal the newest session is open if any is: one entry each suffices to find the newest of others.
    Held are the sessions of one host that began in the window.
    """

    def run(batches):
        import pyarrow as pa

        key, seq = None, 0
        for batch in batches:
            out = []
            for host, b, us, kind, who, at in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, b) != key:
                    # per principal: open sessions, number and row of the newest, number up to which they are closed
                    key, total, begun, newest, of = (host, b), 0, deque(), [], {}
                seq += 1
                while begun and begun[0][0] < us - window_us:
                    _, number, other = begun.popleft()
                    if number > of[other][2]:
                        of[other][0] -= 1
                        total -= 1
                if kind == 0:
                    if who in of:
                        total -= of[who][0]
                        of[who][0], of[who][2] = 0, seq
                elif kind == 1:
                    mine = of.setdefault(who, [0, 0, 0, None])
                    mine[0], mine[1], mine[3] = mine[0] + 1, seq, (who, us, at)
                    total += 1
                    begun.append((us, seq, who))
                    heappush(newest, (-seq, who))
                elif total > (own := of[who][0] if who in of else 0):
                    held = None
                    while True:
                        number, other = newest[0]
                        if of[other][1] != -number or not of[other][0]:
                            heappop(newest)
                        elif other == who:
                            held = heappop(newest)
                        else:
                            break
                    out.append((at, *of[other][3], total - own))
                    if held:
                        heappush(newest, held)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["id", "other", "s_us", "session_id", "open"])

    return run


def open_sessions(starts: DataFrame, ends: DataFrame, probes: DataFrame, window_us: int = 2 * HOUR_US) -> DataFrame:
    """Sessions of other principals that were open on the source host when a probe event happened.

    Blocks as long as the window are swept in the order of time, each with the starts and ends of the block before: rows move in proportion to the events, not to
    the pairs of sessions and probes.
    """
    block = F.expr(f"us div {window_us}")

    def rows(events: DataFrame, kind: int) -> DataFrame:
        where = F.array(block) if kind == 2 else F.array(block, block + 1)
        e = events.select(F.col("target_id").alias("host"), "us", F.lit(kind).cast("tinyint").alias("kind"), F.col("actor_id").alias("who"), F.lit("").alias("id") if kind == 0 else F.col("id"))
        return e.where("host IS NOT NULL AND who IS NOT NULL AND us IS NOT NULL").select("host", F.explode(where).alias("b"), "us", "kind", "who", "id")

    every = union_all([rows(ends, 0).distinct(), rows(starts, 1), rows(probes, 2)])
    swept = every.repartition("host", "b").sortWithinPartitions("host", "b", "us", "kind", "id").mapInArrow(
        _sweep(window_us), "id string, other string, s_us long, session_id string, open long")
    return swept.groupBy("id").agg(F.max_by("other", F.struct("s_us", "session_id")).alias("other"), F.sum("open").alias("open"))


def walk(links: DataFrame, starts: DataFrame, depth: int = 3, backward: bool = True, nearest: int = 5) -> DataFrame:
    """Links reached from ``starts(start, node, bound_us)`` going back (or forward) in time, the nearest few per relation and node.

    Each step follows links that lie before the time of the link it came from. The nearest-N cut is part of the feature; it keeps
    the window per (start, node, relation) short because WindowGroupLimit drops rows before the shuffle.
    """
    links = cut(links)
    here, there = ("effect", "cause") if backward else ("cause", "effect")
    frontier = cut(starts.select("start", "node", "bound_us"))
    seen = [frontier.select("start", "node")]
    out = []
    for level in range(1, depth + 1):
        j = frontier.join(links.withColumnRenamed(here, "node").withColumnRenamed(there, "nxt"), "node")
        j = j.where(F.col("us") <= F.col("bound_us")) if backward else j.where(F.col("us") >= F.col("bound_us"))
        order = F.desc("us") if backward else F.asc("us")
        w = Window.partitionBy("start", "node", "relation").orderBy(order, "nxt")
        step = cut(j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= nearest).select(
            "start", "node", "nxt", "relation", "us", "confidence", F.lit(level).alias("level")))
        if step.isEmpty():
            break
        out.append(step)
        bound = F.max("us") if backward else F.min("us")
        nxt = step.groupBy("start", F.col("nxt").alias("node")).agg(bound.alias("bound_us")).join(union_all(seen), ["start", "node"], "left_anti")
        frontier = cut(nxt)
        seen.append(frontier.select("start", "node"))
    return union_all(out) if out else frontier.limit(0).select("start", "node", F.col("node").alias("nxt"), F.lit("").alias("relation"), F.col("bound_us").alias("us"),
                                                              F.lit(0.0).alias("confidence"), F.lit(0).alias("level"))


# Links of a chain, links tried at each step of every partial chain, and links tried in one search of ``best_chain``.
CHAIN_LINKS, BRANCHES, BUDGET = 12, 3, 2000
LEAST_CONFIDENCE, LEAST_SUPPORT = 0.3, 0.1


def best_chain(subject: str, links: list[tuple], max_links: int = CHAIN_LINKS, branches: int = BRANCHES, budget: int = BUDGET) -> tuple[list[tuple], float]:
    """The chain of causes into ``subject`` with the largest summed support, nearest link first; no object twice. ``links``: (cause, effect, us, confidence, observed, event).

    A link supports the one after it by its confidence, halved a quarter of an hour before it (hyperbolically); below ``LEAST_SUPPORT`` it is none. The first link
    is an observed one where there is any. The search goes depth-first over the best links of each step, so its first chain is the greedy one.
    """
    into: dict[str, list[tuple]] = {}
    for link in links:
        if link[3] >= LEAST_CONFIDENCE:
            into.setdefault(link[1], []).append(link)
    best: tuple[list[tuple], float] = ([], 0.0)
    left = budget

    def steps(node: str, bound: int | None, taken: set[str]) -> list[tuple]:
        fits = [x for x in into.get(node, ()) if x[0] not in taken and (bound is None or x[2] <= bound)]
        if bound is None:
            fits = [x for x in fits if x[4]] or fits
        rated = [(x[3] if bound is None else x[3] / (1 + (bound - x[2]) / MINUTE_US / 15), x[2], x[0], x[5] or "", x) for x in fits]
        return sorted((r for r in rated if r[0] >= LEAST_SUPPORT), key=lambda r: r[:4], reverse=True)[:branches]

    # one entry for each link of the chain: the steps still to try after it, the chain up to it, its support
    open_steps = [(iter(steps(subject, None, {subject})), [], 0.0)]
    while open_steps:
        rest, chain, support = open_steps[-1]
        step = next(rest, None)
        if step is None or left <= 0:
            open_steps.pop()
            continue
        left -= 1
        grown, total = [*chain, step[4]], support + step[0]
        if total > best[1]:
            best = grown, total
        if len(grown) < max_links:
            open_steps.append((iter(steps(step[4][0], step[4][2], {subject, *(x[0] for x in grown)})), grown, total))
    return best


def best_chains(links: DataFrame, starts: DataFrame | None = None, max_links: int = CHAIN_LINKS) -> DataFrame:
    """(start, chain, score, links): the best causal chain into each ``starts(start, node, bound_us)`` by summed support, as in ``best_chain`` but without a budget.

    ``links(cause, effect, us, confidence)`` may have ``kind`` and ``event_id``; with a column ``start`` a link serves that start only, and without ``starts`` those are all.
    Every link at an object can go on a partial chain that came there at its own time; of them its best ``BRANCHES`` do, until no chain grows.
    """
    own = ["start"] if "start" in links.columns else []
    observed = F.col("kind") == "observed" if "kind" in links.columns else F.lit(True)
    event = F.col("event_id") if "event_id" in links.columns else F.lit(None).cast("string")
    usable = cut(links.where(F.col("confidence") >= LEAST_CONFIDENCE).select(
        *own, "cause", F.col("effect").alias("node"), "us", "confidence", F.coalesce(event, F.lit("")).alias("event_id"), F.coalesce(observed, F.lit(False)).alias("observed")))
    if starts is None:
        starts = links.select("start", F.col("start").alias("node"), F.lit(None).cast("long").alias("bound_us")).distinct()
    state = cut(starts.select("start", F.array("node").alias("path"), F.array().cast("array<string>").alias("trail"), "node", "bound_us", F.lit(0.0).alias("score"), F.lit(0).alias("n")))
    done = []
    for turn in range(max_links):
        in_time = F.col("bound_us").isNull() | (F.col("us") <= F.col("bound_us"))
        j = state.join(usable, [*own, "node"]).where(in_time & ~F.array_contains("path", F.col("cause")))
        support = F.col("confidence") if turn == 0 else F.col("confidence") / (1 + (F.col("bound_us") - F.col("us")) / F.lit(MINUTE_US) / 15)
        if turn == 0 and "kind" in links.columns:
            j = j.join(j.groupBy("start").agg(F.max("observed").alias("any_observed")), "start").where("observed OR NOT any_observed")
        w = Window.partitionBy("start", "trail").orderBy(F.desc("support"), F.desc("us"), F.desc("cause"), F.desc("event_id"))
        grown = j.withColumn("support", support).where(F.col("support") >= LEAST_SUPPORT).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= BRANCHES)
        step = F.concat_ws("\x1f", F.col("cause"), F.col("us").cast("string"), "event_id", F.col("rk").cast("string"))
        state = cut(grown.select(
            "start", F.concat("path", F.array("cause")).alias("path"), F.concat("trail", F.array(step)).alias("trail"), F.col("cause").alias("node"), F.col("us").alias("bound_us"),
            (F.col("score") + F.col("support")).alias("score"), (F.col("n") + 1).alias("n")))
        if state.isEmpty():
            break
        done.append(state)
    best = F.max_by(F.struct("path", "score", "n"), F.struct("score", F.array_join("path", ">")))
    return union_all(done or [state]).groupBy("start").agg(best.alias("b")).select(
        "start", F.array_join(F.reverse("b.path"), ">").alias("chain"), F.round("b.score", 4).alias("score"), F.col("b.n").alias("links"))


# ---------------------------------------------------------------- replay


def replay_steps(events: DataFrame, involvement: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordered steps with what each adds: objects seen for the first time and relationship changes.

    ``edges(event_id, us, rel, ended)``. A relationship change counts when the state before differs; the state before is looked up
    inside the day first and then as the last change of an earlier day, so no relationship is ordered in one task.
    """
    first = involvement.groupBy("object_id").agg(F.min(F.struct("us", "event_id")).alias("f")).select(F.col("f.event_id").alias("id"), "object_id")
    added = first.groupBy("id").agg(F.count("*").alias("new_objects"))
    day = F.expr("us div 86400000000")
    e = edges.select("event_id", "us", "rel", "ended", day.alias("day"))
    w = Window.partitionBy("rel", "day").orderBy("us", "event_id")
    last = e.groupBy("rel", "day").agg(newest(F.col("ended"), F.col("us"), F.col("event_id")).alias("end_state"))
    wd = Window.partitionBy("rel").orderBy("day")
    earlier = last.select("rel", "day", F.lag("end_state").over(wd).alias("day_before"))
    s = e.withColumn("prev", F.lag("ended").over(w)).join(earlier, ["rel", "day"]).withColumn("was", F.coalesce("prev", "day_before"))
    starts = ~F.col("ended") & (F.col("was").isNull() | F.col("was"))
    stops = F.col("ended") & F.col("was").isNotNull() & ~F.col("was")
    rel = s.groupBy(F.col("event_id").alias("id")).agg(F.count_if(starts).alias("added_relationships"), F.count_if(stops).alias("removed_relationships"))
    zero = F.lit(0).cast("long")
    return events.select("id", "us", "event_type").join(added, "id", "left").join(rel, "id", "left").select(
        "id", "us", "event_type", *[F.coalesce(c, zero).alias(c) for c in ("new_objects", "added_relationships", "removed_relationships")])


def replay_state(events: DataFrame, at_us: int, flow_us: int = 600_000_000) -> DataFrame:
    """State at an instant: sessions by their last event, and flows of the last ten minutes."""
    past = events.where(F.col("us") <= at_us)
    session = past.where("event_type IN ('auth.login', 'auth.logout', 'auth.failure')").groupBy("actor_id", "target_id").agg(
        newest(F.col("event_type"), F.col("us"), F.col("id")).alias("state"))
    opened = session.where("state = 'auth.login'").select(F.lit("session").alias("kind"), F.concat_ws("@", "actor_id", "target_id").alias("key"))
    flows = past.where((F.col("category") == "network") & (F.col("us") > at_us - flow_us)).select(
        F.lit("flow").alias("kind"), F.concat_ws(">", "actor_id", "target_id").alias("key")).distinct()
    return opened.unionByName(flows)


def state_digest(state: DataFrame) -> DataFrame:
    """One digest per kind, independent of the order in which events arrived."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "kind", "key"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return state.distinct().groupBy("kind").agg(F.count("*").alias("n"), F.sha2(F.sum(part).cast("string"), 256).alias("digest"))


def verify_chain(entries: DataFrame, content: list[str]) -> DataFrame:
    """Broken links of hash chains ``(chain, seq, prev_hash, entry_hash, ...)``.

    The entry before is found by an equi join on (chain, seq - 1), so one long chain is checked in parallel.
    """
    want = F.sha2(F.concat_ws("\x1f", "prev_hash", *[F.col(c).cast("string") for c in content]), 256)
    before = entries.select("chain", (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("before"))
    j = entries.join(before, ["chain", "seq"], "left")
    problem = F.when(want != F.col("entry_hash"), "content").when(F.coalesce("before", F.lit("")) != F.col("prev_hash"), "link")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").select("chain", "seq", "problem")
