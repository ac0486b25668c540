"""Policy decisions: network rules on port sets, identity statements with selectors, and both together for (subject, verb, target).

Addresses of both families are 128-bit numbers in two longs, IPv4 inside ``::ffff:0:0/96``, so one prefix join serves all rules. A rule is looked up by its more
selective side; what has no selective side is copied over ``SALT`` keys and met by a part of the questions each, so no key gathers them all.

Network rules: (policy_id, rule_id, ord, effect, src_cidr, dst_cidr, ports); ``any`` or null is every address. Policies: (policy_id, default, scope), where an
empty scope governs everything. Identity statements: (rule_id, effect, principal, action, resource).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions import netaddr, ports
from vigilframe.functions.folds import once
from vigilframe.operators.graph import closure, union_all
from vigilframe.operators.loops import cut

SALT = 32
MAPPED = 0xFFFF << 32
# Ports of remote administration, verbs about the network alone, verbs that name no action, ports of verbs, actions that log in.
PIVOT_PORTS = ["tcp/22", "tcp/3389", "tcp/5985"]
NETWORK_ONLY = ["reach", "connect"]
GENERIC = ["access", "reach", "connect"]
VERB_PORTS = {
    "ssh": "tcp/22", "rdp": "tcp/3389", "https": "tcp/443", "http": "tcp/80", "dns": "udp/53", "ldap": "tcp/389", "ldaps": "tcp/636", "smb": "tcp/445",
    "postgres": "tcp/5432", "winrm": "tcp/5985",
}
LOGIN_ACTIONS = ["*", "ssh", "rdp", "admin", "login"]
PRINCIPALS = ["user", "identity", "group", "role"]
MAX_PIVOTS, MAX_SESSIONS = 5, 5


# ---------------------------------------------------------------- addresses


# The clean text of an address; its 128 bits as (hi, lo); a network as (len, hi, lo). Written as SQL, so that one call builds the expression.
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), r'^\[+|\]+$', ''), r'%.*$', ''), r'^::ffff:(?=\d+\.\d+\.\d+\.\d+$)', '')"
_OCTETS = " + ".join(f"CAST(split_part(ip, '.', {k}) AS BIGINT) * {256 ** (4 - k)}" for k in (1, 2, 3, 4))
_LEFT = "CASE WHEN s[0] = '' THEN CAST(array() AS array<string>) ELSE split(s[0], ':') END"
_RIGHT = "CASE WHEN coalesce(get(s, 1), '') = '' THEN CAST(array() AS array<string>) ELSE split(get(s, 1), ':') END"
_GROUPS = f"transform(array(split(ip, '::')), s -> CASE size(s) WHEN 2 THEN concat({_LEFT}, array_repeat('0', greatest(8 - size({_LEFT}) - size({_RIGHT}), 0)), {_RIGHT}) WHEN 1 THEN {_LEFT} END)[0]"
_DIGITS = f"transform(array({_GROUPS}), g -> CASE WHEN size(g) = 8 AND forall(g, x -> x RLIKE '^[0-9a-f]{{1,4}}$') THEN array_join(transform(g, x -> lpad(x, 4, '0')), '') END)[0]"
_SIX = f"transform(array({_DIGITS}), d -> CASE WHEN d IS NOT NULL THEN named_struct('hi', CAST(conv(substring(d, 1, 16), 16, -10) AS BIGINT), 'lo', CAST(conv(substring(d, 17, 16), 16, -10) AS BIGINT)) END)[0]"
_BITS = f"transform(array({_CLEAN}), ip -> CASE WHEN ip RLIKE r'{netaddr.V4}' THEN named_struct('hi', 0L, 'lo', {_OCTETS} + {MAPPED}) WHEN contains(ip, ':') THEN {_SIX} END)[0]"
_MASKED = (
    "named_struct('len', {n}, 'hi', CASE WHEN {n} <= 0 THEN 0L WHEN {n} >= 64 THEN {a}.hi ELSE {a}.hi & shiftleft(-1L, 64 - {n}) END, "
    "'lo', CASE WHEN {n} <= 64 THEN 0L WHEN {n} >= 128 THEN {a}.lo ELSE {a}.lo & shiftleft(-1L, 128 - {n}) END)")


def network(name: str) -> Column:
    """(len, hi, lo) of the network or address in a text column; length 0 for ``any`` and null, null for what is none."""
    base = f"substring_index({name}, '/', 1)"
    given = f"CASE WHEN contains({name}, '/') THEN try_cast(substring_index({name}, '/', -1) AS INT) ELSE 128 END"
    length = f"CASE WHEN {base} RLIKE r'{netaddr.V4}' AND contains({name}, '/') THEN {given} + 96 ELSE {given} END"
    at = f"transform(array(named_struct('b', {_BITS.replace('{0}', base)}, 'n', {length})), v -> CASE WHEN v.b IS NOT NULL AND v.n IS NOT NULL THEN {_MASKED.format(n='v.n', a='v.b')} END)[0]"
    return F.expr(f"CASE WHEN {name} IS NULL OR {name} = 'any' THEN named_struct('len', 0, 'hi', 0L, 'lo', 0L) ELSE {at} END")


def enclosing(at: str, length: int) -> Column:
    """(len, hi, lo) of the network of a length around a network column."""
    return F.expr(_MASKED.format(n=length, a=at))


def _inside(at: str, net: str) -> Column:
    """Whether a network (an address is one of length 128) lies in another."""
    return F.expr(f"{at}.len >= {net}.len AND {_MASKED.format(n=net + '.len', a=at)} = {net}")


def _listed(networks: DataFrame, key: Column) -> DataFrame:
    """Networks under their key (key_len, key_hi, key_lo, salt); those of no length under every salt."""
    salts = F.when(key["len"] == 0, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return networks.withColumns({"key_len": key["len"], "key_hi": key["hi"], "key_lo": key["lo"]}).withColumn("salt", F.explode(salts))


def _probed(rows: DataFrame, lengths: list[tuple], at: dict[str, str], *by: str) -> DataFrame:
    """Rows once for each (side, length) in use, with the key of the enclosing network. At most 2 x 129 of them: the only thing collected."""
    looks = ", ".join(f"CASE WHEN {at[side]}.len >= {n} THEN named_struct('side', '{side}', 'k', {_MASKED.format(n=n, a=at[side])}) END" for side, n in lengths)
    keys = f"array_compact(array({looks}))" if looks else "CAST(array() AS array<struct<side:string,k:struct<len:int,hi:bigint,lo:bigint>>>)"
    spread = rows.select("*", F.inline(F.expr(keys)))
    salt = F.expr(f"CASE WHEN k.len = 0 THEN CAST(pmod(xxhash64({', '.join(by)}), {SALT}) AS INT) ELSE 0 END")
    return spread.withColumns({"key_len": F.col("k.len"), "key_hi": F.col("k.hi"), "key_lo": F.col("k.lo"), "salt": salt}).drop("k")


def matches(pairs: DataFrame, rules: DataFrame, carry: tuple[str, ...] = ("ports",)) -> DataFrame:
    """Every rule that covers both ends of a distinct (src_ip, dst_ip), which are addresses or networks; rules with ``enabled`` false or a network that is none
    match nothing."""
    live = rules.where("enabled") if "enabled" in rules.columns else rules
    r = live.select("policy_id", "rule_id", "ord", "effect", *carry, network("src_cidr").alias("from"), network("dst_cidr").alias("to")).where("from IS NOT NULL AND to IS NOT NULL")
    narrow = F.col("to.len") > F.col("from.len")
    r = _listed(r.withColumn("side", F.when(narrow, "dst").otherwise("src")), F.when(narrow, F.col("to")).otherwise(F.col("from")))
    lengths = sorted((x[0], x[1]) for x in r.select("side", "key_len").distinct().collect())
    p = pairs.select("src_ip", "dst_ip").distinct().withColumns({"s": network("src_ip"), "d": network("dst_ip")})
    hit = _probed(p, lengths, {"src": "s", "dst": "d"}, "src_ip", "dst_ip").join(r, ["side", "key_len", "key_hi", "key_lo", "salt"])
    both = hit.where(F.when(F.col("side") == "src", _inside("d", "to")).otherwise(_inside("s", "from")))
    return both.select("src_ip", "dst_ip", "policy_id", "rule_id", "ord", "effect", *carry)


def governed(pairs: DataFrame, policies: DataFrame) -> DataFrame:
    """(src_ip, dst_ip, policy_id, default): policies whose scope holds one of the two addresses."""
    scopes = policies.select("policy_id", "default", F.explode(F.when(F.size("scope") > 0, F.col("scope")).otherwise(F.array(F.lit("any")))).alias("cidr"))
    s = scopes.withColumn("net", network("cidr")).where("net IS NOT NULL")
    s = _listed(s.drop("cidr"), F.col("net"))
    lengths = sorted(("at", x[0]) for x in s.select("key_len").distinct().collect())
    p = pairs.select("src_ip", "dst_ip").distinct()
    ends = p.select("src_ip", "dst_ip", F.explode(F.array("src_ip", "dst_ip")).alias("ip")).withColumn("a", network("ip"))
    return _probed(ends, lengths, {"at": "a"}, "src_ip", "dst_ip").join(s, ["key_len", "key_hi", "key_lo", "salt"]).select("src_ip", "dst_ip", "policy_id", "default").distinct()


# ---------------------------------------------------------------- network decisions


def port_range(proto: Column, lo: Column, hi: Column) -> Column:
    """Port set of one range; ``any`` is every protocol."""
    each = F.transform(F.filter(ports.everything(), lambda r: (proto == "any") | (r["proto"] == proto)), lambda r: F.struct(r["proto"].alias("proto"), lo.cast("int").alias("lo"), F.least(hi.cast("int"), r["hi"]).alias("hi")))
    return F.filter(each, lambda r: r["lo"] <= r["hi"])


def _ports_of(labels: list[str]) -> Column:
    """Port set of labels of single ports."""
    rows = [f"named_struct('proto', '{p.split('/')[0]}', 'lo', {p.split('/')[1]}, 'hi', {p.split('/')[1]})" for p in sorted(labels, key=lambda p: (p.split("/")[0], int(p.split("/")[1])))]
    return F.expr(f"array({', '.join(rows)})")


def wanted_ports(verb: Column, service: Column | None = None) -> Column:
    """The ports a verb asks for: its own, else those of the target ``service`` (labels), else all."""
    own = F.create_map(*[x for name, label in VERB_PORTS.items() for x in (F.lit(name), _ports_of([label]))])[verb]
    return F.coalesce(own, *([ports.parse(service)] if service is not None else []), ports.everything())


def decide_ports(requests: DataFrame, rules: DataFrame, policies: DataFrame) -> DataFrame:
    """(src_ip, dst_ip, wanted, policy_id, decision, allowed, decided) for each distinct request (src_ip, dst_ip, wanted) and governing policy.

    Rules decide in order, each on the ports that are left; the default decides on the rest. ``decided``: array of (rule_id, effect, ports), null rule for the
    default. A policy allows if any of the ports asked for is allowed.
    """
    keys = ["src_ip", "dst_ip"]
    asked = requests.select(*keys, "wanted").distinct()
    hits = matches(asked, rules).groupBy(*keys, "policy_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rule_id", "effect", "ports"))).alias("hits"))
    j = asked.join(governed(asked, policies), keys).join(hits, [*keys, "policy_id"], "left")
    none = F.expr(f"CAST(array() AS array<{ports.RANGE}>)")
    one = F.expr(f"CAST(array() AS array<struct<rule_id:string,effect:string,ports:array<{ports.RANGE}>>>)")
    start = F.struct(F.col("wanted").alias("left"), none.alias("allowed"), one.alias("decided"))

    def step(acc: Column, r: Column) -> Column:
        def with_hit(hit: Column) -> Column:
            note = F.array(F.struct(r["rule_id"].alias("rule_id"), r["effect"].alias("effect"), hit.alias("ports")))
            return F.when(F.size(hit) == 0, acc).otherwise(F.struct(
                ports.subtract(acc["left"], hit).alias("left"), F.when(r["effect"] == "allow", ports.union(acc["allowed"], hit)).otherwise(acc["allowed"]).alias("allowed"),
                F.concat(acc["decided"], note).alias("decided")))

        return once(ports.intersect(acc["left"], r["ports"]), with_hit)

    folded = F.aggregate(F.coalesce("hits", F.expr(f"CAST(array() AS array<struct<ord:int,rule_id:string,effect:string,ports:array<{ports.RANGE}>>>)")), start, step)
    rest = F.struct(F.lit(None).cast("string").alias("rule_id"), F.col("default").alias("effect"), F.col("f.left").alias("ports"))
    allowed = F.when(F.col("default") == "allow", ports.union(F.col("f.allowed"), F.col("f.left"))).otherwise(F.col("f.allowed"))
    out = j.withColumn("f", folded).withColumn("allowed", allowed)
    decided = F.when(F.size("f.left") > 0, F.concat("f.decided", F.array(rest))).otherwise(F.col("f.decided"))
    return out.select(*keys, "wanted", "policy_id", F.when(F.size("allowed") > 0, "allow").otherwise("deny").alias("decision"), "allowed", decided.alias("decided"))


# ---------------------------------------------------------------- identity decisions


def glob_pattern(selector: Column) -> Column:
    """Regular expression of a selector with ``*``, ``?`` and ``[...]``, over the whole text."""
    safe = F.regexp_replace(selector, r"([\\.^$|()+{}])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"\[!", "[^"), r"\*", ".*"), r"(?<!\()\?(?!s:)", "."), F.lit(r")\z"))


def selectors(statements: DataFrame) -> DataFrame:
    """Statements with (kind, size, piece) of their resource: ``all``; ``exact``; ``prefix``, the literal text before the first wildcard; ``gram``, three letters of
    the longest literal piece of a glob that begins with a wildcard; ``any`` for globs without such a piece."""
    wild = F.col("resource").rlike(r"[*?\[]")
    pieces = F.split(F.regexp_replace("resource", r"\[[^\]]*\]", "*"), r"[*?]+")
    lead = pieces[0]
    longest = F.element_at(F.array_sort(pieces, lambda a, b: F.length(b) - F.length(a)), 1)
    kind = F.when(F.col("resource") == "*", "all").when(~wild, "exact").when(F.length(lead) > 0, "prefix").when(F.length(longest) >= 3, "gram").otherwise("any")
    piece = F.when(kind == "exact", F.col("resource")).when(kind == "prefix", lead).when(kind == "gram", F.substring(longest, 1, 3)).otherwise("")
    own = F.col("resource").endswith(":*") & ~F.expr("substring(resource, 1, length(resource) - 1)").rlike(r"[*?\[]")
    return statements.withColumns({"kind": kind, "piece": piece, "size": F.when(kind == "prefix", F.length(lead)).otherwise(0), "pattern": F.when(wild & (kind != "all"), glob_pattern(F.col("resource"))), "own_only": own})


def reached_resources(resources: DataFrame, ancestors: DataFrame, statements: DataFrame) -> DataFrame:
    """(resource, selector): selectors of the statements that match a resource or, unless of the form ``type:*``, what it lies in. ``ancestors(resource, parent)``
    includes the resource itself."""
    s = selectors(statements).select("kind", "piece", "size", "pattern", "own_only", F.col("resource").alias("selector")).distinct()
    shapes = s.select("kind", "size").distinct().collect()  # kinds and literal lengths in use
    up = resources.select("resource").distinct().join(ancestors.select("resource", "parent"), "resource")
    keys = []
    if any(r["kind"] == "exact" for r in shapes):
        keys.append(F.array(F.struct(F.lit("exact").alias("kind"), F.col("parent").alias("piece"))))
    lengths = sorted({r["size"] for r in shapes if r["kind"] == "prefix"})
    if lengths:
        keys.append(F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("parent")), lambda n: F.struct(F.lit("prefix").alias("kind"), F.col("parent").substr(F.lit(1), n).alias("piece"))))
    if any(r["kind"] == "gram" for r in shapes):
        spots = F.sequence(F.lit(1), F.greatest(F.length("parent") - 2, F.lit(1)))
        keys.append(F.array_distinct(F.transform(spots, lambda i: F.struct(F.lit("gram").alias("kind"), F.col("parent").substr(i, F.lit(3)).alias("piece")))))
    if any(r["kind"] == "any" for r in shapes):
        keys.append(F.array(F.struct(F.lit("any").alias("kind"), F.lit("").alias("piece"))))
    found = []
    if keys:
        probe = up.select("resource", "parent", F.inline(F.concat(*keys) if len(keys) > 1 else keys[0]))
        fits = (F.col("pattern").isNull() | F.regexp_like("parent", F.col("pattern"))) & (~F.col("own_only") | (F.col("parent") == F.col("resource")))
        found.append(probe.join(s.where("kind <> 'all'"), ["kind", "piece"]).where(fits).select("resource", "selector"))
    found.append(resources.select("resource", F.lit("*").alias("selector")))
    return union_all(found).distinct()


def decide_access(requests: DataFrame, statements: DataFrame, principals: DataFrame, ancestors: DataFrame, default: str = "deny") -> DataFrame:
    """(principal, action, resource, decision, rules, by_default): deny overrides allow.

    ``principals(principal, holder)`` lists who a principal acts as, ``ancestors(resource, parent)`` what a resource lies in, both with themselves. A null action asks
    for any: it is denied only if no allowed action is left over by the denials. ``rules`` are the decisive statements.
    """
    q = requests.select("principal", "action", "resource").distinct()
    s = statements.select("rule_id", "effect", F.col("principal").alias("holder"), F.col("action").alias("granted"), F.col("resource").alias("selector"))
    holders = q.select("principal").distinct().join(principals.select("principal", "holder"), "principal", "left")
    holders = union_all([holders.where("holder IS NOT NULL"), q.select("principal", F.col("principal").alias("holder")), q.select("principal", F.lit("*").alias("holder"))]).distinct()
    where = reached_resources(q, ancestors, statements)
    # statements meet principals and resources by equal keys; a pair of the request needs both
    who = holders.join(s, "holder").select("principal", "rule_id", "effect", "granted", "selector").distinct()
    on = q.join(where, "resource").join(who, ["principal", "selector"])
    covers = (F.col("granted") == "*") | (F.col("granted") == F.col("action")) | (F.col("granted") == "admin") | (F.col("granted").endswith("*") & F.col("action").startswith(F.expr("substring(granted, 1, length(granted) - 1)")))
    hit = on.where(F.col("action").isNull() | covers)
    key = F.struct("principal", "action", "resource")
    g = hit.groupBy(key.alias("q")).agg(
        F.array_sort(F.collect_set(F.when(F.col("effect") == "deny", F.struct("rule_id", "granted")))).alias("denies"),
        F.array_sort(F.collect_set(F.when(F.col("effect") == "allow", F.struct("rule_id", "granted")))).alias("allows"))

    def action_covers(a: Column, b: Column) -> Column:
        return (a == "*") | (a == b) | (a.endswith("*") & b.startswith(F.substring(a, 1, F.length(a) - 1)))

    survives = F.exists("allows", lambda a: ~F.exists("denies", lambda d: action_covers(d["granted"], a["granted"])))
    denied = (F.size("denies") > 0) & (F.col("q.action").isNotNull() | ~survives)
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["rule_id"])))
    found = g.select(F.col("q").alias("request"), F.when(denied, "deny").when(F.size("allows") > 0, "allow").alias("found"), F.when(denied, names("denies")).otherwise(names("allows")).alias("rules"))
    out = q.withColumn("q", key).join(found, F.col("q").eqNullSafe(F.col("request")), "left").select("principal", "action", "resource", "found", "rules")
    return out.select("principal", "action", "resource", F.coalesce("found", F.lit(default)).alias("decision"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), F.col("found").isNull().alias("by_default"))


def acting_as(edges: DataFrame, who: DataFrame) -> DataFrame:
    """(principal, holder): a principal, the groups it is in at any distance, and the roles of all of them."""
    groups = closure(edges, who.select(F.col("principal").alias("start")).distinct(), 50, F.col("type") == "MEMBER_OF").select(F.col("start").alias("principal"), F.col("node").alias("holder"))
    groups = cut(groups.unionByName(who.select("principal", F.col("principal").alias("holder"))).distinct())
    roles = edges.where("type = 'HAS_ROLE'").select(F.col("src").alias("holder"), F.col("dst").alias("role"))
    return groups.unionByName(groups.join(roles, "holder").select("principal", F.col("role").alias("holder"))).distinct()


def lies_in(edges: DataFrame, what: DataFrame) -> DataFrame:
    """(resource, parent): a resource and all that contains or runs it, at any distance."""
    up = closure(edges, what.select(F.col("resource").alias("start")).distinct(), 50, F.col("type").isin("CONTAINS", "RUNS"), frm="dst", to="src")
    return up.select(F.col("start").alias("resource"), F.col("node").alias("parent")).unionByName(what.select("resource", F.col("resource").alias("parent"))).distinct()


# ---------------------------------------------------------------- both together


def _verdicts(asked: DataFrame, rules: DataFrame, policies: DataFrame) -> DataFrame:
    """(src, dst, wanted, ok, rules) per distinct (src, dst, src_ip, dst_ip, wanted): allowed where every governing policy allows; no row where none governs."""
    d = decide_ports(asked, rules, policies)
    effective = F.transform(F.filter("decided", lambda x: x["effect"] == F.col("decision")), lambda x: F.concat("policy_id", F.lit(":"), F.coalesce(x["rule_id"], F.lit("default"))))
    g = d.groupBy("src_ip", "dst_ip", "wanted").agg(F.bool_and(F.col("decision") == "allow").alias("ok"), F.array_sort(F.flatten(F.collect_list(effective))).alias("rules"))
    return asked.select("src", "dst", "src_ip", "dst_ip", "wanted").distinct().join(g, ["src_ip", "dst_ip", "wanted"]).select("src", "dst", "wanted", "ok", "rules")


def decide(requests: DataFrame, edges: DataFrame, hosts: DataFrame, rules: DataFrame, policies: DataFrame, statements: DataFrame) -> DataFrame:
    """One row per distinct (subject, verb, target): decision, kind (``direct``, ``pivot``, ``none``), network and identity verdicts with their rules, and pivots.

    ``hosts(host, ip)``: one address per host; targets without one have no network verdict. A principal starts from hosts it owns, else from its first five
    session hosts by name; the first of them that every governing policy lets through counts. It is judged itself and, if denied, by the first of its
    identities that is allowed. A request that the network denies is tried through one more host: hosts the subject owns, has sessions on or may log into.
    Legs are only asked for where they can matter: the first leg for requests denied, the second for hosts whose first leg is open.
    """
    kind_of = lambda c: F.substring_index(c, ":", 1)
    # written once: else every leg plans and evaluates them anew, and the driver holds all these plans
    hosts, rules, policies, statements = cut(hosts.select("host", "ip")), cut(rules), cut(policies), cut(statements)
    edges = cut(edges.where(F.col("type").isin("OWNS", "LOGGED_INTO", "USES", "HAS_IDENTITY", "MEMBER_OF", "HAS_ROLE", "CONTAINS", "RUNS")).select("src", "type", "dst"))
    q = cut(requests.select("subject", "verb", "target", wanted_ports(F.col("verb")).alias("wanted")).distinct())
    is_principal = kind_of("subject").isin(PRINCIPALS)
    to_host = edges.where(F.col("dst").startswith("host:"))
    owned = to_host.where("type = 'OWNS' AND src LIKE 'user:%'").select(F.col("src").alias("subject"), F.col("dst").alias("host"), F.lit(0).alias("rank"))
    sessions = to_host.where("type = 'LOGGED_INTO' AND (src LIKE 'user:%' OR src LIKE 'identity:%')").select(F.col("src").alias("subject"), F.col("dst").alias("host"), F.lit(1).alias("rank"))
    used = edges.where("type = 'USES' AND src LIKE 'host:%' AND dst LIKE 'identity:%'").select(F.col("dst").alias("subject"), F.col("src").alias("host"), F.lit(0).alias("rank"))
    subjects = q.where(is_principal).select("subject").distinct()
    around = union_all([owned, sessions, used]).join(subjects, "subject", "left_semi").groupBy("subject", "host").agg(F.min("rank").alias("rank"))
    around = cut(around.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy("rank", "host"))).withColumn("owns", F.max(F.col("rank") == 0).over(Window.partitionBy("subject")) & F.col("subject").startswith("user:")))
    starts = around.where(F.when(F.col("owns"), F.col("rank") == 0).otherwise(F.col("place") <= MAX_SESSIONS)).select("subject", F.col("host").alias("src"), "place")
    itself = q.where(~is_principal).select("subject").distinct().select("subject", F.col("subject").alias("src"), F.lit(1).alias("place"))
    starts = cut(starts.unionByName(itself))
    ip = lambda side: hosts.select(F.col("host").alias(side), F.col("ip").alias(f"{side}_ip"))

    direct = q.join(starts, "subject").join(ip("src"), "src").join(ip("dst"), F.col("target") == F.col("dst"))
    seen = direct.select("subject", "verb", "target", "place", "src", "dst", "wanted").join(_verdicts(direct, rules, policies), ["src", "dst", "wanted"], "left")
    # the first source let through; else the first, which has no verdict if nothing governs it
    best = F.min_by(F.struct("src", "ok", "rules"), F.struct(~F.coalesce("ok", F.lit(False)), F.col("place")))
    net = cut(seen.groupBy("subject", "verb", "target").agg(best.alias("net")).select("subject", "verb", "target", F.col("net.ok").alias("net_ok"), F.col("net.src").alias("source"), F.col("net.rules").alias("net_rules")))

    asked = q.where(is_principal & ~F.col("verb").isin(NETWORK_ONLY)).select(
        "subject", "verb", F.col("subject").alias("principal"), F.when(F.col("verb").isin(GENERIC), None).otherwise(F.col("verb")).alias("action"), F.col("target").alias("resource"))
    other = edges.where("type = 'HAS_IDENTITY'").select(F.col("src").alias("subject"), F.col("dst").alias("identity"))
    also = asked.join(other, "subject").withColumn("principal", F.col("identity")).drop("identity")
    everyone = asked.unionByName(also)
    closures = cut(acting_as(edges, everyone.select("principal").unionByName(subjects.select(F.col("subject").alias("principal")))))
    judged = cut(decide_access(everyone, statements, closures, lies_in(edges, everyone)))
    each = everyone.join(judged.withColumnRenamed("action", "act"), (everyone["principal"] == judged["principal"]) & (everyone["resource"] == judged["resource"]) & F.col("action").eqNullSafe(F.col("act"))).select(
        "subject", "verb", everyone["resource"].alias("target"), everyone["principal"].alias("principal"), "decision", "rules")
    own = F.col("principal") == F.col("subject")
    # an identity counts only where it is allowed and the subject itself is not
    order = F.struct(F.when(own & (F.col("decision") == "allow"), 0).when(~own & (F.col("decision") == "allow"), 1).when(own, 2).otherwise(3), F.col("principal"))
    ident = each.groupBy("subject", "verb", "target").agg(F.min_by(F.struct("principal", "decision", "rules"), order).alias("i")).select(
        "subject", "verb", "target", F.col("i.decision").alias("identity"), F.col("i.principal").alias("as_principal"), F.col("i.rules").alias("identity_rules"))

    # ---- one host in between, for what the network denies
    blocked = cut(q.where(is_principal).join(net.where("net_ok = false"), ["subject", "verb", "target"], "left_semi"))
    logins = statements.where((F.col("effect") == "allow") & (F.col("action").isin(LOGIN_ACTIONS) | F.col("action").startswith("ssh")) & F.col("resource").startswith("host:") & ~F.contains("resource", F.lit("*")))
    everybody = closures.select("principal", "holder").unionByName(closures.select("principal", F.lit("*").alias("holder")).distinct())
    may = everybody.join(logins.select(F.col("principal").alias("holder"), F.col("resource").alias("host")).distinct(), "holder").select(F.col("principal").alias("subject"), "host", F.lit(1_000_000).alias("place"))
    candidates = around.select("subject", "host", "place").unionByName(may).join(blocked.select("subject").distinct(), "subject", "left_semi").groupBy("subject", "host").agg(F.min("place").alias("place"))
    pivots = candidates.join(starts.select("subject", F.col("src").alias("host")), ["subject", "host"], "left_anti")
    first = pivots.join(starts.withColumnRenamed("place", "from_place"), "subject").withColumn("dst", F.col("host")).withColumn("wanted", _ports_of(PIVOT_PORTS))
    first = cut(first.join(ip("src"), "src").join(ip("dst"), "dst"))
    open1 = _verdicts(first, rules, policies).where("ok").select("src", "dst", F.col("rules").alias("rules1"))
    leg1 = first.join(open1, ["src", "dst"]).groupBy("subject", "host", "place").agg(F.min_by(F.struct("src", "rules1"), "from_place").alias("leg1"))
    second = blocked.join(cut(leg1), "subject").where("host <> target").withColumns({"src": F.col("host"), "dst": F.col("target")}).join(ip("src"), "src").join(ip("dst"), "dst")
    second = cut(second)
    open2 = _verdicts(second, rules, policies).where("ok").select("src", "dst", "wanted", F.col("rules").alias("rules2"))
    leg2 = second.join(open2, ["src", "dst", "wanted"]).select("subject", "verb", "target", F.struct("place", F.col("host").alias("pivot"), F.col("leg1.src").alias("source"), F.col("leg1.rules1").alias("rules1"), "rules2").alias("p"))
    ranked = leg2.withColumn("n", F.row_number().over(Window.partitionBy("subject", "verb", "target").orderBy("p.place", "p.pivot"))).where(F.col("n") <= MAX_PIVOTS)
    ways = ranked.groupBy("subject", "verb", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: F.struct(x["p"]["pivot"].alias("pivot"), x["p"]["source"].alias("source"), x["p"]["rules1"].alias("rules1"), x["p"]["rules2"].alias("rules2"))).alias("pivots"))

    keys = ["subject", "verb", "target"]
    out = q.join(net, keys, "left").join(cut(ident), keys, "left").join(cut(ways), keys, "left")
    allowed = F.coalesce("net_ok", F.lit(True)) & F.coalesce(F.col("identity") == "allow", F.lit(True))
    decision = F.when(F.col("net_ok").isNull() & F.col("identity").isNull(), "not-evaluated").when(allowed, "allow").otherwise("deny")
    return out.withColumn("decision", decision).select(
        *keys, "decision", F.when(F.col("decision") == "allow", "direct").when(F.size("pivots") > 0, "pivot").otherwise("none").alias("kind"),
        F.when(F.col("net_ok"), "allow").when(~F.col("net_ok"), "deny").alias("network"), "source", "net_rules", "identity", "as_principal", "identity_rules", "pivots")


# ---------------------------------------------------------------- what-ifs on rules


def insert_deny(rules: DataFrame, policy: str, src: str, dst: str, denied: list[str], rule: str = "inserted-deny") -> DataFrame:
    """The rules with a deny before all others of a policy."""
    first = rules.where(F.col("policy_id") == policy).agg(F.min("ord").alias("low"))
    new = first.select(
        F.lit(policy).alias("policy_id"), F.lit(rule).alias("rule_id"), (F.coalesce("low", F.lit(1)) - 1).cast("int").alias("ord"), F.lit("deny").alias("effect"), F.lit(src).alias("src_cidr"),
        F.lit(dst).alias("dst_cidr"), F.lit(True).alias("enabled"), ports.parse(F.array(*[F.lit(p) for p in denied])).alias("ports"))
    return rules.unionByName(new)


def disable_rule(rules: DataFrame, policy: str, rule: str) -> DataFrame:
    return rules.withColumn("enabled", F.col("enabled") & ~((F.col("policy_id") == policy) & (F.col("rule_id") == rule)))


def regions(ends: DataFrame, nets: DataFrame) -> DataFrame:
    """(cidr, region): each network of ``ends(cidr)`` in regions on which all networks of ``nets(cidr)`` agree.

    A region is named by the smallest network around it: that network without those of ``nets`` inside it. Regions that these fill up wholly are left out.
    """
    n = nets.select(network("cidr").alias("net"), F.col("cidr").alias("text")).where("net IS NOT NULL").groupBy("net").agg(F.min("text").alias("text"))
    n = cut(n.select("net", "text"))
    e = ends.select("cidr", network("cidr").alias("net")).where("net IS NOT NULL").distinct()

    def around(outer: DataFrame, inner: DataFrame) -> DataFrame:
        """Pairs of an inner network and an outer one that holds it and is not the same."""
        o = _listed(outer, F.col("net")).withColumnRenamed("net", "outer_net")
        lengths = sorted(("at", x[0]) for x in o.select("key_len").distinct().collect())
        probe = _probed(inner.withColumnRenamed("net", "inner_net"), lengths, {"at": "inner_net"}, "inner_net").join(o, ["key_len", "key_hi", "key_lo", "salt"])
        return probe.withColumnsRenamed({"inner_net": "inner", "outer_net": "outer"}).where(F.col("inner.len") > F.col("outer.len"))

    # the nearest network of ``nets`` around each one, and how much of a network its children fill
    nearest = around(n.select("net"), n.select("net")).groupBy("inner").agg(F.max_by("outer", "outer.len").alias("parent"))
    filled = nearest.groupBy("parent").agg(F.sum(F.pow(F.lit(2.0), F.col("parent.len") - F.col("inner.len"))).alias("part"))
    inside = cut(around(e, n).select("cidr", F.col("inner").alias("net"), "text", "outer"))
    of_nets = inside.join(filled, F.col("net") == F.col("parent"), "left").where("part IS NULL OR part < 1").select("cidr", F.col("text").alias("region"))
    # children of an end: networks inside it whose nearest one is not
    up = inside.join(nearest, F.col("net") == F.col("inner"), "left").where(F.col("parent").isNull() | (F.col("parent.len") <= F.col("outer.len")))
    own = up.groupBy("cidr").agg(F.sum(F.pow(F.lit(2.0), F.col("outer.len") - F.col("net.len"))).alias("part"))
    of_ends = e.join(own, "cidr", "left").where("part IS NULL OR part < 1").select("cidr", F.col("cidr").alias("region"))
    return of_nets.unionByName(of_ends)


def reach_after(edges: DataFrame, before: DataFrame, after: DataFrame, policies: DataFrame) -> DataFrame:
    """What a change of rules does to reachability ``edges(src, dst, src_cidr, dst_cidr, ports)``: (src, dst, status, left, gained).

    Both ends are cut into regions on which the rules of both sides agree; on each pair of regions an edge loses the ports that were allowed before and are not
    after. ``status``: ``kept`` with all ports everywhere, ``lost`` with none anywhere, else ``narrowed``; ``left``: ports that are left somewhere; ``gained``:
    ports that only the new rules allow. Only rules that are enabled cut.
    """
    both = before.where("enabled").unionByName(after.where("enabled"))
    nets = both.select(F.explode(F.array("src_cidr", "dst_cidr")).alias("cidr")).unionByName(policies.select(F.explode("scope").alias("cidr"))).distinct()
    ends = edges.select(F.explode(F.array("src_cidr", "dst_cidr")).alias("cidr")).distinct()
    r = cut(regions(ends, nets))
    cells = edges.select("src", "dst", "src_cidr", "dst_cidr", "ports").join(r.select(F.col("cidr").alias("src_cidr"), F.col("region").alias("src_ip")), "src_cidr").join(
        r.select(F.col("cidr").alias("dst_cidr"), F.col("region").alias("dst_ip")), "dst_cidr")
    cells = cut(cells.select("src", "dst", "src_ip", "dst_ip", "ports"))
    asked = cells.select("src_ip", "dst_ip").distinct().withColumn("wanted", ports.everything())

    def allowed(rules: DataFrame, name: str) -> DataFrame:
        """Ports that every governing policy allows; all where none governs."""
        d = decide_ports(asked, rules, policies).groupBy("src_ip", "dst_ip").agg(F.array_sort(F.collect_list("allowed")).alias("each"))
        return d.select("src_ip", "dst_ip", F.aggregate("each", ports.everything(), ports.intersect).alias(name))

    was, now = F.coalesce("was", ports.everything()), F.coalesce("now", ports.everything())
    c = cells.join(allowed(before, "was"), ["src_ip", "dst_ip"], "left").join(allowed(after, "now"), ["src_ip", "dst_ip"], "left")
    c = c.withColumns({"left": ports.subtract(F.col("ports"), ports.subtract(was, now)), "gained": ports.subtract(now, was)})
    g = c.groupBy("src", "dst", "ports").agg(
        F.bool_and(F.size("left") == 0).alias("gone"), F.bool_and(ports.covers(F.col("left"), F.col("ports"))).alias("whole"),
        ports.merge(F.flatten(F.collect_set("left"))).alias("left"), ports.merge(F.flatten(F.collect_set("gained"))).alias("gained"))
    return g.select("src", "dst", F.when(F.col("gone"), "lost").when(F.col("whole"), "kept").otherwise("narrowed").alias("status"), "left", "gained")
