"""SQL text for checks that need the same statement at every level."""

from __future__ import annotations

ARC_SQL = """
x AS (SELECT *, split_part(src, ':', 1) AS st, split_part(dst, ':', 1) AS dt, 0.5 + 0.5 * conf AS w FROM rel WHERE src <> dst),
fw AS (SELECT src AS frm, dst AS nxt, type AS rl, true AS fwd, CASE WHEN type = 'CAN_REACH' OR (type = 'MEMBER_OF' AND st NOT IN
 ('user', 'identity', 'group', 'role', 'permission')) THEN 'reach' ELSE 'control' END AS mode, (CASE type WHEN 'LOGGED_INTO' THEN 0.8
 WHEN 'CAN_ACCESS' THEN 0.9 WHEN 'USES' THEN 0.8 WHEN 'RUNS' THEN 0.9 WHEN 'CONTAINS' THEN 0.9 WHEN 'CONTAINS_SECRET' THEN 0.9
 WHEN 'OWNS' THEN 0.6 WHEN 'CAN_REACH' THEN 0.9 ELSE 1.0 END)::DOUBLE * w AS f, dt AS tt, type FROM x
 WHERE type NOT IN ('AFFECTS', 'TRUSTS')),
bw AS (SELECT dst AS frm, src AS nxt, type AS rl, false AS fwd, CASE type WHEN 'MEMBER_OF' THEN 'reach' WHEN 'TRUSTS' THEN 'trust'
 ELSE 'control' END AS mode, (CASE type WHEN 'LOGGED_INTO' THEN 0.5 WHEN 'RUNS' THEN 0.4 WHEN 'TRUSTS' THEN 0.8 ELSE 1.0
 END)::DOUBLE * w AS f, st AS tt, type FROM x WHERE type IN ('LOGGED_INTO', 'RUNS', 'TRUSTS') OR (type = 'MEMBER_OF' AND st = 'host')),
arc AS MATERIALIZED (SELECT a.frm, a.nxt, a.rl, a.mode, a.f, a.s, (a.rl = 'ADMIN_OF' OR (a.tt IN ('role', 'identity', 'group') AND
 coalesce(o.privileged, false))) AS priv, ((a.rl IN ('USES', 'AUTHENTICATES_AS', 'CONTAINS_SECRET') AND a.fwd) OR
 (a.rl = 'LOGGED_INTO' AND NOT a.fwd)) AS cred, CASE WHEN a.rl IN ('CAN_REACH', 'CONNECTED_TO') THEN 1 ELSE 0 END AS net FROM (
 SELECT *, 'C' AS s FROM fw UNION ALL SELECT *, 'C' FROM bw UNION ALL SELECT *, 'R' FROM fw WHERE mode = 'reach' UNION ALL
 SELECT *, 'R' FROM bw WHERE mode = 'reach' UNION ALL SELECT src, dst, type, true, 'reach', w, dt, type, 'R' FROM x WHERE type = 'RUNS'
 ) a LEFT JOIN obj o ON o.id = a.nxt WHERE NOT (a.mode = 'control' AND a.tt IN ('user', 'identity') AND coalesce(o.disabled, false))),
vul AS MATERIALIZED (SELECT dst AS node, vid, 0.6::DOUBLE * least(score, 10.0) / 10.0 AS up FROM (SELECT r.dst, r.src AS vid, o.cvss AS
 score, row_number() OVER (PARTITION BY r.dst ORDER BY o.cvss DESC, r.src) AS n FROM rel r JOIN obj o ON o.id = r.src WHERE
 r.type = 'AFFECTS' AND o.cvss >= 7) WHERE n = 1)"""


def propagate_ctes(
    name: str, starts: str, depth: int, floor: float, mode: str = "control", upgrade: bool = False, rels: str | None = None
) -> str:
    """CTEs that end in ``<name>(start, node, mode, conf, depth, priv, cred, trust, net, vid)``; needs ``ARC_SQL``."""
    p = name
    cols = "start, node, mode, conf, depth, prev, rl, priv, cred, trust, net, vid"
    only = f" AND a.rl IN ({rels})" if rels else ""

    def pick(src: str, known: str) -> str:
        return (
            f"SELECT {cols} FROM (SELECT e.*, row_number() OVER (PARTITION BY e.start, e.node, e.mode ORDER BY e.conf DESC, e.priv, "
            f"e.cred, e.trust, e.net, e.vid NULLS FIRST) AS rn, k.known FROM {src} e LEFT JOIN {known} k ON k.start = e.start AND k.node = e.node AND k.mode = e.mode) "
            f"WHERE rn = 1 AND conf > coalesce(known, -1) + 1e-12"
        )

    out = [
        f"{p}0 AS MATERIALIZED (SELECT start, start AS node, '{mode}' AS mode, 1.0::DOUBLE AS conf, 0 AS depth, '' AS prev, '' AS rl, "
        f"false AS priv, false AS cred, false AS trust, 0 AS net, NULL::VARCHAR AS vid FROM ({starts}) s)"
    ]
    levels = [f"{p}0"]
    if upgrade and mode == "reach":
        out.append(
            f"{p}0u AS MATERIALIZED (SELECT l.start, l.node, 'control' AS mode, l.conf * v.up AS conf, l.depth, '' AS prev, "
            f"'' AS rl, l.priv, l.cred, l.trust, l.net, coalesce(l.vid, v.vid) AS vid FROM {p}0 l JOIN vul v "
            f"ON v.node = l.node WHERE l.conf * v.up >= {floor})"
        )
        out.append(f"{p}0f AS MATERIALIZED (SELECT {cols} FROM {p}0 UNION ALL SELECT {cols} FROM {p}0u)")
        levels = [f"{p}0f"]
    for d in range(1, depth + 1):
        union = " UNION ALL ".join(f"SELECT start, node, mode, conf FROM {x}" for x in levels)
        out.append(f"{p}k{d} AS MATERIALIZED (SELECT start, node, mode, max(conf) AS known FROM ({union}) GROUP BY ALL)")
        out.append(
            f"{p}e{d} AS (SELECT l.start, a.nxt AS node, a.mode, l.conf * a.f AS conf, {d} AS depth, l.node AS prev, a.rl, "
            f"l.priv OR a.priv AS priv, l.cred OR a.cred AS cred, l.trust OR a.mode = 'trust' AS trust, l.net + a.net AS net, l.vid "
            f"FROM {levels[-1]} l JOIN arc a ON a.frm = l.node AND a.s = CASE WHEN l.mode = 'reach' THEN 'R' ELSE 'C' END{only} "
            f"WHERE l.conf * a.f >= {floor})"
        )
        out.append(f"{p}n{d} AS MATERIALIZED ({pick(f'{p}e{d}', f'{p}k{d}')})")
        if upgrade and d < depth:
            out.append(
                f"{p}u{d} AS (SELECT l.start, l.node, 'control' AS mode, l.conf * v.up AS conf, l.depth, '' AS prev, "
                f"'' AS rl, l.priv, l.cred, l.trust, l.net, coalesce(l.vid, v.vid) AS vid FROM {p}n{d} l JOIN vul v "
                f"ON v.node = l.node WHERE l.mode = 'reach' AND l.conf * v.up >= {floor})"
            )
            out.append(
                f"{p}{d} AS MATERIALIZED (SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY start, node, mode ORDER BY conf "
                f"DESC, depth, priv, cred, trust, net, vid NULLS FIRST) AS rn FROM (SELECT {cols} FROM {p}n{d} UNION ALL ({pick(f'{p}u{d}', f'{p}k{d}')}))) "
                f"WHERE rn = 1)"
            )
            levels.append(f"{p}{d}")
        else:
            levels.append(f"{p}n{d}")
    every = " UNION ALL ".join(f"SELECT {cols} FROM {x}" for x in levels)
    out.append(
        f"{p} AS MATERIALIZED (SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY CASE mode WHEN 'reach' "
        f"THEN 2 ELSE 1 END, conf DESC, depth, mode) AS rn FROM ({every}) WHERE node <> start) WHERE rn = 1)"
    )
    return ", ".join(out)


def closure_ctes(name: str, starts: str, where: str, hops: int, frm: str = "src", to: str = "dst") -> str:
    """CTEs that end in ``<name>(start, node, chain, hops)``: shortest chains, smallest chain among equals."""
    out = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT start, start AS node, [start] AS chain, 0 AS hops FROM ({starts}) s)"]
    seen = [f"{name}0"]
    for d in range(1, hops + 1):
        known = " UNION ALL ".join(f"SELECT start, node FROM {x}" for x in seen)
        out.append(
            f"{name}{d} AS MATERIALIZED (SELECT l.start, e.{to} AS node, min(list_append(l.chain, e.{to})) AS chain, {d} AS hops FROM "
            f"{seen[-1]} l JOIN rel e ON e.{frm} = l.node AND {where} WHERE NOT EXISTS (SELECT 1 FROM ({known}) k WHERE "
            f"k.start = l.start AND k.node = e.{to}) GROUP BY l.start, e.{to})"
        )
        seen.append(f"{name}{d}")
    out.append(f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {x}' for x in seen)})")
    return ", ".join(out)
