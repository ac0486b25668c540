"""Port sets as sorted arrays of (proto, lo, hi) ranges that do not touch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.folds import once

# Protocols with their highest port or type number, and service names.
PROTO_MAX = {"tcp": 65535, "udp": 65535, "icmp": 255}
WELL_KNOWN = {
    "ssh": "tcp/22", "rdp": "tcp/3389", "http": "tcp/80", "https": "tcp/443", "dns": "udp/53", "ldap": "tcp/389",
    "ldaps": "tcp/636", "smb": "tcp/445", "postgres": "tcp/5432", "mysql": "tcp/3306", "openvpn": "udp/1194",
    "winrm": "tcp/5985",
}
RANGE = "struct<proto:string,lo:int,hi:int>"


def _range(proto, lo, hi) -> Column:
    p = proto if isinstance(proto, Column) else F.lit(proto)
    return F.struct(p.alias("proto"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def everything() -> Column:
    return F.array(*[_range(p, F.lit(0), F.lit(m)) for p, m in PROTO_MAX.items()])


def merge(ranges: Column) -> Column:
    """Sorted, with overlapping and adjacent ranges joined."""
    empty = F.array().cast(f"array<{RANGE}>")
    start = F.struct(empty.alias("done"), F.lit(None).cast(RANGE).alias("last"))

    def add(acc: Column, r: Column) -> Column:
        last = acc["last"]
        joins = (last["proto"] == r["proto"]) & (r["lo"] <= last["hi"] + 1)
        return F.when(joins, F.struct(acc["done"].alias("done"), _range(last["proto"], last["lo"], F.greatest(last["hi"], r["hi"])).alias("last"))).otherwise(
            F.struct(F.when(last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"), r.alias("last")))

    def all_of(found: Column) -> Column:
        joined = F.aggregate(F.array_sort(found), start, add, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
        return F.when(F.size(found) < 2, found).otherwise(joined)

    return once(ranges, all_of)


def parse(values: Column) -> Column:
    """``any``, ``tcp``, ``tcp/443``, ``udp/1000-2000``, ``443`` or a service name."""
    pattern = r"^(?:(tcp|udp|icmp|any)\s*/\s*)?(\d{1,5})(?:\s*-\s*(\d{1,5}))?$"
    empty = F.array().cast(f"array<{RANGE}>")
    named = F.create_map(*[x for name, label in WELL_KNOWN.items() for x in (F.lit(name), F.array(_range(label.split("/")[0], *[F.lit(int(label.split("/")[1]))] * 2)))])
    top = F.create_map(*[F.lit(x) for pair in PROTO_MAX.items() for x in pair])

    def numbered(m: Column) -> Column:
        each = F.when(m["proto"] == "any", F.transform(everything(), lambda r: _range(r["proto"], m["lo"], F.least(m["hi"], r["hi"])))).otherwise(
            F.array(_range(m["proto"], m["lo"], F.least(m["hi"], top[m["proto"]]))))
        return F.when((m["hi"] >= m["lo"]) & (m["hi"] <= 65535), each).otherwise(empty)

    def parts(x: Column) -> Column:
        proto = F.when(x[0] == "", "tcp").otherwise(x[0])
        return F.struct(proto.alias("proto"), x[1].cast("int").alias("lo"), F.when(x[2] == "", x[1]).otherwise(x[2]).cast("int").alias("hi"))

    def worded(t: Column) -> Column:
        whole = F.regexp_extract(t, r"^(tcp|udp|icmp)(?:\s*/\s*(?:any|\*|all))?$", 1)
        return (
            F.when(t.isin("any", "*", "all") | t.rlike(r"^any\s*/\s*(any|\*|all)$"), everything())
            .when(whole != "", F.filter(everything(), lambda r: r["proto"] == whole)).otherwise(F.coalesce(named[t], empty))
        )

    def one(t: Column) -> Column:
        # a text with a number has no other reading; a last line break is not part of it
        texts = F.split(F.regexp_replace(F.trim(t, F.lit("\r\n\u0085\u2028\u2029")), pattern, "$1,$2,$3"), ",")
        return F.when(t.rlike(pattern), once(once(texts, parts), numbered)).otherwise(worded(t))

    return merge(F.flatten(F.transform(values, lambda v: once(F.lower(F.trim(v)), one))))


def union(a: Column, b: Column) -> Column:
    return merge(F.concat(a, b))


def intersect(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(
        F.filter(b, lambda y: (x["proto"] == y["proto"]) & (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])),
        lambda y: _range(x["proto"], F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"])),
    )))
    return merge(pairs)


def _gaps(a: Column, b: Column) -> Column:
    """For every range of ``a`` the gaps between the cuts of ``b``."""

    def gaps(x: Column) -> Column:
        def between(cuts: Column) -> Column:
            lows = F.concat(F.array(x["lo"]), F.transform(cuts, lambda y: y["hi"] + 1))
            highs = F.concat(F.transform(cuts, lambda y: y["lo"] - 1), F.array(x["hi"]))
            return F.filter(F.zip_with(lows, highs, lambda lo, hi: _range(x["proto"], lo, hi)), lambda r: r["lo"] <= r["hi"])

        return once(F.filter(b, lambda y: (y["proto"] == x["proto"]) & (y["hi"] >= x["lo"]) & (y["lo"] <= x["hi"])), between)

    return F.flatten(F.transform(a, gaps))


def subtract(a: Column, b: Column) -> Column:
    """What is left of ``a`` (both merged)."""
    return merge(_gaps(a, b))


def covers(a: Column, b: Column) -> Column:
    return F.size(_gaps(b, a)) == 0


def overlaps(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["proto"] == y["proto"]) & (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"])))


def size(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, r: acc + (r["hi"] - r["lo"] + 1))


def labels(a: Column) -> Column:
    """Text form in protocol order; ``any`` for everything."""
    order = F.array(*[F.lit(p) for p in PROTO_MAX])
    top = F.create_map(*[F.lit(x) for p, m in PROTO_MAX.items() for x in (p, m)])

    def label(r: Column) -> Column:
        def text(full: Column) -> Column:
            return (
                F.when(full & (r["proto"] == "icmp"), "icmp").when(full, F.concat(r["proto"], F.lit("/all")))
                .when(r["lo"] == r["hi"], F.concat(r["proto"], F.lit("/"), r["lo"].cast("string")))
                .otherwise(F.concat(r["proto"], F.lit("/"), r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string")))
            )

        return once((r["lo"] == 0) & (r["hi"] == top[r["proto"]]), text)

    def texts(s: Column) -> Column:
        known = F.filter(s, lambda r: r["proto"].isin(*PROTO_MAX))
        ordered = F.when(F.size(s) < 2, known).otherwise(F.flatten(F.transform(order, lambda p: F.filter(s, lambda r: r["proto"] == p))))
        # two ranges never make everything
        whole = (F.size(s) > 2) & (size(s) == sum(m + 1 for m in PROTO_MAX.values()))
        return F.when(whole, F.array(F.lit("any"))).otherwise(F.transform(ordered, label))

    return once(a, texts)
