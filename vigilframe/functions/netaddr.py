"""IP addresses as numbers, and their scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.folds import once

# Networks that count as the organization's own.
INTERNAL_V4 = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"]
V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def clean_ip(text: Column) -> Column:
    """The address without brackets and zone; an IPv4-mapped IPv6 address as IPv4."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[+|\]+$", ""), r"%.*$", ""))
    return F.regexp_replace(bare, r"^::ffff:(?=\d+\.\d+\.\d+\.\d+$)", "")


def ipv4_number(text: Column) -> Column:
    """IPv4 text as a long, or null."""
    o = [F.split_part(text, F.lit("."), F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    return F.when(text.rlike(V4), o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3])


def cidr_range(cidr: str) -> tuple[int, int, int]:
    """(lowest, highest, prefix length) of an IPv4 network given as text."""
    address, _, bits = cidr.partition("/")
    length = int(bits or 32)
    base = 0
    for octet in address.split("."):
        base = base * 256 + int(octet)
    size = 1 << (32 - length)
    low = base // size * size
    return low, low + size - 1, length


def network_low(cidr: Column) -> Column:
    size = F.pow(F.lit(2), 32 - prefix_length(cidr)).cast("long")
    base = ipv4_number(F.substring_index(cidr, "/", 1))
    return base - base % size


def prefix_length(cidr: Column) -> Column:
    return F.when(F.instr(cidr, "/") > 0, F.substring_index(cidr, "/", -1).cast("int")).otherwise(F.lit(32))


def prefix_of(address_number: Column, length: Column) -> Column:
    """The network an address belongs to at the given prefix length."""
    size = F.pow(F.lit(2), 32 - length).cast("long")
    return address_number - address_number % size


def address_key(text: Column) -> Column:
    """An address of either family as (family, hi, lo): 4 with its number in ``lo``, 6 with its 128 bits as two longs; null if it is no address."""

    def six(ip: Column) -> Column:
        def groups(part: Column) -> Column:
            return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

        def filled(sides: Column) -> Column:
            left, right = groups(sides[0]), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
            zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
            return F.when(F.size(sides) == 2, F.concat(left, zeros, right)).when(F.size(sides) == 1, left)

        def packed(all_groups: Column) -> Column:
            whole = (F.size(all_groups) == 8) & F.forall(all_groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
            return once(F.when(whole, F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), "")), lambda digits: F.when(digits.isNotNull(), F.struct(
                F.lit(6).alias("family"), F.conv(F.substring(digits, 1, 16), 16, -10).cast("long").alias("hi"), F.conv(F.substring(digits, 17, 16), 16, -10).cast("long").alias("lo"))))

        return once(once(F.split(ip, "::"), filled), packed)

    def either(ip: Column) -> Column:
        four = F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), ipv4_number(ip).alias("lo"))
        return F.when(ip.rlike(V4), four).when(F.contains(ip, F.lit(":")), six(ip))

    return once(clean_ip(text), either)


def network_key(family: Column, hi: Column, lo: Column, length: Column) -> Column:
    """(hi, lo) of the network an address lies in at a prefix length of its family."""

    def masked(half: Column, bits: Column) -> Column:
        return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, half).otherwise(half.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int"))))

    four = F.struct(hi.alias("hi"), masked(lo, length + 32).alias("lo"))
    return F.when(family == 4, four).otherwise(F.struct(masked(hi, length).alias("hi"), masked(lo, length - 64).alias("lo")))


def ip_scope(text: Column, extra: list[str] | None = None) -> Column:
    """internal, public, loopback, link-local, multicast, unspecified, reserved; null if not an address.

    The clean text and its number are computed once per row, however many ranges they are compared with.
    """
    return once(clean_ip(text), lambda ip: once(ipv4_number(ip), lambda n: _scope(ip, n, extra)))


def _scope(ip: Column, n: Column, extra: list[str] | None) -> Column:
    def inside(cidr: str) -> Column:
        low, high, _ = cidr_range(cidr)
        return n.between(low, high)

    internal = F.lit(False)
    for cidr in INTERNAL_V4 + list(extra or []):
        internal = internal | inside(cidr)
    v4 = (
        F.when(n == 0, "unspecified")
        .when(inside("224.0.0.0/4"), "multicast")
        .when(inside("127.0.0.0/8"), "loopback")
        .when(inside("169.254.0.0/16"), "link-local")
        .when(internal, "internal")
        .when(n >= cidr_range("240.0.0.0/4")[0], "reserved")
        .otherwise("public")
    )
    looks_v6 = ip.rlike(r"^[0-9a-f:]*:[0-9a-f:]*(\d+\.\d+\.\d+\.\d+)?$") & (F.length(ip) >= 2)
    v6 = (
        F.when(ip.rlike(r"^(0*:)*:?0*$"), "unspecified")
        .when(ip.rlike(r"^(0*:)*:?0*1$"), "loopback")
        .when(ip.startswith("ff"), "multicast")
        .when(ip.rlike(r"^fe[89ab][0-9a-f]:"), "link-local")
        .when(ip.rlike(r"^f[cd][0-9a-f]{2}:"), "internal")
        .otherwise("public")
    )
    return F.when(n.isNotNull(), v4).when(looks_v6, v6)
