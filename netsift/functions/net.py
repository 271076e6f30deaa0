"""IP address columns: integers, ranges, membership, direction.

IPv4 tests against known ranges are integer arithmetic. Ranges that come as data, and
IPv6, use keys: the family digit and the address in hexadecimal, which sort as numbers do.
All of it is built-in functions.
"""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsift.constants import INTERNAL_RANGES, PRIVATE_RANGES, PRIVATE_V6_RANGES

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
CIDR4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(/(3[0-2]|[12]?[0-9]))?$"


def ip_to_int(ip: Column) -> Column:
    """IPv4 text -> BIGINT, null when the text is not a valid IPv4 address."""
    total = F.lit(0).cast("bigint")
    for part in range(1, 5):
        total = total * 256 + F.split_part(ip, F.lit("."), F.lit(part)).cast("bigint")
    return F.when(ip.rlike(IPV4_PATTERN), total)


V6_GROUPS = r"[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
V6_TEXT = rf"^({V6_GROUPS})?(::({V6_GROUPS})?)?$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _v6_hex(ip: Column) -> Column:
    """IPv6 text -> 32 hexadecimal digits, null when invalid; a dotted tail counts as two groups."""

    def plain(tail: Column) -> Column:
        as_groups = lambda n: F.concat_ws(":", F.lower(F.hex(F.floor(n / 65536))), F.lower(F.hex(F.pmod(n, F.lit(65536)))))
        head = F.substring(ip, F.lit(1), F.length(ip) - F.length(tail))
        return F.lower(let(ip_to_int(tail), lambda n: F.when(n.isNotNull(), F.concat(head, as_groups(n))).otherwise(ip)))

    def sides(text: Column) -> Column:
        groups = lambda part: F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(part)), ":"), lambda g: g != "")
        return F.when(
            text.contains(":") & text.rlike(V6_TEXT),
            F.struct(groups(1).alias("left"), groups(2).alias("right"), text.contains("::").alias("short")),
        )

    def digits(s: Column) -> Column:
        gap = 8 - F.size(s["left"]) - F.size(s["right"])
        wide = lambda part: F.array_join(F.transform(part, lambda g: F.lpad(g, 4, "0")), "")
        fits = F.when(s["short"], gap >= 1).otherwise(gap == 0)
        return F.when(fits, F.concat(wide(s["left"]), F.repeat(F.lit("0000"), gap), wide(s["right"])))

    return let(let(let(F.element_at(F.split(ip, ":"), -1), plain), sides), digits)


def ip_key(ip: Column) -> Column:
    """Sortable text of an address: the family and its hexadecimal digits; null when invalid."""
    number = ip_to_int(ip)
    v4 = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 8, "0"))
    return F.when(ip.contains(":"), F.concat(F.lit("6"), _v6_hex(ip))).otherwise(v4)


def masked_key(key: Column, prefix: Column, fill: str = "0") -> Column:
    """The first key of the range of ``prefix`` bits around an address (the last one with ``fill='f'``)."""
    nibbles, rest = F.floor(prefix / 4).cast("int"), F.pmod(prefix, F.lit(4)).cast("int")
    step = F.element_at(F.array(*[F.lit(n) for n in (16, 8, 4, 2)]), rest + 1)
    edge = lambda digit: digit - F.pmod(digit, step) + (F.lit(0) if fill == "0" else step - 1)
    digit = F.conv(F.substring(key, nibbles + 2, F.lit(1)), 16, 10).cast("int")
    last = let(digit, lambda d: F.lower(F.hex(edge(d).cast("bigint"))))
    cut = F.concat(F.substring(key, F.lit(1), nibbles + 1), F.when(rest > 0, last).otherwise(F.lit("")))
    return F.rpad(cut, F.length(key), F.lit(fill))


def cidr_bounds(cidr: Column) -> Column:
    """CIDR text of either family -> struct(lo, hi, prefix) of address keys; host bits allowed, null when invalid."""
    length = F.split_part(cidr, F.lit("/"), F.lit(2))

    def bounds(p: Column) -> Column:
        bits = F.when(p["key"].startswith("6"), 128).otherwise(32)
        prefix = F.coalesce(p["prefix"], bits)
        return F.when(
            p["key"].isNotNull() & p["good"] & prefix.between(0, bits),
            F.struct(
                masked_key(p["key"], prefix).alias("lo"), masked_key(p["key"], prefix, "f").alias("hi"), prefix.alias("prefix")
            ),
        )

    given = F.when(cidr.contains("/"), F.when(length.rlike("^[0-9]{1,3}$"), length.cast("int")).otherwise(-1))
    good = F.when(cidr.contains(":"), True).otherwise(cidr.rlike(CIDR4_PATTERN))
    parts = F.struct(ip_key(F.split_part(cidr, F.lit("/"), F.lit(1))).alias("key"), given.alias("prefix"), good.alias("good"))
    return let(F.when(cidr.isNotNull(), parts), bounds)


def parse_range(cidr: str) -> tuple[int, int] | None:
    """Bounds of one IPv4 range known while the plan is built; None when invalid or IPv6."""
    try:
        network = ipaddress.ip_network(cidr, strict=False)
    except ValueError:
        return None
    if network.version != 4:
        return None
    return int(network.network_address), int(network.broadcast_address)


def in_ranges(number: Column, ranges: list[str]) -> Column:
    """Is the IPv4 integer inside any of the ranges (never null)."""
    test = F.lit(False)
    for cidr in ranges:
        bounds = parse_range(str(cidr))
        if bounds is not None:
            test = test | number.between(*bounds)
    return F.coalesce(test, F.lit(False))


def in_cidrs(ip: Column, ranges: list[str], number: Column | None = None) -> Column:
    """Address text inside any range of its family (never null)."""
    test = in_ranges(ip_to_int(ip) if number is None else number, ranges)
    known = []
    for cidr in ranges:
        try:
            network = ipaddress.ip_network(str(cidr), strict=False)
        except ValueError:
            continue
        if network.version == 6:
            known.append(tuple(f"{int(end):032x}" for end in (network.network_address, network.broadcast_address)))
    if known:
        inside = let(_v6_hex(ip), lambda v: reduce(or_, [v.between(*ends) for ends in known]))
        test = test | F.coalesce(F.when(ip.contains(":"), inside), F.lit(False))
    return test


def is_internal(ip: Column) -> Column:
    return in_ranges(ip_to_int(ip), INTERNAL_RANGES)


def is_private_or_local(ip: Column) -> Column:
    """Private IPv4, or IPv6 in fc00::/7 or fe80::/10 judged by the first group."""
    head = F.lower(ip)
    v6 = head.rlike(r"^f[cd][0-9a-f]{2}:") | head.rlike(r"^fe[89ab][0-9a-f]:")
    return in_ranges(ip_to_int(ip), PRIVATE_RANGES) | F.coalesce(v6, F.lit(False))


V6_TEXT_PATTERN = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"


def fallback_zone(ip: Column) -> Column:
    valid = ip.rlike(IPV4_PATTERN) | ip.rlike(V6_TEXT_PATTERN)
    return (
        F.when(~F.coalesce(valid, F.lit(False)), F.lit("unknown"))
        .when(is_private_or_local(ip), F.lit("internal-unknown"))
        .otherwise(F.lit("external-unknown"))
    )


def flow_direction(src_ip: Column, dst_ip: Column) -> Column:
    side = lambda ip: F.when(is_internal(ip), F.lit("internal")).otherwise(F.lit("external"))
    return F.concat(side(src_ip), F.lit("_to_"), side(dst_ip))


PRIVATE_NETWORKS = PRIVATE_RANGES + PRIVATE_V6_RANGES
