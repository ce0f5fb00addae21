"""Public web addresses by built-in functions: hosts as numbers, held against tables of address ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address blocks that are not public, and those inside them that are (the special-purpose registries of IANA).
V4_CLOSED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()
V4_OPEN = "192.0.0.9/32 192.0.0.10/32".split()
V6_CLOSED = "::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 fc00::/7 fe80::/10".split()
V6_OPEN = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _within(value: Column, blocks: list[str]) -> Column:
    """Whether an address (a long, or 32 hex digits) lies in one of the blocks."""

    def block(text: str) -> Column:
        net = ipaddress.ip_network(text)
        low, high = (int(net[0]), int(net[-1])) if net.version == 4 else (f"{int(net[0]):032x}", f"{int(net[-1]):032x}")
        return value.between(F.lit(low), F.lit(high))

    return reduce(lambda a, b: a | b, map(block, blocks))


def ipv4_number(host: Column) -> Column:
    """A host of one to four numbers (decimal, octal after 0, hex after 0x; the last one fills the rest) as a long, else null."""
    parts = F.split(host, r"\.")

    def number(p: Column) -> Column:
        made = F.when(p.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(p, 3, 16), 16, 10)).when(p.rlike("^0[0-7]{0,20}$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]{0,17}$"), p)
        return made.cast("decimal(20,0)")

    def address(values: Column) -> Column:
        n = F.size(values)
        room = lambda i: F.element_at(F.array(*[F.lit(256**k).cast("decimal(20,0)") for k in (4, 3, 2, 1)]), i)
        fits = F.forall(values, lambda v: v.isNotNull()) & (F.element_at(values, -1) < room(n)) & F.forall(F.slice(values, F.lit(1), n - 1), lambda v: v < 256)
        placed = F.transform(values, lambda v, i: F.when(i < n - 1, v * room(i + 2)).otherwise(v).cast("decimal(38,0)"))
        return F.when((n <= 4) & fits, F.aggregate(placed, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)")).cast("long"))

    return F.transform(F.array(F.transform(parts, number)), address)[0]


def ipv6_digits(host: Column) -> Column:
    """A version 6 address as 32 hex digits, else null; its end may be written as four decimal numbers."""
    return _let(F.regexp_replace(host, "%.*$", ""), lambda plain: _let(_with_groups(plain), _expanded))


def _with_groups(plain: Column) -> Column:
    """The address with its decimal end as two groups; null if that is none."""
    tail = F.regexp_extract(plain, r"^.*:([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)
    groups = _let(ipv4_number(tail), lambda n: F.when(n.isNotNull(), F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(0xFFFF))))))
    return F.when(tail == "", plain).otherwise(F.concat(F.regexp_extract(plain, r"^(.*:)[^:]*$", 1), groups))


def _expanded(text: Column) -> Column:
    sides = F.split(text, "::")
    side = lambda i: F.filter(F.split(F.coalesce(F.get(sides, i), F.lit("")), ":"), lambda g: g != "")

    def digits(both: Column) -> Column:
        left, right = both["left"], both["right"]
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)).cast("int"))
        every = F.concat(left, zeros, right)
        ok = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
        return F.when(ok & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    whole = ~text.rlike(":::|^:[^:]|[^:]:$")
    return F.when(whole, F.transform(F.array(F.struct(side(0).alias("left"), side(1).alias("right"))), digits)[0])


def _global_v4(number: Column) -> Column:
    return ~_within(number, V4_CLOSED) | _within(number, V4_OPEN)


def is_safe_public_url(url: Column) -> Column:
    """P20. http or https, at most 4096 characters, no credentials (not even empty ones), port 80 or 443, and a host that is a
    name other than localhost or a public address, in whatever form it is written. Names are not resolved."""
    text = F.regexp_replace(F.regexp_replace(url, "[\\t\\r\\n]", ""), r"^[\x00-\x20]+", "")

    def parts(authority: Column) -> Column:
        bracket = F.startswith(authority, F.lit("["))
        host = F.when(bracket, F.regexp_extract(authority, r"^\[([^\]]*)\](?::[0-9]*)?$", 1)).otherwise(F.regexp_extract(authority, "^([^:]*)", 1))
        port = F.when(bracket, F.regexp_extract(authority, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(authority, r"^[^:]*:(.*)$", 1))
        bare = F.lower(F.regexp_replace(host, r"\.+$", ""))
        return F.struct(bracket.alias("bracket"), bare.alias("host"), port.alias("port"), F.contains(authority, F.lit("@")).alias("named"))

    def mapped(v6: Column) -> Column:
        own = _let(F.conv(F.substring(v6, 25, 8), 16, 10).cast("long"), _global_v4)
        return F.when(F.startswith(v6, F.lit("0" * 20 + "ffff")), own).otherwise(~_within(v6, V6_CLOSED) | _within(v6, V6_OPEN))

    def safe(p: Column) -> Column:
        host, port = p["host"], p["port"]
        port_ok = (port == "") | (port.rlike("^[0-9]{1,9}$") & F.coalesce(port.try_cast("int").isin(0, 80, 443), F.lit(False)))
        name_ok = (host != "localhost") & ~F.endswith(host, F.lit(".localhost")) & ~host.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$")
        v4_ok = _let(ipv4_number(host), lambda n: F.when(n.isNotNull(), _global_v4(n)).otherwise(name_ok))
        host_ok = F.when(p["bracket"], F.coalesce(_let(ipv6_digits(host), mapped), F.lit(False))).otherwise(v4_ok)
        return (host != "") & ~p["named"] & port_ok & host_ok

    found = _let(F.regexp_extract(text, r"^(?i:https?)://([^/?#]*)", 1), lambda authority: _let(parts(authority), safe))
    return F.coalesce((F.length(url) <= 4096) & found, F.lit(False))
