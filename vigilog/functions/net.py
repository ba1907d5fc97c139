"""Address functions as column expressions: no Python runs per row."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    PRIVATE_IPV4,
    PRIVATE_IPV6,
    PUBLIC_INSIDE_PRIVATE_IPV4,
    PUBLIC_INSIDE_PRIVATE_IPV6,
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(ip: Column) -> Column:
    """The text before a prefix length, trimmed."""
    return F.trim(F.split_part(ip, F.lit("/"), F.lit(1)))


def _ipv4_number(bare: Column) -> Column:
    """The address as a whole number; null when it is no dotted quad."""

    def total(parts: Column) -> Column:
        number = F.lit(0).cast("long")
        for place in range(4):
            number = number * 256 + F.get(parts, F.lit(place)).cast("long")
        return number

    return F.when(bare.rlike(_IPV4), _let(F.split(bare, r"\."), total))


def _quad_as_groups(text: Column) -> Column:
    """An embedded dotted quad becomes two ordinary groups; null when the quad is invalid."""
    return _let(_ipv4_number(F.regexp_extract(text, r":([0-9.]+)$", 1)), lambda n: F.concat(
        F.regexp_replace(text, r"[0-9.]+$", ""),
        F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535)))))


_GROUPS = r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"


def _digits_of_groups(text: Column) -> Column:
    """32 hex digits of colon-separated groups, the gap of ``::`` filled; null when they do not fit."""
    groups = lambda side: F.filter(
        F.split(F.split_part(text, F.lit("::"), F.lit(side)), ":"), lambda g: g != "")
    pad = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")

    def filled(sides: Column) -> Column:
        head, tail = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        gap = 8 - F.size(head) - F.size(tail)
        return F.when(text.contains("::"), F.when(gap >= 1, F.concat(
            pad(head), F.repeat(F.lit("0000"), gap), pad(tail)))).otherwise(F.when(gap == 0, pad(head)))

    no_tail = F.array().cast("array<string>")
    sides = F.array(groups(1), F.when(text.contains("::"), groups(2)).otherwise(no_tail))
    return F.when(text.rlike(rf"^{_GROUPS}(?:::{_GROUPS})?$") & text.contains(":"), _let(sides, filled))


def _ipv6_digits(bare: Column) -> Column:
    """The 32 hex digits of a valid IPv6 text, else null."""
    plain = F.lower(F.split_part(bare, F.lit("%"), F.lit(1)))
    return _let(plain, lambda text: _let(
        F.when(text.contains("."), _quad_as_groups(text)).otherwise(text), _digits_of_groups))


def _within(value: Column, networks: list[str], bound) -> Column:
    """Whether the value lies in one of the networks, given as a constant list of ranges."""
    ranges = []
    for text in networks:
        net = ipaddress.ip_network(text)
        ranges.append(f"struct({bound(net.network_address)} AS lo, {bound(net.broadcast_address)} AS hi)")
    return F.exists(F.expr(f"array({', '.join(ranges)})"), lambda r: value.between(r["lo"], r["hi"]))


def _whole(address) -> str:
    return f"{int(address)}L"


def _hexed(address) -> str:
    return "'" + address.exploded.replace(":", "") + "'"


def _private_four(number: Column) -> Column:
    return _within(number, PRIVATE_IPV4, _whole) & ~_within(number, PUBLIC_INSIDE_PRIVATE_IPV4, _whole)


def _private_six(digits: Column) -> Column:
    # An address that maps an IPv4 one is judged by that.
    mapped = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
    return F.when(digits.startswith("0" * 20 + "ffff"), _let(mapped, _private_four)).when(
        digits.isNotNull(), _within(digits, PRIVATE_IPV6, _hexed) & ~_within(digits, PUBLIC_INSIDE_PRIVATE_IPV6, _hexed))


def is_private_ip(ip: Column) -> Column:
    """Whether an address is outside the global ranges; null for text that is no address."""
    return _let(_bare(ip), lambda bare: F.when(bare.contains(":"), _let(_ipv6_digits(bare), _private_six)).otherwise(
        _let(_ipv4_number(bare), lambda n: F.when(n.isNotNull(), _private_four(n)))))


def first_octet(ip: Column) -> Column:
    """Integer before the first dot (and before a slash); null when it is no integer."""
    head = F.trim(F.split_part(F.split_part(ip, F.lit("."), F.lit(1)), F.lit("/"), F.lit(1)))
    return F.when(head.rlike(r"^[+-]?[0-9]{1,9}$"), head.try_cast("int"))


def ip_class(ip: Column) -> Column:
    """Address class letter by the first octet."""
    first = first_octet(ip)
    return (
        F.when(first < 128, "A").when(first < 192, "B").when(first < 224, "C").when(first < 240, "D")
        .when(first.isNotNull(), "E")
    )
