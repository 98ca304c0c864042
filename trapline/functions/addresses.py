"""IP address expressions with strict textual rules.

An address is kept as text, and membership in a list of networks is one regular
expression on it, derived from the network list when the module is loaded.  That
keeps the test a single small step of generated code on every event.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The networks counted as private, and the public holes in them.
PRIVATE_V4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
]
PUBLIC_HOLES_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
PRIVATE_V6 = [
    "::1/128",
    "::/128",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
]
PUBLIC_HOLES_V6 = [
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4_BODY = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_IPV4 = rf"^{_IPV4_BODY}\z"

_GROUP = "[0-9a-f]{1,4}"
_ZONE = r"(?:%[^%/]+)?\z"
# Without a gap there are exactly eight groups, with one at most seven; an IPv4 tail stands for two.
_IPV6 = (
    rf"(?i)^(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?:{_GROUP}:){{6}}{_IPV4_BODY}"
    rf"|(?!:{{0,2}}[0-9a-f]+(?::{{1,2}}[0-9a-f]+){{7}})(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?"
    rf"|(?!:{{0,2}}[0-9a-f]+(?::{{1,2}}[0-9a-f]+){{5}}:)(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}:)*{_IPV4_BODY}"
    rf"){_ZONE}"
)


def _v4_pattern(cidr: str) -> str:
    """Text of the addresses of one IPv4 network."""
    network = ipaddress.ip_network(cidr)
    low, high = network.network_address.packed, network.broadcast_address.packed
    octets = []
    for first, last in zip(low, high):
        every = (first, last) == (0, 255)
        octets.append(_OCTET if every else f"(?:{'|'.join(str(n) for n in range(first, last + 1))})")
    return r"\.".join(octets)


def _any_of(patterns: list[str]) -> str:
    return f"(?:{'|'.join(patterns)})"


_PRIVATE_V4_BODY = (
    rf"(?!{_any_of([_v4_pattern(n) for n in PUBLIC_HOLES_V4])}(?![0-9.]))"
    + _any_of([_v4_pattern(n) for n in PRIVATE_V4])
)
_PRIVATE_V4 = rf"^{_PRIVATE_V4_BODY}\z"
_PRIVATE_FIRST_OCTETS = sorted(
    {
        str(octet)
        for network in map(ipaddress.ip_network, PRIVATE_V4)
        for octet in range(network[0].packed[0], network[-1].packed[0] + 1)
    },
    key=int,
)


def _v6_pattern(cidr: str) -> str:
    """One IPv6 network as a pattern on the marked form of an address.

    The marked form has four digits per group, no colons, and a bar for the gap.
    The gap stands for as many zeros as are missing to 32 digits.
    """
    network = ipaddress.ip_network(cidr)
    low, high = f"{int(network[0]):032x}", f"{int(network[-1]):032x}"
    fixed = -(-network.prefixlen // 4)
    digits = ["[" + "".join(f"{n:x}" for n in range(int(a, 16), int(b, 16) + 1)) + "]" for a, b in zip(low, high)]
    zero_ok = [a == "0" for a in low]
    forms = ["".join(digits[:fixed])]
    for gap_at in range(0, fixed, 4):
        before = "".join(digits[:gap_at])
        for gap in range(4, 33 - gap_at, 4):
            covered = min(gap_at + gap, fixed)
            if not all(zero_ok[gap_at:covered]):
                break
            free = 32 - max(gap_at + gap, fixed)
            forms.append(rf"{before}\|{''.join(digits[covered:fixed])}[0-9a-f]{{{free}}}\z")
    return _any_of(forms)


def _wrapped(cidr: str) -> str:
    """An IPv4 network inside IPv6."""
    address, bits = cidr.split("/")
    return f"::ffff:{address}/{96 + int(bits)}"


_PRIVATE_V6 = "^(?!{}){}".format(
    _any_of([_v6_pattern(n) for n in PUBLIC_HOLES_V6 + [_wrapped(n) for n in PUBLIC_HOLES_V4]]),
    _any_of([_v6_pattern(n) for n in PRIVATE_V6 + [_wrapped(n) for n in PRIVATE_V4]]),
)
_ZERO = "0{1,4}"
_MAPPED_PREFIX = rf"(?:(?:{_ZERO}:){{5}}|(?:{_ZERO}(?::{_ZERO})*)?::(?:{_ZERO}:)*)ffff:"
_MAPPED_TEXT = rf"(?i)^{_MAPPED_PREFIX}{_PRIVATE_V4_BODY}{_ZONE}"


def is_ipv4(ip: Column) -> Column:
    """Four decimal octets without leading zeros, nothing else; null stays null."""
    return ip.rlike(_IPV4)


def is_ipv6(ip: Column) -> Column:
    """Groups of hex digits with at most one gap, an optional IPv4 tail and zone; null stays null."""
    return ip.rlike(_IPV6)


def with_ip_number(frame: DataFrame, ip: Column, into: str) -> DataFrame:
    """Add the 32-bit value of an IPv4 address, null for any other text.

    The number is right if writing it out again gives the same text; that is
    much cheaper per event than matching a pattern.
    """
    octets = [
        F.substring_index(F.substring_index(ip, ".", position), ".", -1).try_cast("bigint")
        for position in range(1, 5)
    ]
    number = F.col("_number")
    spelled = F.concat_ws(".", *[F.shiftright(number, bits).bitwiseAND(255).cast("string") for bits in (24, 16, 8, 0)])
    in_range = number.between(0, 0xFFFFFFFF)
    return (
        frame.withColumn("_number", ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3])
        .withColumn(into, F.when(in_range & (spelled == ip), number))
        .drop("_number")
    )


def ip_hex(ip: Column) -> Column:
    """The 128 bits of a valid address as 32 hex digits, an IPv4 one as the IPv6 address that wraps it; null for other text."""

    def four(octets: Column) -> Column:
        number = F.split(octets, r"\.")
        return F.concat(*(F.lpad(F.lower(F.hex(number[i].cast("bigint"))), 2, "0") for i in range(4)))

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda group: group != "")

    tail = F.regexp_extract(ip, rf"({_IPV4_BODY})(?:%.*)?\z", 1)
    plain = F.lower(F.regexp_replace(ip, r"%.*\z", ""))
    hexed = F.when(tail != "", F.concat(F.regexp_replace(plain, rf"{_IPV4_BODY}\z", ""), F.substring(four(tail), 1, 4), F.lit(":"), F.substring(four(tail), 5, 4)))
    text = F.coalesce(hexed, plain)
    left, right = groups(F.substring_index(text, "::", 1)), groups(F.substring_index(text, "::", -1))
    both = F.when(F.contains(text, F.lit("::")), F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right))
    wide = F.array_join(F.transform(F.coalesce(both, left), lambda group: F.lpad(group, 4, "0")), "")
    return F.when(is_ipv4(ip), F.concat(F.lit("0" * 20 + "ffff"), four(ip))).when(is_ipv6(ip), wide)


def prefix_key(hex_digits: Column, bits: int) -> Column:
    """The first so many bits of 32 hex digits, as text: whole digits and the number that is left of the next one."""
    whole, rest = divmod(bits, 4)
    key = F.substring(hex_digits, 1, whole)
    if not rest:
        return key
    digit = F.conv(F.substring(hex_digits, whole + 1, 1), 16, 10).cast("int")
    return F.concat(key, F.lit("/"), F.shiftright(digit, 4 - rest).cast("string"))


def is_valid_ip(ip: Column) -> Column:
    """True for valid IPv4 or IPv6 text, false for anything else including null."""
    return F.coalesce(is_ipv4(ip) | is_ipv6(ip), F.lit(False))


def _marked(ip: Column) -> Column:
    """The marked form of a valid IPv6 address, see ``_v6_pattern``."""
    plain = F.regexp_replace(F.lower(ip), r"%.*\z", "")
    hexed = F.regexp_replace(
        F.regexp_replace(plain, r":0\.0\.0\.([0-2])\z", ":0:$1"), rf":{_IPV4_BODY}\z", ":ffff:fffe"
    )
    wide = F.regexp_replace(F.regexp_replace(hexed, "([0-9a-f]+)", "000$1"), "0{0,3}([0-9a-f]{4})(?![0-9a-f])", "$1")
    return F.translate(F.replace(wide, F.lit("::"), F.lit("|")), ":", "")


def is_private(ip: Column) -> Column:
    """True for a private address; invalid, empty and null text is not private.

    An IPv6 address that wraps an IPv4 one counts as that one.
    """
    wrapped = ip.rlike(rf"(?i)^{_MAPPED_PREFIX}{_IPV4_BODY}{_ZONE}")
    private_v6 = F.when(wrapped, ip.rlike(_MAPPED_TEXT)).otherwise(
        ip.rlike(_IPV6) & _marked(ip).rlike(_PRIVATE_V6)
    )
    first_octet = F.substring_index(ip, ".", 1)
    return F.coalesce(
        F.when(F.contains(ip, F.lit(":")), private_v6).when(
            # Most addresses are told public by their first number alone.
            first_octet.isin(*_PRIVATE_FIRST_OCTETS), ip.rlike(_PRIVATE_V4)
        ),
        F.lit(False),
    )


def mask_ip(ip: Column) -> Column:
    """Hide the last of four dot-separated parts; other text is unchanged."""
    return F.when(
        F.size(F.split(ip, r"\.")) == 4, F.concat(F.substring_index(ip, ".", 3), F.lit(".***"))
    ).otherwise(ip)
