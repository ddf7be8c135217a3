"""IP addresses as columns: IPv4 and IPv6 texts to 128-bit numbers, and whether one is public, by intervals of special networks.

A number is written as 32 hexadecimal digits, so numbers compare as texts. IPv4 addresses lie where IPv6 has them, under
::ffff:0:0/96.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that no fetch may reach, of private, local, reserved and multicast use.
SPECIAL = """
0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 ff00::/8
""".split()
#: Networks within those that are public all the same.
PUBLIC = "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()

_MAPPED = "00000000000000000000ffff"


def _bounds(network: str) -> tuple[str, str]:
    net = ipaddress.ip_network(network)
    digits = (lambda a: _MAPPED + f"{int(a):08x}") if net.version == 4 else (lambda a: f"{int(a):032x}")
    return digits(net[0]), digits(net[-1])


def _v4(text: Column) -> Column:
    """Eight digits of four decimal numbers, null of anything else. Numbers have no zeros in front, as the standard has them."""
    parts = F.split(text, r"\.")
    good = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    return F.when(good, F.concat(*(F.lower(F.lpad(F.hex(F.try_element_at(parts, F.lit(k)).cast("long")), 2, "0")) for k in range(1, 5))))


def number(address: Column) -> Column:
    """The address as 32 hexadecimal digits; null of what is none. A zone behind a per cent sign is left out."""
    text = F.lower(F.regexp_replace(address, "%.*$", ""))
    tail = F.regexp_extract(text, r":([0-9]+\.[0-9.]+)$", 1)  # an IPv4 address at the end
    tail4 = _v4(tail)
    plain = F.when(tail == "", text).otherwise(F.concat(F.regexp_replace(text, r"[0-9]+\.[0-9.]+$", ""), F.substring(tail4, 1, 4), F.lit(":"), F.substring(tail4, 5, 4)))
    halves = F.split(plain, "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    first, last = groups(F.get(halves, F.lit(0))), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    left = 8 - F.size(first) - F.size(last)
    whole = F.concat(first, F.array_repeat(F.lit("0"), F.greatest(left, F.lit(0))), last)
    good = plain.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & F.when(F.size(halves) == 2, left >= 1).otherwise(left == 0)
    v6 = F.when(good & text.contains(":"), F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(text.contains(":"), v6).otherwise(F.concat(F.lit(_MAPPED), _v4(text)))


def _within(digits: Column, networks: list[str]) -> Column:
    """Whether a number lies in one of ``networks``: the last interval that begins before it is looked up, and its end."""
    ends: list[list[str]] = []
    for low, high in sorted(map(_bounds, networks)):
        if ends and low <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], high)
        else:
            ends.append([low, high])
    table = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in ends))
    return F.exists(table, lambda x: digits.between(x["low"], x["high"]))


def is_public(address: Column) -> Column:
    """Whether an address may be reached: null of what is no address."""
    digits = number(address)
    v4 = digits.startswith(_MAPPED)
    of4, of6 = [n for n in SPECIAL if "." in n], [n for n in SPECIAL if ":" in n]
    special = F.when(v4, _within(digits, of4)).otherwise(_within(digits, of6))
    return F.when(digits.isNotNull(), ~special | _within(digits, PUBLIC))


def may_fetch(url: Column, addresses: Column) -> Column:
    """Whether ``url`` is http or https with a host, and every one of the ``addresses`` that its name resolves to, and at least one, is public."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#\s]") & (F.size(addresses) > 0) & F.forall(addresses, lambda a: F.coalesce(is_public(a), F.lit(False))), F.lit(False))
