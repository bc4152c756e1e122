"""IPv4 addresses as numbers and as text, and membership in lists of networks."""

from __future__ import annotations

from collections.abc import Iterable
from ipaddress import IPv4Network, collapse_addresses

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.params import RiskParams

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = f"^{_OCTET}([.]{_OCTET}){{3}}$"


def ipv4_to_string(address: str) -> Column:
    octets = ", ".join(f"shiftright({address}, {shift}) & 255" for shift in (24, 16, 8, 0))
    return F.expr(f"concat_ws('.', {octets})")


def ipv4_to_long(text: str) -> Column:
    """Dotted quad to number; NULL for anything else, IPv6 included."""
    number = " + ".join(
        f"CAST(split_part({text}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5))
    return F.expr(f"CASE WHEN {text} RLIKE '{IPV4_PATTERN}' THEN {number} END")


def _collapsed(networks: Iterable[str]) -> list[IPv4Network]:
    return list(collapse_addresses(IPv4Network(n) for n in networks))


def in_networks(address: str, networks: Iterable[str]) -> Column:
    """Numeric address inside any of the networks.

    Written as ranges rather than masks: range comparisons reach the parquet
    reader, where they can skip row groups.
    """
    return F.expr(" OR ".join(
        f"{address} BETWEEN {int(net.network_address)} AND {int(net.broadcast_address)}"
        for net in _collapsed(networks)
    ))


def text_in_networks(text: str, networks: Iterable[str]) -> Column:
    """Dotted-quad text inside any of the networks.

    The whole octets of a network are a plain prefix test, which the parquet
    reader can use. The test of a partial octet and the pattern check follow as
    separate conditions, so that they run only on rows that passed the prefixes.
    """
    prefixes, exact, partial = set(), [], False
    for net in _collapsed(networks):
        octets = str(net.network_address).split(".")
        whole, bits = divmod(net.prefixlen, 8)
        prefix = "".join(f"{octet}." for octet in octets[:whole]).removesuffix("." if whole == 4 else "")
        condition = f"{text} = '{prefix}'" if whole == 4 else f"startswith({text}, '{prefix}')"
        prefixes.add(condition)
        if bits:
            partial = True
            low = int(octets[whole])
            condition += (f" AND try_cast(split_part({text}, '.', {whole + 1}) AS INT)"
                          f" BETWEEN {low} AND {low + 2 ** (8 - bits) - 1}")
        exact.append(f"({condition})")
    checks = [" OR ".join(sorted(prefixes)), f"{text} RLIKE '{IPV4_PATTERN}'"]
    if partial:
        checks.append(" OR ".join(exact))
    return F.expr(" AND ".join(f"({check})" for check in checks))


def is_local(address: str, p: RiskParams) -> Column:
    return in_networks(address, p.local_networks)


def is_local_text(text: str, p: RiskParams) -> Column:
    return text_in_networks(text, p.local_networks)


def is_external(address: str, p: RiskParams) -> Column:
    """Neither a local network nor one that is never an outside destination."""
    return ~in_networks(address, (*p.local_networks, *p.never_external))
