"""Security predicates over tables of addresses, URLs, archive entries and responses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def disallowed_ipv4(address: Column) -> Column:
    """Private, local, reserved, documentation and malformed addresses."""
    p = F.transform(F.split(address, r"\."), lambda x: F.when(x.rlike("^[0-9]{1,9}$"), x).cast("int"))
    a, b, c = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))
    bad = (F.size(p) != 4) | F.exists(p, lambda x: x.isNull() | (x > 255))
    ranges = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    ranges = ranges | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.when(F.coalesce(bad, F.lit(True)), True).otherwise(ranges)


def disallowed_ipv6(address: Column) -> Column:
    """IPv6 by ranges; addresses that embed an IPv4 one by that one."""

    def one(text: str | None) -> bool:
        try:
            ip = ipaddress.IPv6Address((text or "").strip("[]").split("%")[0])
        except ValueError:
            return True
        four = ip.ipv4_mapped or (ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF) if 1 < int(ip) < 2**32 else None)
        if four is not None:
            return four.is_private or four.is_multicast or four.is_reserved or four.is_loopback or four.is_link_local
        return ip.is_loopback or ip.is_unspecified or ip.is_link_local or ip.is_multicast or ip in ipaddress.IPv6Network("fc00::/7") or ip in ipaddress.IPv6Network("2001:db8::/32")

    @F.pandas_udf("boolean")
    def run(addresses: pd.Series) -> pd.Series:
        return addresses.map(one)

    return run(address)


def url_error(url: Column) -> Column:
    """Why a URL may not be fetched, by its shape; null if it may."""
    scheme, user, host = (F.try_parse_url(url, F.lit(part)) for part in ("PROTOCOL", "USERINFO", "HOST"))
    return F.when(scheme.isNull(), "malformed").when(~F.lower(scheme).isin("http", "https"), "scheme").when(user.isNotNull(), "userinfo").when(host.isNull(), "host").when(host.rlike(r"^[0-9.]+$") & disallowed_ipv4(host), "address").when(F.lower(host) == "localhost", "address")


def response_error(status: Column, declared: Column, received: Column, encoding: Column, redirects: Column, most_bytes: int, most_redirects: int = 5, allow_errors: bool = False) -> Column:
    return (
        F.when(redirects > most_redirects, "too-many-redirects")
        .when(declared > most_bytes, "declared-too-large")
        .when(received > most_bytes, "too-large")
        .when(~F.coalesce(F.lower(encoding), F.lit("identity")).isin("identity", "gzip", "deflate", "br"), "encoding")
        .when(F.lit(not allow_errors) & ~status.between(200, 299), "status")
    )


def entry_error(name: Column, packed: Column, unpacked: Column, most_ratio: float = 100.0) -> Column:
    """Why an archive entry is refused."""
    plain = F.regexp_replace(name, r"\\", "/")
    return (
        F.when(F.contains(name, F.lit("\0")), "nul-byte")
        .when(name.rlike(r"^(\\\\|//)"), "unc-path")
        .when(F.startswith(plain, F.lit("/")), "absolute-path")
        .when(name.rlike("^[a-zA-Z]:"), "drive-letter")
        .when(F.array_contains(F.split(plain, "/"), ".."), "path-traversal")
        .when(unpacked / F.greatest(F.lit(1), packed) > most_ratio, "compression-ratio")
    )


def defused(cell: Column) -> Column:
    """A spreadsheet cell that can't be taken for a formula."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)
