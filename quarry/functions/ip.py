"""Addresses: normal forms, and membership in ranges as a join on bounds."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(address: str | None) -> str | None:
    """An address without zone; version 4 addresses in version 6 clothes as version 4. None for what is none."""
    try:
        ip = ipaddress.ip_address((address or "").strip().strip("[]").split("%")[0])
    except ValueError:
        return None
    mapped = getattr(ip, "ipv4_mapped", None)
    return str(mapped or ip)


def bounds(cidr: str) -> tuple[int, str, str]:
    """Version and the first and last address of a range, in 32 hexadecimal digits; bits of the host don't matter."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    if net.version == 6 and net.network_address.ipv4_mapped and net.prefixlen >= 96:
        net = ipaddress.ip_network(f"{net.network_address.ipv4_mapped}/{net.prefixlen - 96}", strict=False)
    return net.version, f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"


_PLACE = T.StructType().add("ip", T.StringType()).add("version", T.IntegerType()).add("hex", T.StringType())


@F.pandas_udf(_PLACE)
def place(addresses: pd.Series) -> pd.DataFrame:
    """Normal form, version and 32 hexadecimal digits of addresses."""
    found = [normal(a) for a in addresses]
    ips = [ipaddress.ip_address(f) if f else None for f in found]
    return pd.DataFrame({"ip": found, "version": [i.version if i else None for i in ips], "hex": [f"{int(i):032x}" if i else None for i in ips]}).astype({"version": "Int32"})


def allowlisted(rows: DataFrame, cidrs: list[str], column: str = "ip") -> DataFrame:
    """rows with the column allowed. The ranges of an allowlist are configuration, so they are literals of the plan."""
    where = F.lit(False)
    rows = rows.withColumn("_place", place(column))
    for version, low, high in map(bounds, cidrs):
        where = where | ((F.col("_place.version") == version) & F.col("_place.hex").between(low, high))
    return rows.withColumn("allowed", F.coalesce(where, F.lit(False))).drop("_place")


_RANGE = T.StructType().add("version", T.IntegerType()).add("length", T.IntegerType()).add("prefix", T.StringType())


def _prefix(version: int, number: int, length: int) -> str:
    """The key of the range of so many leading bits that holds an address."""
    host = (32 if version == 4 else 128) - length
    return f"{version}/{length}/{number >> host << host:x}"


@F.pandas_udf(_RANGE)
def _range(cidrs: pd.Series) -> pd.DataFrame:
    out = []
    for c in cidrs:
        try:
            version, low, high = bounds(c)
            length = (32 if version == 4 else 128) - (int(low, 16) ^ int(high, 16)).bit_length()
            out.append((version, length, _prefix(version, int(low, 16), length)))
        except (ValueError, AttributeError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["version", "length", "prefix"]).astype({"version": "Int32", "length": "Int32"})


def in_ranges(rows: DataFrame, ranges: DataFrame, column: str = "ip", cidr: str = "cidr") -> DataFrame:
    """rows with matched, the longest range that holds the address (of equal ones the first in order; null where none does).

    An equi-join: the ranges have at most 162 different lengths, an address has one prefix of each, and prefixes that are equal match. Addresses
    are looked up once however often they occur. Null and malformed addresses match nothing; malformed ranges hold nothing.
    """
    known = ranges.select(F.col(cidr).alias("_cidr")).distinct().withColumn("_r", _range("_cidr")).where("_r.prefix IS NOT NULL").select("_cidr", "_r.*")
    lengths = sorted((r.version, r.length) for r in known.select("version", "length").distinct().collect())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def prefixes(addresses: pd.Series) -> pd.Series:
        out = []
        for a in addresses:
            found = normal(a)
            ip = ipaddress.ip_address(found) if found else None
            out.append([_prefix(v, int(ip), n) for v, n in lengths if v == ip.version] if ip else [])
        return pd.Series(out)

    places = rows.select(F.col(column).alias("_ip")).where("_ip IS NOT NULL").distinct().select("_ip", F.explode(prefixes("_ip")).alias("prefix"))
    best = known.groupBy("prefix").agg(F.max("length").alias("length"), F.min("_cidr").alias("_cidr"))
    found = places.join(best, "prefix").groupBy("_ip").agg(F.max_by("_cidr", "length").alias("matched"))
    return rows.join(found, F.col(column) == F.col("_ip"), "left").drop("_ip")
