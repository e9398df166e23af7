"""Range predicates and sort keys for scalar types.

Comparable Spark types compare as they are, so predicates reach the scan. Types that Spark cannot order get a key:
a column whose order is that of the type.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
}

#: Scalar types, and the Spark type (or the parts of the key) that holds them.
TYPES = {
    "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "money": "decimal(19,2)", "oid": "bigint", "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp", "time": "time(6)", "timetz": "struct<micros:bigint,offset:int>", "date": "date", "interval": "struct<months:int,days:int,micros:bigint>",
    "macaddr": "binary", "inet": "struct<family:int,addr:binary,masklen:int>", "cidr": "struct<family:int,addr:binary,masklen:int>", "text": "string", "varchar": "string",
    "char": "string", "bytea": "binary", "bit": "string", "varbit": "string", "numeric": "decimal(38,10)",
}


def timetz_key(micros: Column, offset_seconds: Column) -> Column:
    """Times with a zone order by the instant in UTC, then by zone (``offset_seconds`` west of UTC)."""
    return F.struct((micros + offset_seconds.cast("long") * 1_000_000).alias("instant"), offset_seconds.alias("zone"))


def interval_key(months: Column, days: Column, micros: Column) -> Column:
    """Intervals order by their length with months of 30 days of 24 hours."""
    return ((months.cast("decimal(38,0)") * 30 + days) * 86_400_000_000 + micros).cast("decimal(38,0)")


def macaddr_key(text: Column) -> Column:
    """Six bytes of a hardware address written in hexadecimal; null for other texts."""
    digits = F.regexp_replace(F.lower(text), "[^0-9a-f]", "")
    return F.when(F.length(digits) == 12, F.unhex(digits))


def inet_key(text: Column) -> Column:
    """IPv4 networks and addresses order by the bits of the shorter mask, then by mask length, then by the address.

    The key holds the family, the masked network, the mask length and the address; comparing networks by the bits
    both have needs the masked network of the address only, since a shorter mask sorts first on equal bits.
    """
    parts = F.split(text, "/")
    length = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(32))
    octets = F.split(parts[0], r"\.")
    address = F.aggregate(F.transform(octets, lambda o: o.cast("long")), F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    address = address * F.pow(F.lit(256.0), F.lit(4) - F.size(octets)).cast("long")
    network = F.floor(address / F.pow(F.lit(2.0), F.lit(32) - length)).cast("long") * F.pow(F.lit(2.0), F.lit(32) - length).cast("long")
    return F.struct(F.lit(4).alias("family"), network.alias("network"), length.alias("masklen"), address.alias("addr"))


def inet_value(text: str) -> tuple[int, int, int, int]:
    """The same key for a literal."""
    net = ipaddress.ip_interface(text)
    return 4, int(net.network.network_address), net.network.prefixlen, int(net.ip)


def compare(op: str, a: Column, b: Column) -> Column:
    """A range predicate; null where either side is null."""
    if op not in OPERATORS:
        raise ValueError(f"unknown comparison {op!r}")
    return OPERATORS[op](a, b)


def between(column: Column, low=None, high=None, low_open: bool = False, high_open: bool = False) -> Column:
    """A range with optional ends, as a conjunction that scans can use."""
    parts = []
    if low is not None:
        parts.append(column > low if low_open else column >= low)
    if high is not None:
        parts.append(column < high if high_open else column <= high)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
