"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"[0-9]{1,3}(\.[0-9]{1,3}){3}"


def safe_long(c: Column, default: int) -> Column:
    """A whole number, or ``default`` for what is none."""
    return F.coalesce(c.try_cast("long"), F.lit(default).cast("long"))


def protocol_number(name: Column) -> Column:
    """The number of a protocol given by name or number; null for others."""
    n = F.lower(F.trim(name))
    return F.coalesce(F.when(n == "icmp", 1).when(n == "tcp", 6).when(n == "udp", 17), n.try_cast("int"))


def sanitize(c: Column) -> Column:
    """Addresses and long numbers as placeholders, addresses first."""
    return F.regexp_replace(F.regexp_replace(c, IPV4, "<IP>"), "[0-9]{6,}", "<NUM>")


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def log2_bucket(c: str) -> Column:
    return F.floor(F.log2(F.greatest(F.lit(1), F.col(c)))).cast("long")


def ip_number(c: Column) -> Column:
    """An IPv4 address as a number; null for what is none."""
    p = F.transform(F.split(c, r"\."), lambda x: x.try_cast("long"))
    ok = (F.size(p) == 4) & F.forall(p, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return F.when(ok, F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x))
