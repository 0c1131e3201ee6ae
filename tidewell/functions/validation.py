"""Predicates and projections that guard what a model may see, and typed normalising of rows that may be bad.

Predicates are false for null input unless stated; a row that breaks a rule is marked, and only the guards named so stop a query.
"""

from __future__ import annotations

import ipaddress
import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that no model feature may have.
NEVER_FEATURES = frozenset("sample_id group_id capture_id dataset_id source_file source_row flow_id start_ms end_ms src dst label".split())
#: Protocol numbers by name.
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17, "ipv6-icmp": 58}


def features(rows: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """The columns whose role is ``model_feature``; an identity, time or label column with that role is an error."""
    chosen = [c for c in rows.columns if roles.get(c) == "model_feature"]
    if bad := sorted(NEVER_FEATURES.intersection(chosen)):
        raise ValueError(f"not to be features: {bad}")
    return rows.select(*chosen)


def packet_lists(packets: DataFrame, keys: list[str], order: list[str], columns: list[str], most: int = 8) -> DataFrame:
    """A row for each session with its first ``most`` packets in order; a session's further packets are cut before the shuffle's sort ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = packets.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    packet = F.struct("_n", *columns)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(packet)), lambda p: F.struct(*[p[c].alias(c) for c in columns])).alias("packets"))


def initial_view(sessions: DataFrame, packets: str, shown: int = 8) -> DataFrame:
    """``packet_sequence`` of the first packets; columns that begin with ``service_`` are left out, lists of text are sorted."""
    lists = {f.name for f in sessions.schema if f.dataType.simpleString() == "array<string>"}
    kept = [F.array_sort(c).alias(c) if c in lists else F.col(c) for c in sessions.columns if c != packets and not c.startswith("service_")]
    return sessions.select(*kept, F.slice(packets, 1, shown).alias("packet_sequence"))


def later_packets(sessions: DataFrame, packets: str, shown: int = 8) -> DataFrame:
    """Packets after the shown ones, as many again, of the sessions that have any."""
    return sessions.where(F.size(packets) > shown).withColumn(packets, F.slice(packets, shown + 1, shown))


def exact_keys(column: str, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    found = F.array_sort(F.json_object_keys(column))
    return F.coalesce(found == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def prohibited(column: str, names: list[str]) -> list[Column]:
    """``address, time, name``: whether a text holds an IPv4 address, an absolute time, or one of some names (``-`` as ``_``)."""
    text = F.coalesce(column, F.lit(""))
    plain = F.replace(F.lower(text), F.lit("-"), F.lit("_"))
    name = F.lit(False)
    for n in names:
        name = name | F.contains(plain, F.lit(n))
    return [
        text.rlike(r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])").alias("address"),
        text.rlike(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-2][0-9]:[0-5][0-9]").alias("time"), name.alias("name"),
    ]


def key_paths(value, forbidden: frozenset[str], at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{at}.{k}" if at else k
            if k.lower() in forbidden:
                yield here
            yield from key_paths(v, forbidden, here)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from key_paths(v, forbidden, f"{at}[{i}]")


def forbidden_keys(value: Column, names) -> Column:
    """The dotted paths of the forbidden keys in a JSON value, at any depth; none for text that is not JSON."""
    banned = frozenset(n.lower() for n in names)

    def found(text: str | None) -> list[str]:
        try:
            return list(key_paths(json.loads(text), banned)) if text else []
        except ValueError:
            return []

    @F.pandas_udf("array<string>")
    def paths(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    return paths(value)


def eligible(valid: str, mapped: Column) -> Column:
    return F.coalesce(F.col(valid) & mapped.isNotNull(), F.lit(False))


def timestamp_ms(text: Column, unit: str) -> Column:
    """Milliseconds since the epoch of a text in ``milliseconds``, ``seconds`` or ``iso8601``; null if it is none.

    An ISO time without a zone is in UTC whatever the session's zone; half milliseconds of seconds round to even.
    """
    t = F.trim(text)
    if unit == "milliseconds":
        return F.when(t.rlike(r"^[+-]?\d{1,18}$"), t.cast("long"))
    if unit == "seconds":
        return F.bround(t.try_cast("decimal(27,9)") * 1000, 0).cast("long")
    if unit != "iso8601":
        raise ValueError(f"unit {unit}")
    zoned = F.when(t.rlike(r"([Zz]|[+-]\d\d:?\d\d)$") & t.rlike(r"[T ]"), t).otherwise(F.concat(F.when(t.rlike("[T ]"), t).otherwise(F.concat(t, F.lit("T00:00:00"))), F.lit("Z")))
    return F.unix_millis(zoned.try_cast("timestamp"))


def protocol(text: Column) -> Column:
    """A protocol's number by name or digits; null for a wildcard, -1 for any other text."""
    t = F.lower(F.trim(text))
    known = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    number = F.when(t.rlike(r"^\d{1,9}$"), t.cast("int"))
    return F.when(t.isin("", "*", "any", "-"), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, t), number, F.when(t.isNotNull(), -1)))


def optional_int(text: Column) -> Column:
    """An integer, or null for a wildcard."""
    t = F.trim(text)
    return F.when(~t.isin("", "*", "any", "ANY", "-") & t.rlike(r"^[+-]?\d{1,9}$"), t.cast("int"))


def events(rows: DataFrame, unit: str, default_duration: int | None = None) -> DataFrame:
    """Ground-truth rows of text columns ``start, end, protocol, port``, typed, with ``error`` for the first rule that a row breaks.

    An empty end is the start and the default duration. Wildcards are null.
    """
    start, end = timestamp_ms(F.col("start"), unit), timestamp_ms(F.col("end"), unit)
    if default_duration is not None:
        end = F.when(F.trim("end") == "", start + default_duration).otherwise(end)
    number = protocol(F.col("protocol"))
    out = rows.withColumns({"start_ms": start, "end_ms": end, "_protocol": number, "port": optional_int(F.col("port"))})
    error = F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "no time").when(F.col("end_ms") < F.col("start_ms"), "ends before it starts")
    out = out.withColumns({"error": error.when(F.col("_protocol") == -1, "unsupported protocol"), "protocol": F.nullif("_protocol", F.lit(-1))})
    return out.drop("_protocol")


def event_id(columns: list[str]) -> Column:
    """A stable id of a row without one: a digest of its values by name."""
    return F.concat(F.lit("gt-"), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 20))


def authorised(rows: DataFrame, role: str, forbidden: list[str]) -> DataFrame:
    """The rows; one of a forbidden role stops the query (a guard)."""
    stop = F.raise_error(F.concat(F.lit("isolated role: "), F.col(role)))
    return rows.where(F.when(F.col(role).isin(forbidden), stop.cast("boolean")).otherwise(True))


def first_of(assets: DataFrame, keys: list[str], order: str, *columns: Column) -> DataFrame:
    """The first asset of each key, in the order of the manifest."""
    some = F.min_by(F.struct(*columns), F.col(order)).alias("a")
    return assets.groupBy(*keys).agg(some).select(*keys, "a.*")


def taxonomy(column: str, broad: Mapping[str, str]) -> Column:
    """The broad label of a fine one; null for a label that is not mapped."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in broad.items() for x in pair]), F.col(column))


def first_token(column: str, rules: list[tuple[str, str]], fallback: str | None = None) -> Column:
    """The label of the first rule whose token a label holds; the rules' order matters."""
    return F.coalesce(*[F.when(F.contains(F.lower(column), F.lit(t)), F.lit(v)) for t, v in rules], F.lit(fallback).cast("string"))


def scope_checks(rows: DataFrame, key: str, start: str, end: str, scope: str) -> DataFrame:
    """How a window's input breaks its rules: ids that repeat, times that are none or out of order, scopes beyond one."""
    unordered = F.col(start).isNull() | F.col(end).isNull() | (F.col(end) < F.col(start))
    return rows.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(key)).alias("repeated"), F.count_if(unordered).alias("unordered"), F.count_distinct(scope).alias("scopes"))


def order_violations(rows: DataFrame, line: str, time: str, block: int = 100_000) -> DataFrame:
    """``order_violations``: rows whose time is before that of the line before them.

    Lines are compared within blocks of ``block`` numbers; the blocks' first and last lines, a row for each block, are compared across.
    """
    b = F.floor(F.col(line) / block)
    near = Window.partitionBy("_b").orderBy(line)
    inner = rows.withColumn("_b", b).withColumn("_before", F.lag(time).over(near)).groupBy("_b").agg(
        F.count_if(F.col(time) < F.col("_before")).alias("n"), F.min_by(time, line).alias("first"), F.max_by(time, line).alias("last")
    )
    across = inner.withColumn("prior", F.lag("last").over(Window.orderBy("_b")))
    more = F.coalesce((F.col("first") < F.col("prior")).cast("long"), F.lit(0))
    return across.agg(F.coalesce(F.sum(F.col("n") + more), F.lit(0)).alias("order_violations"))


def address_number(text: Column) -> Column:
    """An IPv4 address as a number, null for any other text."""
    parts = F.split(text, r"\.")
    byte = lambda k: F.get(parts, F.lit(k)).cast("long")
    number = ((byte(0) * 256 + byte(1)) * 256 + byte(2)) * 256 + byte(3)
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def unicast(text: Column) -> Column:
    """Whether a text is an IP address that is no multicast, unspecified, loopback or broadcast one; IPv6 by its written form."""
    n = address_number(text)
    four = (n != 0) & (n != 0xFFFFFFFF) & ~n.between(224 << 24, (240 << 24) - 1) & ~n.between(127 << 24, (128 << 24) - 1)
    low = F.lower(text)
    six = low.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$") & F.contains(low, F.lit(":")) & ~low.rlike(r"^(ff|(0*:)*:?(0*:)*0*[01]?$)")
    return F.coalesce(four, six, F.lit(False))


def address_match(text: Column, pattern: str) -> Column:
    """Whether an address is in a network (``a.b.c.d/n``) or fits a pattern with ``*`` and ``?``; an empty pattern fits all."""
    if not pattern:
        return F.lit(True)
    if "/" in pattern:
        net = ipaddress.ip_network(pattern, strict=False)
        return F.coalesce(address_number(text).between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    escaped = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern)
    return F.coalesce(text.rlike(f"^{escaped}$"), F.lit(False))


def port_match(port: Column, pattern: str) -> Column:
    return F.lit(True) if not pattern else F.coalesce(port.cast("string") == pattern, F.lit(False))
