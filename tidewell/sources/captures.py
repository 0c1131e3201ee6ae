"""Packet captures: classic pcap files to the fields that a packet scan reads, without an external decoder.

A file is read as a stream of records by one task, since a record's place depends on those before it; many captures are
many tasks. A record cut short at the end of a file ends it. Ethernet with VLAN tags, IPv4, IPv6, TCP and UDP are
decoded; of other frames the fields stay empty.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewell.sources.scans import PACKET_FIELDS

#: The first bytes of a capture, its byte order and ticks a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
COLUMNS = [n.replace(".", "_") for n in PACKET_FIELDS]
ROWS = 4096


def frame_fields(frame: bytes) -> dict[str, str]:
    """The address, protocol, port and flag fields of an Ethernet frame."""
    out: dict[str, str] = {}
    kind, at = int.from_bytes(frame[12:14], "big"), 14
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
    if kind == 0x0800 and len(frame) >= at + 20:
        protocol, rest = frame[at + 9], at + 4 * (frame[at] & 15)
        first = not int.from_bytes(frame[at + 6 : at + 8], "big") & 0x1FFF  # of a datagram's fragments only the first has ports
        out |= {"ip_src": str(ipaddress.IPv4Address(frame[at + 12 : at + 16])), "ip_dst": str(ipaddress.IPv4Address(frame[at + 16 : at + 20])), "ip_proto": str(protocol)}
    elif kind == 0x86DD and len(frame) >= at + 40:
        protocol, rest, first = frame[at + 6], at + 40, True
        out |= {"ipv6_src": str(ipaddress.IPv6Address(frame[at + 8 : at + 24])), "ipv6_dst": str(ipaddress.IPv6Address(frame[at + 24 : at + 40])), "ipv6_nxt": str(protocol)}
    else:
        return out
    name = {6: "tcp", 17: "udp"}.get(protocol)
    if name and first and len(frame) >= rest + 4:
        out |= {f"{name}_srcport": str(int.from_bytes(frame[rest : rest + 2], "big")), f"{name}_dstport": str(int.from_bytes(frame[rest + 2 : rest + 4], "big"))}
        if name == "tcp" and len(frame) >= rest + 14:
            out["tcp_flags"] = f"0x{int.from_bytes(frame[rest + 12 : rest + 14], 'big') & 0xFFF:04x}"
    return out


def records(raw: bytes) -> Iterator[dict[str, str]]:
    if raw[:4] not in MAGIC:
        raise ValueError("no classic pcap file")
    order, ticks = MAGIC[raw[:4]]
    at, number = 24, 0
    while at + 16 <= len(raw):
        seconds, part, held, length = struct.unpack_from(f"{order}IIII", raw, at)
        at += 16
        if at + held > len(raw):
            return
        number += 1
        yield {"frame_number": str(number), "frame_time_epoch": f"{seconds}.{part * (10**9 // ticks):09d}", "frame_len": str(length)} | frame_fields(raw[at : at + held])
        at += held


def decoded(captures: DataFrame) -> DataFrame:
    """``path`` and the packet fields as text, from rows of ``path, content``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"]):
                for r in records(bytes(raw)):
                    held.append({"path": path} | dict.fromkeys(COLUMNS, "") | r)
                    if len(held) == ROWS:
                        yield pd.DataFrame(held)
                        held = []
        if held:
            yield pd.DataFrame(held)

    return captures.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{c} string" for c in COLUMNS))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))
