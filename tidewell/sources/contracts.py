"""Contracts of tables (names, types, roles) from YAML or JSON, and bounded fetches of small documents.

Both are the driver's work: a contract is a page of text, and a fetched document is at most ``MOST`` bytes that a job then
reads from the store like any other file.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Mapping

from pyspark.sql import types as T

MOST = 8 << 20


def parse_document(text: str) -> dict:
    """A mapping from JSON, or from YAML where a reader for it is there."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError("a contract is a mapping")
    return value


def schema_of(contract: Mapping) -> T.StructType:
    """The schema of ``fields`` (``name, dtype, role``); roles are the columns' metadata."""
    fields = [T.StructField(f["name"], T._parse_datatype_string(f["dtype"]), True, {"role": f.get("role", "metadata")}) for f in contract["fields"]]
    names = [f.name for f in fields]
    if len(set(names)) < len(names):
        raise ValueError("a name is there twice")
    return T.StructType(fields)


def roles_of(schema: T.StructType) -> dict[str, str]:
    return {f.name: f.metadata.get("role", "metadata") for f in schema}


def check_schema(actual: T.StructType, wanted: T.StructType) -> None:
    """Names, order and types must agree."""
    a, b = ([(f.name, f.dataType.simpleString()) for f in s] for s in (actual, wanted))
    if a != b:
        raise ValueError(f"expected {b}, found {a}")


def fetch(url: str, most: int = MOST, tries: int = 3, wait: float = 1.0) -> bytes:
    """A document of at most ``most`` bytes; a failed try is repeated after a wait that doubles, a larger document is refused at once."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                raw = answer.read(most + 1)
            break
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)
    if len(raw) > most:
        raise ValueError(f"over {most} bytes")
    return raw
