"""Ids with a prefix and twelve hex digits, and versions, as columns and as Python values."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = ("field", "cap", "art", "plan")
_ID = re.compile(r"(field|cap|art|plan)_([0-9a-fA-F]{12})")


def new_id(prefix: str) -> str:
    if prefix not in PREFIXES:
        raise ValueError(f"unknown prefix {prefix!r}")
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def new_id_column(prefix: str) -> Column:
    """Random per row; keep it out of hashes."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def is_id(value: Column, prefix: str) -> Column:
    return value.rlike(rf"^{prefix}_[0-9a-fA-F]{{12}}\z")


def parse_id(value: str) -> tuple[str, str]:
    m = _ID.fullmatch(value)
    if not m:
        raise ValueError(f"{value!r} is no id")
    return m[1], m[2]


def parse_version(version: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", version)
    if not m:
        raise ValueError(f"{version!r} is no version")
    return int(m[1]), int(m[2]), int(m[3])


def compare_versions(a: str, b: str) -> int:
    x, y = parse_version(a), parse_version(b)
    return (x > y) - (x < y)


def bump(version: str, part: str) -> str:
    at = ("major", "minor", "patch").index(part)
    v = list(parse_version(version))
    v[at] += 1
    return ".".join(map(str, v[: at + 1] + [0] * (2 - at)))


def version_key(version: Column) -> Column:
    """Sorts versions; a part that isn't a number counts as 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
