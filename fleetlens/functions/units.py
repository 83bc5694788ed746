"""Unit conversions and section defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1048576.0
GIB = 1073741824.0


def mib(size: str | Column) -> Column:
    return F.round(F.col(size) / MIB if isinstance(size, str) else size / MIB, 2)


def gib(size: str | Column) -> Column:
    return F.round(F.col(size) / GIB if isinstance(size, str) else size / GIB, 2)


def percent(part: str | Column, whole: str | Column) -> Column:
    """Share in percent, 2 decimals; NULL when the whole is zero."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, 2)


def in_section(section: str, key: str) -> Column:
    """A value inside a section: NULL without the section, 0 when only the key is missing."""
    return F.when(F.col(section).isNotNull(), F.coalesce(F.col(f"{section}.{key}"), F.lit(0.0)))
