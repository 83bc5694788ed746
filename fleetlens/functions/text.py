"""Text and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals, rounded half-even on its exact binary value."""
    return F.translate(F.format_number(value, digits), ",", "")


def iso(ts: str | Column) -> Column:
    """ISO-8601 text; a zero fraction of a second is left out, NULL stays NULL."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def label(name: str | Column) -> Column:
    """``cpu_usage`` becomes ``Cpu Usage``."""
    column = F.col(name) if isinstance(name, str) else name
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def probe_latency(output: str | Column) -> Column:
    """Milliseconds in a probe's text output, -1 when the probe failed."""
    found = F.regexp_extract(output, r"time=([0-9.]+) ?ms", 1)
    return F.coalesce(found.try_cast("double"), F.lit(-1.0))
