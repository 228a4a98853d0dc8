"""Wall-clock times (no zone, read as UTC) and instants, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_instant(wall_clock: Column) -> Column:
    """UTC wall-clock time -> instant, as watermarks need it."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock)
    return local.cast("timestamp")


def utc_wall_clock(instant: Column) -> Column:
    """Instant -> UTC wall-clock time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
