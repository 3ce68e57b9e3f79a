"""Date and time text that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ntz: Column) -> Column:
    """Milliseconds since the epoch of a zoneless timestamp read as UTC."""
    seconds = F.unix_date(ntz.cast("date")) * F.lit(86400).cast("bigint") + F.hour(ntz) * 3600 + F.minute(ntz) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ntz) * 1000).cast("bigint")


def local_time(ms: Column, zone: str) -> Column:
    """Zoneless wall-clock time in ``zone`` of an epoch-millisecond column."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=ms / F.lit(1000).cast("decimal(4,0)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def after_seconds(ntz: Column, seconds: Column) -> Column:
    return ntz + F.make_dt_interval(secs=seconds)
