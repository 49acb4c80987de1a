"""Time and number coercion: instants, never strings, are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Something after the time of day: an offset or a zone.
_ZONE = r":[0-9.]+ *[A-Za-z+-].*$"


def parse_instant(text: Column) -> Column:
    """ISO 8601 text to an instant, in UTC where it names no offset; null when it does not parse."""
    written = F.nullif(F.trim(text), F.lit(""))
    parsed = F.try_to_timestamp(written)
    return (
        F.when(written.rlike(_ZONE), parsed)
        .when(written.contains(":"), F.try_to_timestamp(F.concat(written, F.lit("Z"))))
        .otherwise(F.from_utc_timestamp(parsed, F.current_timezone()))
    )


def parse_number(text: Column) -> Column:
    return text.try_cast("double")


def iso_utc(instant: Column) -> Column:
    """An instant as text in UTC, whatever the session time zone; for display only."""
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
