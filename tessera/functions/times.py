"""Time stamps kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def is_rfc3339(text: Column) -> Column:
    """Whether text is a valid RFC 3339 moment; never null.

    Impossible days, hours after 23, minutes or seconds after 59 and moments without an
    offset are not valid.
    """
    return F.coalesce(text.rlike(_RFC3339) & F.substring(text, 1, 10).try_cast("date").isNotNull(), F.lit(False))


def rfc3339_micros(text: Column) -> Column:
    """Microseconds since 1970 of a valid RFC 3339 moment (see is_rfc3339), else null; digits beyond microseconds are dropped."""
    num = lambda pos: F.substring(text, pos, 2).try_cast("int")
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date")).cast("long")
    frac = F.when(F.substring(text, 20, 1) == ".", F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)", 1), 1, 6), 6, "0").try_cast("long")).otherwise(0)
    off = F.right(text, F.lit(6))
    minutes = F.when(F.upper(F.right(text, F.lit(1))) == "Z", 0).otherwise(
        F.when(off.startswith("-"), -1).otherwise(1) * (F.substring(off, 2, 2).try_cast("int") * 60 + F.substring(off, 5, 2).try_cast("int"))
    )
    seconds = day * 86400 + num(12) * 3600 + num(15) * 60 + num(18) - minutes * 60
    return F.when(is_rfc3339(text), seconds * 1_000_000 + frac)


def now_rfc3339() -> Column:
    """The moment the query starts at, in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
