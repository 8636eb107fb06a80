"""Numbers and log entries as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def human_bytes(n: str | Column) -> Column:
    """Two decimals with GB, MB or KB, each 1024 of the next; bytes below that."""
    n = _col(n)
    out = F.when(n.isNull(), F.lit(None))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = out.when(n >= 1 << power, F.format_string(f"%.2f {unit}", F.bround(n / float(1 << power), 2)))
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def human_number(n: str | Column) -> Column:
    """One decimal with M or K, for millions or thousands; the number below that."""
    n = _col(n)
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", F.bround(n / 1e6, 1)))
        .when(n >= 1_000, F.format_string("%.1fK", F.bround(n / 1e3, 1)))
        .otherwise(n.cast("string"))
    )


def human_duration(seconds: str | Column) -> Column:
    """Days, hours and minutes, without leading parts that are zero."""
    s = _col(seconds)
    days, hours, minutes = (F.floor(s / 86400).cast("string"), F.floor(s % 86400 / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string"))
    return (
        F.when(s >= 86400, F.concat(days, F.lit("d "), hours, F.lit("h "), minutes, F.lit("m")))
        .when(s >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .otherwise(F.concat(minutes, F.lit("m")))
    )


def entry_line() -> Column:
    """An entry of a query's result: date, time, level in brackets, pack/source: message."""
    return F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "level", F.lit("] "), "pack", F.lit("/"), "source", F.lit(": "), F.coalesce("message", F.lit("")))


def tail_line() -> Column:
    """An entry of the live tail: time, level, pack/source, message."""
    return F.concat_ws(" ", F.date_format("timestamp", "HH:mm:ss"), "level", F.concat("pack", F.lit("/"), "source"), F.coalesce("message", F.lit("")))
