"""Reading the log table: filters, pages, counts, retention."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.levels import at_least
from emberlog.sources import logs as log_table
from emberlog.sources.logs import COLUMNS


def _instant(text: str | datetime | None) -> datetime | None:
    """In UTC and without zone; a text that isn't RFC 3339 is no bound at all."""
    if isinstance(text, str):
        try:
            text = datetime.fromisoformat(text)
        except ValueError:
            return None
        if text.tzinfo is None:
            return None
    return text.astimezone(timezone.utc).replace(tzinfo=None) if text is not None and text.tzinfo else text


@dataclass
class LogQuery:
    """Which entries, newest first. A limit of 0 is 100. search is a LIKE pattern within the message."""

    source: str | None = None
    pack: str | None = None
    level_min: str | None = None
    search: str | None = None
    since: str | datetime | None = None
    until: str | datetime | None = None
    limit: int = 100
    offset: int = 0

    def conditions(self, columns: list[str]) -> list[Column]:
        out = []
        if self.source is not None:
            out.append(F.col("source") == self.source)
        if self.pack is not None:
            out.append(F.col("pack") == self.pack)
        if self.level_min is not None:
            out.append(at_least("level", self.level_min))
        if self.search is not None:
            out.append(F.col("message").like(f"%{self.search}%"))
        since, until = _instant(self.since), _instant(self.until)
        by_day = "day" in columns  # then whole folders are left out too
        if since is not None:
            out.append(F.col("timestamp") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
            out += [F.col("day") >= F.lit(since.date())] if by_day else []
        if until is not None:
            out.append(F.col("timestamp") <= F.lit(until.isoformat(sep=" ")).cast("timestamp_ntz"))
            out += [F.col("day") <= F.lit(until.date())] if by_day else []
        return out

    def matches(self, logs: DataFrame) -> DataFrame:
        """All entries that fit, in no order: every filter can go down to the scan."""
        return reduce(DataFrame.where, self.conditions(logs.columns), logs)

    def run(self, logs: DataFrame) -> DataFrame:
        """A page of the entries that fit; of equal time the larger id comes first."""
        page = self.matches(logs).select(*COLUMNS).orderBy(F.desc("timestamp"), F.desc("id"))
        return (page.offset(self.offset) if self.offset > 0 else page).limit(self.limit or 100)


def tail(logs: DataFrame, n: int = 20, *, source: str | None = None, pack: str | None = None) -> DataFrame:
    """The newest n entries, oldest first."""
    return LogQuery(source=source, pack=pack, limit=n).run(logs).orderBy("timestamp", "id")


def page_totals(logs: DataFrame, query: LogQuery) -> DataFrame:
    """total: entries of the table; matching: of those, how many fit; returned: how many the page holds. One pass."""
    fits = reduce(lambda a, b: a & b, query.conditions(logs.columns), F.lit(True))
    found = logs.agg(F.count("*").alias("total"), F.count_if(fits).alias("matching"))
    returned = F.least(F.lit(query.limit or 100), F.greatest(F.col("matching") - max(query.offset, 0), F.lit(0)))
    return found.withColumn("returned", returned.cast("long"))


def sql(spark: SparkSession, logs: DataFrame, text: str) -> DataFrame:
    """Any SQL over the view logs, in its own columns."""
    logs.createOrReplaceTempView("logs")
    return spark.sql(text)


def count_by(logs: DataFrame, column: str) -> DataFrame:
    """Entries by source or pack, most first."""
    return logs.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column)


def stats(logs: DataFrame) -> DataFrame:
    """One row: entries, the oldest and newest time, and how many each source has (most first)."""
    # one pass: the groups of sources are few, and the totals are sums over them
    by = logs.groupBy("source").agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("source").alias("source"), F.col("n").alias("n"))))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.transform(order, lambda x: F.struct(x["source"].alias("source"), x["n"].alias("n"))).alias("by_source"))


def table_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Size of the table's files."""
    stored = spark.read.schema(log_table.STORED).parquet(path)
    return stored.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def cutoff(days: int, now: datetime) -> datetime:
    return _instant(now) - timedelta(days=days)


def expired(logs: DataFrame, days: int, now: datetime) -> DataFrame:
    """Entries older than so many days before now; one of exactly that age stays."""
    return logs.where(F.col("timestamp") < F.lit(cutoff(days, now).isoformat(sep=" ")).cast("timestamp_ntz"))


def kept(logs: DataFrame, days: int, now: datetime) -> DataFrame:
    return logs.where(F.col("timestamp") >= F.lit(cutoff(days, now).isoformat(sep=" ")).cast("timestamp_ntz"))


def apply_retention(spark: SparkSession, path: str, days: int, now: datetime) -> int:
    """Delete the expired entries of a table and return how many there were.

    One mark hides them all at once, beside any writer and any stream; see logs.mark(). Entries that are stored later
    are left to the next run, however old they are. Files of days that an earlier run deleted go with this one.
    """
    at = cutoff(days, now)
    gone = log_table.read(spark, path).where(F.col("day") <= F.lit(at.date())).transform(lambda t: expired(t, days, now)).count()
    if gone or log_table.marks(spark, path):
        log_table.mark(spark, path, at)
    return gone
