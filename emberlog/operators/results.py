"""What an interface answers, as frames of one JSON text: pages, counts, statistics, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.formats import human_bytes
from emberlog.operators.query import LogQuery, count_by, stats
from emberlog.sources.logs import COLUMNS


def _told(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(n) for n, v in values.items()]), {"ignoreNullFields": "false"}).alias("json")


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """One row with all rows in their order: the caller bounds them."""
    numbered = F.array_sort(F.collect_list(F.struct("__n", F.struct(*columns).alias("row"))))
    return rows.withColumn("__n", F.monotonically_increasing_id()).agg(F.transform(numbered, lambda x: x["row"]).alias(name))


def page(logs: DataFrame, query: LogQuery) -> DataFrame:
    """{"logs": [...], "total": n}: the page of a query, as long as its limit, and the entries of the table."""
    total = logs.agg(F.count("*").alias("total"))
    return _listed(query.run(logs), "logs", *COLUMNS).crossJoin(total).select(_told(logs=F.col("logs"), total=F.col("total")))  # one row each


def counts(logs: DataFrame) -> DataFrame:
    """{"total": n, "by_source": [...], "by_pack": [...]}: as many groups as there are sources and packs."""
    by = lambda c: _listed(count_by(logs, c), f"by_{c}", c, "cnt")
    total = logs.agg(F.count("*").alias("total"))
    return total.crossJoin(by("source")).crossJoin(by("pack")).select(_told(total=F.col("total"), by_source=F.col("by_source"), by_pack=F.col("by_pack")))  # one row each


def statistics(logs: DataFrame, bytes_: int) -> DataFrame:
    """{"total_logs", "sources", "db_size_bytes", "oldest_entry", "newest_entry"}."""
    return stats(logs).select(_told(total_logs=F.col("total"), sources=F.col("by_source"), db_size_bytes=F.lit(bytes_), oldest_entry=F.col("oldest"), newest_entry=F.col("newest")))


def status(logs: DataFrame, bytes_: int, version: str, window_size: int) -> DataFrame:
    """{"status", "version", "logs_stored", "storage_bytes", "storage", "correlation_window_size"}."""
    size = F.lit(bytes_)
    return logs.agg(F.count("*").alias("n")).select(_told(status=F.lit("running"), version=F.lit(version), logs_stored=F.col("n"), storage_bytes=size, storage=human_bytes(size), correlation_window_size=F.lit(window_size)))
