"""Searches for texts that leave out the files which can't hold them.

For each file of the table of entries a bitmap of BITS says which trigrams of characters its messages hold, by their
hashes. It is made beside the table, for the batches that have none yet; files without one are always read. The LIKE
of the query decides about rows as before, so the bitmaps only save reading.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.query import LogQuery
from emberlog.sources import logs as log_table

#: Bits of a file's bitmap: as many as Spark's bitmap functions gather.
BITS = 32_768
_INDEX = "file string, bits binary, batch string"


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text, as places in a bitmap; empty for shorter texts."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(at, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(3))), F.lit(BITS)))))


def update(spark: SparkSession, path: str) -> int:
    """Make the bitmaps of the batches that have none; returns of how many. May be stopped and repeated: a batch's bitmaps come as one."""
    fs, p = log_table.file_system(spark, path)
    there = {s.getPath().getName() for s in fs.globStatus(p(f"{path}/batch=*")) or []}
    done = {s.getPath().getName() for s in fs.globStatus(p(f"{path}/_grams/batch=*")) or []}
    for batch in sorted(there - done):
        rows = spark.read.schema(log_table.STORED).option("basePath", path).parquet(f"{path}/{batch}").select(F.col("_metadata.file_path").alias("file"), F.explode(_grams(F.col("message"))).alias("place"))
        bits = rows.groupBy("file", "place").agg(F.lit(1).alias("one")).groupBy("file").agg(F.bitmap_construct_agg("place").alias("bits"))
        log_table.add_batch(bits, f"{path}/_grams", f"{path}/_grams/{batch}")
    return len(there - done)


def literals(pattern: str) -> list[str]:
    """The parts of a LIKE pattern that stand in every text it fits: what is between its wildcards. One with a backslash states none."""
    return [] if "\\" in pattern else [x for x in re.split(r"[%_]", pattern) if len(x) >= 3]


def without(spark: SparkSession, path: str, pattern: str) -> set[str]:
    """The files of the table that by their bitmaps hold no text that the pattern fits."""
    parts = literals(pattern)
    if not parts or not log_table.exists(spark, f"{path}/_grams"):
        return set()
    index = spark.read.schema(_INDEX).parquet(f"{path}/_grams")
    wanted = F.array_distinct(F.flatten(F.array(*[_grams(F.lit(x)) for x in parts])))
    byte = lambda i: F.conv(F.hex(F.substring(F.col("bits"), (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.forall(wanted, lambda i: byte(i).bitwiseAND(F.element_at(F.lit([1, 2, 4, 8, 16, 32, 64, 128]), (i % 8 + 1).cast("int"))) != 0)
    return {r.file for r in index.where(~held).select("file").collect()}


def table(spark: SparkSession, path: str, pattern: str | None) -> tuple[DataFrame, int, int]:
    """The table without the files that can't hold what the pattern looks for; how many files it has, and how many are left out."""
    whole = log_table.read(spark, path)
    if pattern is None:
        return whole, len(whole.inputFiles()), 0
    gone = {_plain(f) for f in without(spark, path, pattern)}
    files = whole.inputFiles()
    kept = [f for f in files if _plain(f) not in gone]
    if len(kept) == len(files):
        return whole, len(files), 0
    return (log_table.read(spark, path, files=kept) if kept else whole.where("false")), len(files), len(files) - len(kept)


def _plain(file: str) -> str:
    """A file's name as it is in the folder, however its path was written."""
    return unquote(re.sub(r"^[a-z0-9]+:/*", "/", file))


def run(spark: SparkSession, path: str, query: LogQuery) -> DataFrame:
    """query.run() over the table at path, without the files that its search leaves out."""
    return query.run(table(spark, path, query.search)[0])
