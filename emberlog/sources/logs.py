"""The log table: its columns, where it is kept, and one made from the events table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.levels import normalise
from emberlog.functions.values import in_utc, timestamp, ulid

#: The columns of an entry, in order. fields is a JSON object; timestamp is in UTC.
SCHEMA = "id string, timestamp timestamp_ntz, source string, host string, level string, message string, fields string, raw string, pack string, day date"
COLUMNS = ["id", "timestamp", "source", "host", "level", "message", "fields", "raw", "pack"]


def with_day(logs: DataFrame) -> DataFrame:
    return logs.withColumn("day", F.to_date("timestamp"))


def append(logs: DataFrame, path: str, *, batch: str | None = None) -> bool:
    """Add entries to a table in Parquet as one batch: all of them are there, or none. False if the batch was there.

    A batch is written beside the table and becomes part of it by one rename that fails where its folder exists: so
    writers, streams and retention share a table, and a batch of a name that is done again adds nothing. Days are
    gathered into files of a good size: a large day is several tasks, small ones share one.
    """
    spark, batch = logs.sparkSession, batch or uuid.uuid4().hex
    if exists(spark, f"{path}/batch={batch}"):
        return False
    days = with_day(logs).select(*COLUMNS, "day").hint("rebalance", "day").write.partitionBy("day")
    return _add(spark, path, f"{path}/batch={batch}", lambda staged: days.parquet(f"{staged}/at={_now_ms()}"))


def add_batch(rows: DataFrame, path: str, target: str) -> bool:
    """Rows of any table under path as one folder of it; False if that is there."""
    return _add(rows.sparkSession, path, target, rows.write.parquet)


def _add(spark: SparkSession, path: str, target: str, write: Callable[[str], None]) -> bool:
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    write(staged)
    return _commit(spark, staged, target)


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


def _commit(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename a folder to one that mustn't be there; False if it is."""
    jvm, to = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()) if to.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(staged), to, options)
    except Py4JJavaError as e:
        if not exists(spark, target):
            raise
        if "AlreadyExists" not in str(e.java_exception):
            raise
        file_system(spark, staged)[0].delete(jvm.org.apache.hadoop.fs.Path(staged), True)
        return False
    return True


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the constructor of paths."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p(path))


#: The columns of a table's files: those of an entry, and its batch and when that was begun (milliseconds), of the folders.
STORED = f"{SCHEMA}, batch string, at long"


def read(spark: SparkSession, path: str, *, stream: bool = False, files: list[str] | None = None) -> DataFrame:
    """Entries of a table, and the day that says in which folder each lies; as a stream, those of each new batch.

    files: only these of its files. A stream gives entries as they were stored; what retention has deleted by then, files that are gone included, it leaves out.
    """
    if stream:
        return spark.readStream.schema(STORED).option("ignoreMissingFiles", "true").parquet(path).select(*COLUMNS, "day")
    table = spark.read.schema(STORED).option("basePath", path).parquet(*(files or [path]))
    for cutoff, upto in marks(spark, path):
        table = table.where((F.col("at") > upto) | F.col("timestamp").isNull() | (F.col("timestamp") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")))
    return table.select(*COLUMNS, "day")


def marks(spark: SparkSession, path: str) -> list[tuple[datetime, int]]:
    """What retention has deleted: entries before a time, of batches that were begun up to a moment (milliseconds)."""
    fs, p = file_system(spark, path)
    folder = p(f"{path}/_retained")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return [(_EPOCH + timedelta(microseconds=int(cutoff)), int(upto)) for cutoff, _, upto in (n.partition("_") for n in names)]


_EPOCH = datetime(1970, 1, 1)


def mark(spark: SparkSession, path: str, cutoff: datetime) -> None:
    """Delete the entries before a time that are there now: one empty folder, so all of them go at once.

    Files whose entries were all deleted by an earlier mark go now; those who read them have had the time since.
    """
    before, (fs, p), upto = marks(spark, path), file_system(spark, path), _now_ms()
    name = lambda at, upto: p(f"{path}/_retained/{(at - _EPOCH) // timedelta(microseconds=1)}_{upto}")
    fs.mkdirs(name(cutoff, upto))
    for status in (fs.globStatus(p(f"{path}/batch=*/at=*/day=*")) or []) if before else []:
        folder = status.getPath()
        day, at = folder.getName().removeprefix("day="), int(folder.getParent().getName().removeprefix("at="))
        if any(at <= up and day < cut.date().isoformat() for cut, up in before if day[:1].isdigit()):
            fs.delete(folder, True)
    for cut, up in before:
        if cut <= cutoff and up < upto:
            fs.delete(name(cut, up), True)


def decoded(table: DataFrame, now: Column | None = None) -> DataFrame:
    """Entries of any table: columns that are missing, null or of no use have defaults.

    Texts are empty, an id that isn't of 26 characters is a new one, a time that can't be read is now, a level
    is the nearest known one, and fields that are no JSON object are an empty one.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in table.columns else F.lit("")
    at = table.schema["timestamp"].dataType.simpleString() if "timestamp" in table.columns else ""
    read = F.col("timestamp") if at == "timestamp_ntz" else in_utc(F.col("timestamp")) if at == "timestamp" else timestamp(text("timestamp"))
    fields = text("fields")
    return table.select(
        F.when(text("id").rlike("^[0-9A-Za-z]{26}$"), text("id")).otherwise(ulid()).alias("id"),
        F.coalesce(read, in_utc(F.current_timestamp()) if now is None else now).alias("timestamp"),
        text("source").alias("source"), text("host").alias("host"), normalise(text("level")).alias("level"), text("message").alias("message"),
        F.when(fields.rlike(r"^\s*\{") & F.try_parse_json(fields).isNotNull(), fields).otherwise("{}").alias("fields"), text("raw").alias("raw"), text("pack").alias("pack"),
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made from the events table, the same in every engine: seq is the order of arrival."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    of = lambda **by: F.when(F.col("event_type") == "error", by["error"]).when(F.col("event_type") == "purchase", by["purchase"]).when(F.col("event_type") == "signup", by["signup"])
    status = F.when(F.col("event_type") == "error", 502).otherwise(200)
    uri = F.concat(F.lit("/"), "event_type", F.lit("/"), "k")
    client = F.concat(F.lit("10.0.0."), F.col("user_id") % 250)
    request = F.when(F.col("event_type").isin("error", "purchase"), F.concat(F.lit(" request_id="), F.lpad(F.lower(F.hex(F.col("user_id") % 4096)), 8, "0"))).otherwise("")
    session = F.when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit(',"session_id":"s-'), F.col("user_id") % 500, F.lit('"'))).otherwise("")
    pid = F.when(F.col("event_type").isin("error", "signup"), F.concat(F.lit(',"pid":'), F.col("user_id") % 300)).otherwise("")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"),
        F.col("ts").alias("timestamp"),
        of(error=F.lit("error"), purchase=F.lit("slow"), signup=F.lit("auth")).otherwise("access").alias("source"),
        F.concat(F.lit("host-"), F.col("user_id") % 8).alias("host"),
        of(error=F.lit("error"), purchase=F.lit("warn"), signup=F.lit("info")).when(F.col("event_type") == "click", "debug").otherwise("trace").alias("level"),
        F.concat("event_type", F.lit(" k="), "k", F.lit(" client "), client, request).alias("message"),
        F.concat(F.lit('{"client_ip":"'), client, F.lit('","remote_user":"u'), "user_id", F.lit('","uri":"'), uri, F.lit('","status":'), status, session, pid, F.lit("}")).alias("fields"),
        F.concat(client, F.lit(" - u"), "user_id", F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), uri, F.lit(' HTTP/1.1" '), status, F.lit(" "), "event_id", F.lit(' "-" "agent/'), "k", F.lit('"')).alias("raw"),
        of(error=F.lit("php-fpm"), purchase=F.lit("mysql"), signup=F.lit("syslog")).otherwise("nginx").alias("pack"),
        F.col("event_id").alias("seq"),
    )
