"""Helpers that the corpus operators share: tables, written cuts of the lineage, connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators read it: the blank, and the control characters from tab to carriage return.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is named, one inside the warehouse, which must not be the driver's own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    local = spark.sparkContext.master.startswith("local")
    if not named and not local and root.startswith("file:"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_copy(spark: SparkSession, file: str) -> str:
    """A copy of one of the driver's files in the shared folder."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    to = path(f"{scratch_dir(spark)}/{os.path.basename(file)}")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.copyFromLocalFile(False, True, path(f"file://{file}"), to)
    return fs.makeQualified(to).toString()


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lost executors only cost what follows."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Bytes of a table in one of its buckets, about, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 50_000


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df as a table in the shared folder, dealt into files by a column: joins by that column move the other side only. forget() drops it.

    As many buckets as there are shuffle partitions, or more where by the size of the files it is read from these would be larger than BUCKET_BYTES.
    """
    spark, name = df.sparkSession, f"scratch_{uuid.uuid4().hex}"
    files = df.inputFiles()
    size = sum(_length(spark, f) for f in files) if len(files) <= 10_000 else len(files) * _length(spark, files[0])
    parts = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // BUCKET_BYTES))
    df.write.bucketBy(parts, column).format("parquet").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out._scratch_table = name
    return out


def _length(spark: SparkSession, file: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def forget(df: DataFrame) -> None:
    """Drop what bucketed() made of df, once nothing reads it any more."""
    spark, name = df.sparkSession, df._scratch_table
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of whole texts that go to Python at once.
TEXT_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, once its session hands at most TEXT_ROWS rows at once to Python: rows hold whole texts, and memory is bounded by rows."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def n_words(text: str | Column) -> Column:
    """Number of runs of characters that aren't white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: str | Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): every node of an edge with the smallest node that it reaches.

    Alternating large and small stars (Kiveris et al. 2014): each round hangs neighbours on the smallest
    node near them, with a minimum and a join by node, so no neighbourhood is ever collected. Each round
    is written to the shared folder. Loops, repeated edges and nulls in either column are dropped.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") != F.col("m")))
        .distinct()
    )
    state = _checksum(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("least").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("v", F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("e"))
            .select("e.*")
            .where("v != m")
            .distinct()
        )
        after = cut(small)
        discard(now)
        now, before, state = after, state, _checksum(after)
        if state == before:
            break
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())


def _checksum(pairs: DataFrame) -> tuple:
    hashed = F.xxhash64("v", "m").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(hashed)).first())
