"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a key from a hash of its id. A source's key range is cut into as many equal ranges as its
share of the rows asks for, so one source that holds most rows is spread over most tasks. Running sums
within a range plus the sums of the ranges before give each row its place in its source, and a source is
cut where its budget ends: whole epochs first, then rows in key order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import BLANK, cut, n_words

#: Ranges over all sources together, and the fewest rows for which a range is worth having.
RANGES, LEAST_ROWS = 16384, 64
KEY_SPAN = 1 << 28


def hash_key(id: Column, seed: int) -> Column:
    """28 bits of the MD5 of seed and id: any engine can compute the same order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources: source, source_size, n. Adds target: share of all sizes by weight, none above most times its source.

    Weights go to the sources in code point order, null last, and repeat. What a full source can't take is
    dealt to the others by weight again; in the order of size by weight the full ones come first, so one
    pass of running sums finds the final price of a unit of weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    fill = Window.orderBy("__ratio", "__pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__ratio", "__pos").rowsBetween(0, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    price = (F.col("__budget") - F.coalesce(F.sum("__cap").over(fill), F.lit(0.0))) / F.sum("__w").over(after)
    return (
        sources.withColumn("__pos", F.row_number().over(order))
        .withColumn("__w", w)
        .withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__price", price)
        .withColumn("__full", F.col("__price") >= F.col("__ratio"))
        .withColumn("__price", F.min_by(F.when(~F.col("__full"), F.col("__price")), F.when(~F.col("__full"), F.struct("__ratio", "__pos"))).over(all_rows))
        .withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least("__cap", F.col("__price") * F.col("__w"))))
        .select("source", "source_size", "n", "target")
    )


def mix(
    df: DataFrame,
    *,
    source: str = "source",
    size: str | Column = "size",
    id: str = "doc_id",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """All rows and columns of df with size, source_size, target and taken (the words that the mix takes of the row).

    Columns of df of these four names are replaced. Null sizes count as 0, a null source is a source of its
    own, rows of equal id, size and other columns are interchangeable; an empty table gives an empty table.
    taken is at most ceil(most) times size, and the sum of a source is its target rounded down.
    """
    size = F.col(size) if isinstance(size, str) else size
    rows = (
        df.withColumn("size", F.coalesce(size.cast("long"), F.lit(0)))
        .drop("source_size", "target", "taken")
        .withColumn("__source", F.col(source))
        .withColumn("__key", hash_key(F.col(id), seed))
    )
    stats = targets(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    each = F.greatest(F.lit(float(LEAST_ROWS)), F.sum("n").over(Window.partitionBy()) / F.lit(RANGES))
    stats = stats.select(F.col("source").alias("__s"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / each)).alias("__ranges"))
    placed = (
        rows.join(stats, F.col("__source").eqNullSafe(F.col("__s")))
        .drop("__s")
        .withColumn("__range", F.floor(F.col("__key") * F.col("__ranges") / F.lit(KEY_SPAN)))
    )
    # rows without an id have one key and would be one range: in the order of their sizes they are as many as there are sizes
    alone, without = hash_key(F.lit(None).cast(df.schema[id].dataType), seed), F.col(id).isNull()
    placed = placed.withColumn("__part", F.struct(F.when(F.col("__key") < alone, 0).when(without, 1).otherwise(2).alias("a"), F.when(without, F.col("size")).otherwise(0).alias("b")))
    sums = placed.groupBy("__source", "__range", "__part").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__source").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__source").alias("__s"), F.col("__range").alias("__r"), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__source", "__range", "__part").orderBy("__key", id, "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - epochs * F.col("source_size") - F.col("__base") - F.col("__before")
    return (
        placed.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")) & (F.col("__part") == F.col("__p")))
        .withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long"))
        .select(*[c for c in df.columns if c not in ("size", "source_size", "target", "taken")], "size", "source_size", "target", "taken")
    )


def repeat_taken(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix: each row as often as it was taken whole, and once more cut after its last taken word."""
    pieces = F.split(text, rf"(?<=[^{BLANK}])(?=[{BLANK}])")
    part = F.when(F.col("__take") >= F.col("size"), F.col(text)).otherwise(F.concat_ws("", F.slice(pieces, F.lit(1), F.col("__take").cast("int"))))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return (
        mixed.where("taken > 0")
        .withColumn("__turn", F.explode(F.sequence(F.lit(1), times)))
        .withColumn("__take", F.col("taken") - (F.col("__turn") - 1) * F.col("size"))
        .withColumn(text, part)
        .drop("__turn", "__take")
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs."""
    sized = cut(docs.select("doc_id", "source", n_words("text").alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
