"""Comparing the members of groups inside tasks, a bounded block of a group at a time.

Rows are sorted by group key within partitions and stream through a task; a group above the limit is dealt
into blocks by a hash of its members and every pair of blocks is a group of its own, so no task holds more
than two blocks and no pair of rows leaves a task: a task gives counts and the stars of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Adds lo, hi, side and deals rows out sorted by keys, lo, hi. Rows of a pair lo < hi meet those of the other side only."""
    large = rows.groupBy(*keys).count().where(F.col("count") > limit).select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("count") / limit).cast("int").alias("__n"))
    same = [rows[k] == F.col(f"__{k}") for k in keys]
    mine, other = F.col("__mine"), F.col("__other")
    return (
        rows.join(large, same, "left")
        .withColumn("__n", F.coalesce("__n", F.lit(1)))
        .withColumn("__mine", F.pmod(F.xxhash64(F.lit(7), member), F.col("__n")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .select(*rows.columns, F.least(mine, other).alias("lo"), F.greatest(mine, other).alias("hi"), (mine > other).alias("side"))
        .repartition(*keys, "lo", "hi")
        .sortWithinPartitions(*keys, "lo", "hi")
    )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted batches, with the number of each row's group."""
    keys = [*keys, "lo", "hi"]
    rest = None
    for batch in batches:
        if batch.num_rows:
            rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
            group = _numbers(rest, keys)
            n = int(np.searchsorted(group, group[-1]))
            if n:
                yield rest.slice(0, n), group[:n]
                rest = rest.slice(n)
    if rest is not None:
        yield rest, _numbers(rest, keys)


def _numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, dtype=bool)
    for k in keys:
        x = t[k].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are linked to a smaller one, and the smallest that they reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        far = x != y
        if not far.any():
            break
        np.minimum.at(up, np.maximum(x, y)[far], np.minimum(x, y)[far])
        while (up != up[up]).any():
            up = up[up]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]
