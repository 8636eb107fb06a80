"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints that differ in at most t bits differ, in at least one of m groups of bits, by no more than
that group's threshold, if the thresholds plus one sum to t + 1. Bits that agree with each other are put
into one group, and a dynamic programme deals out the thresholds so that signatures and candidates cost
least; their counts are estimated from how often each bit is set over all fingerprints. Fingerprints meet
under a group's value or, by probes, under the values near it, and every candidate is verified on all bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.blocks import deal, forest, whole_groups
from emberlog.llm.shared import components, cut, small_batches

#: Members of a group that are compared in one piece.
BLOCK = 1024
#: Relative costs of moving a signature and of verifying a candidate.
SIGNATURE_COST, CANDIDATE_COST = 1.0, 0.005
LANES, ONES = np.arange(8, dtype=np.uint64)[:, None], np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64 bits; a bit is 1 if more than half of the shingles' XXH64 have it. No words: 0."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[len(words) - n :] - 1).tolist()
    counts = np.zeros((8, 8), dtype=np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)])], dtype=np.uint64)
        # a byte of each lane counts one bit of up to 255 hashes
        lanes = np.add.reduceat((h >> LANES) & ONES, np.arange(0, len(h), 255), axis=1)
        counts += lanes.view(np.uint8).reshape(8, -1, 8).sum(1, dtype=np.int64)
    bits = (counts * 2 > n).T.reshape(64)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, keep: list[str] | None = None, text: str = "text", into: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    """The columns to keep (doc_id) of each row with its fingerprint, 64 bits as a long; a null text counts as empty."""
    keep = ["doc_id"] if keep is None else keep
    rows = small_batches(docs).select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", shingle, seed) for t in b.column(len(keep)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=[*keep, into])

    return rows.mapInArrow(run, rows.select(*keep, F.lit(None).cast("long").alias(into)).schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j set, for all i and j; over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        at = np.arange(4096, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])

    # at most 4097 rows come back, whatever the number of fingerprints
    got = dict(map(tuple, fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect()))
    return int(got.pop(-1, 0) or 0), np.array([got.get(i, 0) for i in range(4096)], dtype=float).reshape(64, 64)


def plan_groups(n: int, both: np.ndarray, bits: int = 4) -> list[tuple[list[int], int]]:
    """Groups of bit numbers with a threshold each; a threshold of -1 needs no search."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    alike = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    best = (math.inf, [])
    for m in range(2, bits + 2):
        groups, left = [], set(range(64))
        for i in range(m):
            size = len(left) // (m - i)
            group = [max(sorted(left), key=lambda b: alike[b, sorted(left)].sum())]
            left.discard(group[0])
            while len(group) < size:
                group.append(max(sorted(left), key=lambda b: alike[b, group].sum()))
                left.discard(group[-1])
            groups.append(sorted(group))
        costs = [[_cost(n, [2 * p[b] * (1 - p[b]) for b in g], t) for t in range(-1, bits + 1)] for g in groups]
        # cheapest[s]: thresholds so far whose successors sum to s
        cheapest = {0: (0.0, [])}
        for c in costs:
            cheapest = {
                s: min((cheapest[s - u][0] + c[u], [*cheapest[s - u][1], u - 1]) for u in range(len(c)) if s - u in cheapest)
                for s in range(bits + 2)
                if any(s - u in cheapest for u in range(len(c)))
            }
        if cheapest[bits + 1][0] < best[0]:
            best = (cheapest[bits + 1][0], list(zip(groups, cheapest[bits + 1][1], strict=True)))
    return best[1]


def _cost(n: int, differ: list[float], t: int) -> float:
    if t < 0:
        return 0.0
    near = [1.0] + [0.0] * t  # near[d]: chance that d bits of the group differ
    for q in differ:
        near = [near[d] * (1 - q) + (near[d - 1] * q if d else 0) for d in range(t + 1)]
    ball = sum(math.comb(len(differ), d) for d in range(t + 1))
    return SIGNATURE_COST * n * (ball + (t > 0)) + CANDIDATE_COST * n * n / 2 * sum(near) * (1 + (t > 0))


def link(nodes: DataFrame, *, bits: int = 4) -> DataFrame:
    """nodes: node, fp (distinct). Returns edges (a, b) whose components are those of all pairs within bits."""
    plan = [(g, t) for g, t in plan_groups(*bit_counts(nodes), bits) if t >= 0]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = b.column("fp").to_numpy().view(np.uint64), b.column("node").to_numpy()
            for i, (group, t) in enumerate(plan):
                mask = np.uint64(sum(1 << x for x in group))
                for d in range(t + 1):
                    for flips in itertools.combinations(group, d):
                        sig = (fp & mask) ^ np.uint64(sum(1 << x for x in flips))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(fp), i, np.int32)), pa.array(sig.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(node), pa.array(np.full(len(fp), d == 0))],
                            names=["part", "sig", "fp", "node", "own"],
                        )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["part", "sig"]):
            fp, node, own, side = t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy(), t["own"].to_numpy(), t["side"].to_numpy()
            split = t["lo"].to_numpy() != t["hi"].to_numpy()
            a, b, held = [], [], 0
            i, k = np.arange(len(fp)), 0
            while len(i := i[i + k + 1 < len(fp)]):
                k += 1
                i = i[group[i] == group[i + k]]
                j = i + k
                near = (np.bitwise_count(fp[i] ^ fp[j]) <= bits) & (own[i] | own[j]) & (~split[i] | (side[i] != side[j]))
                a.append(node[i[near]])
                b.append(node[j[near]])
                held += int(near.sum())
                if held > 1 << 20:
                    x, y = forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
            if held:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    signed = nodes.select("fp", "node").mapInArrow(sign, "part int, sig long, fp long, node long, own boolean")
    return deal(signed, ["part", "sig"], "fp", BLOCK).mapInArrow(verify, "a long, b long")


def groups(fps: DataFrame, *, bits: int = 4) -> DataFrame:
    """fps: fp. Each fingerprint with root, the smallest one that its component reaches by links."""
    nodes = cut(fps.select("fp", F.col("fp").alias("node")).distinct())
    roots = components(link(nodes, bits=bits))
    return nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, *, bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for each row of docs.

    Null and empty texts have fingerprint zero and are linked as any other. Equal fingerprints are compared
    once, whatever the number of their rows. Rows without a doc_id link as others do but lend no component its
    name; one of such rows alone has none. An empty table gives an empty table.
    """
    fps = cut(fingerprints(docs, shingle=shingle, seed=seed))
    named = fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")).join(groups(fps, bits=bits), "fp")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(of_root, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, bits: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row of each component: that of the smallest doc_id (nulls last), of equal ones the first by a hash of all columns.

    Rows are numbered as they are written with their fingerprints, so only numbers are compared and grouped, and
    texts move once.
    """
    kept = docs.columns
    every = F.xxhash64(*kept)
    rows = cut(fingerprints(docs.withColumn("__hash", every), keep=[*kept, "__hash"], into="__fp", shingle=shingle, seed=seed).withColumn("__row", F.monotonically_increasing_id()))
    roots = groups(rows.select(F.col("__fp").alias("fp")), bits=bits).select(F.col("fp").alias("__fp"), F.col("root").alias("__root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "__row")
    first = rows.select("__fp", "__row", order.alias("__order")).join(roots, "__fp").groupBy("__root").agg(F.min_by("__row", "__order").alias("__row"))
    return rows.join(first.select("__row"), "__row", "left_semi").select(*kept)
