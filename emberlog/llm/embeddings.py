"""Embedding near-duplicates by product quantisation.

Unit vectors are put into coarse inverted lists, and what is left after a list's centre is coded by the
nearest centroid in each subspace; the codes travel with the vectors. A vector is looked up in its own list and in
those whose border is near enough: of two linked vectors in different lists one is within half a link's length of
the border between them, and within less where a link's direction is one of many (see link_reach()). There, asymmetric distances are sums of table entries, and since each code
knows its error they bound the true distance from below. What remains is reranked by the exact cosine in double
precision. Equal vectors are one entry with a count. A task gives counts of links and the stars of a spanning
forest, never the pairs, and a list above a limit is dealt into pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.blocks import deal, forest, whole_groups
from emberlog.llm.shared import components, cut

#: Bounds of the fit: vectors and components of the sample (those of the smallest hashes of their ids).
FIT_ROWS, FIT_VALUES = 20_000, 2_000_000
#: Most coarse lists, vectors of one label that a list is meant for, and of the sample for each list; subspaces, codes of a subspace.
LISTS, LIST_ROWS, LIST_SAMPLE, SUBSPACES, CODES = 1024, 512, 8, 8, 64
#: Members of a group that are compared in one piece; rows whose distances to all centres are held at once.
BLOCK, ROWS = 4096, 2048
#: How far behind its list's border a vector's partners are looked for, in lengths of the longest link: half of it
#: loses no link, since both sides look.
EXACT = 0.5


@dataclass
class Index:
    """centres: of the lists; books: for each subspace its codes' centroids; cuts: the subspaces' bounds; reach: link_reach()."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray
    reach: float

    def lists(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and by vector and list whether its border is within reach."""
        home, near = np.empty(len(x), dtype=int), np.empty((len(x), len(self.centres)), dtype=bool)
        apart = np.sqrt(np.maximum(_square_distances(self.centres, self.centres), 1e-12))
        for s in range(0, len(x), ROWS):
            d2 = _square_distances(x[s : s + ROWS], self.centres)
            home[s : s + ROWS] = own = d2.argmin(1)
            least = d2[np.arange(len(d2)), own]
            near[s : s + ROWS] = d2 - least[:, None] <= 2 * reach * apart[own] + 1e-9
            near[s + np.arange(len(d2)), own] = False
        return home, near

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals in each subspace, and the length of what the codes leave."""
        codes = np.empty((len(rest), len(self.books)), dtype=np.uint8)
        left = np.zeros(len(rest))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            d2 = _square_distances(part, book)
            codes[:, m] = d2.argmin(1)
            left += np.maximum(d2.min(1), 0)
        return codes, np.sqrt(left)

    def tables(self, rest: np.ndarray) -> list[np.ndarray]:
        """For each subspace the square distances of the residuals to all codes."""
        return [_square_distances(rest[:, self.cuts[m] : self.cuts[m + 1]], book) for m, book in enumerate(self.books)]


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_square_distances(x[s : s + ROWS], centres).argmin(1) for s in range(0, len(x), ROWS)])


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a centroid without rows stays where it was."""
    at = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, at)
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(own, x[:, j], minlength=k)
            at[n > 0, j] = s[n > 0] / n[n > 0]
    return at


def build_index(sample: np.ndarray, n_lists: int, *, subspaces: int = SUBSPACES, codes: int = CODES) -> Index:
    """sample: unit vectors, one at least."""
    centres = _centroids(sample, max(1, min(n_lists, len(sample))))
    rest = sample - centres[_nearest(sample, centres)]
    cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    books = [_centroids(rest[:, a:b], min(codes, len(rest))) for a, b in zip(cuts, cuts[1:])]
    return Index(centres, books, cuts, link_reach(rest))


def link_reach(rest: np.ndarray) -> float:
    """The reach, in lengths of the longest link, that links behind a border exceed once in some 16,000.

    A link's direction is taken to be spread as the residuals are. Across a border it then goes no further than four
    standard deviations, at most those of the direction in which residuals spread most, and the nearer of its two
    vectors half as far. Residuals of few directions give EXACT.
    """
    spread = np.linalg.eigvalsh(rest.T @ rest)
    return EXACT if spread[-1] <= 0 else min(EXACT, 2 * math.sqrt(spread[-1] / spread.sum()))


def usable(embedding: str | Column) -> Column:
    """Neither null nor zero, and all components are finite."""
    x = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def fit(classes: DataFrame, *, rows: int = FIT_ROWS, values: int = FIT_VALUES, lists: int = LISTS) -> dict[int, Index]:
    """classes: node, label, dim, embedding. An index for each of the commonest dimensions (64 at most).

    There are two lists at least, and as many as the largest label needs: more of them would send each vector to more lists.
    """
    out = {}
    by_label = classes.groupBy("dim", "label").count()
    for r in by_label.groupBy("dim").agg(F.sum("count").alias("count"), F.max("count").alias("largest")).orderBy(F.desc("count"), "dim").limit(64).collect():
        most = max(1, min(rows, values // r.dim))
        share = min(1.0, most / r["count"])
        place = F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(1 << 30))
        chosen = classes.where((F.col("dim") == r.dim) & (place < F.lit(int(share * (1 << 30))))).select(place.alias("at"), "node", "embedding")
        found = chosen.limit(2 * most).toArrow().sort_by([("at", "ascending"), ("node", "ascending")])
        if found.num_rows:
            wanted = max(2, min(lists, -(-r.largest // LIST_ROWS)))
            out[r.dim] = build_index(_unit(_matrix(found["embedding"], r.dim)), min(wanted, max(2, found.num_rows // LIST_SAMPLE)))
    return out


def placed(classes: DataFrame, index: dict[int, Index], *, least: float = 0.93, reach: float | None = None) -> DataFrame:
    """classes: node, n, label, dim, embedding. A row for each vector in its own list, with code, error and the lists it visits too; and for each visit.

    A dimension that no index covers is one list, whose codes are made where it is compared.
    """
    far = math.sqrt(2 - 2 * least)
    schema = f"label {classes.schema['label'].dataType.simpleString()}, dim int, list int, home int, node long, n long, own boolean, code binary, error double, visits binary, x {classes.schema['embedding'].dataType.simpleString()}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = b.column("embedding").take(pa.array(at))
                x, known = _unit(_matrix(raw, dim)), index.get(int(dim))
                home, near = (np.zeros(len(at), dtype=int), np.zeros((len(at), 1), dtype=bool)) if known is None else known.lists(x, (known.reach if reach is None else reach) * far)
                codes, error = (None, np.zeros(len(at))) if known is None else known.encode(x - known.centres[home])
                rows, lists = np.nonzero(near)
                rows, lists = np.concatenate([np.arange(len(at)), rows]), np.concatenate([home, lists])
                own = np.arange(len(rows)) < len(at)
                here = lambda blobs: pa.array([*blobs, *[None] * (len(rows) - len(at))], pa.binary())
                taken = pa.array(at[rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("label").take(taken), b.column("dim").take(taken), pa.array(lists.astype(np.int32)), pa.array(home[rows].astype(np.int32)), b.column("node").take(taken), b.column("n").take(taken), pa.array(own),
                        here([None] * len(at) if codes is None else [c.tobytes() for c in codes]), pa.array(error[rows]), here([v.tobytes() for v in np.packbits(near, axis=1)]), raw.take(pa.array(rows)),
                    ],
                    names=["label", "dim", "list", "home", "node", "n", "own", "code", "error", "visits", "x"],
                )

    return classes.select("label", "dim", "node", "n", "embedding").mapInArrow(place, schema)


def near_pairs(classes: DataFrame, index: dict[int, Index], *, least: float = 0.93, reach: float | None = None) -> DataFrame:
    """classes: node, n, label, dim, embedding. Rows (a, b, is_count): a has b links in one group; or else a and b are a tree's edge.

    Two vectors of different lists meet in the later one if the other visits it, else in the earlier one.
    """
    far = math.sqrt(2 - 2 * least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ["label", "dim", "list"]):
            cols = {k: t[k].to_numpy() for k in ("dim", "list", "home", "node", "n", "own", "error", "lo", "hi", "side")}
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            links, a, b = np.zeros(len(group), dtype=np.int64), [], []
            for i, j in zip(bounds, bounds[1:]):
                if j - i < 2:
                    continue
                dim, at = int(cols["dim"][i]), int(cols["list"][i])
                x = _unit(_matrix(t["x"].slice(i, j - i), dim))
                own, side, home = (cols[k][i:j] for k in ("own", "side", "home"))
                if not own.any():
                    continue
                coded, mine = Coded.of(x, own, t["code"].slice(i, j - i), cols["error"][i:j], index.get(dim), at), np.flatnonzero(own)
                visits = np.zeros((len(own), len(index[dim].centres) if dim in index else 1), dtype=bool)
                visits[mine] = np.unpackbits(np.frombuffer(b"".join(t["visits"].slice(i, j - i).take(pa.array(mine)).to_pylist()), dtype=np.uint8).reshape(len(mine), -1), axis=1, count=visits.shape[1])
                if cols["lo"][i] == cols["hi"][i]:
                    sides = [(mine, mine, True), (np.flatnonzero(~own), mine, False)]
                else:
                    sides = [(np.flatnonzero(side), np.flatnonzero(~side & own), False), (np.flatnonzero(~side & ~own), np.flatnonzero(side & own), False)]
                for q, y, same in sides:
                    for p, r in coded.linked(q, y, same, least, far):
                        once = (home[p] <= at) | ~visits[r, home[p]]
                        p, r = p[once], r[once]
                        np.add.at(links, i + p, cols["n"][i + r])
                        np.add.at(links, i + r, cols["n"][i + p])
                        f, g = forest(cols["node"][i + p], cols["node"][i + r])
                        a.append(f)
                        b.append(g)
            hit = np.flatnonzero(links)
            if len(hit):
                f, g = forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cols["node"][hit], f])), pa.array(np.concatenate([links[hit], g])), pa.array(np.arange(len(hit) + len(f)) < len(hit))], names=["a", "b", "is_count"])

    rows = placed(classes, index, least=least, reach=reach)
    return deal(rows, ["label", "dim", "list"], "node", BLOCK).mapInArrow(compare, "a long, b long, is_count boolean")


@dataclass
class Coded:
    """The vectors of one list: x, and of its own members codes (in rows of all) and their errors."""

    x: np.ndarray
    index: Index
    centre: np.ndarray
    codes: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, own: np.ndarray, codes: pa.ChunkedArray, error: np.ndarray, index: Index | None, at: int) -> Coded:
        if index is None:  # a dimension beyond the fit: codes of its first members
            index, at = build_index(x[own][:BLOCK], 1), 0
            found, error = index.encode(x - index.centres[0])
        else:
            found = np.zeros((len(x), len(index.books)), dtype=np.uint8)
            mine = np.flatnonzero(own)
            found[mine] = np.frombuffer(b"".join(codes.take(pa.array(mine)).to_pylist()), dtype=np.uint8).reshape(len(mine), -1)
        return cls(x, index, index.centres[at], found, error)

    def candidates(self, q: np.ndarray, members: np.ndarray, far: float) -> np.ndarray:
        """By query and member, whether the asymmetric distance lets the true one be within far."""
        about = np.zeros((len(q), len(members)))
        for m, table in enumerate(self.index.tables(self.x[q] - self.centre)):
            about += np.take(table, self.codes[members, m], axis=1)
        return about <= ((far + self.error[members] + 1e-9) ** 2)[None, :]

    def linked(self, queries: np.ndarray, members: np.ndarray, same: bool, least: float, far: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) of at least the cosine; of the same set, each pair once."""
        for s in range(0, len(queries) if len(members) else 0, 512):
            q = queries[s : s + 512]
            near = self.candidates(q, members, far)
            if same:
                near &= q[:, None] < members[None, :]
            if 16 * np.count_nonzero(near) > near.size:  # so many that one product of matrices is less work
                p, r = np.nonzero(near & (self.x[q] @ self.x[members].T >= least))
                yield q[p], members[r]
                continue
            p, r = np.nonzero(near)
            p, r = q[p], members[r]
            for k in range(0, len(p), 1 << 16):
                u, v = p[k : k + (1 << 16)], r[k : k + (1 << 16)]
                hit = np.einsum("ij,ij->i", self.x[u], self.x[v]) >= least
                if hit.any():
                    yield u[hit], v[hit]


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, reach: float | None = None) -> DataFrame:
    """vectors: vec_id, embedding, label. vec_id, n_links, component_id and kept for each row.

    Rows are compared when their labels are equal and not null. Null, empty or zero vectors, null or
    non-finite components and null labels link with nothing; so do vectors of different lengths, and rows
    without a vec_id, whose component is null. Other rows of an equal vector are links, also those of an
    equal vec_id; different vectors of an equal vec_id share what they link with. An empty table gives an
    empty table; further columns are left out. Links across the borders of lists may be lost where they go in few
    directions and residuals in many; with reach = EXACT none is.
    """
    # components stay as narrow as they came; adding 0 makes a negative zero positive
    of = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast(of) + F.lit(0).cast(of)).alias("embedding"), "label")
    fits = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = [F.when(F.col("fits"), F.xxhash64(F.lit(s), "label", "embedding")).alias(f"k{s}") for s in (1, 2)]
    rows = vectors.withColumn("fits", fits)
    keys = cut(rows.select("vec_id", *key))
    classes = rows.where("fits").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    classes = cut(classes.select(F.xxhash64(F.lit(1), "label", "embedding").alias("k1"), F.xxhash64(F.lit(2), "label", "embedding").alias("k2"), "node", "n", "label", F.size("embedding").alias("dim"), "embedding"))
    found = cut(near_pairs(classes, fit(classes), least=least, reach=reach))
    roots = components(found.where("NOT is_count").select("a", "b"))
    counts = found.where("is_count").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    told = (
        classes.select("k1", "k2", "node", "n")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("component"))
    )
    component = F.coalesce("component", "vec_id")
    return keys.join(told, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )
