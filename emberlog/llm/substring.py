"""Near-duplicate passages by compact windows.

Two passages of at least 50 words whose sets of five-word shingles are similar by 0.8 share a run of at least
RUN shingles unchanged: at 46 shingles no more than 5 may be unmatched, one edit takes 4 at least, and longer
passages have longer runs. The Cartesian tree over the min-hashes of a text's shingles gives its compact windows: all
runs within a window that hold its minimum have that minimum. Of RUN shingles, ARM lie on one side of the minimum or
on the other, so a window's signatures are the hashes of these two arms: both texts have one of them, whatever stands
around the run. Equal arms agree under every hash function, so one tree does, and windows meet by an equi-join.

Windows of a signature meet the first of them, and the texts are verified where they line up. Where the parts of a
passage stand in other texts too, those may be the first ones. So windows that no verified passage covers go on with
all passages of least length around them: each has BANDS signatures, every one of the minima under TOGETHER hash functions, which
two passages similar by 0.8 share under some band but for one pair in 4,000 (each band with 0.8 ** TOGETHER), and the hash of all its
shingles. Minima from different parts of a passage tell it from texts that hold one part.

That second step may still leave passages out. So by default, instead of it, all windows of one signature are compared with each other,
unless a passage of a smaller text covers that of the larger one already and texts that are linked join both. No window is
given up for the number of others of its signature. Only pairs whose surroundings can be similar are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.shared import BLANK, bucketed, components, cut, discard, forget, n_words, small_batches

SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
#: Shingles of a passage of least length, of the run that similar passages share, and of the longer half of it.
WIDTH = PASSAGE - SHINGLE + 1
RUN, ARM = 21, 11
#: Signatures of a whole passage, and the hash functions whose minima make one.
BANDS, TOGETHER = 12, 3
#: Shingles by which single matches may lie off a passage's alignment, at least; longer passages may shift by a quarter.
GAP = 10
#: Shingles before and after the windows that met in which their passages are looked for; equal ones are followed beyond.
AROUND = 120
#: Longest run of shingles hashed in one piece; positions have 24 bits.
PIECE = 1 << 23

_U = np.uint64
_SEED = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as were ever needed."""

    up = _powers(_BASE, 1)
    down = up

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = _powers(_BASE, n + n // 2)
            cls.down = _powers(pow(_BASE, -1, 1 << 64), n + n // 2)
        return cls.up[:n], cls.down[:n]


def shingle_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each five successive words, A-Z lower-cased; empty for fewer words."""
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    up, down = _Powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw] + _U(1)) * up[:-1], out=sums[1:])
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < SHINGLE:
        return np.empty(0, dtype=np.uint64)
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    n = len(words) - SHINGLE + 1
    out = words[:n].copy()
    for j in range(1, SHINGLE):
        out = out * _U(_BASE) + words[j : j + n]
    return _mix(out)


def _minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of width keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First, minimum and last position of each compact window of at least width shingles, and its least hash.

    The minimum of a wide window is the minimum of some run of exactly width, so those runs give the nodes of
    the Cartesian tree; a smaller hash beyond such a run's reach is a node too, so a stack of nodes finds it.
    """
    mask = _U((1 << 24) - 1)
    keys = (_mix(hashes + _U(_SEED)) & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    least = _minima(keys, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    node = least[first]
    at = (node & mask).astype(np.int64)
    a, b = first.copy(), last + width - 1
    # where nothing smaller lies within reach, the window ends at the nearest smaller node or at the text's end
    left, right = np.full(len(at), 0), np.full(len(at), len(hashes) - 1)
    stack: list[int] = []
    values, places = node.tolist(), at.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    a = np.where(a == np.maximum(at - width + 1, 0), left, a)
    b = np.where(b == np.minimum(at + width - 1, len(hashes) - 1), right, b)
    return a, at, b, node


def _grams(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n shingles from each start."""
    out = hashes[start]
    for j in range(1, n):
        out = out * _U(_BASE) + hashes[start + j]
    return _mix(out)


def signatures(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first shingle of the arms of all windows of a text.

    An arm is given where some run of RUN shingles around the minimum reaches as far. Where a text repeats itself
    within RUN shingles, one place of an arm is given for each RUN of them: the verification looks further.
    """
    sigs, starts = [], []
    for base in range(0, max(1, len(hashes) - RUN + 1), PIECE):
        part = hashes[base : base + PIECE + RUN - 1]
        if len(part) < RUN:
            break
        a, c, b, _ = compact_windows(part, RUN)
        start = np.unique(np.concatenate([c[b - c >= ARM - 1], c[c - a >= ARM - 1] - ARM + 1]))
        sigs.append(_grams(part, start, ARM))
        starts.append(start + base)
    if not sigs:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    sig, start = np.concatenate(sigs).view(np.int64), np.concatenate(starts)
    order = np.lexsort((start, sig))
    sig, start = sig[order], start[order]
    again = (sig[1:] == sig[:-1]) & (start[1:] // RUN == start[:-1] // RUN)
    keep = np.append(True, ~again)
    return sig[keep], start[keep].astype(np.int32)


def windows(texts: DataFrame) -> DataFrame:
    """texts: tk, text. Rows tk, sig, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                rows.append(signatures(shingle_hashes(text)))
                keys.append(np.full(len(rows[-1][0]), key))
                held += len(keys[-1])
                if held > 1 << 17:
                    yield _rows(keys, *zip(*rows))
                    rows, keys, held = [], [], 0
            if held:
                yield _rows(keys, *zip(*rows))

    return small_batches(texts).select("tk", "text").mapInArrow(run, "tk long, sig long, at int")


def _rows(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["tk", "sig", "at"])


#: Texts of the sample that finds frequent signatures, about; texts of it that make one frequent; parts of a frequent one.
SAMPLE_TEXTS, FREQUENT, PARTS = 20_000, 10, 256


def frequent(texts: DataFrame, n_texts: int) -> DataFrame:
    """Signatures that about one of SAMPLE_TEXTS / FREQUENT texts or more hold, by a sample of the texts' hashes.

    There are at most as many as the sample has windows, by FREQUENT: they can be broadcast. They only say where
    work is split, so a signature that is missed costs time and no link.
    """
    share = min(1.0, SAMPLE_TEXTS / max(1, n_texts))
    sample = texts.where(F.pmod(F.xxhash64(F.lit(3), "tk"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return windows(sample).groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).select("sig", F.lit(True).alias("hot"))


def meet(found: DataFrame, hot: DataFrame) -> DataFrame:
    """found: tk, sig, at. Rows sig, lo, at_lo, hi, at_hi: each window but the first of its signature, with that.

    Links grow with the windows, not with their pairs. A frequent signature is dealt into parts; the firsts of
    its parts then meet the first of them. lo is the smaller key, or the same where a text holds a signature at several places.
    """
    part = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(5), "tk"), F.lit(PARTS))).otherwise(0)
    dealt = found.join(F.broadcast(hot), "sig", "left").withColumn("part", part)
    every = _with_first(dealt, "sig", "part")
    own = (F.col("lo") == F.col("tk")) & (F.col("at_lo") == F.col("at"))
    met = cut(every.where(~own | F.col("hot")).select("sig", "tk", "at", "lo", "at_lo"))
    heads = _with_first(met.where(own).select("sig", "tk", "at"), "sig")
    linked = cut(met.unionByName(heads).where(~own).select("sig", "lo", "at_lo", F.col("tk").alias("hi"), F.col("at").alias("at_hi")))
    discard(met)
    return linked


def _with_first(rows: DataFrame, *group: str) -> DataFrame:
    """rows (tk, at and others) with lo and at_lo, those of the group's first row."""
    up_to = Window.partitionBy(*group).orderBy("tk", "at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"lo": F.first("tk").over(up_to), "at_lo": F.first("at").over(up_to)})


def passage_signatures(hashes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the passages of WIDTH shingles from each start (ascending), and a shingle where each is.

    A run of starts whose minima under a band's functions stay the same, the meeting of their compact windows, gives one row.
    """
    mask, sigs, places = _U((1 << 24) - 1), [_grams(hashes, start, WIDTH)], [start]
    for run in np.split(start, np.flatnonzero(np.diff(start) > 1) + 1):
        part = hashes[run[0] : run[-1] + WIDTH]
        seeds = (np.arange(1, BANDS * TOGETHER + 1, dtype=np.uint64) * _U(_SEED))[:, None]
        least = _minima_of_each((_mix(part[None, :] ^ seeds) & ~mask) | np.arange(len(part), dtype=np.uint64), WIDTH)
        at = (least & mask).astype(np.int64).reshape(BANDS, TOGETHER, -1)
        new = np.ones(at.shape[::2], dtype=bool)
        new[:, 1:] = (at[:, :, 1:] != at[:, :, :-1]).any(axis=1)
        band, k = np.nonzero(new)
        sig = band.astype(np.uint64)
        for j in range(TOGETHER):
            sig = _mix(sig * _U(_BASE) + part[at[band, j, k]])
        sigs.append(sig)
        places.append(run[0] + at[band, 0, k])
    sig, place = np.concatenate(sigs).view(np.int64), np.concatenate(places)
    _, first = np.unique(sig, return_index=True)
    return sig[first], place[first].astype(np.int32)


def _minima_of_each(keys: np.ndarray, width: int) -> np.ndarray:
    """_minima() of every row."""
    n = keys.shape[1]
    padded = np.full((len(keys), -(-n // width) * width), np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:, :n] = keys
    rows = padded.reshape(len(keys), -1, width)
    ahead = np.minimum.accumulate(rows, axis=2).reshape(len(keys), -1)
    back = np.minimum.accumulate(rows[:, :, ::-1], axis=2)[:, :, ::-1].reshape(len(keys), -1)
    return np.minimum(back[:, : n - width + 1], ahead[:, width - 1 : n])


def whole_passages(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """rest: tk, sig, at; texts: tk, text. Rows tk, sig, at of all passages of least length around the windows, by passage_signatures()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, at in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                hashes = shingle_hashes(text)
                near = np.asarray(at.values) + np.arange(ARM - WIDTH, 1)[:, None]
                start = np.unique(near[(near >= 0) & (near <= len(hashes) - WIDTH)])
                if len(start):
                    sig, place = passage_signatures(hashes, start)
                    yield _rows([np.full(len(sig), key)], [sig], [place])

    by_text = rest.groupBy("tk").agg(F.collect_set("at").alias("at")).join(texts, "tk")
    return small_batches(by_text).select("tk", "text", "at").mapInArrow(run, "tk long, sig long, at int")


def _passages(hi: np.ndarray, lo: np.ndarray, meets: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (first and last shingle in hi, then in lo, similarity). meets: rows of at_lo, at_hi."""
    meets = meets[np.lexsort((meets[:, 1], meets[:, 1] - meets[:, 0]))]
    shift = meets[:, 1] - meets[:, 0]
    out: list[tuple[int, int, int, int, float]] = []
    again = _repeats(hi)
    # first the parts that line up, then what an insertion may hold apart: a quarter of a passage at most
    apart, done = np.abs(np.diff(meets[:, 1])) > 64 * PASSAGE, set()
    for limit in (GAP, max(GAP, min(len(hi), len(lo)) // 4)):
        far = np.flatnonzero((np.diff(shift) > limit) | apart) + 1
        for start, group in zip([0, *far.tolist()], np.split(meets, far)):
            if (start, len(group)) in done:
                continue
            done.add((start, len(group)))
            (y0, x0), (y1, x1) = np.maximum(group.min(0) - AROUND, 0).tolist(), (group.max(0) + ARM + AROUND).tolist()
            x, y = _matched(hi[x0:x1], lo[y0:y1], int(np.median(group[:, 1] - group[:, 0])) - x0 + y0)
            if len(x):
                out += _stretches(hi, lo, x0 + x, y0 + y)
                if again[x0 + x[-1] + 1] > again[x0 + x[0]] or not (y[1:] > y[:-1]).all() or len(np.unique(lo[y0 + y[0] : y0 + y[-1] + 1])) <= y[-1] - y[0]:
                    out += _verify(hi, lo, x0 + x, y0 + y, again)
    # where shingles repeat, windows that met line up in several ways: what is still open is looked at by itself
    seen, same = set(), None
    for y0, x0 in meets.tolist():
        if (x0 - y0, x0 // AROUND) not in seen and not any(s[0] <= x0 and x0 + ARM - 1 <= s[1] for s in out):
            seen.add((x0 - y0, x0 // AROUND))
            same = _repeats(lo) if same is None else same
            left, low, end = max(0, x0 - AROUND), max(0, y0 - AROUND), min(len(lo), y0 + ARM + AROUND)
            if same[end] > same[low]:
                x, y = _matched(hi[left : x0 + ARM + AROUND], lo[low:end], x0 - left - y0 + low)
                out += _verify(hi, lo, left + x, low + y, again) + _stretches(hi, lo, left + x, low + y)
    return _merged(out)


def _matched(part: np.ndarray, other: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of part that other holds, and where: of several places the one nearest to the position less the shift."""
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    left, right = np.searchsorted(ranked, part, "left"), np.searchsorted(ranked, part, "right")
    x = np.flatnonzero(right > left)
    left, right = left[x], right[x]
    y = order[left]
    many = np.flatnonzero(right - left > 1)
    if len(many):
        # the first place of each shingle stands for it, so one search finds shingle and place together
        span = len(other) + 1
        first = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), np.arange(len(ranked)), 0))
        want = np.clip(x[many] - shift, 0, len(other))
        at = np.clip(np.searchsorted(first * span + order, left[many] * span + want), left[many], right[many] - 1)
        before = np.maximum(at - 1, left[many])
        y[many] = np.where(np.abs(order[before] - want) <= np.abs(order[at] - want), order[before], order[at])
    return x, y


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """How many of the first n shingles stood in the text before, for each n from 0."""
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(hashes) + 1, dtype=np.int64)
    again[1 + order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    return np.cumsum(again)


def _verify(hi: np.ndarray, lo: np.ndarray, x: np.ndarray, y: np.ndarray, again: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """x: matched positions in hi, in order; y: where they stand in lo. Splits until it is similar.

    Gaps that are too wide for any passage of the run split it at once: their shingles alone, without those that
    came before, are more than a similar passage may hold unmatched. Then it is split at the widest gap.

    again: _repeats(hi). A passage's shingles are at least its length without those that came before, and what
    both texts share is at most what was matched; where that can't do, nothing is counted.
    """
    width = PASSAGE - SHINGLE + 1
    todo: list[tuple[np.ndarray, np.ndarray]] = [(x, y)]
    out: list[tuple[int, int, int, int, float]] = []
    while todo:
        p, q = todo.pop()
        if len(p) < SIMILAR * width or p[-1] - p[0] + 1 < width:
            continue
        own = again[p[1:]] - again[p[:-1] + 1]
        wide = np.flatnonzero(np.diff(p) - 1 - own > len(p) * (1 / SIMILAR - 1)) + 1
        if len(wide):
            todo += zip(np.split(p, wide), np.split(q, wide))
            continue
        like = 0.0
        if len(p) >= SIMILAR * (p[-1] - p[0] + 1 - again[p[-1] + 1] + again[p[0]]):
            mid = np.median(p - q)
            near = np.abs(p - q - mid) <= max(GAP, (p[-1] - p[0]) // 4)
            ends = q[near] if near.any() else q
            a, b = hi[p[0] : p[-1] + 1], lo[ends.min() : ends.max() + 1]
            both = len(np.intersect1d(a, b))
            like = both / max(1, len(np.unique(a)) + len(np.unique(b)) - both)
        if like >= SIMILAR and len(b) >= width:
            before, after = _same_ahead(hi[: p[0]][::-1], lo[: q[0]][::-1]), _same_ahead(hi[p[-1] + 1 :], lo[q[-1] + 1 :])
            out.append((int(p[0]) - before, int(p[-1]) + after, min(int(ends.min()), int(q[0]) - before), max(int(ends.max()), int(q[-1]) + after), like))
        elif len(p) > 1:
            # cut where matches are farthest apart, in either text; of equal places at the one nearest to the middle
            wide = np.maximum(np.diff(p), np.abs(np.diff(q)))
            places = np.flatnonzero(wide == wide.max())
            cut_at = int(places[np.abs(places - len(wide) // 2).argmin()]) + 1
            todo += [(p[:cut_at], q[:cut_at]), (p[cut_at:], q[cut_at:])]
    return out


def _dense_runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y: matched positions as in _verify(). Those that line up with a neighbour (all if in order), and first and last one of each run of them that is a passage
    by numbers and lies in no other one.

    With p and q shingles in the texts, m of them matched, the similarity is m / (p + q - m): 0.8 at least if 4 (p + q) <= 9 m. That is
    a difference of two values, one for each end, so the farthest end of each start is found by a search, and no run is missed by where a text is split.
    """
    if not (y[1:] > y[:-1]).all():
        line = np.abs(np.diff(x - y)) <= WIDTH // 2
        keep = np.append(line, False) | np.append(False, line)
        x, y = x[keep], y[keep]
    if len(x) < SIMILAR * WIDTH:
        return x, y, x[:0], x[:0]
    up = np.maximum.accumulate(y)
    value = 4 * (x + up) - 9 * np.arange(len(x))
    last = np.searchsorted(np.minimum.accumulate(value[::-1])[::-1], value + 1, "right") - 1
    first = np.flatnonzero((x[last] - x + 1 >= WIDTH) & (up[last] - up + 1 >= WIDTH))
    last = last[first]
    new = last > np.maximum.accumulate(np.append(-1, last))[:-1]
    return x, y, first[new], last[new]


def _likeness(hi: np.ndarray, lo: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """The similarity of the stretches of both texts that matched positions span; 0 if that of lo is too short."""
    a, b = np.unique(hi[x[0] : x[-1] + 1]), np.unique(lo[y.min() : y.max() + 1])
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if y.max() - y.min() + 1 >= WIDTH else 0.0


def _stretches(hi: np.ndarray, lo: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """As few of the passages of _dense_runs() as hold all windows that these hold, verified."""
    x, y, first, last = _dense_runs(x, y)
    out, k = [], 0
    while k < len(first):
        p, q = x[first[k] : last[k] + 1], y[first[k] : last[k] + 1]
        like = _likeness(hi, lo, p, q)
        if like >= SIMILAR:
            before, after = _same_ahead(hi[: p[0]][::-1], lo[: q[0]][::-1]), _same_ahead(hi[p[-1] + 1 :], lo[q[-1] + 1 :])
            out.append((int(p[0]) - before, int(p[-1]) + after, min(int(q.min()), int(q[0]) - before), max(int(q.max()), int(q[-1]) + after), like))
            k = max(k + 1, int(np.searchsorted(x[first], p[-1] - ARM + 2, "right")) - 1)
        else:
            k += 1
    return out


def _same_ahead(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles at the head of both are equal: a passage goes on beyond the windows that found it."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n]) if n and x[0] == y[0] else np.zeros(1, dtype=int)
    return int(differ[0]) if len(differ) else n


def _merged(spans: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Without spans that lie within another one."""
    out: list[tuple[int, int, int, int, float]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or s[1] > out[-1][1]:
            out.append(s)
    return out


#: Pairs of one text that a task verifies against one copy of it.
BLOCK = 64


def verified(links: DataFrame, texts: DataFrame) -> DataFrame:
    """links: lo, at_lo, hi, at_hi; texts: tk, text. Rows lo, hi, start, end, match_start, match_end (words), similarity.

    The smaller text travels once for each BLOCK of its partners.
    """
    pairs = cut(links.groupBy("lo", "hi").agg(F.collect_set(F.struct("at_lo", "at_hi")).alias("meets")))
    parts = pairs.groupBy("lo").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    several = parts.where("parts > 1")  # at most one for each BLOCK of pairs
    none = F.lit(None)
    schema = "array<struct<at_lo:int,at_hi:int>>"
    higher = (
        pairs.join(several, "lo", "left")
        .join(texts.withColumnRenamed("tk", "hi"), "hi")
        .select("lo", F.pmod(F.xxhash64("hi"), F.coalesce("parts", F.lit(1))).cast("int").alias("block"), "hi", "meets", "text")
    )
    lower = (
        parts.withColumnRenamed("lo", "tk")
        .join(texts, "tk")
        .select(F.col("tk").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), none.cast("long").alias("hi"), none.cast(schema).alias("meets"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, np.empty(0, dtype=np.uint64)  # the smaller text of the block
        for batch in batches:
            lo, block, hi = (batch.column(i).to_pylist() for i in range(3))
            text, meets, rows = batch.column(4).cast(pa.binary()), batch.column(3), []
            for i in range(batch.num_rows):
                hashes = shingle_hashes(text[i].as_py())
                if hi[i] is None:
                    of, held = (lo[i], block[i]), hashes
                elif of == (lo[i], block[i]):
                    at = np.stack([np.asarray(meets[i].values.field(j)) for j in range(2)], axis=1)
                    rows += [(lo[i], hi[i], a, b + SHINGLE, c, d + SHINGLE, s) for a, b, c, d, s in _passages(hashes, held, at)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lo", "hi", "start", "end", "match_start", "match_end", "similarity"])

    ordered = lower.unionByName(higher).repartition("lo", "block").sortWithinPartitions("lo", "block", F.col("hi").asc_nulls_first())
    return small_batches(ordered).mapInArrow(run, "lo long, hi long, start long, end long, match_start long, match_end long, similarity double")


def _uncovered(links: DataFrame, found: DataFrame) -> DataFrame:
    """tk, sig, at of the windows (hi, at_hi) that no passage found covers, where two texts at least have such a one."""
    spans = found.groupBy("hi").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = F.exists("spans", lambda s: (F.col("at_hi") >= s["start"]) & (F.col("at_hi") + ARM + SHINGLE - 1 <= s["end"]))
    rest = links.where("lo != hi").join(spans, "hi", "left").where(~F.coalesce(covered, F.lit(False))).select(F.col("hi").alias("tk"), "sig", F.col("at_hi").alias("at"))
    all_rest = cut(rest.distinct())
    out = cut(_shared(all_rest))
    discard(all_rest)
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """rows (tk, sig, at) of the signatures that two texts at least have."""
    more = rows.groupBy("sig").agg(F.min("tk").alias("least"), F.max("tk").alias("most")).where("least < most").select("sig")
    return rows.join(more, "sig", "left_semi")


def _frequent_here(rows: DataFrame) -> DataFrame:
    """The signatures of more than one in 10,000 rows, fewer than 10,000 of them: they can be broadcast."""
    most = max(64, rows.count() // 10_000)
    return rows.groupBy("sig").count().where(F.col("count") > most).select("sig", F.lit(True).alias("hot"))


#: Windows of one signature that a task compares with all others of it, about; shingles before and after a window that two of them are compared by.
DEALT, NEAR = 512, AROUND
#: Pairs of windows of a group up to which it is compared together with others; windows and others of a larger one that are compared at once; rows of a group that are held.
SMALL, HELD_ROWS, OTHER_ROWS, SLAB = 4096, 128, 64, 8192


def _places(links: DataFrame) -> DataFrame:
    """sig, tk, at of all windows of links."""
    lower = links.select("sig", F.col("lo").alias("tk"), F.col("at_lo").alias("at")).distinct()
    return links.select("sig", F.col("hi").alias("tk"), F.col("at_hi").alias("at")).union(lower).distinct()


def _apart(places: DataFrame, found: DataFrame) -> DataFrame:
    """places: sig, tk, at. These with alone, class, most, parts, of the signatures with pairs that are to be compared.

    A window is alone unless a passage that a text of smaller key holds covers it; its class is that of its text, the smallest one that passages lead to.
    Two windows are to be compared if the one of the larger key is alone, or their classes differ. most: neither is so for any two of
    those rows (of the class of most windows, and covered or of the smallest text); parts: how many parts the others are dealt into.
    """
    spans = found.groupBy(F.col("hi").alias("tk")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    roots = components(found, "lo", "hi").withColumnRenamed("node", "tk")
    covered = F.exists("spans", lambda s: (F.col("at") >= s["start"]) & (F.col("at") + ARM + SHINGLE - 1 <= s["end"]))
    alone = ~F.coalesce(covered, F.lit(False))
    placed = cut(places.join(roots, "tk", "left").join(spans, "tk", "left").select("sig", "tk", "at", alone.alias("alone"), F.coalesce("root", "tk").alias("class")))
    counted = placed.groupBy("sig", "class").agg(F.count("*").alias("n"), F.min("tk").alias("least"), F.max("tk").alias("last"))
    largest = counted.groupBy("sig").agg(F.max(F.struct("n", "class"))["class"].alias("largest"), F.min("least").alias("least"), F.max("last").alias("last"))
    most = (F.col("class") == F.col("largest")) & (~F.col("alone") | (F.col("tk") == F.col("least")))
    told = placed.join(largest.where("least < last"), "sig").select("sig", "tk", "at", "alone", "class", most.alias("most"))
    several = told.where("NOT most").groupBy("sig").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    out = cut(told.join(several, "sig"))
    discard(placed)
    return out


def _with_surroundings(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """apart: _apart(); texts: tk, text. apart with near, 32 bits of each shingle up to NEAR before and after, and more: places of the text with the same near, which have no row of their own."""
    kept = ["sig", "at", "alone", "class", "most", "parts"]
    names = ["tk", *kept, "near", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, held in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)):
                low = shingle_hashes(text).astype(np.uint32).view(np.int32)
                first: dict[tuple, tuple[dict, np.ndarray, list[int]]] = {}
                for row in sorted(held.as_py(), key=lambda r: r["at"]):
                    near = low[max(0, row["at"] - NEAR) : row["at"] + ARM + NEAR]
                    same = (row["sig"], row["alone"], row["most"], min(row["at"], NEAR), near.tobytes())
                    if same in first:
                        first[same][2].append(row["at"])
                    else:
                        first[same] = (row, near, [])
                rows = list(first.values())
                for i in range(0, len(rows), 1 << 11):
                    some = rows[i : i + (1 << 11)]
                    lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(r[1]) for r in some], dtype=np.int32), np.concatenate([r[1] for r in some]))
                    columns = [pa.array([r[0][c] for r in some], batch.column(2).type.value_type.field(c).type) for c in kept]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.int64()), *columns, lists, pa.array([r[2] for r in some], pa.list_(pa.int32()))], names=names)

    by_text = apart.groupBy("tk").agg(F.collect_list(F.struct(*kept)).alias("held")).join(texts, "tk")
    schema = "tk long, sig long, at int, alone boolean, class long, most boolean, parts int, near array<int>, more array<int>"
    return small_batches(by_text).select("tk", "text", "held").mapInArrow(run, schema)


class _Windows:
    """Windows of signatures: keys (tk, at, alone, class, most), shingles around each (the window stands at NEAR; -1 where there is none)."""

    def __init__(self, columns: list[np.ndarray], near: np.ndarray) -> None:
        self.tk, self.at, self.alone, self.kind, self.most = columns
        self.near = np.where(near < 0, (1 << 32) + np.arange(len(near))[:, None], near)
        order = np.argsort(self.near, axis=1, kind="stable")
        self.ranked = np.take_along_axis(self.near, order, axis=1)
        first = np.ones(near.shape, dtype=bool)
        first[:, 1:] = self.ranked[:, 1:] != self.ranked[:, :-1]
        #: whether a shingle is the first of its kind around the window, and how many of the first n differ from the one before
        self.first = np.empty_like(first)
        np.put_along_axis(self.first, order, first, axis=1)
        self.first |= near < 0
        new = self.near[:, 1:] != self.near[:, :-1]
        self.different = np.pad(np.cumsum(np.pad(new, ((0, 0), (1, 0)), constant_values=True), axis=1, dtype=np.int32), ((0, 0), (1, 0)))
        #: whether some shingle at the window repeats, so that it may stand for another place within RUN
        self.loose = ~self.first[:, NEAR - RUN : NEAR + ARM + RUN].all(axis=1)

    def held(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of windows, which shingles around the first ones the second ones have, and the other way round."""
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        x, y = at[: len(i), None], at[len(i) :, None]
        if len(i) > 2 * len(rows):  # many pairs of few windows: a table of who has what
            values, place = np.unique(self.near[rows], return_inverse=True)
            place = place.reshape(len(rows), -1)
            has = np.zeros((len(rows), len(values)), dtype=bool)
            np.put_along_axis(has, place, True, axis=1)
            return has[y, place[x[:, 0]]], has[x, place[y[:, 0]]]
        ranked = (self.ranked[rows] + (np.arange(len(rows)) << 34)[:, None]).ravel()
        found = lambda of, by: ranked[np.minimum(np.searchsorted(ranked, want := self.near[of] + (by << 34)), len(ranked) - 1)] == want
        return found(i, y), found(j, x)

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of windows may hold a passage."""
        middle = slice(NEAR + ARM - RUN, NEAR + RUN)
        run, side = self.near[i, middle] == self.near[j, middle], RUN - ARM  # around the windows, themselves in the middle
        loose = self.loose[i] | self.loose[j] | ~run[:, side : side + ARM].all(axis=1)
        some = np.flatnonzero(loose | (run[:, RUN:].cumprod(axis=1).sum(axis=1) + run[:, side - 1 :: -1].cumprod(axis=1).sum(axis=1) + ARM >= RUN))
        fit = np.zeros(len(i), dtype=bool)
        for k in range(0, len(some), 1024):
            part = some[k : k + 1024]
            mine, other = self.held(i[part], j[part])
            lacks, near = self.lacks(mine, i[part], loose[part])
            more, also = self.lacks(other, j[part], loose[part])
            fit[part] = near & also & (lacks + more <= 2)
        return fit

    def lacks(self, held: np.ndarray, rows: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """held: which shingles around the window the other has. For the best WIDTH successive ones or more that the window is among (loose: or not), nine times
        those that lack less all, and whether some such ones lack a fifth at most. Repeats count once: at most those that differ from the one before are different, and one."""
        n = held.shape[1]
        span = n - held[:, ::-1].argmax(axis=1) - held.argmax(axis=1) >= WIDTH
        lacks = np.zeros((len(held), n + 1), dtype=np.int32)
        np.cumsum(self.first[rows] & ~held, axis=1, out=lacks[:, 1:], dtype=np.int32)
        of_all = self.different[rows]
        most = lambda over: np.maximum.accumulate(over[:, : n - WIDTH + 1], axis=1)
        over = 5 * lacks - of_all
        fifth = span & (over[:, WIDTH:] <= most(over) + 1).any(axis=1)
        over = 9 * lacks - of_all
        before, ends = most(over), np.arange(NEAR + ARM, n + 1)
        best = (over[:, ends] - before[:, np.minimum(NEAR, ends - WIDTH)]).min(axis=1)
        return np.where(loose, (over[:, WIDTH:] - before).min(axis=1), best), fifth

    def hold(self, hi: int, lo: int) -> bool:
        """Whether a passage that is verified by the shingles around them holds both windows."""
        x, y, first, last = _dense_runs(*_matched(self.near[hi], self.near[lo], 0))
        for k in np.flatnonzero((x[first] <= NEAR) & (x[last] >= NEAR + ARM - 1)):
            p, q = x[first[k] : last[k] + 1], y[first[k] : last[k] + 1]
            if q.min() <= NEAR <= q.max() - ARM + 1 and _likeness(self.near[hi], self.near[lo], p, q) >= SIMILAR:
                return True
        return False


def _around(lists: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """The shingles of each list, the window at NEAR; -1 where the text has ended."""
    width, n = 2 * NEAR + ARM, np.diff(lists.offsets.to_numpy())[:, None]
    column = np.arange(width) - np.maximum(0, NEAR - at)[:, None]
    out = np.full((len(lists), width), -1, dtype=np.int64)
    out[(column >= 0) & (column < n)] = lists.flatten().to_numpy().view(np.uint32)
    return out


class _Groups:
    """Whole groups of windows, each sorted: those that are compared with all others (mine), then the others.

    Without once, link() gives all pairs that are to be compared (see _apart()) and fit. With it a window is alone no more, and two classes are one,
    as soon as a passage around both windows is verified: these pairs, a forest, are linked, and of those that fit and aren't verified
    the ones that are still to be compared at the end.
    """

    def __init__(self, group: np.ndarray, mine: np.ndarray, keys: list[np.ndarray], near: np.ndarray, once: bool) -> None:
        self.group, self.mine, self.w, self.once = group, mine, _Windows(keys, near), once
        self.alone, self.kind = self.w.alone.copy(), self.w.kind.copy()

    def link(self) -> tuple[np.ndarray, np.ndarray]:
        linked, rest, pool = [], [], []
        edges = np.flatnonzero(np.diff(self.group)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(self.group)]):
            others = start + int(self.mine[start:end].sum())
            if (others - start) * (end - others) <= SMALL:
                pool.append((np.repeat(np.arange(start, others), end - others), np.tile(np.arange(others, end), others - start)))
                continue
            for k in range(others, end, OTHER_ROWS):
                for m in range(start, others, HELD_ROWS):
                    i, j = np.arange(m, min(m + HELD_ROWS, others)), np.arange(k, min(k + OTHER_ROWS, end))
                    self._compare(np.repeat(i, len(j)), np.tile(j, len(i)), linked, rest)
        if pool:
            self._compare(*(np.concatenate(c) for c in zip(*pool)), linked, rest)
        linked += [(h, lo) for h, lo in rest if self._needed(h, lo)]
        hi, lo = np.array(linked, dtype=np.int64).reshape(-1, 2).T
        return hi, lo

    def _needed(self, hi: int, lo: int) -> bool:
        return self.alone[hi] or self.kind[hi] != self.kind[lo]

    def _compare(self, i: np.ndarray, j: np.ndarray, linked: list[tuple[int, int]], rest: list[tuple[int, int]]) -> None:
        w = self.w
        up = w.tk[i] > w.tk[j]
        hi, lo = np.where(up, i, j), np.where(up, j, i)
        # of two that aren't most, the one of the larger key is in i once
        open_ = np.flatnonzero((w.tk[i] != w.tk[j]) & (up | w.most[j]) & (self.alone[hi] | (self.kind[hi] != self.kind[lo])))
        open_ = open_[w.fit(i[open_], j[open_])]
        hi, lo = hi[open_], lo[open_]
        order = np.lexsort((w.tk[lo], hi))
        for h, other in zip(hi[order].tolist(), lo[order].tolist()):
            if not self.once:
                linked.append((h, other))
            elif self._needed(h, other):
                if w.hold(h, other):
                    linked.append((h, other))
                    self.alone[h] = False
                    kind = self.kind[h], self.kind[other]
                    if kind[0] != kind[1]:
                        self.kind[(self.group == self.group[h]) & (self.kind == max(kind))] = min(kind)
                else:
                    rest.append((h, other))


def meet_all(apart: DataFrame, others: DataFrame, once: bool = False) -> DataFrame:
    """apart: _with_surroundings(); others: rows of it. Rows lo, at_lo, hi, at_hi: pairs of windows of apart and others, of one signature, that are to be compared (see _apart()), if a passage can hold both.

    Similar passages lack, both together, a ninth of their shingles at most, so a fifth of either. So does some part of a longer one, of WIDTH to
    115 successive shingles, and an edit leaves four shingles or more unmatched, so that part holds a common run of RUN. Pairs without such
    stretches around the windows hold no passage there.

    One of each pair isn't most: these windows, dealt into parts, meet all others, and a large class doesn't meet itself. Each pair comes once.
    With once, the pairs grow with the windows and not with their square where passages are verified by the shingles around: see _Groups.
    """
    columns = ["sig", "part", "held", "tk", "at", "alone", "class", "most", "near"]
    part = F.pmod(F.xxhash64(F.lit(7), "tk", "at"), F.col("parts")).cast("int")
    some = apart.where("NOT most").withColumns({"part": part, "held": F.lit(True)}).select(columns)
    every = others.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "held": F.lit(False)}).select(columns)
    ordered = some.unionByName(every).repartition("sig", "part").sortWithinPartitions("sig", "part", F.col("held").desc(), "tk", "at")

    def linked(rows: pa.Table) -> tuple[_Groups, list[pa.RecordBatch]]:
        keys = [rows[k].to_numpy() for k in columns[:8]]
        new = np.append(False, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))
        groups = _Groups(np.cumsum(new), keys[2], keys[3:], _around(rows["near"].combine_chunks(), keys[4]), once)
        hi, lo = groups.link()
        w = groups.w
        out = [w.tk[lo], w.at[lo], w.tk[hi], w.at[hi]]
        return groups, [pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["lo", "at_lo", "hi", "at_hi"])] if len(hi) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, rows]) if rest is not None else rows
            sig, number = rest["sig"].to_numpy(), rest["part"].to_numpy()
            last = int(np.searchsorted((sig == sig[-1]) & (number == number[-1]), True)) if len(sig) else 0
            if last:
                yield from linked(rest.slice(0, last))[1]
                rest = rest.slice(last)
            if rest.num_rows > SLAB:  # the windows that are compared with all stay, as what they are now
                groups, out = linked(rest)
                yield from out
                told = {"alone": groups.alone, "class": groups.kind}
                for name, values in told.items():
                    k = rest.schema.get_field_index(name)
                    rest = rest.set_column(k, rest.schema.field(k), pa.array(values))
                rest = rest.filter(pa.array(groups.mine))
        if rest is not None and rest.num_rows:
            yield from linked(rest)[1]

    return small_batches(ordered).mapInArrow(run, "lo long, at_lo int, hi long, at_hi int")


def text_key(docs: DataFrame) -> Column:
    """64 bits of a text that tell all texts of docs apart: where two different ones share theirs (one pair at 6 billion texts, about), another hash."""
    key, other = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    seen = docs.where("text IS NOT NULL").select(key.alias("tk"), other.alias("other")).groupBy("tk").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    shared = [r.tk for r in seen.where("least < most").select("tk").collect()]
    return F.when(key.isin(shared), other).otherwise(key) if shared else key


def passages_of_texts(docs: DataFrame, key: Column, *, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """The passages of all distinct texts (verified()), and the texts (tk, rep, copies, n): rep is the smallest doc_id, n the words of those that come again.

    Each window is compared with the first of its signature. Then all windows of a signature are compared with each other, but for pairs
    whose larger text has its window covered already by a passage of a smaller text, if both texts are of one class: no passage is left
    uncovered in the larger text of a similar pair, and no two classes unlinked, because others came first. A window goes on to verification with the
    first other that holds it in a passage; with all that may only where none does (see _Groups). Without exact, only the whole passages around windows that are not covered are compared,
    each with the first of each of its signatures.

    Distinct texts are dealt out by key once; what needs some of them comes to where they are.
    """
    distinct = docs.where("text IS NOT NULL").select("doc_id", "text", key.alias("tk")).groupBy("tk").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("text").alias("text"))
    texts = bucketed(distinct.withColumn("n", F.when(F.col("copies") > 1, n_words("text"))), "tk")

    def of(needed: DataFrame) -> DataFrame:
        return texts.select("tk", "text").join(needed.hint("shuffle_hash"), "tk", "left_semi")

    def verify(links: DataFrame) -> DataFrame:
        links = links.where("lo != hi")
        whole = cut(of(links.select(F.col("lo").alias("tk")).union(links.select("hi")).distinct()))
        out = cut(verified(links, whole))
        discard(whole)
        return out

    links = meet(windows(texts), frequent(texts, texts.count()))
    found = verify(links)
    if exact:
        places = cut(_places(links))
        apart = _apart(places, found)
        discard(places)
        if not apart.isEmpty():
            near = cut(_with_surroundings(apart, of(apart.select("tk").distinct())))
            more = near.where(F.size("more") > 0).groupBy(F.col("tk").alias("hi"), F.col("at").alias("at_hi")).agg(F.flatten(F.collect_set("more")).alias("more"))
            all_at = F.concat(F.array("at_hi"), F.coalesce("more", F.array().cast("array<int>")))
            met = meet_all(near, near, once=True).join(more, ["hi", "at_hi"], "left").select("lo", "at_lo", "hi", F.explode(all_at).alias("at_hi"))
            tried = ["lo", "at_lo", "hi", "at_hi"]
            again = cut(met.distinct().join(links.select(tried), tried, "left_anti"))
            found = found.unionByName(verify(again)).distinct()
            discard(near)
            discard(again)
        discard(apart)
    else:
        rest = _uncovered(links, found)
        if not rest.isEmpty():
            whole = cut(_shared(whole_passages(rest, of(rest.select("tk").distinct()))))
            again = meet(whole, _frequent_here(whole))
            found = found.unionByName(verify(again))
            discard(whole)
            discard(again)
        discard(rest)
    discard(links)
    told = cut(texts.select("tk", "rep", "copies", "n"))
    forget(texts)
    return found, told


def repeated_passages(docs: DataFrame, *, exact: bool = True) -> DataFrame:
    """docs: doc_id, text. A row for each passage of at least 50 words that a text of smaller key holds too.

    doc_id, start_word, end_word (exclusive), match_doc_id, match_start, match_end, similarity (of the sets of
    five-word shingles, 0.8 at least). Equal texts are one text, that of the smallest doc_id: every other copy
    of at least 50 words has one row, over all its words. Every passage that repeats, with edits or without, is covered by rows
    (see passages_of_texts(); with exact=False one with edits may stay if its windows, and all signatures of its passages,
    met other texts first). Null, empty and shorter texts have no rows; a text without any doc_id is compared as others are
    and named by null, and rows without a doc_id come last among copies. Other columns are left out.
    """
    key = text_key(docs)
    found, texts = passages_of_texts(docs, key, exact=exact)
    name = lambda k, to: texts.select(F.col("tk").alias(k), F.col("rep").alias(to))
    rows = (
        found.join(name("hi", "doc_id"), "hi")
        .join(name("lo", "match_doc_id"), "lo")
        .select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "match_doc_id", "match_start", "match_end", "similarity")
    )
    zero = F.lit(0).cast("long")
    copies = (
        docs.where("text IS NOT NULL").select("doc_id", key.alias("tk"))
        .join(texts.where(F.col("n") >= PASSAGE), "tk")
        .where(~F.col("doc_id").eqNullSafe(F.col("rep")))
        .select("doc_id", zero.alias("start_word"), F.col("n").alias("end_word"), F.col("rep").alias("match_doc_id"), zero.alias("match_start"), F.col("n").alias("match_end"), F.lit(1.0).alias("similarity"))
    )
    return rows.unionByName(copies)


def without_passages(docs: DataFrame, *, exact: bool = True) -> DataFrame:
    """docs without the passages that another text keeps, and without further rows of a text of at least 50 words.

    Of equal texts the row of the smallest doc_id stays (nulls last, then by all columns). A document of which no word
    is left goes. What is left keeps its own white space; documents without passages stay as they are, and so do
    null, empty and shorter texts, all of their rows. Passages belong to texts: doc_id may be null or repeat.
    """
    key = text_key(docs)
    found, texts = passages_of_texts(docs, key, exact=exact)
    spans = found.groupBy(F.col("hi").alias("__tk")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    told = texts.select(F.col("tk").alias("__tk"), (F.col("n") >= PASSAGE).alias("__several")).where("__several").join(spans, "__tk", "full")
    told = cut(told)  # a row for each text that is changed or comes again: if that may be broadcast, no text moves
    pieces = F.split("text", rf"(?<=[^{BLANK}])(?=[{BLANK}])")
    inside = lambda i: F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    left = F.filter(F.transform(pieces, lambda w, i: F.when(~inside(i), w)), lambda w: w.isNotNull())
    marked = docs.withColumn("__tk", F.when(F.col("text").isNotNull(), key)).join(told, "__tk", "left")
    first = Window.partitionBy("__tk").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in docs.columns if c not in ("doc_id", "text")])
    copies = marked.where("__several").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return (
        marked.where("__several IS NULL").unionByName(copies)
        .withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(left, "")))
        .where(F.col("__spans").isNull() | F.col("text").rlike(rf"[^{BLANK}]"))
        .select(*docs.columns)
    )
