"""Media columns as progressive JPEG.

A payload is stored as the quantised coefficients of a 4:2:0 image, so it comes back to the byte: first scans
hold the coefficients' upper bits (the DC of all components, then bands of AC), later ones the last bit of
each. Reading accumulates the scans into coefficient arrays, transforms them back in numpy, upsamples the
chroma and gives a full-resolution RGB tensor.

Both Huffman tables of the writer give a code and its value bits eight bits together, so a scan of bytes is
written and read by table look-up. The reader takes any progressive JPEG of 8-bit samples and up to three
components: runs of codes of one total length are looked up at once, all others one by one.
"""

from __future__ import annotations

import functools
import math
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import small_batches

#: Payloads are filled up with blanks to a multiple of this: one block for each component.
UNIT, BLANK = 192, 32
#: Bytes of results after which a task hands a batch on.
HAND_ON = 8 << 20

#: Fixed by the format: in which row-major place of a block the k-th coefficient of the scans stands.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
_BITS = 13


def _basis() -> np.ndarray:
    """Row k: the block of samples of coefficient k of the scans, in 1 / 2**13. Whole numbers, so sums are exact."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, math.sqrt(0.5), 1) / 2
    return np.rint(np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)[ZIGZAG] * (1 << _BITS))


_BASIS = _basis()


# ---------------------------------------------------------------------------------------------- writing


def _word(value: np.ndarray) -> np.ndarray:
    """Eight bits for values of up to seven bits: ones, a zero, then the value's own bits."""
    size = np.ceil(np.log2(np.abs(value) + 1)).astype(int)
    own = np.where(value < 0, value + (1 << size) - 1, value)
    return ((0xFF << (size + 1)) & 0xFF | own).astype(np.uint8)


_BYTE = np.arange(256)
#: The DC value of a byte, and its AC value, which is never -1, 0 or 1: all but its last bit isn't zero.
_DC, _AC = _BYTE - 128, np.where(_BYTE < 128, _BYTE - 129, _BYTE - 126)
_DC_WORD = _word(np.arange(-127, 128))
_AC_WORD, _AC_LAST = _word(np.sign(_AC) * (np.abs(_AC) >> 1)), (np.abs(_AC) & 1).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes, ac_table: int = 0) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, ac_table]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\0")


def _packed(*bits: np.ndarray) -> bytes:
    """Bits as bytes, filled up with ones."""
    bits = np.concatenate(bits)
    return np.packbits(np.append(bits, np.ones(-len(bits) % 8, dtype=np.uint8))).tobytes()


#: Huffman tables: DC sizes 7 to 0 and AC sizes 7 to 1 with codes of one bit and up; runs of ended blocks with four bits.
_TABLES = _segment(0xC4, bytes([0x00, *[1] * 8, *[0] * 8, *range(7, -1, -1)]) + bytes([0x10, *[1] * 7, *[0] * 9, *range(7, 0, -1)]) + bytes([0x11, 0, 0, 0, 15, *[0] * 12, *range(0, 0xF0, 0x10)]))
_QUANT = _segment(0xDB, bytes([0, *[1] * 64]))


def _grid(mcus: int) -> tuple[int, int]:
    """Rows and columns that hold so many squares of 16 by 16, with little waste."""
    least, root = -(-mcus // 4095), math.isqrt(mcus)
    cols = min(range(max(1, least, root - 32), max(root, least) + 1), key=lambda c: (-mcus % c, -c))
    return -(-mcus // cols), cols


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, of a positive multiple of 192 bytes."""
    rows, cols = _grid(-(-len(payload) // (6 * 64)))
    n = rows * cols
    p = np.full(n * 6 * 64, BLANK, dtype=np.uint8)
    p[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    p = p.reshape(-1, 64)
    dc = _DC[p[:, 0]]
    in_order = np.empty((n, 6), dtype=dc.dtype)
    in_order[:, :4] = dc[: 4 * n].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    in_order[:, 4], in_order[:, 5] = dc[4 * n : 5 * n], dc[5 * n :]
    half = in_order >> 1
    steps = np.empty((n, 6), dtype=dc.dtype)
    steps[:, :4] = np.diff(half[:, :4].ravel(), prepend=0).reshape(n, 4)
    steps[:, 4:] = np.diff(half[:, 4:], axis=0, prepend=0)
    planes = [p[: 4 * n], p[4 * n : 5 * n], p[5 * n :]]
    frame = struct.pack(">BHHB", 8, 16 * rows, 16 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _QUANT, _segment(0xC2, frame), _TABLES]
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, _DC_WORD[steps + 127].tobytes()))
    for c, first, last in ((1, 1, 5), (2, 1, 63), (3, 1, 63), (1, 6, 63)):
        out.append(_scan([c], first, last, 0, 1, _AC_WORD[planes[c - 1][:, first : last + 1]].tobytes()))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, _packed((in_order & 1).astype(np.uint8).ravel())))
    for c, plane in enumerate(planes, 1):
        bits = []
        for start in range(0, len(plane), 32767):
            part = plane[start : start + 32767, 1:]
            size = len(part).bit_length() - 1
            head = f"{size:04b}" + (f"{len(part) - (1 << size):0{size}b}" if size else "")
            bits += [np.array([*head], dtype=np.uint8), _AC_LAST[part].ravel()]
        out.append(_scan([c], 1, 63, 1, 0, _packed(*bits), 1))
    return b"".join(out) + b"\xff\xd9"


# ---------------------------------------------------------------------------------------------- reading


class _Table:
    """A Huffman table: length and symbol of the code at the head of any 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
        at, k = 0, 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                end = at + (1 << (16 - size))
                self.length[at:end], self.symbol[at:end] = size, symbols[k]
                at, k = end, k + 1
        self.words: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def whole(self, total: int, ac: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each word of so many bits: whether it is a code with its value bits, without a run, and the value."""
        if (total, ac) not in self.words:
            word = np.arange(1 << total)
            length, symbol = self.length[word << (16 - total)].astype(int), self.symbol[word << (16 - total)].astype(int)
            fits = (length > 0) & (length + symbol == total) & (symbol <= total) & (~np.bool_(ac) | (symbol > 0))
            size = np.where(fits, symbol, 0)
            own = word & ((1 << size) - 1)
            self.words[total, ac] = fits, np.where(own < (1 << size) >> 1, own - (1 << size) + 1, own)
        return self.words[total, ac]


@functools.lru_cache(64)
def _tables(body: bytes) -> dict[int, _Table]:
    out, at = {}, 0
    while at < len(body):
        n = sum(body[at + 1 : at + 17])
        out[body[at]] = _Table(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
        at += 17 + n
    return out


class _Bits:
    """The bits of a stretch of coded data."""

    def __init__(self, data: bytes):
        self.raw = data.replace(b"\xff\0", b"\xff")
        self.padded, self.end, self.at = self.raw + bytes(8), 8 * len(self.raw), 0

    def peek(self, n: int) -> int:
        byte, bit = divmod(self.at, 8)
        return int.from_bytes(self.padded[byte : byte + 5], "big") >> (40 - bit - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        out = self.peek(n)
        self.skip(n)
        return out

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("coded data ends too early")

    def many(self, n: int) -> np.ndarray:
        """The next n bits, one in each element."""
        byte, bit = divmod(self.at, 8)
        self.skip(n)
        return np.unpackbits(np.frombuffer(self.raw, np.uint8)[byte : byte + (bit + n + 7) // 8])[bit : bit + n]

    def symbol(self, table: _Table) -> int:
        word = self.peek(16)
        if not table.length[word]:
            raise ValueError("no such code")
        self.skip(int(table.length[word]))
        return int(table.symbol[word])

    def value(self, size: int) -> int:
        own = self.take(size) if size else 0
        return own if not size or own >> (size - 1) else own - (1 << size) + 1

    def run(self, table: _Table, most: int, ac: bool) -> np.ndarray:
        """The values of the next codes that have, with their value bits, one length together; none if the next has a run."""
        word = self.peek(16)
        total = int(table.length[word]) + int(table.symbol[word])
        parts, chunk = [], 256
        if not table.length[word] or total > 16:
            return np.empty(0, dtype=int)
        fits, values = table.whole(total, ac)
        while most and (n := min(most, chunk, (self.end - self.at) // total)):
            byte, bit = divmod(self.at, 8)
            if total == 8 and not bit:
                words = np.frombuffer(self.raw, np.uint8, n, byte)
            else:
                bits = np.unpackbits(np.frombuffer(self.raw, np.uint8)[byte : byte + (bit + n * total + 7) // 8])[bit : bit + n * total]
                words = bits.reshape(n, total) @ (1 << np.arange(total - 1, -1, -1))
            ok = fits[words]
            good = n if ok.all() else int(ok.argmin())
            parts.append(values[words[:good]])
            self.at += good * total
            most -= good
            if good < n:
                break
            chunk *= 8
        return np.concatenate(parts) if parts else np.empty(0, dtype=int)


@dataclass
class Component:
    across: int
    down: int
    quant: int
    base: int = 0  # its first block among all
    cols: int = 0  # blocks in the padded grid
    rows: int = 0
    own_cols: int = 0  # blocks that the component needs
    own_rows: int = 0


@dataclass
class Image:
    """Coefficients of all blocks in the order of the scans, one component after another, as they were quantised."""

    width: int
    height: int
    components: list[Component]
    coefficients: np.ndarray
    quant: dict[int, np.ndarray]
    comments: list[bytes]

    def rgb(self) -> np.ndarray:
        """The tensor (height, width, 3) of 8-bit samples."""
        most_across, most_down = max(c.across for c in self.components), max(c.down for c in self.components)
        planes = []
        for c in self.components:
            blocks = self.coefficients[c.base : c.base + c.rows * c.cols] * self.quant[c.quant]
            samples = np.floor((blocks.astype(np.float64) @ _BASIS + (1 << (_BITS - 1))) * 0.5**_BITS) + 128
            samples = np.clip(samples, 0, 255, out=samples).astype(np.uint8)
            planes.append(samples.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8))
        grow = lambda x, c: x.repeat(most_down // c.down, 0).repeat(most_across // c.across, 1)[: self.height, : self.width]
        y = grow(planes[0], self.components[0]).astype(np.int16)
        if len(planes) == 1:
            return np.repeat(y.astype(np.uint8)[:, :, None], 3, axis=2)
        # what the chroma adds is found at its own resolution, then repeated
        cb, cr = planes[1], planes[2]
        if self.components[1] != self.components[2] and cb.shape != cr.shape:
            raise ValueError("chroma planes of different sizes")
        out = np.empty((self.height, self.width, 3), dtype=np.uint8)
        for k, add in enumerate((_CR_RED[cr], _CB_GREEN[cb] + _CR_GREEN[cr], _CB_BLUE[cb])):
            channel = y + grow(add, self.components[1])
            out[:, :, k] = np.clip(channel, 0, 255, out=channel)
        return out


_CHROMA = np.arange(256) - 128
_CR_RED, _CB_BLUE = np.rint(1.402 * _CHROMA).astype(np.int16), np.rint(1.772 * _CHROMA).astype(np.int16)
_CR_GREEN, _CB_GREEN = np.rint(-0.714136 * _CHROMA).astype(np.int16), np.rint(-0.344136 * _CHROMA).astype(np.int16)
_SCAN_END, _RESTART = re.compile(rb"\xff(?![\x00\xd0-\xd7])"), re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Image:
    """The coefficients of a progressive JPEG, all its scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, ids, tables, quant, comments, restart, at = None, {}, {}, {}, [], 0, 2
    while at + 4 <= len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        if marker in (0xFF, 0xD9):
            if marker == 0xD9:
                break
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            tables |= _tables(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            image, ids = _frame(body, quant, comments)
        elif marker == 0xDA:
            end = _SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            _read_scan(image, ids, body, tables, restart, data[at:stop])
            at = stop
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xD0)):
            raise ValueError("only progressive frames are read")
    if image is None:
        raise ValueError("no frame")
    return image


def _frame(body: bytes, quant: dict, comments: list) -> tuple[Image, dict[int, Component]]:
    depth, height, width, n = struct.unpack(">BHHB", body[:6])
    if depth != 8 or n not in (1, 3) or not height or not width:
        raise ValueError("only 8-bit samples of one or three components are read")
    ids = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
    across, down, base = max(c.across for c in ids.values()), max(c.down for c in ids.values()), 0
    for c in ids.values():
        c.cols, c.rows = -(-width // (8 * across)) * c.across, -(-height // (8 * down)) * c.down
        c.own_cols, c.own_rows = -(-(-(-width * c.across // across)) // 8), -(-(-(-height * c.down // down)) // 8)
        c.base, base = base, base + c.cols * c.rows
    return Image(width, height, list(ids.values()), np.zeros((base, 64), dtype=np.int32), quant, comments), ids


def _blocks(components: list[Component]) -> tuple[np.ndarray, int, np.ndarray]:
    """The blocks of a scan in coded order, how many make a unit of restarts, and the component of each."""
    if len(components) == 1:
        c = components[0]
        blocks = (c.base + np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)).ravel()
        return blocks, 1, np.zeros(len(blocks), dtype=int)
    parts, which = [], []
    for i, c in enumerate(components):
        grid = c.base + np.arange(c.rows * c.cols).reshape(c.rows // c.down, c.down, c.cols // c.across, c.across)
        parts.append(grid.transpose(0, 2, 1, 3).reshape(-1, c.down * c.across))
        which += [i] * (c.down * c.across)
    blocks = np.concatenate(parts, axis=1)
    return blocks.ravel(), blocks.shape[1], np.tile(which, len(blocks))


def _read_scan(image: Image, ids: dict[int, Component], head: bytes, tables: dict[int, _Table], restart: int, data: bytes) -> None:
    n = head[0]
    first, last, bits = head[1 + 2 * n : 4 + 2 * n]
    high, low = bits >> 4, bits & 15
    blocks, unit, which = _blocks([ids[head[1 + 2 * i]] for i in range(n)])
    stretches = _RESTART.split(data) if restart else [data]
    step = restart * unit or len(blocks)
    for k, stretch in enumerate(stretches):
        own, bits = blocks[k * step : (k + 1) * step], _Bits(stretch)
        if not len(own):
            break
        if not first and high:
            image.coefficients[own, 0] |= bits.many(len(own)).astype(np.int32) << low
        elif not first:
            dc_tables = [tables[head[2 + 2 * i] >> 4] for i in range(n)]
            steps, of = _dc_steps(bits, dc_tables, which[k * step : (k + 1) * step]), which[k * step : (k + 1) * step]
            for i in range(n):
                image.coefficients[own[of == i], 0] = np.cumsum(steps[of == i]) << low
        else:
            table = tables[0x10 | head[2] & 15]
            band = image.coefficients[own, first : last + 1].ravel()
            (_ac_refine if high else _ac_first)(bits, table, band, last - first + 1, low)
            image.coefficients[own, first : last + 1] = band.reshape(len(own), -1)


def _dc_steps(bits: _Bits, tables: list[_Table], of: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(of), dtype=np.int32), 0
    while at < len(out):
        if all(t is tables[0] for t in tables) and len(run := bits.run(tables[0], len(out) - at, False)):
            out[at : at + len(run)] = run
            at += len(run)
        else:
            out[at] = bits.value(bits.symbol(tables[of[at]]))
            at += 1
    return out


def _ac_first(bits: _Bits, table: _Table, band: np.ndarray, width: int, low: int) -> None:
    """band: the coefficients of all blocks, one after another; without runs of zeros it is filled straight on."""
    at = 0
    while at < len(band):
        run = bits.run(table, len(band) - at, True)
        if len(run):
            band[at : at + len(run)] = run << low
            at += len(run)
            continue
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            at += zeros
            if at >= len(band):
                raise ValueError("a run leaves the image")
            band[at] = bits.value(size) << low
            at += 1
        elif zeros == 15:
            at += 16
        else:
            at = (at // width + (1 << zeros) + (bits.take(zeros) if zeros else 0)) * width


def _ac_refine(bits: _Bits, table: _Table, band: np.ndarray, width: int, low: int) -> None:
    def mend(places: np.ndarray) -> None:
        band[places] += np.sign(band[places]) * (bits.many(len(places)).astype(np.int32) << low)

    at = 0
    while at < len(band):
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if not size and zeros < 15:
            end = min(len(band), (at // width + (1 << zeros) + (bits.take(zeros) if zeros else 0)) * width)
            mend(at + np.flatnonzero(band[at:end]))
            at = end
            continue
        value = (1 if bits.take(1) else -1) << low if size else 0
        end = (at // width + 1) * width
        empty = at + np.flatnonzero(band[at:end] == 0)
        stop = int(empty[zeros]) if zeros < len(empty) else end
        mend(at + np.flatnonzero(band[at:stop]))
        if value:
            if stop == end:
                raise ValueError("a run leaves its block")
            band[stop] = value
        at = min(stop + 1, end)


def payload_of(image: Image) -> bytes:
    """What encode() was given."""
    n = next((int(c[8:]) for c in image.comments if re.fullmatch(rb"payload \d+", c)), None)
    if n is None:
        raise ValueError("this image holds no payload")
    v = image.coefficients[: -(-n // 64)]
    out = np.where(v < 0, v + 129, v + 126).astype(np.uint8)
    out[:, 0] = (v[:, 0] + 128).astype(np.uint8)
    return out.tobytes()[:n]


def feature(rgb: np.ndarray) -> str:
    """Size and, for each channel, mean and how much of it is above the middle, in hundredths."""
    n = max(1, rgb.shape[0] * rgb.shape[1])
    flat = rgb.reshape(-1, 3)
    mean, bright = flat.sum(0, dtype=np.int64) * 100 // n, (flat >> 7).sum(0, dtype=np.int64) * 100 // n
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(f"{m}/{b}" for m, b in zip(mean.tolist(), bright.tolist()))


# ---------------------------------------------------------------------------------------------- columns


def _remembered(f: Callable[[bytes], tuple], most: int = 256, largest: int = 1 << 16) -> Callable[[bytes], tuple]:
    """f with the results of the last small inputs kept: copies of a text often come together."""
    known: dict[bytes, tuple] = {}

    def run(x: bytes) -> tuple:
        if x in known:
            return known[x]
        out = f(x)
        if len(x) <= largest:
            if len(known) >= most:
                known.clear()
            known[x] = out
        return out

    return run


def _map(df: DataFrame, column: str, kept: list[str], added: str, f: Callable[[bytes], tuple]) -> DataFrame:
    """The kept columns and what f gives for each value of column; batches are handed on by size."""
    df = small_batches(df).select(*kept, F.col(column).alias("__in"))
    schema = df.select(*kept).schema
    for part in added.split(", "):
        schema = schema.add(*part.split(" "))
    names, kinds = zip(*(x.split(" ") for x in added.split(", ")))
    kinds = [{"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x] for x in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _remembered(f)
        for b in batches:
            start, rows, size = 0, [], 0
            for i, value in enumerate(b.column(len(kept))):
                rows.append(one((value.as_py() or b"") if not isinstance(value, pa.StringScalar) else (value.as_buffer().to_pybytes() if value.is_valid else b"")))
                size += sum(len(x) for x in rows[-1] if isinstance(x, bytes)) + 64
                if size >= HAND_ON or i + 1 == b.num_rows:
                    cols = [b.column(j).slice(start, len(rows)) for j in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, zip(*rows), kinds)], names=[*kept, *names])
                    start, rows, size = i + 1, [], 0

    return df.mapInArrow(run, schema)


def store(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all of them, if not given), with n_bytes of the text and the media that holds it.

    Columns of these names are replaced. A null text counts as empty; an empty one is 192 blanks.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_bytes", "media")]

    def one(raw: bytes) -> tuple[int, bytes]:
        return len(raw), encode(raw + b" " * ((UNIT - len(raw) % UNIT) % UNIT or UNIT * (not raw)))

    return _map(docs, text, kept, "n_bytes long, media binary", one)


def load(df: DataFrame, *, media: str = "media", tensors: bool = True) -> DataFrame:
    """All columns of df, with payload, width, height and feature of the media, and rgb (rows of samples) if tensors.

    Columns of these names are replaced. A null media has a null payload and tensor and no size.
    """
    added = "payload binary, width integer, height integer, feature string" + (", rgb binary" if tensors else "")
    kept = [c for c in df.columns if c not in {x.split(" ")[0] for x in added.split(", ")}]

    def one(data: bytes) -> tuple:
        if not data:
            return (None,) * (5 if tensors else 4)
        image = decode(data)
        rgb = image.rgb()
        return (payload_of(image), image.width, image.height, feature(rgb), *([rgb.tobytes()] if tensors else []))

    return _map(df, media, kept, added, one)


def media_report(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Digests of what is read back from the media of each text, its tensor included."""
    back = load(store(docs, keep=["doc_id"]))
    return back.select(
        "doc_id",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("rgb").cast("long").alias("rgb_bytes"),
        F.crc32("rgb").alias("rgb_crc32"),
    )
