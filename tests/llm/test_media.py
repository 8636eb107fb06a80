import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from emberlog.llm import media


class Writer:
    """A plain progressive writer: all 8-bit symbols have a code of eight or nine bits, and codes go out one by one."""

    COUNTS = [0, 0, 0, 0, 0, 0, 0, 254, 2] + [0] * 7

    def __init__(self):
        self.bits = []

    def put(self, value, size):
        self.bits += [value >> i & 1 for i in range(size - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 8) if s < 254 else self.put((254 << 1) + s - 254, 9)

    def value(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, dtype=np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


def down(v, low):
    return abs(v) >> low if v >= 0 else -(abs(v) >> low)


def dc_scan(blocks, low):
    w, last = Writer(), {}
    for c, b in blocks:
        v = int(b[0]) >> low
        d = v - last.get(c, 0)
        last[c] = v
        w.symbol(abs(d).bit_length())
        w.value(d, abs(d).bit_length()) if d else None
    return w.data()


def ac_scan(blocks, first, last, low):
    w, ended = Writer(), 0

    def flush():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            w.symbol(n << 4)
            w.put(ended - (1 << n), n)
            ended = 0

    for b in blocks:
        run = 0
        for k in range(first, last + 1):
            v = down(int(b[k]), low)
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            w.symbol(run << 4 | abs(v).bit_length())
            w.value(v, abs(v).bit_length())
            run = 0
        if run:
            ended += 1
    flush()
    return w.data()


def ac_refine(blocks, first, last, low):
    w, ended, pending = Writer(), 0, []

    def flush():
        nonlocal ended, pending
        if ended:
            n = ended.bit_length() - 1
            w.symbol(n << 4)
            w.put(ended - (1 << n), n)
            w.bits += pending
            ended, pending = 0, []

    for b in blocks:
        now = [abs(int(b[k])) >> low for k in range(first, last + 1)]
        end = max([i for i, v in enumerate(now) if v == 1], default=-1)
        run, own = 0, []
        for i, v in enumerate(now):
            if v > 1:
                own.append(v & 1)
                continue
            if not v:
                run += 1
                if run == 16 and i < end:
                    flush()
                    w.symbol(0xF0)
                    w.bits += own
                    run, own = 0, []
                continue
            flush()
            w.symbol(run << 4 | 1)
            w.put(int(b[first + i] > 0), 1)
            w.bits += own
            run, own = 0, []
        if run or own:
            ended += 1
            pending += own
    flush()
    return w.data()


def seg(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def picture(width, height, sampling, seed):
    """A JPEG of sparse random coefficients and those coefficients, component by component in the padded grid."""
    rng = np.random.default_rng(seed)
    across, high = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mx, my = -(-width // (8 * across)), -(-height // (8 * high))
    comps = []
    for h, v in sampling:
        c = np.where(rng.random((my * v, mx * h, 64)) < 0.3, rng.integers(-200, 200, (my * v, mx * h, 64)), 0)
        c[rng.random(c.shape[:2]) < 0.3, 1:] = 0
        rows, cols = -(-(-(-height * v // high)) // 8), -(-(-(-width * h // across)) // 8)
        c[rows:, :, 1:], c[:, cols:, 1:] = 0, 0
        comps.append((c, rows, cols))
    tables = b"".join(seg(0xC4, bytes([t, *Writer.COUNTS]) + bytes(range(256))) for t in (0x00, 0x10))
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, *[1, 2] * 32])) + seg(0xC2, frame) + tables
    mcus = [(i, c[y * v + dy, x * h + dx]) for y, x in itertools.product(range(my), range(mx)) for i, ((c, *_), (h, v)) in enumerate(zip(comps, sampling)) for dy, dx in itertools.product(range(v), range(h))]
    if len(comps) == 1:
        mcus = [(0, comps[0][0][y, x]) for y, x in itertools.product(range(comps[0][1]), range(comps[0][2]))]
    ids = bytes(x for i in range(len(comps)) for x in (i + 1, 0))
    out += seg(0xDA, bytes([len(comps)]) + ids + bytes([0, 0, 1])) + dc_scan(mcus, 1)
    own = [[c[y, x] for y, x in itertools.product(range(rows), range(cols))] for c, rows, cols in comps]
    for i, blocks in enumerate(own):
        for first, last in ((1, 5), (6, 63)):
            out += seg(0xDA, bytes([1, i + 1, 0, first, last, 2])) + ac_scan(blocks, first, last, 2)
    w = Writer()
    w.bits = [int(b[0]) & 1 for _, b in mcus]
    out += seg(0xDA, bytes([len(comps)]) + ids + bytes([0, 0, 0x10])) + w.data()
    for low in (1, 0):
        for i, blocks in enumerate(own):
            out += seg(0xDA, bytes([1, i + 1, 0, 1, 63, (low + 1) << 4 | low])) + ac_refine(blocks, 1, 63, low)
    return out + b"\xff\xd9", [c for c, *_ in comps]


@pytest.mark.parametrize("width, height, sampling", [(8, 8, [(1, 1)]), (37, 21, [(1, 1)]), (40, 33, [(1, 1)] * 3), (50, 45, [(2, 2), (1, 1), (1, 1)]), (61, 20, [(2, 1), (1, 1), (1, 1)])])
def test_reader_takes_any_progressive_scans(width, height, sampling):
    for seed in range(3):
        data, want = picture(width, height, sampling, seed)
        image = media.decode(data)
        got = [image.coefficients[c.base : c.base + c.rows * c.cols].reshape(c.rows, c.cols, 64) for c in image.components]
        for g, w in zip(got, want):
            if len(want) == 1:
                rows, cols = -(-height // 8), -(-width // 8)
                g, w = g[:rows, :cols], w[:rows, :cols]
            assert (g == w).all()
        rgb = image.rgb()
        assert rgb.shape == (height, width, 3)
        # steps of 2**-13 in the transform: a sample on the edge may be the next one, and chroma counts nearly twice
        assert np.abs(rgb - plain_rgb(image)).max() <= 4


def plain_rgb(image):
    """The inverse transform and colours, sample by sample in floats."""
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    planes = []
    top = max(x.across for x in image.components), max(x.down for x in image.components)
    for comp in image.components:
        plane = np.zeros((comp.rows * 8, comp.cols * 8))
        for i in range(comp.rows * comp.cols):
            block = np.zeros(64)
            block[media.ZIGZAG] = image.coefficients[comp.base + i] * image.quant[comp.quant]
            y, x = divmod(i, comp.cols)
            plane[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = np.clip(np.floor(c @ block.reshape(8, 8) @ c.T + 0.5) + 128, 0, 255)
        planes.append(plane.repeat(top[1] // comp.down, 0).repeat(top[0] // comp.across, 1)[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = [y + np.rint(1.402 * cr), y + np.rint(-0.344136 * cb) + np.rint(-0.714136 * cr), y + np.rint(1.772 * cb)]
    return np.clip(np.stack(rgb, axis=2), 0, 255)


def test_transform_of_fixed_steps_is_near_the_true_one():
    rng = np.random.default_rng(1)
    coefficients = rng.integers(-300, 300, (200, 64))
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    natural = np.zeros((200, 64))
    natural[:, media.ZIGZAG] = coefficients
    true = np.einsum("yv,nvu,xu->nyx", c, natural.reshape(-1, 8, 8), c).reshape(-1, 64)
    assert np.abs(coefficients @ media._BASIS / (1 << media._BITS) - true).max() < 0.6


@pytest.mark.parametrize("n", [192, 384, 576, 192 * 37, 192 * 700])
def test_payload_round_trip(n):
    rng = random.Random(n)
    for payload in (rng.randbytes(n), b"\0" * n, b"\xff" * n, b" " * n):
        data = media.encode(payload)
        assert media.payload_of(media.decode(data)) == payload


def test_errors():
    data = media.encode(b"a" * 192)
    for bad in (b"", b"no image", data[:40], data[: len(data) // 2].replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
            media.payload_of(media.decode(bad))
    with pytest.raises(ValueError):
        media.payload_of(media.decode(picture(16, 16, [(1, 1)] * 3, 0)[0]))


def test_report_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é" * 96), (-4, "x" * 300_000), (None, "twice"), (None, "twice")], "doc_id long, text string")
    rows = docs.unionByName(extra)
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    got = media.media_report(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes) for r in got) == sorted((i is None, i, len((t or "").encode())) for i, t in texts)
    by_id = {r.doc_id: r for r in got}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        stored = media.encode(payload)
        r = by_id[i]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(media.decode(stored).rgb()))


def test_tensors_clashing_names_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "text", b"old", "rgb")], "doc_id long, text string, media binary, feature string")
    r = media.load(media.store(rows)).first()
    assert (r.doc_id, r.text, r.n_bytes, bytes(r.payload)) == (1, "text", 4, b"text" + b" " * 188)
    assert len(r.rgb) == r.width * r.height * 3 and r.feature != "rgb"
    assert media.load(media.store(rows.where("false"))).collect() == []
    assert media.load(rows.select(media_null())).first().payload is None


def media_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("binary").alias("media")
