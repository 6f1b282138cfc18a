"""Image kernels against their definitions, pixel by pixel."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.functions import images
from attestor.operators import raster
from attestor.sources import backends


def picture(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)


def reflected(i, n):
    """The place of a pixel beyond the border, reflected about the outermost one."""
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def rounded(v):
    return int(min(max(np.rint(v), 0), 255))


def test_resize():
    for scale in (2.0, 3.0, 0.5, 0.37, 1.4):
        assert (images.resize(np.full((9, 7), 77, np.uint8), scale) == 77).all()
        assert images.resize(picture(9, 7), scale).shape == (int(9 * scale), int(7 * scale))
    x = picture(12, 8)
    assert (images.resize(x, 0.5) == np.rint(x.reshape(6, 2, 4, 2).mean((1, 3)))).all()
    ramp = np.tile(np.arange(40, 100, 2, dtype=np.uint8), (5, 1))
    middle = images.resize(ramp, 2.0)[:, 6:-6].astype(float)
    assert (np.abs(middle - (40 + (np.arange(6, 54) + 0.5) - 1)) <= 0.5).all()  # 2 a pixel are 1 a half one
    assert images.resize(x, 1.0) is x and images.resize(picture(1, 1), 0.2).shape == (1, 1)
    colour = np.stack([picture(6, 6, k) for k in range(3)], axis=-1)
    assert all((images.resize(colour, 2.0)[..., k] == images.resize(colour[..., k], 2.0)).all() for k in range(3))


def test_cubic_weights_by_definition():
    def kernel(d, a=-0.75):
        d = abs(d)
        return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a if d < 2 else 0.0

    for t in (0.0, 0.25, 0.6, 0.99):
        assert np.allclose(images.cubic_weights(np.array([t]))[0], [kernel(t + 1), kernel(t), kernel(1 - t), kernel(2 - t)])


@pytest.mark.parametrize("shape", [(5, 6), (1, 4), (3, 3)])
def test_denoise(shape, monkeypatch):
    monkeypatch.setattr(images, "SEARCH", 5)
    monkeypatch.setattr(images, "PATCH", 3)
    monkeypatch.setattr(images, "STRENGTH", 40.0)
    x = picture(*shape)
    h, w = shape
    edge = (lambda i, n: reflected(i, n)) if min(shape) > 1 else (lambda i, n: min(max(i, 0), n - 1))
    at = lambda r, c: float(x[edge(r, h), edge(c, w)])
    want = np.zeros(shape, np.uint8)
    for r in range(h):
        for c in range(w):
            total = weights = 0.0
            for dr in range(-2, 3):
                for dc in range(-2, 3):
                    d = sum((at(r + i, c + j) - at(r + dr + i, c + dc + j)) ** 2 for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
                    weight = math.exp(-d / 1600)
                    if weight >= 0.001:
                        weights, total = weights + weight, total + weight * at(r + dr, c + dc)
            want[r, c] = rounded(total / weights)
    assert (np.abs(images.denoise(x).astype(int) - want) <= 0).all()


def test_denoise_levels_noise():
    rng = np.random.default_rng(2)
    clean = np.where(np.arange(60) < 30, 60, 200) * np.ones((40, 1))
    noisy = np.clip(clean + rng.normal(0, 6, clean.shape), 0, 255).astype(np.uint8)
    out = images.denoise(noisy).astype(float)
    assert np.abs(out - clean).mean() < 0.5 * np.abs(noisy - clean).mean() and out[:, :28].max() < 90 and out[:, 32:].min() > 170


@pytest.mark.parametrize("shape", [(16, 24), (19, 24), (21, 13), (5, 3)])
def test_contrast(shape):
    x = (picture(*shape) // 3 + 60).astype(np.uint8)
    h, w = shape
    grown = (0, 0) if h % 8 == w % 8 == 0 else (8 - h % 8, 8 - w % 8)
    th, tw = (h + grown[0]) // 8, (w + grown[1]) // 8
    tables = {}
    for i in range(8):
        for j in range(8):
            count = [0] * 256
            for r in range(i * th, (i + 1) * th):
                for c in range(j * tw, (j + 1) * tw):
                    count[x[reflected(r, h), reflected(c, w)]] += 1
            limit = max(int(2.5 * th * tw / 256), 1)
            over = sum(max(n - limit, 0) for n in count)
            count = [min(n, limit) + over // 256 for n in count]
            rest, k = over % 256, 0
            step = max(256 // rest, 1) if rest else 0
            while rest and k < 256:
                count[k] += 1
                rest, k = rest - 1, k + step
            total, tables[i, j] = 0, []
            for n in count:
                total += n
                tables[i, j].append(rounded(total * (255 / (th * tw))))
    out = images.contrast(x)
    for r in range(h):
        for c in range(w):
            y, z = r / th - 0.5, c / tw - 0.5
            i, j = math.floor(y), math.floor(z)
            look = lambda a, b: tables[min(max(a, 0), 7), min(max(b, 0), 7)][x[r, c]]  # noqa: B023, E731
            v = (look(i, j) * (1 - z + j) + look(i, j + 1) * (z - j)) * (1 - y + i) + (look(i + 1, j) * (1 - z + j) + look(i + 1, j + 1) * (z - j)) * (y - i)
            assert abs(int(out[r, c]) - v) <= 0.5 + 1e-6, (r, c)


def block(angle, h=160, w=260):
    """A dark bar of 180 by 60, turned by an angle (degrees, x towards y), its edges smooth."""
    t = math.radians(angle)
    r, c = np.mgrid[:h, :w].astype(float)
    r, c = r - h // 2, c - w // 2
    u, v = math.cos(t) * c + math.sin(t) * r, -math.sin(t) * c + math.cos(t) * r
    inside = np.clip(90.5 - np.abs(u), 0, 1) * np.clip(30.5 - np.abs(v), 0, 1)
    return (255 - 235 * inside).astype(np.uint8)


def angle_of(x):
    """By the slope of the bar's middle line."""
    columns = np.arange(x.shape[1] // 2 - 60, x.shape[1] // 2 + 60)
    rows = np.arange(x.shape[0])[:, None]
    ink = 255.0 - x[:, columns]
    return math.degrees(math.atan(np.polyfit(columns, (ink * rows).sum(0) / ink.sum(0), 1)[0]))


@pytest.mark.parametrize("angle", [0.5, 1.0, 3.0, 7.5, 12.0, 14.5, -0.6, -2.0, -9.0, -14.0])
def test_deskew(angle):
    x = block(angle)
    assert abs(angle_of(x) - angle) < 0.2
    assert abs(angle_of(images.deskew(x))) < 0.5


def test_deskew_leaves_small_and_large_angles():
    for angle in (0.0, 0.1, 20.0, -30.0, 44.0):
        x = block(angle)
        assert images.deskew(x) is x
    few = np.full((30, 30), 255, np.uint8)
    few[3, 3:10] = 0
    assert images.deskew(few) is few and images.deskew(np.full((9, 9), 7, np.uint8)).shape == (9, 9)


def test_least_rectangle_by_trial():
    rng = np.random.default_rng(3)
    for _ in range(20):
        points = rng.integers(-40, 40, (rng.integers(4, 30), 2))
        def area(a):
            c, s = math.cos(a), math.sin(a)
            return np.ptp(points @ [c, s]) * np.ptp(points @ [-s, c])  # noqa: B023
        best = min(area(a) for a in np.linspace(-math.pi / 4, math.pi / 4, 4001))
        assert area(math.radians(images.least_rectangle_angle(points))) <= best + 1e-6


def decoded(data):
    """An independent reading of a PNG file, line by line."""
    at, body = 8, b""
    while at < len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        assert zlib.crc32(name + part) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        if name == b"IHDR":
            w, h, depth, colour = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big"), part[8], part[9]
        body += part if name == b"IDAT" else b""
        at += 12 + size
    step, raw = {0: 1, 2: 3}[colour], zlib.decompress(body)
    assert depth == 8 and len(raw) == h * (1 + w * step)
    lines, kinds = [[0] * (w * step)], set()
    for i in range(h):
        kind, line = raw[i * (1 + w * step)], []
        kinds.add(kind)
        for k, v in enumerate(raw[i * (1 + w * step) + 1 : (i + 1) * (1 + w * step)]):
            a, b, c = line[k - step] if k >= step else 0, lines[-1][k], lines[-1][k - step] if k >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v + (0, a, b, (a + b) // 2, near)[kind]) % 256)
        lines.append(line)
    return np.array(lines[1:], np.uint8).reshape((h, w) if step == 1 else (h, w, 3)), kinds


def test_png():
    smooth = np.add.outer(np.arange(40), 3 * np.arange(30)).astype(np.uint8)
    colour = np.stack([smooth, smooth[::-1], picture(40, 30)], axis=-1)
    every = set()
    for x in (picture(7, 5), smooth, np.zeros((3, 1), np.uint8), colour, np.repeat(picture(1, 30), 9, axis=0)):
        found, kinds = decoded(images.to_png(x))
        every |= kinds
        assert (found == (x if x.ndim == 2 else x[..., ::-1])).all() and (images.from_png(images.to_png(x)) == x).all()
    assert len(every) >= 3
    for broken in (b"", b"\x89PNG\r\n\x1a\n", images.to_png(smooth)[:-20] + b"0" * 20):
        with pytest.raises(ValueError):
            images.from_png(broken)


def test_steps_and_pictures_in_spark(spark):
    x = picture(12, 10)
    for kind in raster.PIPELINES:
        out, skipped = raster.prepare(x, kind)
        assert not skipped and out.dtype == np.uint8 and out.ndim == 2
    assert (raster.STEPS["swap_channels"](np.dstack([x, x + 1, x + 2]), None)[..., 0] == x + 2).all()
    assert (raster.sharpen(np.full((4, 4), 9, np.uint8)) == 9).all()
    spike = np.full((5, 5), 100, np.uint8)
    spike[2, 2] = 120
    assert raster.sharpen(spike)[2, 2] == 200 and raster.sharpen(spike)[2, 1] == 80
    rows = spark.createDataFrame([(raster.raster_of(x),), (raster.raster_of(None),)], f"r {raster.RASTER}").withColumn("png", raster.png("r")).withColumn("back", raster.from_png("png")).collect()
    assert rows[0]["back"] == rows[0]["r"] and (decoded(bytes(rows[0]["png"]))[0] == x).all() and rows[1]["png"] is None and rows[1]["back"]["h"] is None
    assert spark.range(1).select(raster.from_png(F.lit(b"x")).alias("b")).first()["b"]["data"] is None
    try:
        import PIL  # noqa: F401
    except ImportError:
        assert backends.provider("image", {})(images.to_png(x))[:3] == (12, 10, 1)
        with pytest.raises(RuntimeError):
            backends.provider("image", {})(b"GIF89a")
