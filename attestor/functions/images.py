"""Numpy kernels of image preparation: grey or colour arrays of bytes, rows first.

Neighbourhoods beyond the border: repeated for resizing and rotation,
reflected about the outermost pixel for denoising and the contrast's tiles.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

#: Sharpness of the cubic kernel.
CUBIC = -0.75
# Strength, patch and window of denoising; clip limit and tiles of contrast.
STRENGTH, PATCH, SEARCH, LEAST_WEIGHT = 10.0, 7, 21, 0.001
CLIP, TILES = 2.5, 8
#: Angles (degrees) that are corrected, and pixels an angle is taken from at least.
SKEW, INK = (0.3, 15.0), 20


def grey(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 2 else np.rint(x[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu_each(x: np.ndarray) -> np.ndarray:
    """The level that parts each grey image of a stack with most variance between the parts."""
    n = len(x)
    at = x.reshape(n, -1).astype(np.int64) + 256 * np.arange(n)[:, None]
    count = np.bincount(at.ravel(), minlength=256 * n).reshape(n, 256).astype(float)
    below = np.cumsum(count, axis=1)
    mass, total = np.cumsum(count * np.arange(256), axis=1), below[:, -1:]
    both = below * (total - below)
    between = np.where(both > 0, (mass[:, -1:] * below - mass * total) ** 2 / np.where(both > 0, both, 1), 0)
    return np.where(between.max(axis=1) > 0, between.argmax(axis=1), 0)


def otsu(x: np.ndarray) -> int:
    """The level that parts a grey image with most variance between the parts."""
    return int(otsu_each(x[None])[0])


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def cubic_weights(t: np.ndarray) -> np.ndarray:
    """Weights of the four neighbours -1, 0, 1, 2 of a place t (0 to 1) past a pixel."""
    a = CUBIC
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.stack([far(t + 1), near(t), near(1 - t), far(2 - t)], axis=-1)


@lru_cache(256)
def _cubic(size: int, target: int) -> np.ndarray:
    """(target, size) weights that resample a line of pixels by the cubic kernel."""
    at = (np.arange(target) + 0.5) * size / target - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((target, size))
    for k, weight in enumerate(cubic_weights(at - base).T):
        np.add.at(out, (np.arange(target), np.clip(base + k - 1, 0, size - 1)), weight)
    return out


@lru_cache(256)
def _area(size: int, target: int) -> np.ndarray:
    """(target, size) weights by how much of a target pixel each pixel covers."""
    edges = np.arange(target + 1) * size / target
    pixel = np.arange(size)
    cover = np.minimum(edges[1:, None], pixel + 1) - np.maximum(edges[:-1, None], pixel)
    cover = np.maximum(cover, 0)
    return cover / cover.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, scale: float) -> np.ndarray:
    """By the cubic kernel where it grows, by covered areas where it shrinks; sizes are cut off."""
    if scale == 1.0 or not x.size:
        return x
    kind = _cubic if scale > 1 else _area
    rows, columns = (kind(n, max(1, int(n * scale))) for n in x.shape[:2])
    if x.ndim == 2:  # without a search for the order of the products
        return _bytes(rows @ x.astype(float) @ columns.T)
    return _bytes(np.einsum("ij,jk...,lk->il...", rows, x.astype(float), columns, optimize=True))


def _box_sums(x: np.ndarray, size: int) -> np.ndarray:
    """Sums over all windows of size by size, by an integral image."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    total[1:, 1:] = x.cumsum(0).cumsum(1)
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def denoise(x: np.ndarray) -> np.ndarray:
    """Non-local means: each pixel is the mean of the pixels of its window, weighted by
    how alike the patches around them are.  One integral image of squared
    differences for each shift of the window serves all pixels."""
    x = grey(x)
    if not x.size:
        return x
    h, w = x.shape
    reach, half = SEARCH // 2, PATCH // 2
    p = np.pad(x.astype(float), reach + half, mode="reflect" if min(h, w) > 1 else "edge")
    centre = p[reach : reach + h + 2 * half, reach : reach + w + 2 * half]
    weights, total = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(SEARCH):
        for dx in range(SEARCH):
            other = p[dy : dy + h + 2 * half, dx : dx + w + 2 * half]
            weight = np.exp(-_box_sums((other - centre) ** 2, PATCH) / (PATCH * PATCH * STRENGTH * STRENGTH))
            weight[weight < LEAST_WEIGHT] = 0
            weights += weight
            total += weight * other[half : half + h, half : half + w]
    return _bytes(total / weights)


def _tile_tables(x: np.ndarray) -> np.ndarray:
    """(TILES, TILES, 256) levels: each tile's clipped histogram, equalised.

    What is clipped goes to all levels alike, the remainder to levels at even steps."""
    h, w = x.shape[0] // TILES, x.shape[1] // TILES
    limit = max(int(CLIP * h * w / 256), 1)
    out = np.empty((TILES, TILES, 256))
    for i in range(TILES):
        for j in range(TILES):
            count = np.bincount(x[i * h : (i + 1) * h, j * w : (j + 1) * w].ravel(), minlength=256)
            over = int(np.maximum(count - limit, 0).sum())
            count = np.minimum(count, limit) + over // 256
            if over % 256:
                step = max(256 // (over % 256), 1)
                count[: step * (over % 256) : step] += 1
            out[i, j] = _bytes(count.cumsum() * (255 / (h * w)))
    return out


def contrast(x: np.ndarray) -> np.ndarray:
    """Adaptive equalisation: tables of tiles, blended between their middles."""
    x = grey(x)
    if not x.size:
        return x
    h, w = x.shape
    missing = [(-n) % TILES for n in (h, w)]
    if any(missing):  # both sides grow then, by a whole row of tiles if only the other one is uneven
        missing = [m or TILES for m in missing]
    padded = np.pad(x, ((0, missing[0]), (0, missing[1])), mode="reflect" if min(h, w) > 1 else "edge")
    tables = _tile_tables(padded)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.maximum(low, 0), np.minimum(low + 1, TILES - 1), at - low

    r0, r1, fr = between(h, padded.shape[0] // TILES)
    c0, c1, fc = between(w, padded.shape[1] // TILES)
    look = lambda r, c: tables[r[:, None], c[None, :], x]
    fr, fc = fr[:, None], fc[None, :]
    return _bytes((look(r0, c0) * (1 - fc) + look(r0, c1) * fc) * (1 - fr) + (look(r1, c0) * (1 - fc) + look(r1, c1) * fc) * fr)


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of distinct points (x, y) in turning order, by two monotone chains."""
    points = np.unique(points, axis=0)  # sorted by x, then y
    if len(points) < 3:
        return points
    chains = []
    for order in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def least_rectangle_angle(points: np.ndarray) -> float:
    """The angle (degrees, above -45 and up to 45) of the sides of the rectangle of least
    area around points; one of its sides lies on a side of the hull."""
    corners = hull(points).astype(float)
    if len(corners) < 2:
        return 0.0
    sides = np.roll(corners, -1, axis=0) - corners
    angles = np.arctan2(sides[:, 1], sides[:, 0])
    c, s = np.cos(angles), np.sin(angles)
    along, across = corners @ np.stack([c, s]), corners @ np.stack([-s, c])
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    angle = np.degrees(angles[int(area.argmin())]) % 90
    return float(angle - 90 if angle > 45 else angle)


def rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    """Turned against the y axis's direction about the middle, each pixel fetched by the cubic kernel."""
    h, w = x.shape[:2]
    cy, cx = h // 2, w // 2
    t = np.radians(degrees)
    dy, dx = np.mgrid[:h, :w].astype(float)
    dy, dx = dy - cy, dx - cx
    at_x, at_y = cx + np.cos(t) * dx - np.sin(t) * dy, cy + np.sin(t) * dx + np.cos(t) * dy
    x0, y0 = np.floor(at_x).astype(int), np.floor(at_y).astype(int)
    wx, wy = cubic_weights(at_x - x0), cubic_weights(at_y - y0)
    out = np.zeros(x.shape)
    more = (1,) * (x.ndim - 2)
    for j in range(4):
        row = np.clip(y0 + j - 1, 0, h - 1)
        for i in range(4):
            weight = (wy[..., j] * wx[..., i]).reshape(h, w, *more)
            out += weight * x[row, np.clip(x0 + i - 1, 0, w - 1)]
    return _bytes(out)


def deskew(x: np.ndarray) -> np.ndarray:
    """Turned back by the angle of the least rectangle around the ink; small and large angles stay."""
    g = grey(x)
    if not g.size:
        return x
    rows, columns = np.nonzero(g <= otsu(g))
    if len(rows) < INK:
        return x
    # only a row's outermost pixels can be corners
    order = np.unique(rows, return_index=True)
    ends = np.append(order[1][1:], len(rows)) - 1
    points = np.concatenate([np.stack([columns[k], rows[k]], axis=1) for k in (order[1], ends)])
    angle = least_rectangle_angle(points)
    return rotate(x, angle) if SKEW[0] <= abs(angle) <= SKEW[1] else x


_MAGIC = b"\x89PNG\r\n\x1a\n"


def _filtered(lines: np.ndarray, step: int) -> np.ndarray:
    """All scan lines (int16) under each of the five filters, which take the lines as they are."""
    above, left, corner = (np.zeros_like(lines) for _ in range(3))
    above[1:], left[:, step:], corner[1:, step:] = lines[:-1], lines[:, :-step], lines[:-1, :-step]
    guess = left + above - corner
    a, b, c = np.abs(guess - left), np.abs(guess - above), np.abs(guess - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    return np.stack([lines, lines - left, lines - above, lines - ((left + above) >> 1), lines - paeth]) & 255


def to_png(x: np.ndarray) -> bytes:
    """PNG bytes of a grey or blue-green-red image; each line has the filter of least magnitude."""
    x = x if x.ndim == 2 else x[..., 2::-1]
    h, w = x.shape[:2]
    step = 1 if x.ndim == 2 else 3
    kinds = _filtered(x.reshape(h, w * step).astype(np.int16), step)
    best = np.minimum(kinds, 256 - kinds).sum(axis=2).argmin(axis=0)
    lines = np.concatenate([best[:, None], kinds[best, np.arange(h)]], axis=1).astype(np.uint8)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if x.ndim == 2 else 2, 0, 0, 0)
    return _MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The image of PNG bytes: 8-bit grey or colour, opacity left out, not interlaced."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        (size,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + part)):
            raise ValueError("a damaged PNG file")
        head = struct.unpack(">IIBBBBB", part) if name == b"IHDR" else head
        body += [part] if name == b"IDAT" else []
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        raise ValueError("this kind of PNG is not supported")
    w, h, step = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for i in range(h):
        kind, line = int(raw[i, 0]), raw[i, 1:]
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = line.reshape(w, step).cumsum(0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind in (3, 4):
            line = line.copy()
            own, over = line.tolist(), above.tolist()
            for k in range(len(own)):
                left, up, corner = (own[k - step], over[k], over[k - step]) if k >= step else (0, over[k], 0)
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                own[k] = (own[k] + guess) & 255
            line = np.array(own, np.uint8)
        out[i] = above = line
    image = out.reshape(h, w, step)
    return image[..., 0] if step < 3 else image[..., 2::-1]
