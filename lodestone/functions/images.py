"""Picture functions over arrays, and UDFs over binary columns.

Pictures are arrays of height by width, or by width by channels (three colours, or four with
alpha). Decoders are pluggable; the built-in one reads PNG (8 bits, not interlaced) and binary PGM
and PPM, which needs nothing but zlib. Functions on bytes give null, or the bytes unchanged where so
stated, for pictures that can't be read.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the picture operators.
WHITE, CROP_PAD = 250, 2
CLEAR_FROM, CLEAR_RAMP = 245, 15
ZONE_HEIGHT, ZONE_WIDTH, ZONE_INK, ZONE_PAD = 0.6, 0.5, 242, 5
PART_AREA, PART_SIDE, PART_ASPECT, PART_INK = 120, 6, (0.12, 12.0), 0.02
BEST_ASPECT, BEST_AREA = (0.1, 10.0), 400
GAP_WIDTH, GAP_FROM, GAP_TO = 15, 0.15, 0.85
PICTURE_DEVIATION = 5.0

# ------------------------------------------------------------------------ coding

_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(blob: bytes) -> np.ndarray:
    """A PNG, PGM or PPM picture as an array; gray ones have two axes."""
    if blob[:8] == b"\x89PNG\r\n\x1a\n":
        return _decode_png(blob)
    if blob[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while blob[at : at + 1].isspace():
                at += 1
            end = at
            while not blob[end : end + 1].isspace():
                end += 1
            fields.append(int(blob[at:end]))
            at = end
        w, h, _ = fields
        data = np.frombuffer(blob, np.uint8, offset=at + 1)
        return data[: w * h].reshape(h, w).copy() if blob[:2] == b"P5" else data[: w * h * 3].reshape(h, w, 3).copy()
    raise ValueError("unknown picture format")


def _decode_png(blob: bytes) -> np.ndarray:
    at, packed, head = 8, b"", None
    while at + 8 <= len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in _CHANNELS:
        raise ValueError("unsupported PNG")
    n = _CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    above = np.zeros(w * n, np.int32)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind:
            for x in range(w * n):
                left = line[x - n] & 255 if x >= n else 0
                corner = above[x - n] if x >= n else 0
                if kind == 1:
                    line[x] += left
                elif kind == 3:
                    line[x] += (left + above[x]) // 2
                else:
                    guess = left + above[x] - corner
                    near = [abs(guess - left), abs(guess - above[x]), abs(guess - corner)]
                    line[x] += (left, above[x], corner)[near.index(min(near))]
        out[y] = line & 255
        above = out[y].astype(np.int32)
    pixels = out.reshape(h, w, n)
    if n == 1:
        return pixels[:, :, 0]
    return np.dstack([pixels[:, :, 0]] * 3 + [pixels[:, :, 1]]) if n == 2 else pixels


def encode(pixels: np.ndarray) -> bytes:
    """A picture as PNG."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    colour = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    h, w = pixels.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def attempt(f: Callable, *args):
    """What a function makes of a picture, or None where it can't."""
    try:
        return None if args[0] is None else f(*args)
    except Exception:  # a decoder may raise anything on broken bytes
        return None


# ---------------------------------------------------------------------- on arrays


def gray(p: np.ndarray) -> np.ndarray:
    """Luma of a picture; what is transparent counts as white."""
    if p.ndim == 2:
        return p.astype(np.float64)
    luma = p[:, :, :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    return luma if p.shape[2] < 4 else luma * p[:, :, 3] / 255.0 + 255.0 - p[:, :, 3]


def resized(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """A gray picture at another size, each new pixel the mean of what it covers."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        edges = np.linspace(0, x.shape[0], n + 1)
        at = np.minimum(edges.astype(int), x.shape[0])
        part = edges - at
        whole = sums[at] + part[:, None] * np.vstack([x, x[-1:]])[at]
        return np.diff(whole, axis=0) / np.diff(edges)[:, None]

    return along(along(g.astype(np.float64), h).T, w).T


def box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(top, bottom, left, right) around what is set, ends exclusive."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (rows[0], rows[-1] + 1, cols[0], cols[-1] + 1) if len(rows) else None


def cropped(p: np.ndarray, mask: np.ndarray, pad: int = 0) -> np.ndarray:
    found = box(mask)
    if found is None:
        return p
    t, b, l, r = found
    return p[max(0, t - pad) : b + pad, max(0, l - pad) : r + pad]


def tight_crop(p: np.ndarray, white: int = WHITE, pad: int = CROP_PAD) -> np.ndarray:
    """A picture without its white margin."""
    return cropped(p, gray(p) < white, pad)


def without_white(p: np.ndarray, start: int = CLEAR_FROM, ramp: int = CLEAR_RAMP) -> np.ndarray:
    """White made transparent, near-white in proportion, and cropped to what is left."""
    colours = np.dstack([p] * 3) if p.ndim == 2 else p[:, :, :3]
    lightest = colours.min(axis=2).astype(np.float64)
    alpha = np.clip((start - lightest) / ramp, 0, 1) * 255
    out = np.dstack([colours, alpha.round().astype(np.uint8)])
    return cropped(out, out[:, :, 3] > 0)


def logo_zone(p: np.ndarray) -> np.ndarray | None:
    """What is inked in the upper left part of a block, where its logo stands; None if nothing is."""
    zone = p[: int(p.shape[0] * ZONE_HEIGHT), : int(p.shape[1] * ZONE_WIDTH)]
    ink = gray(zone) < ZONE_INK
    return cropped(zone, ink, ZONE_PAD) if ink.any() else None


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(top, bottom, left, right, pixels) of each group of set pixels that touch, corners included."""
    seen, out = np.zeros_like(mask, bool), []
    h, w = mask.shape
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, n, t, b, l, r = deque([(y, x)]), 0, y, y, x, x
        seen[y, x] = True
        while todo:
            cy, cx = todo.popleft()
            n, t, b, l, r = n + 1, min(t, cy), max(b, cy), min(l, cx), max(r, cx)
            for ny in range(max(0, cy - 1), min(h, cy + 2)):
                for nx in range(max(0, cx - 1), min(w, cx + 2)):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        todo.append((ny, nx))
        out.append((int(t), int(b) + 1, int(l), int(r) + 1, n))
    return out


def logo_parts(p: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(top, bottom, left, right, ink) of the components that may be a logo, the most inked and largest first."""
    kept = []
    for t, b, l, r, n in components(gray(p) < ZONE_INK):
        h, w = b - t, r - l
        ink = n / (h * w)
        if h * w >= PART_AREA and h > PART_SIDE and w > PART_SIDE and PART_ASPECT[0] <= w / h <= PART_ASPECT[1] and ink >= PART_INK:
            kept.append((t, b, l, r, ink))
    return sorted(kept, key=lambda x: (x[4], (x[1] - x[0]) * (x[3] - x[2])), reverse=True)


def largest_part(parts: list[tuple]) -> tuple | None:
    """Of the components of a fitting shape the one with the largest box."""
    area = lambda x: (x[1] - x[0]) * (x[3] - x[2])
    fit = [x for x in parts if area(x) >= BEST_AREA and BEST_ASPECT[0] <= (x[3] - x[2]) / (x[1] - x[0]) <= BEST_ASPECT[1]]
    return max(fit, key=area, default=None)


def longest_gap(blank: np.ndarray) -> tuple[int, int]:
    """(start, length) of the first longest run of set values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], blank.astype(np.int8), [0]])))
    if not len(edges):
        return 0, 0
    lengths = edges[1::2] - edges[::2]
    at = int(lengths.argmax())
    return int(edges[2 * at]), int(lengths[at])


def logo_beside_text(p: np.ndarray) -> np.ndarray:
    """The left part of a picture that a wide blank column run divides, without its margin."""
    ink = gray(p) < WHITE
    w = p.shape[1]
    a, b = int(w * GAP_FROM), int(w * GAP_TO)
    start, length = longest_gap(~ink[:, a:b].any(axis=0))
    return tight_crop(p[:, : a + start] if length > GAP_WIDTH else p)


def has_picture(p: np.ndarray) -> bool:
    """Whether brightness varies enough to be more than an empty patch."""
    return float(gray(p).std()) > PICTURE_DEVIATION


def perceptual_hash(p: np.ndarray) -> int:
    """64 signs of the low frequencies of a 32 by 32 picture against their median, as a signed long."""
    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ resized(gray(p), n, n) @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def snapshot(page: np.ndarray, box_: tuple[float, float, float, float], page_size: tuple[float, float]) -> np.ndarray:
    """The part of a page's raster that a block (x0, y0, x1, y1, in page units) covers."""
    sy, sx = page.shape[0] / page_size[1], page.shape[1] / page_size[0]
    x0, y0, x1, y1 = box_
    return page[max(0, round(y0 * sy)) : round(y1 * sy), max(0, round(x0 * sx)) : round(x1 * sx)]


# -------------------------------------------------------------- pictures in pairs

# Sides and thresholds of edge maps, key points and the ratio of their matches.
EDGE_SIDE, EDGE_LOW, EDGE_HIGH, POINTS, RATIO = 128, 100.0, 200.0, 500, 0.75
#: Half the side of the patch that a descriptor compares points of, and how many pairs it compares.
PATCH, PAIRS = 12, 256


def _gradient(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(g, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return gx, gy


def edges(g: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Crests of the gradient above high, and those above low that touch them."""
    gx, gy = _gradient(g)
    size = np.abs(gx) + np.abs(gy)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    padded = np.pad(size, 1)
    h, w = g.shape
    at = lambda dy, dx: padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    crest = np.zeros_like(size, bool)
    for t, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        crest |= (turn == t) & (size > at(dy, dx)) & (size >= at(-dy, -dx))
    weak, strong = crest & (size > low), crest & (size > high)
    out = np.zeros_like(strong)
    while (out != strong).any():
        out = strong
        wide = np.pad(strong, 1)
        near = np.logical_or.reduce([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        strong = strong | weak & near
    return strong


def edge_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 minus the share of pixels in which the edge maps of two pictures differ."""
    x, y = (edges(resized(gray(p), EDGE_SIDE, EDGE_SIDE)) for p in (a, b))
    return 1.0 - float((x != y).mean())


def descriptors(p: np.ndarray, most: int = POINTS) -> np.ndarray:
    """Binary descriptors of a picture's corners: which of two points of the patch around each is darker."""
    g = gray(p)
    gx, gy = _gradient(g)

    def smooth(x):
        for _ in range(2):
            q = np.pad(x, 1, mode="edge")
            x = (q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] + x) / 5
        return x

    xx, yy, xy = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
    corner = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    h, w = g.shape
    q = np.pad(corner, 1, constant_values=-np.inf)
    peak = np.logical_and.reduce([corner >= q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    y, x = np.nonzero(peak & (corner > 1e-3 * max(corner.max(), 1e-9)))
    best = np.argsort(-corner[y, x], kind="stable")[:most]
    y, x = y[best], x[best]
    around = np.pad(smooth(g), PATCH, mode="edge")
    pairs = np.random.default_rng(11).integers(0, 2 * PATCH + 1, (PAIRS, 4))
    first = around[y[:, None] + pairs[:, 0], x[:, None] + pairs[:, 1]]
    return np.packbits(first < around[y[:, None] + pairs[:, 2], x[:, None] + pairs[:, 3]], axis=1)


def ratio_matches(a: np.ndarray, b: np.ndarray, ratio: float = RATIO) -> int:
    """How many descriptors of the first are clearly nearer to one of the second than to any other."""
    if not len(a) or len(b) < 2:
        return 0
    apart = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    two = np.partition(apart, 1, axis=1)[:, :2]
    return int((two[:, 0] < ratio * two[:, 1]).sum())


def key_point_score(a: np.ndarray, b: np.ndarray, over: str = "fewer", extract: Callable = descriptors) -> float:
    """Matched key points over the fewer of both pictures, or over those of the first."""
    x, y = extract(a), extract(b)
    n = min(len(x), len(y)) if over == "fewer" else len(x)
    return ratio_matches(x, y) / max(1, n)


def pair_score(a: Column, b: Column, f: Callable, decoder: Callable = decode) -> Column:
    """A score of two binary columns; 0 where a picture can't be read."""

    @F.pandas_udf("double")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        def of(x, y):
            p, q = attempt(decoder, x), attempt(decoder, y)
            return 0.0 if p is None or q is None else float(attempt(f, p, q) or 0.0)

        return pd.Series([of(x, y) for x, y in zip(one, two, strict=True)], dtype="float64")

    return run(a, b)


# ---------------------------------------------------------------- on binary columns


def picture(c: Column, f: Callable, keep: bool = False, decoder: Callable = decode) -> Column:
    """A binary column of what a function makes of each picture; where it fails, null or the bytes as they were."""

    @F.pandas_udf("binary")
    def run(blobs: pd.Series) -> pd.Series:
        def one(b):
            made = attempt(lambda x: f(decoder(x)), b)
            return (b if keep else None) if made is None else encode(made)

        return pd.Series([one(b) for b in blobs], dtype=object)

    return run(c)


def hash_of(c: Column, decoder: Callable = decode) -> Column:
    @F.pandas_udf("long")
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([attempt(lambda x: perceptual_hash(decoder(x)), b) for b in blobs], dtype="Int64")

    return run(c)


def is_picture(c: Column, decoder: Callable = decode) -> Column:
    @F.pandas_udf("boolean")
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([bool(attempt(lambda x: has_picture(decoder(x)), b)) for b in blobs])

    return run(c)


def logo_of(block: Column, detector: Callable | None = None, decoder: Callable = decode) -> Column:
    """A block's logo: what a detector finds, else the inked zone. A detector maps an array to an array or None."""

    def find(p):
        found = None if detector is None else attempt(detector, p)
        return logo_zone(p) if found is None else found

    return picture(block, find, decoder=decoder)
