"""Images as arrays: reading and writing PNG, metrics of quality, enhancement, and photographs made from clean scans.

Arrays are (height, width, 3), red first, 0 to 255.  Each function takes one image, so that Spark gives them to workers
row by row (see measured() and photographed()): an image is one row, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed

# How networks expect their input.
MEAN, SPREAD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
# What counts as paper by its brightness, from nothing to all, and the power that darkens faint ink.
PAPER, GAMMA = (100.0, 170.0), 3.5

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_png(data: bytes) -> np.ndarray | None:
    """An 8-bit grey or colour PNG that isn't interlaced; None if it can't be read."""
    if not data or data[:8] != _SIGNATURE:
        return None
    at, packed, head = 8, [], None
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                packed.append(body)
            at += 12 + size
        width, height, depth, colour, _, _, interlaced = head
        bands = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * bands)
    except (KeyError, TypeError, ValueError, struct.error, zlib.error):
        return None
    out, above = np.zeros((height, width, bands), np.uint8), np.zeros((width, bands), np.uint8)
    for y, row in enumerate(rows):
        line = row[1:].reshape(width, bands).copy()
        if row[0] == 1:
            line = np.add.accumulate(line, axis=0, dtype=np.uint8)
        elif row[0] == 2:
            line += above
        elif row[0] in (3, 4):
            _along(line, above, int(row[0]))
        elif row[0]:
            return None
        out[y] = above = line
    return np.repeat(out[..., :1], 3, axis=2) if bands < 3 else out[..., :3]


def _along(line: np.ndarray, above: np.ndarray, kind: int) -> None:
    left, corner = np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64)
    for x, up in enumerate(above.astype(np.int64)):
        if kind == 3:
            guess = (left + up) // 2
        else:
            far = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        left, corner = (line[x] + guess) % 256, up
        line[x] = left


def write_png(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    rows = np.concatenate((np.zeros((height, 1), np.uint8), image.astype(np.uint8).reshape(height, -1)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def normalised(image: np.ndarray) -> np.ndarray:
    """As networks take it: (1, 3, height, width)."""
    return ((image / 255.0 - MEAN) / SPREAD).astype(np.float32).transpose(2, 0, 1)[None]


def smaller(g: np.ndarray, side: int) -> np.ndarray:
    """Means of blocks, so that the longer side is about `side`."""
    k = max(1, -(-max(g.shape) // side))
    h, w = (max(1, n // k) for n in g.shape)
    return g[: h * k, : w * k].reshape(h, min(k, g.shape[0]), w, min(k, g.shape[1])).mean(axis=(1, 3)) if min(g.shape) >= k else g


def _over(g: np.ndarray, reach: int, f) -> np.ndarray:
    """f (a maximum or minimum) over squares of 2 * reach + 1, one axis after the other."""
    for axis in (0, 1):
        padded = np.pad(g, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        g = f.reduce([np.take(padded, range(i, i + g.shape[axis]), axis=axis) for i in range(2 * reach + 1)])
    return g


def _smooth(g: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian, one axis after the other."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(g, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        g = sum(k * np.take(padded, range(i, i + g.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return g


def sharpness(g: np.ndarray) -> float:
    """The variance of what a pixel differs from its four neighbours by."""
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def tilt(g: np.ndarray, most: float = 30.0, step: float = 0.5) -> float:
    """The angle in degrees at which ink lies in rows most clearly: of the sheared rows' sums, the largest variance; 0 if none stands out."""
    small = smaller(g, 400)
    ink = np.maximum(np.median(small) - small, 0)
    ys, xs = np.nonzero(ink > 0.25 * max(ink.max(), 1e-9))
    if len(ys) < 20:
        return 0.0
    weight, angles = ink[ys, xs], np.arange(-most, most + step / 2, step)
    angles = angles[np.argsort(np.abs(angles), kind="stable")]
    clear = []
    for a in np.radians(angles):
        row = np.rint(ys * np.cos(a) - xs * np.sin(a)).astype(int)
        clear.append(np.bincount(row - row.min(), weight, 2 * sum(small.shape)).var())
    return float(angles[int(np.argmax(clear))])


def text_share(g: np.ndarray) -> float:
    """The share of pixels that are much darker than what surrounds them."""
    small = smaller(g, 320)
    return float((small < 0.7 * _over(small, 4, np.maximum)).mean())


def _flat(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small image and its background: ink closed over, then smoothed."""
    small = smaller(g, 256)
    reach = max(small.shape) // 24
    ground = _over(_over(small, reach, np.maximum), reach, np.minimum) if reach else small
    return small, _smooth(ground, reach + 0.5)


def faintness(g: np.ndarray) -> dict[str, float]:
    """stroke_p95, paper_px, ink_p1, as quality.needs_enhancement takes them."""
    small = smaller(g, 640)
    strokes = _over(small, 1, np.maximum) - _over(small, 1, np.minimum)
    ink, ground = _flat(g)
    paper = np.clip(ink / np.maximum(ground, 16), 0, 1)[ground >= PAPER[0]]
    return {"stroke_p95": float(np.percentile(strokes, 95)), "paper_px": float(paper.size), "ink_p1": float(np.percentile(paper, 1)) if paper.size else 0.0}


def enhanced(image: np.ndarray) -> np.ndarray:
    """Paper divided by its background and darkened by GAMMA; what is no paper stays."""
    g = grey(image)
    _, small = _flat(g)
    rows, columns = (np.minimum(np.arange(n) * m // n, m - 1) for n, m in zip(g.shape, small.shape, strict=True))
    ground = small[rows][:, columns]
    share = np.clip((ground - PAPER[0]) / (PAPER[1] - PAPER[0]), 0, 1)
    out = share * 255 * np.clip(g / np.maximum(ground, 16), 0, 1) ** GAMMA + (1 - share) * g
    return np.repeat(np.clip(out, 0, 255).astype(np.uint8)[..., None], 3, axis=2)


# Photographs from clean scans


#: What each strength does: own settings, as shares of the effect's range, pixels or degrees.
PHOTO = {
    "light": {"corners": 0.01, "turn": 1.5, "sideways": 0.0, "fade": 0.2, "curl": 0.05, "cast": 0.15, "light": 0.1, "band": 0.1, "shake": 0, "noise": 3.0},
    "medium": {"corners": 0.03, "turn": 3.0, "sideways": 0.2, "fade": 0.4, "curl": 0.1, "cast": 0.3, "light": 0.2, "band": 0.2, "shake": 5, "noise": 5.0},
    "heavy": {"corners": 0.05, "turn": 4.0, "sideways": 0.3, "fade": 0.55, "curl": 0.15, "cast": 0.4, "light": 0.3, "band": 0.3, "shake": 7, "noise": 9.0},
}
GROUNDS = ["boards", "weave", "desk"]


def clouds(rng: np.random.Generator, height: int, width: int, cell: int) -> np.ndarray:
    """Smooth noise from 0 to 1: random values at the corners of cells, eased between them."""
    grid = rng.random((height // cell + 2, width // cell + 2))
    parts = []
    for n in (height, width):
        at = np.arange(n) / cell
        parts.append((at.astype(int), (t := at % 1) * t * (3 - 2 * t)))
    (y, v), (x, u) = parts
    rows = grid[y] * (1 - v)[:, None] + grid[y + 1] * v[:, None]
    out = rows[:, x] * (1 - u) + rows[:, x + 1] * u
    return (out - out.min()) / max(np.ptp(out), 1e-9)


def faded(image: np.ndarray, rng: np.random.Generator, share: float) -> np.ndarray:
    """Ink lost in patches and columns; white stays white, and a fifth of the ink at least."""
    height, width = image.shape[:2]
    left = 1 - share * clouds(rng, height, width, 48) ** 1.5 - 0.4 * share * np.repeat(rng.random(-(-width // 6)), 6)[:width]
    return 255 - (255 - image) * np.maximum(left, 0.2)[..., None]


def curled(image: np.ndarray, rng: np.random.Generator, share: float) -> np.ndarray:
    """Warm paper, darker towards its sides."""
    tint = np.array([1.0, rng.uniform(0.96, 0.99), rng.uniform(0.9, 0.95)])
    return image * tint * (1 - share * np.abs(np.linspace(-1, 1, image.shape[1])) ** 2)[:, None]


def ground(rng: np.random.Generator, height: int, width: int) -> tuple[np.ndarray, str]:
    """What lies below the paper, and its name."""
    kind = GROUNDS[rng.integers(len(GROUNDS))]
    colour = rng.uniform(50, 150) * np.array([1.0, rng.uniform(0.75, 0.95), rng.uniform(0.55, 0.9)])
    y, x = np.mgrid[:height, :width]
    grain = {"boards": lambda: 0.2 * np.sin(y / 9 + 6 * clouds(rng, height, width, 90)), "weave": lambda: 0.1 * ((x // 2 + y // 2) % 2 - 0.5), "desk": lambda: np.zeros((height, width))}[kind]()
    return np.clip(colour * (1 + grain + 0.15 * (clouds(rng, height, width, 60) - 0.5))[..., None] + rng.normal(0, 2, (height, width, 1)), 0, 255), kind


def laid(image: np.ndarray, rng: np.random.Generator, p: dict) -> tuple[np.ndarray, str]:
    """The paper on a ground: its corners moved, turned a little, with a shadow below."""
    h, w = image.shape[:2]
    size = np.array([w + 2 * (w // 5 + 8), h + 2 * (h // 10 + 8)])
    under, kind = ground(rng, size[1], size[0])
    frame = np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
    a = np.radians(rng.uniform(-p["turn"], p["turn"]))
    moved = (frame - [w / 2, h / 2] + rng.uniform(-1, 1, (4, 2)) * p["corners"] * [w, h]) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + size / 2
    # The projection from the photograph back to the paper: eight numbers from four corners.
    left, right = [], []
    for (x, y), (u, v) in zip(moved, frame, strict=True):
        left += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    m = np.append(np.linalg.solve(np.array(left), np.array(right)), 1).reshape(3, 3)
    y, x = np.mgrid[: size[1], : size[0]]
    u, v, s = np.tensordot(m, np.stack((x + 0.5, y + 0.5, np.ones_like(x))), 1)
    u, v = u / s - 0.5, v / s - 0.5
    inside = ((u >= -0.5) & (u < w - 0.5) & (v >= -0.5) & (v < h - 0.5)).astype(float)
    i, j = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    x0, y0 = np.minimum(i.astype(int), max(w - 2, 0)), np.minimum(j.astype(int), max(h - 2, 0))
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), (i - x0)[..., None], (j - y0)[..., None]
    paper = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    shadow = _smooth(np.roll(inside, (6, 5), (0, 1)), max(1.0, size.max() / 80))
    edge = inside[..., None]
    return under * (1 - p["cast"] * shadow)[..., None] * (1 - edge) + paper * edge, kind


def lit(image: np.ndarray, rng: np.random.Generator, share: float, band: float) -> np.ndarray:
    """Brighter on one side than on the other, and a soft dark band across."""
    height, width = image.shape[:2]

    def ramp(a: float) -> np.ndarray:
        d = np.arange(width) * np.cos(a) + (np.arange(height) * np.sin(a))[:, None]
        return (d - d.min()) / max(np.ptp(d), 1e-9)

    out = image * (1 + share * (ramp(rng.uniform(0, 2 * np.pi)) - 0.5))[..., None]
    across = (ramp(rng.uniform(0, np.pi)) - rng.uniform(0.25, 0.75)) / rng.uniform(0.07, 0.16)
    return out * (1 - band * np.exp(-(across**2)))[..., None]


def shaken(image: np.ndarray, rng: np.random.Generator, pixels: int) -> np.ndarray:
    """The mean of the image moved along a line of so many pixels; under three change nothing."""
    if pixels < 3:
        return image
    a, along = rng.uniform(0, np.pi), np.arange(pixels) - (pixels - 1) / 2
    steps = {(round(d * np.sin(a)), round(d * np.cos(a))) for d in along}
    reach = pixels
    padded = np.pad(image, ((reach, reach), (reach, reach), (0, 0)), mode="edge")
    h, w = image.shape[:2]
    return sum(padded[reach + dy : reach + dy + h, reach + dx : reach + dx + w] for dy, dx in steps) / len(steps)


def photograph(image: np.ndarray, name: str, strength: str, seed: int = 42) -> tuple[np.ndarray, dict]:
    """A photograph of a scan, and what was done.  It depends on the seed, the name and the strength, not on other images."""
    rng, p = np.random.default_rng(list(hashlib.sha256(f"{seed}:{name}:{strength}".encode()).digest())), PHOTO[strength]
    x, kind = laid(curled(faded(image.astype(float), rng, p["fade"]), rng, p["curl"]), rng, p)
    turns = int(rng.choice([1, 3])) if rng.random() < p["sideways"] else 0
    x = shaken(lit(np.rot90(x, turns), rng, p["light"], p["band"]), rng, p["shake"])
    x = x + rng.normal(0, p["noise"], x.shape)
    return np.clip(x, 0, 255).astype(np.uint8), {"bg": kind, "rot90_applied": 90 * turns}


# In Spark


_METRICS = ["width", "height", "brightness", "sharpness", "tilt", "text_area", "stroke_p95", "paper_px", "ink_p1"]


def measured(images: DataFrame, content: str = "content") -> DataFrame:
    """images (PNG bytes) with a struct of metrics; nulls where an image can't be read."""

    @F.pandas_udf(", ".join(f"{m} double" for m in _METRICS))
    def measure(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            image = read_png(x) if x is not None else None
            if image is None:
                rows.append(dict.fromkeys(_METRICS))
                continue
            g = grey(image)
            rows.append({"width": image.shape[1], "height": image.shape[0], "brightness": g.mean(), "sharpness": sharpness(g), "tilt": tilt(g), "text_area": text_share(g)} | faintness(g))
        return pd.DataFrame(rows, columns=_METRICS, dtype="float64")

    return images.withColumn("metrics", measure(content))


def photographed(images: DataFrame, seed: int = 42, strengths: list[str] | None = None) -> DataFrame:
    """images: image (a name), content (PNG).  A row an image and strength: content (PNG), bg, rot90_applied; unreadable ones have nulls."""

    @F.pandas_udf("content binary, bg string, rot90_applied int")
    def make(name: pd.Series, strength: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = []
        for n, s, x in zip(name, strength, data, strict=True):
            image = read_png(x) if x is not None else None
            made, about = photograph(image, n, s, seed) if image is not None else (None, {"bg": None, "rot90_applied": None})
            rows.append((None if made is None else write_png(made), about["bg"], about["rot90_applied"]))
        return pd.DataFrame(rows, columns=["content", "bg", "rot90_applied"]).astype({"rot90_applied": "Int32"})

    d = images.select("image", "content", F.explode(F.array(*map(F.lit, strengths or fixed.STRENGTHS))).alias("strength"))
    return d.withColumn("_p", make("image", "strength", "content")).select("image", "strength", "_p.content", "_p.bg", "_p.rot90_applied")
