"""Image kernels on numpy arrays, and their use over ``binaryFile`` rows.

Arrays are uint8, grey (H, W) or blue-green-red (H, W, 3).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold that parts grey levels with the largest variance between both sides."""
    p = np.bincount(image.ravel(), minlength=256) / image.size
    w, m = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return int(np.argmax(np.nan_to_num(between)))


def rotate(image: np.ndarray, degrees: float, border: int, linear: bool = True) -> np.ndarray:
    """Rotation about the centre, counter-clockwise, same size; outside is ``border``."""
    h, w = image.shape[:2]
    t = np.deg2rad(degrees)
    c, s = np.cos(t), np.sin(t)
    cx, cy = w // 2, h // 2
    y, x = np.mgrid[0:h, 0:w].astype(float)
    # The source of each pixel: the inverse rotation.
    sx, sy = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy

    def at(iy: np.ndarray, ix: np.ndarray) -> np.ndarray:
        ok = (iy >= 0) & (iy < h) & (ix >= 0) & (ix < w)
        got = image[np.clip(iy, 0, h - 1), np.clip(ix, 0, w - 1)].astype(float)
        return np.where(ok if image.ndim == 2 else ok[..., None], got, border)

    if not linear:
        return at(np.rint(sy).astype(int), np.rint(sx).astype(int)).astype(np.uint8)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def skew_angle(image: np.ndarray, reach: float = 10.0, step: float = 0.5) -> float:
    """The rotation whose row sums of ink vary most; the first of equals."""
    ink = np.where(image > otsu(image), 0, 255).astype(np.uint8)
    best, most = 0.0, -1.0
    for angle in np.arange(-reach, reach + step, step):
        variance = float(rotate(ink, float(angle), 0, linear=False).sum(axis=1, dtype=np.float64).var())
        if variance > most:
            best, most = float(angle), variance
    return best


def deskew(image: np.ndarray, reach: float = 10.0, step: float = 0.5) -> np.ndarray:
    return rotate(image, skew_angle(grey(image), reach, step), 255)


def _box_sums(a: np.ndarray, size: int) -> np.ndarray:
    total = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


def sauvola(image: np.ndarray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Local threshold mean * (1 + k * (deviation / 127.5 - 1)); pixels below it (ink) become 255."""
    half = window // 2
    a = np.pad(image.astype(float), half, mode="reflect" if min(image.shape) > half else "edge")
    n = window * window
    mean = _box_sums(a, window) / n
    deviation = np.sqrt(np.maximum(_box_sums(a * a, window) / n - mean * mean, 0))
    return np.where(image < mean * (1 + k * (deviation / 127.5 - 1)), 255, 0).astype(np.uint8)


def saturation(image: np.ndarray) -> np.ndarray:
    top, low = image.max(2).astype(float), image.min(2).astype(float)
    return np.rint(np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)).astype(np.uint8)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation by a disc, row by row of the disc."""
    if radius <= 0:
        return mask
    h, w = mask.shape
    out = np.zeros_like(mask)
    counts = np.pad(np.cumsum(np.pad(mask, ((0, 0), (radius, radius))), axis=1), ((0, 0), (1, 0)))
    for dy in range(-radius, radius + 1):
        half = int(np.rint(np.sqrt(radius * radius - dy * dy)))
        near = counts[:, radius + half + 1 : radius + half + 1 + w] - counts[:, radius - half : radius - half + w] > 0
        out[max(0, dy) : h + min(0, dy)] |= near[max(0, -dy) : h + min(0, -dy)]
    return out


def mask_color(image: np.ndarray, binary: np.ndarray, threshold: int = 60, radius: int = 15) -> np.ndarray:
    """``binary`` with strongly coloured regions of ``image``, widened by ``radius``, set to 255."""
    return np.where(dilate(saturation(image) > threshold, radius), 255, binary).astype(np.uint8)


def equalize(channel: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of one channel, blended between tiles."""
    h, w = channel.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    a = np.pad(channel, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= max(th, tw) else "edge")
    limit = max(1, int(clip * th * tw / 256))
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(a[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + over // 256
            spare = over % 256
            if spare:
                hist[:: max(1, 256 // spare)][:spare] += 1
            maps[i, j] = np.cumsum(hist) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda r, c: maps[np.clip(r, 0, tiles - 1)[:, None], np.clip(c, 0, tiles - 1)[None, :], channel]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# sRGB to CIE XYZ (D65) and its white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def _to_lab(image: np.ndarray) -> np.ndarray:
    rgb = image[..., ::-1] / 255.0
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def _from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], -1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, 1)
    rgb = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(rgb * 255), 0, 255).astype(np.uint8)[..., ::-1]


def enhance(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Local contrast on lightness only; colours stay. A grey image is its own lightness."""
    if image.ndim == 2:
        return equalize(image, clip, tiles)
    lab = _to_lab(image)
    light = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.uint8)
    lab[..., 0] = equalize(light, clip, tiles) / 2.55
    return _from_lab(lab)


def prepare(image: np.ndarray, straighten: bool = True, contrast: bool = True, local: bool = True, mask: bool = True) -> np.ndarray:
    """Deskew, contrast, binarise, mask colours, each optional.

    The local threshold makes ink 255, the global one 0, and masked regions are
    255 in either: known and kept. A grey image has no colours to mask.
    """
    if straighten:
        image = deskew(image)
    if contrast:
        image = enhance(image)
    g = grey(image)
    binary = sauvola(g) if local else np.where(g > otsu(g), 255, 0).astype(np.uint8)
    return mask_color(image, binary) if mask and image.ndim == 3 else binary


def prepare_files(files: DataFrame, decode: Callable[[bytes], np.ndarray | None], **stages: bool) -> DataFrame:
    """(path, height, width, pixels) of ``binaryFile`` rows; ``decode`` turns bytes into an array.

    A file that it can't decode raises an error that names it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                image = decode(bytes(content))
                if image is None:
                    raise ValueError(f"can't decode {path}")
                out = prepare(image, **stages)
                rows.append((path, *out.shape, out.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels"])

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, pixels binary")


def decode_pgm(content: bytes) -> np.ndarray | None:
    """Binary PGM and PPM, which need no library; PPM comes back blue-green-red."""
    head = content.split(None, 4)
    if len(head) < 5 or head[0] not in (b"P5", b"P6"):
        return None
    w, h = int(head[1]), int(head[2])
    n = 3 if head[0] == b"P6" else 1
    pixels = np.frombuffer(content[len(content) - w * h * n :], np.uint8)
    return pixels.reshape(h, w) if n == 1 else pixels.reshape(h, w, 3)[..., ::-1]
