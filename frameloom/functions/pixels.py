"""Pixel work: gray images as long tables in SQL, or as arrays in numpy for the pluggable stages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gray(rgb: Column) -> Column:
    """0..255 brightness of a packed 24-bit colour."""
    part = lambda shift: F.shiftright(rgb, shift).bitwiseAND(F.lit(255))
    return (0.299 * part(16) + 0.587 * part(8) + 0.114 * part(0)).cast("int")


def laplacian_variance(pixels: DataFrame, image: str = "image_id") -> DataFrame:
    """image, sharpness: variance of the 4-neighbour Laplacian over inner pixels of (image, x, y, g); 0 without any."""
    row, column = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    near = [F.lag("g").over(row), F.lead("g").over(row), F.lag("g").over(column), F.lead("g").over(column)]
    lap = (near[0] + near[1] + near[2] + near[3] - 4 * F.col("g")).cast("double")
    mean, square = F.avg("lap"), F.avg(F.col("lap") * F.col("lap"))
    return pixels.withColumn("lap", lap).groupBy(image).agg(F.coalesce(F.greatest(square - mean * mean, F.lit(0.0)), F.lit(0.0)).alias("sharpness"))


def blur_score(gray_rows: np.ndarray) -> float:
    """The same for one image of rows of gray values."""
    g = np.asarray(gray_rows, np.float64)
    if g.ndim != 2 or min(g.shape) < 3:
        return 0.0
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(max(0.0, (lap * lap).mean() - lap.mean() ** 2))


def resized(image: np.ndarray, longest: int) -> np.ndarray:
    """Down to a longest side by nearest pixels; never up."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = longest / max(h, w)
    nh, nw = max(1, int(h * scale)), max(1, int(w * scale))
    return image[(np.arange(nh) * h // nh)[:, None], np.arange(nw) * w // nw]


def small_upright(w: int, h: int, gray_values, rotation: int, longest: int = 640) -> tuple[int, int, list[int]]:
    """A frame's width, height and values, turned clockwise by a multiple of 90 degrees and no larger than longest."""
    image = resized(np.rot90(np.asarray(gray_values, np.int64).reshape(h, w), -(rotation // 90) % 4), longest)
    return image.shape[1], image.shape[0], image.reshape(-1).tolist()


def embed_square(box: tuple[int, int, int, int], w: int, h: int, expand: float = 0.2) -> tuple[int, int, int, int]:
    """l, t, w, h of the square that an embedder sees of a box (left, top, right, bottom), as scalar.embed_rect()."""
    f = np.float32
    side = f(max(box[2] - box[0], box[3] - box[1], 0)) * (f(1) + f(expand))

    def along(low: int, high: int, size: int) -> tuple[int, int]:
        start = min(max(int(f(low + high) / f(2) - side / f(2)), 0), size - 1)
        end = min(max(int(f(start) + side), start + 1), size)
        start = max(int(f(end) - side), 0)
        return start, end - start

    (l, width), (t, height) = along(box[0], box[2], w), along(box[1], box[3], h)
    return l, t, width, height


def face_crop(image: np.ndarray, rect: tuple[int, int, int, int], roll: float = 0.0, size: int = 112) -> np.ndarray:
    """The rect (l, t, w, h) of an image, turned upright if it is tilted by 15 degrees or more, as size x size, by nearest pixels."""
    l, t, w, h = rect
    part = image[t : t + h, l : l + w]
    if abs(roll) < 15:
        return part[(np.arange(size) * h // size)[:, None], np.arange(size) * w // size]
    sin, cos = np.sin(np.radians(roll)), np.cos(np.radians(roll))
    # The turned part's frame holds all of it; what lies outside the part is 0.
    big_w, big_h = abs(w * cos) + abs(h * sin), abs(w * sin) + abs(h * cos)
    y, x = np.meshgrid((np.arange(size) + 0.5) / size * big_h - big_h / 2, (np.arange(size) + 0.5) / size * big_w - big_w / 2, indexing="ij")
    at_x, at_y = np.floor(x * cos - y * sin + w / 2).astype(int), np.floor(x * sin + y * cos + h / 2).astype(int)
    inside = (at_x >= 0) & (at_x < w) & (at_y >= 0) & (at_y < h)
    out = part[at_y.clip(0, h - 1), at_x.clip(0, w - 1)]
    return np.where(inside if out.ndim == 2 else inside[..., None], out, 0)


def laplacian_variance_of(gray_values: Column, wide: int, high: int) -> Column:
    """The same as laplacian_variance for an image in one array, row by row: no shuffle."""
    inner = [y * wide + x for y in range(1, high - 1) for x in range(1, wide - 1)]
    if not inner:
        return F.lit(0.0)
    at = lambda i: F.get(gray_values, i)
    laps = F.transform(F.array(*[F.lit(i) for i in inner]), lambda i: (at(i - 1) + at(i + 1) + at(i - wide) + at(i + wide) - 4 * at(i)).cast("double"))
    sums = F.aggregate(laps, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    return F.get(F.transform(F.array(sums), lambda a: F.greatest(a["q"] / len(inner) - a["s"] / len(inner) * a["s"] / len(inner), F.lit(0.0))), 0)


def sharpness_of(image: np.ndarray, region: tuple[int, int, int, int] | None = None, longest: int = 160) -> float:
    """Blur score of a region (left, top, right, bottom, clamped) of an image, downscaled first."""
    if region:
        h, w = image.shape[:2]
        l, t = (min(max(v, 0), m - 1) for v, m in zip(region[:2], (w, h), strict=True))
        r, b = (min(max(v, low + 1), m) for v, low, m in zip(region[2:], (l, t), (w, h), strict=True))  # a pixel at least
        image = image[t:b, l:r]
    if image.ndim == 3:
        image = (image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.int64)
    return blur_score(resized(image, longest)) if image.size else 0.0


def model_input(crop: np.ndarray) -> np.ndarray:
    """RGB 0..255 to -1..1, channels interleaved."""
    return (np.asarray(crop, np.float32) / np.float32(127.5) - np.float32(1)).reshape(-1)
