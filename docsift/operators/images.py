"""Cleaning page images before character recognition: kernels for arrays, and the same steps on pixel tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grayscale(rgb: np.ndarray) -> np.ndarray:
    """Luma of an (h, w, 3) array, halves rounded up."""
    r, g, b = (rgb[..., k].astype("float64") for k in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).clip(0, 255).astype("uint8")


def upscale(image: np.ndarray, below: int = 1_500, factor: int = 2) -> np.ndarray:
    """Twice the size, bilinear, if the image is narrower than ``below``."""
    h, w = image.shape[:2]
    if w >= below:
        return image
    y = ((np.arange(h * factor) + 0.5) / factor - 0.5).clip(0, h - 1)
    x = ((np.arange(w * factor) + 0.5) / factor - 0.5).clip(0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    dy, dx = (y - y0)[:, None], (x - x0)[None, :]
    if image.ndim == 3:
        dy, dx = dy[..., None], dx[..., None]
    f = image.astype("float64")
    top = f[y0][:, x0] * (1 - dx) + f[y0][:, x1] * dx
    low = f[y1][:, x0] * (1 - dx) + f[y1][:, x1] * dx
    return np.floor(top * (1 - dy) + low * dy + 0.5).clip(0, 255).astype("uint8")


def median3x3(gray: np.ndarray) -> np.ndarray:
    """The median of each pixel's 3x3 neighbourhood; the border stays."""
    out = gray.copy()
    h, w = gray.shape
    if h < 3 or w < 3:
        return out
    near = np.stack([gray[dy : h - 2 + dy, dx : w - 2 + dx] for dy in range(3) for dx in range(3)])
    out[1:-1, 1:-1] = np.partition(near, 4, axis=0)[4]
    return out


def otsu(gray: np.ndarray) -> int:
    """The threshold of the greatest variance between the classes, the smallest of equals; 0 for a uniform image."""
    count = np.bincount(gray.ravel(), minlength=256).astype("float64")
    level = np.arange(256) * count
    dark, below = np.cumsum(count), np.cumsum(level)
    light = count.sum() - dark
    with np.errstate(divide="ignore", invalid="ignore"):
        between = dark * light * (below / dark - (level.sum() - below) / light) ** 2
    between[(dark == 0) | (light == 0)] = 0.0
    return int(np.argmax(between)) if between.max() > 0 else 0


def binarize(gray: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(gray > threshold, 255, 0).astype("uint8")


def preprocess(rgb: np.ndarray) -> np.ndarray:
    """Upscale, gray, median, Otsu, black and white."""
    gray = median3x3(grayscale(upscale(rgb)))
    return binarize(gray, otsu(gray))


def pixel_grayscale(pixels: DataFrame) -> DataFrame:
    """``r, g, b`` of a pixel table as ``gray``."""
    return pixels.withColumn("gray", F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int")).drop("r", "g", "b")


def pixel_histogram(pixels: DataFrame) -> DataFrame:
    """``(image_id, level, n)`` of the levels that occur."""
    return pixels.groupBy("image_id", F.col("gray").alias("level")).agg(F.count("*").alias("n"))


def pixel_median3x3(pixels: DataFrame) -> DataFrame:
    """``image_id, y, x, gray`` with inner pixels replaced by the median of their neighbourhood.

    Every pixel is sent to its nine neighbours, and the middle of nine values is taken: one shuffle on the pixel.
    """
    off = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    sent = pixels.select("image_id", "y", "x", "gray", F.explode(off).alias("o")).select(
        "image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "gray", ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("own")
    )
    near = sent.groupBy("image_id", "y", "x").agg(F.sort_array(F.collect_list("gray")).alias("g"), F.max(F.when(F.col("own"), F.col("gray"))).alias("own"))
    return near.filter("own is not null").select("image_id", "y", "x", F.when(F.size("g") == 9, F.col("g")[4]).otherwise(F.col("own")).alias("gray"))


def pixel_otsu(pixels: DataFrame) -> DataFrame:
    """``(image_id, threshold)`` by prefix sums over each image's histogram."""
    upto = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    h = pixel_histogram(pixels).withColumns({
        "dark": F.sum("n").over(upto).cast("double"), "below": F.sum(F.col("n") * F.col("level")).over(upto).cast("double"),
        "total": F.sum("n").over(whole).cast("double"), "mass": F.sum(F.col("n") * F.col("level")).over(whole).cast("double"),
    })
    light = F.col("total") - F.col("dark")
    apart = F.col("below") / F.col("dark") - F.try_divide(F.col("mass") - F.col("below"), light)
    h = h.withColumn("between", F.when(light > 0, F.col("dark") * light * apart * apart).otherwise(0.0))
    best = h.groupBy("image_id").agg(F.max(F.struct("between", (-F.col("level")).alias("l"))).alias("b"))
    return best.select("image_id", F.when(F.col("b.between") > 0, -F.col("b.l")).otherwise(0).cast("int").alias("threshold"))


def pixel_binarize(pixels: DataFrame) -> DataFrame:
    """``image_id, y, x, gray`` as 0 or 255 by each image's threshold."""
    return pixels.join(pixel_otsu(pixels), "image_id").select("image_id", "y", "x", F.when(F.col("gray") > F.col("threshold"), 255).otherwise(0).alias("gray"))
