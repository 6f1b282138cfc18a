"""Features of image regions: numpy in Arrow batches, verdicts native.

A raster is a struct (h, w, c, data): rows first, c channels of one byte,
blue first where there are three.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import dates, geometry, images
from attestor.functions.images import grey, otsu
from attestor.sources import templates

FEATURES = T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("ink_ratio", "ink_share", "variance")), T.StructField("error", T.StringType())])
RASTER = "struct<h: int, w: int, c: int, data: binary>"
RASTER_TYPE = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("h", "w", "c")), T.StructField("data", T.BinaryType())])
PREPARED = f"struct<raster: {RASTER}, skipped: array<string>, error: string>"
#: Pixels (or levels) of pictures that are taken together.
STACK = 1 << 18
#: Share of the radius that counts as the inside of a mark.
INSIDE = 0.65
# The steps of a field type's preparation.
PIPELINES = {
    "TEXT": (("resize", 2.0), ("grayscale", None), ("denoise", None), ("contrast", None)), "NAME": (("resize", 2.0), ("grayscale", None), ("denoise", None), ("contrast", None)), "ADDRESS": (("resize", 2.0), ("grayscale", None), ("denoise", None), ("contrast", None)),
    "NUMBER": (("resize", 3.0), ("grayscale", None), ("threshold", None)), "DATE": (("resize", 3.0), ("grayscale", None), ("threshold", None)),
    "CHECKBOX": (("grayscale", None), ("threshold", None)), "SIGNATURE": (("grayscale", None), ("threshold", None)), "DEFAULT": (("resize", 2.0), ("grayscale", None), ("contrast", None)),
}


def array_of(raster: dict) -> np.ndarray:
    # beside null rasters pandas has sizes as floats
    h, w, c = (int(raster[k]) for k in ("h", "w", "c"))
    shape = (h, w) if c == 1 else (h, w, c)
    return np.frombuffer(raster["data"], np.uint8).reshape(shape)


def raster_of(x: np.ndarray | None) -> dict:
    return dict.fromkeys(("h", "w", "c", "data")) if x is None else {"h": x.shape[0], "w": x.shape[1], "c": 1 if x.ndim == 2 else x.shape[2], "data": np.ascontiguousarray(x, np.uint8).tobytes()}


def threshold(x: np.ndarray) -> np.ndarray:
    x = grey(x)
    return np.where(x > otsu(x), 255, 0).astype(np.uint8)


@lru_cache(256)
def _inside(h: int, w: int) -> np.ndarray:
    """The pixels inside a mark's circle."""
    rows, cols = np.ogrid[:h, :w]
    inside = np.hypot(rows - h / 2, cols - w / 2) <= min(h, w) / 2 * INSIDE
    return inside if inside.any() else np.ones_like(inside)


def ink_ratio(x: np.ndarray) -> float:
    """Share of ink inside a mark's circle; its printed ring is left out."""
    if not x.size:
        return 0.0
    return float((threshold(x) == 0)[_inside(*x.shape[:2])].mean())


def ink_share(x: np.ndarray) -> float:
    return float((threshold(x) == 0).mean())


def adaptive_threshold(x: np.ndarray, size: int = 25, offset: float = 15) -> np.ndarray:
    """White where a grey image is above its Gaussian mean less the offset;
    the border is repeated."""
    x = grey(x)
    at, sigma = np.arange(size) - size // 2, 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weight = np.exp(-(at**2) / (2 * sigma**2))
    mean = np.pad(x.astype(float), size // 2, mode="edge")
    for axis in (0, 1):
        mean = np.apply_along_axis(np.convolve, axis, mean, weight / weight.sum(), "valid")
    return np.where(x > np.rint(mean) - offset, 255, 0).astype(np.uint8)


def sharpen(x: np.ndarray) -> np.ndarray:
    p = np.pad(x.astype(int), ((1, 1), (1, 1), *[(0, 0)] * (x.ndim - 2)), mode="reflect")
    return np.clip(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:], 0, 255).astype(np.uint8)


#: Steps by name; others can be registered here.
STEPS = {
    "resize": images.resize, "grayscale": lambda x, _: grey(x), "denoise": lambda x, _: images.denoise(x), "contrast": lambda x, _: images.contrast(x), "deskew": lambda x, _: images.deskew(x),
    "threshold": lambda x, _: threshold(x), "adaptive_threshold": lambda x, _: adaptive_threshold(x), "sharpen": lambda x, _: sharpen(x), "swap_channels": lambda x, _: x[..., ::-1],
}


def prepare(x: np.ndarray, field_type: str) -> tuple[np.ndarray, list[str]]:
    """The prepared image, and the names of steps that no backend offers."""
    skipped = []
    for name, value in PIPELINES.get(field_type, PIPELINES["DEFAULT"]):
        if name in STEPS:
            x = STEPS[name](x, value)
        else:
            skipped.append(name)
    return x, skipped


def crop(x: np.ndarray, bounds: list[int]) -> np.ndarray | None:
    x0, y0, x1, y1 = bounds
    return x[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else None


def _features(stack: np.ndarray) -> np.ndarray:
    """ink_ratio, ink_share and variance of each picture of a stack of one shape."""
    x = stack if stack.ndim == 3 else grey(stack)
    n, h, w = x.shape
    ink = x <= images.otsu_each(x)[:, None, None]
    return np.stack([ink[:, _inside(h, w)].mean(axis=1), ink.reshape(n, -1).mean(axis=1), x.reshape(n, -1).var(axis=1)], axis=1)


@F.pandas_udf(FEATURES)
def features(rasters: pd.DataFrame) -> pd.DataFrame:
    """Numbers of each raster; a broken one has an error and no numbers.  Pictures of one shape are taken together."""
    out: list[tuple] = [(None, None, None, None)] * len(rasters)
    shapes: dict[tuple, list[int]] = {}
    arrays: dict[int, np.ndarray] = {}
    for i, raster in enumerate(rasters.to_dict("records")):
        try:
            x = array_of(raster)
            if x.size:
                arrays[i] = x
                shapes.setdefault(x.shape, []).append(i)
            else:
                out[i] = (0.0, None, None, None)
        except Exception as e:
            out[i] = (None, None, None, str(e))
    for shape, at in shapes.items():
        most = max(1, STACK // max(256, math.prod(shape)))
        for lo in range(0, len(at), most):
            part = at[lo : lo + most]
            try:
                for i, numbers in zip(part, _features(np.stack([arrays[i] for i in part])).tolist(), strict=True):
                    out[i] = (*numbers, None)
            except Exception as e:
                for i in part:
                    out[i] = (None, None, None, str(e))
    return pd.DataFrame(out, columns=["ink_ratio", "ink_share", "variance", "error"])


def crops(pages: DataFrame, rois: DataFrame) -> DataFrame:
    """Regions of pages (document, page, raster, native_w, native_h) as rasters; an
    empty one is null.  Pages that name their template (template_id) have the
    regions of that one alone."""
    joined = templates.beside(pages, rois.where("box IS NOT NULL"), "page")
    scaled = geometry.scale_box(F.col("box"), F.col("native_w"), F.col("native_h"), F.col("raster.w").cast("double"), F.col("raster.h").cast("double"))
    bounds = geometry.crop_bounds(scaled, F.col("raster.w"), F.col("raster.h"))

    @F.pandas_udf(RASTER)
    def cut(rasters: pd.DataFrame, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([raster_of(crop(array_of(r), list(b))) for r, b in zip(rasters.to_dict("records"), at, strict=True)], columns=["h", "w", "c", "data"])

    return joined.withColumn("crop", dates.let(cut("raster", bounds), lambda x: F.when(x["h"].isNotNull(), x)))


def prepared(regions: DataFrame) -> DataFrame:
    """Adds prepared (raster, skipped, error): each crop after the steps of its
    field_type, with the names of steps that no backend offers."""

    @F.pandas_udf(PREPARED)
    def steps(rasters: pd.DataFrame, field_types: pd.Series) -> pd.DataFrame:
        def each(raster: dict, field_type: str) -> tuple:
            try:
                if raster["data"] is None:
                    return None, [], None
                x, skipped = prepare(array_of(raster), field_type)
                return raster_of(x), skipped, None
            except Exception as e:
                return None, [], str(e)

        return pd.DataFrame([each(r, t) for r, t in zip(rasters.to_dict("records"), field_types, strict=True)], columns=["raster", "skipped", "error"])

    return regions.withColumn("prepared", steps("crop", "field_type"))


@F.pandas_udf(T.BinaryType())
def png(rasters: pd.DataFrame) -> pd.Series:
    """PNG bytes of each raster; null for a null one."""
    return pd.Series([None if r["data"] is None else images.to_png(array_of(r)) for r in rasters.to_dict("records")])


@F.pandas_udf(RASTER_TYPE)
def from_png(files: pd.Series) -> pd.DataFrame:
    """Rasters of PNG bytes; all fields are null for null or unreadable ones."""

    def each(data: bytes | None) -> dict:
        try:
            return raster_of(None if data is None else images.from_png(data))
        except (ValueError, zlib.error):
            return raster_of(None)

    return pd.DataFrame([each(f) for f in files], columns=["h", "w", "c", "data"])


def presence(found: DataFrame, kind: Column) -> Column:
    """Verdict by the kind of region, from the features."""
    return F.when(kind == "PHOTO", geometry.detect_photo(F.col("variance"))).otherwise(geometry.detect_ink(F.col("ink_share")))
