"""Gray-image steps before recognition, in numpy inside Arrow batches: an image is a row (w, h, pixels)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------------------------

#: Medians and pixels below these are dark; a checkbox lies so many points beside the start of its option.
DARK_MEDIAN, BOX_DARK = 110, 220
BOX_ACROSS, BOX_DOWN, BOX_SCALE = (-14, -6), (-3, 5), 1.5


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, samples aligned at the top left, edges repeated, halves rounded up."""
    h, w = image.shape
    if not image.size:
        return np.zeros((height, width), np.uint8)
    ys, xs = np.arange(height) * (h / height), np.arange(width) * (w / width)
    y0, x0 = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    source = image.astype(float)
    rows = lambda y: (1 - fx) * source[y][:, x0] + fx * source[y][:, x1]
    return np.floor((1 - fy) * rows(y0) + fy * rows(y1) + 0.5).astype(np.uint8)


def blurred(image: np.ndarray, radius: int) -> np.ndarray:
    """Box means along rows, then columns, edges repeated, each cut to whole numbers."""
    if radius <= 0 or not image.size:
        return image
    r = min(radius, min(image.shape) // 2)

    def along(a: np.ndarray) -> np.ndarray:
        sums = np.cumsum(np.pad(a.astype(np.int64), ((0, 0), (r + 1, r)), mode="edge"), axis=1)
        return (sums[:, 2 * r + 1 :] - sums[:, : -(2 * r + 1)]) // (2 * r + 1)

    return along(along(image).T).T.astype(np.uint8)


def flattened(image: np.ndarray) -> np.ndarray:
    """Each pixel over the blurred background around it, 255 for as bright as that."""
    if not image.size:
        return image
    background = blurred(image, max(9, (min(image.shape) // 25) | 1))
    return np.clip(image / (background + 1e-6) * 255.0, 0, 255).astype(np.uint8)


def binarised(image: np.ndarray, window: int = 25, k: float = 0.2) -> np.ndarray:
    """Sauvola's local threshold by integral images; a tiny image is cut at its mean.

    The pixel count of a window is cut at the low edges alone, so thresholds fall towards the right and lower edges.
    """
    if not image.size:
        return image
    h, w = image.shape
    window = min(window | 1, (min(w, h) - 1) | 1)
    if window < 3:
        return np.where(image > image.astype(np.int64).sum() // image.size, 255, 0).astype(np.uint8)
    r = window // 2
    v = image.astype(np.int64)
    one, two = (np.pad(np.cumsum(np.cumsum(a, axis=0), axis=1), ((1, 0), (1, 0))) for a in (v, v * v))
    y, x = np.arange(h), np.arange(w)
    y0, x0, y1, x1 = np.maximum(0, y - r), np.maximum(0, x - r), y + r + 1, x + r + 1
    n = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    top, bottom, left, right = y0[:, None], np.minimum(h, y1)[:, None], x0[None, :], np.minimum(w, x1)[None, :]
    sums = [t[bottom, right] - t[top, right] - t[bottom, left] + t[top, left] for t in (one, two)]
    mean = sums[0] / n
    spread = np.sqrt(np.maximum(0.0, sums[1] / n - mean * mean))
    return np.where(image > mean * (1 + k * (spread / 128.0 - 1.0)), 255, 0).astype(np.uint8)


def is_dark(image: np.ndarray) -> bool:
    """Whether the (upper) median is below 110."""
    return bool(image.size) and int(np.partition(image.ravel(), image.size // 2)[image.size // 2]) < DARK_MEDIAN


def inverted(image: np.ndarray) -> np.ndarray:
    return 255 - image


def dark_sums(page: np.ndarray) -> np.ndarray:
    """The summed-area table of dark pixels: [y, x] counts those above and left of (x, y)."""
    sums = np.zeros((page.shape[0] + 1, page.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(page < BOX_DARK, axis=0), axis=1, out=sums[1:, 1:])
    return sums


def dark_ratio(sums: np.ndarray, x: float, y: float, scale: float = BOX_SCALE) -> float:
    """The share of dark pixels (by dark_sums) in the checkbox left of an option that begins at (x, y) in points; corners are rounded, halves up."""
    at = lambda v, most: min(max(int(np.floor(v * scale + 0.5)), 0), most)
    (left, right), (top, bottom) = ([at(c + d, most) for d in span] for c, span, most in ((x, BOX_ACROSS, sums.shape[1] - 1), (y, BOX_DOWN, sums.shape[0] - 1)))
    if right <= left or bottom <= top:
        return 0.0
    return float(sums[bottom, right] - sums[top, right] - sums[bottom, left] + sums[top, left]) / ((right - left) * (bottom - top))


#: Pixels that are summed at once.
_AT_ONCE = 1 << 20


def _page_ratios(app_id: pa.Array, w: pa.Array, h: pa.Array, pixels: pa.Array, options: pa.Array) -> list[pa.Array]:
    """Columns of checkbox_ratios for some pages: dark_sums and dark_ratio of all pages of one size and all their options at once."""
    across, down, n = (np.asarray(pc.fill_null(a, 0), np.int64) for a in (w, h, pc.binary_length(pixels)))
    whole = (across > 0) & (down > 0) & (n == across * down)
    of_page = np.where(whole, np.asarray(pc.fill_null(pc.list_value_length(options), 0), np.int64), 0)
    page = np.repeat(np.arange(len(whole)), of_page)
    each = pc.list_flatten(pc.filter(options, pa.array(whole)))
    column = lambda name: pc.struct_field(each, name)

    def corners(name: str, span: tuple[int, int], most: np.ndarray) -> list[np.ndarray]:
        # an option without a place has no box
        at = np.nan_to_num(np.asarray(pc.fill_null(column(name), np.nan), float), nan=0.0)
        return [np.clip(np.floor((at + d) * BOX_SCALE + 0.5), 0, most[page]).astype(np.int64) for d in span]

    (left, right), (top, bottom) = corners("x1", BOX_ACROSS, across), corners("y1", BOX_DOWN, down)
    ratio = np.zeros(len(page))
    for width, height in np.unique(np.stack([across[whole], down[whole]], axis=1), axis=0).tolist():
        alike = np.flatnonzero(whole & (across == width) & (down == height))
        step = max(1, _AT_ONCE // (width * height))
        for begin in range(0, len(alike), step):
            some = alike[begin : begin + step]
            images = np.frombuffer(b"".join(pixels.take(pa.array(some)).to_pylist()), np.uint8).reshape(-1, height, width)
            sums = np.zeros((len(some), height + 1, width + 1), np.int32)
            np.cumsum(np.cumsum(images < BOX_DARK, axis=1, dtype=np.int32), axis=2, out=sums[:, 1:, 1:])
            number = np.full(len(whole), -1)
            number[some] = np.arange(len(some))
            k = np.flatnonzero((number[page] >= 0) & (right > left) & (bottom > top))
            i, x0, x1, y0, y1 = number[page[k]], left[k], right[k], top[k], bottom[k]
            ratio[k] = (sums[i, y1, x1] - sums[i, y0, x1] - sums[i, y1, x0] + sums[i, y0, x0]) / ((x1 - x0) * (y1 - y0))
    return [app_id.take(pa.array(page)), column("option"), column("option_pos"), pa.array(ratio)]


def checkbox_ratios(rasters: DataFrame, options: DataFrame) -> DataFrame:
    """app_id, option, option_pos, dark_ratio: how dark the checkbox of each option is on the page.

    rasters: app_id, w, h, pixels (gray, row by row) of page 1, those without all their pixels left out; options: as
    form.option_lines gives them. A task hashes its pages' options, so that pixels are neither sorted nor spilled, and
    takes the pages of an Arrow batch that are of one size together.
    """
    ddl = "app_id long, option string, option_pos int, dark_ratio double"
    listed = options.groupBy("app_id").agg(F.collect_list(F.struct("option", "option_pos", "x1", "y1")).alias("options"))

    def run(batches):
        for batch in batches:
            yield pa.record_batch(_page_ratios(*batch.columns), names=["app_id", "option", "option_pos", "dark_ratio"])

    return rasters.join(listed.hint("shuffle_hash"), "app_id").select("app_id", "w", "h", "pixels", "options").mapInArrow(run, ddl)


def brightness(pixels: Column | str) -> Column:
    """The sum of an image's pixels."""

    @F.pandas_udf("long")
    def summed(images: pd.Series) -> pd.Series:
        return images.map(lambda one: int(np.frombuffer(one, np.uint8).sum(dtype=np.int64)), na_action="ignore").astype("Int64")

    return summed(pixels)


VARIANT_DDL = "variant string, w int, h int, pixels binary"


def variants(images: DataFrame) -> DataFrame:
    """The three renderings of each image (raw, flat, bin; bin with dark text), a row each.

    images: app_id, name, w, h, pixels (gray, row by row). Images without pixels have none.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for app_id, name, w, h, pixels in batch.itertuples(index=False):
                if not w or not h or not pixels or len(pixels) != w * h:
                    continue
                raw = np.frombuffer(pixels, np.uint8).reshape(h, w)
                flat = flattened(raw)
                cut = binarised(flat)
                for variant, image in (("raw", raw), ("flat", flat), ("bin", inverted(cut) if is_dark(cut) else cut)):
                    rows.append((app_id, name, variant, w, h, image.tobytes()))
            yield pd.DataFrame(rows, columns=["app_id", "name", "variant", "w", "h", "pixels"])

    return images.select("app_id", "name", "w", "h", "pixels").mapInPandas(run, f"app_id long, name string, {VARIANT_DDL}")


def enlarged(images: DataFrame, factor: float) -> DataFrame:
    """Images (as above, other columns kept out) at `factor` times their size, sides rounded."""

    def run(batches):
        for batch in batches:
            rows = []
            for app_id, name, w, h, pixels in batch.itertuples(index=False):
                nw, nh = int(np.floor(w * factor + 0.5)), int(np.floor(h * factor + 0.5))
                rows.append((app_id, name, nw, nh, resized(np.frombuffer(pixels, np.uint8).reshape(h, w), nw, nh).tobytes()))
            yield pd.DataFrame(rows, columns=["app_id", "name", "w", "h", "pixels"])

    kept = images.filter((F.col("w") > 0) & (F.col("h") > 0) & (F.octet_length("pixels") == F.col("w") * F.col("h")))
    return kept.select("app_id", "name", "w", "h", "pixels").mapInPandas(run, "app_id long, name string, w int, h int, pixels binary")
