"""What follows character recognition: boxes, passes, duplicates among words, and lines.

Recognition itself is an external library's; its words and boxes come in as tables. Rules that depend on the order of words
run over one image's words at a time, sorted, in tasks that hold many whole images.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from itertools import chain, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.numbers import six_digits

# --- fixed values -------------------------------------------------------------------------------------------------

#: A gap of so much of a character's height is a space.
WIDE_GAP = 0.15
#: Overlaps (of the smaller box) from which two words are one: anywhere, and with the same letters.
SAME_PLACE, SAME_LETTERS = 0.5, 0.2
NEAR_LINE = 0.6
#: Enlargements and the pixels that their longer side may have.
ENLARGEMENTS = ((2.0, 1400.0), (4.0, 2800.0))
LAYOUTS = (3, 11)

_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = ("text", "conf", "x", "y", "w", "h", "seq")


def page_text(chars: DataFrame) -> DataFrame:
    """app_id, page, line, text: characters in order, with a space where the gap to the one before is wide.

    chars: app_id, page, line, seq, c, x0, x1, y0, y1. A gap is wide beyond WIDE_GAP of the character's height, and counts
    where the line does not end in a space already.
    """
    line = Window.partitionBy("app_id", "page", "line").orderBy("seq")
    before = F.lag("c").over(line)
    wide = (F.col("x0") - F.lag("x1").over(line) > WIDE_GAP * (F.col("y1") - F.col("y0"))) & (before != " ")
    spaced = chars.withColumn("piece", F.when(wide, F.concat(F.lit(" "), F.col("c"))).otherwise(F.col("c")))
    return spaced.groupBy("app_id", "page", "line").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "piece"))).getField("piece"), "").alias("text"))


def page_images(blocks: DataFrame) -> DataFrame:
    """Images of the first three pages, 50 pixels at least to either side, numbered within their page and named after it.

    blocks: app_id, page, block_seq, w, h, x0, y0, x1, y1 (text or number). Adds img_pos, name and bbox.
    """
    kept = blocks.filter((F.col("w") >= 50) & (F.col("h") >= 50) & (F.col("page") <= 3))
    n = F.row_number().over(Window.partitionBy("app_id", "page").orderBy("block_seq"))
    place = F.row_number().over(Window.partitionBy("app_id").orderBy("page", "block_seq")) - 1
    text = {name for name, kind in blocks.dtypes if kind == "string"}
    box = F.concat_ws(" ", *(F.col(c) if c in text else six_digits(c) for c in ("x0", "y0", "x1", "y1")))
    # places first: their exchange and order serve the numbers within pages too
    numbered = kept.withColumn("img_pos", place).withColumn("n", n)
    return numbered.select("app_id", "page", "img_pos", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_"), F.col("n").cast("string"), F.lit(".png")).alias("name"), F.col("w").alias("width"), F.col("h").alias("height"), box.alias("bbox"))


def rendered_pages(pages: DataFrame) -> DataFrame:
    """The page that is rendered for display: the first, with its name."""
    return pages.filter(F.col("page") == 1).select("app_id", "page", F.lit("document_p1.png").alias("name"))


def lines_of_polygons(polygons: DataFrame) -> DataFrame:
    """Recognised boxes as lines: the bounds of their corners, cut to whole numbers; blank texts go.

    polygons: app_id, img_pos, image, seq, text, conf, polygon (array of [x, y]).
    """
    bound = lambda pick, i: pick(F.transform("polygon", lambda p: F.get(p, F.lit(i)))).cast("int")
    rows = polygons.withColumn("text", T.trim("text")).filter("text != ''")
    place = F.row_number().over(Window.partitionBy("app_id", "img_pos").orderBy("seq")) - 1
    return rows.select("app_id", "img_pos", "image", place.alias("line_pos"), "text", "conf", bound(F.array_min, 0).alias("x1"), bound(F.array_min, 1).alias("y1"), bound(F.array_max, 0).alias("x2"), bound(F.array_max, 1).alias("y2"))


def scaled_words(words: DataFrame) -> DataFrame:
    """Words of an enlarged image in the image's own pixels; blank words and those of negative confidence go.

    words: ..., text, conf, x1, y1, x2, y2, scale. Adds x, y, w, h.
    """
    kept = words.withColumn("text", T.trim("text")).filter((F.col("text") != "") & (F.col("conf") >= 0))
    whole = lambda c: F.round(c / F.col("scale")).cast("int")
    size = lambda a, b: F.greatest(F.lit(1), whole(F.col(b) - F.col(a)))
    return kept.withColumns({"x": whole(F.col("x1")), "y": whole(F.col("y1")), "w": size("x1", "x2"), "h": size("y1", "y2")})


def passes(images: DataFrame) -> DataFrame:
    """The recognition passes of each image: twice and four times its size, up to 1400 and 2800 pixels, in two layouts; none that would not enlarge it."""
    ways = F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(cap).alias("cap"), F.lit(m).alias("psm")) for s, cap in ENLARGEMENTS for m in LAYOUTS)))
    rows = images.select("app_id", "name", "width", "height", ways.alias("way"))
    factor = F.least(F.col("way.scale"), F.col("way.cap") / F.greatest("width", "height"))
    return rows.select("app_id", "name", "way.psm", "way.scale", factor.alias("factor"), F.round(F.col("width") * factor).cast("int").alias("width"), F.round(F.col("height") * factor).cast("int").alias("height")).filter("factor > 1")


VARIANTS = ("raw", "flat", "bin")


def best_variant(words: DataFrame) -> DataFrame:
    """app_id, image, variant, score: the rendering whose words are surest; few words count for less, of equals the first.

    words: app_id, image, variant, conf. Images without words take the first variant.
    """
    scored = words.groupBy("app_id", "image", "variant").agg((F.avg("conf") * F.least(F.lit(1.0), F.count(F.lit(1)) / 20)).alias("score"))
    place = F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("app_id", "image").orderBy(F.desc("score"), place)))
    return ranked.filter("place = 1").select("app_id", "image", "variant", "score")


def _image_by_image(words: DataFrame, order: list[Column], run: Callable[[list[dict]], list[tuple]], ddl: str) -> DataFrame:
    """Rows (after app_id and image) that `run` makes of each image's words in order: images are dealt out whole and sorted,
    and a task goes through its images one by one."""
    names = [n for n, *_ in (f.split() for f in ddl.split(", "))]
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in ddl.split(", ")])
    sort = [f"_{i}" for i in range(len(order))]
    dealt = words.select("app_id", "image", *_WORD, *(c.alias(n) for n, c in zip(sort, order, strict=True))).repartition("app_id", "image").sortWithinPartitions("app_id", "image", *sort)

    def images(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["app_id"], row["image"]) != key:
                    if held:
                        yield key, held
                    key, held = (row["app_id"], row["image"]), []
                held.append(row)
        if held:
            yield key, held

    def all_images(batches):
        rows = []
        for key, held in images(batches):
            rows += [(*key, *made) for made in run(held)]
            if len(rows) >= 10_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)

    return dealt.select("app_id", "image", *_WORD).mapInArrow(all_images, ddl)


class KeptBoxes:
    """Boxes in grids, one for each power of two of their longer side: a box lies in four cells of its grid at most."""

    def __init__(self):
        self.grids: dict[int, dict[tuple[int, int], list[dict]]] = {}

    @staticmethod
    def _cells(box: dict, level: int):
        return product(range(box["x"] >> level, ((box["x"] + box["w"] - 1) >> level) + 1), range(box["y"] >> level, ((box["y"] + box["h"] - 1) >> level) + 1))

    def add(self, box: dict) -> None:
        level = max(box["w"], box["h"], 1).bit_length()
        grid = self.grids.setdefault(level, {})
        for cell in self._cells(box, level):
            grid.setdefault(cell, []).append(box)

    def near(self, box: dict):
        """Boxes that share a cell with this one; in a grid with fewer cells than it covers, all boxes."""
        for level, grid in self.grids.items():
            if ((box["w"] >> level) + 2) * ((box["h"] >> level) + 2) > len(grid):
                yield from chain.from_iterable(grid.values())
            else:
                for cell in self._cells(box, level):
                    yield from grid.get(cell, ())


def _same_word(w: dict, k: dict) -> bool:
    across = min(w["x"] + w["w"], k["x"] + k["w"]) - max(w["x"], k["x"])
    down = min(w["y"] + w["h"], k["y"] + k["h"]) - max(w["y"], k["y"])
    if across <= 0 or down <= 0:
        return False
    shared = across * down / min(w["w"] * w["h"], k["w"] * k["h"])
    return shared >= SAME_PLACE or (shared > SAME_LETTERS and w["low"] == k["low"])


def _suppressed(words: list[dict]) -> list[tuple]:
    kept, rows = KeptBoxes(), []
    for w in words:
        w["low"] = (w["text"] or "").translate(_ASCII_LOWER)
        if not any(_same_word(w, k) for k in kept.near(w)):
            kept.add(w)
            rows.append((len(rows), *(w[c] for c in _WORD)))
    return rows


def merged_words(words: DataFrame) -> DataFrame:
    """Words of all passes without duplicates: surest first (then largest, then as they come), a word goes if it overlaps a kept one by half of the smaller, or by more than a fifth with the same letters.

    Kept boxes lie in grids, so a word meets those near it alone.
    """
    area = F.col("w").cast("double") * F.col("h")
    return _image_by_image(words, [-F.col("conf"), -area, F.col("seq")], _suppressed, "app_id long, image string, place int, text string, conf double, x int, y int, w int, h int, seq int")


def _swept(words: list[dict]) -> list[tuple]:
    """Words from the top down in lines; a line is retired when no word from here on can reach it.

    A word of height h at y joins a line of middle c and tallest word t where y + h / 2 is nearer to c than NEAR_LINE * max(h, t).
    Beyond y = c + (NEAR_LINE - 1/2) * (greatest height) and y = c + NEAR_LINE * t no later word does.
    """
    tallest = max(w["h"] for w in words)
    lines, begun = [], []
    for w in words:
        middle = w["y"] + w["h"] / 2.0
        lines = [line for line in lines if w["y"] - line["at"] < (NEAR_LINE - 0.5) * tallest + 1 or w["y"] - line["at"] < NEAR_LINE * line["tall"]]
        line = next((line for line in lines if abs(middle - line["at"]) < NEAR_LINE * max(w["h"], line["tall"])), None)
        if line is None:
            line = {"first": middle, "tall": 0, "words": []}
            lines.append(line)
            begun.append(line)
        line["words"].append(w)
        line["at"], line["tall"] = (line["first"] + middle) / 2.0, max(line["tall"], w["h"])
    rows = []
    for line in begun:
        ws = sorted(line["words"], key=lambda w: (w["x"], w["seq"]))
        box = min(w["x"] for w in ws), min(w["y"] for w in ws), max(w["x"] + w["w"] for w in ws), max(w["y"] + w["h"] for w in ws)
        rows.append((" ".join(w["text"] or "" for w in ws), sum((w["conf"] for w in ws), 0.0) / len(ws), ws[0]["y"], *box))
    return [(i, *row) for i, row in enumerate(sorted(rows, key=lambda r: r[2]))]


def grouped_lines(words: DataFrame) -> DataFrame:
    """app_id, image, line_pos, text, conf, y, x1, y1, x2, y2: words in lines, lines from top to bottom.

    From the top down, a word joins the first line whose middle (between its first and last word) is nearer than NEAR_LINE of
    the larger of its height and the line's; else it opens a line. Ties go by seq.
    """
    return _image_by_image(words, [F.col("y"), F.col("seq")], _swept, "app_id long, image string, line_pos int, text string, conf double, y int, x1 int, y1 int, x2 int, y2 int")


def image_text(lines: DataFrame) -> DataFrame:
    """app_id, image, text: the lines of an image, a space between."""
    return lines.groupBy("app_id", "image").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_pos", "text"))).getField("text"), " ").alias("text"))
