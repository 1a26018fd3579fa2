"""The label text of applications, line by line, normalised once.

Order decides which line is found first, so each line carries it: the position of its image, then of the line there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.joins import large

LINE = ("app_id", "img_pos", "image", "line_pos", "text", "conf", "x1", "y1", "x2", "y2")


def corpus(lines: DataFrame) -> DataFrame:
    """lines with nl (normalised), nlc (without spaces) and ord (one number for the order within an application)."""
    return lines.select(*LINE).withColumn("nl", T.norm("text")).withColumn("nlc", T.compact("nl")).withColumn("ord", order("img_pos", "line_pos"))


def order(img_pos: Column | str, line_pos: Column | str) -> Column:
    """One number in place of (img_pos, line_pos): its minimum is a hash aggregate, that of a struct is not."""
    return F.shiftleft(T.column(img_pos).cast("long"), 32) + T.column(line_pos)


def lines_of_images(images: DataFrame) -> DataFrame:
    """Flattens (app_id, img_pos, name, lines) into lines; lines: an array of structs of text, conf and box."""
    rows = images.select("app_id", "img_pos", F.col("name").alias("image"), F.posexplode("lines").alias("line_pos", "line"))
    return rows.select("app_id", "img_pos", "image", "line_pos", "line.text", "line.conf", "line.x1", "line.y1", "line.x2", "line.y2")


def by_image_name(lines: DataFrame) -> DataFrame:
    """The same lines with images in the order of their names as text (p2_10.png before p2_2.png)."""
    names = lines.select("app_id", "image").distinct()
    ranked = names.withColumn("by_name", F.row_number().over(Window.partitionBy("app_id").orderBy("image")) - 1)
    return lines.join(large(ranked), ["app_id", "image"]).withColumn("img_pos", F.col("by_name")).select(*LINE)
