"""Applications as streams: those that arrive whole, and those whose form and label arrive apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vouch.operators.corpus import corpus, lines_of_images
from vouch.operators.matchers import matches

_FORM = "form_qa array<struct<pos:int,num:string,question:string,answer:string>>"
_IMAGES = "images array<struct<img_pos:int,name:string,lines:array<struct<text:string,conf:double,x1:int,y1:int,x2:int,y2:int>>>>"
BUNDLE_DDL = f"app_id long, {_FORM}, {_IMAGES}"
FORM_DDL, LABEL_DDL = f"app_id long, arrived timestamp, {_FORM}", f"app_id long, arrived timestamp, {_IMAGES}"
#: How long a form and a label wait for each other, and how late a row may come after later ones.
KEEP_HOURS, LATE = 24, "10 minutes"


def bundles(spark: SparkSession, folder: str, files_per_batch: int = 100, ddl: str = BUNDLE_DDL) -> DataFrame:
    """A stream of JSON rows: an application with its form and the lines of its images (or, by FORM_DDL and LABEL_DDL, either)."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).json(folder)


def matched(batch: DataFrame) -> DataFrame:
    """The verdicts of a table of bundles."""
    form = batch.selectExpr("app_id", "inline(form_qa)")
    lines = lines_of_images(batch.selectExpr("app_id", "inline(images)"))
    return matches(batch.select("app_id"), form, corpus(lines))


def write_matches(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch under its own number, overwritten if it runs again: a batch counts once, whatever fails in between."""

    def write(batch: DataFrame, number: int) -> None:
        matched(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def met(forms: DataFrame, labels: DataFrame, keep_hours: int = KEEP_HOURS, late: str = LATE) -> DataFrame:
    """app_id, arrived, form_qa, images of forms and labels (streams or tables) that arrive within keep_hours of each other, either first.

    What waits is state by application, dropped once the watermark says that nothing in reach can come any more. A form that
    meets no label comes out then, its images null; a label that meets no form just goes. A label that comes later is as
    one without a form.
    """
    shown = labels.select(F.col("app_id").alias("label_app"), F.col("arrived").alias("shown"), "images").withWatermark("shown", late)
    reach = F.expr(f"INTERVAL {int(keep_hours)} HOURS")  # a literal: the bounds of the state are taken from it
    near = (F.col("app_id") == F.col("label_app")) & (F.col("shown") >= F.col("arrived") - reach) & (F.col("shown") <= F.col("arrived") + reach)
    return forms.withWatermark("arrived", late).join(shown, near, "leftOuter").select("app_id", "arrived", "form_qa", "images")


def write_met(joined: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Of each batch of met(): the pairs (out/met), their verdicts (out/matches), and the applications whose label never came (out/expired).

    A batch is written before it is matched, so the state behind it is read once; a batch that runs again overwrites its own rows.
    """
    spark = joined.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/met/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(batch.schema).parquet(path)
        matched(rows.filter(F.col("images").isNotNull())).write.mode("overwrite").parquet(f"{out}/matches/batch={number}")
        rows.filter(F.col("images").isNull()).select("app_id", "arrived").write.mode("overwrite").parquet(f"{out}/expired/batch={number}")

    return joined.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
