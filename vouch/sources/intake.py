"""Sources: uploaded files, saved form documents, image folders, and page text by a reader that the caller brings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.functions import text as T

UPLOAD_CAP = 50 * 1024 * 1024
PDF_MARK, MARK_WITHIN = "%PDF-", 1024
PAGE_IMAGE = r"^p(\d+)_(\d+)\.png$"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content; only the columns in use are read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def upload_status(name: Column | str, size: Column | str, head: Column | str, cap: int = UPLOAD_CAP) -> Column:
    """200, or 400 for a bad name or content, 413 for too large; head: the first bytes, as text."""
    marked = F.contains(F.substring(T.column(head), 1, MARK_WITHIN), F.lit(PDF_MARK))
    return F.when(T.pdf_name_error(name).isNotNull(), 400).when(T.column(size) > cap, 413).when(~marked, 400).otherwise(200)


def accepted_pdfs(found: DataFrame, cap: int = UPLOAD_CAP) -> DataFrame:
    """Files (path, length, content) that pass the upload's checks."""
    name = F.element_at(F.split("path", "/"), -1)
    head = F.decode(F.substring("content", 1, MARK_WITHIN), "ISO-8859-1")
    return found.filter(upload_status(name, "length", head, cap) == 200)


def page_texts(found: DataFrame, read_pages: Callable[[bytes], list[str]]) -> DataFrame:
    """app_id, page, text of PDF files by a reader of the caller's choice (a function from content to page texts)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(a, i + 1, t or "") for a, content in zip(batch["app_id"], batch["content"], strict=True) for i, t in enumerate(read_pages(bytes(content)))]
            yield pd.DataFrame(rows, columns=["app_id", "page", "text"])

    return found.select(F.xxhash64("path").alias("app_id"), "content").mapInPandas(run, "app_id long, page int, text string")


def form_documents(documents: DataFrame) -> DataFrame:
    """app_id, ttb_id, raw_text, form_qa of saved JSON documents (app_id, json): an object with form_qa, or a bare array of entries.

    Values of another type than text are empty; entries that are no objects go. An entry's bbox is null unless it is an object.
    """
    entry = "array<variant>"
    parsed = documents.select("app_id", F.try_parse_json("json").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)

    def value(of: Column, name: str) -> Column:
        """A field that is text, else empty."""
        is_text = F.schema_of_variant(F.try_variant_get(of, f"$.{name}", "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(of, f"$.{name}", "string")).otherwise("")

    def box(of: Column) -> Column:
        corners = F.struct(*(F.try_variant_get(of, f"$.bbox.{c}", "double").alias(c) for c in ("x1", "y1", "x2", "y2")))
        return F.when(F.startswith(F.schema_of_variant(F.try_variant_get(of, "$.bbox", "variant")), F.lit("OBJECT")), corners)

    rows = parsed.select("app_id", value(F.col("v"), "ttb_id").alias("ttb_id"), get("$.raw_text", "array<string>").alias("raw_text"), F.coalesce(get("$.form_qa", entry), get("$", entry)).alias("entries"))
    kept = F.filter("entries", lambda e: F.startswith(F.schema_of_variant(e), F.lit("OBJECT")))
    return rows.withColumn("form_qa", F.transform(kept, lambda e: F.struct(value(e, "num").alias("num"), value(e, "question").alias("question"), value(e, "answer").alias("answer"), box(e).alias("bbox")))).drop("entries")


def form_data(found: DataFrame, name: str = "analysis.json") -> DataFrame:
    """run_id, json of each run's saved form among files (path, content): the run's own folder goes before its folder of images."""
    inside = rf"(?:^|/)([^/]+)/(images/)?{re.escape(name)}$"
    level = (F.regexp_extract("path", inside, 2) != "").cast("int")
    kept = found.filter(F.regexp_like("path", F.lit(inside))).select(F.regexp_extract("path", inside, 1).alias("run_id"), level.alias("level"), "content")
    return kept.groupBy("run_id").agg(F.min_by("content", "level").alias("content")).select("run_id", F.decode("content", "UTF-8").alias("json"))


def form_entries(documents: DataFrame) -> DataFrame:
    """app_id, pos, num, question, answer and bbox_x1 to bbox_y2 (null without a box) of form_documents()."""
    rows = documents.select("app_id", F.posexplode("form_qa").alias("pos", "e"))
    return rows.select("app_id", "pos", "e.num", "e.question", "e.answer", *(F.col(f"e.bbox.{c}").cast("float").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")))


def page_images(found: DataFrame) -> DataFrame:
    """app_id, img_pos, page, n, name of files named like a page's image, in the order of their names as text."""
    kept = found.filter(F.rlike("name", F.lit(PAGE_IMAGE)))
    place = F.row_number().over(Window.partitionBy("app_id").orderBy("name")) - 1
    return kept.select("app_id", place.alias("img_pos"), F.regexp_extract("name", PAGE_IMAGE, 1).try_cast("int").alias("page"), F.regexp_extract("name", PAGE_IMAGE, 2).try_cast("int").alias("n"), "name")


def samples(found: DataFrame, name: str) -> DataFrame:
    """The demonstration file among files (path, length): its name, size in KB to one place, and that it is made up."""
    own = F.element_at(F.split("path", "/"), -1)
    return found.filter(own == name).select(own.alias("name"), F.round(F.col("length") / 1024, 1).alias("size_kb"), F.lit(True).alias("synthetic"))
