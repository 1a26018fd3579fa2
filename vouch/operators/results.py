"""Results: one JSON document or text report for each application, links to its images, and the retention of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.joins import large
from vouch.functions.numbers import six_digit_number, six_digits

#: The report's marks for a verdict.
ICONS = {"MATCH": "[OK]  ", "PARTIAL": "[~]   ", "NOT FOUND": "[MISS]", "SKIP": "[n/a] "}
BAR = "=" * 78
#: The keys of a document, in their order.
KEYS = ("pdf", "task", "ttb_id", "pages", "raw_text", "form_qa", "document_pages", "images", "ocr", "matches", "class_type")


def icon(status: Column | str) -> Column:
    status, mark = T.column(status), None
    for name, text in ICONS.items():
        mark = F.when(status == name, text) if mark is None else mark.when(status == name, text)
    return mark.otherwise("[?]   ")


def page_list(pages: DataFrame) -> DataFrame:
    """app_id, page, chars: the length of each page's text in bytes."""
    return pages.select("app_id", "page", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


def _listed(df: DataFrame, order: str, row: Column, name: str) -> DataFrame:
    """An application's rows as an array in order."""
    return df.groupBy("app_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, row.alias("row")))), lambda x: x["row"]).alias(name))


def _box(prefix: str, columns: list[str]) -> Column:
    """A box of the form as an object; null (so left out of a document) without one."""
    corners = [f"{prefix}{c}" for c in ("x1", "y1", "x2", "y2")]
    if not set(corners) <= set(columns):
        return F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    return F.when(F.col(corners[0]).isNotNull(), F.struct(*(six_digit_number(c).alias(c[-2:]) for c in corners)))


def _recognised(images: DataFrame, lines: DataFrame) -> DataFrame:
    """app_id, ocr: what was read on each image, by its name (of images of one name the last); lines are gathered by image first."""
    of_image = lines.groupBy("app_id", F.col("image").alias("name")).agg(F.array_sort(F.collect_list(F.struct("line_pos", "text", F.col("conf").cast("double").alias("conf")))).alias("l"))
    named = images.groupBy("app_id", "name").agg(F.max_by(F.struct("img_pos", "width", "height"), "img_pos").alias("i"))
    read = named.join(large(of_image), ["app_id", "name"], "left")
    shown = F.transform(F.coalesce("l", F.array().cast("array<struct<line_pos:int,text:string,conf:double>>")), lambda x: F.struct(x["text"].alias("text"), six_digit_number(x["conf"]).alias("conf")))
    text = F.coalesce(F.array_join(F.col("l.text"), " "), F.lit(""))
    entry = F.struct("name", F.struct(F.col("i.width").alias("width"), F.col("i.height").alias("height"), shown.alias("lines"), text.alias("text")).alias("read"))
    listed = read.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct(F.col("i.img_pos").alias("at"), entry.alias("e")))).alias("all"))
    return listed.select("app_id", F.map_from_entries(F.transform("all", lambda x: x["e"])).alias("ocr"))


def documents(apps: DataFrame, form_qa: DataFrame, matches: DataFrame, class_type: DataFrame, pages: DataFrame, images: DataFrame, lines: DataFrame, rendered: DataFrame, task: str = "both") -> DataFrame:
    """app_id, json: everything about an application in one document, its arrays in order; its keys stand in the order of KEYS.

    apps: app_id, pdf; images: app_id, img_pos, page, name, width, height, path, bbox; lines: label lines; rendered: app_id,
    page, name, width, height, path. Numbers that are not whole have six significant digits. Entries and verdicts without a
    box have no key for it. What belongs to one application is one value at last, so it is gathered in one task, in parts.
    """
    evidence = F.struct("found", "image", "line", six_digit_number("conf").alias("conf"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("found_n", "of_n")), "line_x1", "line_y1", "line_x2", "line_y2")
    verdict = F.struct("num", "question", "answer", "status", "mandatory", "mandatory_message", evidence.alias("evidence"), "note", _box("form_", matches.columns).alias("form_bbox"))
    parts = [
        pages.filter(F.col("page") == 1).groupBy("app_id").agg(F.min(T.ttb_id("text")).alias("ttb_id")),
        _listed(page_list(pages), "page", F.struct("page", "chars"), "pages"),
        _listed(pages, "page", F.coalesce("text", F.lit("")), "raw_text"),
        _listed(form_qa, "pos", F.struct("num", "question", "answer", _box("bbox_", form_qa.columns).alias("bbox")), "form_qa"),
        _listed(rendered, "page", F.struct("page", "name", "width", "height", "path"), "document_pages"),
        _listed(images, "img_pos", F.struct("page", "name", "width", "height", "path", "bbox"), "images"),
        _recognised(images, lines),
        _listed(matches, "pos", verdict, "matches"),
        class_type.select("app_id", F.struct("status", "class_type", "matched_as").alias("class_type")),
    ]
    out = apps.select("app_id", "pdf").dropDuplicates(["app_id"]).withColumn("task", F.lit(task))
    for part in parts:
        out = out.join(large(part), "app_id", "left")
    empty = {c: F.coalesce(c, F.array().cast(t)) for c, t in out.dtypes if t.startswith("array")}
    empty["ocr"] = F.coalesce("ocr", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{out.schema['ocr'].dataType.valueType.simpleString()}>")))
    out = out.withColumns(empty | {"ttb_id": F.coalesce("ttb_id", F.lit(""))})
    return out.select("app_id", F.to_json(F.struct(*KEYS)).alias("json"))


def report_lines(matches: DataFrame) -> DataFrame:
    """app_id, pos, text: the report's lines for each verdict."""
    counts = F.when(F.col("of_n").isNotNull(), F.concat(F.lit(" ("), F.col("found_n").cast("string"), F.lit("/"), F.col("of_n").cast("string"), F.lit(" tokens)"))).otherwise("")
    sure = F.when(F.col("conf") >= 0, F.concat(F.lit(", conf "), six_digits("conf"))).otherwise("")
    label = F.concat(F.lit('        label  : "'), "line", F.lit('" on '), "image", sure, counts, _as("matched_as"))
    label = F.when(F.col("found") & (F.col("line") != ""), label).when(F.col("status") == "SKIP", F.concat(F.lit("        note   : "), "note")).otherwise("        label  : (not found)")
    head = F.concat(F.lit("  "), icon("status"), F.lit(" "), "num", F.lit(". "), "question")
    return matches.select("app_id", "pos", F.concat_ws("\n", head, F.concat(F.lit("        answer : "), "answer"), label).alias("text"))


def _as(name: str) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" (matched as '"), name, F.lit("')"))).otherwise("")


def _joined_lines(rows: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """app_id, the rows' texts (column `text`) line by line, and how many there are (name_n)."""
    order = [order] if isinstance(order, str) else order
    return rows.groupBy("app_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(*order, "text"))).getField("text"), "\n").alias(name), F.count(F.lit(1)).alias(f"{name}_n"))


def _page_summary(pages: DataFrame) -> DataFrame:
    every = page_list(pages).groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("page", "chars"))).alias("p"))
    listed = lambda c: F.array_join(F.transform(f"p.{c}", lambda x: x.cast("string")), ", ")
    return every.select("app_id", F.concat(F.lit(" Pages : ["), listed("page"), F.lit("] (chars: "), listed("chars"), F.lit(")")).alias("summary"))


def reports(apps: DataFrame, form_qa: DataFrame, matches: DataFrame, class_type: DataFrame, pages: DataFrame, images: DataFrame, lines: DataFrame, backend: str = "table", title: str = " PDF ANALYSIS — ") -> DataFrame:
    """app_id, report: an application as text: its head, the form, the images, what was read on them, the verdicts and the class and type.

    Columns as for documents().
    """
    entry = F.concat(F.lit("    "), "num", F.lit(". "), "question", F.lit("\n          -> "), F.when(F.col("answer") == "", "(blank)").otherwise(F.col("answer")))
    image = F.concat(F.lit("    p"), F.col("page").cast("string"), F.lit(" "), "name", F.lit(": "), "path", F.lit(" ("), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(", png)"))
    read = F.concat(F.lit("      "), "text", F.lit("   (conf "), F.round("conf").cast("long").cast("string"), F.lit(")"))
    names = images.select("app_id", "img_pos", F.lit(-1).alias("line_pos"), F.concat(F.lit("    --- "), "name", F.lit(" ---")).alias("text"))
    on_images = lines.join(large(images.select("app_id", "img_pos", F.col("name").alias("image"))), ["app_id", "image"], "left_semi").select("app_id", "img_pos", "line_pos", read.alias("text"))
    label = F.concat(F.lit('        label  : "'), "line", F.lit('" on '), "image", _as("matched_as"))
    label = F.when((F.col("status") == "MATCH") & (F.col("line") != ""), label).when(F.col("status") == "NOT FOUND", "        label  : (not found)")
    mark = F.when(F.col("status") == "MATCH", ICONS["MATCH"]).otherwise(ICONS["NOT FOUND"])
    kind = F.when(F.col("status") != "SKIP", F.concat_ws("\n", F.concat(F.lit("  "), mark, F.lit(" page-2 class/type: "), "class_type"), label))
    parts = [
        pages.filter(F.col("page") == 1).groupBy("app_id").agg(F.min(T.ttb_id("text")).alias("ttb_id")),
        _page_summary(pages),
        _joined_lines(form_qa.select("app_id", "pos", entry.alias("text")), "pos", "form"),
        _joined_lines(images.select("app_id", "img_pos", image.alias("text")), "img_pos", "graphics"),
        _joined_lines(names.unionByName(on_images), ["img_pos", "line_pos"], "read"),
        _joined_lines(report_lines(matches), "pos", "verdicts"),
        class_type.select("app_id", kind.alias("kind")),
    ]
    out = apps.select("app_id", "pdf").dropDuplicates(["app_id"])
    for part in parts:
        out = out.join(large(part), "app_id", "left")
    count = lambda name: F.coalesce(f"{name}_n", F.lit(0)).cast("string")
    said = F.coalesce(F.nullif("ttb_id", F.lit("")), F.lit("(none found)"))
    lines_of = [
        F.lit(BAR), F.concat(F.lit(title), "pdf"), F.lit(BAR), F.concat(F.lit(" TTB ID: "), said), F.coalesce("summary", F.lit(" Pages : [] (chars: )")), F.lit(""),
        F.concat(F.lit("[1] FORM Q&A — parsed from page 1 ("), count("form"), F.lit(" fields)")), F.col("form"), F.lit(""),
        F.concat(F.lit("[2] EMBEDDED GRAPHICS — "), count("graphics"), F.lit(" image(s)")), F.col("graphics"), F.lit(""),
        F.lit(f"[3] OCR — backend: {backend}"), F.col("read"), F.lit(""),
        F.concat(F.lit("[4] MATCH — label text vs form answers ("), count("verdicts"), F.lit(" fields)")), F.col("verdicts"), F.col("kind"), F.lit(BAR),
    ]
    return out.select("app_id", F.concat_ws("\n", *lines_of).alias("report"))


def stored_images(found: DataFrame) -> DataFrame:
    """run_id and name of files (a listing: path) that lie in a run's own folder of images."""
    inside = r"(?:^|/)([^/]+)/images/([^/]+)$"
    return found.select(F.regexp_extract("path", inside, 1).alias("run_id"), F.regexp_extract("path", inside, 2).alias("name")).filter("run_id <> ''").distinct()


def image_urls(images: DataFrame, found: DataFrame) -> DataFrame:
    """run_id, name and the address an image is served at; null unless both names are well formed and the file is there.

    found: a listing of files (path), as of sources.intake.files.
    """
    fine = F.rlike("run_id", F.lit(T.RUN_ID)) & F.rlike("name", F.lit(T.IMAGE_NAME))
    there = stored_images(found).withColumn("there", F.lit(True))
    return images.join(large(there), ["run_id", "name"], "left").select("run_id", "name", F.when(fine & F.col("there"), F.concat(F.lit("/runs/"), "run_id", F.lit("/images/"), "name")).alias("url"))


def expired_runs(runs: DataFrame, now: Column, max_age_hours: int) -> DataFrame:
    """Runs of this service (by their id) that were last changed before the limit; others are never touched."""
    return runs.filter(F.rlike("run_id", F.lit(T.RUN_ID)) & (F.col("mtime") < now - F.make_dt_interval(hours=F.lit(max_age_hours))))
