"""The registered queries of the label-checking engine, over applications made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.joins import large
from vouch.operators import corpus as C
from vouch.operators import evidence as E
from vouch.operators import form, imaging, matchers, ocr, results
from vouch.plans import oracles
from vouch.plans import stand_ins as S
from vouch.session import ensure_package
from vouch.sources import intake, stored

_VERDICT = ("app_id", "pos", "num", "question", "answer", "status", "found", "image", "line", "conf", "found_n", "of_n", "line_x1", "line_y1", "line_x2", "line_y2", "note", "mandatory", "mandatory_message", "matched_as")


def _pages(spark, d) -> DataFrame:
    return S.frame(spark, d, S.PAGES)


def _corpus(spark, d) -> DataFrame:
    return C.corpus(S.frame(spark, d, S.LABEL_LINES))


def _apps(spark, d) -> DataFrame:
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("app_id"))


def _entries(spark, d) -> DataFrame:
    return form.form_entries(_pages(spark, d))


def _words(spark, d) -> DataFrame:
    return ocr.scaled_words(S.frame(spark, d, S.WORDS))


def _ratios(spark, d) -> DataFrame:
    ensure_package(spark)
    return imaging.checkbox_ratios(S.rasters(spark, d), form.option_lines(S.frame(spark, d, S.OPTION_LINES)))


def _document_lines(spark, d) -> DataFrame:
    docs = S.frame(spark, d, S.DOCUMENT_PAGES)
    lines = docs.select("app_id", F.posexplode(F.split("text", "\n")).alias("line_pos", "text")).filter(T.trim("text") != "")
    image = (F.col("line_pos") % 2).cast("int")
    zero = [F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return lines.select("app_id", image.alias("img_pos"), F.concat(F.lit("p1_"), (image + 1).cast("string"), F.lit(".png")).alias("image"), "line_pos", "text", F.lit(1.0).alias("conf"), *zero)


def _document_probes(spark, d) -> DataFrame:
    """Two words of a document's first line, looked for in the document itself or the one before."""
    docs = S.frame(spark, d, S.DOCUMENT_PAGES)
    first = F.split(F.get(F.split("text", "\n"), F.lit(0)), " ")
    name = F.concat_ws(" ", F.get(first, F.lit(1)), F.get(first, F.lit(2)))
    return docs.select(F.when(F.col("app_id") % 3 == 0, F.col("app_id")).otherwise(F.col("app_id") - 1).alias("app_id"), F.col("app_id").alias("pos"), T.norm(name).alias("a"))


def first_line_of_documents(spark, d):
    """The flagship: norm, corpus, first evidence and a verdict, over whole documents."""
    probes, lines = _document_probes(spark, d), C.corpus(_document_lines(spark, d))
    found = E.first_evidence(probes, lines, ["app_id", "pos"], [E.contains_text("a")])
    return probes.join(large(found), ["app_id", "pos"], "left").select("app_id", "pos", "a", F.when(F.col("found"), "MATCH").otherwise("NOT FOUND").alias("status"), F.coalesce("image", F.lit("")).alias("image"), F.coalesce("line", F.lit("")).alias("line"))


def indexed_evidence(spark, d):
    """The same lookup by way of the rarest three letters of each probe; lines are normalised and stored once, as they are read at every step."""
    probes = stored.bucketed(_document_probes(spark, d), "app_id", ("pos",), name="probes")
    lines = stored.bucketed(C.corpus(_document_lines(spark, d)), "app_id", ("ord",), name="lines")
    found = E.first_evidence(probes, lines, ["app_id", "pos"], [E.contains_text("a")], through="a")
    return found.select("app_id", "pos", "image", "line")


def norm_lines(spark, d):
    return C.corpus(_document_lines(spark, d)).select("app_id", "img_pos", "line_pos", "nl", "nlc")


def document_checklist(spark, d):
    lines = C.corpus(_document_lines(spark, d))
    found = matchers.checklist(S.frame(spark, d, S.DOCUMENT_PAGES), lines, oracles.LICENCE_ANCHORS)
    return found.select("app_id", "found_n", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("line", F.lit("")).alias("line"))


def text_functions(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    spaced = F.concat(F.lit(" \t"), "text", F.lit(" \n"))
    cut = T.before_last(F.concat("text", F.lit(" (Used On Label) x")), T.USED_ON_LABEL)
    return docs.select("doc_id", F.md5(T.ascii_lower("text")).alias("lower_md5"), F.char_length(T.trim(spaced)).cast("long").alias("trimmed"), F.char_length(cut).cast("long").alias("before"), T.before_last("text", "the").isNull().alias("absent"), T.first_number("text").alias("number"))


def field_kinds(spark, d):
    return _entries(spark, d).select("app_id", "pos", T.field_kind("question").alias("kind"))


def ttb_ids(spark, d):
    return _pages(spark, d).filter("page = 1").select("app_id", T.ttb_id("text").alias("ttb_id"))


def form_entries(spark, d):
    return _entries(spark, d)


def form_with_product(spark, d):
    return form.with_product(_entries(spark, d), form.product_of_checkboxes(_ratios(spark, d)))


def form_boxes(spark, d):
    return form.with_boxes(_entries(spark, d), S.frame(spark, d, oracles.PAGE_LINES))


def form_widgets(spark, d):
    return form.with_widgets(form_boxes(spark, d), S.frame(spark, d, S.WIDGETS))


def checkbox_ratios(spark, d):
    return _ratios(spark, d)


def product_checkboxes(spark, d):
    return form.product_of_checkboxes(_ratios(spark, d))


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entries with their boxes, and label lines, each written once and bucketed by application."""
    return stored.bucketed(form_boxes(spark, d), "app_id", ("pos",), name="entries"), stored.bucketed(_corpus(spark, d), "app_id", ("ord",), name="lines")


def matches(spark, d):
    return matchers.matches(_apps(spark, d), *_stored(spark, d))


def _matcher(*kinds):
    def query(spark, d):
        asked = matchers.answers(_entries(spark, d)).filter(F.col("kind").isin(*kinds))
        return matchers.verdicts(asked, _corpus(spark, d)).select(*_VERDICT)

    return query


def mandatory_check(spark, d):
    last = _apps(spark, d).withColumn("last", F.lit(9))
    return matchers.mandatory_rows(_apps(spark, d), _corpus(spark, d), last).select(*_VERDICT)


def class_types(spark, d):
    return matchers.class_type(_pages(spark, d), _corpus(spark, d))


def tally(spark, d):
    return matchers.tally(matches(spark, d))


def scaled_words(spark, d):
    return _words(spark, d).select("app_id", "seq", "variant", "text", "conf", "x", "y", "w", "h")


def best_variants(spark, d):
    return ocr.best_variant(_words(spark, d)).select("app_id", "variant", F.round("score", 6).alias("score"))


def merged_words(spark, d):
    return ocr.merged_words(_words(spark, d)).select("app_id", "place", "seq", "text", "conf", "x", "y", "w", "h")


def grouped_lines(spark, d):
    lines = ocr.grouped_lines(_words(spark, d))
    return lines.select("app_id", "line_pos", "text", F.round("conf", 6).alias("conf"), "y", "x1", "y1", "x2", "y2")


def image_texts(spark, d):
    return ocr.image_text(_document_lines(spark, d)).select("app_id", "image", "text")


def recognition_passes(spark, d):
    images = S.frame(spark, d, oracles.SIZED)
    return ocr.passes(images).select("app_id", "name", "psm", "scale", F.round("factor", 6).alias("factor"), "width", "height")


def page_images(spark, d):
    return ocr.page_images(S.frame(spark, d, S.BLOCKS))


def polygon_lines(spark, d):
    words = S.frame(spark, d, S.WORDS)
    corner = lambda x, y: F.array(F.col(x) + 0.7, F.col(y) - 0.4)
    polygons = words.select("app_id", F.lit(0).alias("img_pos"), "image", "seq", "text", "conf", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")).alias("polygon"))
    return ocr.lines_of_polygons(polygons).select("app_id", "line_pos", "text", "conf", "x1", "y1", "x2", "y2")


def page_chars(spark, d):
    """Characters of each label line put together again from their boxes."""
    return ocr.page_text(S.frame(spark, d, oracles.CHARS)).select("app_id", "line", "text")


def page_list(spark, d):
    return results.page_list(_pages(spark, d))


def label_image_order(spark, d):
    return C.by_image_name(S.frame(spark, d, S.LABEL_LINES)).select("app_id", "img_pos", "image", "line_pos", "text")


def image_names(spark, d):
    return intake.page_images(S.frame(spark, d, oracles.NAMED_IMAGES))


def uploads(spark, d):
    runs = S.frame(spark, d, S.RUNS)
    return runs.select("run_id", "filename", T.pdf_name_error("filename").alias("error"), intake.upload_status("filename", "size_bytes", "head", 50_000_000).alias("status"))


def expired_runs(spark, d):
    return results.expired_runs(S.frame(spark, d, S.RUNS), F.lit("2024-02-01 00:00:00").cast("timestamp"), 24).select("run_id", "filename")


def image_urls(spark, d):
    return results.image_urls(S.frame(spark, d, S.RUNS).withColumnRenamed("image", "name"), S.frame(spark, d, S.STORED))


def report_lines(spark, d):
    return results.report_lines(matches(spark, d))


def form_documents(spark, d):
    """Forms saved as JSON, in both shapes and with their boxes, read back into entries."""
    entries = form_boxes(spark, d)
    box = F.when(F.col("bbox_x1").isNotNull(), F.struct(*(F.col(f"bbox_{c}").alias(c) for c in form.BOX)))
    listed = entries.groupBy("app_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("num", "question", "answer", box.alias("bbox")).alias("e")))), lambda x: x["e"]).alias("form_qa"))
    bare = F.to_json("form_qa")
    whole = F.to_json(F.struct(F.concat(F.lit("26"), F.col("app_id").cast("string")).alias("ttb_id"), "form_qa"))
    saved = listed.select("app_id", F.when(F.col("app_id") % 2 == 0, whole).otherwise(bare).alias("json"))
    return intake.form_entries(intake.form_documents(saved)).select("app_id", F.col("pos").cast("int").alias("pos"), "num", "question", "answer", *(f"bbox_{c}" for c in form.BOX))


def _everything(spark, d) -> list[DataFrame]:
    entries, lines = _stored(spark, d)
    pages = _pages(spark, d)
    return [S.frame(spark, d, S.APPS), entries, matchers.matches(_apps(spark, d), entries, lines), matchers.class_type(pages, lines), pages, S.frame(spark, d, S.IMAGES), lines]


def json_documents(spark, d):
    return results.documents(*_everything(spark, d), S.frame(spark, d, S.RENDERED))


def reports(spark, d):
    return results.reports(*_everything(spark, d))


def image_variants(spark, d):
    """Gray renderings of small images made from the words' boxes: their sizes and sums of pixels."""
    ensure_package(spark)
    return imaging.variants(oracles.drawn_images(spark, d)).select("app_id", "variant", "w", "h", imaging.brightness("pixels").alias("brightness"))


def enlarged_images(spark, d):
    """The same images at one and a half times their size."""
    ensure_package(spark)
    return imaging.enlarged(oracles.drawn_images(spark, d), 1.5).select("app_id", "w", "h", imaging.brightness("pixels").alias("brightness"))


def rendered_pages(spark, d):
    return ocr.rendered_pages(_pages(spark, d))


def samples(spark, d):
    """Uploaded files taken as a folder of samples, of which one name is the demonstration's."""
    found = S.frame(spark, d, S.RUNS).select(F.concat(F.lit("file:/samples/"), "run_id", F.lit("/"), "filename").alias("path"), F.col("size_bytes").alias("length"))
    return intake.samples(found, "label.pdf")


QUERIES = {
    "first_evidence": first_line_of_documents,
    "indexed_evidence": indexed_evidence,
    "norm_lines": norm_lines,
    "document_checklist": document_checklist,
    "text_functions": text_functions,
    "field_kinds": field_kinds,
    "ttb_ids": ttb_ids,
    "form_entries": form_entries,
    "form_with_product": form_with_product,
    "form_boxes": form_boxes,
    "form_widgets": form_widgets,
    "checkbox_ratios": checkbox_ratios,
    "product_checkboxes": product_checkboxes,
    "match_net_contents": _matcher("NetContents"),
    "match_alcohol": _matcher("Alcohol"),
    "match_product_type": _matcher("ProductType"),
    "match_wording": _matcher("Wording"),
    "match_name_address": _matcher("NameAddress"),
    "match_admin": _matcher("Admin"),
    "match_printed_text": _matcher("Brand", "Fanciful", "Appellation", "Vintage"),
    "mandatory_check": mandatory_check,
    "matches": matches,
    "class_types": class_types,
    "tally": tally,
    "scaled_words": scaled_words,
    "best_variants": best_variants,
    "merged_words": merged_words,
    "grouped_lines": grouped_lines,
    "image_texts": image_texts,
    "recognition_passes": recognition_passes,
    "page_images": page_images,
    "polygon_lines": polygon_lines,
    "page_chars": page_chars,
    "page_list": page_list,
    "label_image_order": label_image_order,
    "image_names": image_names,
    "uploads": uploads,
    "expired_runs": expired_runs,
    "image_urls": image_urls,
    "report_lines": report_lines,
    "form_documents": form_documents,
    "json_documents": json_documents,
    "reports": reports,
    "image_variants": image_variants,
    "enlarged_images": enlarged_images,
    "rendered_pages": rendered_pages,
    "samples": samples,
}


def flagship(spark, sf_dir):
    return matches(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: sql for name, sql in oracles.SQL.items() if name in QUERIES}
