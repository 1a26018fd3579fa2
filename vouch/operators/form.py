"""Form extraction: the lines of page 1 as question and answer rows, and the widgets and checkbox that override them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.joins import large

SCALE = 1.5

# --- fixed values: patterns of the form's lines -------------------------------------------------------------------

QUESTION = r"^(\d{1,2}[a-z]?)\.\s"
STOP = r"^(PART I|PART II|PART III)\b"
#: Printed furniture: texts anywhere in a line, in either case, and what a line can begin with.
FURNITURE_TEXTS = ("omb no.", "http://", "https://", "for ttb use only")
_FURNITURE_LINES = (
    r"TTB ID$", r"TTB F \d", "DEPARTMENT OF THE TREASURY$", "ALCOHOL AND TOBACCO TAX AND TRADE BUREAU$", "APPLICATION FOR AND$", "CERTIFICATION/EXEMPTION OF LABEL/BOTTLE$", "APPROVAL$",
    r"\(See Instructions and Paperwork Reduction Act Notice on Back\)$", r"\d{1,2}/\d{1,2}/\d{2,4}, \d{1,2}:\d{2}( AM| PM)?$", r"\d+/\d+$",
)
_CONTINUATION_LINES = (r"(?:NO\.\s*)?\(?(?:Required|If any)\)?$", "IF ON LABEL$", "APPLICATION$")
FURNITURE = r"(?i)OMB No\.|https?://|FOR TTB USE ONLY|" + "|".join("^" + line for line in _FURNITURE_LINES)
CONTINUATION = "(?i)" + "|".join("^" + line for line in _CONTINUATION_LINES)
#: The lines of both in one pattern that is tried at a line's start alone, and not at each character.
PRINTED_LINES = f"(?i)^(?:{'|'.join(_FURNITURE_LINES + _CONTINUATION_LINES)})"
OPTIONS = {"WINE": "WINE", "DISTILLED SPIRITS": "DISTILLED SPIRITS", "MALT BEVERAGE": "MALT BEVERAGE", "MALT BEVERAGES": "MALT BEVERAGE"}
PRODUCT_WIDGET = "Check Box22"
DARK_RATIO, DARK_MARGIN = 0.30, 0.10


def form_lines(pages: DataFrame) -> DataFrame:
    """app_id, line_pos, s: the lines of page 1 that are neither blank nor printed furniture.

    Lines are trimmed and lower-cased as elements of their page: as columns of the exploded rows, they would be made
    anew at every place of the filter that names them.
    """
    shown = F.transform(F.transform(F.split("text", "\n"), T.trim), lambda s: F.struct(s.alias("s"), T.ascii_lower(s).alias("low")))
    lines = pages.filter(F.col("page") == 1).select("app_id", F.posexplode(shown).alias("line_pos", "line"))
    return lines.filter((F.col("line.s") != "") & ~is_printed("line.s", "line.low")).select("app_id", "line_pos", "line.s")


def is_printed(line: str, low: str | None = None) -> Column:
    """Whether a line is one that FURNITURE or CONTINUATION finds. low: the line in lower case (A-Z), where a column has it."""
    lowered = F.col(low) if low else T.ascii_lower(line)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(text)) for text in FURNITURE_TEXTS)) | F.rlike(line, F.lit(PRINTED_LINES))


def form_entries(pages: DataFrame) -> DataFrame:
    """app_id, pos, num, question, answer: a numbered line opens an entry, the lines after it are its answer, a PART line ends it.

    The prompt for name and address wraps: its lines belong to the question until one has '(Required)'.
    """
    marked = form_lines(pages).withColumns({"stop": F.rlike("s", F.lit(STOP)), "num": F.regexp_extract("s", QUESTION, 1)})
    opens = ~F.col("stop") & (F.col("num") != "")
    by_line = Window.partitionBy("app_id").orderBy("line_pos")
    islands = marked.withColumn("island", F.count_if(F.col("stop") | opens).over(by_line)).filter("island > 0")
    entries = islands.groupBy("app_id", "island").agg(
        F.min_by("stop", "line_pos").alias("stopped"),
        F.min_by("num", "line_pos").alias("num"),
        F.array_sort(F.collect_list(F.struct("line_pos", "s"))).alias("lines"),
    ).filter(~F.col("stopped"))
    lines = F.col("lines.s")
    # how many lines belong to the question: one, or up to the first with (Required) where a name and address is asked for
    required = F.array_position(F.transform(lines, lambda s: F.contains(s, F.lit("(Required)"))), True)
    address = F.contains(T.ascii_lower(F.get(lines, F.lit(0))), F.lit("name and address"))
    prompt = _prompt_lines(address, required, F.size(lines))
    pos = F.row_number().over(Window.partitionBy("app_id").orderBy("island")) - 1
    return entries.withColumn("n", prompt).select(
        "app_id", pos.cast("int").alias("pos"), "num", F.array_join(F.slice(lines, F.lit(1), F.col("n")), " ").alias("question"), F.array_join(F.slice(lines, F.col("n") + 1, F.size(lines)), " ").alias("answer")
    )


def _prompt_lines(address: Column, required: Column, size: Column) -> Column:
    return F.when(~address, 1).when(required > 0, required).otherwise(size).cast("int")


def option_lines(lines: DataFrame) -> DataFrame:
    """app_id, option, option_pos, x1, y1: the last line of page 1 that is the text of each option. lines: as in with_boxes."""
    products = list(dict.fromkeys(OPTIONS.values()))
    shown = F.create_map(*(F.lit(x) for pair in OPTIONS.items() for x in pair))
    named = lines.withColumn("option", F.try_element_at(shown, T.trim("text"))).filter(F.col("option").isNotNull())
    last = named.groupBy("app_id", "option").agg(F.max_by(F.struct("x1", "y1"), "line_pos").alias("at"))
    return last.select("app_id", "option", (F.array_position(F.array(*map(F.lit, products)), F.col("option")) - 1).cast("int").alias("option_pos"), F.col("at.x1").cast("double").alias("x1"), F.col("at.y1").cast("double").alias("y1"))


def product_of_checkboxes(ratios: DataFrame) -> DataFrame:
    """app_id, product: the option whose box is darkest, if dark enough and clearly darker than the next; else none.

    ratios: app_id, option, option_pos, dark_ratio. Of equal ratios the first option counts as the darker.
    """
    ranked = ratios.withColumn("place", F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("dark_ratio"), "option_pos")))
    best = ranked.groupBy("app_id").agg(
        F.max(F.when(F.col("place") == 1, F.col("option"))).alias("option"), F.max(F.when(F.col("place") == 1, F.col("dark_ratio"))).alias("dark"), F.max(F.when(F.col("place") == 2, F.col("dark_ratio"))).alias("second")
    )
    clear = (F.col("dark") >= DARK_RATIO) & (F.col("dark") - F.coalesce("second", F.lit(0.0)) >= DARK_MARGIN)
    return best.select("app_id", F.when(clear, F.col("option")).otherwise("").alias("product"))


def with_product(entries: DataFrame, products: DataFrame) -> DataFrame:
    """The first entry that asks for the type of product is answered by the checkbox, where one is ticked."""
    asks = F.contains(T.ascii_lower("question"), F.lit("type of product"))
    first = F.row_number().over(Window.partitionBy("app_id", asks).orderBy("pos")) == 1
    joined = entries.withColumn("first", asks & first).join(large(products), "app_id", "left")
    return joined.withColumn("answer", F.when(F.col("first") & (F.coalesce("product", F.lit("")) != ""), F.col("product")).otherwise(F.col("answer"))).select(entries.columns)


def with_boxes(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries with the box of their question's line (page points times SCALE): the k-th line of a number goes to the k-th entry.

    lines: app_id, line_pos, text, x1, y1, x2, y2 of page 1. Adds bbox_x1 to bbox_y2, null where there is none.
    """
    num = F.regexp_extract(T.trim("text"), QUESTION, 1)
    of_line = lines.withColumn("num", num).filter("num != ''").withColumn("k", F.row_number().over(Window.partitionBy("app_id", "num").orderBy("line_pos")))
    boxes = of_line.select("app_id", "num", "k", *((F.col(c) * F.lit(SCALE)).cast("float").alias(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")))
    numbered = entries.withColumn("k", F.row_number().over(Window.partitionBy("app_id", "num").orderBy("pos")))
    return numbered.join(large(boxes), ["app_id", "num", "k"], "left").drop("k").select(*entries.columns, "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")


def set_widgets(widgets: DataFrame) -> DataFrame:
    """Widgets with a name and a value, but for boxes that are off."""
    trimmed = widgets.withColumn("value", T.trim(F.coalesce("value", F.lit("")))).withColumn("name", F.coalesce("name", F.lit("")))
    return trimmed.filter((F.col("name") != "") & ~F.col("value").isin("", "Off", "/Off"))


BOX = ("x1", "y1", "x2", "y2")


def with_widgets(entries: DataFrame, widgets: DataFrame) -> DataFrame:
    """Entries overridden by widgets: app_id, pos, num, question, answer, from_widget, bbox_x1 to bbox_y2.

    A widget answers the first entry of the kind its name asks for, or adds one at the end; of widgets of one kind the
    last counts, its box (points times SCALE) too. The first product box that names a product answers the first entry that
    asks for it. Where any widget applied, administrative entries go. widgets: app_id, seq, name, value, x1, y1, x2, y2;
    entries may have boxes, which stay where no widget answers.
    """
    own_box = {f"bbox_{c}": (F.col(f"bbox_{c}") if f"bbox_{c}" in entries.columns else F.lit(None)).cast("float") for c in BOX}
    at = F.struct(*((F.col(c) * F.lit(SCALE)).cast("float").alias(c) for c in BOX)).alias("at")
    filled = set_widgets(widgets).withColumns({"kind": T.field_kind("name"), "low": T.ascii_lower("value"), "answered": F.struct("value", at)})
    product = F.when(F.contains("low", F.lit("wine")), "WINE").when(F.contains("low", F.lit("spirit")), "DISTILLED SPIRITS").when(F.contains("low", F.lit("malt")), "MALT BEVERAGE")
    boxes = filled.filter(F.col("name") == PRODUCT_WIDGET).withColumn("product", product).filter(F.col("product").isNotNull())
    boxed = boxes.groupBy("app_id").agg(F.min_by(F.struct(F.col("product").alias("value"), at), "seq").alias("answered")).withColumn("kind", F.lit("ProductType")).withColumns({"name": F.lit(None).cast("string"), "seq": F.lit(0)})
    texts = filled.filter(~F.col("kind").isin("Admin", "ProductType")).groupBy("app_id", "kind").agg(F.max_by("answered", "seq").alias("answered"), F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    values = boxed.unionByName(texts.select(boxed.columns))
    own = entries.withColumns({"kind": T.field_kind("question")} | own_box)
    first = F.row_number().over(Window.partitionBy("app_id", "kind").orderBy("pos")) == 1
    own = own.withColumn("first", first).withColumn("join_kind", F.when(F.col("first"), F.col("kind")))
    wanted = values.select("app_id", F.col("kind").alias("join_kind"), "name", "answered.value", "answered.at", "seq")
    joined = own.join(large(wanted), ["app_id", "join_kind"], "full_outer")
    # a product box without an entry that asks for the product applies to nothing
    joined = joined.filter(F.col("pos").isNotNull() | F.col("name").isNotNull())
    applied = F.max(F.col("value").isNotNull()).over(Window.partitionBy("app_id"))
    rows = joined.select(
        "app_id", "pos", "seq", F.coalesce("num", F.regexp_extract("name", QUESTION, 1), F.lit("")).alias("num"), F.coalesce("question", "name").alias("question"), F.coalesce("value", "answer").alias("answer"),
        F.col("value").isNotNull().alias("from_widget"), applied.alias("applied"), *(F.when(F.col("value").isNotNull(), F.col(f"at.{c}")).otherwise(F.col(f"bbox_{c}")).alias(f"bbox_{c}") for c in BOX),
    )
    rows = rows.filter(~F.col("applied") | (T.field_kind("question") != "Admin"))
    place = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("pos").asc_nulls_last(), "seq")) - 1
    return rows.select("app_id", place.cast("int").alias("pos"), "num", "question", "answer", "from_widget", *(f"bbox_{c}" for c in BOX))
