"""Field matchers: for each answer of a form, whether its label supports it, and the line that says so.

The kind of field decides which candidates (texts, patterns, words) an answer has; all candidates of all answers are looked
up in one join with the label's lines. Rows have the columns of MATCH; `matches` adds the mandatory check's row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.joins import large
from vouch.operators import evidence as E

MATCH = ("app_id", "pos", "num", "question", "answer", "status", "found", "image", "line", "conf", "found_n", "of_n", "line_x1", "line_y1", "line_x2", "line_y2", "note", "mandatory", "mandatory_message", "matched_as", "form_x1", "form_y1", "form_x2", "form_y2")
_KEYS = ["app_id", "pos"]

# --- fixed values -------------------------------------------------------------------------------------------------

ANCHORS = ("governmentwarning", "surgeongeneral", "womenshouldnotdrink", "pregnancy", "birthdefects", "consumptionofalcoholicbeverages", "abilitytodrive", "healthproblems")
#: Words of an answer, and the texts that support it, best first, with what each counts as.
PRODUCTS = (("wine", "vino", "wine"), ("wine", "wine", "wine"), ("distilled", "distilled spirits", "distilled spirits"), ("malt", "malt beverage", "malt beverage"))
TABLE_RED_WINE = ("red wine", "red table wine", "vino rosso da tavola", "vino rosso")
NO_TRADENAME = "no tradename marked 'Used on label'"
ADMINISTRATIVE = "administrative field — not printed on label"
MANDATORY_QUESTION, MANDATORY_ANSWER, MANDATORY_NOTE = "GOVERNMENT WARNING (100% REQUIRED)", "100% REQUIRED", "mandatory government warning check"
CLASS_TYPE = r"(?i)CLASS/TYPE DESCRIPTION\s*\n([^\n]+)"
#: What follows a volume, and what stands beside a strength; the number goes in as it is written, its point matching anything.
AFTER_VOLUME = (r"(?:\.0+)?\s*m[l|i|!|1]\b", r"(?:\.0+)?\s*millilit(?:er|re)s?\b")
AFTER_STRENGTH = r"(?:\.0+)?\s*0?\s*(?:%|percent|per cent|alc\.?|alcohol|by vol(?:ume)?)"
BEFORE_STRENGTH, END_OF_STRENGTH = r"(?:alc\.?|alcohol)[.:]?\s*\b", r"(?:\.0+)?\b"
SEEN, INCOMPLETE, NOT_SEEN = "SEEN - government warning complete ", "INCOMPLETE - government warning ", "NOT SEEN - government warning is mandatory"


def answers(form_qa: DataFrame) -> DataFrame:
    """Answers that are not blank, trimmed, with their kind and normal form, and the box that the form shows them in (bbox_x1 to bbox_y2 of form_qa; null without)."""
    trimmed = form_qa.withColumn("answer", T.trim(F.coalesce("answer", F.lit("")))).filter(F.col("answer") != "")
    box = [(F.col(f"bbox_{c}") if f"bbox_{c}" in form_qa.columns else F.lit(None)).cast("float").alias(f"form_{c}") for c in ("x1", "y1", "x2", "y2")]
    filled = trimmed.select("app_id", "pos", F.coalesce("num", F.lit("")).alias("num"), F.coalesce("question", F.lit("")).alias("question"), "answer", *box)
    return filled.withColumn("kind", T.field_kind("question")).withColumn("a", T.norm("answer"))


def _candidate(rank: int, needle: Column | None = None, packed: bool = False, pattern: Column | None = None, words: Column | None = None) -> Column:
    """One way for a line to support an answer: a text it holds (packed: without spaces), a pattern (with a text that whatever
    it matches holds), or all of some words."""
    none = F.lit(None)
    return F.struct(
        F.lit(rank).alias("rank"), (none if needle is None else needle).cast("string").alias("needle"), F.lit(packed).alias("packed"),
        (none if pattern is None else pattern).cast("string").alias("pattern"), (none if words is None else words).cast("array<string>").alias("words"),
    )


def _some(*candidates: Column) -> Column:
    return F.filter(F.array(*candidates), lambda c: c.isNotNull())


def _whole_part(number: Column) -> Column:
    """A number's digits before its point."""
    return F.substring_index(number, ".", 1)


def net_contents() -> Column:
    """The answer itself, else its first number as millilitres."""
    number = T.first_number("answer")
    pattern = F.concat(F.lit(r"(?i)\b"), number, F.lit(AFTER_VOLUME[0] + r"|\b"), number, F.lit(AFTER_VOLUME[1]))
    return _some(_candidate(0, needle=F.col("a")), F.when(number != "", _candidate(1, needle=_whole_part(number), pattern=pattern)))


def alcohol() -> Column:
    """The answer's first number beside a word for alcohol; without a number, the answer itself."""
    number = T.first_number("answer")
    pattern = F.concat(F.lit(r"(?i)\b"), number, F.lit(f"{AFTER_STRENGTH}|{BEFORE_STRENGTH}"), number, F.lit(END_OF_STRENGTH))
    return _some(F.when(number != "", _candidate(0, needle=_whole_part(number), pattern=pattern)).otherwise(_candidate(0, needle=F.col("a"))))


def product_type() -> Column:
    """The texts that stand for the product, in their order."""
    low = T.ascii_lower("answer")
    return _some(*(F.when(F.contains(low, F.lit(word)), _candidate(i, needle=F.lit(text))) for i, (word, text, _) in enumerate(PRODUCTS)))


def _tradenames() -> Column:
    """The last four, three, two and one words before the last '(used on label)', without commas and stops at the end."""
    words = F.filter(F.split(T.before_last("answer", T.USED_ON_LABEL), r"\s+"), lambda w: w != "")
    name = lambda words, n: F.when(F.size(words) >= n, F.regexp_replace(F.array_join(F.slice(words, -n, n), " "), "[,.]+$", ""))
    return F.flatten(F.transform(F.array(words), lambda w: F.array(*(name(w, n) for n in (4, 3, 2, 1)))))


def name_address() -> Column:
    """Each trade name (column `normed`, the longest first) as written, then run together."""
    return _some(*(F.when(F.get("normed", F.lit(i)).isNotNull(), c) for i in range(4) for c in (_candidate(2 * i, needle=F.get("normed", F.lit(i))), _candidate(2 * i + 1, needle=T.compact(F.get("normed", F.lit(i))), packed=True))))


def printed_text() -> Column:
    """Brand, fanciful name, appellation, vintage: the answer on a line, else all its words of three letters or more on one."""
    return _some(_candidate(0, needle=F.col("a")), _candidate(1, words=E.tokens("a", 3)))


CANDIDATES = {"NetContents": net_contents, "Alcohol": alcohol, "ProductType": product_type, "NameAddress": name_address, "Brand": printed_text, "Fanciful": printed_text, "Appellation": printed_text, "Vintage": printed_text}
#: Kinds whose words may be anywhere on the label, their least length, and the share that counts as evidence.
SPREAD = {"Wording": (4, 0.0)} | dict.fromkeys(("Brand", "Fanciful", "Appellation", "Vintage"), (3, 1.0))


def _by_kind(values: dict[str, Column]) -> Column:
    chosen = None
    for kind, value in values.items():
        chosen = F.when(F.col("kind") == kind, value) if chosen is None else chosen.when(F.col("kind") == kind, value)
    return chosen


def supports(way: Column) -> Column:
    """Whether a line (nl, nlc) is one that a candidate asks for; a pattern runs on lines that hold its text alone, as it is compiled for each."""
    line, needle = F.col("nl"), way["needle"]
    words = (F.size(way["words"]) > 0) & F.forall(way["words"], lambda w: F.contains(line, w))
    text = (needle != "") & F.contains(F.when(way["packed"], F.col("nlc")).otherwise(line), needle)
    return F.when(way["pattern"].isNotNull(), F.contains(line, needle) & F.regexp_like(line, way["pattern"])).when(way["words"].isNotNull(), words).otherwise(text)


FORM_BOX = ("form_x1", "form_y1", "form_x2", "form_y2")


def probes(asked: DataFrame) -> DataFrame:
    """app_id, pos, q (what stays of the answer, with its trade names and its words that may be spread) and ways (its candidates, best first): a row for each answer."""
    named = asked.withColumn("names", F.when(F.col("kind") == "NameAddress", _tradenames())).withColumn("normed", F.transform("names", T.norm)).withColumn("tokens", _by_kind({kind: E.tokens("a", least) for kind, (least, _) in SPREAD.items()}))
    ways = F.coalesce(_by_kind({kind: build() for kind, build in CANDIDATES.items()}), F.array())
    return named.select(*_KEYS, F.struct("num", "question", "answer", "kind", "names", "tokens", *FORM_BOX).alias("q"), ways.alias("ways"))


def verdicts(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """MATCH rows for answers(): one join of the answers with the label's lines, and one group for each answer.

    Both sides need nothing but the application as their key, so bucketed tables (sources.stored) are not exchanged; then
    lines that cost much to normalise are read back and not made anew. An answer takes part as one row, whatever the number
    of its candidates and words, and only lines that hold one of them leave the join.
    """
    lines = corpus.select(F.col("app_id").alias("line_app"), "ord", "nl", "nlc", F.struct("image", F.col("text").alias("line"), F.col("conf").cast("double").alias("conf"), *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("e"))
    holds = lambda word: F.contains(F.col("nl"), word)
    # what a line must hold to support any way: plain texts, so that most pairs of an answer and a line cost a few searches; words of a way are among the tokens
    texts = lambda packed: F.transform(F.filter("ways", lambda w: (w["packed"] == packed) & (F.coalesce(w["needle"], F.lit("")) != "")), lambda w: w["needle"])
    wanted = F.exists("texts", holds) | F.exists("packed_texts", lambda text: F.contains(F.col("nlc"), text)) | F.exists("q.tokens", holds)
    hits = probes(asked).withColumns({"texts": texts(False), "packed_texts": texts(True)}).join(large(lines), (F.col("app_id") == F.col("line_app")) & wanted, "left")
    rank = F.get(F.filter("ways", supports), F.lit(0))["rank"]
    seen = F.filter(F.transform("q.tokens", lambda t, i: F.when(holds(t), i)), lambda i: i.isNotNull())
    hits = hits.select(*_KEYS, "q", "e", (F.shiftleft(rank.cast("long"), E.RANK_BITS) + F.col("ord")).alias("packed"), F.when(F.size(seen) > 0, seen).alias("seen"))
    rows = hits.groupBy(*_KEYS).agg(F.first("q").alias("q"), F.min("packed").alias("best"), F.min_by("e", "packed").alias("e"), F.collect_set("seen").alias("seen"))
    rows = rows.select(*_KEYS, "q.*", "best", "e", F.flatten("seen").alias("seen"))
    kind, hit, way = F.col("kind"), F.col("best").isNotNull(), F.shiftright("best", E.RANK_BITS).cast("int")
    loose = kind.isin(*SPREAD) & ~hit & (F.size("tokens") > 0)
    found_words = F.filter("tokens", lambda t, i: F.array_contains("seen", i))
    rows = rows.withColumn("of_n", F.when(loose, F.size("tokens").cast("long"))).withColumn("found_n", F.when(loose, F.size(found_words).cast("long")))
    enough = F.col("of_n").isNotNull() & (F.col("found_n") >= _by_kind({kind: F.lit(need) for kind, (_, need) in SPREAD.items()}) * F.col("of_n"))
    on_one_line = hit & kind.isin(*SPREAD) & (way == 1)
    n_words = F.size("tokens").cast("long")
    share = F.col("found_n") / F.col("of_n")
    unmarked = (kind == "NameAddress") & ~F.contains(T.ascii_lower("answer"), F.lit(T.USED_ON_LABEL))
    wording = F.when(F.col("of_n").isNull(), "EMPTY").when(share >= 0.9, "MATCH").when(share >= 0.5, "PARTIAL").otherwise("NOT FOUND")
    status = F.when((kind == "Admin") | unmarked, "SKIP").when(kind == "Wording", wording).when(hit | enough, "MATCH").otherwise("NOT FOUND")
    product = F.get(F.array(*(F.lit(name) for *_, name in PRODUCTS)), way)
    tradename = F.get("names", F.floor(way / 2).cast("int"))
    place = [F.when(hit, F.col(f"e.{c}")).otherwise(0).alias(f"line_{c}") for c in ("x1", "y1", "x2", "y2")]
    return rows.select(
        *_KEYS, "num", "question", "answer", status.alias("status"), (hit | enough).alias("found"),
        F.when(hit, F.col("e.image")).when(enough, "multiple").otherwise("").alias("image"), F.when(hit, F.col("e.line")).when(enough, F.array_join(found_words, " ")).otherwise("").alias("line"),
        F.when(hit, F.col("e.conf")).otherwise(-1.0).alias("conf"),
        F.when(on_one_line, n_words).when(enough, F.col("found_n")).alias("found_n"), F.when(on_one_line, n_words).when(enough, F.col("of_n")).alias("of_n"), *place,
        F.when(kind == "Admin", ADMINISTRATIVE).when(unmarked, NO_TRADENAME).otherwise("").alias("note"), F.lit(False).alias("mandatory"), F.lit("").alias("mandatory_message"),
        F.when(hit & (kind == "ProductType"), product).when(hit & (kind == "NameAddress"), tradename).alias("matched_as"), *FORM_BOX,
    )


def run_together(corpus: DataFrame, carry: int) -> DataFrame:
    """Lines that are not blank, with `seam`: the line without spaces, after the last `carry` characters of the label before it.

    Every text of carry + 1 characters in the label run together lies within some line's seam. The ends of lines are
    gathered by doubling: of one line, two, four and so on, until even lines of one character make up the seam.
    """
    by_line = Window.partitionBy("app_id").orderBy("ord")
    rows, reach = corpus.filter(F.col("nlc") != "").withColumn("tail", F.right("nlc", F.lit(carry))), 1
    while reach < carry:
        before = F.coalesce(F.lag("tail", reach).over(by_line), F.lit(""))
        rows, reach = rows.withColumn("tail", F.right(F.concat(before, F.col("tail")), F.lit(carry))), 2 * reach
    return rows.withColumn("seam", F.concat(F.coalesce(F.lag("tail", 1).over(by_line), F.lit("")), F.col("nlc")))


def checklist(apps: DataFrame, corpus: DataFrame, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """app_id, found_n and the evidence of the mandatory text for every application.

    Anchors are looked for in all lines of an application run together, so one may span lines and images. The line shown
    is the first with both halves of the first anchor's words, else (if any anchor is there) the first with an anchor.
    """
    held = [F.contains("seam", F.lit(x)) for x in anchors]
    both = F.contains(F.col("nl"), F.lit("government")) & F.contains(F.col("nl"), F.lit("warning"))
    own = reduce(lambda a, b: a | b, (F.contains(F.col("nlc"), F.lit(x)) for x in anchors))
    packed = F.when(both, F.col("ord")).when(own, F.col("ord") + (1 << E.RANK_BITS))
    rows = run_together(corpus, max(map(len, anchors)) - 1)
    shown = F.struct("image", F.col("text").alias("line"), F.col("conf").cast("double").alias("conf"), *(F.col(c).alias(f"line_{c}") for c in ("x1", "y1", "x2", "y2")))
    counted = rows.groupBy("app_id").agg(reduce(lambda a, b: a + b, (F.max(h.cast("long")) for h in held)).alias("found_n"), F.min_by(shown, packed).alias("e"), F.min(packed).isNotNull().alias("found"))
    counted = counted.select("app_id", "found_n", F.when(F.col("found"), True).alias("found"), *(F.when(F.col("found"), F.col(f"e.{c}")).alias(c) for c in ("image", "line", "conf", "line_x1", "line_y1", "line_x2", "line_y2")))
    all_apps = apps.select("app_id").distinct()
    return all_apps.join(large(counted), "app_id", "left").withColumn("found_n", F.coalesce("found_n", F.lit(0)).cast("long"))


def mandatory_rows(apps: DataFrame, corpus: DataFrame, last: DataFrame, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """The mandatory check as the last row of every application; last: app_id and the largest pos of its answers."""
    n = len(anchors)
    rows = checklist(apps, corpus, anchors).join(large(last), "app_id", "left")
    k = F.col("found_n")
    status = F.when(k == n, "MATCH").when(k > 0, "PARTIAL").otherwise("NOT FOUND")
    checks = F.concat(F.lit("("), k.cast("string"), F.lit(f"/{n} checks)"))
    message = F.when(k == n, F.concat(F.lit(SEEN), checks)).when(k > 0, F.concat(F.lit(INCOMPLETE), checks)).otherwise(NOT_SEEN)
    return rows.select(
        "app_id", (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("pos"), F.lit("GW").alias("num"), F.lit(MANDATORY_QUESTION).alias("question"), F.lit(MANDATORY_ANSWER).alias("answer"), status.alias("status"),
        F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("image", F.lit("")).alias("image"), F.coalesce("line", F.lit("")).alias("line"), F.coalesce(F.col("conf").cast("double"), F.lit(-1.0)).alias("conf"),
        "found_n", F.lit(n).cast("long").alias("of_n"), *(F.coalesce(f"line_{c}", F.lit(0)).cast("int").alias(f"line_{c}") for c in ("x1", "y1", "x2", "y2")),
        F.lit(MANDATORY_NOTE).alias("note"), F.lit(True).alias("mandatory"), message.alias("mandatory_message"), F.lit(None).cast("string").alias("matched_as"),
        *(F.lit(None).cast("float").alias(c) for c in FORM_BOX),
    )


def matches(apps: DataFrame, form_qa: DataFrame, corpus: DataFrame, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """A row for each answer of each application, and the mandatory row; applications without lines have it too.

    form_qa and corpus are read twice; where that costs much, give bucketed tables of them (sources.stored).
    """
    asked = answers(form_qa).withColumn("pos", F.col("pos").cast("int"))
    last = asked.groupBy("app_id").agg(F.max("pos").alias("last"))
    return verdicts(asked, corpus).unionByName(mandatory_rows(apps, corpus, last, anchors))


def class_type(pages: DataFrame, corpus: DataFrame) -> DataFrame:
    """app_id, status, class_type, matched_as, and the line: the class and type that page 2 names, on the label.

    pages: app_id, page, text. Applications whose page 2 is absent or names none are skipped.
    """
    page2 = pages.groupBy("app_id").agg(F.max(F.when(F.col("page") == 2, F.col("text"))).alias("text"))
    named = page2.select("app_id", F.regexp_like(F.coalesce("text", F.lit("")), F.lit(CLASS_TYPE)).alias("asked"), T.trim(F.regexp_extract(F.coalesce("text", F.lit("")), CLASS_TYPE, 1)).alias("class_type"))
    normed = T.norm("class_type")
    variants = F.when(normed == "table red wine", F.concat(F.array(normed), F.array(*map(F.lit, TABLE_RED_WINE)))).otherwise(F.array(normed))
    # a variant is normalised once more, which can change letters that had accents
    probes = named.filter("asked").select("app_id", F.posexplode(variants).alias("rank", "variant")).withColumn("needle", T.norm("variant")).withColumn("needle_c", T.compact("needle"))
    found = E.first_evidence(probes, corpus, ["app_id"], [E.contains_text("needle"), E.contains_text("needle_c", "nlc")])
    found = found.withColumn("rank", F.floor(F.col("way") / 2).cast("int")).join(large(probes.select("app_id", "rank", F.col("variant").alias("matched_as"))), ["app_id", "rank"]).select("app_id", "matched_as", "image", "line")
    status = F.when(~F.col("asked"), "SKIP").when(F.col("matched_as").isNotNull(), "MATCH").otherwise("NOT FOUND")
    return named.join(large(found), "app_id", "left").select("app_id", status.alias("status"), F.when(F.col("asked"), F.col("class_type")).otherwise("").alias("class_type"), F.coalesce("matched_as", F.lit("")).alias("matched_as"), F.coalesce("image", F.lit("")).alias("image"), F.coalesce("line", F.lit("")).alias("line"))


def tally(matched: DataFrame) -> DataFrame:
    """app_id, n_match and n_checked: supported answers out of those that were checked at all (not skipped)."""
    return matched.groupBy("app_id").agg(F.count_if(F.col("status") == "MATCH").alias("n_match"), F.count_if(F.col("status") != "SKIP").alias("n_checked"))
