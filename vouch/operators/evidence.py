"""First-evidence lookup: for every probe of an application, the first line of its label that supports it.

A lookup is an equi join on app_id with a condition on the line, then the least (rank, order) of each probe. Only one
number is aggregated (a hash aggregate with partial sums on the map side); the line itself is joined back afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import text as T
from vouch.functions.joins import large

EVIDENCE = ("found", "image", "line", "conf", "found_n", "of_n", "line_x1", "line_y1", "line_x2", "line_y2")
#: Ranks of a probe's ways to match stand above the order of lines.
RANK_BITS = 54
#: Characters of a posting.
GRAM = 3


def contains_text(needle: Column | str, haystack: str = "nl") -> Column:
    """The line holds a normalised text; an empty one is held by no line."""
    needle = T.column(needle)
    return (needle != "") & F.contains(F.col(haystack), needle)


def postings(corpus: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """app_id, gram, ord: the lines that hold each run of GRAM characters; with `wanted` (app_id, gram), those runs alone.

    Then an application's wanted runs come to its lines as a list, and a line gives rows for what it holds of them.
    """
    lines = corpus.filter(F.char_length("nl") >= GRAM)
    grams = F.array_distinct(_grams("nl"))
    if wanted is not None:
        lines = lines.select("app_id", "ord", "nl").join(large(wanted.groupBy("app_id").agg(F.collect_set("gram").alias("wanted"))), "app_id")
        few = F.size("wanted") <= F.char_length("nl")
        grams = F.when(few, F.filter("wanted", lambda g: F.contains("nl", g))).otherwise(F.array_intersect(grams, "wanted"))
    return lines.select("app_id", "ord", F.explode(grams).alias("gram")).select("app_id", "gram", "ord")


def _grams(text: Column | str) -> Column:
    text = T.column(text)
    return F.transform(F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM)))


def candidates(probes: DataFrame, corpus: DataFrame, through: str, index: DataFrame | None = None) -> DataFrame:
    """Probes with the lines (ord, nl, nlc) that hold the rarest gram of the text in column `through`, for texts of GRAM characters or more.

    Texts with a gram that no line of their label has are left out. index: postings(), if they are at hand.
    """
    texts = probes.filter(F.char_length(through) >= GRAM).select("app_id", F.col(through).alias("through")).distinct()
    wanted = texts.select("app_id", "through", F.explode(F.array_distinct(_grams("through"))).alias("gram"))
    index = postings(corpus, wanted.select("app_id", "gram")) if index is None else index
    known = index.groupBy("app_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(known, ["app_id", "gram"], "left").groupBy("app_id", "through").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    found = rarest.select("app_id", "through", F.col("r.gram").alias("gram")).join(index, ["app_id", "gram"]).select("app_id", F.col("through").alias(through), "ord")
    return probes.join(found, ["app_id", through]).join(corpus.select("app_id", "ord", "nl", "nlc"), ["app_id", "ord"])


def first_evidence(probes: DataFrame, corpus: DataFrame, keys: list[str], ways: list[Column], through: str | None = None) -> DataFrame:
    """keys, way (from 0) and the evidence of the first line that a probe finds; probes without one are left out.

    A probe (a row with app_id among keys) may have several ways to match, best first; a better way wins over an earlier
    line. A column `rank`, if the probe has one, stands above the ways. through: a column whose text every supporting line
    holds; then lines are found by that text's rarest gram, which pays for labels of many lines. Shorter texts, and null, meet all lines.
    """
    way = None
    for i, condition in enumerate(ways):
        way = F.when(condition, i) if way is None else way.when(condition, i)
    rank = F.col("rank") if "rank" in probes.columns else F.lit(0)
    held = ways[0]
    for condition in ways[1:]:
        held = held | condition
    lines = corpus.select("app_id", "ord", "nl", "nlc")
    if through is None:
        hits = probes.join(large(lines), "app_id")
    else:
        short = probes.filter(F.coalesce(F.char_length(through) < GRAM, F.lit(True)))
        hits = candidates(probes, corpus, through).unionByName(short.join(large(lines), "app_id"))
    hits = hits.filter(held)
    best = hits.groupBy(*keys).agg(F.min(F.shiftleft((rank * len(ways) + way).cast("long"), RANK_BITS) + F.col("ord")).alias("best"))
    best = best.withColumn("ord", F.col("best").bitwiseAND((1 << RANK_BITS) - 1)).withColumn("way", F.shiftright("best", RANK_BITS).cast("int"))
    return best.join(large(corpus.select("app_id", "ord", "image", F.col("text").alias("line"), "conf", *(F.col(c).alias(f"line_{c}") for c in ("x1", "y1", "x2", "y2")))), ["app_id", "ord"]).select(
        *keys, "way", F.lit(True).alias("found"), "image", "line", "conf", "line_x1", "line_y1", "line_x2", "line_y2"
    )


def tokens(normed: Column | str, least: int) -> Column:
    """The words of a normalised text with at least so many characters, repeated ones included."""
    return F.filter(F.split(T.column(normed), " "), lambda t: (t != "") & (F.char_length(t) >= least))


def token_coverage(probes: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """keys, of_n, found_n and the found words (in answer order) for probes with an array `tokens`; every probe stays.

    Distinct words are looked up; repeated ones count as often as they occur.
    """
    listed = probes.select(*keys, F.posexplode("tokens").alias("i", "token"))
    wanted = listed.select("app_id", "token").distinct()
    held = wanted.join(corpus.select("app_id", "nl"), "app_id").filter(F.contains(F.col("nl"), F.col("token"))).select("app_id", "token").distinct().withColumn("held", F.lit(True))
    counted = listed.join(held, ["app_id", "token"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("of_n"),
        F.count_if(F.col("held")).alias("found_n"),
        F.array_sort(F.collect_list(F.when(F.col("held"), F.struct("i", "token")))).alias("words"),
    )
    return counted.select(*keys, "of_n", "found_n", F.array_join(F.col("words.token"), " ").alias("words"))
