"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for assignments, access keys and hex runs (the base spans), and for further opaque strings that
look like credentials: runs of at least `generic_chars` letters, digits and base64 signs with a letter and a digit and
`generic_bits` bits of entropy a character. The hash of each candidate's value is counted over distinct repositories
and distinct owners of the whole corpus. A value with more owners than `most_owners`, or more repositories than
`most_repos`, is a widely copied example; the others are owner-specific and look live. Base spans always stay; a generic span is added (as kind `live`) only where
its value is owner-specific and it overlaps no base span.

Here a document is a repository and its source the owner; any other columns can be named. A null owner counts as one
owner of its own. Null and empty texts have no spans (the digest is that of an empty string). Rows that repeat a
doc_id are scanned each on their own and keep a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm import bloom
from vouch.llm.common import arrow_schema, joined_by_group, slices, thrifty, written

#: Fixed patterns of the base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "live")
#: A value in more repositories is an example even where few owners hold them.
MOST_REPOS = 50
LEAST = {"assign": 12, "access": 18, "hex": 16}
_LONG_HEX, _KEYWORD = re.compile(r"[0-9a-f]{16,}"), re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)

_SPAN = "array<struct<kind:int,start:int,stop:int,value_sha256:string>>"
_SCAN_DDL = f"doc_id long, repo string, owner string, spans {_SPAN}"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base kinds; code points, end exclusive."""
    found = []
    if _KEYWORD.search(text):
        # the shorter matches are made too: they use up their characters
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(2, m.start(), m.end(), m[0]) for m in _LONG_HEX.finditer(text)]
    return found


@lru_cache(maxsize=100_000)
def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def generic_spans(text: str, taken: list[tuple[int, int, int, str]], pattern: re.Pattern, bits: float) -> list[tuple[int, int, int, str]]:
    found = []
    for m in pattern.finditer(text):
        value = m[0]
        if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value) or bits_per_character(value) < bits:
            continue
        if not any(a < m.end() and m.start() < b for _, a, b, _ in taken):
            found.append((3, m.start(), m.end(), value))
    return found


def candidates(docs: DataFrame, repo: str = "doc_id", owner: str = "source", generic_chars: int = 20, generic_bits: float = 3.0) -> DataFrame:
    """A row for each row of docs: doc_id, repo, owner and its candidate spans."""
    schema = arrow_schema(_SCAN_DDL)
    pattern = re.compile(rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{{generic_chars},}}")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                spans = []
                for text in part.column(3).to_pylist():
                    found = base_spans(text)
                    found += generic_spans(text, found, pattern, generic_bits)
                    found.sort(key=lambda x: (x[1], x[0]))
                    spans.append([{"kind": k, "start": a, "stop": b, "value_sha256": hashlib.sha256(v.encode()).hexdigest()} for k, a, b, v in found])
                yield pa.record_batch([*part.columns[:3], pa.array(spans, schema.field("spans").type)], schema=schema)

    texts = docs.select("doc_id", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(thrifty(run), _SCAN_DDL)


def ownership(spans: DataFrame) -> DataFrame:
    """value_sha256, n_repos, n_owners over the corpus; each (value, repository) and (value, owner) meets once after partial aggregation."""
    repos = spans.select("value_sha256", "repo").distinct().groupBy("value_sha256").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = spans.select("value_sha256", "owner").distinct().groupBy("value_sha256").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "value_sha256")


def judged_spans(docs: DataFrame, most_owners: int = 2, most_repos: int = MOST_REPOS, **options) -> tuple[DataFrame, DataFrame]:
    """The scanned rows (with a row number), and their spans with n_repos, n_owners and live."""
    scanned = written(candidates(docs, **options).withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    spans = scanned.select("row_id", "repo", "owner", F.explode("spans").alias("span")).select("row_id", "repo", "owner", "span.*")
    owned = written(ownership(spans), "ownership")
    # a value's rows are at least as many as its repositories
    judged = joined_by_group(spans, owned, "value_sha256", "n_repos").withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))
    return scanned, judged.filter((F.col("kind") < 3) | F.col("live"))


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_repos, n_owners: a row for each row of docs.

    n_repos and n_owners list the counts of the spans' values, in the order of spans.
    """
    scanned, judged = judged_spans(docs, **options)

    def shown(span: Column) -> Column:
        return F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), span["start"].cast("string"), span["stop"].cast("string"))

    listed = judged.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "live", "n_repos", "n_owners"))).alias("found"),
    )
    rows = scanned.select("row_id", "doc_id").join(listed, "row_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,stop:int,live:boolean,n_repos:bigint,n_owners:bigint>>")))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return rows.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", shown), ",").alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        *(F.array_join(F.col(f"found.{c}").cast("array<string>"), ",").alias(c) for c in ("n_repos", "n_owners")),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]", owner: str = "source", **options) -> DataFrame:
    """docs with every owner-specific value replaced by the mask (n_chars, where it is a column, follows); all rows stay.

    Values that many owners or repositories share are examples and stay as they are. Overlapping spans are masked as one.
    Only rows that may hold a value to mask are shuffled.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    _, judged = judged_spans(docs.select("doc_id", "text", F.col(owner).alias("owner"), key.alias("key")), repo="key", owner="owner", **options)
    live = judged.filter("live").groupBy(F.col("repo").cast("long").alias("key")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    live = written(live, "live")
    maybe = bloom.marked(live.select("key"), live.count())(key)
    named = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), maybe.alias("maybe"))

    @F.pandas_udf("string")
    def masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _mask(t, s, mask) for t, s in zip(texts, spans, strict=True)])

    joined = named.filter("maybe").join(live, "key", "left")
    row = F.col("row").withField("text", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(masked("row.text", "spans")))
    out = joined.select(row.alias("row"), "spans")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("row.text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return out.select("row.*").unionByName(named.filter(~F.col("maybe")).select("row.*"))


def _mask(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for span in spans:
        if span["stop"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at : span["start"]], mask]
        at = span["stop"]
    return "".join([*out, text[at:]])
