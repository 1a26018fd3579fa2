"""Exact deduplication: two passes over a Bloom filter, so that only rows that may repeat are shuffled.

Texts are equal if identical after lower-casing A-Z only. Pass one marks the filter slots that two rows or more have
set; pass two probes every row. A row with a slot that nobody else has set is unique and passes straight through; the
rest are grouped by their SHA-256, so a false positive costs a shuffled row and never a wrong result. There is one filter
of bounded size (see bloom); beyond some 50 million rows it lets more through, and at worst all fingerprints (48 bytes a
row, no texts) are shuffled once.

Null text counts as empty; empty texts are equal to each other. Of equal texts the largest doc_id stays; a null doc_id is
smaller than any, and of equal texts without any doc_id one row stays. Rows that repeat a doc_id count each in group_size
and share its verdict. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.llm import bloom
from vouch.llm.common import joined_by_group, whole_texts, written


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and its 64-bit hash."""
    named = whole_texts(docs).select("doc_id", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return named.withColumn("h", F.xxhash64("text_sha256"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    prints = written(fingerprints(docs).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    probed = written(prints.withColumn("maybe", bloom.marked(prints.select("h"), prints.count(), 2)(F.col("h"))), "probed")
    alone = probed.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = probed.filter("maybe").select("doc_id", "row", "text_sha256")
    groups = written(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.max("row").alias("keep_row"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull() & (F.col("row") == F.col("keep_row")))
    shared = joined_by_group(again, groups, "text_sha256", "group_size").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each text: the one with the largest doc_id (a missing one is smaller than any; of equal ones any).

    Rows whose text cannot repeat pass straight through; of the others each partition sends one row a text at most.
    """
    key = F.xxhash64(ascii_lower(F.coalesce("text", F.lit(""))))
    maybe = bloom.marked(docs.select(key.alias("h")), docs.count(), 2)(key)
    named = docs.select(F.struct(*docs.columns).alias("row"), maybe.alias("maybe"))
    digest = F.sha2(ascii_lower(F.coalesce("row.text", F.lit(""))).cast("binary"), 256)
    one = named.filter("maybe").groupBy(digest.alias("digest")).agg(F.max_by("row", F.struct("row.doc_id")).alias("row"))
    return one.select("row.*").unionByName(named.filter(~F.col("maybe")).select("row.*"))


ORACLE_SQL = """
WITH named AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY text_sha256), max(doc_id) OVER (PARTITION BY text_sha256) IS NULL AND row_number() OVER (PARTITION BY text_sha256) = 1) AS kept,
       text_sha256
FROM named
"""
