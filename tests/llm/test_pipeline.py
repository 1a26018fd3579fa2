"""The corpus pipeline against a plain version of its stages, and the SQL of its operators."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from vouch.llm import registry, toxicity

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def test_oracles(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        ours = registry.queries()[name](spark, str(SF))
        theirs = db.sql(sql)
        columns = sorted(theirs.columns)
        assert sorted(ours.columns) == columns
        assert sorted(map(tuple, ours.select(columns).collect())) == sorted(theirs.select(", ".join(columns)).fetchall())


def test_stages_follow_from_each_other(spark):
    from test_operators import plain_groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(SF))
        assert now.columns == columns
        kept.append({r.doc_id: r.text for r in now.collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(kept[0]) == {r.doc_id for r in scores if not r.predicted}
    last = {}
    for i in sorted(kept[0]):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])] = i
    assert set(kept[1]) == set(last.values())
    assert set(kept[2]) == {i for i, least, _ in plain_groups([(i, texts[i]) for i in kept[1]]) if i == least}
    assert set(kept[3]) == set(kept[2])
    assert all(kept[3][i] == texts[i] or "[SECRET]" in kept[3][i] for i in kept[3])
    pieces = corpus_pipeline.run(spark, str(SF)).collect()
    assert {r.doc_id for r in pieces} == set(kept[3])


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, an empty table and columns named like the stages' own."""
    from test_operators import ROWS, table

    odd = table(spark, ROWS).selectExpr("*", "'x' AS row", "1 AS __doc_key", "2 AS __spans", "3 AS digest", "4 AS row_key")
    labels = spark.createDataFrame([(8, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, odd.limit(0)):
        rows = docs.count()
        kept = [toxicity.without_toxic(docs, labels), *(stage(spark, docs, "") for _, stage in corpus_pipeline.STAGES[1:4])]
        assert all(k.columns == docs.columns for k in kept)
        counts = [k.count() for k in kept]
        assert counts[3] == rows and all(n <= rows for n in counts)
        assert not rows or counts[1] == len({"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for _, t in ROWS})
        pieces = corpus_pipeline.STAGES[4][1](spark, docs, "")
        assert {r.doc_id for r in pieces.collect()} == ({i for i, _ in ROWS} if rows else set())
