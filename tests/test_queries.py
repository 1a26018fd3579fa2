"""Every registered query of the label engine against its DuckDB SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from vouch.operators import evidence as E
from vouch.plans import registry
from vouch.plans import stand_ins as S

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def comparable(rows, columns):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x:.6g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(row[columns.index(c)]) for c in sorted(columns)) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, str(SF))
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    expected = comparable(theirs.fetchall(), theirs.columns)
    assert comparable([tuple(r) for r in ours.collect()], ours.columns) == expected
    assert expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    assert registry.queries()[name](spark, str(SF)).count()


def test_matches_exchange_little(spark):
    """Stored tables are joined and grouped where they lie; nothing is cached."""
    plan = registry.matches(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 8 and "InMemoryTableScan" not in plan and "collect_list" not in plan


def test_braces_of_patterns_are_no_tables():
    """The number in BARE_TTB_ID's {14} stays a quantifier in the SQL of documents and reports."""
    assert S.names(r"SELECT '\d{14}' FROM {part}") == {"part"}
    assert S.for_duckdb(r"SELECT '\d{14}' FROM {part}") == r"SELECT '\d{14}' FROM part"
    assert all(r"(\d{14})" in registry.oracle_sql()[name] for name in ("json_documents", "reports"))


def test_sizes_are_rounded_as_in_the_sql(spark, tmp_path):
    """Some value * 1e6 is a little less than the whole number in doubles; a cast in Spark alone loses a byte of the sample's size."""
    value = next(x / 100 for x in range(1, 60_000) if int(x / 100 * 1e6) != round(x / 100 * 1e6))
    duckdb.sql(f"COPY (SELECT 0 AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST({value!r} AS DOUBLE) AS value, '' AS props) TO '{tmp_path}/events.parquet'")
    events = duckdb.connect()
    events.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours = [r.size_bytes for r in S.frame(spark, str(tmp_path), S.RUNS).collect()]
    assert ours == [size for (size,) in events.sql(f"SELECT size_bytes FROM ({S.for_duckdb(S.RUNS)})").fetchall()] == [round(value * 1e6)]


def test_parts_are_dealt_over_tasks(spark):
    """However few row groups hold the parts; and what is made from them is not exchanged again, nor broadcast."""
    rows = registry.form_entries(spark, str(SF))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    for name in ("form_with_product", "form_boxes", "matches", "json_documents", "reports"):
        assert "BroadcastExchange" not in registry.queries()[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString(), name


def test_rasters_are_those_of_the_sql(spark):
    ours, theirs = S.rasters(spark, str(SF)), S.frame(spark, str(SF), S.RASTERS)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_no_work_for_each_pixel_in_sql(spark):
    """Pixels are drawn by line and summed in numpy: lists of pixels took most of these queries' time."""
    for name in ("checkbox_ratios", "image_variants", "enlarged_images"):
        plan = registry.queries()[name](spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in plan and "aggregate(" not in plan.replace("Aggregate", ""), name


def test_page_images_are_exchanged_and_sorted_once(spark):
    plan = registry.page_images(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_indexed_evidence_lists_wanted_grams_alone(spark):
    """The index holds what the probes ask for, not every run of letters of every line; lines are read from a table."""
    plan = registry.indexed_evidence(spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "wanted" in plan and "regexp_replace" not in plan
    lines = spark.createDataFrame([(1, i, "the quick brown fox") for i in range(50)], "app_id long, ord long, nl string")
    asked = spark.createDataFrame([(1, "fox"), (1, "cat"), (2, "the")], "app_id long, gram string")
    assert sorted(map(tuple, E.postings(lines, asked).collect())) == [(1, "fox", i) for i in range(50)]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count()
