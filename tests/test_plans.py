"""What the physical plans must and must not hold."""

import re
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from gridloom.operators import changes as C
from gridloom.operators.paging import _narrow
from gridloom.operators.skew import broadcast_if_small
from gridloom.plans import PLANS, changes as P

SF_DIR = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    """Physical plans of all queries, with every side taken to be too large to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.maxMetadataStringLength": "10000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        return {n: physical(p.run(spark, SF_DIR)) for n, p in PLANS.items()}
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_no_all_pairs_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_no_row_at_a_time_python(plans):
    for name, text in plans.items():
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name
        if name != "arrow_export":
            assert "InArrow" not in text and "InPandas" not in text, name


def test_single_partitions_hold_summaries_only(plans):
    """What goes through one task is a page, a partial aggregate or partition counts."""
    for name, text in plans.items():
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" not in line:
                continue
            below = lines[i + 1]
            assert re.search(r"partial_|HashAggregate\(keys=\[_part|LocalLimit", below), (name, below)


def test_measuring_adds_up_in_the_tasks(spark):
    """The job that measures a frame, run while a plan is built, moves sums only."""
    seen = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("measure", "measure")
    df = spark.range(0, 50_000, numPartitions=4).select(F.repeat(F.lit("x"), 20).alias("s"))
    broadcast_if_small(df)
    for job in tracker.getJobIdsForGroup("measure"):
        seen += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 4 in seen


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("filter_number", "GreaterThan(o_totalprice,250000.0)"),
        ("filter_model", "GreaterThan(l_quantity,25.0)"),
        ("lookup_by_id", "EqualTo(o_orderkey,742)"),
        ("page_after", "Or(LessThanOrEqual(o_totalprice,250000.0),IsNull(o_totalprice))"),
    ],
)
def test_filters_reach_the_scan(plans, name, pushed):
    assert pushed in plans[name]


@pytest.mark.parametrize(
    "name,columns",
    [
        ("duplicate_keys", "l_orderkey:bigint,l_linenumber:int"),
        ("row_count", ""),
        ("fk_violations", "l_orderkey:bigint"),
        ("distinct_ids", "l_orderkey:bigint"),
        ("insert_stats", "ts:timestamp_ntz"),
    ],
)
def test_scans_read_needed_columns_only(plans, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plans[name]


@pytest.mark.parametrize("name", ["retain_last_versions", "retain_last_snapshots"])
def test_old_versions_are_cut_before_the_shuffle(plans, name):
    text = plans[name]
    assert re.search(r"WindowGroupLimit.*Final(.|\n)*Exchange(.|\n)*WindowGroupLimit.*Partial", text)


def test_small_edits_do_not_shuffle_the_table(spark):
    grid = P.orders_grid(spark, SF_DIR)
    text = physical(C.apply_changes(grid, P.orders_log(spark, SF_DIR), "me", P.NOW))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_broadcast_is_measured(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(df))
    assert not hinted(broadcast_if_small(df, max_rows=99))
    assert not hinted(broadcast_if_small(df, max_bytes=90_000))


def test_narrowing_shrinks_the_table(spark):
    df = spark.range(0, 20_000).select((F.col("id") * 7919 % 20_000).alias("id"))
    window, skipped, rows = _narrow(df, [("id", "asc")], 12_000, 12_100, 500, 1_000)
    assert window.count() == rows <= 500 and window.agg(F.min("id")).first()[0] == skipped
    assert skipped <= 12_000


def test_checkpoints_go_to_the_named_folder(tmp_path):
    script = f"""
        import sys; sys.path.insert(0, {sys.path[0]!r})
        from pyspark.sql import SparkSession
        from gridloom.session import checkpointed, ensure_checkpoint_dir
        spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
        checkpointed(spark.range(5)).count()
        print("DIR", ensure_checkpoint_dir(spark))
    """
    out = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=120
    )
    assert str(tmp_path) in out.stdout, out.stderr
    assert any(tmp_path.rglob("part-*"))
