"""Plans: columns are pruned, filters reach the scan, and no join is a cross join of large sides."""

import re

import pytest

from reelspark import queries as core
from reelspark.operators import labels
from reelspark.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_three_columns(spark, sf):
    p = plan(readers.read_item_manifest(spark, f"{sf}/lineitem.parquet", ("l_orderkey", "l_linenumber", "l_quantity")))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in p


def test_filter_is_pushed_down(spark, sf):
    p = plan(labels.informative(spark.read.parquet(f"{sf}/events.parquet"), "event_type", ("error",)).select("event_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", p)[1]
    assert "IsNotNull(event_type)" in pushed and "error" in pushed


@pytest.mark.parametrize("name", ["j01_enrich_manifest", "j02_attach_annotations", "j03_keep_ids", "j04_drop_ids", "j05_propagate_labels", "j09_missing_ids", "p17_encode_labels"])
def test_joins_are_equi_joins(spark, sf, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(core.QUERIES[name](spark, sf)))


@pytest.mark.parametrize("name", ["p03_spacing_plan", "p04_resample_plan", "p12_grade_text", "p19_build_text", "p20_softmax", "a05_confusion", "a09_roc_auc", "a12_ece", "w02_top_items"])
def test_no_python_in_column_work(spark, sf, name):
    assert not re.search("Python|Pandas|Arrow", plan(core.QUERIES[name](spark, sf)))
