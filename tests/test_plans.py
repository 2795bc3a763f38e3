"""Plan-shape guards for the headline queries: no single-partition exchange, pruned scans."""

import re

import pytest

SF = "/root/testdata/sf0.01"
HEADLINE = ["augment_low_resource", "kfold_leakage_safe", "kfold_assignment_compact", "tfidf",
            "classification_report", "dedup_keep_none", "rouge_1", "rouge_l", "split_stratified", "split_plain"]


@pytest.mark.parametrize("name", HEADLINE)
def test_no_single_partition_exchange(spark, name):
    import __spark_entry__ as e
    df = e.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        # documents.source / documents.n_chars are never needed: pruning must reach the scan
        assert "source:" not in schema and "n_chars:" not in schema
