import re

import __spark_entry__ as contract


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names



def test_no_cross_products(spark, sf):
    """Plans of the large joins hold no cartesian product and no nested loop."""
    for name in ("transitions", "label_slices", "gaps", "knn", "silhouette", "repeat_position"):
        plan = contract.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_scans_are_pruned(spark, sf):
    plan = contract.queries()["anova"](spark, sf)._jdf.queryExecution().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("l_shipdate" not in s and "l_orderkey" not in s for s in schemas)
