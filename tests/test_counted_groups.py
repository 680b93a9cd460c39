"""What a report of numbers needs: groups are counted without their items, bindings and bodies are counted once for all rules."""

from pyspark.sql import functions as F

from structcheck.operators import rules
from structcheck.plans import bridge

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_of_groups_collect_nothing(spark):
    m = bridge.instance(spark, SF)
    for name in ("chk_duplicate_names", "chk_local_namespace", "chk_inherited_method_conflict", "spec_local_namespace", "chk_multiple_bindings"):
        found = rules.REGISTRY[name].check(m)
        numbers = found.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
        assert "collect_list" in _plan(found) and "collect_list" not in _plan(numbers)
        assert numbers.agg(F.sum("n")).first()[0] == found.count()


def test_bindings_and_bodies_are_counted_once(spark):
    plain = bridge.instance(spark, SF, keep=("methods",))
    m = rules.Prepared(*plain)
    assert "Join" not in _plan(rules.REGISTRY["spec_binding_count"].check(m))
    assert m.body_counts is m.body_counts
    for name in ("spec_binding_count", "spec_body_count", "chk_orphan_body"):
        rows = [sorted(map(tuple, rules.REGISTRY[name].check(x).collect())) for x in (plain, m)]
        assert rows[0] == rows[1] and rows[0]
