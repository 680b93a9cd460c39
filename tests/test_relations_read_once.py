"""What a rule needs of its largest relations is read once."""

import re

import pytest

from structcheck.functions import tables
from structcheck.operators import rules
from structcheck.plans import bridge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chk_unresolved", "spec_unresolved", "chk_override_return"])
def test_inherited_methods_are_read_once(spark, name):
    m = bridge.instance(spark, SF, keep=True)
    m = m._replace(inherited_methods=tables.written(m.inherited_methods, "inherited"))
    df = rules.REGISTRY[name].check(m)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[repo#\d+,cls#\d+,method#\d+\] parquet", plan)) == (name != "chk_override_return")


def test_bindings_without_names_and_classes_on_a_cycle(spark):
    t = lambda cols, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols.split()))
    m = rules.Instance(
        classifier=t("repo cls is_abstract", ("r", "a", None), ("r", "b", "No"), ("r", "c", "Yes")),
        method=t("repo method is_abstract", ("r", "f", "No"), ("r", "g", "Yes")), attribute=None, body=None,
        binding=t("repo binding implementer target body", ("r", "1", None, "f", "y"), ("r", "2", "b", "h", "y"), ("r", "3", "b", "h", "z"), ("r", "4", "c", None, "y")),
        parents=t("repo cls parent ord", ("r", "a", "b", "1"), ("r", "b", "a", "1")),
        local_methods=t("repo cls method", ("r", "a", "f"), ("r", "a", "g"), ("r", "a", "h"), ("r", "c", "f"), ("r", "b", "i"), ("r", "b", "i")),
        local_attributes=None, inherited_methods=t("repo cls method", ("r", "b", "h"), ("r", "a", "h"), ("r", "a", None)), inherited_attributes=None,
    )
    shown = sorted((r["subject"], r["description"]) for r in rules.unresolved(m).filter("subject IS NOT NULL").collect())
    assert shown == [
        ("f", "Non-abstract classifier a has non-abstract method f with no ImplementationBinding visible in ancestor chain"),
        ("i", "Non-abstract classifier b has non-abstract method i without any ImplementationBinding"),
    ]
    assert sorted(r["subject"] for r in rules.spec_unresolved(m).collect()) == ["i"]
