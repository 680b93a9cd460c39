"""What relates classes and methods is dealt once for all rules of a report, also where tuples and rows are repeated."""

import pytest

from structcheck.operators import rules
from structcheck.plans import bridge

SF = "/root/testdata/sf0.001"

@pytest.mark.parametrize("name", ["chk_binding_target", "chk_abstract_has_body"])
def test_rules_of_pairs_need_no_join_of_their_own(spark, name):
    m = rules.Prepared(*bridge.instance(spark, SF, keep=True))
    assert "Join" not in rules.REGISTRY[name].check(m)._jdf.queryExecution().optimizedPlan().toString()


def _model(spark):
    t = lambda cols, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols.split()))
    return rules.Instance(
        classifier=t("repo cls is_abstract", ("r", "a", "No"), ("r", "b", "No")),
        method=t("repo method member_name param_types return_type scope is_inheritable is_abstract", *[("r", m, n, "_", r, "Instance", "Yes", v) for m, n, r, v in (("f", "x", "int", "No"), ("g", "x", "long", "Yes"), ("h", "y", "int", "No"), ("h", "y", "int", "Yes"), ("i", "y", "int", "No"))]),
        attribute=None, body=None,
        binding=t("repo binding implementer target body", ("r", "1", "a", "g", "y"), ("r", "2", "a", "g", "y"), ("r", "3", None, "f", "y"), ("r", "4", "b", "h", "y"), ("r", "5", "b", "z", "y")),
        parents=t("repo cls parent ord", ("r", "a", "b", "1")),
        local_methods=t("repo cls method", ("r", "a", "f"), ("r", "a", "f"), ("r", "a", "g"), ("r", "b", "h"), ("r", "b", "g"), ("r", None, "f"), ("r", "a", "z"), ("r", "a", "i")),
        local_attributes=t("repo cls attribute"), inherited_methods=t("repo cls method", ("r", "a", "f"), ("r", "b", None)), inherited_attributes=t("repo cls attribute"),
    )


def test_repeated_tuples_and_rows(spark):
    plain = _model(spark)
    for m in (plain, rules.Prepared(*plain)):
        got = lambda name: sorted(str(r["subject"]) for r in rules.REGISTRY[name].check(m).collect())  # noqa: E731,B023
        assert got("chk_local_inherited_disjoint") == ["f"]
        assert got("chk_binding_target") == ["5"]
        assert got("chk_abstract_has_body") == ["g", "g", "h"]
        assert got("chk_multiple_bindings") == ["g"]
        assert got("chk_missing_binding") == ["f", "f", "f", "i"]
        assert got("spec_override_implemented") == ["f", "i"]
        assert sorted(r["description"] for r in rules.REGISTRY["spec_override_return"].check(m).collect()) == ["Override f (returnType int) in a differs from overridden g (returnType long)"]
        assert sorted((r["cls"], r["method"]) for r in rules.inherited_of(m).collect()) == [("a", "f")]
        assert sorted(str(r["method"]) for r in rules.local_of(m).collect()) == ["f", "f", "f", "g", "g", "h", "h", "i"]
