"""Cases that an operator once left out."""

import inspect

import numpy as np

from structcheck.llm import pivot_index, toxicity

DOCS = "doc_id long, text string"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_signs_doubles_and_spaced_signs_are_restored(spark):
    plain = "you stupid idiot and loser clown threw trash at a moron"
    r = toxicity.Restorer(toxicity.language_model(toxicity.count_trigrams(docs(spark, [plain] * 30 + ["all good letters (all of them) stop! here"] * 30))))
    given = {"!diot": "idiot", "!d!ot": "idiot", "|oser": "loser", "(lown": "clown", "stuupid": "stupid", "iddiot": "idiot", "idiiot": "idiot", "t r @ s h": "trash", "$ t u p 1 d": "stupid", "i d i o t.": "idiot.", "m o r o n, you": "moron, you"}
    assert {k: r.text(k) for k in given} == given
    same = "all good letters (all of them) stop! here 5 + 3"
    assert r.text(same) == same


def test_recall_at_the_threshold_does_not_fall_with_the_table():
    rng = np.random.default_rng(4)
    by_name = {n: p.default for n, p in inspect.signature(pivot_index.near_duplicates).parameters.items()}
    pivots = pivot_index.unit(rng.normal(size=(1 << 14, 64)))[: by_name["most_pivots"]]
    a, z = pivot_index.unit(rng.normal(size=(2000, 64))), rng.normal(size=(2000, 64))
    z = pivot_index.unit(z - (z * a).sum(1, keepdims=True) * a)
    near, other = (pivot_index.nearest(x, pivots, by_name["k"] or pivot_index.neighbours(len(pivots))) for x in (a, 0.9 * a + np.sqrt(1 - 0.81) * z))
    assert np.mean([len(set(x) & set(y)) >= 2 for x, y in zip(near, other)]) >= 0.9


def test_each_dimension_is_compared_by_itself(spark):
    given = [(i, [1.0, float(i % 2), 0.5]) for i in range(6)] + [(i, [1.0, float(i % 2)]) for i in range(6, 10)] + [(10, [2.0]), (11, None)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.near_duplicates(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()}
    assert out == {i: (2, i % 2) for i in range(6)} | {i: (1, 6 + i % 2) for i in range(6, 10)} | {10: (0, 10), 11: (0, 11)}
