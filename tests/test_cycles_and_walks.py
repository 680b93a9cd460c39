"""Classes on cycles are found without the closure of all others; a pair of a chain is made once."""

import itertools
import random

from structcheck.operators import closure, rules

EDGE = "repo string, cls string, parent string"


def plain_closure(edges):
    """All pairs, one step after the other."""
    steps = set(edges)
    found = set(steps)
    while True:
        more = {(r, c, p) for r, c, a in found for s, b, p in steps if (s, b) == (r, a)} - found
        if not more:
            return found
        found |= more


def random_edges(seed):
    g = random.Random(seed)
    return [(f"r{seed % 2}", f"c{a}", f"c{b}") for a, b in ((g.randrange(14), g.randrange(14)) for _ in range(18))]


def test_closure_and_cycles_of_random_graphs(spark):
    for seed in range(4):
        edges = random_edges(seed)
        df, pairs = spark.createDataFrame(edges, EDGE), plain_closure(edges)
        assert sorted(map(tuple, closure.ancestors(df).collect())) == sorted(pairs)
        assert sorted(map(tuple, closure.on_cycles(df).collect())) == sorted((r, c) for r, c, a in pairs if c == a)


def tree(n):
    return [("t", f"c{i}", f"c{(i - 1) // 2}") for i in range(1, n)]


def test_only_edges_of_cycles_are_closed(spark, monkeypatch):
    given, plain = [], closure.ancestors
    monkeypatch.setattr(closure, "ancestors", lambda e: (given.append(e.count()), plain(e))[1])
    edges = spark.createDataFrame([*tree(127), ("t", "c0", "c5"), ("u", "a", "a"), *tree(0)], EDGE)
    assert sorted(r["cls"] for r in closure.on_cycles(edges).collect()) == ["a", "c0", "c2", "c5"]
    assert given == [4]
    assert closure.on_cycles(edges.limit(0)).count() == 0
    assert rules.cycle(rules.Instance(*[None] * 5, edges, *[None] * 4)).count() == 4 and given == [4, 0, 4]


def test_a_pair_of_a_chain_is_made_once(spark, monkeypatch):
    made, plain = [], closure._composed
    monkeypatch.setattr(closure, "_composed", lambda a, b: (lambda df: (made.append(df.count()), df)[1])(plain(a, b)))
    chain = spark.createDataFrame([("r", f"c{i:02}", f"c{j:02}") for i, j in itertools.pairwise(range(33))], EDGE)
    assert closure.ancestors(chain).count() == 33 * 32 // 2
    leaps = 33 - 2 + 33 - 4 + 33 - 8 + 33 - 16 + 33 - 32
    assert sum(made) <= 33 * 32 // 2 - 32 + leaps
