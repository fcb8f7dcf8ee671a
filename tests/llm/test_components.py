import random

import pytest

from daybook.llm.common import Scratch
from daybook.llm.components import components


@pytest.mark.parametrize("seed, nodes, edges", [(0, 60, 40), (1, 200, 190), (2, 40, 200)])
def test_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    low = list(range(nodes))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    met = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: low[x] for x in met}
