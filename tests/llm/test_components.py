"""Components beside a plain union-find."""

import random

import pytest

from lucarne.llm.components import components
from lucarne.llm.shared import Staging


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


pick = random.Random(4)
GRAPHS = {
    "random": [(pick.randrange(300), pick.randrange(300)) for _ in range(200)],
    "path": [(i, i + 1) for i in range(120)],
    "star": [(500, i) for i in range(400)],
    "odd": [(1, 1), (2, 1), (1, 2), (2, 1), (None, 3), (4, None), (-5, 2)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    got = components(spark.createDataFrame(GRAPHS[name], "a long, b long"), Staging(spark, "test"))
    rows = [(r.node, r.root) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == plain(GRAPHS[name])
