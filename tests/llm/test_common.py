"""Connected components, closed in one task or in rounds, against a plain search."""

import random

import pytest

from histria.llm.common import components


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in found:
                found[x] = start
                todo += near[x]
    return sorted(found.items())


def graphs():
    r = random.Random(11)
    names = [r.randrange(-(1 << 62), 1 << 62) for _ in range(120)]
    path = list(zip(names, names[1:]))
    r.shuffle(path)
    return {
        "random": [(r.choice(names), r.choice(names)) for _ in range(90)],
        "path": path,
        "ladder": [(i, i + 1) for i in range(0, 60)] + [(100 - i, 99 - i) for i in range(0, 30)],
        "hub": [(1000, i) for i in range(80)] + [(i, 1000) for i in range(40)] + [(2000, 2001)],
        "odd": [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5), (7, 6)],
        "none": [],
    }


@pytest.mark.parametrize("name", graphs())
def test_components(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, component string").repartition(3)
    for limit in (1, 7, 1_000_000):
        got = sorted((x["node"], x["component"]) for x in components(df, limit=limit).collect())
        assert got == brute(edges), (name, limit)
