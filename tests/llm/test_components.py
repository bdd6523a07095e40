import random

import pytest

from voxlake.llm.components import connected_components


def brute(edges):
    group = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            group.setdefault(a, a)
            group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in group and b in group and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return group


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_equals_brute_force(spark, local):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + rnd.randrange(1, 300)) for _ in range(200)] + [(1000 - k, 2000) for k in range(50)]
    edges += [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(150)] + [(5, 5), (None, 3), (7, None), (-4, 3)]
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long")
    rows = connected_components(df, "x", "y", local).collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id: r.component for r in rows} == brute(edges)


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
