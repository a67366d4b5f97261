"""Components against a plain walk."""

import random

import pytest

from harborline.llm.components import components


@pytest.mark.parametrize("shape", ["random", "path", "star", "none", "rings"])
def test_components(spark, shape):
    rng = random.Random(2)
    name = rng.sample(range(-10_000, 10_000), 400)
    edges = {
        "random": [(rng.choice(name), rng.choice(name)) for _ in range(260)],
        "path": list(zip(name, name[1:])),
        "star": [(name[7], x) for x in name],
        "none": [],
        "rings": [(name[i], name[i // 10 * 10 + (i + 1) % 10]) for i in range(400)],
    }[shape]
    beside = {}
    for a, b in edges:
        if a != b:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for node in sorted(beside):
        walk = [node]
        while walk:
            x = walk.pop()
            if x not in seen:
                seen.add(x)
                want[x] = node
                walk += beside[x]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
