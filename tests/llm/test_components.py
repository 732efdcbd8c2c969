"""Connected components against a plain union of sets."""

import random

import pytest

from launchgrid.llm.common import components


def smallest_reachable(links):
    group = {}
    for a, b in links:
        if a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            group.update(dict.fromkeys(both, both))
    return {k: min(g) for k, g in group.items()}


_rng = random.Random(1)
_order = _rng.sample(range(60), 60)
CASES = {
    "empty": [],
    "loops only": [(3, 3), (-1, -1)],
    "repeated and reversed": [(1, 2), (2, 1), (1, 2), (-5, 2), (4, 4)],
    "hub": [(500, i) for i in range(300)],
    "shuffled chain": [(_order[i], _order[i + 1]) for i in range(59)],
    "random": [(_rng.randrange(300), _rng.randrange(300)) for _ in range(170)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    got = components(spark.createDataFrame(CASES[name], "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == smallest_reachable(CASES[name])
