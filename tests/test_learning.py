"""Isolation forests: by walking their trees, and against the distance from the centre."""

import numpy as np
import pytest

from spindrift.operators import learning

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two clusters, and a few rows between and beside them."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal((-4, -4), 0.5, (240, 2)), rng.normal((4, 4), 0.5, (240, 2)), rng.uniform(-1.5, 1.5, (20, 2))])
    return spark.createDataFrame([(i, *map(float, v), int(i >= 480)) for i, v in enumerate(x)], "id long, a double, b double, odd int")


def test_scores_are_those_of_the_trees(rows):
    forest = learning.isolation_forest(rows, FEATURES, trees=12).cache()
    nodes = {(r.tree, r.node): r for r in forest.collect()}
    assert {t for t, _ in nodes} == set(range(12)) and all(nodes[t, 0].n == learning.ROWS_OF_TREE for t in range(12))
    for (t, k), r in nodes.items():
        if r.feature >= 0:
            assert nodes[t, 2 * k + 1].n + nodes[t, 2 * k + 2].n == r.n and nodes[t, 2 * k + 1].n and nodes[t, 2 * k + 2].n

    def depth(t, row, k=0, d=0):
        r = nodes[t, k]
        return d + learning.expected_depth(r.n) if r.feature < 0 else depth(t, row, 2 * k + 1 + (row[FEATURES[r.feature]] > r.split), d + 1)

    got = {r.id: r.anomaly for r in learning.isolated(forest, rows, FEATURES).collect()}
    for row in rows.collect():
        want = 2 ** (-np.mean([depth(t, row) for t in range(12)]) / learning.expected_depth(learning.ROWS_OF_TREE))
        assert abs(got[row.id] - want) < 1e-9


def test_order_beats_the_distance_from_the_centre(rows):
    def area(scored):
        """The share of pairs, an odd row and another, of which the odd one scores higher."""
        found = [(r.odd, r.anomaly) for r in scored.collect()]
        odd, others = ([s for o, s in found if o == k] for k in (1, 0))
        return np.mean([a > b for a in odd for b in others])

    assert area(learning.isolated(learning.isolation_forest(rows, FEATURES), rows, FEATURES)) > 0.9 > 0.5 > area(learning.anomaly(rows, rows, FEATURES))


def test_few_and_equal_rows(spark):
    one = spark.createDataFrame([(1, 2.0, None), (2, 2.0, None)], "id long, a double, b double")
    assert {r.anomaly for r in learning.isolated(learning.isolation_forest(one, FEATURES, trees=2), one, FEATURES).collect()} == {0.5}
