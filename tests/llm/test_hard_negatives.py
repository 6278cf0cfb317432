"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from fraylens.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block string, part long"


def brute(rows):
    good = {}
    for i, vector, label, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, q) in good.items():
        if a % 50:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, (l, v) in good.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fits = [r for r in ranked if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df).collect())


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_equals_brute_force(spark, spread):
    """Clusters, a hot label, many ties, broken and repeated rows; several blocks of a label."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, spread, (12, 6))
    rows = []
    for i in range(4000):
        c = int(rng.integers(12))
        v = np.round(centres[c] + rng.normal(0, 0.1, 6), 2).astype("f4").tolist()
        label = 3 if rng.random() < 0.4 else c % 10
        rows.append((i, v, label, "x", 1))
    rows[50] = (50, None, 3, "x", 1)
    rows[51] = (51, [0.1, None] + [0.0] * 4, 3, "x", 1)
    rows[52] = (52, [float("nan")] * 6, 3, "x", 1)
    rows[53] = (53, [float("inf")] * 6, 3, "x", 1)
    rows[100] = (100, rows[100][1], None, "x", 1)
    rows += [(None, rows[1][1], 3, "x", 1), rows[150], rows[150], rows[7], (200, [0.0] * 6, 3, None, None)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert len({r[0] for r in want}) > 60 and len(want) > 600
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want


def test_small_and_empty_tables(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(50, [1.0], 1, "", 0)], SCHEMA)) == []
    rows = [(50, [1.0, 2.0], 1, "", 0), (51, [1.0], 1, "", 0), (52, [0.5, 0.2], 2, "", 0), (54, [], 2, "", 0), (55, [0.3, 0.3], 4, "", 0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == [(50, 51, 1, 55, 65536, 58368)] or got(spark.createDataFrame(rows, SCHEMA)) == brute([(i, v + [0.0] * (2 - len(v)), l) for i, v, l, *_ in rows])


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 2e5, 4).astype("f4").tolist(), int(rng.integers(3)), "", 0) for i in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_hilbert_curve_visits_neighbours():
    """All places once, each next to the one before it."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    place = hard_negatives.hilbert(cells, 3)
    path = cells[np.argsort(place)]
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(6)
    q, box = rng.integers(-50, 50, (20, 5)), rng.integers(-50, 50, (30, 5))
    least, most = hard_negatives.bounds(q, box.min(0)[None], box.max(0)[None])
    s = q @ box.T
    assert (least[:, 0] <= s.min(1)).all() and (most[:, 0] >= s.max(1)).all()
