"""The quality model is fitted on all labelled rows, and exactly."""

import numpy as np
import pytest

from fraylens.llm import quality


def brute_threshold(score, good, loss=quality.LOSS):
    best, cut = 0.0, 1.0
    for s in np.unique(score)[::-1]:
        lost, found = (good & (score >= s)).sum() / good.sum(), (~good & (score >= s)).sum() / (~good).sum()
        if lost <= loss and found - lost > best:
            below = score[score < s]
            best, cut = found - lost, (s + (below.max() if len(below) else s - 0.01)) / 2
    return cut


@pytest.mark.parametrize("seed", range(3))
def test_threshold_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    good = rng.random(3000) < 0.9
    score = np.round(np.where(good, rng.beta(4, 6, 3000), rng.beta(6, 5, 3000)), (2, 3, 9)[seed])  # ties
    rows = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good)], "score double, good boolean")
    assert quality.threshold(rows.repartition(5)) == pytest.approx(brute_threshold(score, good), abs=1e-12)
    assert quality.threshold(rows.where("good")) == quality.threshold(rows.where("not good")) == quality.threshold(rows.limit(0)) == 1.0


def test_trees_draw_from_all_rows(spark):
    """Rows beyond the first 20,000 hashes take part, each tree has rows of its own, and the forest is the same for any partitioning."""
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.random((30_000, 5)))], "doc_id long, x array<double>")
    x = np.vstack([rng.random((500, 5)), np.full((5, 5), 3.0)])
    one, two = (quality.fit_forest(r) for r in (rows, rows.unionByName(rows.limit(2000)).repartition(7)))
    assert len(one.roots) == quality.TREES and one.rows == quality.ROWS
    assert (one.score(x) == two.score(x)).all() and one.score(x)[-5:].min() > one.score(x)[:500].max()
    few = quality.fit_forest(rows.limit(3), trees=4)
    assert few.rows == 3 and len(few.roots) == 4
    empty = quality.fit_forest(rows.limit(0))
    assert len(empty.roots) == 0 and (empty.score(x) == 1).all()


def test_every_labelled_document_counts(spark, monkeypatch):
    """24,000 labelled documents: all of them reach the forest and the threshold."""
    words = " ".join(f"w{i}" for i in range(24))
    docs = spark.range(24_000).selectExpr("id AS doc_id", f"concat('{words} ', repeat('x', int(id % 7))) AS text").repartition(4)
    labels = docs.selectExpr("doc_id", "int(doc_id % 50 <> 0) AS quality")
    seen = {}
    plain = quality.fit_forest, quality.threshold
    monkeypatch.setattr(quality, "fit_forest", lambda rows: [seen.update(forest=rows.count()), plain[0](rows, trees=5)][1])
    monkeypatch.setattr(quality, "threshold", lambda scored: [seen.update(threshold=scored.count()), plain[1](scored)][1])
    quality.fit(docs, labels)
    assert seen == {"forest": 24_000, "threshold": 24_000}
