"""Cells of many blocks against brute force, and vectors at the ends of the range of doubles."""

import numpy as np
import pytest

pytest.importorskip("blockloom.llm")
from blockloom.llm import covertree  # noqa: E402


def clustered(n, clusters, spread, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, 24))
    return np.concatenate([c[i % clusters] + spread * r.normal(size=24) for i in range(n)]).reshape(n, 24)


def brute(x, cosine=0.98):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    m = y @ y.T >= cosine
    np.fill_diagonal(m, False)
    top = np.arange(len(x))
    while True:
        new = np.where(m, top[None, :], len(x)).min(axis=1)
        new = np.minimum(new, top)
        if (new == top).all():
            return m.sum(axis=1), top
        top = new


def test_many_blocks_against_brute_force(spark):
    # Clusters of near copies, one of them with a third of all rows, others' cells that only touch, and equal vectors.
    x = np.concatenate([clustered(600, 40, 0.1), clustered(600, 60, 0.02, 2), np.tile(clustered(1, 1, 0, 3), (40, 1)), clustered(700, 1, 0.05, 4)])
    data = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    links, top = brute(x)
    got = {r.vec_id: r for r in covertree.near_vectors(frame, block=64).collect()}
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == top.tolist()
    assert all(got[i].kept == got[i].stays == (top[i] == i) for i in range(len(x)))


@pytest.mark.parametrize("spread, most_met, most_sent", [(0.02, 0.02, 1.2), (0.2, 0.25, 5)])
def test_cells_that_cannot_reach_each_other_are_skipped(spark, spread, most_met, most_sent):
    x = clustered(2000, 12, spread, 5)
    classes = spark.createDataFrame([(i, 1, 0, v.tolist()) for i, v in enumerate(x)], "uid long, w long, root long, vector array<double>").repartition(4)
    reach = float(np.sqrt(2 - 2 * 0.98))
    cells = covertree.grow(classes, reach, block=100)
    inside, meet = covertree.traverse(cells.nodes, reach)
    low, met = cells.nodes.filter("lowest").count(), meet.count()
    sent = covertree._meetings(cells, meet, reach, 100).select("uid").count()
    assert low >= 10 and met <= most_met * low * (low + 1) / 2 and sent <= most_sent * len(x), (low, met, inside.count(), sent)
    assert cells.rows.count() == len(x)


@pytest.mark.parametrize("scale", [1e-200, 1e-310, 1e200, 1e307])
def test_very_small_and_very_large_vectors(spark, scale):
    data = [(1, [scale, 0.0], 1), (2, [3 * scale, 0.1 * scale], 1), (3, [0.0, scale], 1), (4, [scale], 1), (4, [scale], 1), (None, [scale, 0.0], 1)]
    got = covertree.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == sorted([("1", 2, 1, True), ("2", 2, 1, False), ("3", 0, 3, True), ("4", 1, 4, True), ("4", 1, 4, True), ("None", 2, 1, False)])
    assert sum(r.stays for r in got) == 3
