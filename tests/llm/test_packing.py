"""The exchange of packing over many partitions, and small cases against the optimum."""

import functools

import numpy as np
import pytest

pytest.importorskip("blockloom.llm")
from blockloom.llm import packing  # noqa: E402


def packed(spark, lengths, capacity, per_part):
    rows = spark.createDataFrame([(i, i, 0, int(n)) for i, n in enumerate(lengths)], "id long, uid long, piece int, length long").repartition(4)
    return packing.pack(rows, capacity, per_part).toPandas()


def check(got, lengths, capacity):
    assert sorted(got.length) == sorted(lengths)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all() and g.length.sum() <= capacity
    return got.sequence_id.nunique()


@pytest.mark.parametrize("low, high", [(1100, 1800), (700, 1800), (1, 2048)])
def test_no_task_gets_more_than_its_share(spark, low, high, monkeypatch):
    lengths = np.random.default_rng(low).integers(low, high + 1, 100_000)
    cuts = []
    monkeypatch.setattr(packing, "cut", lambda df, real=packing.cut: cuts.append(real(df)) or cuts[-1])
    got = packed(spark, lengths, 2048, 5_000)
    most = [c.groupBy("part").count().agg({"count": "max"}).first()[0] for c in cuts if "part" in c.columns]
    assert most and max(most) <= 1.1 * 5_000, most
    assert check(got, lengths, 2048) <= 1.01 * packing.lower_bound(lengths, 2048)


def optimum(lengths, capacity):
    @functools.lru_cache(None)
    def best(left, rooms):
        if not left:
            return 0
        n, rest = left[0], left[1:]
        options = [1 + best(rest, tuple(sorted((*rooms, capacity - n))))]
        for i, r in enumerate(rooms):
            if r >= n and (not i or rooms[i - 1] != r):
                options.append(best(rest, tuple(sorted((*rooms[:i], *rooms[i + 1 :], r - n)))))
        return min(options)

    return best(tuple(sorted(map(int, lengths), reverse=True)), ())


def test_against_the_optimum():
    r = np.random.default_rng(8)
    exact = 0
    for _ in range(40):
        n = np.sort(r.integers(1, 20, 8))[::-1]
        best, used, bound = optimum(n, 20), packing.best_fit_decreasing(n, 20).max() + 1, packing.lower_bound(n, 20)
        assert bound <= best <= used <= best + 1
        exact += used == best
    assert exact >= 36


def test_small_parts_come_near_the_bound(spark):
    lengths = np.random.default_rng(5).integers(1, 100, 4000)
    assert check(packed(spark, lengths, 100, 500), lengths, 100) <= 1.01 * packing.lower_bound(lengths, 100)
