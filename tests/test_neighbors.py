"""The pivot-based neighbour search against brute force, on inputs made to stress its pruning."""

import numpy as np
import pytest

from gridsieve.operators import neighbors


def brute(q, r, k, exclude_self=False):
    d = np.sqrt(((q[:, None, :] - r[None, :, :]) ** 2).sum(-1))
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def mean_finite(d):
    return np.array([row[np.isfinite(row)].mean() if np.isfinite(row).any() else np.nan for row in d])


def frame(spark, m, partitions=3):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>").repartition(partitions)


def run(df):
    return np.array([row["knn_distance"] for row in df.orderBy("id").collect()], dtype=float)


def clusters(seed, n=240, d=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (5, d))
    return centres[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, d))


@pytest.mark.parametrize("block_rows", [512, 8])
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed, block_rows):
    r, q = clusters(seed), clusters(seed + 10, 60)
    got = run(neighbors.knn_mean_distance(frame(spark, q), frame(spark, r), "v", 5, block_rows=block_rows))
    np.testing.assert_allclose(got, mean_finite(brute(q, r, 5)), rtol=1e-9)


@pytest.mark.parametrize("block_rows", [512, 8])
def test_hot_copies_and_near_copies(spark, block_rows):
    rng = np.random.default_rng(3)
    base = clusters(2, 120)
    copies = np.repeat(base[:1], 60, axis=0)
    near = base[1] + rng.normal(0, 1e-6, (60, base.shape[1]))
    m = np.concatenate([base, copies, near])
    got = run(neighbors.knn_mean_distance(frame(spark, m), None, "v", 5, block_rows=block_rows))
    np.testing.assert_allclose(got, mean_finite(brute(m, m, 5, True)), rtol=1e-7, atol=1e-12)
    against = run(neighbors.knn_mean_distance(frame(spark, m[:40]), frame(spark, m), "v", 5, block_rows=block_rows))
    np.testing.assert_allclose(against, mean_finite(brute(m[:40], m, 5)), rtol=1e-7, atol=1e-12)


def test_all_rows_identical(spark):
    m = np.ones((20, 3))
    assert (run(neighbors.knn_mean_distance(frame(spark, m), None, "v", 5)) == 0).all()


@pytest.mark.parametrize("n", [1, 2, 4])
def test_fewer_rows_than_neighbours(spark, n):
    r, q = clusters(5, n), clusters(6, 7)
    got = run(neighbors.knn_mean_distance(frame(spark, q), frame(spark, r), "v", 5))
    np.testing.assert_allclose(got, mean_finite(brute(q, r, 5)), rtol=1e-9)
    own = run(neighbors.knn_mean_distance(frame(spark, r), None, "v", 5))
    np.testing.assert_allclose(own, mean_finite(brute(r, r, 5, True)), rtol=1e-9)


def test_negative_zero_is_zero(spark):
    r = np.array([[0.0, 1.0], [-0.0, 1.0], [3.0, -0.0]])
    got = run(neighbors.knn_mean_distance(frame(spark, r), frame(spark, r), "v", 2))
    np.testing.assert_allclose(got, mean_finite(brute(r, r, 2)), rtol=1e-12)


def test_novelty_takes_every_training_row(spark):
    r, q = clusters(1, 1300), clusters(2, 30)
    want = mean_finite(brute(q, r, 5))
    rows = neighbors.novelty_score(frame(spark, q), frame(spark, r), "v", 5).orderBy("id").collect()
    np.testing.assert_allclose([x["novelty_score"] for x in rows], (want - want.min()) / (want.max() - want.min()), rtol=1e-7, atol=1e-9)


def test_standardized_domain(spark):
    train, q = clusters(1, 80) * [1, 100, 1, 1], clusters(2, 20) * [1, 100, 1, 1]
    labelled, threshold = neighbors.applicability_domain(frame(spark, train), frame(spark, q), "v", 3, 1.0, scale=True)
    mu, sd = train.mean(0), train.std(0)
    a, b = (train - mu) / sd, (q - mu) / sd
    own = mean_finite(brute(a, a, 3, True))
    want = mean_finite(brute(b, a, 3))
    assert threshold.first()["ad_threshold"] == pytest.approx(own.mean() + own.std())
    rows = labelled.orderBy("id").collect()
    np.testing.assert_allclose([row["ad_score"] for row in rows], want, rtol=1e-9)
    assert [row["within_ad"] for row in rows] == list(want <= own.mean() + own.std())


def test_bounded_groups_and_numbers_that_overflow(spark, monkeypatch):
    """A full block meets its queries in several groups; squares beyond a double do not lose a near vector."""
    monkeypatch.setattr(neighbors, "MEET", 16)
    rng = np.random.default_rng(4)
    m = rng.normal(0, 1, (150, 12))
    got = run(neighbors.knn_mean_distance(frame(spark, m), None, "v", 5, block_rows=70))
    np.testing.assert_allclose(got, mean_finite(brute(m, m, 5, True)), rtol=1e-9)
    huge = np.array([[1e200, 0.0], [1e200, 0.0], [1e200, 3.0], [1e6 + 1e-7, 1.0], [1e6, 1.0]])
    block = neighbors.Block(huge, np.array([1, 2, 1, 1, 1]))
    assert block.nearest(huge[:1], 4)[0].tolist() == [0.0, 0.0, 0.0, 3.0]
    assert block.nearest(huge[3:4], 2)[0].tolist() == [0.0, huge[3, 0] - huge[4, 0]]
