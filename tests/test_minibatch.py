import numpy as np
import pytest

from talkloom.operators import minibatch
from talkloom.operators.minibatch import Batches, Centres, minibatch_kmeans, minibatch_kmeans_sweep

GROUPS = np.array([[0.0, 0, 0], [20, 0, 0], [0, 20, 0], [0, 0, 20], [20, 20, 20]])


def table(spark, n=600, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    x = GROUPS[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "doc_id bigint, vec array<double>"), x


def plain_steps(batches, seeds, k, steps, patience):
    """The same rules, row by row, on the same batches."""
    centres, seen = seeds[:k].copy(), np.zeros(k)
    mean, lowest, idle = None, np.inf, 0
    weight = min(1.0, 2 * batches.batch_size / (batches.n + 1))
    for step in range(steps):
        rows = [(r["_place"], r["vec"]) for r in batches.get(step).collect()]
        x = np.array([v for _, v in sorted(rows)])
        distance = np.array([[((row - c) ** 2).sum() for c in centres] for row in x])
        label = distance.argmin(axis=1)
        for c in range(k):
            own = x[label == c]
            if len(own):
                seen[c] += len(own)
                centres[c] += (own.sum(axis=0) - len(own) * centres[c]) / seen[c]
        inertia = distance.min(axis=1).mean()
        mean = inertia if mean is None else mean + weight * (inertia - mean)
        idle = 0 if mean < lowest * (1 - minibatch.GAIN) else idle + 1
        lowest = min(lowest, mean) if idle == 0 else lowest
        starved = np.flatnonzero(seen < minibatch.STARVED * seen.max())
        if len(starved):
            centres[starved], seen[starved] = x[: len(starved)], np.delete(seen, starved).min()
        if idle >= patience:
            break
    return centres, seen


@pytest.mark.parametrize("batch_size", [70, 1000])
def test_equals_plain_version(spark, batch_size):
    points, x = table(spark)
    # The last seed is nearest to nothing, so it starves and is put on a row.
    seeds = np.vstack([x[:6], [[1e6, 0, 0]]])
    fitted = minibatch_kmeans(points, [3, 7], batch_size=batch_size, max_iter=2, seeds=seeds)
    for k in (3, 7):
        centres, seen = plain_steps(fitted.batches, seeds, k, 2 * fitted.batches.n_batches, minibatch.PATIENCE)
        assert np.allclose(fitted.models[k].points, centres) and np.allclose(fitted.models[k].seen, seen)
        distance = ((x[:, None] - centres) ** 2).sum(axis=2)
        assert fitted.inertia[k] == pytest.approx(distance.min(axis=1).sum())
        labels = {r["doc_id"]: r["cluster"] for r in fitted.labels(k).collect()}
        assert [labels[i] for i in range(len(x))] == distance.argmin(axis=1).tolist()
    assert np.abs(fitted.models[7].points).max() < 1000


def test_batches_cover_all_rows_once(spark):
    points, _ = table(spark)
    batches = Batches(points, "doc_id", "vec", 50, 7)
    assert (batches.n, batches.n_batches) == (600, 12)
    ids = [r["doc_id"] for number in range(12) for r in batches.get(number).collect()]
    assert sorted(ids) == list(range(600))
    sizes = [batches.get(number).count() for number in range(12)]
    assert min(sizes) > 20 and max(sizes) < 90
    # The same rows whatever the partitioning; others with another seed; a batch reads few folders.
    again = Batches(points.repartition(7), "doc_id", "vec", 50, 7)
    assert [sorted(r[0] for r in b.get(3).collect()) for b in (batches, again)] == [
        sorted(r[0] for r in batches.get(3).collect())
    ] * 2
    assert Batches(points, "doc_id", "vec", 50, 8).get(3).subtract(batches.get(3)).count()
    plan = batches.get(5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_chunk" in plan and "PushedFilters: [IsNotNull(_place), GreaterThanOrEqual(_place" in plan
    folders = batches.get(5).select("_chunk").distinct().count()
    assert folders <= 2 < batches.chunks


def test_finds_the_groups(spark):
    points, x = table(spark, spread=0.5)
    fitted = minibatch_kmeans(points, 5, batch_size=100)
    found = np.array(sorted(fitted.models[5].points.round().tolist()))
    assert (found == np.array(sorted(GROUPS.tolist()))).all()
    exact = sum(((x[i] - GROUPS).T ** 2).sum(axis=0).min() for i in range(len(x)))
    assert fitted.inertia[5] < 1.05 * exact


def test_sweep_falls_and_ends(spark):
    points, _ = table(spark)
    swept = {r["k"]: r["inertia"] for r in minibatch_kmeans_sweep(points, range(1, 7), batch_size=200).collect()}
    assert list(swept) == [1, 2, 3, 4, 5, 6]
    assert all(swept[k + 1] <= 1.001 * swept[k] for k in range(1, 6)) and swept[5] < swept[4] / 5
    fitted = minibatch_kmeans(points, 2, batch_size=1000, max_iter=100)
    assert fitted.steps < 40


def test_copies_and_wrong_arguments(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "doc_id bigint, vec array<double>")
    fitted = minibatch_kmeans(same, 3, batch_size=10, max_iter=3)
    assert fitted.inertia[3] == pytest.approx(0) and fitted.labels(3).count() == 30
    for ks, size in ((0, 10), ([], 10), (31, 10), (2, 0)):
        with pytest.raises(ValueError):
            minibatch_kmeans(same, ks, batch_size=size)
    with pytest.raises(ValueError):
        minibatch_kmeans(same, 3, seeds=np.zeros((2, 2)))


def test_centres_move_by_share():
    moved = Centres(np.array([[0.0, 0], [5, 5]]), np.array([3.0, 2])).move(np.array([[4.0, 8], [0, 0]]), np.array([1.0, 0]))
    assert moved.points.tolist() == [[1, 2], [5, 5]] and moved.seen.tolist() == [4, 2]


def test_small_batches_share_a_job(spark, monkeypatch):
    """Many batches a round; before, each step was a job."""
    points, _ = table(spark)
    calls, sums = [], minibatch._sums
    monkeypatch.setattr(minibatch, "_sums", lambda *a: calls.append(1) or sums(*a))
    jobs, steps = [], Batches.steps
    monkeypatch.setattr(Batches, "steps", lambda *a: jobs.append(1) or steps(*a))
    fitted = minibatch_kmeans(points, [2, 5], batch_size=20, max_iter=4, patience=1000)
    assert fitted.steps == 4 * 30 and len(jobs) == 4 and len(calls) == 1
    # The same centres as by a job for each step.
    monkeypatch.setattr(minibatch, "STRETCH_ROWS", 0)
    apart = minibatch_kmeans(points, [2, 5], batch_size=20, max_iter=1, patience=1000)
    monkeypatch.setattr(minibatch, "STRETCH_ROWS", 200)
    parts = minibatch_kmeans(points, [2, 5], batch_size=20, max_iter=1, patience=1000)
    assert len(jobs) == 4 + 3 and apart.steps == parts.steps == 30
    for k in (2, 5):
        assert np.allclose(apart.models[k].points, parts.models[k].points)
        assert np.allclose(apart.models[k].seen, parts.models[k].seen)
