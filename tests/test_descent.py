import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.operators import blocks, descent, knn
from talkloom.operators.descent import approximate_knn


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k bigint, vec array<double>")


def recall(found, exact, n, k):
    got, wanted = ({(r["k"], r["neighbour"]) for r in df.collect()} for df in (found, exact))
    assert len(wanted) == n * k
    return len(got & wanted) / len(wanted)


def test_recall_in_high_dimensions(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 128)
    monkeypatch.setattr(descent, "BLOCK_ROWS", 128)
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(60, 24)), 25, axis=0) + 0.7 * rng.normal(size=(1500, 24))
    points = frame(spark, x)
    found = approximate_knn(points, 10, "k", "vec", "euclidean")
    lists = found.lists.cache()
    assert recall(lists, knn.knn_graph(points, 10, "k", "vec", "euclidean"), 1500, 10) >= 0.95
    assert found.recall >= 0.95 and found.rounds >= 1
    assert lists.count() == 15_000 and lists.where("k = neighbour").count() == 0
    assert sorted({r["rank"] for r in lists.collect()}) == list(range(1, 11))
    for r in lists.where("k % 100 = 7").collect():
        assert r["distance"] == pytest.approx(np.sqrt(((x[r["k"]] - x[r["neighbour"]]) ** 2).sum()))
    # The start alone is worse: the descent is what finds them.
    assert approximate_knn(points, 10, "k", "vec", "euclidean", rounds=0).recall < found.recall - 0.05


def test_hubs_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(descent, "MEETING", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros((1, 12)), rng.normal(size=(300, 12)) * 3])  # the middle is near to all
    points = frame(spark, x)
    rows = points.select(F.col("k").alias("key"), "vec")
    lists = spark.createDataFrame([(i, 0, 1.0, 1) for i in range(1, 301)], "key bigint, neighbour bigint, distance double, new int")
    groups = [sorted(r["keys"]) for r in descent._meetings(lists, rows, 1, 0).collect()]
    assert max(map(len, groups)) <= 48
    met = sorted(i for g in groups if 0 not in g for i in g)
    assert met == list(range(1, 301))  # all that hold the hub, each once
    again = [sorted(r["keys"]) for r in descent._meetings(lists, rows, 1, 1).collect()]
    assert sorted(again) != sorted(groups)
    assert recall(approximate_knn(points, 5, "k", "vec", "euclidean").lists, knn.knn_graph(points, 5, "k", "vec", "euclidean"), 301, 5) >= 0.95


def test_copies_and_small_tables(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 5)), np.ones((40, 5))])
    points = frame(spark, x)
    found = approximate_knn(points, 4, "k", "vec").lists
    exact = knn.knn_graph(points, 4, "k", "vec")
    assert recall(found, exact, 100, 4) >= 0.95
    assert [r["neighbour"] for r in found.where("k = 99").orderBy("rank").collect()] == [60, 61, 62, 63]
    two = approximate_knn(frame(spark, x[:2]), 4, "k", "vec")
    assert [(r["k"], r["neighbour"]) for r in two.lists.orderBy("k").collect()] == [(0, 1), (1, 0)] and two.recall == 1
    assert approximate_knn(frame(spark, x[:0]), 4, "k", "vec").lists.count() == 0


def test_vectors_are_not_sent_by_the_driver(spark):
    rows = frame(spark, np.eye(4)).select(F.col("k").alias("key"), "vec")
    lists = spark.createDataFrame([(i, 0, 1.0, 1) for i in range(1, 4)], "key bigint, neighbour bigint, distance double, new int")
    plan = descent._meetings(lists, rows, 1, 0)._jdf.queryExecution().analyzed().toString()
    assert plan.count("strategy=broadcast") == 1  # the hubs, an id and a number each
