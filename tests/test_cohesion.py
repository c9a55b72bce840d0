import numpy as np
import pytest

from talkloom.operators.cohesion import cluster_cohesion_terms


def test_deviation_of_sparse_rows(spark):
    """Exact against all pairs; the sketch within its error at several widths. Rows without terms and single rows count."""
    rng = np.random.default_rng(5)
    x = np.zeros((63, 200))
    for i in range(61):
        x[i, rng.choice(100 if i % 3 else 20, 8, replace=False)] = rng.random(8) + 0.2
        x[i] /= np.linalg.norm(x[i])
    cluster = np.array([i % 3 for i in range(61)] + [1, 7])
    weights = spark.createDataFrame(
        [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "doc_id bigint, term string, w double"
    )
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cluster)], "doc_id bigint, cluster int")
    plain = {}
    for c in (0, 1, 2):
        own = x[cluster == c]
        plain[c] = (own @ own.T)[np.triu_indices(len(own), 1)]
    exact = {r["cluster"]: r for r in cluster_cohesion_terms(weights, labels, width=None).collect()}
    for c, cosines in plain.items():
        assert exact[c]["n"] == (cluster == c).sum() and exact[c]["error"] == 0
        assert exact[c]["mean_cosine"] == pytest.approx(cosines.mean()) and exact[c]["std_cosine"] == pytest.approx(cosines.std())
    assert exact[7]["n"] == 1 and exact[7]["mean_cosine"] is None and exact[7]["std_cosine"] is None
    errors = []
    for width in (256, 4096):
        found = {r["cluster"]: r for r in cluster_cohesion_terms(weights, labels, width, repeats=16).collect()}
        for c, cosines in plain.items():
            assert abs(found[c]["mean_square"] - (cosines**2).mean()) < 5 * found[c]["error"]
        errors.append(sum(found[c]["error"] for c in plain))
    assert errors[1] < errors[0] / 2


def test_weights_are_made_once(spark):
    """Before, the mean and the squares each made them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    kind = "doc_id bigint, term string, w double"
    weights = spark.createDataFrame([(i, f"t{j}", 0.5) for i in range(20) for j in range(i, i + 4)], kind)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, cluster int")
    assert len(cluster_cohesion_terms(weights.mapInPandas(count, kind), labels, 64, 2).collect()) == 2
    assert made.value == 80
