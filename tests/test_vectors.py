import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions.vectors import ml_vectors
from talkloom.operators import blocks, cell_blocks, density, embed, kmeans, knn, profile, reduce


def frame(spark, x, key="k"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"{key} bigint, vec array<double>")


def with_labels(spark, labels, key="k"):
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], f"{key} bigint, cluster int")


def distances(x, metric):
    x = np.asarray(x, float)
    if metric == "euclidean":
        return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return 1 - u @ u.T


def brute_knn(x, k, metric):
    d = distances(x, metric)
    return {i: sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}


def got_knn(df, key="k"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append((round(r["distance"], 9), r["neighbour"]))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_over_many_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, size=(100, 6)) for c in (0, 4, 9, -7)])
    assert got_knn(knn.knn_graph(frame(spark, x), 5, "k", "vec", metric)) == brute_knn(x, 5, metric)


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(100 * c, 0.1, size=(100, 4)) for c in range(6)])
    rows = frame(spark, x, "key")
    packed = blocks.pack_blocks(knn.with_cells(rows, len(x), 42), "key", ["vec"], "cell")
    packed = packed.cache()
    pairs = knn._near_pairs(knn._block_bounds(packed, 5)).count()
    n = packed.count()
    assert n <= pairs < n * n / 2


def test_third_of_the_vectors_are_copies(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    x[::3] = x[0]
    x[1] = x[2]
    assert got_knn(knn.knn_graph(frame(spark, x), 4, "k", "vec", "euclidean")) == brute_knn(x, 4, "euclidean")


def test_fewer_points_than_neighbours(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [3.0, 0.0]]
    assert got_knn(knn.knn_graph(frame(spark, x), 10, "k", "vec", "euclidean")) == brute_knn(x, 2, "euclidean")


def test_zero_vector_is_at_cosine_distance_one(spark):
    x = [[0.0, 0.0], [1.0, 0.0], [1.0, 0.1]]
    got = got_knn(knn.knn_graph(frame(spark, x), 2, "k", "vec", "cosine"))
    assert got[0] == [(1.0, 1), (1.0, 2)]


def test_cohesion_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    labels = np.array([-1, 0, 1] * 19 + [0, 1, 2])
    got = {r["cluster"]: r for r in profile.cluster_cohesion(frame(spark, x), with_labels(spark, labels), "k", "vec").collect()}
    similarity = 1 - distances(x, "cosine")
    for c in (-1, 0, 1):
        at = np.flatnonzero(labels == c)
        pairs = [similarity[i, j] for i, j in itertools.combinations(at, 2)]
        assert (got[c]["n"], got[c]["mean_cosine"], got[c]["std_cosine"]) == (
            len(at), pytest.approx(np.mean(pairs)), pytest.approx(np.std(pairs)))
    assert got[2]["mean_cosine"] is None and got[2]["std_cosine"] is None


def brute_silhouette(x, labels):
    d = distances(x, "euclidean")
    out = []
    for i, c in enumerate(labels):
        same = [j for j in range(len(x)) if labels[j] == c and j != i]
        if not same:
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b))
    return out


def test_silhouette_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(5)
    labels = np.array([0, 0, 1] * 40 + [2])
    x = rng.normal(size=(121, 3)) + labels[:, None]
    got = kmeans.silhouette_samples(frame(spark, x), with_labels(spark, labels), "k", "vec").orderBy("k").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(brute_silhouette(x, labels))
    few = kmeans.silhouette_samples(frame(spark, x), with_labels(spark, labels), "k", "vec", sample_size=50)
    assert few.count() == 50


def blobs(rng, sizes=(60, 50, 40), spread=0.15):
    return np.concatenate([rng.normal(5 * i, spread, size=(n, 2)) for i, n in enumerate(sizes)])


def test_kmeans_finds_blobs_and_inertia_falls(spark):
    x = blobs(np.random.default_rng(6))
    points = frame(spark, x)
    vectors = ml_vectors(points, "vec", "k")
    found = kmeans.kmeans(vectors, 3, "k", n_init=3)
    sizes = sorted(r["n"] for r in profile.cluster_sizes(found.labels).collect())
    assert sizes == [40, 50, 60]
    sweep = [r["inertia"] for r in kmeans.kmeans_sweep(vectors, range(1, 5), "k", n_init=3).orderBy("k").collect()]
    assert sweep == sorted(sweep, reverse=True)
    assert sweep[0] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    table, best = kmeans.find_optimal_clusters(points, "k", "vec", 6, n_init=2)
    assert best == 3 and table.count() == 5
    centres = kmeans.cluster_centres(points, found.labels, "k", "vec")
    again = kmeans.assign_clusters(points, centres, "k", "vec")
    assert again.join(found.labels.withColumnRenamed("cluster", "c"), "k").where("c <> cluster").count() == 0
    inertia = again.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0]
    assert inertia == pytest.approx(found.inertia)


def test_truncated_svd_equals_numpy(spark):
    x = np.random.default_rng(7).normal(size=(80, 12)) * np.linspace(3, 0.1, 12)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    reduced = reduce.truncated_svd(frame(spark, x), 4, "k", "vec")
    got = np.array([r["vec"] for r in reduced.rows.orderBy("k").collect()])
    assert reduced.singular_values == pytest.approx(s[:4])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :4] * s[:4]))
    picture = reduce.project_2d(reduced.rows, "k").orderBy("k").first()
    assert (picture["x"], picture["y"]) == (got[0, 0], got[0, 1])


@pytest.mark.parametrize("fan_bytes", [64 << 20, 0])
def test_singular_values_of_an_ill_conditioned_matrix(spark, monkeypatch, fan_bytes):
    monkeypatch.setattr(reduce, "TRIANGLE_BYTES", fan_bytes)
    rng = np.random.default_rng(8)
    u, v = np.linalg.qr(rng.normal(size=(300, 10)))[0], np.linalg.qr(rng.normal(size=(10, 10)))[0]
    s = 10.0 ** -np.arange(10)
    x = (u * s) @ v.T
    values, vectors = reduce.right_singular(frame(spark, x).repartition(5), "vec", 10)
    assert (np.abs(values - s) < 1e-8 * s + 1e-15).all()
    assert np.abs(vectors.T @ v) == pytest.approx(np.eye(10), abs=1e-5)
    by_gram = np.sqrt(np.maximum(np.linalg.eigvalsh(x.T @ x)[::-1], 0))
    assert abs(by_gram[-1] - s[-1]) > 1e-8 * s[-1]  # squared, the smallest is lost
    assert reduce.right_singular(frame(spark, x), "vec", 10, 3)[1].shape == (10, 3)
    few, basis = reduce.right_singular(frame(spark, x[:2]), "vec", 10)
    assert few[:2] == pytest.approx(np.linalg.svd(x[:2])[1]) and not few[2:].any() and basis.shape == (10, 10)


@pytest.mark.parametrize("max_bytes", [1 << 30, 0])
def test_svd_of_long_rows(spark, max_bytes):
    rng = np.random.default_rng(8)
    x = (rng.random((90, 40)) < 0.2) * rng.random((90, 40)) * np.linspace(4, 0.1, 40)
    x[5] = 0
    cells = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    weights = spark.createDataFrame(cells, "doc_id bigint, term string, w double")
    docs = spark.range(90).withColumnRenamed("id", "doc_id")
    reduced = reduce.truncated_svd_terms(weights, 3, docs=docs, max_bytes=max_bytes)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert reduced.singular_values == pytest.approx(s[:3], rel=1e-3)
    got = np.array([r["vec"] for r in reduced.rows.orderBy("doc_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=0.05) and not got[5].any()


def test_svd_of_long_rows_joins_no_cells(spark, monkeypatch):
    """Both sides of each step were joins of all cells with a vector each before; rows without a key are one row."""
    rng = np.random.default_rng(8)
    x = (rng.random((60, 30)) < 0.3) * rng.random((60, 30)) * np.linspace(4, 0.1, 30)
    cells = [(int(i) or None, f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    weights = spark.createDataFrame(cells, "doc_id bigint, term string, w double")
    monkeypatch.setattr(reduce, "lookup_join", None)
    monkeypatch.setattr(cell_blocks, "LEAST_CELLS", 100)
    reduced = reduce.truncated_svd_terms(weights.repartition(5), 30, oversample=0, seed=1, max_bytes=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert reduced.singular_values == pytest.approx(s, rel=1e-9)
    got = {r["doc_id"] or 0: r["vec"] for r in reduced.rows.collect()}
    assert np.abs([got[i] for i in range(60)]) == pytest.approx(np.abs(u * s), abs=1e-6)


def test_neighbour_weights_and_coordinates(spark):
    x = blobs(np.random.default_rng(9), (30, 30), 0.4)
    graph = knn.knn_graph(frame(spark, x), 6, "k", "vec", "euclidean")
    edges = reduce.neighbour_weights(graph, "k").toPandas()
    assert ((edges.w > 0) & (edges.w <= 1 + 1e-9)).all() and (edges.u < edges.v).all()
    nearest = graph.where("rank = 1").toPandas()
    ends = {(min(a, b), max(a, b)) for a, b in zip(nearest.k, nearest.neighbour)}
    w = {(u, v): x for u, v, x in zip(edges.u, edges.v, edges.w)}
    assert all(w[e] == pytest.approx(1.0) for e in ends)
    coords = reduce.neighbour_embedding(frame(spark, x), "k", "vec", dim=2, n_neighbours=6, metric="euclidean")
    c = np.array([r["vec"] for r in coords.orderBy("k").collect()])
    assert c.shape == (60, 2)
    near = np.array([[np.linalg.norm(a - b) for b in c] for a in c]) + np.eye(60) * 1e9
    same = (near.argmin(axis=1) < 30) == (np.arange(60) < 30)
    assert same.mean() > 0.95


def brute_forest(edges):
    parent, total, n = {}, 0.0, 0

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for w, u, v in sorted((r["w"], r["u"], r["v"]) for r in edges):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            total, n = total + w, n + 1
    return n, total


def test_spanning_forest_weight(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    edges = density.mutual_reachability(knn.knn_graph(x, 6, "vec_id", "embedding", "euclidean"), 5, "vec_id").cache()
    forest = density.minimum_spanning_forest(edges).collect()
    n, total = brute_forest(edges.collect())
    assert len(forest) == n and sum(r["w"] for r in forest) == pytest.approx(total)


def test_components_per_level(spark):
    path = [(0, i, i + 1, 1.0) for i in range(40) if i != 20]
    star = [(1, 0, i, 1.0) for i in range(1, 30)]
    edges = spark.createDataFrame(path + star, "level int, u bigint, v bigint, w double")
    _, comps = density.spanning_forest(edges, with_components=True)
    sizes = sorted((r["level"], r["count"]) for r in comps.groupBy("level", "comp").count().collect())
    assert sizes == [(0, 20), (0, 21), (1, 30)]


def test_density_clusters_of_blobs_with_noise(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([blobs(rng), rng.uniform(-3, 14, size=(12, 2))])
    points = frame(spark, x)
    h = density.density_hierarchy(points, "k", "vec", min_samples=5)
    labels = np.array([r["cluster"] for r in density.label_clusters(h, 15).orderBy("k").collect()])
    assert set(labels) - {-1} == {0, 1, 2}
    start = 0
    for i, n in enumerate((60, 50, 40)):  # numbered by size
        part = labels[start : start + n]
        assert (part == i).mean() > 0.9
        start += n
    sweep = density.hdbscan_sweep(h, [15, 55]).orderBy("min_cluster_size").collect()
    assert sweep[0]["n_clusters"] == 3 and sweep[0]["noise_pct"] == pytest.approx(100 * (labels == -1).mean())
    assert sweep[1]["n_clusters"] <= 2


@pytest.mark.parametrize("tight,far,expected", [(0.9, 6.0, [40, 30]), (0.01, 1.05, [30, 20, 20])])
def test_nested_split_prefers_the_more_stable_side(spark, tight, far, expected):
    """Two tight groups that meet at 1 and a loose one that joins them at `far`."""
    loose = 5.0 if far > 5 else 1.0
    edges = [(i, i + 1, tight) for i in (*range(19), *range(20, 39))] + [(0, 20, 1.0)]
    edges += [(i, i + 1, loose) for i in range(40, 69)] + [(0, 40, far)]
    points = spark.createDataFrame([(i,) for i in range(70)], "k bigint")
    forest = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    labels = density.label_clusters(density.hierarchy_of(points, "k", forest), 10)
    sizes = {r["cluster"]: r["count"] for r in labels.groupBy("cluster").count().collect()}
    assert [sizes[c] for c in range(len(expected))] == expected and sum(sizes.values()) == 70
    nothing = density.hierarchy_of(points.limit(0), "k", forest.limit(0))
    assert density.label_clusters(nothing, 10).count() == 0


def test_cluster_choice_and_noise(spark):
    labels = with_labels(spark, [0, 0, 0, 1, 1, -1])
    assert profile.n_clusters(labels) == 2
    assert {r["cluster"]: r["share"] for r in profile.cluster_sizes(labels).collect()} == {0: 0.5, 1: pytest.approx(1 / 3)}
    assert profile.cluster_sizes(labels, 1).count() == 1 and profile.cluster_sizes(labels, [0, 1]).count() == 2
    for wrong in (2, [-1], [0, 5]):
        with pytest.raises(ValueError):
            profile.select_clusters(labels, wrong)
    for wrong in ("some", None, 1.5):
        with pytest.raises(TypeError):
            profile.select_clusters(labels, wrong)
    assert profile.top_clusters_by_size(labels, n=21).count() == 2
    assert profile.top_clusters_by_size(labels, 5, hide_noise=False).count() == 3
    summary = profile.noise_summary(labels).first()
    assert (summary["n_clusters"], summary["noise_pct"]) == (2, pytest.approx(100 / 6))


def test_vectors_from_a_model_and_by_projection(spark):
    docs = spark.createDataFrame([(1, "red cat"), (2, "red cat"), (3, "blue sky over sea"), (4, None)], "doc_id bigint, text string")

    def load():
        return lambda texts: np.array([[len(t), t.count("e")] for t in texts], float)

    got = {r["doc_id"]: list(r["vec"]) for r in embed.embed_with_model(docs, "text", "doc_id", load, batch_size=2).collect()}
    assert got == {1: [7.0, 1.0], 2: [7.0, 1.0], 3: [17.0, 3.0]}
    vec = {r["doc_id"]: np.array(r["vec"]) for r in embed.embed_by_projection(docs, "text", "doc_id", dim=100).collect()}
    assert set(vec) == {1, 2, 3} and np.allclose(vec[1], vec[2])
    assert all(np.linalg.norm(v) == pytest.approx(1.0, abs=1e-5) for v in vec.values())
    assert abs(vec[1] @ vec[3]) < 0.5


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_links_between_trees_complete_the_spanning_tree(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(11)
    angle = np.concatenate([rng.normal(c, 0.02, size=30) for c in (0.1, 0.6, 1.1, 1.3)])
    x = np.column_stack([np.cos(angle), np.sin(angle)]) * rng.uniform(1, 1.2, size=(120, 1))
    points = frame(spark, x)
    neighbours = knn.knn_graph(points, 4, "k", "vec", metric).cache()
    edges = density.mutual_reachability(neighbours, 4, "k").withColumn("level", F.lit(0))
    forest, trees = density.spanning_forest(edges, with_components=True)
    assert trees.select("comp").distinct().count() > 1
    core = density.core_distances(neighbours, 4, "k")
    links = density.link_trees(points, "k", "vec", core, trees, metric)
    tree = forest.select("u", "v", "w").unionByName(links).collect()
    single = points.select(F.col("k").alias("node"), F.col("k").alias("comp"))
    exact = density.link_trees(points, "k", "vec", core, single, metric).collect()
    d = distances(x, metric)
    far = np.sort(d + np.eye(len(x)) * 1e9, axis=1)[:, 2]
    every = [{"u": i, "v": j, "w": max(d[i, j], far[i], far[j])} for i, j in itertools.combinations(range(len(x)), 2)]
    n, total = brute_forest(every)
    assert len(tree) == len(exact) == n == 119
    assert sum(r["w"] for r in exact) == pytest.approx(total)
    assert total * (1 - 1e-9) <= sum(r["w"] for r in tree) < 1.02 * total


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_linking_skips_blocks_that_are_too_far(spark, monkeypatch, metric):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    angle = np.linspace(0.05, 1.5, 24)[:, None] + rng.normal(0, 0.004, size=(24, 25))
    x = np.column_stack([np.cos(angle.ravel()), np.sin(angle.ravel())]) * rng.uniform(1, 1.001, size=(600, 1))
    points = frame(spark, x)
    core = points.select("k", F.lit(0.0).alias("core"))
    trees = points.select(F.col("k").alias("node"), F.floor(F.col("k") / 25).alias("comp"))
    counts = []
    links = density.link_trees(points, "k", "vec", core, trees, metric, counts).collect()
    d = distances(x, metric)
    groups = np.arange(600) // 25
    between = [[d[np.ix_(groups == a, groups == b)].min() for b in range(24)] for a in range(24)]
    every = [{"u": a, "v": b, "w": between[a][b]} for a, b in itertools.combinations(range(24), 2)]
    n, total = brute_forest(every)
    assert len(links) == n == 23 and sum(r["w"] for r in links) == pytest.approx(total)
    assert sum(compared for compared, _ in counts) < 0.5 * sum(possible for _, possible in counts)


def exact_clusters(x, min_samples, min_size):
    """Every merge of the full hierarchy, by plain union of sorted edges: the most stable clusters as sets."""
    d = distances(x, "euclidean")
    core = np.sort(d + np.eye(len(x)) * 1e9, axis=1)[:, min_samples - 2]
    edges = sorted((max(d[i, j], core[i], core[j]), i, j) for i, j in itertools.combinations(range(len(x)), 2))
    group = {i: frozenset([i]) for i in range(len(x))}
    alive = {}  # large set -> [stability, since rate, chosen inside, its stability]

    def close(s, rate):
        stability = alive[s][0] + len(s) * (alive[s][1] - rate)
        return ([s], stability) if stability >= alive[s][3] else (alive[s][2], alive[s][3])

    for w, i, j in edges:
        a, b = group[i], group[j]
        if a is b:
            continue
        rate, both = 1 / w, a | b
        large = [s for s in (a, b) if len(s) >= min_size]
        if len(large) == 2:
            results = [close(s, rate) for s in large]
            alive[both] = [0.0, rate, results[0][0] + results[1][0], results[0][1] + results[1][1]]
        elif len(large) == 1:
            s = large[0]
            alive[both] = [alive[s][0] + len(s) * (alive[s][1] - rate), rate, alive[s][2], alive[s][3]]
        elif len(both) >= min_size:
            alive[both] = [0.0, rate, [], 0.0]
        for node in both:
            group[node] = both
    return alive[group[0]][2]


def clusters_of(rows):
    found = {}
    for r in rows:
        found.setdefault(r["cluster"], set()).add(r["k"])
    found.pop(-1, None)
    return sorted(map(sorted, found.values()))


def test_labels_against_the_full_hierarchy(spark):
    rng = np.random.default_rng(12)
    parts = [rng.normal((0, 0), 0.3, (70, 2)), rng.normal((2.2, 0), 0.3, (60, 2)), rng.normal((8, 8), 0.8, (50, 2))]
    x = np.concatenate([*parts, rng.uniform(-3, 11, (20, 2))])
    h = density.density_hierarchy(frame(spark, x), "k", "vec", 5, exact=True)
    for size in (5, 20):
        assert clusters_of(density.label_clusters(h, size).collect()) == sorted(map(sorted, exact_clusters(x, 5, size)))
    approximate = density.density_hierarchy(frame(spark, x), "k", "vec", 5)
    found = clusters_of(density.label_clusters(approximate, 20).collect())
    expected = exact_clusters(x, 5, 20)
    assert len(found) == len(expected)
    for want in expected:  # the neighbour graph's tree is not always that of all pairs
        assert max(len(want & set(f)) / len(want | set(f)) for f in found) > 0.9
    swept = {r["min_cluster_size"]: r for r in density.hdbscan_sweep(h, [5, 20]).collect()}
    for size in (5, 20):
        wanted = exact_clusters(x, 5, size)
        assert swept[size]["n_clusters"] == len(wanted)
        assert abs(swept[size]["noise_pct"] - 100 * (1 - sum(map(len, wanted)) / len(x))) < 1e-9


def test_nine_grids_in_three_groups(spark):
    grid = np.array(list(itertools.product(range(7), range(7))), float)
    centres = [(100 * g, 7.5 * i) for g in range(3) for i in range(3)]
    x = np.concatenate([grid + c for c in centres])
    assert sorted(map(len, exact_clusters(x, 3, 20))) == [147, 147, 147]
    found = clusters_of(density.hdbscan(frame(spark, x), "k", "vec", 20, min_samples=3).collect())
    assert found == [list(range(147 * g, 147 * (g + 1))) for g in range(3)]


def test_merges_do_not_depend_on_the_size_of_problems(spark):
    rng = np.random.default_rng(5)
    n = 80
    edges = [(i, int(rng.integers(i)), float(rng.integers(20))) for i in range(1, n)]
    points = spark.createDataFrame([(i,) for i in range(n)], "k bigint")
    forest = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    tables = [density.hierarchy_of(points, "k", forest, size) for size in (1000, 12)]
    merges = [
        sorted((r["node"], frozenset([(r["left"], r["n_left"]), (r["right"], r["n_right"])]), r["w"]) for r in h.merges.collect())
        for h in tables
    ]
    assert merges[0] == merges[1] and len(merges[0]) == n - 1
    parent = {}
    for r in tables[0].merges.orderBy("node").collect():
        assert r["w"] >= 0 and r["left"] not in parent and r["right"] not in parent
        parent[r["left"]] = parent[r["right"]] = r["node"]
    assert len(parent) == 2 * n - 2



def test_silhouette_meets_each_pair_of_blocks_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 3)) + 1e3, np.full((5, 3), 1e3), rng.normal(size=(55, 3)) * 1e-4])
    labels = [int(i) for i in rng.integers(0, 4, len(x) - 1)] + [9]
    rows = [(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, cluster int")
    monkeypatch.setattr("talkloom.operators.blocks.BLOCK_ROWS", 16)
    seen, join = [], kmeans.join_block_pairs
    monkeypatch.setattr(kmeans, "join_block_pairs", lambda b, p: (seen.append((b.count(), p.count())), join(b, p))[1])
    found = {r["id"]: r["silhouette"] for r in kmeans.silhouette_samples(df, df, "id", "vec").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    label = np.array(labels)
    for i in range(len(x)):
        mean = {c: d[i, label == c].sum() / max((label == c).sum() - (c == label[i]), 1) for c in set(labels)}
        a, b = mean.pop(label[i]), min(mean.values())
        assert found[i] == pytest.approx((b - a) / max(a, b) if (label == label[i]).sum() > 1 else 0.0, abs=1e-9)
    blocks, pairs = seen[0]
    assert blocks > 1 and pairs == blocks * (blocks + 1) // 2


def test_distances_keep_small_ones():
    a = np.random.default_rng(1).normal(size=(40, 5)) + 1e6
    b = np.vstack([a[:20] + 1e-7, a[:3], a[:10] + 1.0])
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert np.allclose(kmeans.distances(a, b), exact, rtol=1e-9, atol=0)


def test_blocks_travel_once_a_group_and_every_pair_meets_once(spark, monkeypatch):
    """Sent for each pair, 40 blocks would travel 1,600 times."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    packed = blocks.pack_blocks(frame(spark, np.arange(320)[:, None]), "k", ["vec"], None)
    packed = packed.cache()
    n = packed.count()
    pairs = blocks.all_block_pairs(packed).cache()

    def compare(held, arriving):
        import pandas as pd

        for row in arriving:
            assert all(left in held for left in row.lefts)
            yield pd.DataFrame({"left": row.lefts, "right": row.block, "sent": [1] + [0] * (len(row.lefts) - 1)})

    monkeypatch.setattr(blocks, "MEETING_GROUPS", 4)
    met = blocks.meet_in_groups(packed, pairs, compare, "left bigint, right bigint, sent int").toPandas()
    assert n > 30 and len(met) == n * n and not met.duplicated(["left", "right"]).any()
    assert met["sent"].sum() <= (2 * spark.sparkContext.defaultParallelism + 2) * n
    none = blocks.meet_in_groups(packed, pairs.limit(0), compare, "left bigint, right bigint, sent int")
    assert none.isEmpty()


def test_links_of_a_node_lie_in_one_file(spark, monkeypatch):
    """So that an iteration sends a row a node and file, not a row a link."""
    walks, cut = [], reduce.cut
    monkeypatch.setattr(reduce, "cut", lambda df, label: (found := cut(df, label), label == "graph-walk" and walks.append(found))[0])
    rng = np.random.default_rng(3)
    reduce.neighbour_embedding(frame(spark, rng.normal(size=(120, 4))), "k", "vec", 2, 10, n_iter=1)
    walk = walks[0].selectExpr("u", "input_file_name() AS f").distinct()
    assert walks[0].count() > 1200 and walk.count() == 120


def jobs_of(spark, run):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    found = run()
    return found, len(tracker.getJobIdsForGroup()) - before


def test_silhouette_sends_blocks_once_a_group_and_all_labelings_together(spark, monkeypatch):
    """Pairs of 40 blocks are 820 rows, once for each k."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    sent, join = [], kmeans.join_block_pairs
    monkeypatch.setattr(kmeans, "join_block_pairs", lambda b, p: (sent.append(join(b, p)), sent[-1])[1])
    x = blobs(np.random.default_rng(8), (120, 110, 90))
    table, best = kmeans.find_optimal_clusters(frame(spark, x), "k", "vec", 5, n_init=2)
    assert best == 3 and len(sent) == 1 and sent[0].count() <= 40 * (2 * spark.sparkContext.defaultParallelism + 3)
    for r in table.where("k > 1").collect():
        labels = kmeans.kmeans(ml_vectors(frame(spark, x), "vec", "k"), r["k"], "k", 2).labels
        assert r["silhouette"] == pytest.approx(kmeans.silhouette(frame(spark, x), labels, "k", "vec"))


def test_silhouette_of_odd_labels_and_keys(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [5.0, 0.0], 1), (4, [6.0, 0.0], 1), (5, [9.0, 9.0], None)]
    df = spark.createDataFrame(rows, "id bigint, vec array<float>, cluster int")
    found = kmeans.silhouette_samples(df, df, "id", "vec").orderBy("id").collect()
    assert [r["id"] for r in found] == [1, 2, 3, 4, 5] and found[4]["silhouette"] == 0.0 and found[4]["cluster"] is None
    one = kmeans.silhouette_samples(df.where("id < 3"), df, "id", "vec").collect()
    assert [r["silhouette"] for r in one] == [None, None]


def test_tasks_finish_bounded_graphs_and_trees(spark, monkeypatch):
    """Clusters that hold each other, 30 deep, took several jobs for each."""
    clusters = [(8, c, c + 1 if c < 29 else None, 100 + c, float(c % 7)) for c in range(30)]
    clusters += [(8, 100 + c, c, 8, 1.5) for c in range(30)]
    table = spark.createDataFrame(clusters, "size bigint, cluster bigint, parent bigint, n bigint, stability double")
    found, jobs = jobs_of(spark, lambda: sorted(map(tuple, density.select_stable(table).collect()), key=str))
    assert jobs < 25 and len(found) == 60
    rng = np.random.default_rng(4)
    ends = rng.integers(0, 90, size=(200, 2))
    edges = spark.createDataFrame(
        [(0, int(a), int(b), float(rng.integers(9))) for a, b in ends[ends[:, 0] != ends[:, 1]]], "level int, u bigint, v bigint, w double"
    )
    whole = [sorted(map(tuple, f.collect())) for f in density.spanning_forest(edges, with_components=True)]
    few = table.where("cluster % 100 > 24")
    found = sorted(map(tuple, density.select_stable(few).collect()), key=str)
    monkeypatch.setattr(density, "TASK_ROWS", 3)
    assert sorted(map(tuple, density.select_stable(few).collect()), key=str) == found
    assert whole == [sorted(map(tuple, f.collect())) for f in density.spanning_forest(edges, with_components=True)]


def test_linking_leaves_out_pairs_of_one_tree(spark):
    """A tree of most points in every block: its edges to the others, and theirs to it, are those of all pairs."""
    x = np.random.default_rng(6).normal(size=(90, 3))
    tree = np.where(np.arange(90) % 9 == 0, np.arange(90) % 4 + 1, 0)
    points = frame(spark, x)
    trees = spark.createDataFrame([(i, int(t)) for i, t in enumerate(tree)], "node bigint, comp bigint")
    core = points.select("k", F.lit(0.0).alias("core"))
    links = density.link_trees(points, "k", "vec", core, trees).collect()
    d = distances(x, "euclidean")
    between = [
        {"u": a, "v": b, "w": d[np.ix_(tree == a, tree == b)].min()} for a, b in itertools.combinations(range(5), 2)
    ]
    n, total = brute_forest(between)
    assert len(links) == n == 4 and sum(r["w"] for r in links) == pytest.approx(total)
