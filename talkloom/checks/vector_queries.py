"""Queries on embeddings and on models: k-means, silhouettes, reduction, neighbours, density clusters, vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.checks.document_queries import documents, lemmatised, texts
from talkloom.checks.oracles import TFIDF, VECTORS
from talkloom.functions.vectors import as_doubles, ml_vectors
from talkloom.operators import density, descent, embed, kmeans, knn, minibatch, profile, reduce
from talkloom.operators import tfidf as features
from talkloom.operators.sparse_kmeans import sparse_kmeans
from talkloom.plans.cluster import cluster_embeddings, cluster_tfidf, cluster_tfidf_by_density, describe
from talkloom.runtime import cut

KEY, VEC = "vec_id", "embedding"


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def given(spark, sf) -> DataFrame:
    return embeddings(spark, sf).select(KEY, F.col("label").cast("int").alias("cluster"))


def ml(spark, sf) -> DataFrame:
    return ml_vectors(embeddings(spark, sf), VEC, KEY)


def cohesion(spark, sf):
    c = profile.cluster_cohesion(embeddings(spark, sf), given(spark, sf), KEY, VEC)
    return c.withColumn("mean_cosine", F.round("mean_cosine", 6)).withColumn("std_cosine", F.round("std_cosine", 6))


def assigned(spark, sf):
    points = embeddings(spark, sf)
    centres = kmeans.cluster_centres(points, given(spark, sf), KEY, VEC)
    centres = centres.withColumn("centre", F.transform("centre", lambda x: F.round(x, 6)))
    return kmeans.assign_clusters(points, centres, KEY, VEC).withColumn("distance", F.round("distance", 6))


def inertia_one(spark, sf):
    """Inertia at k = 1; the sum over rows comes from one aggregation."""
    value = kmeans.kmeans_sweep(ml(spark, sf), [1], KEY)
    return value.withColumn("inertia", F.round("inertia", 6))


def silhouettes(spark, sf):
    s = kmeans.silhouette_samples(embeddings(spark, sf), given(spark, sf), KEY, VEC)
    return s.withColumn("silhouette", F.round("silhouette", 6))


def neighbours(spark, sf, k=10) -> DataFrame:
    return knn.knn_graph(embeddings(spark, sf), k, KEY, VEC, "cosine")


def euclidean(spark, sf, k=10) -> DataFrame:
    return cut(knn.knn_graph(embeddings(spark, sf), k, KEY, VEC, "euclidean"), "neighbours")


def knn_query(spark, sf):
    return neighbours(spark, sf).select(
        KEY, "neighbour", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 6).alias("distance")
    )


def approximate(spark, sf):
    """Neighbours by descent, with the recall measured on a sample."""
    found = descent.approximate_knn(embeddings(spark, sf), 10, KEY, VEC, "cosine")
    return found.lists.withColumn("recall", F.lit(found.recall))


def core(spark, sf):
    return density.core_distances(euclidean(spark, sf), 10, KEY).withColumn("core", F.round("core", 6))


def reachability(spark, sf):
    return density.mutual_reachability(euclidean(spark, sf), 10, KEY).withColumn("w", F.round("w", 6))


def forest(spark, sf):
    found = density.minimum_spanning_forest(density.mutual_reachability(euclidean(spark, sf), 10, KEY))
    return found.select("u", "v", F.round("w", 6).alias("w"))


def points_2d(spark, sf) -> DataFrame:
    """A given picture: two coordinates of each embedding."""
    return embeddings(spark, sf).select(
        KEY, (F.col(VEC)[0].cast("double") * 100).alias("x"), (F.col(VEC)[1].cast("double") * 100).alias("y")
    )


def near_point(spark, sf):
    near = profile.nearest_point(points_2d(spark, sf), given(spark, sf), 6.0, 0.0, KEY, 20.0)
    return near.select(KEY, "cluster", F.round("distance", 6).alias("distance"), "n_near")


def plot(spark, sf):
    data = profile.plot_data(points_2d(spark, sf), given(spark, sf), KEY)
    return data.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


def bounds(spark, sf):
    b = profile.grid_bounds(profile.plot_data(points_2d(spark, sf), given(spark, sf), KEY))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


def svd(spark, sf):
    """Length of each row on all axes, which a rotation keeps, next to its first coordinates."""
    rows = reduce.truncated_svd(embeddings(spark, sf), 64, KEY, VEC).rows
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(KEY, F.round(length, 5).alias("length"))


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two results of one row."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def axes(rows: DataFrame, k: int) -> DataFrame:
    """What singular vectors must show: rows, axes, products of different axes next to the largest one, and whether the
    axes' lengths fall."""
    vec = F.col("vec")
    products = F.flatten(F.transform(vec, lambda x, i: F.transform(F.slice(vec, i + 1, k), lambda y: x * y)))
    summed = rows.select(F.posexplode(products).alias("cell", "p")).groupBy("cell").agg(F.sum("p").alias("p"))
    cells = summed.agg(F.sort_array(F.collect_list(F.struct("cell", "p"))).alias("cells"))  # k (k + 1) / 2 numbers
    own = [sum(k - j for j in range(i)) for i in range(k)]
    values = F.transform("cells", lambda c: c["p"])
    squares = F.transform(F.array(*map(F.lit, own)), lambda i: F.get(values, i))
    others = F.filter(values, lambda p, i: ~F.array_contains(F.array(*map(F.lit, own)), i))
    falling = F.forall(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.get(squares, i) <= F.get(squares, i - 1))
    off = F.aggregate(others, F.lit(0.0), lambda a, p: F.greatest(a, F.abs(p))) / F.get(squares, 0)
    checked = cells.select(F.round(off, 4).alias("off_diagonal"), falling.alias("falling"))
    n = rows.agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).cast("bigint").alias("n_axes"))
    return _beside(n, checked)


AXES_SQL = "SELECT count(*) AS n_rows, {k} AS n_axes, 0.0 AS off_diagonal, true AS falling FROM {table}"


def svd_axes(spark, sf):
    return axes(reduce.truncated_svd(embeddings(spark, sf), 15, KEY, VEC).rows, 15)


def svd_terms(spark, sf):
    t = features.tfidf(lemmatised(spark, sf))
    reduced = reduce.truncated_svd_terms(t.weights, 50, docs=documents(spark, sf).select("doc_id"))
    return axes(cut(reduced.rows, "svd-terms"), 50)


def picture(spark, sf):
    """The picture's coordinates as two axes."""
    data = reduce.project_2d(reduce.truncated_svd(embeddings(spark, sf), 50, KEY, VEC).rows, KEY)
    return axes(data.select(F.array("x", "y").alias("vec")), 2)


def spectral(spark, sf):
    """Rows, coordinates and rows with a coordinate that isn't a number."""
    rows = reduce.neighbour_embedding(embeddings(spark, sf), KEY, VEC, dim=15, n_neighbours=200)
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.agg(
        F.count("*").alias("n_rows"), F.max(F.size("vec")).cast("bigint").alias("n_axes"),
        F.coalesce(F.sum(odd.cast("bigint")), F.lit(0)).alias("n_odd"),
    )


def kmeans_rows(spark, sf):
    """Rows, clusters, rows that are nearer to another label's mean, and inertia against the sum of squared distances."""
    points, fitted = embeddings(spark, sf), kmeans.kmeans(ml(spark, sf), 10, KEY)
    labels = cut(fitted.labels, "labels")
    nearest = kmeans.assign_clusters(points, kmeans.cluster_centres(points, labels, KEY, VEC), KEY, VEC)
    both = nearest.withColumnRenamed("cluster", "nearest").join(labels, KEY)
    return both.agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"),
        F.sum((F.col("nearest") != F.col("cluster")).cast("bigint")).alias("n_nearer"),
        (F.abs(F.sum(F.pow("distance", F.lit(2))) / fitted.inertia - 1) < 1e-6).alias("is_inertia"),
    )


def seeds(spark, sf, k) -> np.ndarray:
    """Given seeds: the first k embeddings."""
    rows = embeddings(spark, sf).orderBy(KEY).select(as_doubles(VEC)).limit(k).collect()
    return np.array([r[0] for r in rows])


def sweep(spark, sf):
    """Inertia of each k after three rounds of mini-batches from given seeds."""
    swept = minibatch.minibatch_kmeans_sweep(
        embeddings(spark, sf), range(10, 25), KEY, VEC, batch_size=10_000, max_iter=3, seeds=seeds(spark, sf, 24), starved_below=0
    )
    return swept.withColumn("inertia", F.round("inertia", 4))


def sparse_steps(spark, sf):
    """Long-table k-means of TF-IDF rows, started at the first five documents with terms and moved twice."""
    docs = lemmatised(spark, sf)
    weights = cut(features.tfidf(docs).weights, "weights")
    first = weights.select("doc_id").distinct().orderBy("doc_id").limit(5)
    seeds = first.withColumn("cluster", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("int"))
    found = sparse_kmeans(weights, 5, docs.select("doc_id"), seeds, max_iter=2, tol=0.0)
    return found.labels.withColumn("distance", F.round("distance", 6))


def _sparse_near(step: int) -> str:
    return f"""size{step} AS (
        SELECT j AS cluster, coalesce(c2, 0) AS c2 FROM range(5) AS t(j)
        LEFT JOIN (SELECT cluster, sum(c * c) AS c2 FROM sparse{step} GROUP BY 1) AS s ON s.cluster = j),
    dot{step} AS (SELECT doc_id, cluster, sum(w * c) AS dot FROM weights JOIN sparse{step} USING (term) GROUP BY 1, 2),
    near{step} AS (
        SELECT doc_id, cluster, round(c2 - 2 * coalesce(dot, 0), 12) AS score
        FROM lists CROSS JOIN size{step} LEFT JOIN dot{step} USING (doc_id, cluster)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, cluster) = 1)"""


def _sparse_move(step: int) -> str:
    return f"""sparse{step + 1} AS (
        SELECT cluster, term, sum(w) / any_value(n) AS c FROM weights JOIN near{step} USING (doc_id)
        JOIN (SELECT cluster, count(*) AS n FROM near{step} GROUP BY 1) USING (cluster) GROUP BY 1, 2
        UNION ALL SELECT * FROM sparse{step} WHERE cluster NOT IN (SELECT cluster FROM near{step}))"""


def minibatch_steps(spark, sf):
    """Centres after a step on each of four given batches, which are all rows, from given seeds."""
    points, models = embeddings(spark, sf), [minibatch.Centres.at(seeds(spark, sf, 10))]
    for number in range(4):
        models = minibatch.minibatch_update(points.where(F.pmod(KEY, F.lit(4)) == number), models, VEC)
    rows = [
        (c, i + 1, round(float(x), 6), int(models[0].seen[c])) for c, centre in enumerate(models[0].points) for i, x in enumerate(centre)
    ]
    return spark.createDataFrame(rows, "cluster bigint, axis bigint, x double, seen bigint")


def minibatch_rows(spark, sf):
    """Mini-batches with seeds of their own: clusters, rows, rows that are nearer to another centre, and inertia against the
    sum of squared distances."""
    fitted = minibatch.minibatch_kmeans(embeddings(spark, sf), 10, KEY, VEC, batch_size=256)
    centres = [(i, c.tolist()) for i, c in enumerate(fitted.models[10].points)]
    nearest = kmeans.assign_clusters(
        embeddings(spark, sf), spark.createDataFrame(centres, "cluster int, centre array<double>"), KEY, VEC
    )
    both = nearest.withColumnRenamed("cluster", "nearest").join(fitted.labels(10), KEY)
    return both.agg(
        F.count("*").alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"),
        F.sum((F.col("nearest") != F.col("cluster")).cast("bigint")).alias("n_nearer"),
        (F.abs(F.sum(F.pow("distance", F.lit(2))) / fitted.inertia[10] - 1) < 1e-6).alias("is_inertia"),
    )


def density_labels(spark, sf):
    """Density clusters of the embeddings, noise -1."""
    return density.label_clusters(hierarchy(spark, sf), 8)


def best_k(spark, sf):
    """The inertia of a single cluster, and whether the other values are in their range."""
    table, best = kmeans.find_optimal_clusters(embeddings(spark, sf), KEY, VEC, 6)
    whole = F.max(F.when(F.col("k") == 1, F.col("inertia"))).over(Window.partitionBy())  # a row per k
    top = F.max("silhouette").over(Window.partitionBy())
    return table.select(
        "k", F.round(F.when(F.col("k") == 1, F.col("inertia")), 6).alias("inertia"),
        (F.col("inertia") <= whole).alias("below_one"),
        ((F.col("k") == best) == F.coalesce(F.col("silhouette") == top, F.lit(False))).alias("is_best"),
    )


def grid_clusters(spark, sf):
    """Density clusters of a picture with known groups: five square grids far apart, a point for each embedding. A
    cluster is named by its smallest id."""
    i = F.col(KEY)
    x, y = 10_000 * (i % 5) + F.floor(i / 5) % 10, F.floor(i / 50)
    points = embeddings(spark, sf).select(KEY, F.array(x.cast("double"), y.cast("double")).alias("vec"))
    labels = density.hdbscan(points, KEY, "vec", 20, min_samples=3)
    name = F.min(KEY).over(Window.partitionBy("cluster"))
    return labels.select(KEY, F.when(F.col("cluster") >= 0, name).alias("first_id"))


def swept_sizes(spark, sf):
    """Minimum sizes with noise in its range; no size has more clusters than fit."""
    swept = density.hdbscan_sweep(hierarchy(spark, sf), range(4, 12))
    n = embeddings(spark, sf).count()
    fits = F.col("n_clusters") * F.col("min_cluster_size") <= n * (1 - F.col("noise_pct") / 100) + 1e-6
    return swept.select("min_cluster_size", F.col("noise_pct").between(0.0, 100.0).alias("in_range"), fits.alias("fits"))


def projected(spark, sf):
    """Length of each text's vector."""
    vectors = embed.embed_by_projection(texts(spark, sf), "text", "doc_id")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("doc_id", F.round(length, 4).alias("length"), F.size("vec").cast("bigint").alias("n_axes"))


def _profiled(found: dict[str, DataFrame], n_terms: int = 15) -> DataFrame:
    """Labelled rows, clusters without `n_terms` ranked terms, and terms that rank above one with a higher mean."""
    before = F.lag("mean_w").over(Window.partitionBy("cluster").orderBy("rank"))
    terms = found["top_terms"].withColumn("risen", (F.col("mean_w") > before).cast("bigint"))
    per = terms.groupBy("cluster").agg(F.max("rank").alias("n"), F.sum("risen").alias("risen"))
    checked = per.agg(
        F.coalesce(F.sum((F.col("n") != n_terms).cast("bigint")), F.lit(0)).alias("n_short"),
        F.coalesce(F.sum("risen"), F.lit(0)).alias("n_risen"),
    )
    return _beside(found["labels"].agg(F.count("*").alias("n_rows")), checked)


PROFILED_SQL = "SELECT count(*) AS n_rows, 0 AS n_short, 0 AS n_risen FROM documents WHERE text IS NOT NULL"


def embedded_clusters(spark, sf) -> DataFrame:
    vectors = embed.embed_by_projection(texts(spark, sf), "text", "doc_id", dim=384)
    return cut(cluster_embeddings(vectors, min_cluster_size=8, min_samples=5, dim=15, key="doc_id"), "labels")


def embedding_clusters(spark, sf):
    """Labelled texts, and clusters below the minimum size."""
    sizes = embedded_clusters(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))
    small = (F.col("cluster") >= 0) & (F.col("n") < 8)
    return sizes.agg(F.sum("n").alias("n_rows"), F.sum(small.cast("bigint")).alias("n_small"))


def embedding_cluster_terms(spark, sf):
    weights = cut(features.tfidf(lemmatised(spark, sf)).weights, "weights")
    return _profiled(describe(weights, embedded_clusters(spark, sf)))


def fitted_comparison(spark, sf):
    """k-means on TF-IDF against density clusters of the sentence vectors: rows in all cells, and whether the shares of
    each label add up."""
    by_terms = cluster_tfidf(lemmatised(spark, sf), n_clusters=6)["labels"]
    cells = profile.compare_clusterings(by_terms, embedded_clusters(spark, sf), "doc_id")
    rows = cells.groupBy("cluster_a").agg(F.sum("n").alias("n"), F.sum("share_a").alias("share"))
    return rows.agg(F.sum("n").alias("n_rows"), F.max(F.abs(F.col("share") - 1) < 1e-9).alias("adds_up"))


def hierarchy(spark, sf) -> density.Hierarchy:
    reduced = reduce.truncated_svd(embeddings(spark, sf), 15, KEY, VEC).rows
    return density.density_hierarchy(cut(reduced, "reduced"), KEY, "vec", min_samples=5)


def model_vectors(spark, sf):
    """A stand-in model (characters, spaces and letters e of the whole text) through the interface of a real one."""

    def load():
        return lambda batch: np.array([[len(t), t.count(" "), t.count("e")] for t in batch], dtype=float)

    vectors = embed.embed_with_model(texts(spark, sf), "text", "doc_id", load)
    parts = [F.col("vec")[i].cast("bigint").alias(c) for i, c in enumerate(("n_chars", "n_spaces", "n_e"))]
    return vectors.select("doc_id", *parts)


def squared_silhouettes(spark, sf):
    values = [(m, kmeans.silhouette_squared(ml(spark, sf), given(spark, sf), KEY, m)) for m in ("squaredEuclidean", "cosine")]
    return spark.createDataFrame(values, "measure string, silhouette double").withColumn(
        "silhouette", F.round("silhouette", 6)
    )


def _v(select: str) -> str:
    return f"WITH {VECTORS} {select}"


CENTRES = """comp AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
axis AS (SELECT label AS cluster, i, round(avg(x), 6) AS c FROM comp GROUP BY ALL),
centres AS (SELECT cluster, list(c ORDER BY i) AS centre FROM axis GROUP BY cluster)"""

NEAR = """nn AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM pairs QUALIFY rank <= 10),
core AS (SELECT a, d AS core FROM nn WHERE rank = 9)"""

# Trees grown a point at a time by the lightest edge that leaves them.
FOREST_SQL = f"""WITH RECURSIVE {VECTORS}, {NEAR},
near AS (SELECT least(a, b) AS u, greatest(a, b) AS v, min(d) AS d FROM nn GROUP BY ALL),
graph AS MATERIALIZED (
  SELECT u, near.v AS v, greatest(d, cu.core, cv.core) AS w
  FROM near JOIN core cu ON cu.a = u JOIN core cv ON cv.a = near.v),
grown(reached, e) AS (
  SELECT [min(vec_id)], NULL::STRUCT(w DOUBLE, u BIGINT, v BIGINT) FROM embeddings
  UNION ALL
  SELECT list_append(reached, CASE
           WHEN e IS NULL THEN (SELECT min(vec_id) FROM embeddings WHERE NOT list_contains(reached, vec_id))
           WHEN list_contains(reached, e.u) THEN e.v ELSE e.u END), e
  FROM (SELECT reached, (SELECT min({{'w': w, 'u': u, 'v': v}}) FROM graph
                         WHERE list_contains(reached, u) <> list_contains(reached, v)) AS e FROM grown)
  WHERE len(reached) < (SELECT count(*) FROM embeddings))
SELECT e.u AS u, e.v AS v, round(e.w, 6) AS w FROM grown WHERE e IS NOT NULL"""

XY = "xy AS (SELECT vec_id, label AS cluster, v[1] * 100 AS x, v[2] * 100 AS y FROM vectors)"



def _nearest(step: int, where: str = "true") -> str:
    return f"""SELECT k, vec_id, min({{'d': list_distance(v, centre), 'c': cluster}}) AS near
        FROM vectors CROSS JOIN c{step} WHERE {where} GROUP BY k, vec_id"""


def _step(step: int, where: str = "true") -> str:
    """A step of mini-batch k-means on the rows of a condition, from centres c<step> to c<step + 1>."""
    return f"""near{step} AS MATERIALIZED ({_nearest(step, where)}),
        sum{step} AS (SELECT k, near.c AS cluster, i, sum(x) AS s, count(*) AS n
                      FROM near{step} JOIN comp USING (vec_id) GROUP BY ALL),
        tot{step} AS (SELECT k, cluster, list(s ORDER BY i) AS s, min(n) AS n FROM sum{step} GROUP BY ALL),
        c{step + 1} AS MATERIALIZED (
            SELECT k, cluster, seen + coalesce(n, 0) AS seen, CASE WHEN n IS NULL THEN centre ELSE list_transform(
                list_zip(centre, s), lambda z: z[1] + (z[2] - n * z[1]) / (seen + n)) END AS centre
            FROM c{step} LEFT JOIN tot{step} USING (k, cluster))"""


QUERIES = {
    "cluster_cohesion": (
        cohesion,
        _v("""SELECT cluster, n, round(mean_cosine, 6) AS mean_cosine, round(std_cosine, 6) AS std_cosine
        FROM (SELECT label AS cluster, count(*) AS n FROM vectors GROUP BY label)
        LEFT JOIN (SELECT la AS cluster, avg(cosine) AS mean_cosine, stddev_pop(cosine) AS std_cosine
                   FROM pairs WHERE la = lb AND a < b GROUP BY la) USING (cluster)"""),
    ),
    "assign_clusters": (
        assigned,
        _v(f""", {CENTRES}, dist AS (SELECT vec_id, cluster, list_distance(v, centre) AS d FROM vectors CROSS JOIN centres)
        SELECT vec_id, arg_min(cluster, d) AS cluster, round(min(d), 6) AS distance FROM dist GROUP BY vec_id"""),
    ),
    "kmeans_inertia_one": (
        inertia_one,
        """WITH comp AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
                    FROM embeddings)
        SELECT 1 AS k, round(sum(s), 6) AS inertia FROM (SELECT var_pop(x) * count(*) AS s FROM comp GROUP BY i)""",
    ),
    "silhouette": (
        silhouettes,
        _v(""", sizes AS (SELECT label, count(*) AS n FROM vectors GROUP BY label),
        dists AS (SELECT a, la, lb, sum(d) AS s FROM pairs GROUP BY ALL),
        ab AS (SELECT a, la, max(CASE WHEN la = lb THEN s / (n - 1) END) AS a_in,
                      min(CASE WHEN la <> lb THEN s / n END) AS b_out
               FROM dists JOIN sizes ON sizes.label = lb GROUP BY a, la)
        SELECT a AS vec_id, la AS cluster, coalesce(round((b_out - a_in) / greatest(a_in, b_out), 6), 0) AS silhouette
        FROM ab"""),
    ),
    "knn_graph": (
        knn_query,
        _v("""SELECT a AS vec_id, b AS neighbour, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank,
        round(1 - cosine, 6) AS distance FROM pairs QUALIFY rank <= 10"""),
    ),
    "approximate_neighbours": (approximate, None),
    "core_distances": (core, _v(f", {NEAR} SELECT a AS vec_id, round(core, 6) AS core FROM core")),
    "mutual_reachability": (
        reachability,
        _v(f""", {NEAR}, edges AS (SELECT least(a, b) AS u, greatest(a, b) AS v, min(d) AS d FROM nn GROUP BY ALL)
        SELECT u, edges.v AS v, round(greatest(d, cu.core, cv.core), 6) AS w
        FROM edges JOIN core cu ON cu.a = u JOIN core cv ON cv.a = edges.v"""),
    ),
    "minimum_spanning_forest": (forest, FOREST_SQL),
    "nearest_point_2d": (
        near_point,
        _v(f""", {XY}, far AS (SELECT *, sqrt((x - 6) ** 2 + y ** 2) AS distance FROM xy),
        best AS (SELECT * FROM far ORDER BY distance, vec_id LIMIT 1)
        SELECT vec_id, cluster, round(distance, 6) AS distance,
               (SELECT count(*) FROM far WHERE far.cluster = best.cluster AND far.distance < 20) AS n_near FROM best"""),
    ),
    "plot_data": (plot, _v(f", {XY} SELECT vec_id, cluster, round(x, 6) AS x, round(y, 6) AS y FROM xy")),
    "grid_bounds": (
        bounds,
        _v(f""", {XY} SELECT round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min,
        round(max(y), 6) AS y_max FROM xy"""),
    ),
    "svd_row_lengths": (
        svd, _v("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS length FROM vectors"),
    ),
    "truncated_svd": (svd_axes, AXES_SQL.format(k=15, table="embeddings")),
    "truncated_svd_terms": (svd_terms, AXES_SQL.format(k=50, table="documents")),
    "project_2d": (picture, AXES_SQL.format(k=2, table="embeddings")),
    "umap_reduce": (spectral, "SELECT count(*) AS n_rows, 15 AS n_axes, 0 AS n_odd FROM embeddings"),
    "kmeans": (
        kmeans_rows, "SELECT count(*) AS n_rows, 10 AS n_clusters, 0 AS n_nearer, true AS is_inertia FROM embeddings",
    ),
    "kmeans_sweep": (
        sweep,
        _v(f""", comp AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
        seed AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, v FROM vectors QUALIFY cluster < 24),
        c0 AS (SELECT k, cluster, 0 AS seen, v AS centre FROM range(10, 25) AS t(k) JOIN seed ON cluster < k),
        {", ".join(_step(s) for s in range(3))}, last AS ({_nearest(3)})
        SELECT k, round(sum(near.d * near.d), 4) AS inertia FROM last GROUP BY k"""),
    ),
    "sparse_kmeans": (
        sparse_steps,
        f"""WITH {TFIDF},
        seed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS cluster
                 FROM (SELECT DISTINCT doc_id FROM weights) QUALIFY cluster < 5),
        sparse0 AS (SELECT cluster, term, w AS c FROM weights JOIN seed USING (doc_id)),
        {_sparse_near(0)}, {_sparse_move(0)}, {_sparse_near(1)}, {_sparse_move(1)}, {_sparse_near(2)}
        SELECT doc_id, CAST(cluster AS INTEGER) AS cluster,
            round(greatest(score + CASE WHEN doc_id IN (SELECT doc_id FROM weights) THEN 1 ELSE 0 END, 0), 6) AS distance
        FROM near2""",
    ),
    "minibatch_steps": (
        minibatch_steps,
        _v(f""", comp AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
        c0 AS (SELECT 10 AS k, row_number() OVER (ORDER BY vec_id) - 1 AS cluster, 0 AS seen, v AS centre FROM vectors
               QUALIFY cluster < 10),
        {", ".join(_step(s, f"vec_id % 4 = {s}") for s in range(4))}
        SELECT cluster, generate_subscripts(centre, 1) AS axis, round(unnest(centre), 6) AS x, CAST(seen AS BIGINT) AS seen
        FROM c4"""),
    ),
    "minibatch_kmeans": (
        minibatch_rows,
        "SELECT count(*) AS n_rows, 10 AS n_clusters, 0 AS n_nearer, true AS is_inertia FROM embeddings",
    ),
    "kmeans_best_k": (
        best_k,
        """WITH comp AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
                    FROM embeddings),
        one AS (SELECT round(sum(s), 6) AS inertia FROM (SELECT var_pop(x) * count(*) AS s FROM comp GROUP BY i))
        SELECT k, CASE WHEN k = 1 THEN inertia END AS inertia, true AS below_one, true AS is_best
        FROM range(1, 6) AS t(k), one""",
    ),
    "silhouette_squared": (
        squared_silhouettes,
        _v(""", sizes AS (SELECT label, count(*) AS n FROM vectors GROUP BY label),
        measured AS (SELECT 'squaredEuclidean' AS measure, a, la, lb, d * d AS d FROM pairs
                     UNION ALL SELECT 'cosine', a, la, lb, 1 - cosine FROM pairs),
        dists AS (SELECT measure, a, la, lb, sum(d) AS s FROM measured GROUP BY ALL),
        ab AS (SELECT measure, a, max(CASE WHEN la = lb THEN s / (n - 1) END) AS a_in,
                      min(CASE WHEN la <> lb THEN s / n END) AS b_out
               FROM dists JOIN sizes ON sizes.label = lb GROUP BY measure, a)
        SELECT measure, round(avg(coalesce((b_out - a_in) / greatest(a_in, b_out), 0)), 6) AS silhouette
        FROM ab GROUP BY measure"""),
    ),
    "hdbscan": (density_labels, None),
    "hdbscan_grid": (grid_clusters, "SELECT vec_id, min(vec_id) OVER (PARTITION BY vec_id % 5) AS first_id FROM embeddings"),
    "hdbscan_sweep": (
        swept_sizes, "SELECT min_cluster_size, true AS in_range, true AS fits FROM range(4, 12) AS t(min_cluster_size)",
    ),
    "embed_text": (
        projected,
        r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]{2}') THEN 1.0 ELSE 0.0 END AS length, 384 AS n_axes
        FROM documents WHERE text IS NOT NULL""",
    ),
    "embed_text_model": (
        model_vectors,
        """SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_spaces,
        length(text) - length(replace(text, 'e', '')) AS n_e FROM documents""",
    ),
    "tfidf_cluster_terms": (lambda s, d: _profiled(cluster_tfidf(lemmatised(s, d), n_clusters=6)), PROFILED_SQL),
    "tfidf_density_clusters": (
        lambda s, d: _profiled(cluster_tfidf_by_density(lemmatised(s, d), min_cluster_size=8, min_samples=5)), PROFILED_SQL,
    ),
    "embedding_clusters": (
        embedding_clusters, "SELECT count(*) AS n_rows, 0 AS n_small FROM documents WHERE text IS NOT NULL",
    ),
    "embedding_cluster_terms": (embedding_cluster_terms, PROFILED_SQL),
    "fitted_comparison": (
        fitted_comparison, "SELECT count(*) AS n_rows, true AS adds_up FROM documents WHERE text IS NOT NULL",
    ),
}
