"""Queries on documents: text steps, tokens, lemmas, TF-IDF, samples, cluster profiles on given labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.checks.oracles import (
    DOC_LABELS, LETTERS, TFIDF, TOKENS, kept_words, tokens, words_sql,
)
from talkloom.functions import text as T
from talkloom.functions.lemmas import lemmas_in_row
from talkloom.functions.stopwords import stopword_pattern, stopwords
from talkloom.operators import lemma, profile, sampling, stats
from talkloom.operators import tfidf as features
from talkloom.operators.cohesion import cluster_cohesion_terms
from talkloom.runtime import cut, scratch_path
from talkloom.sources import raw as sources


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", "text")


def tokenised(spark, sf) -> DataFrame:
    """`(doc_id, tokens)` before lemmas."""
    return texts(spark, sf).na.drop(subset=["text"]).select("doc_id", T.tokens("text").alias("tokens"))


def lemmatised(spark, sf) -> DataFrame:
    """`(doc_id, tokens)`, cut because fitting and weighting both read it."""
    return cut(tokenised(spark, sf).withColumn("tokens", lemmas_in_row("tokens")), "lemmatised")


def given_labels(spark, sf) -> DataFrame:
    source = F.substring("source", 4, 10).cast("int")
    return documents(spark, sf).select("doc_id", F.when(F.col("lang") == "en", source).otherwise(-1).alias("cluster"))


def quality_labels(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("cluster"))


def weights(spark, sf) -> features.Tfidf:
    return features.tfidf(lemmatised(spark, sf))


def _text(step):
    return lambda spark, sf: texts(spark, sf).select("doc_id", step("text").alias("text"))


def _text_sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS text FROM documents"


def _tokens(step):
    def query(spark, sf):
        rows = texts(spark, sf).select("doc_id", step("text").alias("t"))
        return rows.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))

    return query


def _tokens_sql(expression: str) -> str:
    return f"""SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t) AS n_tokens
    FROM (SELECT doc_id, {expression} AS t FROM documents)"""


def lemma_lookup(spark, sf):
    """Lemma table joined to the tokens."""
    docs = cut(tokenised(spark, sf), "tokens")
    table, _ = lemma.lemma_dict_and_vocab(docs, "tokens")
    done = lemma.lemmatize_tokens(docs, "tokens", table, "doc_id")
    return done.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("bigint").alias("n_tokens"))


def lemmas_by_rule(spark, sf):
    done = tokenised(spark, sf).withColumn("tokens", lemmas_in_row("tokens"))
    return done.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("bigint").alias("n_tokens"))


LEMMATISED_SQL = f"""WITH {TOKENS} SELECT doc_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS tokens,
count(term) AS n_tokens FROM lists LEFT JOIN terms USING (doc_id) GROUP BY doc_id"""


def vocabulary(spark, sf):
    return lemma.lemma_dict_and_vocab(tokenised(spark, sf), "tokens")[1].select("term", "idx")


def stored_vocabulary(spark, sf):
    path = scratch_path(spark, "vocabulary")
    sources.write_vocabulary(lemma.lemma_dict_and_vocab(tokenised(spark, sf), "tokens")[1], path)
    return sources.read_vocabulary(spark, path)


VOCABULARY_SQL = f"""WITH {TOKENS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx
FROM (SELECT DISTINCT lemma AS term FROM lemmas)"""


def persist_features(spark, sf):
    path = scratch_path(spark, "features")
    sources.load_or_compute(spark, path, lambda: weights(spark, sf).weights)
    stored = sources.load_or_compute(spark, path, lambda: None)
    return stored.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))


def _rounded(df, column="w", digits=6):
    return df.withColumn(column, F.round(column, digits))


def tfidf(spark, sf):
    return _rounded(weights(spark, sf).weights)


def tfidf_raw_text(spark, sf):
    return _rounded(features.tfidf_raw_text(texts(spark, sf), "text").weights)


RAW_TEXT_SQL = r"""WITH
lists AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN_\pM]{2,}') AS tokens FROM documents),
terms AS (SELECT doc_id, unnest(tokens) AS term FROM lists),
""" + TFIDF[TFIDF.index("n AS (SELECT count(*)"):] + """
SELECT doc_id, term, tf, round(w, 6) AS w FROM weights"""


def sparse_rows(spark, sf):
    """Number and sum of the non-zeros of the vector form."""
    docs = lemmatised(spark, sf)
    n_terms = lemma.distinct_tokens(docs, "tokens").count()
    few = n_terms <= features.BROADCAST_ROWS
    rows = features.sparse_vectors(docs, n_terms) if few else features.sparse_vectors_by_blocks(docs)
    # a vector can be opened only from Python without making it as wide as the vocabulary; for this check alone
    non_zeros = F.udf(lambda v: (int(v.numNonzeros()), float(v.values.sum())), "n bigint, s double")
    opened = rows.select("doc_id", non_zeros("features").alias("o"))
    return opened.select("doc_id", F.col("o.n").alias("n_terms"), F.round("o.s", 5).alias("sum_w"))


def top_words(spark, sf):
    t = weights(spark, sf)
    return features.top_words(t.weights, t.n_docs)


def corpus_mean(spark, sf):
    t = weights(spark, sf)
    return _rounded(features.corpus_mean(t.weights, t.n_docs), "mean_w", 8)


def cluster_mean(spark, sf):
    return _rounded(profile.cluster_mean(weights(spark, sf).weights, given_labels(spark, sf)), "mean_w", 8)


def top_tfidf_terms(spark, sf):
    top = profile.top_tfidf_terms(weights(spark, sf).weights, given_labels(spark, sf))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


def most_overrepresented(spark, sf):
    top = profile.most_overrepresented_terms(weights(spark, sf).weights, given_labels(spark, sf))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


CLUSTER_MEAN = f"""WITH {TFIDF}, {DOC_LABELS},
sizes AS (SELECT cluster, count(*) AS n FROM doc_labels GROUP BY cluster),
means AS (SELECT cluster, term, sum(w) / any_value(n) AS mean_w
          FROM weights JOIN doc_labels USING (doc_id) JOIN sizes USING (cluster) GROUP BY cluster, term),
overall AS (SELECT term, sum(w) / (SELECT count(*) FROM doc_labels) AS overall FROM weights GROUP BY term)
"""


def sample_per_cluster(spark, sf):
    s = sampling.sample_per_cluster(documents(spark, sf), given_labels(spark, sf), "text", 10)
    return s.withColumn("rank", F.col("rank").cast("bigint"))


def rows_in_sample(spark, sf):
    """Rows whose key was drawn in a sample taken elsewhere."""
    docs = documents(spark, sf)
    drawn = sampling.sample_exact(docs.select("doc_id"), "doc_id", fraction=0.1)
    return sampling.rows_with_keys(docs, drawn, "doc_id").select("doc_id", "lang", "n_chars")


def _share(df, column="share"):
    return df.withColumn(column, F.round(column, 6))


CONTINGENCY = f"""WITH {DOC_LABELS}, cells AS (
  SELECT d.cluster AS cluster_a, CAST(l.quality AS INTEGER) AS cluster_b, count(*) AS n
  FROM doc_labels d JOIN labels l USING (doc_id) GROUP BY ALL),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster_a) AS share_a FROM cells),
best AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY cluster_a ORDER BY n DESC, cluster_b) = 1)
"""

PREDICATE_SQL = rf"""list_filter(string_split_regex(lower(text), '\s+'), lambda t: length(t) > 0
  AND NOT regexp_matches(t, '^(?:https?://|www\.).') AND NOT regexp_matches(t, '^[^@]+@[^@]+$')
  AND NOT regexp_matches(t, '^[[:punct:]]+$') AND NOT list_contains({words_sql(stopwords())}, t))"""

REDUCED_SQL = rf"""string_split(trim(regexp_replace(array_to_string({kept_words('text')}, ' '), '\s+', ' ', 'g')), ' ')"""

# A stop list with words added and removed.
CUSTOM = stopwords(add=["der", "die", "und", "el", "la"], remove=["not", "no"])

def cosine_deviation(spark, sf):
    """Deviation of the pairwise cosines of TF-IDF rows in each cluster of more than one row, by sketches."""
    found = cluster_cohesion_terms(weights(spark, sf).weights, given_labels(spark, sf)).where("n > 1")
    rounded = {"mean_cosine": 6, "mean_square": 6, "std_cosine": 5}
    return found.select("cluster", "n", *(F.round(name, digits).alias(name) for name, digits in rounded.items()))


QUERIES = {
    "scan_clean_projection": (
        lambda s, d: sources.scan_columns(s, f"{d}/documents.parquet", ["doc_id", "text"]),
        "SELECT doc_id, text FROM documents",
    ),
    "scan_limited": (
        lambda s, d: sources.scan_columns(s, f"{d}/documents.parquet", ["doc_id", "text"], limit=50_000, order="doc_id").select(
            "doc_id", F.char_length("text").cast("bigint").alias("n_chars")
        ),
        "SELECT doc_id, length(text) AS n_chars FROM documents ORDER BY doc_id LIMIT 50000",
    ),
    "parquet_param_sql": (
        lambda s, d: sources.query_file(
            s, f"{d}/documents.parquet", "SELECT lang, count(*) AS n FROM {source} WHERE n_chars >= :least GROUP BY lang",
            least=500,
        ),
        "SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY lang",
    ),
    "frame_as_table": (
        lambda s, d: sources.query_frame(
            documents(s, d), "SELECT source, sum(n_chars) AS n_chars FROM {docs} GROUP BY source", "docs"
        ),
        "SELECT source, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source",
    ),
    "lower": (_text(F.lower), _text_sql("lower(text)")),
    "strip_urls": (_text(T.strip_urls), _text_sql(r"regexp_replace(text, 'https?://\S+|www\.\S+', '', 'g')")),
    "strip_emails": (_text(T.strip_emails), _text_sql(r"regexp_replace(text, '\S+@\S+', '', 'g')")),
    "strip_punct": (_text(T.strip_punctuation), _text_sql("regexp_replace(text, '[[:punct:]]', '', 'g')")),
    "strip_stopwords": (
        _text(lambda c: F.array_join(F.filter(F.split(T.strip_stopwords(T.without_links(c)), T.SPACES), lambda w: w != ""), " ")),
        _text_sql(f"array_to_string(list_filter({kept_words('text')}, lambda w: w <> ''), ' ')"),
    ),
    "stopword_pattern": (
        _text(lambda c: F.array_join(F.filter(F.split(
            T.strip_stopwords(T.without_links(c), stopword_pattern(CUSTOM)), T.SPACES), lambda w: w != ""), " ")),
        _text_sql(f"array_to_string(list_filter({kept_words('text', CUSTOM)}, lambda w: w <> ''), ' ')"),
    ),
    "strip_digits": (_text(T.strip_digits), _text_sql(r"regexp_replace(text, '\p{Nd}+', '', 'g')")),
    "strip_non_latin": (
        _text(T.strip_non_latin), _text_sql(LETTERS.replace(r"\p{Nd}+|", "").replace("(w,", "(text,")),
    ),
    "collapse_ws": (_text(T.collapse_spaces), _text_sql(r"trim(regexp_replace(text, '\s+', ' ', 'g'))")),
    "split_tokens": (
        _tokens(lambda c: T.split_tokens(T.collapse_spaces(c))),
        _tokens_sql(r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"),
    ),
    "filter_tokens": (
        _tokens(lambda c: T.keep_long_tokens(T.split_tokens(c))),
        _tokens_sql("list_filter(string_split(text, ' '), lambda t: length(t) > 1)"),
    ),
    "clean_tokens": (_tokens(T.tokens), _tokens_sql(tokens("text"))),
    "clean_tokens_reduced": (_tokens(T.clean_tokens_reduced), _tokens_sql(REDUCED_SQL)),
    "clean_tokens_strict": (
        _tokens(T.clean_tokens_strict),
        _tokens_sql(rf"list_filter({tokens('text')}, lambda t: length(t) > 2 AND regexp_matches(t, '^\p{{L}}+$'))"),
    ),
    "clean_tokens_by_predicate": (_tokens(T.clean_tokens_by_predicate), _tokens_sql(PREDICATE_SQL)),
    "distinct_tokens": (
        lambda s, d: lemma.distinct_tokens(tokenised(s, d), "tokens"), f"WITH {TOKENS} SELECT token FROM lemmas",
    ),
    "distinct_tokens_sql": (
        lambda s, d: lemma.distinct_tokens_sql(tokenised(s, d), "tokens"), f"WITH {TOKENS} SELECT token FROM lemmas",
    ),
    "lemma_dict_and_vocab": (
        lambda s, d: lemma.lemma_dict_and_vocab(tokenised(s, d), "tokens")[0], f"WITH {TOKENS} SELECT token, lemma FROM lemmas",
    ),
    "vocabulary": (vocabulary, VOCABULARY_SQL),
    "sink_vocab": (stored_vocabulary, VOCABULARY_SQL),
    "lemma_lookup": (lemma_lookup, LEMMATISED_SQL),
    "lemmatize_tokens": (lemmas_by_rule, LEMMATISED_SQL),
    "duplicate_lemmas": (
        lambda s, d: lemma.duplicate_lemmas(lemma.lemma_dict_and_vocab(tokenised(s, d), "tokens")[0]),
        f"WITH {TOKENS} SELECT token, lemma FROM lemmas QUALIFY count(*) OVER (PARTITION BY lemma) > 1",
    ),
    "corpus_token_counts": (
        lambda s, d: stats.corpus_token_counts(tokenised(s, d), "tokens"),
        f"WITH {TOKENS} SELECT token, count(*) AS n FROM words GROUP BY token",
    ),
    "tfidf": (tfidf, f"WITH {TFIDF} SELECT doc_id, term, tf, round(w, 6) AS w FROM weights"),
    "tfidf_raw_text": (tfidf_raw_text, RAW_TEXT_SQL),
    "tfidf_vectors": (
        sparse_rows,
        f"""WITH {TFIDF} SELECT doc_id, count(w) AS n_terms, coalesce(round(sum(w), 5), 0) AS sum_w
        FROM lists LEFT JOIN weights USING (doc_id) GROUP BY doc_id""",
    ),
    "persist_features": (
        persist_features,
        f"WITH {TFIDF} SELECT doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM weights GROUP BY doc_id",
    ),
    "corpus_mean_tfidf": (
        corpus_mean,
        f"WITH {TFIDF} SELECT term, round(sum(w) / (SELECT n_docs FROM n), 8) AS mean_w FROM weights GROUP BY term",
    ),
    "top_words_tfidf": (
        top_words,
        f"""WITH {TFIDF} SELECT term, round(sum(w) / (SELECT n_docs FROM n), 6) AS mean_w FROM weights GROUP BY term
        ORDER BY mean_w DESC, term LIMIT 20""",
    ),
    "cluster_mean_tfidf": (cluster_mean, CLUSTER_MEAN + "SELECT cluster, term, round(mean_w, 8) AS mean_w FROM means"),
    "top_tfidf_terms": (
        top_tfidf_terms,
        CLUSTER_MEAN + """SELECT cluster, term, round(mean_w, 6) AS mean_w,
        row_number() OVER (PARTITION BY cluster ORDER BY round(mean_w, 6) DESC, term) AS rank
        FROM means WHERE cluster <> -1 QUALIFY rank <= 15""",
    ),
    "most_overrepresented_terms": (
        most_overrepresented,
        CLUSTER_MEAN + """SELECT cluster, term, round(mean_w / (overall + 1e-10), 4) AS ratio,
        row_number() OVER (PARTITION BY cluster ORDER BY round(mean_w / (overall + 1e-10), 4) DESC, term) AS rank
        FROM means JOIN overall USING (term) WHERE cluster <> -1 QUALIFY rank <= 15""",
    ),
    "sample_exact": (
        lambda s, d: sampling.sample_exact(documents(s, d), "doc_id", fraction=0.1).select("doc_id", "text"),
        """SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id)
        LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM documents)""",
    ),
    "row_index_in_sample": (
        rows_in_sample,
        """SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id)
        LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM documents)""",
    ),
    "sample_conversations_per_cluster": (
        sample_per_cluster,
        f"""WITH {DOC_LABELS} SELECT cluster, doc_id, substr(text, 1, 500) AS excerpt,
        row_number() OVER (PARTITION BY cluster ORDER BY md5('42:' || doc_id), doc_id) AS rank
        FROM doc_labels JOIN documents USING (doc_id) WHERE cluster <> -1 QUALIFY rank <= 10""",
    ),
    "labels_to_rows": (
        lambda s, d: profile.labels_to_rows(documents(s, d).select("doc_id", "text"), given_labels(s, d)),
        f"WITH {DOC_LABELS} SELECT doc_id, text, cluster FROM documents JOIN doc_labels USING (doc_id)",
    ),
    "cluster_sizes": (
        lambda s, d: _share(profile.cluster_sizes(given_labels(s, d))),
        f"""WITH {DOC_LABELS} SELECT cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM doc_labels), 6) AS share
        FROM doc_labels WHERE cluster <> -1 GROUP BY cluster""",
    ),
    "noise_pct": (
        lambda s, d: _share(profile.noise_summary(given_labels(s, d)), "noise_pct"),
        f"""WITH {DOC_LABELS} SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters,
        count(*) AS n_rows, round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 6) AS noise_pct FROM doc_labels""",
    ),
    "noise_mask": (
        lambda s, d: profile.without_noise(given_labels(s, d)),
        f"WITH {DOC_LABELS} SELECT doc_id, cluster FROM doc_labels WHERE cluster <> -1",
    ),
    "cluster_selection": (
        lambda s, d: given_labels(s, d).where(profile.select_clusters(given_labels(s, d), [0, 3])),
        f"WITH {DOC_LABELS} SELECT doc_id, cluster FROM doc_labels WHERE cluster IN (0, 3)",
    ),
    "top_clusters_by_size": (
        lambda s, d: profile.top_clusters_by_size(given_labels(s, d), 10),
        f"""WITH {DOC_LABELS} SELECT cluster, count(*) AS n FROM doc_labels WHERE cluster <> -1 GROUP BY cluster
        ORDER BY n DESC, cluster LIMIT 10""",
    ),
    "compare_clusterings": (
        lambda s, d: _share(profile.compare_clusterings(given_labels(s, d), quality_labels(s, d)), "share_a"),
        CONTINGENCY + "SELECT cluster_a, cluster_b, n, round(share_a, 6) AS share_a FROM shares",
    ),
    "best_matches": (
        lambda s, d: _share(profile.best_matches(given_labels(s, d), quality_labels(s, d)), "share_a"),
        CONTINGENCY + "SELECT cluster_a, cluster_b, n, round(share_a, 6) AS share_a FROM best",
    ),
    "purity": (
        lambda s, d: _share(profile.purity(given_labels(s, d), quality_labels(s, d)), "purity"),
        CONTINGENCY + "SELECT round(sum(n) / (SELECT sum(n) FROM cells), 6) AS purity FROM best",
    ),
    "all_pairs_cosine": (
        lambda s, d: _share(profile.cluster_cohesion_mean(weights(s, d).weights, given_labels(s, d)), "mean_cosine"),
        f"""WITH {TFIDF}, {DOC_LABELS}, sizes AS (SELECT cluster, count(*) AS n FROM doc_labels GROUP BY cluster),
        cells AS (SELECT cluster, doc_id, term, w FROM weights JOIN doc_labels USING (doc_id)),
        dots AS (SELECT a.cluster, sum(a.w * b.w) AS total FROM cells a JOIN cells b
                 ON a.cluster = b.cluster AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY a.cluster)
        SELECT cluster, n, CASE WHEN n > 1 THEN round(coalesce(total, 0) / (n * (n - 1) / 2), 6) END AS mean_cosine
        FROM sizes LEFT JOIN dots USING (cluster)""",
    ),
    "all_pairs_cosine_deviation": (cosine_deviation, None),
}
