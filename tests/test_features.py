import json
import math

import pytest
from pyspark.sql import functions as F

from talkloom import runtime
from talkloom.checks import document_queries
from talkloom.functions.lemmas import IRREGULAR, lemmas_in_row
from talkloom.operators import embed, lemma, sampling, tfidf
from talkloom.sources import raw as sources

DOCS = [(1, ["cats", "dog", "cats"]), (2, ["dog"]), (3, []), (4, ["cat", "stories", "classes", "bus"])]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, tokens array<string>")


def test_lemmas_by_table_and_by_rule(spark, docs):
    table, vocab = lemma.lemma_dict_and_vocab(docs, "tokens")
    found = {r["token"]: r["lemma"] for r in table.collect()}
    assert found == {"cats": "cat", "cat": "cat", "dog": "dog", "stories": "story", "classes": "class", "bus": "bus"}
    assert [r["term"] for r in vocab.orderBy("idx").collect()] == ["bus", "cat", "class", "dog", "story"]
    by_table = {r["doc_id"]: r["tokens"] for r in lemma.lemmatize_tokens(docs, "tokens", table, "doc_id").collect()}
    by_rule = {r["doc_id"]: r["tokens"] for r in docs.withColumn("tokens", lemmas_in_row("tokens")).collect()}
    assert by_table == by_rule == {1: ["cat", "dog", "cat"], 2: ["dog"], 3: [], 4: ["cat", "story", "class", "bus"]}
    assert [tuple(r) for r in lemma.duplicate_lemmas(table).collect()] == [("cat", "cat"), ("cats", "cat")]
    assert all(found == IRREGULAR[t] for t, found in zip(IRREGULAR, spark.createDataFrame(
        [(list(IRREGULAR),)], "t array<string>").select(lemmas_in_row("t")).first()[0]))


def test_tokens_missing_from_a_given_table_stay(spark, docs):
    given = spark.createDataFrame([("dog", "hound")], "token string, lemma string")
    out = {r["doc_id"]: r["tokens"] for r in lemma.lemmatize_tokens(docs, "tokens", given, "doc_id").collect()}
    assert out[1] == ["cats", "hound", "cats"] and out[3] == []
    conv = spark.createDataFrame([("c", "Dogs eat"), ("d", None)], "conversation_id string, text string")
    table = spark.createDataFrame([("dogs", "hound")], "token string, lemma string")
    done, vocab = lemma.process_message_tokens(conv, "text", lemmas=table)
    assert done.first()["text_tokens"] == ["hound", "eat"]
    assert {r["term"] for r in vocab.collect()} == {"hound", "eat"}


def test_forms_of_distinct_tokens_agree(docs):
    a = {r[0] for r in lemma.distinct_tokens(docs, "tokens").collect()}
    b = {r[0] for r in lemma.distinct_tokens_sql(docs, "tokens").collect()}
    two = docs.withColumn("more", F.array(F.lit("extra")))
    assert a == b and {r[0] for r in lemma.distinct_tokens(two, ["tokens", "more"]).collect()} == a | {"extra"}


def test_tfidf_by_hand_and_empty_document(docs):
    fitted = tfidf.tfidf(docs)
    got = {(r["doc_id"], r["term"]): r["w"] for r in fitted.weights.collect()}
    idf = {"cats": math.log(5 / 2) + 1, "dog": math.log(5 / 3) + 1}
    norm = math.hypot(2 * idf["cats"], idf["dog"])
    assert fitted.n_docs == 4
    assert got[(1, "cats")] == pytest.approx(2 * idf["cats"] / norm)
    assert got[(2, "dog")] == pytest.approx(1.0)
    means = {r["term"]: r["mean_w"] for r in tfidf.corpus_mean(fitted.weights, 4).collect()}
    assert means["dog"] == pytest.approx((got[(1, "dog")] + 1.0) / 4)


def test_vectors_equal_long_form_and_keep_empty_rows(docs):
    fitted = tfidf.tfidf(docs)
    long = {}
    for r in fitted.weights.collect():
        long.setdefault(r["doc_id"], []).append(r["w"])
    for r in tfidf.sparse_vectors(docs, fitted.idf.count()).collect():
        assert sorted(r["features"].values) == pytest.approx(sorted(long.get(r["doc_id"], [])))
    with pytest.raises(ValueError):
        tfidf.sparse_vectors(docs, runtime.BROADCAST_ROWS + 1)


def test_given_vocabulary(spark, docs):
    vocab = spark.createDataFrame([("dog", 0)], "term string, idx bigint")
    assert {r["term"] for r in tfidf.tfidf(docs, vocabulary=vocab).weights.collect()} == {"dog"}


def test_salted_lookup_equals_broadcast(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, runtime.lookup_join(left, right, "k", how).collect()))
        b = sorted(map(str, runtime.lookup_join(left, right, "k", how, limit=10).collect()))
        assert a == b


@pytest.mark.parametrize("n", [5, 1500])
def test_top_n_of_a_hot_group(spark, n):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 4).alias("g"), "id").repartition(8)
    top = runtime.top_n_per_group(df, ["g"], [F.desc("id")], n)
    got = {}
    for r in top.collect():
        got.setdefault(r["g"], {})[r["rank"]] = r["id"]
    for g, ranked in got.items():
        ids = sorted((i for i in range(6000) if (0 if i % 3 == 0 else i % 4) == g), reverse=True)[:n]
        assert [ranked[i + 1] for i in range(len(ids))] == ids and len(ranked) == len(ids)


def test_dense_index_is_gapless_over_partitions(spark):
    df = spark.range(5000).select(F.format_string("%05d", F.col("id")).alias("t")).repartition(16)
    got = [r["idx"] for r in runtime.dense_index(df, "t").orderBy("t").collect()]
    assert got == list(range(5000))


def test_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    first = None
    for parts in (1, 7, 64):
        keys = {r["k"] for r in sampling.sample_exact(df.repartition(parts), "k", size=6_001, seed=3).collect()}
        assert len(keys) == 6_001 and (first is None or keys == first)
        first = keys
    assert sampling.sample_exact(df, "k", fraction=0.1).count() == 2000
    assert sampling.sample_exact(df, "k", size=0).count() == 0
    assert sampling.sample_exact(df, "k", size=10**9).count() == 20_000
    assert "Exchange" not in sampling.sample_exact(df, "k", size=10)._jdf.queryExecution().executedPlan().toString()
    for wrong in ({}, {"size": 1, "fraction": 0.5}):
        with pytest.raises(ValueError):
            sampling.sample_exact(df, "k", **wrong)


def test_sample_per_cluster(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), 600).alias("text"))
    labels = df.select("doc_id", F.when(F.col("doc_id") < 290, 0).when(F.col("doc_id") < 295, 1).otherwise(-1).alias("cluster"))
    out = sampling.sample_per_cluster(df, labels, "text", 10).collect()
    sizes = {c: sum(r["cluster"] == c for r in out) for c in (-1, 0, 1)}
    assert sizes == {-1: 0, 0: 10, 1: 5} and {len(r["excerpt"]) for r in out} == {500}


def test_features_are_saved_once_and_vocabulary_roundtrips(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "f")
    assert sources.load_or_compute(spark, path, build).count() == 3
    assert sources.load_or_compute(spark, path, build).count() == 3 and len(calls) == 1
    vocab = spark.createDataFrame([("é", 0), ("z", 1)], "term string, idx bigint")
    sources.write_vocabulary(vocab, str(tmp_path / "v"))
    assert [tuple(r) for r in sources.read_vocabulary(spark, str(tmp_path / "v")).orderBy("idx").collect()] == [("é", 0), ("z", 1)]
    (tmp_path / "list.json").write_text(json.dumps(["z", "é", "a"], ensure_ascii=False, indent=2), encoding="utf-8")
    got = sources.read_vocabulary(spark, str(tmp_path / "list.json")).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [("a", 0), ("z", 1), ("é", 2)]


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    assert runtime.scratch_dir(spark)

    class Conf:
        def get(self, *_):
            return None

    class Context:
        folder = None

        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = f"file:{folder}"

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), Context(master)

    with pytest.raises(ValueError):
        runtime.scratch_dir(Session("spark://host:7077"))
    local = Session("local[2]")
    assert runtime.scratch_dir(local).startswith("file:") and runtime.scratch_dir(local) == runtime.scratch_dir(local)


def test_rows_with_null_or_repeated_keys_keep_their_tokens(spark):
    docs = spark.createDataFrame(
        [(None, ["cats", "dogs"], 1), (None, ["mice"], 2), (7, ["cats"], 3), (7, ["dogs", "stay"], 4), (8, None, 5), (9, [], 6)],
        "key bigint, tokens array<string>, n int",
    )
    given = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("mice", "mouse")], "token string, lemma string")
    found = {r["n"]: r["tokens"] for r in lemma.lemmatize_tokens(docs, "tokens", given, "key").collect()}
    assert found == {1: ["cat", "dog"], 2: ["mouse"], 3: ["cat"], 4: ["dog", "stay"], 5: None, 6: []}


def test_texts_without_words_have_the_zero_vector(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "? !"), (3, None), (4, "")], "doc_id bigint, text string")
    found = {r["doc_id"]: sum(abs(x) for x in r["vec"]) for r in embed.embed_by_projection(docs, "text", "doc_id", dim=16).collect()}
    assert sorted(found) == [1, 2, 4] and found[1] > 0 and found[2] == found[4] == 0


def test_features_follow_their_inputs(spark, tmp_path):
    source, store, calls = str(tmp_path / "in"), str(tmp_path / "store"), []

    def build():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS twice")

    def load(**parameters):
        rows = sources.load_or_compute(spark, store, build, [source], parameters)
        return sorted(r["twice"] for r in rows.collect())

    spark.range(3).write.parquet(source)
    assert load() == load() == [0, 2, 4] and len(calls) == 1
    assert load(width=2) == [0, 2, 4] and len(calls) == 2
    spark.range(3, 5).write.mode("append").parquet(source)
    assert load() == [0, 2, 4, 6, 8] and len(calls) == 3


def test_interrupted_build_is_made_anew(spark, tmp_path):
    store = str(tmp_path / "store")
    fail = F.when(F.col("id") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    with pytest.raises(Exception, match="lost"):
        sources.load_or_compute(spark, store, lambda: spark.range(2).select(fail.alias("id")))
    assert sources.load_or_compute(spark, store, lambda: spark.range(2)).count() == 2
    empty = sources.load_or_compute(spark, store, lambda: spark.range(0), parameters={"n": 0})
    assert empty.columns == ["id"] and empty.count() == 0


def test_first_rows_by_a_column(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("(id * 37) % 100 AS k", "id").repartition(5).write.parquet(path)
    assert [r["k"] for r in sources.scan_columns(spark, path, ["k", "id"], 7, "k").collect()] == list(range(7))
    assert sources.scan_columns(spark, path, ["k"], 200, "k").count() == 100
    assert sources.scan_columns(spark, path, ["k"], 5).count() == 5


def test_lists_of_short_tokens_are_measured_as_they_are_held(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 200)
    lists = spark.createDataFrame([(1, ["ab"] * 20)], "k bigint, tokens array<string>")
    assert not runtime.fits_broadcast(lists) and runtime.fits_broadcast(lists.select("k"))


def test_rebuilt_lists_are_not_sent_to_every_task(spark):
    rows = [(1, ["cats", None, "dog"], "x"), (1, ["cats", "é"], "y"), (None, [], "z"), (None, None, "u"), (2, ["", "cats", ""], "v")]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, more string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("é", "e")], "token string, lemma string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = lemma.lemmatize_tokens(docs, "tokens", lemmas, "doc_id")
        plan = done._jdf.queryExecution().executedPlan().toString()
        found = {r["more"]: (r["doc_id"], r["tokens"]) for r in done.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1  # the lemmas
    assert found == {
        "x": (1, ["cat", None, "dog"]), "y": (1, ["cat", "e"]), "z": (None, []), "u": (None, None), "v": (2, ["", "cat", ""]),
    }


def test_weights_with_a_large_idf_table_shuffle_no_terms_of_documents(spark, monkeypatch):
    rows = [(i % 23 or None, None if i % 11 == 0 else [f"w{i * j % 17}" for j in range(i % 7)] + [None, "é"]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    vocab = spark.createDataFrame([("w1", 0), ("é", 1)], "term string, idx bigint")

    def found(**given):
        weights = tfidf.tfidf(docs, **given).weights
        return weights, {(r["doc_id"], r["term"]): (r["tf"], pytest.approx(r["w"])) for r in weights.collect()}

    near, near_given = found()[1], found(vocabulary=vocab)[1]
    monkeypatch.setattr(tfidf, "fits_broadcast", lambda *_: False, raising=False)
    monkeypatch.setattr(runtime, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr("talkloom.operators.token_blocks.BLOCK_TOKENS", 30, raising=False)
    weights, far = found()
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert far == near and found(vocabulary=vocab)[1] == near_given
    assert "_salt" not in plan and "Exchange hashpartitioning(doc_id" not in plan


def test_vectors_of_a_vocabulary_beyond_the_limit(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(f"{a}{b}x" for a in "abc"[: i % 4] for b in "defg"[: i % 5] + "d")) for i in range(40)] + [(3, None), (3, "")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def found():
        return sorted(map(tuple, document_queries.sparse_rows(spark, str(tmp_path)).collect()))

    near = found()
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 3)
    assert found() == near
    docs = document_queries.lemmatised(spark, str(tmp_path))
    terms = {t: i for i, t in enumerate(sorted({t for r in docs.collect() for t in r["tokens"]}))}
    own = {r["doc_id"]: sorted({terms[t] for t in r["tokens"]}) for r in docs.where("doc_id <> 3").collect()}
    vectors = tfidf.sparse_vectors_by_blocks(docs).where("doc_id <> 3").collect()
    assert {r["doc_id"]: list(r["features"].indices) for r in vectors} == own
    assert {r["features"].size for r in vectors} == {len(terms)}


def test_blocks_project_their_own_weights(spark, monkeypatch):
    texts = ["red fish blue fish", "", None, "one red stone and a blue one", "wörter für 鱼鱼 straße", "a b", "blue"] * 3
    keys = [0, 1, 2, 3, 4, 5, None, 7, 8, 9, 0, 11, 12, None, 14, 15, 16, 17, 18, 19, 20]
    docs = spark.createDataFrame(list(zip(keys, texts)), "k bigint, text string")

    def found():
        vectors = embed.embed_by_projection(docs, "text", "k", dim=16)
        assert vectors.schema.simpleString() == "struct<k:bigint,vec:array<float>>"
        return vectors, sorted((r["k"] is None, r["k"] or 0, [round(x, 5) for x in r["vec"]]) for r in vectors.collect())

    expected = found()[1]
    assert len(expected) == 18
    monkeypatch.setattr(tfidf, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(runtime, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr("talkloom.operators.token_blocks.BLOCK_TOKENS", 30)
    vectors, rows = found()
    assert rows == expected
    # Nothing is shuffled by document behind the blocks.
    assert "doc_id" not in " ".join(x for x in vectors._jdf.queryExecution().toString().splitlines() if "hashpartitioning" in x.lower() and "_block" not in x)
    assert vectors._jdf.queryExecution().analyzed().toString().count("Join") == 1  # terms' idf
