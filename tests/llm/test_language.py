import base64
import random
import string

import numpy as np
from cases import frame, odd_texts

from talkloom.llm.language import cluster, fit, gram_counts, held_out, identify

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs.where(~held_out()))
    found = identify(docs, model).join(docs.select("doc_id", "lang", held_out().alias("held_out")), "doc_id").toPandas()
    assert len(found) == docs.count()
    assert (found.lang_pred == found.lang)[found.held_out].mean() >= 0.98
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.005
    assert set(found.lang_pred) <= set(model.languages)
    other = spark.createDataFrame([(1, "日本語のテキストです。" * 30), (2, "Это русский текст о языке. " * 20)], "doc_id bigint, text string")
    assert [r["rejected"] for r in identify(other, model).collect()] == [True, True]


OTHERS = {
    "fi": "Suomi on pohjoismaa, jonka naapurimaita ovat Ruotsi, Norja ja Venäjä. Kaupungin kadut olivat hiljaisia, kun kävelimme kotiin.",
    "tr": "Her yıl milyonlarca turist bu şehre gelir. Dün akşam arkadaşlarımla birlikte yemek yedik ve sonra eve döndük.",
    "pl": "Wczoraj wieczorem poszliśmy do kina, a potem wróciliśmy do domu przez park. Kraj leży w środkowej Europie.",
}


def test_junk_and_other_languages_of_the_script_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs.where(~held_out()))
    rng = random.Random(7)
    alphabet = string.ascii_lowercase + "   "
    junk = {
        "letters": ["".join(rng.choices(alphabet, k=n)) for n in (30, 100, 300, 2000) for _ in range(25)],
        "base64": [base64.b64encode(rng.randbytes(n)).decode() for n in (30, 100, 300, 2000) for _ in range(25)],
    }
    for lang, text in OTHERS.items():
        junk[lang] = [text[at : at + n] for n in (40, 80) for at in range(0, len(text) - n, 3)] + [text, text * 9]
    for kind, texts in junk.items():
        assert np.mean([rejected for _, _, rejected in model.nearest(texts)]) >= 0.9, kind
    known = identify(docs.where("lang IS NOT NULL"), model).toPandas()
    assert known.rejected[known.lang_pred != "und"].mean() < 0.005
    # Without the limits nothing is.
    model.least[:] = 0
    assert not any(rejected for texts in junk.values() for _, _, rejected in model.nearest(texts))


def test_copies_fill_one_place_of_the_sample(spark):
    rows = [("the cat and the dog and the bird", "en")] * 50 + [(f"a text of its own number {'abcdefgh'[i]}", "en") for i in range(8)]
    frame_ = spark.createDataFrame(rows, "text string, lang string")
    assert len(fit(frame_, sample=9).vectors) == 4
    assert np.array_equal(fit(frame_, sample=100).vectors, fit(frame_, sample=1000).vectors)


def test_odd_texts(spark):
    rows = odd_texts()
    labelled = spark.createDataFrame(
        [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("le chat", None), ("...", "es"), ("", "it")],
        "text string, lang string",
    )
    model = fit(labelled)
    assert model.languages == ["de", "en"]
    found = identify(frame(spark, rows), model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] in (5, 6, 7, 15):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert {r["lang_pred"] for r in found} <= {"de", "en", "und"}
    pair = spark.createDataFrame([(1, "THE DOG"), (2, "die Katze!")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in identify(pair, model).collect()} == {1: "en", 2: "de"}
    assert identify(frame(spark, []), model).count() == 0


def test_without_labels_all_is_unknown(spark):
    model = fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in identify(frame(spark, odd_texts()), model).collect()} == {"und"}


def test_counts_are_of_grams(spark):
    counts = gram_counts(["ab ab", "AB,,,AB", "", "x" * 1000], 1 << 12)
    assert (counts[0] == counts[1]).all() and not counts[2].any()
    # Letters one by one, pairs and triples of " ab ab ".
    assert counts[0].sum() == 4 + 6 + 5
    together, alone = gram_counts(["ab", "cd"], 256), gram_counts(["cd"], 256)
    assert (together[1] == alone[0]).all()


def test_clusters_follow_the_groups():
    rng = np.random.default_rng(0)
    centres = np.eye(3, 20)
    vectors = np.repeat(centres, 30, axis=0) + 0.05 * rng.random((90, 20))
    found = cluster(vectors.astype(np.float32), 3)
    assert sorted(found.argmax(axis=1).tolist()) == [0, 1, 2]
    assert len(cluster(vectors[:2], 4)) <= 2
