import math
import random

import numpy as np
import pytest
from cases import frame, odd_texts

from talkloom.llm import quality
from talkloom.llm.quality import ALPHA, BETA, CHUNK_BYTES, L1, L2, Leader, cell_counts, fit, held_out, score, vectors

SF = "/root/testdata/sf0.01"


def area(labels, scores):
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + (good[:, None] >= bad).mean()) / 2


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights = fit(docs, labels.where(~held_out()))
    found = score(docs, weights)
    assert found.count() == docs.count()
    known = found.join(labels, "doc_id").where(held_out()).toPandas()
    assert area(known.quality.to_numpy(), known.score.to_numpy()) >= 0.97
    assert (known.score[known.quality == 1] >= 0.3).mean() >= 0.99
    assert known.score.between(0, 1).all()
    # Held-out labels aren't learned from: turning them over changes nothing.
    turned = labels.where(~held_out()).unionByName(labels.where(held_out()).withColumn("quality", 1 - labels["quality"]))
    assert (fit(docs, turned.where(~held_out())) == weights).all()


def plain(examples, shards, rounds, cells):
    """The updates one number at a time."""
    z, n = [0.0] * (cells + 1), [0.0] * (cells + 1)

    def weight(i, z, n):
        if abs(z[i]) <= L1:
            return 0.0
        return -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)

    for _ in range(rounds):
        ends = []
        for shard in shards:
            zs, ns = list(z), list(n)
            for e in shard:
                x, y = examples[e]
                w = {i: weight(i, zs, ns) for i in x}
                p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
                for i, v in x.items():
                    g = (p - y) * v
                    zs[i] += g - (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / ALPHA * w[i]
                    ns[i] += g * g
            ends.append((zs, ns))
        z = [sum(e[0][i] for e in ends) / len(ends) for i in range(cells + 1)]
        n = [sum(e[1][i] for e in ends) / len(ends) for i in range(cells + 1)]
    return [weight(i, z, n) for i in range(cells + 1)]


def test_states_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    sent, collect = [], DataFrame.collect

    def counted(df):
        rows = collect(df)
        sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    docs = spark.createDataFrame([(i, f"text {i} {'!' * (i % 2)}") for i in range(40)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    assert len(fit(docs, labels, cells=1024, rounds=3)) == 1025
    assert sent and sum(sent) <= 8 * 1025  # the weights, and no shard's state


def test_updates_equal_plain_ones(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("good fine bad! ugly!! plain Word".split(), k=rng.randrange(1, 12))) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int("!" not in t)) for i, t in enumerate(texts)], "doc_id bigint, quality int")
    cells = 64
    got = fit(docs, labels, cells=cells, rounds=3)
    from pyspark.sql import functions as F

    order = docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("o")).selectExpr("doc_id", "o", "pmod(o, 4) AS s").collect()
    examples = {}
    for i, t in enumerate(texts):
        _, cell, value = vectors([t.encode()], cells)
        examples[i] = ({**dict(zip(cell.tolist(), value.astype("<f4").astype(float).tolist())), cells: 1.0}, int("!" not in t))
    shards = [[r["doc_id"] for r in sorted(order, key=lambda r: r["o"]) if r["s"] == s] for s in range(4)]
    expected = plain(examples, [s for s in shards if s], 3, cells)
    assert np.allclose(got, expected, atol=1e-9)


def test_copies_count_once_and_odd_labels_are_left_out(spark):
    docs = spark.createDataFrame([(1, "good words"), (2, "bad words!!"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int")
    more = docs.unionByName(spark.createDataFrame([(i, "bad words!!") for i in range(10, 40)], docs.schema))
    odd = labels.unionByName(spark.createDataFrame([(i, 0) for i in range(10, 40)] + [(None, 1), (2, None), (99, 1), (1, 1)], labels.schema))
    assert (fit(docs, labels, cells=256) == fit(more, odd, cells=256)).all()
    assert len(quality.sampled(odd, "doc_id", "quality", 5).collect()) == 5


def test_odd_texts(spark):
    rows = odd_texts()
    weights = np.zeros(257)
    weights[:256] = np.linspace(-1, 1, 256)
    weights[256] = 0.7
    found = score(frame(spark, rows), weights).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        if r["doc_id"] in (5, 6, 7):
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-0.7)))
    assert score(frame(spark, []), weights).count() == 0
    none = fit(frame(spark, rows), spark.createDataFrame([], "doc_id bigint, quality int"), cells=256)
    assert not none.any()


def test_counts_do_not_depend_on_company():
    texts = [b"One two, two!! THREE 4x \xc3\xbc", b"", b"  ", b"One two", b"!?"]
    place, counts = cell_counts(texts, 1 << 10)
    for i, t in enumerate(texts):
        own, n = cell_counts([t], 1 << 10)
        mine = place // (1 << 10) == i
        assert (place[mine] % (1 << 10) == own).all() and (counts[mine] == n).all()
    # Tokens: One two , two !! THREE 4x ü; pairs of them; shapes, their pairs and triples.
    assert counts[place < 1 << 10].sum() == 8 + 7 + 8 + 7 + 6


def test_long_texts_are_counted_in_segments():
    text = b"some words and more, " * (3 * CHUNK_BYTES // 21)
    number, cell, value = vectors([text], 1 << 10)
    assert not number.any() and (value @ value) == pytest.approx(1)
    whole, counts = cell_counts([text], 1 << 10)
    assert set(whole) <= set(cell) and len(cell) <= len(whole) + 8


def test_state_starts_at_zero():
    leader = Leader.new(8)
    assert not leader.weights().any()
    leader.learn(np.array([1, 8]), np.array([1.0, 1.0]), 1.0)
    assert leader.weights()[1] > 0 and not leader.weights()[0]
