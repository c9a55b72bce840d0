import itertools

import pytest
from cases import frame, odd_texts, random_texts
from pyspark.sql import functions as F

from talkloom.llm.hilbert import curve_index, hilbert_shards, quantised, write_shards
from talkloom.runtime import scratch_path


@pytest.mark.parametrize("bits,dimensions", [(3, 2), (2, 3), (2, 4)])
def test_neighbours_on_the_curve_are_neighbouring_cells(spark, bits, dimensions):
    cells = list(itertools.product(range(1 << bits), repeat=dimensions))
    names = [f"c{i}" for i in range(dimensions)]
    df = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    kept = df.select("*", *(F.col(n).alias(f"_{n}") for n in names))
    found = curve_index(kept, [f"_{n}" for n in names], bits, "at").orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(len(cells)))
    for a, b in zip(found, found[1:]):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_cells_follow_the_order_of_the_values(spark):
    rows = [(None, None), *((f"http://host{i % 7}.org/{i}", float(i * i)) for i in range(200)), ("http://host3.org/", float("nan"))]
    df = spark.createDataFrame(rows, "url string, size double")
    found = quantised(df, ["url", "size"], 3).collect()
    for column, cell in (("url", "_cell0"), ("size", "_cell1")):
        known = sorted((r[column], r[cell]) for r in found if r[column] is not None and r[column] == r[column])
        assert [c for _, c in known] == sorted(c for _, c in known)
        assert {r[cell] for r in found if r[column] is None or r[column] != r[column]} == {0}
    assert max(r["_cell1"] for r in found) == 7


def test_shards_are_even_runs(spark):
    rows = [*odd_texts(), *random_texts(8, 200)]
    df = frame(spark, rows).withColumn("size", F.octet_length("text"))
    found = hilbert_shards(df, ["lang", "size", "key"], ["doc_id"], 7)
    assert found.columns == [*df.columns, "curve", "shard", "slot"]
    path = scratch_path(spark, "shards-test")
    write_shards(found, path, 7)
    shards: dict = {}
    for r in spark.read.parquet(path).collect():
        shards.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    assert sorted(shards) == list(range(7))
    sizes = [len(s) for s in shards.values()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    last = -1
    for shard in range(7):
        slots = sorted(shards[shard])
        assert [slot for slot, _ in slots] == list(range(len(slots)))
        curve = [c for _, c in slots]
        assert curve == sorted(curve) and curve[0] >= last
        last = curve[-1]


def test_few_equal_or_no_rows(spark):
    same = spark.createDataFrame([(1, "a")] * 5, "doc_id bigint, shard string").withColumnRenamed("shard", "lang")
    found = hilbert_shards(same, ["lang", "doc_id"], ["doc_id"], 10).collect()
    assert len({r["shard"] for r in found}) == 5 and {r["slot"] for r in found} == {0}
    assert hilbert_shards(frame(spark, []), ["lang", "class"], ["doc_id"], 3).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 4, "doc_id bigint, lang string")
    assert sorted(r["slot"] for r in hilbert_shards(nulls, ["lang"], ["doc_id"], 2).collect()) == [0, 0, 1, 1]
