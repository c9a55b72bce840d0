import numpy as np
from cases import components, frame, shingles, without_lines
from test_decontaminate import plain
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from talkloom.llm.language import fit, held_out, identify
from talkloom.llm.tables import documents
from talkloom.llm.tokens import default_tokenizer
from talkloom.runtime import cut

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_each_stage_on_its_own_input(spark):
    docs = documents(spark, SF)
    inputs = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        inputs.append(cut(stage(spark, inputs[-1], SF), "stage-test"))
        assert inputs[-1].schema.simpleString() == docs.schema.simpleString()
    first, known, lined, single, clean = (rows_of(df) for df in inputs)

    rejected = {r["doc_id"] for r in identify(docs, fit(docs.where(~held_out()))).where("rejected").collect()}
    assert known == {i: r for i, r in first.items() if i not in rejected}

    left = without_lines([(i, r["text"]) for i, r in known.items()])
    kept = {i: t for i, (_, n, t) in left.items() if not n or t.strip(" \t\n\v\f\r")}
    assert {i: r["text"] for i, r in lined.items()} == kept
    assert all(r["n_chars"] == len(r["text"]) for i, r in lined.items() if left[i][1])

    order = sorted(lined)
    root = components([(i, lined[i]["text"]) for i in order], pipeline.PERCENT)
    assert single == {order[n]: lined[order[n]] for n, r in enumerate(root) if r == n}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {int(r[0]) for r in plain([(i, r["text"]) for i, r in single.items()], items) if r[-1]}
    assert clean == {i: r for i, r in single.items() if i not in gone}

    library = Tokenizer.from_file(default_tokenizer())
    pieces = pipeline.STAGES[-1][1](spark, inputs[-1], SF).toPandas()
    for i, own in pieces.sort_values("start").groupby("doc_id"):
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == [*library.encode(clean[i]["text"], add_special_tokens=False).ids, 1]
    assert set(pieces.doc_id) == set(clean)


def test_near_dedup_like_all_pairs_at_80(spark):
    """Pairs that share from 0.7 to 0.95 of their shingles, and a chain."""
    rows = []
    for n in range(60):
        words = [f"w{n}x{i}" for i in range(104)]
        changed = [f"c{n}x{i}" for i in range(3 + n % 15)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[: -len(changed)] + changed))]
        if n % 5 == 0:
            rows.append((10 * n + 2, " ".join(["y"] * 8 + words[8 : -len(changed)] + changed)))
    sets = {i: shingles(t) for i, t in rows}
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i // 10 == j // 10 and i < j}
    assert sum(0.8 <= x < 0.85 for x in share.values()) >= 10
    root = {i: i for i in sets}
    for _ in range(3):
        for (i, j), x in share.items():
            if x >= 0.8:
                root[i] = root[j] = min(root[i], root[j])
    found = pipeline.one_of_each_group(spark, frame(spark, rows), SF)
    assert set(rows_of(found)) == {i for i, r in root.items() if i == r}


def test_run_is_all_stages(spark):
    assert [name for name, _ in pipeline.STAGES] == [
        "language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"
    ]
    found = pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    assert found.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
