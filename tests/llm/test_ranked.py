import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import frame, odd_texts, random_texts

from talkloom.llm import ranked
from talkloom.llm.ranked import Best, product, rank_documents


def terms(text):
    lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, k=10):
    bags = [(key, Counter(terms(t))) for key, t in rows]
    bags = [(key, bag, sum(bag.values())) for key, bag in bags if bag]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    frequency = Counter(t for _, bag, _ in bags for t in bag)
    result = []
    for item, text in items:
        scored = []
        for key, bag, n in bags:
            m = 25 + 75 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in terms(text) if t in bag
            )
            if score > 0:
                scored.append((-score, key is not None, key or 0, key))
        result += [(item, rank + 1, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scored)[:k])]
    return sorted(result, key=str)


def found(spark, rows, items, **how):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, rank string, doc_id int")
    ranks = rank_documents(frame(spark, rows), table, **how)
    assert ranks.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, ranks.collect()), key=str)


def test_equals_brute_force(spark):
    rows = odd_texts() + random_texts(3, 120)
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices((rng.choice(rows)[1] or "a").split() or ["b"], k=rng.randrange(1, 9)))) for i in range(20)]
    items += [(90, None), (91, ""), (92, "..."), (93, "One ONE one, one"), (94, "nowhere"), (95, rows[-1][1]), (95, "two words")]
    expected = brute(rows, items)
    assert found(spark, rows, items) == expected
    # Several passes over the documents, and tiles smaller than the tables.
    assert found(spark, rows, items, pass_bytes=60) == expected


def test_small_tiles(spark, monkeypatch):
    rows, items = random_texts(5, 70), [(i, t) for i, t in random_texts(6, 15)]
    expected = brute(rows, items, 3)
    for name, value in (("TILE_ITEMS", 4), ("TILE_DOCS", 8), ("TILE_TERMS", 16)):
        monkeypatch.setattr(ranked, name, value)
    assert found(spark, rows, items, k=3) == expected


def test_ties_take_the_smallest_ids(spark):
    rows = [(i, "a copy of one text") for i in range(50, 0, -1)] + [(None, "a copy of one text"), (7, "a copy of one text")]
    got = found(spark, rows, [(1, "copy text")], k=4)
    # A null id first; the repeated row counts as a document of its own. All texts hold all terms, so weights are small.
    assert got == brute(rows, [(1, "copy text")], 4)
    varied = rows + [(i, f"other words {i}") for i in range(100, 200)]
    got = found(spark, varied, [(1, "copy text")], k=4)
    assert [(r[1], r[2]) for r in got] == [(1, None), (2, 1), (3, 2), (4, 3)] and len({r[3] for r in got}) == 1


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None), (2, "...")], [(1, "a")]) == []


def test_products_are_exact(monkeypatch):
    rng = np.random.default_rng(0)
    items = rng.integers(0, 1 << 33, (5, 40))
    items[0, 3] = 1 << 40  # beyond float64 by itself
    impacts = rng.integers(0, ranked.IMPACT + 1, (40, 7))
    plain = [[sum(int(a) * int(b) for a, b in zip(row, column)) for column in impacts.T] for row in items]
    assert product(items, impacts).tolist() == plain
    monkeypatch.setattr(ranked, "TILE_TERMS", 7)
    assert product(items, impacts).tolist() == plain
    assert product(np.zeros((2, 0), int), np.zeros((0, 3), int)).tolist() == [[0] * 3] * 2


@pytest.mark.parametrize("seed", range(5))
def test_best_keeps_ties(seed):
    rng = np.random.default_rng(seed)
    scores, docs = rng.integers(0, 5, (3, 60)), rng.permutation(60)
    best = Best(3, 4)
    for at in range(0, 60, 7):
        best.add(scores[:, at : at + 7], docs[at : at + 7])
    for item in range(3):
        expected = sorted((-s, d) for s, d in zip(scores[item], docs) if s > 0)[:4]
        kept = best.item == item
        assert [(-s, d) for s, d in zip(best.score[kept], best.doc[kept])] == expected
