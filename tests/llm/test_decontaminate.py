import re

import numpy as np
import pytest
from cases import PASSAGE, frame, odd_texts, random_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm.decontaminate import SuffixArray, contamination

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub(b"[A-Z]+", lambda m: m.group().lower(), (text or "").encode()))


def plain(docs, items, window=13):
    windows: dict = {}
    for name, text in items:
        own = words(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            windows.setdefault(tuple(own[i : i + n]), set()).add(str(name))
    result = []
    for key, text in docs:
        own, hit, names, longest = words(text), set(), set(), 0
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if found := windows.get(tuple(own[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        for _, item in items:
            other = words(item)
            for i in range(len(own)):
                for j in range(len(other)):
                    k = 0
                    while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                        k += 1
                    if k >= min(window, len(other)):
                        longest = max(longest, k)
        contaminated = bool(hit) and 20 * len(hit) >= len(own)
        result.append((str(key), len(own), len(hit), tuple(sorted(names)), longest, contaminated))
    return sorted(result)


def found(df):
    return sorted(
        (str(r["doc_id"]), r["n_words"], r["n_hit"], tuple(r["items"]), r["longest"], r["contaminated"])
        for r in df.collect()
    )


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_hits_like_a_search_of_windows(spark, item_bytes):
    docs = [*random_texts(6, 40), (9001, "Short-ITEM, here"), (9002, "short item here and there")]
    items = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[5:25])), (10, "short item"), (3, docs[0][1]), (4, "absent " * 20)]
    items += [(5, None), (6, ""), (7, "?!"), (2, "a second text of one item")]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in [*items, (None, PASSAGE)]], "item_id bigint, text string, n_hit int")
    assert found(contamination(frame(spark, docs), benchmark, item_bytes=item_bytes)) == plain(docs, items)


@pytest.mark.parametrize("item_bytes", [1 << 20, 100])
def test_items_of_null_or_equal_ids(spark, item_bytes):
    one, two, three = (" ".join(f"{c}{i}" for i in range(20)) for c in "abc")
    rows = [(None, one), (2, two), (2, three), (1, three)]
    benchmark = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = frame(spark, [(1, one), (2, f"{two} and {three}"), (3, f"{one} {two}"), (4, "nothing")])
    found = contamination(docs, benchmark, item_bytes=item_bytes)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: (r["n_hit"], r["items"], r["unnamed"], r["contaminated"]) for r in found.collect()}
    assert got == {1: (20, [], True, True), 2: (40, ["1", "2"], False, True), 3: (40, ["2"], True, True), 4: (0, [], False, False)}


def test_odd_texts(spark):
    docs = [r for r in odd_texts() if r[0] not in (13, 14)]
    items = [(1, PASSAGE), (2, "日本語 text")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(contamination(frame(spark, docs), benchmark)) == plain(docs, items)
    long = contamination(frame(spark, odd_texts()), benchmark).where("doc_id = 14").first()
    assert (long["n_words"], long["n_hit"], long["longest"]) == (60_001, 0, 0)
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in contamination(frame(spark, docs), nothing).collect()} == {0}
    assert contamination(frame(spark, []), benchmark).count() == 0


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.integers(1, 3), max_size=30), max_size=5), pattern=st.lists(st.integers(1, 3), min_size=1, max_size=6))
def test_suffix_array_finds_all_places(texts, pattern):
    array = SuffixArray([np.array(t, np.uint64) for t in texts], 6)
    padded = np.zeros((1, 6), np.uint64)
    padded[0, : len(pattern)] = pattern
    _, at = array.find(padded, np.array([len(pattern)]))
    wanted = [
        int(array.starts[t]) + i for t, text in enumerate(texts) for i in range(len(text)) if text[i : i + len(pattern)] == pattern
    ]
    assert sorted(at.tolist()) == wanted
