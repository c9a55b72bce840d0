import pytest
from cases import components, frame, odd_texts, one_edit, random_texts, without_lines, without_repeats
from hypothesis import given, settings
from hypothesis import strategies as st

from talkloom.llm.graph import connected_components
from talkloom.llm.lines import remove_lines
from talkloom.llm.minhash import near_duplicates
from talkloom.llm.substrings import remove_repeats


@pytest.mark.parametrize(("block_bytes", "block_sets"), [(1 << 20, 1024), (600, 1024), (1 << 20, 2)])
def test_near_duplicates_like_all_pairs(spark, block_bytes, block_sets):
    rows = random_texts(3, 80)
    near = near_duplicates(frame(spark, rows), block_bytes=block_bytes, block_sets=block_sets)
    found = {r["doc_id"]: r for r in near.collect()}
    root = components(rows)
    least: dict = {}
    for (key, _), r in zip(rows, root):
        least[r] = min(key, least.get(r, key))
    assert {k: r["component_id"] for k, r in found.items()} == {key: least[r] for (key, _), r in zip(rows, root)}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())
    assert len(set(root)) < len(rows)


def test_near_duplicates_of_odd_texts(spark):
    rows = odd_texts()
    found = near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    of = lambda key: [r for r in found if r["doc_id"] == key]
    for key in (5, 6, 7):  # no words: no links
        assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in of(key)] == [(0, key, True)]
    assert [r["component_id"] for r in of(9)] == [8] and not of(9)[0]["kept"]
    assert [r["kept"] for r in of(11)] == [True, True]
    assert of(14)[0]["component_id"] == 13
    assert all(r["kept"] and r["component_id"] is None for r in of(None))
    assert near_duplicates(frame(spark, [])).count() == 0


def test_substrings_like_a_set_of_windows(spark):
    rows = random_texts(4, 80)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(frame(spark, rows)).collect()}
    assert found == without_repeats(rows)
    assert sum(n for _, n, _ in found.values()) > 0


def test_substrings_of_odd_texts(spark):
    rows = odd_texts()
    found = remove_repeats(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    of = lambda key: [r for r in found if r["doc_id"] == key]
    plain = without_repeats([r for r in rows if r[0] not in (None, 11, 12)])
    for key, wanted in plain.items():
        assert [(r["n_words"], r["n_removed"], r["kept"]) for r in of(key)] == [wanted]
    assert of(5)[0]["kept"] == "" and of(18)[0]["n_removed"] == 80
    assert remove_repeats(frame(spark, [])).count() == 0


def test_lines_of_one_template(spark):
    """All lines share their coarse keys; numbers written twice differ in two places at least."""
    line = "2024-01-01 00:00:00 INFO worker {0:05d}{0:05d} has taken the next of the tasks that were waiting in its queue".format
    rows = [(i, "\n".join(line(n) for n in range(100 * i, 100 * i + 100))) for i in range(200)]
    rows += [(1000, line(7)), (1001, line(8).replace("INFO", "INFOS")), (1002, line(9).replace("next", "text"))]
    found = {r["doc_id"]: r["n_removed"] for r in remove_lines(frame(spark, rows)).collect()}
    assert {k for k, n in found.items() if n} == {1000, 1001, 1002}


def test_lines_like_all_pairs(spark):
    base = ["a line that many documents hold", "another one of them, with more in it", "short", "", "ünïcode líne of wörds 日本"]
    edits = [lambda s: s, lambda s: s[1:], lambda s: s + "x", lambda s: s[:7] + "q" + s[8:], lambda s: s[:-1] + "zz"]
    rows = [(n, "\n".join(e(b) for b in base)) for n, e in enumerate(edits * 2)] + [(50 + n, t) for n, t in random_texts(5, 40)]
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in remove_lines(frame(spark, rows)).collect()}
    assert found == without_lines(rows)


def test_short_lines_go_as_copies_only(spark):
    rows = [(1, "Read more\n}\n \t\n\na text of its own, first"), (2, "Read more\nRead moro\n}\n \t\n"), (3, "Read more\n)"), (4, "}\n}")]
    found = {r["doc_id"]: (r["n_compared"], r["kept"]) for r in remove_lines(frame(spark, rows)).collect()}
    assert found == {1: (3, rows[0][1]), 2: (3, "Read moro\n \t\n"), 3: (2, ")"), 4: (2, "")}
    found = {r["doc_id"]: r["kept"] for r in remove_lines(frame(spark, rows), least_chars=1).collect()}
    assert found == {i: t for i, (_, _, t) in without_lines(rows, 1).items()} and found[2] == " \t\n"


def test_lines_of_odd_texts(spark):
    rows = odd_texts()
    found = remove_lines(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    of = lambda key: [r for r in found if r["doc_id"] == key]
    assert [(r["n_lines"], r["kept"]) for r in of(5) + of(6)] == [(0, ""), (0, "")]
    assert sorted(r["n_removed"] for r in of(11)) == [0, 1]
    assert {r["rest"]["row_key"] for r in found} == {f"k{n}" for n in range(len(rows))}
    plain = without_lines([r for r in rows if r[0] is not None and r[0] not in (11, 12)])
    assert all((r["n_lines"], r["n_removed"], r["kept"]) == plain[r["doc_id"]] for r in found if r["doc_id"] in plain)
    assert remove_lines(frame(spark, [])).count() == 0
    assert remove_lines(frame(spark, rows).select("doc_id", "text")).count() == len(rows)


@settings(max_examples=200, deadline=None)
@given(a=st.text("ab", max_size=8), b=st.text("ab", max_size=8))
def test_one_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    assert one_edit(a, b) == (row[-1] <= 1)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    wanted = {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert found == wanted
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
