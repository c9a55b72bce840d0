import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from cases import odd_texts

from talkloom.llm.collocations import _ids, _join, _judge, _pack, _unpack, collocations

SCHEMA = "doc_id string, text string, lang string, block int, words string, places string, n double, id int"


def brute(rows, least, longest=5, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    counts = {g: n for g, n in counts.items() if n >= least}
    held = {
        (lang, g[i : i + m]) for (lang, g), n in counts.items() for m in range(2, len(g)) for i in range(len(g) - m + 1)
        if counts[lang, g[i : i + m]] == n
    }
    result = {}
    for (lang, g), a in counts.items():
        if len(g) > 1 and (lang, g) not in held:
            cuts = [(1000 * a * total[lang] // (counts[lang, g[:k]] * counts[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            result.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    return [
        (lang, rank + 1, phrase.decode(), -a, l, r, total[lang], -score)
        for lang, scored in sorted(result.items()) for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top])
    ]


def found(spark, rows, least, **how):
    wide = [(str(i), t, lang, 1, "w", None, 0.5, i) for i, (t, lang) in enumerate(rows)]
    ranks = collocations(spark.createDataFrame(wide, SCHEMA).repartition(3), least, **how)
    assert ranks.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, ranks.collect()))


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a", "ünï", "\x00odd", "l'été", "x" * 40]
    fixed = ["new york city", "out of the blue", "a b a b a b a", "one two three four five six"]
    breaks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", " \x1c "]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(60))]
        rows.append(("".join(p + rng.choice(breaks) for p in parts), rng.choice(["en", "de", None, "und", ""])))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1) + [(t, "en") for _, t in odd_texts()] + [(None, None), ("", "xx"), ("...", "fr"), ("only once here", "fr")]
    for least in (3, 12):
        expected = brute(rows, least)
        assert len(expected) > 20
        assert found(spark, rows, least) == expected
        # Blocks of a few pieces, so that counts come from many of them.
        assert found(spark, rows, least, block_words=50) == expected


def test_fewer_words_and_first_ranks(spark):
    rows = corpus(2)
    assert found(spark, rows, 5, longest=3, top=4) == brute(rows, 5, 3, 4)
    assert found(spark, rows, 5, longest=2) == brute(rows, 5, 2)


def test_copies_and_a_piece_longer_than_a_segment(spark):
    rows = [("same words again and again", "en")] * 300 + [("so long " * 200_000, "en")]
    assert found(spark, rows, 100) == brute(rows, 100)


def test_tables_without_phrases(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [("a b c", "en"), ("d e f", None)], 2) == []


def test_join_keeps_places():
    ids = np.array([70, -1, 90, 50])
    longer, prefixes, suffixes, counts = _join(np.array([0, 2, 0, 2, -1, 3, 1, 3, 3], np.int32), ids)
    pairs = {(int(p), int(s)): int(n) for p, s, n in zip(prefixes, suffixes, counts)}
    assert pairs == {(70, 90): 2, (90, 70): 1, (50, 50): 1}
    at = {i: (int(prefixes[c]), int(suffixes[c])) for i, c in enumerate(longer) if c >= 0}
    assert at == {0: (70, 90), 1: (90, 70), 2: (70, 90), 7: (50, 50)}


def pack(x, kind="<i4"):
    return np.array(x, kind).tobytes()


def test_bucket_adds_counts():
    group = pd.DataFrame({
        "bucket": [3, 3], "block": [10, 11], "prefixes": [pack([1, 1, 2]), pack([2, 1])], "suffixes": [pack([5, 6, 5]), pack([5, 7])],
        "counts": [pack([4, 1, 6]), pack([4, 10])],
    })
    *blocks, phrases = _judge(group, 10, "<i4")
    assert [np.frombuffer(x, k).tolist() for x, k in zip(phrases[5:], ("<i4", "<i4", "<i8"))] == [[1, 2], [7, 5], [10, 10]]
    assert [(b[1], np.frombuffer(b[3], "<i4").tolist()) for b in blocks] == [(10, [1]), (11, [1, 0])]
    # Eight bytes an id give the same.
    wide = group.assign(**{c: [pack(np.frombuffer(x, "<i4"), "<i8") for x in group[c]] for c in ("prefixes", "suffixes")})
    assert [b[:4] for b in _judge(wide, 10, "<i8")] == [b[:4] for b in [*blocks, phrases]]


def test_bucket_adds_counts_of_words():
    words = [b"en\xffa\xfede\xffa", b"de\xffa"]
    group = pd.DataFrame({"bucket": [0, 0], "block": [1, 2], "words": words, "counts": [pack([9, 5]), pack([5])]})
    *blocks, found = _judge(group, 10, "word")
    assert found[4] == b"de\xffa" and np.frombuffer(found[7], "<i8").tolist() == [10]
    assert [(b[1], np.unpackbits(np.frombuffer(b[2], np.uint8))[:2].tolist()) for b in blocks] == [(1, [0, 1]), (2, [1, 0])]


def test_ids_of_a_block():
    keys = np.array([1, 2, 1 << 63, (1 << 63) + 5], np.uint64)
    marks = [{"bucket": 1, "bits": np.packbits([False, True]).tobytes(), "ranks": pack([4])}]
    assert _ids(keys, marks, np.array([0, 100]), "<i4").tolist() == [-1, -1, -1, 104]
    assert _ids(keys, None, np.array([0, 100]), "<i8").tolist() == [-1] * 4


def test_numbers_take_few_bytes():
    rng = np.random.default_rng(5)
    for kind in ("<i4", "<i8"):
        for values in (rng.zipf(1.5, 5000) % 30_000, np.full(3, -1), np.zeros(0)):
            values = values.astype(kind)
            packed = _pack(values)
            assert _unpack(packed, kind).tolist() == values.tolist()
            assert len(packed) < 2.2 * len(values) + 40
