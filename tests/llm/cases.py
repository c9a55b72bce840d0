"""Small corpora with the cases every operator must stand, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, row_key string, class int, block string, key double, bands string"

PASSAGE = " ".join(f"shared{i}" for i in range(40))


def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, one word, ties, repeated rows, equal ids, a long text."""
    long = " ".join(f"w{i % 9973} x{i}" for i in range(30_000))
    return [
        (None, "a null id with a text of its own and some more words to fill a line"), (None, None),
        (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one"), (10, "two words"),
        (11, "the same row twice, with a line that is long enough to compare"),
        (11, "the same row twice, with a line that is long enough to compare"),
        (12, "an id of two texts, this one first"), (12, "an id of two texts, that one then"),
        (13, long), (14, long + " end"), (15, "!!! ... 123"), (-3, "Ünïcode wörds, “quotes” and 日本語 text\nline two"),
        (16, PASSAGE), (17, "before " + PASSAGE + " behind"), (18, PASSAGE + " " + PASSAGE),
        (2**62, "x" * 50_000),
        # Words and lines of 1,024 characters on which polynomials modulo 2^64 agree, whatever their base.
        (20, twin("ab")), (21, twin("ba")), (22, " ".join([twin("ab")] * 30)), (23, " ".join([twin("ba")] * 30)),
    ]


def twin(letters: str) -> str:
    """1,024 of the two letters, chosen by the parity of the bits in the place's number."""
    return "".join(letters[i.bit_count() % 2] for i in range(1024))


def random_texts(seed: int, n: int = 60) -> list[tuple]:
    """(doc_id, text): texts over a small vocabulary, many of them edited copies of others, some with shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{i}" for i in range(300)]
    texts: list[list[str]] = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
        else:
            words = rng.choices(vocabulary, k=rng.randrange(1, 120))
        if rng.random() < 0.2:
            words += PASSAGE.split()[: rng.randrange(10, 40)]
        texts.append(words)
    ids = rng.sample(range(1000, 1000 + 10 * n), n)
    breaks = [" ", " ", " ", " ", "\n", "  ", "\t"]
    return [(i, "".join(w + rng.choice(breaks) for w in words)) for i, words in zip(ids, texts)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The rows with further columns, whose names operators might use themselves."""
    wide = [(i, t, "en" if n % 3 else None, f"k{n}", n, None, 1.5, "b") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, SCHEMA).repartition(3, "key", "class")


def shingles(text: str | None, size: int = 5) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(rows: list[tuple], percent: int = 85) -> list[int]:
    """For each row the number of the first row that links reach."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def without_repeats(rows: list[tuple], span: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, result = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            if window in seen:
                gone.update(range(i, i + span))
            seen.add(window)
        result[key] = len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)
    return result


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or a == b


def without_lines(rows: list[tuple], least: int = 16) -> dict[int, tuple[int, int, str]]:
    seen: list[str] = []
    result = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n") if text else []
        kept = []
        for line in lines:
            if line.strip(" \t\v\f\r"):
                gone = any(
                    line == other or min(len(line), len(other)) >= least and one_edit(line, other) for other in seen
                )
                seen.append(line)
                if gone:
                    continue
            kept.append(line)
        result[key] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return result
