import re

from cases import frame, odd_texts, random_texts
from pyspark.sql import functions as F

from talkloom.llm.private import KINDS, LABELERS, estimate, personal_data, written

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        twice = int(c) * (1 + i % 2)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()}


ODD = [
    "a@b.c_d@e.f.g@x.y-z", "@a.b a@ b@c d@e. f@g.h.", "ünï x.y+z%1@ho-st.co.uk, “q@r.st”", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4",
    "300.1.2.3.4 1.2.3 1..2.3.4 999999999999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1111-1 41111111111111111111",
    "5  4111111111111111 7 4111111111111111", "4111111111111112 4111 1111  1111 1111", "+1 (555) 555-0100 +1+22 333 444 55 +0 1 2 3",
    "+12345678901234567890 +1 2 3 4 5 6 7 8 ) ", "\u0001a@b.c\u0001 \u0002d@e.f", "日本 +49 30 123456 日本 10.0.0.1 終", "9" * 3000, "1." * 3000,
    "a." * 3000 + "@" + "b." * 3000 + "c", "+" * 500 + "1 2 3 4 5 6 7 8", " ".join(f"u{i}@h{i}.example.org" for i in range(700)),
]


def test_base_spans_like_the_patterns(spark):
    rows = [*odd_texts(), *random_texts(9, 20), *((3000 + n, t) for n, t in enumerate(ODD))]
    found = personal_data(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t in rows}
    for r in found:
        if r["doc_id"] not in (None, 11, 12):
            wanted = plain(texts[r["doc_id"]])
            assert {k: [tuple(s) for s in r[f"base_{k}"]] for k in KINDS} == wanted, texts[r["doc_id"]]
    assert personal_data(frame(spark, [])).count() == 0


def test_cards_of_single_digits(spark):
    """No two digits of the text stand side by side."""
    card = "4111111111111111"
    texts = ["-".join(card), " ".join(card), f"pay with {' '.join(card)}, please", "-".join("371449635398431"), "1-2 3"]
    found = {r["doc_id"]: r for r in personal_data(frame(spark, list(enumerate(texts)))).collect()}
    for n, text in enumerate(texts):
        assert [tuple(s) for s in found[n]["base_card"]] == plain(text)["card"]
    assert [len(found[n]["base_card"]) for n in range(5)] == [1, 1, 1, 0, 0]


def test_written(spark):
    row = spark.range(1).select(
        written({
            "email": F.expr("array(named_struct('start', 9, 'end', 12), named_struct('start', 1, 'end', 3))"),
            "ip": F.expr("cast(array() as array<struct<start:int,end:int>>)"),
            "card": F.expr("array(named_struct('start', 4, 'end', 5))"),
        }).alias("w")
    )
    assert row.first()["w"] == "email:1:3,email:9:12,card:4:5"


def test_reliabilities_are_recovered(spark):
    """Votes of labelers with known error rates: the estimates come near, and the useless one gets no weight."""
    right = {"pattern": (0.9, 0.1), "gazetteer": (0.8, 0.2), "context": (0.85, 0.3), "checksum": (0.5, 0.5)}
    rows = []
    for code in range(16):
        votes = [code >> i & 1 for i in range(4)]
        n = 0
        for side, share in ((0, 0.4), (1, 0.6)):
            p = share
            for name, v in zip(LABELERS, votes):
                p *= right[name][side] if v else 1 - right[name][side]
            n += p
        rows.append(("phone", *(2 if v else 1 for v in votes), round(100_000 * n)))
    patterns = spark.createDataFrame(rows, "kind string, pattern int, gazetteer int, context int, checksum int, n bigint")
    found = estimate(patterns, rounds=60)["phone"]
    assert abs(found["prior"] - 0.4) < 0.05
    for name, (true, false) in right.items():
        assert abs(found[f"{name}_true"] - true) < 0.08 and abs(found[f"{name}_false"] - false) < 0.08


def test_candidates_with_cues_are_added(spark):
    rows = [(i, f"mail us: user{i}@host.org or phone +1 (555) 555-01{i:02d} now") for i in range(40)]
    rows += [(100 + i, f"please call 555-555-01{i:02d} today, mail john.doe{i} [at] host [dot] org please") for i in range(20)]
    found = {r["doc_id"]: r for r in personal_data(frame(spark, rows)).collect()}
    assert all(len(found[i]["base_email"]) == len(found[i]["base_phone"]) == 1 for i in range(40))
    for i in range(20):
        text = rows[40 + i][1]
        assert not found[100 + i]["base_email"]
        spans = [text[s["start"] : s["end"]] for s in found[100 + i]["added_email"]]
        assert spans in ([], [f"john.doe{i} [at] host [dot] org"])
    assert not any(found[i][f"added_{k}"] for i in range(40) for k in KINDS)


def test_no_python_in_the_plan(spark):
    df = personal_data(frame(spark, odd_texts()))
    assert not re.search("Python|Pandas|Arrow|MapIn", df._jdf.queryExecution().toString())
