"""Personal data by weak supervision, with DataFrame functions only.

Strict patterns give the base spans. Looser patterns give further candidates. Labelers (pattern, gazetteer, context,
checksum) vote on all of them; expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is, without labels, and what each pattern means. These estimates train a span classifier on the candidates' own
features, which decides on the candidates that aren't base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.tables import row_key
from talkloom.runtime import cut

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "checksum")
# Votes: for, against, none.
YES, NO, NONE = 2, 1, 0
ROUNDS = 12
# A candidate that isn't a base span is added at this probability.
ACCEPTED = 0.9
# Characters of context on either side.
LEFT, RIGHT = 32, 8

# Patterns begin only where a leftmost match can, and repeat without backtracking, so that they take linear time.
_STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Written-out addresses, full IPv6 addresses, shorter cards, and numbers in groups without a country code.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]++){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][ -])3[47](?:[ -]?[0-9]){13}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
# A text without a match of these has none of the above.
_TRIGGERS = {"email": r"@|[\[({]at[\])}]", "ip": r"[0-9][.:]|[A-Fa-f]:", "card": "[0-9][ -]?[0-9]", "phone": "[0-9]"}
_CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|whatsapp|telefon|tél",
}
_AGAINST = r"version|isbn|order|invoice|serial|part no|article"
# Top-level domains, country calling codes and card issuers.
_GAZETTEER = {
    "email": r"(?:\.|dot[\])}] ?)(?:com|org|net|edu|gov|info|biz|io|de|fr|es|it|nl|uk|us|ca|au|ch|at|be|pt|br|mx|ru|cn|jp|in)$",
    "ip": r"^(?!0+\.|0*127\.|0*(?:22[4-9]|2[345][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6[045])",
    "phone": r"^\+ ?(?:1|7|2[07]|2[1-6][0-9]|29[0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]"
    r"|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9])",
}
_MARK = "\u0001"
_CHUNK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(sizes: Column) -> Column:
    """Sum of the sizes before each one, in two levels: sums of chunks, and of the sizes since the chunk's beginning."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    upto = lambda n: F.sequence(F.lit(0), n)
    chunks = F.transform(
        upto(((F.size(sizes) - 1) / _CHUNK).cast("int")), lambda c: total(F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK)))
    )
    before = _let(chunks, lambda t: F.transform(upto(F.size(t) - 1), lambda c: total(F.slice(t, F.lit(1), c))))
    return _let(before, lambda b: F.transform(upto(F.size(sizes) - 1), lambda i: (
        F.get(b, (i / _CHUNK).cast("int"))
        + total(F.slice(sizes, (i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))
    )))


def _spans(text: Column, pattern: str, trigger: str) -> Column:
    """Leftmost matches that don't overlap: start, end (code points), value and what stands around."""
    marked = F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}")

    def matches(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.char_length(p))
        return _let(sizes, lambda s: _let(_running(s), lambda before: F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(
                F.get(before, i).alias("start"), (F.get(before, i) + F.get(s, i)).alias("end"),
                F.get(parts, i).alias("value"), F.right(F.get(parts, i - 1), F.lit(LEFT)).alias("left"),
                F.left(F.get(parts, i + 1), F.lit(RIGHT)).alias("right"),
            )
        )))

    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    found = _let(F.split(marked, _MARK), lambda parts: F.when(F.size(parts) > 1, matches(parts)).otherwise(none))
    return F.when(F.regexp_like(text, F.lit(trigger)), found).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when((F.char_length(digits) - i) % 2 == 1, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + doubled(i))
    return total % 10 == 0


def _checks(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return _let(_digits(value), lambda d: F.char_length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(NONE)


def _judged(kind: str, span: Column, base: bool) -> Column:
    """A candidate with its votes and the features of the span classifier."""
    value, left = span["value"], F.lower(span["left"])
    digits = F.char_length(_digits(value))
    if kind == "card":
        checksum = _vote(_luhn(_digits(value)), ~_luhn(_digits(value)))
    elif kind == "phone":
        checksum = _vote(digits.between(10, 13), ~digits.between(7, 15))
    elif kind == "ip":
        checksum = _vote(F.lit(base) | value.contains(":"), F.lit(False))
    else:
        checksum = _vote(F.char_length(value).between(6, 64), F.char_length(value) > 254)
    known = F.regexp_like(F.lower(value), F.lit(_GAZETTEER[kind]))
    side = lambda c: F.when(c == "", "edge").when(F.regexp_like(c, F.lit(r"\s")), "blank").when(
        F.regexp_like(c, F.lit(r"\p{L}|[0-9]")), "word").otherwise("mark")
    return F.struct(
        F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(base).alias("base"),
        F.lit(YES if base else NONE).alias("pattern"),
        _vote(known, ~known & F.lit(kind != "phone") | value.startswith("+") & ~known).alias("gazetteer"),
        _vote(F.regexp_like(left, F.lit(_CONTEXT[kind])), F.regexp_like(left, F.lit(_AGAINST))).alias("context"),
        checksum.alias("checksum"),
        F.array(
            F.concat(F.lit("length "), F.least(F.floor(F.char_length(value) / 4), F.lit(12)).cast("string")),
            F.concat(F.lit("digits "), F.round(4 * digits / F.greatest(F.char_length(value), F.lit(1))).cast("string")),
            F.concat(F.lit("before "), side(F.right(span["left"], F.lit(1)))),
            F.concat(F.lit("behind "), side(F.left(span["right"], F.lit(1)))),
            F.concat(F.lit("plus "), value.startswith("+").cast("string")),
            F.concat(F.lit("cue "), F.regexp_like(left, F.lit(_CONTEXT[kind])).cast("string")),
        ).alias("features"),
    )


def _candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row_key, and the base and other candidates of each document."""
    plain = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), _MARK, "\u0002")
    found = docs.select(
        docs[doc_id].cast("bigint").alias("doc_id"), row_key(docs, doc_id, text).alias("row_key"), plain.alias("text")
    )
    found = found.select(
        "doc_id", "row_key", *(_spans(F.col("text"), _STRICT[k], _TRIGGERS[k]).alias(f"base_{k}") for k in KINDS),
        *(_spans(F.col("text"), _LOOSE[k], _TRIGGERS[k]).alias(f"loose_{k}") for k in KINDS),
    )
    found = cut(found, "private-spans")
    all_base = F.concat(*(F.col(f"base_{k}") for k in KINDS))

    def base(kind: str) -> Column:
        passed = F.filter(f"base_{kind}", lambda s: _checks(kind, s["value"]))
        return F.transform(passed, lambda s: _judged(kind, s, True)).alias(f"base_{kind}")

    def loose(kind: str) -> Column:
        meet = lambda s: F.exists(all_base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        apart = F.filter(f"loose_{kind}", lambda s: ~meet(s))
        return F.transform(apart, lambda s: _judged(kind, s, False)).alias(f"loose_{kind}")

    judged = [*map(base, KINDS), *map(loose, KINDS)]
    return cut(found.select("doc_id", "row_key", *judged), "private-candidates")


def _log_odds(row: dict, vote: dict[str, Column]) -> Column:
    """Log odds of a vote pattern under a kind's estimates."""
    total = F.lit(math.log(row["prior"] / (1 - row["prior"])))
    for name in LABELERS:
        yes, no = row[f"{name}_true"], row[f"{name}_false"]
        total = total + F.when(vote[name] == YES, math.log(yes / no)).when(
            vote[name] == NO, math.log((1 - yes) / (1 - no))
        ).otherwise(0.0)
    return total


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict[str, dict]:
    """Reliability of each labeler by kind: how often it votes yes, if it votes, on true and on false spans.

    `patterns` has kind, a vote per labeler and n, one row per pattern (81 of a kind at most); each round sums it up.
    """
    votes = {name: F.col(name) for name in LABELERS}
    yes = sum((F.when(v == YES, 1).otherwise(0) for v in votes.values()), F.lit(0))
    cast = sum((F.when(v != NONE, 1).otherwise(0) for v in votes.values()), F.lit(0))
    posterior: Column = (yes + 0.5) / (cast + 1)
    found: dict[str, dict] = {}
    for _ in range(rounds):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(p * n).alias("t"), F.sum((1 - p) * n).alias("f")]
        for name, v in votes.items():
            for side, weight in (("true", p * n), ("false", (1 - p) * n)):
                sums.append(F.sum(F.when(v == YES, weight).otherwise(0)).alias(f"{name}_{side}_yes"))
                sums.append(F.sum(F.when(v != NONE, weight).otherwise(0)).alias(f"{name}_{side}_cast"))
        for row in patterns.withColumn("p", posterior).groupBy("kind").agg(*sums).collect():
            held = {"prior": (row["t"] + 1) / (row["t"] + row["f"] + 2)}
            for name in LABELERS:
                # Counted as if each labeler had been right on two spans and wrong on one.
                for side, lead in (("true", 2), ("false", 1)):
                    held[f"{name}_{side}"] = (row[f"{name}_{side}_yes"] + lead) / (row[f"{name}_{side}_cast"] + 3)
            found[row["kind"]] = held
        posterior = F.lit(0.5)
        for kind, held in found.items():
            posterior = F.when(F.col("kind") == kind, _probability(_log_odds(held, votes))).otherwise(posterior)
    return found


def train(spans: DataFrame, estimates: dict[str, dict]) -> dict[str, float]:
    """Log odds of each kind and of each of its feature values, weighted by what the labelers' votes mean."""
    p = F.lit(0.5)
    for kind, held in estimates.items():
        p = F.when(F.col("kind") == kind, _probability(_log_odds(held, {n: F.col(n) for n in LABELERS}))).otherwise(p)
    weighted = spans.select("kind", p.alias("p"), F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"))
    sums = weighted.groupBy("kind", "feature").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f")).collect()
    totals = {row["kind"]: row for row in sums if row["feature"] == ""}  # a few dozen feature values of each kind
    odds = {}
    for row in sums:
        whole = totals[row["kind"]]
        if row["feature"]:
            ratio = (row["t"] + 1) / (whole["t"] + 2) / ((row["f"] + 1) / (whole["f"] + 2))
        else:
            ratio = (row["t"] + 1) / (row["f"] + 1)
        odds[f"{row['kind']} {row['feature']}"] = math.log(ratio)
    return odds


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in each whole text, one row per document.

    Columns: doc_id, row_key (hash of doc_id and text), base_<kind> and added_<kind> for e-mail addresses, IP addresses,
    payment cards and phone numbers: arrays of start and end in code points, in order. Base spans are leftmost matches that
    don't overlap and pass the kind's check; added ones overlap no base match and were accepted by the classifier.

    A null text counts as empty and has no spans. Null ids and repeated rows are kept. Without candidates in the whole
    table nothing is learned and nothing added; an empty table gives no rows. Other columns are not read.
    """
    found = _candidates(docs, doc_id, text)
    both = F.concat(*(F.col(f"base_{k}") for k in KINDS), *(F.col(f"loose_{k}") for k in KINDS))
    spans = found.select(F.explode(both).alias("span")).select("span.*")
    patterns = cut(spans.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")), "private-patterns")
    odds = train(spans, estimate(patterns))
    table = F.create_map(*(F.lit(x) for pair in odds.items() for x in pair)) if odds else None

    def accepted(span: Column) -> Column:
        if table is None:
            return F.lit(False)
        of = lambda name: F.coalesce(F.try_element_at(table, F.concat(span["kind"], F.lit(" "), name)), F.lit(0.0))
        total = F.aggregate(span["features"], of(F.lit("")), lambda a, name: a + of(name))
        return _probability(total) >= ACCEPTED

    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    return found.select(
        "doc_id", "row_key", *(F.transform(f"base_{k}", place).alias(f"base_{k}") for k in KINDS),
        *(F.transform(F.filter(f"loose_{k}", accepted), place).alias(f"added_{k}") for k in KINDS),
    )


def written(kinds: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""
    def parts(kind: str) -> Column:
        text = lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
        return F.transform(F.array_sort(kinds[kind]), text)

    return F.array_join(F.concat(*map(parts, kinds)), ",")
