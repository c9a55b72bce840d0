"""Default English lemmas: a small table of irregular forms and plural rules, both replaceable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Irregular forms, token -> lemma.
IRREGULAR = {
    "am": "be", "are": "be", "been": "be", "children": "child", "did": "do", "does": "do", "done": "do",
    "feet": "foot", "found": "find", "gave": "give", "given": "give", "gone": "go", "got": "get", "had": "have",
    "has": "have", "held": "hold", "kept": "keep", "knew": "know", "known": "know", "knives": "knife",
    "leaves": "leaf", "lives": "life", "made": "make", "men": "man", "mice": "mouse", "people": "person",
    "ran": "run", "said": "say", "saw": "see", "seen": "see", "taken": "take", "taught": "teach", "teeth": "tooth",
    "thought": "think", "told": "tell", "took": "take", "was": "be", "went": "go", "were": "be", "women": "woman",
    "written": "write", "wrote": "write",
}


def irregular_lemmas(spark: SparkSession) -> DataFrame:
    """Lemma table `(token, lemma)`; any table of that shape can take its place."""
    return spark.createDataFrame(list(IRREGULAR.items()), "token string, lemma string")


def rule_lemma(token: Column | str) -> Column:
    """Lemma of a token that the table does not list: English plurals, everything else unchanged."""
    t = F.col(token) if isinstance(token, str) else token
    return (
        F.when(~t.endswith("s"), t)
        .when(t.rlike("[a-z]{2}ies$"), F.regexp_replace(t, "ies$", "y"))
        .when(t.rlike("[a-z](?:ss|sh|ch|x|z)es$"), F.regexp_replace(t, "es$", ""))
        .when(t.rlike("[a-z][a-rt-z]s$") & ~t.rlike("(?:us|is)$"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def lemmas_in_row(tokens: Column | str) -> Column:
    """Default lemmas of a token list as an expression: the irregular forms are few enough for a map literal."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(irregular, t), rule_lemma(t)))
