"""English stop words and the pattern that removes them."""

from __future__ import annotations

import re
from collections.abc import Iterable

# The widely used English stop-word list (pronouns, auxiliaries, particles, contractions).
ENGLISH = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't
""".split()


def stopwords(add: Iterable[str] = (), remove: Iterable[str] = (), base: Iterable[str] = ENGLISH) -> list[str]:
    return sorted((set(base) | set(add)) - set(remove))


def _alternatives(words: Iterable[str] | None) -> str:
    """The words grouped by first letter, so that a regex engine which tries alternatives in turn tries about twenty
    per word instead of all."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(set(stopwords() if words is None else words)):
        by_letter.setdefault(word[0], []).append(re.escape(word[1:]))
    return "|".join(f"{re.escape(letter)}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())


def stopword_pattern(words: Iterable[str] | None = None) -> str:
    """Pattern of stop words inside a text. `(?U)` makes `\\b` Unicode-aware."""
    return rf"(?U)\b(?:{_alternatives(words)})\b"


def whole_stopword_pattern(words: Iterable[str] | None = None) -> str:
    """Pattern of a token that is a stop word."""
    return rf"^(?:{_alternatives(words)})$"
