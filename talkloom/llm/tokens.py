"""Token ids of whole texts, by a public tokenizer that is passed as a file."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

# Encoded words kept by a task; the store is emptied when it is full, which changes no result.
WORDS_KEPT = 1 << 20
# Id put behind each document.
END_ID = 1


class _Kept(dict):
    """Ids by part, encoded when a part is first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: bytes) -> bytes:
        ids = self.encode(part)
        self[part] = ids
        return ids


class WordEncoder:
    """Ids of texts as little-endian integers, encoded word by word.

    If the tokenizer drops white space and never joins across it, as word-end BPE does, the ids of a text are those of its
    space-separated parts in order, so each different part is encoded once and looked up afterwards. Texts are split at
    ASCII white space only; other white space stays inside a part, where the library drops it. If moreover it lower-cases
    and separates letters from marks, a word of Latin letters, with a mark behind it or not, goes straight to the
    library's model. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(*vocabulary.values(), end_id) < 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._end = self._bytes([end_id])
        self._marks = {mark: self._encode(mark) for mark in (b",", b".")}
        self._by_word = self._pieces("Ab, ab\n ab.") == ["ab", ",", "ab", "ab", "."] and not any(
            token.content.isalpha() for token in self._tokenizer.get_added_tokens_decoder().values()
        )
        # What the model sees of each Latin letter: it reads bytes as characters.
        self._seen = {c: "".join(self._pieces(chr(c))) for c in range(256) if self._by_word and chr(c).isalpha()}
        self._kept = _Kept(self._part)

    def _pieces(self, text: str) -> list[str]:
        normalizer, splitter = self._tokenizer.normalizer, self._tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [piece for piece, _ in splitter.pre_tokenize_str(text)] if splitter else [text]

    def _encode(self, text: bytes) -> bytes:
        return self._bytes(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def _part(self, part: bytes) -> bytes:
        mark = part[-1:] if part[-1:] in self._marks else b""
        word = part[:-1] if mark else part
        if word.isalpha():  # of bytes: ASCII letters
            low = word.lower()
            if low == part:
                return self._bytes([t.id for t in self._tokenizer.model.tokenize(low.decode())])
        else:
            text = word.decode()
            if not text.isalpha() or max(text) > "\xff":  # Latin letters have no other normal form
                return self._encode(part)
            text = text.lower()
            low = text.encode()
            if low == part:
                return self._bytes([t.id for t in self._tokenizer.model.tokenize(text.translate(self._seen))])
        return self._kept[low] + self._marks[mark] if mark else self._kept[low]

    def forget(self) -> None:
        """Empty the store, which a worker would keep between its tasks."""
        self._kept.clear()

    def __call__(self, text: bytes | None) -> bytes:
        """Ids of `text`, then the end id; None counts as empty."""
        if not self._by_word:
            return self._encode(text or b"") + self._end
        if len(self._kept) > WORDS_KEPT:
            self._kept.clear()
        return b"".join(map(self._kept.__getitem__, (text or b"").split())) + self._end


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, end_id)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def widened(ids: bytes, dtype: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype).astype("<u4").tobytes()
