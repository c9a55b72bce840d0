import zlib

import numpy as np
import pytest
from cases import frame, odd_texts, random_texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkloom.llm.packing import SquaresPacker, pack
from talkloom.llm.token_file import EliasFano, fetch, read_token_file, write_token_file
from talkloom.llm.tokens import WordEncoder, default_tokenizer
from talkloom.runtime import scratch_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encode():
    return WordEncoder(default_tokenizer())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


TRICKY = [
    "", "  ", "A b", "J̌ ä K", "<|endoftext|> x<|STARTOFTEXT|>y", "don't we'll. I'M", "İstanbul İ.",
    "日本語 テスト。", "a\x1cb \x85c", "x" * 5000, "1234 5,6.7 ...,", " é", "ﬁ ǅ ß ẞ", "a,,b.,. , .", "Ärger, ÄRGER. ÿ Ÿ",
    "µ ª º", "tab\tline\nfeed\x0bvt", "été. Été, ÉTÉ", "á", "😀 😀.",
]


@pytest.mark.parametrize("text", TRICKY)
def test_words_encode_like_whole_texts(library, encode, text):
    assert np.frombuffer(encode(text.encode()), encode.dtype).tolist() == ids_of(library, text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(" aAbzZéÉñ.,'\n\t ̌12!<|>ßİ日"), max_size=60))
def test_any_text_encodes_like_the_library(library, encode, text):
    assert np.frombuffer(encode(text.encode()), encode.dtype).tolist() == ids_of(library, text)


@settings(max_examples=100, deadline=None)
@given(steps=st.lists(st.integers(0, 10**9), max_size=200), big=st.booleans())
def test_elias_fano_gives_back_its_numbers(steps, big):
    values = np.cumsum(np.array(steps, np.uint64) * np.uint64(10**7 if big else 1)).astype(np.uint64)
    coded = EliasFano.of(values)
    assert coded.decode().tolist() == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()
    if len(values):
        bound = 2 + np.log2(max(int(values[-1]), 1) / len(values) + 1) + 1
        assert 8 * (len(coded.low) + len(coded.high)) <= len(values) * bound + 16


def test_token_file_round_trip(spark, library):
    rows = [*odd_texts(), *random_texts(1)]
    path = scratch_path(spark, "tokens-test")
    write_token_file(frame(spark, rows), path, default_tokenizer(), block_tokens=500)
    found = read_token_file(spark, path).orderBy("start").collect()
    assert len(found) == len(rows)
    order = [-(2**63) if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)
    start = 0
    for r in found:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
    wanted = sorted((str(i), tuple(ids_of(library, t))) for i, t in rows)
    assert sorted((str(r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == wanted
    single = fetch(spark, path, [13, 8, 12, 999_999]).collect()
    assert sorted(r["doc_id"] for r in single) == [8, 12, 12, 13]
    texts = {i: t for i, t in rows}
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == ids_of(library, texts[r["doc_id"]]) for r in single if r["doc_id"] != 12)


def test_token_file_of_nothing(spark):
    path = scratch_path(spark, "tokens-test")
    write_token_file(frame(spark, []), path, default_tokenizer())
    assert read_token_file(spark, path).count() == 0


def test_pieces_hold_every_id_once(spark, library):
    rows = [*odd_texts(), *random_texts(2)]
    pieces = pack(frame(spark, rows), default_tokenizer(), window=64, open_windows=4)
    pieces = pieces.withColumn("crc", F.crc32("ids")).toPandas().sort_values(["sequence_id", "offset"])
    assert all(zlib.crc32(b) == c for b, c in zip(pieces.ids, pieces.crc))
    inside = pieces.groupby("sequence_id")
    assert (inside.length.cumsum() - pieces.length == pieces.offset).all()
    assert (inside.length.sum() <= 64).all() and (inside.length.sum() < 64).sum() <= 3  # one of a partition
    texts: dict = {}
    for r in pieces.sort_values("start").itertuples():
        if r.doc_id not in (11, 12) and r.doc_id == r.doc_id:  # ids of several rows can't be told apart
            have = texts.setdefault(int(r.doc_id), [])
            assert len(have) == r.start and len(r.ids) == 4 * r.length
            have += np.frombuffer(r.ids, "<u4").tolist()
    for key, text in rows:
        if key not in (11, 12, None):
            assert texts[key] == ids_of(library, text)
    assert pieces.length.sum() == sum(len(ids_of(library, t)) for _, t in rows)
    assert pack(frame(spark, []), default_tokenizer()).count() == 0


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_a_piece_goes_where_squares_grow_least(sizes):
    packer = SquaresPacker(window=20, open_windows=1000)
    seen = []
    for n, size in enumerate(sizes):
        rest = size % 20
        if rest:
            before = packer.counts.copy()
            level = packer.level_for(rest)

            def squares(h, counts=before, rest=rest):
                after = counts.copy()
                if h:
                    after[h] -= 1
                if h + rest < 20:
                    after[h + rest] += 1
                return int((after[:20] ** 2).sum())

            options = [h for h in range(20 - rest + 1) if h == 0 or before[h] > 0]
            assert squares(level) == min(map(squares, options))
        seen += packer.add(n, np.full(size, n))
    seen += packer.close()
    assert sum(len(p[3]) for pieces in seen for p in pieces) == sum(sizes)
    assert sum(sum(len(p[3]) for p in pieces) < 20 for pieces in seen) <= 1
