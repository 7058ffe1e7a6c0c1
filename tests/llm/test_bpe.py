import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe as op
from millrace.llm import queries
from millrace.llm.queries import tokenizer_file, word_tokenizer_file


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(word_tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return op.Codec(word_tokenizer_file())


PIECES = ["word", "Word", "WORLD's", " ", "  ", "\n", "\t", "\r\n", "\x0b", "é", "é", "́", "̈", "naïve", "İ", "ΣΑΣ", "ß", "123", "4", "½", "Ⅷ", "²", ".", ",", "!?", "'s", "'LL", "don't", " ", "\x1c", "\x85", " ", "日本", "한", "각", "𝄞", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "a</w>", "_", "a.b", "　", "fffi", "ﬁ", "\x00", "�", "aaaaaaaaaaaa", "qzxjqzxj"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_ids_and_text_are_the_librarys(codec, plain, text):
    expected = plain.encode(text, add_special_tokens=False).ids
    got = codec.encode(text.encode())
    assert got.tolist() == expected
    assert codec.decode(got) == plain.decode(expected, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40))
def test_any_text(codec, plain, text):
    assert codec.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_every_code_point_between_letters(codec, plain):
    for at in range(0, 0x110000, 997):
        text = "".join(f"a{chr(c)}b" for c in range(at, min(at + 997, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, at


def test_fragments_are_cut_where_no_token_goes_on(codec):
    vocabulary = set(codec.tokenizer.get_vocab())
    for piece in ("qzxjqzxj", "hello", "æĹ¥æľ¬èªŀ"):
        parts, last = codec.fragments([piece, "next"])
        assert "".join(parts) == piece + "next"
        parts = parts[: last.index(True) + 1]
        assert "".join(parts) == piece
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1] + b[0] in token for token in vocabulary)
    assert not codec.fragments(["qzxjqzxj"])[1][0] and not codec.fragments(["æĹ¥æľ¬èªŀ"])[1][0]


def test_other_tokenizers():
    """One that keeps white space in its pieces, has no word ends and has a decoder."""
    t, codec = Tokenizer.from_file(tokenizer_file()), op.Codec(tokenizer_file())
    assert not codec.by_word
    for text in ("", "a  b\n\nc", " Hello, world's qzxj 123", "日本語 é\t", "x <|endoftext|> y"):
        ids = t.encode(text, add_special_tokens=False).ids
        assert codec.encode(text.encode()).tolist() == ids
        assert codec.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_memory_is_bounded(plain, prose, monkeypatch):
    monkeypatch.setattr(op, "MEMO", 400)
    small = op.Codec(word_tokenizer_file())
    for seed in range(6):
        texts = [prose(120, 10 * seed + i) for i in range(5)]
        got = [x.tolist() for x in small.encode_all([t.encode() for t in texts])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.words) <= 600 and all(len(f) <= 400 for f in small.fragments_known.values())
    small.encode(b"z" * 1000)
    assert b"z" * 1000 not in small.words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), max_size=5))
def test_texts_that_are_encoded_together(codec, plain, texts):
    assert [x.tolist() for x in codec.encode_all([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_against_the_library(spark, make, edge_rows, plain, tmp_path):
    rows = [*edge_rows, (20, "<|endoftext|> then <|startoftext|>x"), (21, "é" * 3000), (22, "A" * 200_000)]
    make(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def expected(doc_id, text):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        shown = [" ".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False)]
        return (doc_id, len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in shown])

    got = queries.op13_bpe_round_trip(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_clashing_columns_and_empty_tables(make, plain):
    docs = make([(1, "some words"), (None, None)], extra=True)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in op.encode(docs, word_tokenizer_file()).collect()}
    assert got == {1: (plain.encode("some words", add_special_tokens=False).ids, "some</w> words</w>"), None: ([], "")}
    assert op.encode(make([]), word_tokenizer_file()).count() == 0


def test_words_with_spaces_of_other_kinds_keep_their_own_ids(plain):
    """One such space hides an end of a word, another looks like one: the numbers agree, the words don't."""
    words = ["x", "\u2028", "y", "a\u2028b"]
    found = op.Codec(word_tokenizer_file())._learn([w.encode() for w in words])
    assert {w: list(found[w.encode()]) for w in words} == {w: plain.encode(w, add_special_tokens=False).ids for w in words}
