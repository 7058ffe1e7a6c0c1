import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_store as op
from millrace.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_file())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return op.Encoder(tokenizer_file())


PIECES = ["word", "Word", " ", "  ", "\n", "\t", "\r\n", "é", "naïve", "123", "4", ".", ",", "!?", "'s", "'ll", "don't", " ", "\x1c", "\x85", "日本", "𝄞", "<|endoftext|>", "_", "a.b", "　"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_ids_are_the_tokenizers(codec, plain, text):
    assert codec.encode(text).tolist() == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(codec, plain, text):
    assert codec.encode(text).tolist() == plain(text)


def test_memory_ages(plain, prose, monkeypatch):
    monkeypatch.setattr(op, "MEMO", 20)
    codec = op.Encoder(tokenizer_file())
    for seed in range(4):
        text = prose(200, seed)
        assert codec.encode(text).tolist() == plain(text)
    assert len(codec.spaced) <= 11


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**31), max_size=40), max_size=8))
def test_shards_round_trip(documents):
    flat = np.array([i for d in documents for i in d], dtype=np.uint32)
    shard = op.Shard(op.pack(flat, np.array([len(d) for d in documents], dtype=np.int64), [None, *range(len(documents) - 1)][: len(documents)]))
    assert shard.ids().tolist() == flat.tolist()
    assert [shard.token(i) for i in range(len(flat))] == flat.tolist()
    assert [shard.document(k).tolist() for k in range(len(documents))] == documents


def test_random_access_over_blocks():
    ids = np.random.default_rng(0).integers(0, 60_000, 3000)
    ids[::3] %= 200
    shard = op.Shard(op.pack(ids, np.array([3000]), [1]))
    assert [shard.token(i) for i in range(3000)] == ids.tolist()
    with pytest.raises(IndexError):
        shard.token(3000)
    with pytest.raises(ValueError):
        op.Shard(b"something else")


def expect(rows, plain):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(t or "") + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_files(make, plain, edge_rows, monkeypatch):
    rows = [r for r in edge_rows if r[0] is not None and r[0] != 4] + [(None, "no id"), (-5, "below")]
    monkeypatch.setattr(op, "SHARD_TOKENS", 100)
    got = sorted((tuple(r) for r in op.token_output(make(rows, extra=True), tokenizer_file(), 2).collect()), key=lambda r: r[1])
    assert got == expect(rows, plain)


def test_repeated_ids(make, plain):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (0, "z")]
    got = op.token_output(make(rows), tokenizer_file(), 2).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in got) == sorted((r[0], r[3]) for r in expect(rows, plain))
    assert sorted(r["start"] for r in got)[0] == 0


def test_empty(make):
    assert op.token_output(make([]), tokenizer_file(), 2).count() == 0


def test_added_tokens(make):
    """Against the tokenizer as it comes, which finds added tokens in texts; later documents start where it says, too."""
    unaltered = Tokenizer.from_file(tokenizer_file())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "a <|endoftext| > b", "plain words", "<|endoftext|> \n", "<|ENDOFTEXT|>"]
    want = expect(list(enumerate(texts)), lambda text: unaltered.encode(text, add_special_tokens=False).ids)
    assert sorted(tuple(r) for r in op.token_output(make(list(enumerate(texts))), tokenizer_file(), 2).collect()) == want
    assert op.Encoder(tokenizer_file()).encode(texts[0]).tolist() == [64, 220, 50256, 275]


def test_plain_text_between_added_tokens(codec, plain):
    """Finding added tokens in one document leaves the memory of units as it was."""
    for text in ("a<|endoftext|>b c", "new unitsx here", "d<|endoftext|>", "b c", "b c new unitsx <|endoftext|>"):
        assert codec.encode(text).tolist() == plain(text)


def test_a_folder_with_shards_is_refused(make, spark, tmp_path):
    folder = (tmp_path / "shards").as_uri()
    assert op.token_output(make([(i, "a b") for i in range(30)]), tokenizer_file(), 2, folder).count() == 30
    with pytest.raises(FileExistsError):
        op.token_output(make([(1, "x")]), tokenizer_file(), 2, folder)


def test_only_files_of_the_manifest_are_read(make, spark, tmp_path, plain):
    folder = (tmp_path / "shards").as_uri()
    manifest = op.write_tokens(make([(1, "a b"), (2, "c")]), folder, tokenizer_file(), 2)
    (tmp_path / "shards" / "part-9999999-0000000.dac").write_bytes(op.pack(np.array([5], dtype=np.uint32), np.array([1]), [7]))
    got = sorted(tuple(r) for r in op.read_tokens(manifest, folder).collect())
    assert got == expect([(1, "a b"), (2, "c")], plain)


def test_extreme_and_string_ids(make, spark, plain):
    rows = [(-(2**63), "least"), (2**63 - 1, "most"), (None, "none"), (0, None)]
    got = sorted((tuple(r) for r in op.token_output(make(rows), tokenizer_file(), 2).collect()), key=lambda r: r[1])
    assert got == expect(rows, plain)
    named = [("b", "one two"), ("", "empty name"), (None, "x"), ("é", "y")]
    got = op.token_output(spark.createDataFrame(named, "doc_id string, text string"), tokenizer_file(), 2).collect()
    order = sorted(named, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [d for d, _ in order]
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {d: len(plain(t)) + 1 for d, t in named}
