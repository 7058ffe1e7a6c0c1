"""BPE encoding and decoding by forced boundaries.

A merge makes a token of the vocabulary, and a token holds each pair of neighbours of its spelling. So two neighbours that no
token holds next to each other are never joined: between them is a cut, whatever stands around. A text is cut where its
tokenizer cuts it anyway and then at each such pair; the fragments are encoded one by one, each new one once, and their ids
follow one another. Only the last fragment of a word bears the end-of-word mark.

Fragments go through the tokenizer's own merges, and a text's words (between ASCII white space, which neither composes nor
joins with anything) are remembered with their ids. A word that holds one of the tokenizer's added tokens is encoded whole.
Of tokenizers that keep white space in their pieces a whole text is one word. Decoding looks ids up in the table of tokens.

Null texts count as empty and have no ids. Bytes that are no UTF-8 count as U+FFFD. Repeated rows get equal rows; other columns
are left alone; an empty table gives an empty result. Memory is bounded by MEMO words, and by BATCH_BYTES of texts or the longest one with its ids.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, map_arrow, text_of

#: Words (and as many fragments) remembered by a worker, at most, and the longest one that is.
MEMO, LONGEST = 400_000, 64
#: White space of any kind.
SPACE = re.compile(r"\s")
#: The greatest code point of an alphabet whose pairs stand in a table.
TABLE = 2_048
#: Bytes of texts that are encoded together, and ids after which a batch of results is closed.
BATCH_BYTES, BATCH_IDS = 4_000_000, 2_000_000


class Codec:
    """A tokenizer of the tokenizers library with a BPE model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(self.tokenizer.to_str())["model"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["dropout"]:
            raise ValueError("not a plain BPE tokenizer")
        mark = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        options = {k: model[k] for k in ("unk_token", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
        inner = models.BPE(model["vocab"], merges, **options) if mark else self.tokenizer.model
        ends = self.tokenizer.model  # looked up once, as each look-up makes an object
        #: Neighbours within tokens, with the mark and without it.
        self.joined = {pair for token in model["vocab"] for spelling in {token, token.removesuffix(mark) if mark else token} for pair in pairwise(spelling)}
        self.width = 1 + max((ord(c) for token in model["vocab"] for c in token), default=0)
        if self.width <= TABLE:  # the alphabet is small, as that of bytes is
            self.table = np.zeros((self.width + 1, self.width + 1), dtype=bool)
            self.table[tuple(np.array([[ord(a), ord(b)] for a, b in self.joined], dtype=np.int64).reshape(-1, 2).T)] = True
        self.tokenize = {False: inner.tokenize, True: ends.tokenize}
        self.fragments_known: dict[bool, dict[str, tuple[int, ...]]] = {False: {}, True: {}}
        self.words: dict[bytes, tuple[int, ...]] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.normal = normal.normalize_str if normal else str
        self.cut = cut.pre_tokenize_str if cut else (lambda s: [(s, (0, len(s)))] if s else [])
        self.by_word = [p for p, _ in self.cut(self.normal("a \t\n\x0b\x0c\rb"))] == [p for w in "ab" for p, _ in self.cut(self.normal(w))]
        size = max([*model["vocab"].values(), *self.tokenizer.get_added_tokens_decoder()], default=-1) + 1
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.plain_decoding = self.tokenizer.decoder is None

    def cuts(self, text: str) -> np.ndarray:
        """The places in pieces, put one after the other, before which there is a forced boundary."""
        if self.width > TABLE:
            return np.array([i for i, pair in enumerate(pairwise(text), 1) if pair not in self.joined], dtype=np.int64)
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), self.width)
        return np.flatnonzero(~self.table[codes[:-1], codes[1:]]) + 1

    def fragments(self, pieces: list[str]) -> tuple[list[str], list[bool]]:
        """The fragments of pieces, and whether each is the last one of its piece."""
        text = "".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        bounds = np.union1d(self.cuts(text), ends)
        places = bounds.tolist()
        return [text[a:b] for a, b in pairwise([0, *places])], np.isin(bounds, ends).tolist()

    def _ids(self, fragment: str, last: bool) -> tuple[int, ...]:
        known = self.fragments_known[last]
        found = known.get(fragment)
        if found is None:
            found = tuple(t.id for t in self.tokenize[last](fragment))
            if len(fragment) <= LONGEST:
                if len(known) >= MEMO:
                    known.clear()
                known[fragment] = found
        return found

    def _learn(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of words, which are made ready and cut all at once."""
        texts = [w.decode("utf-8", "replace") for w in words]
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        plain = [i for i in range(len(texts)) if i not in whole]
        joined = [i for i in plain if not SPACE.search(texts[i])] if self.by_word else []  # spaces of other kinds would move the starts of words
        ready = self.normal("\n".join(texts[i] for i in joined))
        starts = [0, *(i + 1 for i, c in enumerate(ready) if c == " ")]
        if len(starts) != len(joined):  # of one text that is one word
            joined = []
        cut_together: dict[int, list[str]] = {i: [] for i in joined}
        if joined:
            word = 0
            starts.append(len(ready) + 1)
            for p, (at, _) in self.cut(ready):
                while starts[word + 1] <= at:
                    word += 1
                cut_together[joined[word]].append(p)
        pieces = [cut_together[i] if i in cut_together else [p for p, _ in self.cut(self.normal(texts[i]))] for i in plain]
        found = {words[i]: tuple(self.tokenizer.encode(texts[i], add_special_tokens=False).ids) for i in whole}
        if any(pieces):
            fragments, lasts = self.fragments([p for ps in pieces for p in ps])
            each = zip(fragments, lasts)
            for i, ps in zip(plain, pieces):
                ids: list[int] = []
                for _ in ps:
                    last = False
                    while not last:
                        fragment, last = next(each)
                        ids += self._ids(fragment, last)
                found[words[i]] = tuple(ids)
        else:
            found |= {words[i]: () for i in plain}
        return found

    def encode_all(self, texts: list[bytes]) -> Iterator[array]:
        """The ids of each text, given as UTF-8; words that are new in these texts are learnt together."""
        if self.by_word:  # bytes are cut at ASCII white space alone
            split = [t.split() for t in texts]
        else:
            split = [[t] for t in texts]
        here = set(chain.from_iterable(split))
        new = self._learn(list(here.difference(self.words)))
        if len(self.words) + len(new) > MEMO:  # what these texts don't hold goes
            self.words = {w: self.words[w] for w in here if w in self.words} if len(here) < MEMO else {}
            new |= self._learn([w for w in here if w not in self.words and w not in new])
        long = [w for w in new if len(w) > LONGEST]
        self.words |= new
        for words in split:
            yield array("i", chain.from_iterable(map(self.words.__getitem__, words)))
        for w in long:
            del self.words[w]

    def encode(self, data: bytes) -> array:
        return next(iter(list(self.encode_all([data]))))

    def decode(self, ids: array | list[int]) -> str:
        """The text of ids, as the library's decode(ids, skip_special_tokens=False)."""
        if self.plain_decoding:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


def codec(path: str) -> Codec:
    held = kept.get("bpe")
    if held is None or held.path != path:
        held = kept["bpe"] = Codec(path)
    return held


def _results(held: Codec, names: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    first, ids, ends, decoded = 0, array("i"), [0], []
    for row, mine in enumerate(held.encode_all(texts)):
        ids += mine
        ends.append(len(ids))
        decoded.append(held.decode(mine))
        if len(ids) >= BATCH_IDS or row + 1 == len(texts):
            flat = pa.array(np.frombuffer(ids, dtype=np.int32)) if ids else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([names.slice(first, len(decoded)), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
            first, ids, ends, decoded = row + 1, array("i"), [0], []


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids and decoded (what the ids decode to) of each row; texts go once through a worker and are not moved.

    tokenizer: the path of a tokenizer file, the same on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = codec(tokenizer)
        for batch in batches:
            first, texts, size = 0, [], 0
            for row in range(batch.num_rows):
                texts.append(batch.column(1)[row].as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= BATCH_BYTES or row + 1 == batch.num_rows:
                    yield from _results(held, batch.column(0).slice(first, len(texts)), texts)
                    first, texts, size = row + 1, [], 0

    base = docs.select(docs[id_col].alias("doc_id"), text_of(docs[text_col]).alias("text"))
    return map_arrow(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string", "bpe")
