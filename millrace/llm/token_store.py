"""Token ids as directly addressable codes (DACs) in binary shard files.

An id is cut into chunks of CHUNK bits, lowest first. Level k holds the k-th chunk of each id that has one, as bytes, and a
bitmap that says which of them go on in level k + 1. A rank directory holds, for every BLOCK bits of the bitmap, the number
of set bits before, so the place of an id's next chunk is one lookup and one population count away: any token is read without
decoding its neighbours.

Layout of a shard, all little-endian:
  8 bytes magic, u64 tokens, u64 documents, u64 levels, u64 kind of the ids (0: whole numbers, 1: strings),
  a bitmap of the documents whose id is null, padded to 8 bytes,
  the ids: i64 each, or (documents + 1) u64 starts and the UTF-8 bytes of all (null: 0, or nothing),
  (documents + 1) u64 starts of the documents' token ids within the shard,
  for each level: u64 entries, the chunk bytes; but for the last level: the bitmap, padded to whole blocks, and the directory
  of u64 ranks, one for each block.

Documents are sorted by id over all shards (by range partition, then within each). A shard is written under a temporary name
and renamed, so a task that runs again leaves one whole file. The manifest names the files of finished tasks, and only these
are read; a folder that holds shards already is refused. Null texts count as empty and get the end id alone. Documents with a
null id come first; ids that are no whole numbers are kept as strings and sorted as such; repeated rows are separate
documents. An empty table gives no files.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from .common import fresh_path, kept, map_arrow, staged, text_of

MAGIC = b"DACSHRD2"
CHUNK, BLOCK = 8, 512
#: A shard is closed when it has this many ids: 16 MB of a small vocabulary, and some times that while it is packed.
SHARD_TOKENS = 8_000_000
#: Units remembered by a worker, at most.
MEMO = 1_300_000
#: ASCII signs that make one pre-token after letters; an apostrophe may begin another one.
SIGNS = string.punctuation.replace("'", "")
#: Cuts a text before each space that comes before something else than white space, for texts where others come before white
#: space or the end. Elsewhere line feeds begin units, too.
UNIT = re.compile(r" (?=\S)").split


class OddSpaces(Exception):
    """A unit that begins with white space: the text can't be cut at every space."""


class Units(dict):
    """The ids of units that stand after `before`, as bytes and without those of `before` if it is a line feed.

    It has two generations: what is asked for in the old one moves to the young one, the rest goes in time.
    """

    def __init__(self, encoder: Encoder, before: str) -> None:
        self.old: dict[str, bytes] = {}
        self.encoder, self.before, self.mark = encoder, before, "\u0120" if before == " " else ""

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self._make(unit)
        if len(self) > MEMO // 2:
            self.old = dict(self)
            self.clear()
        self[unit] = found
        return found

    def _make(self, unit: str) -> bytes:
        encoder = self.encoder
        if unit[:1] == "\n":  # a line's first unit
            return encoder.newline + encoder.leading._make(unit[1:])
        if not unit or unit[0].isspace():
            raise OddSpaces
        if unit.isalpha():  # one pre-token
            shown = unit if unit.isascii() else unit.encode().decode("latin-1").translate(BYTE_SIGNS)
            return array("I", [t.id for t in encoder.one_piece(self.mark + shown)]).tobytes()
        letters = unit.rstrip(SIGNS)
        if letters != unit and letters.isalpha():
            return self[letters] + encoder.signs(unit[len(letters) :])
        if "\n" in unit and unit.split() == (parts := unit.split("\n")):
            return self[parts[0]] + b"".join(encoder.newline + encoder.leading[p] for p in parts[1:])
        return encoder.plain(self.before + unit)[len(encoder.newline) if self.before == "\n" else 0 :]


#: A byte-level vocabulary shows bytes as characters: printable Latin-1 as itself, the others from U+0100 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """A byte-level tokenizer of the tokenizers library with a memory of units.

    A space before a character that isn't white space always begins a pre-token, and so does a line feed after one, so a
    text's ids are those of its units, cut before these, one after the other. Within a unit, signs after letters are a
    pre-token. Each part goes through the tokenizer when it is first met. A text that holds one of the tokenizer's added
    tokens, which it finds before it cuts, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.one_piece = self.tokenizer.model.tokenize  # looked up once, as each look-up of the model makes an object
        self.newline = self.plain("\n")
        self.spaced, self.leading = Units(self, " "), Units(self, "\n")
        self.signs = lru_cache(10_000)(self.plain)

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return np.frombuffer(self.plain(text), dtype=np.uint32)
        try:
            head, *units = text.replace("\n", " \n").split(" ")
            rest = b"".join(map(self.spaced.__getitem__, units))
        except OddSpaces:
            head, *units = UNIT(text)
            rest = b"".join(map(self.spaced.__getitem__, units))
        first = self.leading[head] if head.isalpha() else self.plain(head)
        return np.frombuffer(first + rest, dtype=np.uint32)


def encoder(path: str) -> Encoder:
    held = kept.get("tokens")
    if held is None or held.path != path:
        held = kept["tokens"] = Encoder(path)
    return held


def _pack_ids(doc_ids: list[int | str | None]) -> tuple[int, bytes]:
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool), bitorder="little").tobytes()
    nulls += bytes(-len(nulls) % 8)
    if not any(isinstance(d, str) for d in doc_ids):
        return 0, nulls + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
    names = [(d or "").encode() for d in doc_ids]
    return 1, nulls + np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype("<u8").tobytes() + b"".join(names)


def _read_ids(data: bytes, docs: int, kind: int, at: int) -> tuple[list[int | str | None], int]:
    """The ids that begin at a place, and where they end."""
    size = -(-docs // 64) * 8
    nulls = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=docs, bitorder="little").astype(bool)
    at += size
    if kind == 0:
        ids, at = np.frombuffer(data, "<i8", docs, at).tolist(), at + 8 * docs
    else:
        starts, at = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64), at + 8 * (docs + 1)
        ids = [data[at + a : at + b].decode() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        at += int(starts[-1])
    return [None if n else d for d, n in zip(ids, nulls.tolist())], at


def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | str | None]) -> bytes:
    """A shard of documents with these numbers of token ids and these token ids, one after the other."""
    levels = max(1, -(-int(ids.max(initial=0)).bit_length() // CHUNK))
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    kind, names = _pack_ids(doc_ids)
    parts = [MAGIC, np.array([len(ids), len(lengths), levels, kind], dtype="<u8").tobytes(), names, starts.tobytes()]
    for level in range(levels):
        parts += [np.array([len(ids)], dtype="<u8").tobytes(), (ids & 0xFF).astype(np.uint8).tobytes()]
        ids = ids >> CHUNK
        if level < levels - 1:
            more = ids > 0
            bits = np.zeros(-(-len(ids) // BLOCK) * BLOCK, dtype=bool)
            bits[: len(ids)] = more
            counts = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
            parts += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()]
            ids = ids[more]
    return b"".join(parts)


class Shard:
    """Reads a packed shard."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.data = data
        n, docs, levels, kind = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        self.doc_ids, at = _read_ids(data, docs, kind, 40)
        self.n_tokens, self.starts, at = n, np.frombuffer(data, "<u8", docs + 1, at), at + 8 * (docs + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for level in range(levels):
            m = int(np.frombuffer(data, "<u8", 1, at)[0])
            chunks, at, blocks = np.frombuffer(data, np.uint8, m, at + 8), at + 8 + m, -(-m // BLOCK)
            if level == levels - 1:
                self.levels.append((chunks, None, None))
            else:
                self.levels.append((chunks, np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at), np.frombuffer(data, "<u8", blocks, at + blocks * BLOCK // 8)))
                at += blocks * (BLOCK // 8 + 8)

    def token(self, i: int) -> int:
        """The i-th id, by one rank lookup for each level after the first."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK * level
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block, bit = divmod(i, BLOCK)
            inside = int.from_bytes(bitmap[block * BLOCK // 8 : (block + 1) * BLOCK // 8].tobytes(), "little")
            i = int(ranks[block]) + (inside & (1 << bit) - 1).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_tokens, dtype=np.uint32)
        where: np.ndarray | slice = slice(None)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(CHUNK * level)
            if bitmap is not None:
                more = np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little")).astype(np.int32)
                where = more if level == 0 else where[more]
        return out

    def document(self, k: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(int(self.starts[k]), int(self.starts[k + 1]))], dtype=np.uint32)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def _holds_shards(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.dac")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _put(folder: str, name: str, data: bytes) -> None:
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, f"{root}/{name}")


def _whole(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest: shard (names sort as the documents do), documents, tokens."""
    from pyspark import TaskContext

    if _holds_shards(docs.sparkSession, folder):
        raise FileExistsError(f"{folder} holds token shards already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, count, held = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        kind = np.uint16 if max(codec.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else np.uint32
        end = np.array([end_id], dtype=kind)
        ids: list[np.ndarray] = []
        keys: list[int | str | None] = []

        def close() -> pa.RecordBatch:
            nonlocal count, held
            name = f"part-{part:07d}-{count:07d}.dac"
            _put(folder, name, pack(np.concatenate(ids), np.array([len(x) for x in ids]), keys))
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64())], ["shard", "documents", "tokens"])
            ids.clear(), keys.clear()
            count, held = count + 1, 0
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(np.concatenate([codec.encode(text.as_py()).astype(kind), end]))
                keys.append(key)
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield close()
        if keys:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "long" if _whole(docs.schema[id_col].dataType) else "string"
    base = docs.select(F.col(id_col).cast(kind).alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash deals a repeated id over several ranges
    ranged = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(map_arrow(ranged, run, "shard string, documents long, tokens long", "tokens"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shard files in folder that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f.read())
                ids, starts = shard.ids().astype("<u4"), shard.starts.astype(np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                names = pa.array(shard.doc_ids, pa.int64() if id_type == "long" else pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    shards = manifest.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    return map_arrow(shards.repartition(parts, "shard"), run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes docs as token shards and returns, from the files, doc_id, start, n_tokens and ids_crc32 of each document."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    kind = "long" if _whole(docs.schema[columns.get("id_col", "doc_id")].dataType) else "string"
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id, **columns), folder, kind)
