"""Token ids in sorted-string-table shards, keyed by document.

File (integers little-endian unless said otherwise):
    data blocks   entries ``varint shared | varint own | varint value bytes |
                  own key bytes | value``, where ``shared`` leading bytes are
                  those of the key before; a block starts with shared = 0 and
                  closes at BLOCK_BYTES.
    index         for each block its last key (u16 length, bytes), u64 offset, u32 length
    Bloom filter  bits, k hashes by double hashing of xxh3-128
    footer        6 u64 (index offset, index bytes, Bloom offset, Bloom bytes,
                  documents, ids), u32 bytes an id, u32 k, 8 bytes of magic

Keys: 8 bytes, the signed id with its sign bit flipped, big-endian, so byte
order is id order; a null id has the empty key and stands first. Values: the
ids, 2 bytes each if the vocabulary allows, else 4.

Shards hold consecutive ranges of ids in the order of their names, so reading
them in turn gives the corpus in ascending order. Each attempt of a task writes
a file of its own, and the row it returns names it: what a lost or doubled
attempt leaves in the folder is in no row, and no file is renamed or replaced.

Defined results
    null or empty text: only the end id. Repeated ids: an entry each, ordered
    by text. Extra columns are not read. Empty table: no shard.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small_batches

MAGIC = b"QRYSST01"
FOOTER = struct.Struct("<6Q2I8s")
BLOCK_BYTES = 32 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
SHARD_BYTES = 64 << 20
#: Units held at most, and characters encoded at a time.
UNITS, BATCH_CHARS = 400_000, 1_000_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, m: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % 2**64 % m for i in range(k)]


class Writer:
    """Appends entries in key order; finish() writes index, filter and footer."""

    def __init__(self, sink, width: int, block_bytes: int = BLOCK_BYTES):
        self.sink, self.width, self.block_bytes = sink, width, block_bytes
        self.block, self.last, self.offset = bytearray(), b"", 0
        self.index, self.keys, self.ids = [], [], 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.block:
            self.sink.write(bytes(self.block))
            self.index.append((self.last, self.offset, len(self.block)))
            self.offset += len(self.block)
            self.block = bytearray()

    def finish(self) -> None:
        self._close()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        m = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bits = np.zeros(m, bool)
        for key in self.keys:
            bits[_bloom_bits(key, m, BLOOM_HASHES)] = True
        bloom = np.packbits(bits, bitorder="little").tobytes()
        self.sink.write(index + bloom + FOOTER.pack(self.offset, len(index), self.offset + len(index), len(bloom), len(self.keys), self.ids, self.width, BLOOM_HASHES, MAGIC))


class Reader:
    """Reads a shard: footer and index at once, blocks when asked for."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOTER.size)
        self.index_at, index_bytes, self.bloom_at, self.bloom_bytes, self.documents, self.ids, self.width, self.hashes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        data = self._at(self.index_at, index_bytes)
        self.last_keys, self.blocks, k = [], [], 0
        while k < len(data):
            n = struct.unpack_from("<H", data, k)[0]
            self.last_keys.append(data[k + 2 : k + 2 + n])
            self.blocks.append(struct.unpack_from("<QI", data, k + 2 + n))
            k += 14 + n
        self.bloom = None

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data, k, key = self._at(*self.blocks[block]), 0, b""
        while k < len(data):
            shared, k = _read_varint(data, k)
            own, k = _read_varint(data, k)
            n, k = _read_varint(data, k)
            key = key[:shared] + data[k : k + own]
            yield key, data[k + own : k + own + n]
            k += own + n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.blocks)):
            for key, value in self._entries(block):
                yield id_of(key), np.frombuffer(value, f"<u{self.width}")

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first entry of a document: Bloom filter, binary search of the index, one block."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.bloom = self._at(self.bloom_at, self.bloom_bytes)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, 8 * len(self.bloom), self.hashes)):
            return None
        block = bisect_left(self.last_keys, key)
        if block < len(self.blocks):
            for k, value in self._entries(block):
                if k == key:
                    return np.frombuffer(value, f"<u{self.width}")
        return None


def open_shard(path: str) -> Reader:
    store, name = fs.FileSystem.from_uri(path)
    return Reader(store.open_input_file(name))


#: Fixed value: how a byte-level tokenizer cuts text before its merges.
_UNIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LETTER = regex.compile(r"\p{L}")
#: The characters that stand for bytes in such a vocabulary: printable ones for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _ragged(values: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``at`` of a ragged table (flat values, length of each row), as such a table."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[at]
    place = np.arange(int(n.sum())) + np.repeat(starts[at] - (np.cumsum(n) - n), n)
    return values[place], n


def _strings(column: pa.StringArray) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()


def _tails(texts: pa.StringArray, heads: pa.StringArray) -> pa.StringArray:
    """What follows ``heads`` in ``texts``."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = ends[1:] - ends[:-1] - pc.binary_length(heads).to_numpy()
    upto = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(upto[-1]) + np.repeat(ends[1:] - upto[1:], size)]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def _spelled(unit: str) -> str:
    """The characters that stand for the unit's bytes."""
    word = unit[1:]
    if unit[:1] == " " and word.isascii() and word.isalpha():
        return _BYTE[32] + word
    return "".join([_BYTE[b] for b in unit.encode()])


#: Characters after a word that make a unit of their own.
_STOPS = ".,;:!?"


class Units:
    """The ids of the units met: strings in one Arrow array and ids in one numpy
    array, some 30 bytes a unit. Beyond UNITS of them the half met longest ago goes."""

    def __init__(self, model, dtype: str):
        self.model, self.names, self.ids = model, pa.array([], pa.string()), np.empty(0, dtype)
        self.lengths, self.used, self.round = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def __call__(self, wanted: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """A ragged table of the ids of each unit."""
        self.round += 1
        found = pc.index_in(wanted, value_set=self.names)
        new = wanted.filter(found.is_null())
        made = [[t.id for t in self.model.tokenize(_spelled(unit))] for unit in _strings(new)]
        known = len(self.names)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = np.arange(known, known + len(new))
        self.names = pa.concat_arrays([self.names, new])
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int64, len(made))])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in made for i in ids), self.ids.dtype)])
        self.used = np.concatenate([self.used, np.zeros(len(made), np.int64)])
        self.used[at] = self.round
        out = _ragged(self.ids, self.lengths, at)
        if len(self.names) > UNITS:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: UNITS // 2])
            (self.ids, self.lengths), self.names, self.used = _ragged(self.ids, self.lengths, keep), self.names.take(pa.array(keep)), self.used[keep]
        return out


class Encoder:
    """Texts' ids as bytes, with the end id.

    A byte-level tokenizer cuts a text into units and merges inside them, so
    its model is asked once for each unit while it is held. Where every space
    stands between two characters that are not white space, units never reach
    over a space, so a batch's texts are split there and each different piece
    is cut once.

    The tokenizer's own cut is compared with the pattern here for every
    character met, beside each kind of neighbour. Texts with a character that
    they take differently, texts with an added token, and all texts of a
    tokenizer of another kind go to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        self.tokenizer_path, self.end_id, self.tokenizer = tokenizer_path, end_id, None

    def load(self) -> Encoder:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.tokenizer_path)
            self.width = 2 if self.tokenizer.get_vocab_size() <= 65536 and self.end_id < 65536 else 4
            self.dtype = f"<u{self.width}"
            made = json.loads(self.tokenizer.to_str())
            cut = made.get("pre_tokenizer") or {}
            self.by_unit = made["model"]["type"] == "BPE" and made.get("normalizer") is None and cut.get("type") == "ByteLevel" and bool(cut.get("use_regex", True)) and not cut.get("add_prefix_space")
            self.added = [t["content"] for t in made.get("added_tokens", [])]
            self.units = Units(self.tokenizer.model, self.dtype)
            self.odd = re.compile(r"^ |\s | \s| $|[\x1c-\x1f\x85]")
            self.rare = re.compile(r"[^\S \n]")
            self.alike: set[str] = set()
            self.unlike: set[str] = set()
        return self

    def _compare(self, characters: set[str]) -> None:
        new = sorted(characters - self.alike - self.unlike)
        for c, letter in zip(new, pc.utf8_is_alpha(pa.array(new, pa.string())).to_pylist()):
            text = f"a{c}a1{c}1!{c}! {c}"
            own = [m.span() for m in _UNIT.finditer(text)]
            same = own == [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] and letter == bool(_LETTER.match(c))
            (self.alike if same else self.unlike).add(c)

    def _spaced(self, text: str) -> bool:
        """Whether every space stands between two characters that are not white space."""
        if self.rare.search(text):
            return not self.odd.search(text)
        return not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ")

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for t in texts]
        return np.concatenate([np.empty(0, self.dtype), *ids]), np.array([len(x) for x in ids], np.int64)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        self.load()
        whole = [k for k, t in enumerate(texts) if t and (not self.by_unit or any(x in t for x in self.added))]
        held = set(whole)
        cut = [k for k, t in enumerate(texts) if t and k not in held]
        split = pc.split_pattern(pa.array([texts[k] if self._spaced(texts[k]) else "" for k in cut], pa.large_string()), " ")
        pieces = split.flatten().dictionary_encode()
        known, opens = pieces.dictionary.cast(pa.string()), split.offsets.to_numpy()[:-1]
        # a text's first piece, or the whole text if it has other spacing, is cut by itself: it follows no space
        first = _strings(pieces.take(pa.array(opens)).cast(pa.string())) if len(opens) else []
        first = [f or texts[k] for k, f in zip(cut, first)]
        self._compare(set().union(*_strings(known), *first))
        if self.unlike:
            strange = [k for k in cut if not self.unlike.isdisjoint(texts[k])]
            if strange:
                odd = set(strange)
                out = self([None if k in odd else t for k, t in enumerate(texts)])
                values, lengths = self._whole([texts[k] for k in strange])
                for k, b, n in zip(strange, np.cumsum(lengths).tolist(), lengths.tolist()):
                    out[k] = values[b - n : b].tobytes() + out[k]
                return out
        # most pieces are letters and then stops: two units, the second perhaps empty; the pattern cuts the others
        stem = pc.utf8_rtrim(known, characters=_STOPS)
        plain = pc.utf8_is_alpha(stem)
        stop = _tails(known.filter(plain), stem.filter(plain))
        found = [*(_UNIT.findall(" " + p) for p in _strings(known.filter(pc.invert(plain)))), *map(_UNIT.findall, first)]
        n = len(stop)
        units = pa.concat_arrays([pc.binary_join_element_wise("", stem.filter(plain), " "), stop, pa.array([u for f in found for u in f], pa.string())]).dictionary_encode()
        at_unit = units.indices.to_numpy()
        at_unit = np.concatenate([np.stack([at_unit[:n], at_unit[n : 2 * n]], 1).ravel(), at_unit[2 * n :]])
        ids, lengths = _ragged(*self.units(units.dictionary), at_unit)
        # ids of pieces (plain ones, others, first ones), then of texts
        ends = np.concatenate([[0], np.cumsum([2] * n + [len(f) for f in found], dtype=np.int64)])
        lengths = np.diff(np.concatenate([[0], np.cumsum(lengths)])[ends])
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, n + np.cumsum(~is_plain) - 1)
        at = place[pieces.indices.to_numpy()]
        at[opens] = len(known) + np.arange(len(opens))
        ids, lengths = _ragged(ids, lengths, at)
        upto = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy()]
        data, end = ids.tobytes(), self.end_id.to_bytes(self.width, "little")
        out = [end] * len(texts)
        for k, a, b in zip(cut, (upto[:-1] * self.width).tolist(), (upto[1:] * self.width).tolist()):
            out[k] = data[a:b] + end
        values, lengths = self._whole([texts[k] for k in whole])
        for k, b, n in zip(whole, np.cumsum(lengths).tolist(), lengths.tolist()):
            out[k] = values[b - n : b].tobytes() + end
        return out


@functools.cache
def encoder_of(tokenizer_path: str, end_id: int) -> Encoder:
    """One encoder a Python worker, so that its memo serves all the worker's tasks."""
    return Encoder(tokenizer_path, end_id).load()


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, of BATCH_CHARS characters and one text more at most."""
    ids, texts, size = [], [], 0
    for batch in small_batches(batches, 500):
        for i, t in zip(batch.column(0).to_pylist(), _strings(batch.column(1))):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards under ``path``; one row for each: (shard, path, documents, ids, base), base the ids before it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        store, folder = fs.FileSystem.from_uri(path)
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.sst"
        for ids, texts in _by_size(batches):
            if writer is None:
                store.create_dir(folder, recursive=True)
                sink = store.open_output_stream(name)
                encoder = encoder_of(tokenizer_path, end_id)
                writer = Writer(sink, encoder.width)
            for i, value in zip(ids, encoder(texts)):
                writer.add(key_of(i), value)
        if writer is not None:
            writer.finish()
            sink.close()
            base = path[: len(path) - len(folder)] if path.endswith(folder) else ""
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [base + name], "documents": pa.array([len(writer.keys)], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    ordered = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    made = materialize(ordered.mapInArrow(run, "shard int, path string, documents long, ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return made.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of ``write``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, starts, counts, sums = [], [], [], []
                for i, tokens in open_shard(path):
                    ids.append(i)
                    starts.append(start)
                    counts.append(len(tokens))
                    sums.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    start += len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], names=["id", "start", "n_tokens", "ids_crc32"])

    files = shards.select("path", "base", "shard").repartition(max(1, shards.count()), "shard").select("path", "base")
    return files.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", doc_id)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards in the shared folder and reads them back."""
    spark: SparkSession = docs.sparkSession
    return read(write(docs, fresh_path(spark, "tokens"), tokenizer_path, end_id, doc_id, text), doc_id)
