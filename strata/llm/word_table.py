"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Encoding: tasks split the texts before every run of white space, and words before a final run of
stops after an ASCII letter or figure (a byte-level vocabulary never merges across such a place, nor do
its patterns look across it), and number the distinct words of
each *chunk* of documents, ``CHUNK_BYTES`` of text.  A chunk becomes one row: the word numbers by
position, and its distinct words.  The words are then dealt by hash, and the *distinct-word
table* arises in buckets of that hash: a bucket meets every word from all chunks that hold it,
has it encoded once, and answers each chunk with the words' ids.  A join by chunk brings these
back, and the ids are put in place by position.

So what is shuffled is each chunk's distinct words and its numbers, never one row per word of a
text, and nothing is broadcast, however large the table grows.  No group is unbounded: a frequent
word is one entry of a chunk however often it occurs there, and the rows of a bucket go through
one by one; a bucket that would have to remember more than ``TABLE_WORDS`` words starts anew
(those met again are then encoded again, with the same result).

Decoding joins ids to the table of pieces, which has one row per id of the vocabulary, a bound
that doesn't depend on the data.

Special strings of the vocabulary inside a text get their own id, as the tokenizers library does
by default; they hold no white space, so the words hold them whole.

Cases: null and empty texts have no ids; texts of any length are cut into slices for splitting,
and are part of one chunk, which is then larger; equal rows, and rows with equal or null ids, are
rows of their own in the result; other columns are ignored; an empty table gives an empty result.
When decoding, a null list is an empty one, ids outside the vocabulary have no piece, and bytes
that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import materialise, stream_bound, text_bytes

#: Text of one chunk; bounds the memory of a task that splits or puts ids in place.
CHUNK_BYTES = 24 << 20
#: Text that is split at once.
SLICE_BYTES = 4 << 20
#: Words that one bucket of the table has at about, and at most remembers.
BUCKET_WORDS, TABLE_WORDS = 600_000, 2_000_000
MAX_BUCKETS = 4096

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_WHITE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
#: White space other than one space or newline by itself.
_UNUSUAL = re.compile(rb" [ \n]|\n[ \n]|[\t\x0b\x0c\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_PLAIN_CUT = re.compile(rb"[!-~] [!-~]")
_WIDE, _FINE = 240, pa.Codec("zstd", compression_level=6)
_STOPS = re.compile(rb"(?<=[0-9A-Za-z])[.,;:!?]+\Z")
#: First byte of the key of a word that doesn't begin with exactly one space or newline; never part of UTF-8.
_AS_IS = b"\xff"


def _slices(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about ``SLICE_BYTES``, cut before a space between two ASCII characters."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = _PLAIN_CUT.search(text, at + SLICE_BYTES)
        if cut is None:
            break
        yield text[at:cut.start() + 1]
        at = cut.start() + 1
    yield text[at:] if at else text


def split_words(text: bytes) -> list[bytes]:
    """Keys of a text's words: cut before each run of white space.  ``word`` restores a word."""
    if _UNUSUAL.search(text):
        return [x[1:] if x[:1] == b" " and x[1:2] not in (b"", b"\n") else _AS_IS + x
                for x in (s.encode() for s in _BEFORE_WHITE.split(text.decode()))]
    found = text.replace(b"\n", b" \n").split(b" ")
    found[0] = _AS_IS + found[0]
    return found


def parts(key: bytes) -> list[bytes]:
    """A word's key, or the keys of the word and of the stops at its end."""
    found = _STOPS.search(key)
    return [key[:found.start()], _AS_IS + found.group()] if found else [key]


def word(key: bytes) -> str:
    if key[:1] == _AS_IS:
        return key[1:].decode()
    return key.decode() if key[:1] == b"\n" else " " + key.decode()


def _pack(numbers: np.ndarray, data: bytes = b"") -> bytes:
    """Unsigned 32-bit numbers (all first bytes, then all second ones ..., which compresses better) and bytes
    as one compressed value."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() + data
    return len(raw).to_bytes(8, "little") + len(numbers).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(value: bytes) -> tuple[np.ndarray, bytes]:
    size, n = int.from_bytes(value[:8], "little"), int.from_bytes(value[8:16], "little")
    raw = pa.decompress(value[16:], size, "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel(), raw[4 * n:]


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Word numbers, small ones in one byte: a byte from ``_WIDE`` on has the number's high bits, and two more follow
    in a second part.  Numbers too large for that are packed as others."""
    if len(numbers) and numbers.max() >> 16 >= 256 - _WIDE:
        return b"w" + _pack(numbers)
    wide = numbers >= _WIDE
    heads = np.where(wide, _WIDE + (numbers >> 16), numbers).astype(np.uint8)
    tails = np.ascontiguousarray((numbers[wide] & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T)
    raw = heads.tobytes() + tails.tobytes()
    return b"n" + len(raw).to_bytes(8, "little") + len(heads).to_bytes(8, "little") + _FINE.compress(raw, asbytes=True)


def _unpack_numbers(value: bytes) -> np.ndarray:
    if value[:1] == b"w":
        return _unpack(value[1:])[0]
    size, n = int.from_bytes(value[1:9], "little"), int.from_bytes(value[9:17], "little")
    raw = np.frombuffer(pa.decompress(value[17:], size, "zstd", asbytes=True), np.uint8)
    numbers = raw[:n].astype(np.uint32)
    wide = np.flatnonzero(numbers >= _WIDE)
    tails = np.ascontiguousarray(raw[n:].reshape(2, -1).T).view("<u2").ravel()
    numbers[wide] = (numbers[wide] - _WIDE << 16) + tails
    return numbers


def _pack_words(keys: list[bytes]) -> bytes:
    return _pack(np.fromiter(map(len, keys), np.uint32, len(keys)), b"".join(keys))


def _unpack_words(value: bytes) -> list[bytes]:
    lengths, data = _unpack(value)
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class _Numbers(dict):
    """Key -> number, in the order in which keys come."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


def number_words(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk: ``chunk``, ``row_ids`` and ``row_words`` (words of each document),
    ``numbers`` of all words by position, and the distinct ``words`` with ``n_words``: frequent ones first, by powers
    of two, else in their order, so that numbers are small and neighbours alike."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("row_ids", T.ArrayType(id_type)),
        T.StructField("row_words", T.ArrayType(T.LongType())), T.StructField("numbers", T.BinaryType()),
        T.StructField("words", T.BinaryType()), T.StructField("n_words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        index, keys, counts, numbers, size, kind = _Numbers(), [], [], [], 0, None

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate([np.empty(0, np.int32), *numbers])
            finer, split = _Numbers(), [parts(k) for k in index]
            left = np.fromiter((finer[p[0]] for p in split), np.int32, len(split))
            stops = np.fromiter((finer[p[1]] if len(p) > 1 else -1 for p in split), np.int32, len(split))
            both = np.stack([left[flat], stops[flat]], axis=1)
            n_row = np.add.reduceat(np.append(both[:, 1] >= 0, False), np.cumsum([0, *counts[:-1]])) if len(counts) else []
            row_words = [n + int(m) if n else 0 for n, m in zip(counts, n_row)]
            flat, words = both[both >= 0], list(finer)
            often = np.frexp(np.bincount(flat, minlength=len(words)))[1].tolist()
            order = sorted(range(len(words)), key=lambda k: (-often[k], words[k]))
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            flat = place[flat]
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), pa.array([keys], pa.list_(kind)),
                pa.array([row_words], pa.list_(pa.int64())), pa.array([_pack_numbers(flat)], pa.binary()),
                pa.array([_pack_words([words[k] for k in order])], pa.binary()),
                pa.array([len(words)], pa.int64())], schema.names)

        for batch in batches:
            kind, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            off, data, _ = text_bytes(batch.column(1))
            for k, key in enumerate(ids):
                n = 0
                if off[k + 1] > off[k]:
                    for part in _slices(bytes(data[off[k]:off[k + 1]])):
                        found = split_words(part)
                        numbers.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                        n += len(found)
                keys.append(key)
                counts.append(n)
                size += int(off[k + 1] - off[k]) + 64
                if size >= chunk_bytes:
                    yield chunk()
                    made += 1
                    index, keys, counts, numbers, size = _Numbers(), [], [], [], 0
        if keys:
            yield chunk()

    return stream_bound(docs, [id_col, text_col]).mapInArrow(run, schema)


def deal_words(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """The chunks' distinct words with their numbers (as steps), one row per chunk and bucket; a bucket is a
    range of the words' hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = _unpack_words(words.as_py())
                bucket = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) * n_buckets >> 32
                order = np.argsort(bucket, kind="stable")
                found, at = np.unique(bucket[order], return_index=True)
                parts = np.split(order, at[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array(found, pa.int32()), pa.array([chunk] * len(found), pa.int64()),
                    pa.array([_pack(np.diff(p, prepend=0)) for p in parts if len(p)], pa.binary()),
                    pa.array([_pack_words([keys[k] for k in p]) for p in parts if len(p)], pa.binary())],
                    ["bucket", "chunk", "steps", "words"])

    return chunks.select("chunk", "words").mapInArrow(run, "bucket int, chunk long, steps binary, words binary")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def encode_words(dealt: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each distinct word of a bucket encoded once: per chunk and bucket, the words' numbers
    (``steps``), their ``lengths`` in ids and all ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        now, table = None, {}
        for batch in batches:
            sizes, out = [], []
            for bucket, value in zip(batch.column(0).to_pylist(), batch.column(3)):
                if bucket != now or len(table) > TABLE_WORDS:
                    now, table = bucket, {}
                keys = _unpack_words(value.as_py())
                new = [k for k in keys if k not in table]
                for i in range(0, len(new), 10_000):
                    part = new[i:i + 10_000]
                    coded = tokenizer.encode_batch_fast([word(k) for k in part], add_special_tokens=False)
                    table.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in coded)))
                ids = [table[k] for k in keys]
                sizes.append(_pack(np.fromiter(map(len, ids), np.uint32, len(ids)) // 4))
                out.append(_pack(np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sizes, pa.binary()),
                                              pa.array(out, pa.binary())], ["chunk", "steps", "lengths", "ids"])

    return dealt.mapInArrow(run, "chunk long, steps binary, lengths binary, ids binary")


def place_ids(chunks: DataFrame, id_type: T.DataType, id_col: str, decode_path: str | None, text_col: str) -> DataFrame:
    """Documents with their ids: each word number of a chunk gives way to the word's ids; with a
    ``decode_path``, also the text of these ids."""
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())] + [T.StructField(text_col, T.StringType())] * bool(decode_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("row_ids").type.value_type
            for k in range(batch.num_rows):
                row_ids, row_words, numbers, blocks = (batch.column(c)[k].as_py() for c in
                                                       ("row_ids", "row_words", "numbers", "blocks"))
                none = np.empty(0, np.int64)
                parts = [[_unpack(b[c])[0] for c in ("steps", "lengths", "ids")] for b in blocks or []]
                place = np.concatenate([none, *[np.cumsum(p[0], dtype=np.int64) for p in parts]])
                size_at = np.concatenate([none, *[p[1] for p in parts]]).astype(np.int64)
                flat = np.concatenate([none.astype("<u4"), *[p[2] for p in parts]])
                length, begin = np.empty_like(size_at), np.empty_like(size_at)   # by word number
                length[place], begin[place] = size_at, np.cumsum(size_at) - size_at
                number = _unpack_numbers(numbers)
                at = i = 0
                while i < len(row_ids):   # documents of about SLICE_BYTES words at a time
                    j, n = i, 0
                    while j < len(row_ids) and (j == i or n + row_words[j] <= SLICE_BYTES // 8):
                        n += row_words[j]
                        j += 1
                    these = number[at:at + n]
                    size = length[these]
                    before = np.concatenate([[0], np.cumsum(size)])
                    ids = flat[np.repeat(begin[these] - before[:-1], size) + np.arange(before[-1])]
                    ends = before[np.cumsum(row_words[i:j])]
                    off = np.concatenate([[0], ends * 4]).astype(np.int64)
                    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [
                        None, pa.py_buffer(off), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                    columns = [pa.array(row_ids[i:j], kind), pa.array(np.diff(off) // 4, pa.int64()), coded]
                    if decode_path:
                        columns.append(decode_ids(coded, decode_path))
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                    at, i = at + n, j

    return chunks.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                     chunk_bytes: int = CHUNK_BYTES, decoded_col: str | None = None) -> DataFrame:
    """Per document its id, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit), and in ``decoded_col``, if
    that is wanted too, the text of the ids as ``decode_documents`` gives it.

    ``tokenizer_path``: a byte-level file of the ``tokenizers`` library without a normalizer, there on
    every machine.
    """
    chunks = materialise(number_words(docs, id_col, text_col, chunk_bytes), "word-chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = min(max(total // BUCKET_WORDS, 1), MAX_BUCKETS)
    dealt = deal_words(chunks, n_buckets).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    blocks = (encode_words(dealt, tokenizer_path).groupBy("chunk")
              .agg(F.collect_list(F.struct("steps", "lengths", "ids")).alias("blocks")))   # n_buckets entries at most
    placed = chunks.select("chunk", "row_ids", "row_words", "numbers").join(blocks, "chunk", "left")
    return place_ids(placed, docs.schema[id_col].dataType, id_col, tokenizer_path if decoded_col else None, decoded_col or "")


@lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of every id's piece, and the bytes of all pieces; no piece has length zero."""
    tokenizer = _tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]   # bytes that stand for themselves
    code = {chr(b): b for b in plain}
    code |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    size = max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
    pieces = []
    for i in range(size):
        token = tokenizer.id_to_token(i) or ""
        pieces.append(bytes(code[c] for c in token) if all(c in code for c in token) else token.encode())
    length = np.array([*map(len, pieces), 0], np.int64)   # the last: ids outside the vocabulary
    return np.cumsum(length) - length, length, np.frombuffer(b"".join(pieces) or b"\0", np.uint8)


def decode_ids(ids: pa.Array, path: str) -> pa.Array:
    """Texts of lists of ids: a join of the ids, by position, with the table of pieces."""
    begin, length, data = piece_table(path)
    texts = []
    for value in ids:
        one = np.minimum(np.frombuffer(value.as_py() or b"", "<u4"), len(length) - 1)
        size = length[one]
        at = np.repeat(begin[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        texts.append(data[at].tobytes().decode("utf-8", "replace"))
    return pa.array(texts, pa.string())


def decode_documents(coded: DataFrame, tokenizer_path: str, *, ids_col: str = "ids",
                     text_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ``ids`` (little-endian unsigned 32-bit), special tokens included."""
    schema = T.StructType([f for f in coded.schema if f.name != text_col] + [T.StructField(text_col, T.StringType())])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep],
                                                  decode_ids(batch.column(ids_col), tokenizer_path)], schema.names)

    return stream_bound(coded, keep).mapInArrow(run, schema)
