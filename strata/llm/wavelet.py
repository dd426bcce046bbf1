"""Token ids in wavelet-matrix files, one per shard of documents in ascending id order.

A shard file holds its ids as segments of at most ``SEGMENT`` ids; each segment is a wavelet
matrix: one bit-plane per bit of an id, from the highest, each plane's ids stably parted by
the plane above.  Planes are packed bits, compressed one by one; a directory of ones per
512 bits gives rank in constant time.  So one file serves reading, access to any token,
counting a token in a prefix (rank), and finding its occurrences (select).

    file:     "WMT1", segments, footer, 8 bytes footer length, "WMT1"
    segment:  per plane: zstd of packed bits (little bit order)
    footer:   zstd of JSON: segments (start, length, planes' offsets, sizes, zeros), documents (id, ids)

Documents are dealt to shards by ranges of their id (ties by a hash of the text, so a hot id
spreads), sorted in each shard, encoded, and written by one task per shard under a
temporary name that is then renamed: a task that runs again writes the same file.  Files go
to the shared folder.  Memory is one segment and its text block at a time.

Null and empty texts are documents of the end id alone; null ids come first; repeated rows are
documents of their own; extra columns are not read; an empty table gives no file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import blocks, materialise, open_fs, shared_folder, ship, text_bytes
from strata.llm.tokens import piece_encoder

MAGIC = b"WMT1"
SEGMENT = 1 << 17
_RANK = 512


def build_planes(ids: np.ndarray, n_bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit-planes from the highest bit, and the zeros of each."""
    ids = ids.astype(np.uint16 if n_bits <= 16 else np.uint32)
    planes, zeros = [], []
    for bit in range(n_bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << bit)) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        left = np.flatnonzero(~ones)
        zeros.append(len(left))
        ids = np.concatenate([ids.take(left), ids.take(np.flatnonzero(ones))])
    return planes, zeros


def read_planes(planes: list[np.ndarray], zeros: list[int], n: int) -> np.ndarray:
    """All ids of a segment: the planes' partitions undone from the lowest bit up."""
    ids = np.zeros(n, np.uint16 if len(planes) <= 16 else np.uint32)
    for level in range(len(planes) - 1, -1, -1):
        ones = np.unpackbits(planes[level], count=n, bitorder="little").astype(bool)
        above = np.empty_like(ids)
        above[np.flatnonzero(~ones)] = ids[:zeros[level]]
        above[np.flatnonzero(ones)] = ids[zeros[level]:] | ids.dtype.type(1 << len(planes) - 1 - level)
        ids = above
    return ids


class WaveletMatrix:
    """Rank, select and access on one segment."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n
        self.directory = []
        for plane in planes:
            padded = np.zeros(-(-max(n, 1) // _RANK) * _RANK // 8, np.uint8)
            padded[:len(plane)] = plane
            counts = np.bitwise_count(padded).reshape(-1, _RANK // 8).sum(1)
            self.directory.append(np.concatenate([[0], np.cumsum(counts)]))

    def _ones(self, level: int, at: int) -> int:
        block = at // _RANK
        part = self.planes[level][block * _RANK // 8:-(-at // 8)]
        bits = np.unpackbits(part, bitorder="little")[:at - block * _RANK]
        return int(self.directory[level][block] + bits.sum())

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        found = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at // 8] >> at % 8 & 1)
            ones = self._ones(level, at)
            at = zeros + ones if bit else at - ones
            found = found << 1 | bit
        return found

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the first ``end`` ids' occurrences of a token lie below the last plane."""
        a, b = 0, end
        if token >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            ones_a, ones_b = self._ones(level, a), self._ones(level, b)
            if token >> len(self.planes) - 1 - level & 1:
                a, b = zeros + ones_a, zeros + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token among the first ``end`` ids."""
        a, b = self._range(token, min(end, self.n))
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a value."""
        directory = self.directory[level]
        counts = directory if bit else np.minimum(np.arange(len(directory)) * _RANK, self.n) - directory
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * _RANK // 8:(block + 1) * _RANK // 8], bitorder="little")
        return block * _RANK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> len(self.planes) - 1 - level & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at


class ShardWriter:
    def __init__(self, sink, n_bits: int):
        self.sink, self.n_bits, self.at = sink, n_bits, len(MAGIC)
        self.segments, self.docs, self.waiting, self.held, self.total = [], [], [], 0, 0
        self.squeeze = zstandard.ZstdCompressor(level=1)
        sink.write(MAGIC)

    def add(self, keys: list, lengths: list[int], ids: np.ndarray) -> None:
        self.docs += zip(keys, lengths)
        self.waiting.append(ids)
        self.held += len(ids)
        while self.held >= SEGMENT:
            self._segment(SEGMENT)

    def _segment(self, size: int) -> None:
        ids = np.concatenate(self.waiting)
        planes, zeros = build_planes(ids[:size], self.n_bits)
        self.waiting, self.held = [ids[size:]], len(ids) - size
        places = []
        for plane in planes:
            packed = self.squeeze.compress(plane.tobytes())
            self.sink.write(packed)
            places.append((self.at, len(packed)))
            self.at += len(packed)
        self.segments.append({"start": self.total, "n": size, "planes": places, "zeros": zeros})
        self.total += size

    def close(self) -> None:
        if self.held:
            self._segment(self.held)
        footer = self.squeeze.compress(json.dumps({"segments": self.segments, "docs": self.docs}).encode())
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class ShardFile:
    """Reads a shard file: documents, ids in order, and rank and select over the whole shard."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(4, size - 4) != MAGIC or self.file.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is no shard file")
        length = int.from_bytes(self.file.read_at(8, size - 12), "little")
        self.open = zstandard.ZstdDecompressor()
        footer = json.loads(self.open.decompress(self.file.read_at(length, size - 12 - length)))
        self.segments, self.docs = footer["segments"], footer["docs"]

    def _planes(self, segment: dict) -> list[np.ndarray]:
        return [np.frombuffer(self.open.decompress(self.file.read_at(n, at)), np.uint8) for at, n in segment["planes"]]

    def ids(self) -> Iterator[np.ndarray]:
        for s in self.segments:
            yield read_planes(self._planes(s), s["zeros"], s["n"])

    def _matrices(self) -> Iterator[tuple[int, WaveletMatrix]]:
        for s in self.segments:
            yield s["start"], WaveletMatrix(self._planes(s), s["zeros"], s["n"])

    def access(self, at: int) -> int:
        s = next(s for s in self.segments if s["start"] <= at < s["start"] + s["n"])
        return WaveletMatrix(self._planes(s), s["zeros"], s["n"]).access(at - s["start"])

    def rank(self, token: int, end: int) -> int:
        return sum(m.rank(token, end - start) for start, m in self._matrices() if start < end)

    def occurrences(self, token: int) -> list[int]:
        return [start + m.select(token, k) for start, m in self._matrices() for k in range(m.rank(token, m.n))]


def write_shards(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                 cut: str = "white", n_bits: int = 16, shard_bytes: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """Encode, write; one row per file: ``shard`` (in id order), ``path``, ``n_docs``, ``n_tokens``.

    ``n_bits``: bits of the largest id; ``shard_bytes``: text of a shard, about."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "wavelet")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["id", F.xxhash64("text")]
    shards = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    schema = "shard long, path string, n_docs long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, writer = TaskContext.get().partitionId(), None
        name = f"{folder}/shard-{shard:08d}.wm"
        system, path = open_fs(name)
        draft = f"{path}.{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = piece_encoder(tokenizer_path, cut)
                system.create_dir(open_fs(folder)[1], recursive=True)
                sink = system.open_output_stream(draft)
                writer = ShardWriter(sink, n_bits)
            keys = batch.column(0).to_pylist()
            off, data, _ = text_bytes(batch.column(1))
            for i, j in blocks(off):
                ids, lengths = encoder.encode([bytes(data[off[k]:off[k + 1]]) for k in range(i, j)], end_id)
                if int(ids.max()) >> n_bits:
                    raise ValueError(f"an id needs more than {n_bits} bits")
                writer.add(keys[i:j], lengths.tolist(), ids)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, path)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [len(writer.docs)],
                                              "n_tokens": [writer.total]})

    return materialise(shards.mapInArrow(run, schema), "wavelet-files")


def read_shards(files: DataFrame, id_type: T.DataType) -> DataFrame:
    """From the files of documents with whole-number or string ids: per document its id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (little-endian unsigned 32-bit).  The order of files is a running sum over one row per file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = pa.string() if isinstance(id_type, T.StringType) else pa.int64()
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardFile(uri)
                docs, at, rest = iter(shard.docs), base, np.empty(0, np.uint32)
                doc = next(docs, None)
                for part in shard.ids():
                    rest = np.concatenate([rest, part.astype("<u4")])
                    used, out = 0, ([], [], [], [])
                    while doc is not None and used + doc[1] <= len(rest):
                        for column, value in zip(out, (doc[0], at, doc[1], rest[used:used + doc[1]].tobytes())):
                            column.append(value)
                        used, at = used + doc[1], at + doc[1]
                        doc = next(docs, None)
                    rest = rest[used:].copy()
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], key_type), *[pa.array(c, pa.int64()) for c in out[1:3]], pa.array(out[3], pa.binary())], schema.names)

    n = max(1, placed.count())
    return placed.select("path", "base").repartition(n, "path").mapInArrow(run, schema)
