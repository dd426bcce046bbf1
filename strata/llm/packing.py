"""Hierarchical multi-length packing of documents into training sequences.

Each document is encoded (its ids, then the end id) and parted:

1. Whole windows of the longest tier are sequences of their own.
2. The rest, shorter than a window, is routed to the tier it fits (the smallest
   tier length that holds it).
3. Tiers are packed from the longest down.  A window opens with the longest piece
   left; its gap is filled with the longest pieces that fit, which come from the
   shorter tiers; when none fits, one piece is cut, so that the window is full.
4. What is left when a pool of documents ends goes on into the next pool; at the
   end of a task it fills windows of the shorter tiers, and less than the shortest
   tier is one padded sequence.  So a task pads one sequence at most.
5. The sequences of a tier are dealt to steps of equal token counts, in serpentine
   order of their attention cost (sum of squared piece lengths), so that the steps
   of a group take about equal time.

A task packs its own partition of the input in one pass, without a shuffle, and
holds one pool (``POOL_TOKENS`` ids) at a time.  Partitions are those of the input;
read from files they are the same on a retry, and so are the sequence ids.

Null and empty texts are documents of the end id alone.  Repeated rows are
documents of their own.  A null id stays null.  Other columns are not read.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strata.llm.common import blocks, stream_bound, text_bytes
from strata.llm.tokens import piece_encoder

#: Ids that a task gathers before it packs them.
POOL_TOKENS = 2_000_000
#: Sequence and step ids: the task's number times this, plus a count.
TASK_IDS = 1 << 33


class TierPacker:
    """Packs pieces ``(key, start, length)`` of documents into sequences of the tiers' lengths."""

    def __init__(self, tiers: tuple[int, ...], step_windows: int):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers, self.window, self.step_windows = tiers, tiers[-1], step_windows
        self.pool: list[list[tuple]] = [[] for _ in range(self.window)]  # pieces by length
        self.filled = 0  # bit n is set where pool[n] has pieces
        self.waiting = 0  # ids in the pool
        self.done: list[tuple[int, list[tuple]]] = []  # tier, pieces
        self.sequences = self.steps = 0

    def _put(self, key, start: int, length: int) -> None:
        self.pool[length].append((key, start, length))
        self.filled |= 1 << length
        self.waiting += length

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            self.filled ^= 1 << length
        self.waiting -= length
        return piece

    def add(self, key, length: int) -> None:
        """Part a document of ``length`` ids into whole windows and a routed rest."""
        whole = length // self.window * self.window
        for start in range(0, whole, self.window):
            self.done.append((self.window, [(key, start, self.window)]))
        if length > whole:
            self._put(key, whole, length - whole)

    def _fill(self, tier: int) -> None:
        """One window of ``tier``: the longest piece that fits, then its gap from shorter ones."""
        pieces, gap = [], tier
        while gap and self.filled:
            fits = (self.filled & ((2 << gap) - 1)).bit_length() - 1
            if fits > 0:
                pieces.append(self._take(fits))
                gap -= fits
            else:  # every piece is longer than the gap: cut the shortest
                key, start, length = self._take((self.filled & -self.filled).bit_length() - 1)
                pieces.append((key, start, gap))
                self._put(key, start + gap, length - gap)
                gap = 0
        self.done.append((tier, pieces))

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, list[tuple]]]:
        """Sequences that are ready: id, tier, step id and pieces.  ``last``: leave no piece waiting."""
        # a tier's windows open with its own pieces (longer than the tier below) and take their
        # gaps from the shorter tiers; until the end, enough stays back to fill the next gaps
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while self.filled.bit_length() - 1 > below and self.waiting >= (tier if last else 2 * self.window):
                self._fill(tier)
        if last and self.waiting:
            self._fill(self.window)
        ready, self.done = self.done, []
        for tier in self.tiers:
            own = sorted((pieces for t, pieces in ready if t == tier),
                         key=lambda p: -sum(x[2] * x[2] for x in p))
            per_step = self.step_windows * self.window // tier
            n_steps = -(-len(own) // per_step)
            for k, pieces in enumerate(own):
                turn, place = divmod(k, n_steps)
                step = place if turn % 2 == 0 else n_steps - 1 - place
                yield self.sequences, tier, self.steps + step, pieces
                self.sequences += 1
            self.steps += n_steps


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id",
                   text_col: str = "text", end_id: int = 0, cut: str = "space",
                   tiers: tuple[int, ...] = (128, 256, 512, 1024), step_windows: int = 8) -> DataFrame:
    """Pieces of packed sequences, with their ids.

    ``tokenizer_path``: a file of the ``tokenizers`` library, there on every machine;
    ``cut``: see ``tokens``.  ``tiers``: context lengths, powers of two; ``step_windows``:
    longest windows per training step.

    Returns per piece: the document's id, ``start`` (its ids before the piece), ``length``,
    ``doc_tokens`` (its ids, with the end id), ``sequence_id``, ``offset`` (ids before the
    piece in the sequence), ``tier`` (the sequence's context length), ``step_id`` and
    ``ids`` (little-endian unsigned 32-bit).
    """
    TierPacker(tiers, step_windows)  # refuses bad tiers before the job
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]
                          + [T.StructField(n, T.LongType()) for n in
                             ("start", "length", "doc_tokens", "sequence_id", "offset")]
                          + [T.StructField("tier", T.IntegerType()), T.StructField("step_id", T.LongType()),
                             T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_path, cut)
        packer, base = TierPacker(tiers, step_windows), TaskContext.get().partitionId() * TASK_IDS
        held: dict[int, tuple] = {}  # documents with pieces that wait: id, ids
        count = fresh = 0
        id_type = None

        def emit(last: bool) -> pa.RecordBatch:
            rows = []
            for sequence, tier, step, pieces in packer.pack(last):
                at = 0
                for key, start, length in pieces:
                    doc, ids = held[key]
                    rows.append((doc, start, length, len(ids), base + sequence, at, tier, base + step,
                                 ids[start:start + length].tobytes()))
                    at += length
            waiting = {piece[0] for same in packer.pool for piece in same}
            for key in [k for k in held if k not in waiting]:
                del held[key]
            for key, (doc, ids) in held.items():  # no longer views of whole blocks
                held[key] = (doc, ids.copy())
            columns = list(zip(*rows)) or [[]] * 9
            types = [id_type, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        for batch in batches:
            keys, id_type = batch.column(0).to_pylist(), batch.schema.field(0).type
            off, data, _ = text_bytes(batch.column(1))
            for i, j in blocks(off):
                ids, lengths = encoder.encode([bytes(data[off[k]:off[k + 1]]) for k in range(i, j)], end_id)
                at = 0
                for k, length in zip(range(i, j), lengths.tolist()):
                    held[count] = (keys[k], ids[at:at + length])
                    packer.add(count, length)
                    at += length
                    count += 1
                fresh += at
                if fresh >= POOL_TOKENS:
                    fresh = 0
                    yield emit(False)
        if id_type is not None:
            yield emit(True)

    return stream_bound(docs, [id_col, text_col]).mapInArrow(run, schema)
