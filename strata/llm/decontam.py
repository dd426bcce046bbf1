"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one
window.  Training texts are scanned in one pass over the documents: words become numbers
of the benchmark's vocabulary, rolling hashes of their windows are looked up in the hash
set, and every hit is verified word by word, so that no result rests on a hash.

The broadcast holds the windows of at most ``max_broadcast_bytes`` of benchmark text,
measured before; a larger benchmark is taken in blocks of items of that size, one pass
each, and the hits of all passes are put together.  There is no shuffle of documents.

Null and empty texts, and texts without a word, have no words and no hits; items without
a word have no window.  Items that share an id are one item.  Repeated rows are judged
alike.  Extra columns of ``decontaminate`` pass through; its own names are not taken from
them.  With an empty benchmark nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import blocks, materialise, ship, text_bytes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z, all that parts words to a space, the rest (0-9, a-z, bytes over 7F) as it is.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
              for c in range(256))
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WindowSet:
    """Hash set of the windows of some items, with the windows themselves for the verification."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                found = by_length.setdefault(size, {}).setdefault(tuple(ids[at:at + size]), set())
                if name is not None:
                    found.add(number[name])
        self.tables = []
        for size, windows in sorted(by_length.items()):
            rows = np.array(list(windows), np.int64).reshape(len(windows), size)
            rng = np.random.default_rng(size)
            while True:  # a multiplier under which the windows' hashes differ
                powers = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                hashes = (rows.astype(np.uint64) * powers).sum(1, dtype=np.uint64)
                order = np.argsort(hashes)
                if len(order) < 2 or (np.diff(hashes[order]) != 0).all():
                    break
            owners = list(windows.values())
            self.tables.append((size, powers, hashes[order], rows[order], [sorted(owners[k]) for k in order]))

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """Per window length: the places in ``ids`` where windows occur, and their numbers."""
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for size, powers, hashes, rows, owners in self.tables:
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            total = np.zeros(len(at), np.uint64)
            for k in range(size):
                total += ids[at + k].astype(np.uint64) * powers[k]
            place = np.minimum(np.searchsorted(hashes, total), len(hashes) - 1)
            hit = hashes[place] == total
            at, place = at[hit], place[hit]
            same = np.ones(len(at), bool)
            for k in range(size):
                same &= ids[at + k] == rows[place, k]
            yield size, at[same], place[same], owners


def _scan_texts(texts: list[bytes], index: WindowSet):
    """Per text: number of words, mask of hit words, names of the items with occurring windows."""
    get = index.vocabulary.get
    parts, counts = [], np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = words_of(text)
        counts[k] = len(found)
        parts.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        parts.append(np.zeros(1, np.int64))  # no window goes from one text into the next
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    mark = np.zeros(len(ids) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    for size, at, place, owners in index.scan(ids):
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
        pairs = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, place], 1), axis=0)
        for k, window in pairs.tolist():
            items[k].update(owners[window])
    hit = np.cumsum(mark[:-1]) > 0
    for k in range(len(texts)):
        yield int(counts[k]), hit[first[k]:first[k] + counts[k]], items[k]


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Byte ranges of the hit words, those next to each other as one."""
    folded = text.translate(_FOLD)
    ends = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": ends[a][0], "end": ends[b - 1][1]} for a, b in edge.reshape(-1, 2).tolist()]


def scan_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = 13,
                       max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with the columns ``n_words``, ``n_hit`` (words inside occurrences of windows),
    ``items`` (ids, as strings, of the items with occurring windows, sorted) and ``spans``
    (byte ranges of the hit words in the text's UTF-8).
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = -(-size // max_broadcast_bytes) or 1
    names = ("n_words", "n_hit", "items", "spans")
    kept = [c for c in docs.columns if c not in names]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)])
    column = kept.index(text_col)

    def one_pass(frame: DataFrame, held, again: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                off, data, _ = text_bytes(batch.column(column))
                for i, j in blocks(off):
                    texts = [bytes(data[off[k]:off[k + 1]]) for k in range(i, j)]
                    part = batch.slice(i, j - i)
                    old = [part.column(len(kept) + k).to_pylist() for k in (2, 3)] if again else None
                    n_words, n_hit, found, spans = [], [], [], []
                    for k, (n, hit, owners) in enumerate(_scan_texts(texts, index)):
                        named = {index.names[x] for x in owners}
                        if again:
                            named |= set(old[0][k])
                            if old[1][k]:
                                ends = np.array([m.start() for m in re.finditer(rb"[^ ]+", texts[k].translate(_FOLD))])
                                hit = hit.copy()
                                for s in old[1][k]:
                                    hit |= (ends >= s["start"]) & (ends < s["end"])
                        n_words.append(n)
                        n_hit.append(int(hit.sum()))
                        found.append(sorted(named))
                        spans.append(_spans(texts[k], hit) if n_hit[-1] else [])
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:len(kept)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                         pa.array(found, pa.list_(pa.string())), pa.array(spans, span_type)], schema.names)
        return frame.mapInArrow(run, schema)

    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b) if n_blocks > 1 else items
        held = sc.broadcast(WindowSet([(r[0], r[1]) for r in block.collect()], window))
        if b:
            out = materialise(out, "decontam")
        out = one_pass(out, held, b > 0)
    return out


def contaminated(share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", share: int = 20,
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit spans cut from
    the texts of all documents; other columns as they are."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    found = scan_contamination(docs, benchmark, text_col=text_col, **options)
    if remove == "documents":
        found = found.where(~contaminated(share))
    else:  # the pieces between the spans, by bytes
        raw = F.col(text_col).cast("binary")
        edges = F.transform("spans", lambda s, k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.col("spans")[k - 1]["end"]).alias("a"), s["start"].alias("b")))
        last = F.coalesce(F.element_at("spans", -1)["end"], F.lit(0))
        cut = F.aggregate(edges, F.lit("").cast("string"),
                          lambda acc, e: F.concat(acc, F.substring(raw, e["a"] + 1, e["b"] - e["a"]).cast("string")))
        cut = F.concat(cut, F.substring(raw, last + 1, F.length(raw) - last).cast("string"))
        found = found.withColumn(text_col, F.when(F.size("spans") > 0, cut).otherwise(F.col(text_col)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")])
