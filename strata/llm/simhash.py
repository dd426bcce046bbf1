"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``shingle`` words
(repeats included; a shorter text is one shingle, a text without words has fingerprint 0),
XXH64 of each with seed 42; a bit is 1 if more than half the hashes have it.

Links: two fingerprints with at most ``max_bits`` differing bits differ in at most that many
of their eight bytes, so they share at least ``8 - max_bits`` positional bytes.  The index is
keyed by positional bytes: the eight are parted into ``max_bits + 2`` groups of neighbouring
positions, and a posting list is keyed by the values in two groups, which such a pair must
share.  Candidates come from the same list; their shared positional bytes are tallied,
those that reach the guaranteed minimum are kept and their differing bits counted.

Equal fingerprints are one entry from the start.  A posting list of more than ``max_list``
entries makes no pairs: its entries, and each with one of its other bits flipped, are hubs, and
entries at a common hub are chained to the smallest.  Two entries at one hub differ in two bits
at most, and every two entries that differ in one or two bits have a common hub, so this is exact
for ``max_bits`` of 2; a hub has 65 entries at most.  Components come from ``components``.

Null texts count as empty.  Rows of one id are documents of their own with the same id; a null
id is kept as null and never a component's id unless it has no other.  Other columns are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import blocks, join_classes, materialise, stream_bound, text_bytes
from strata.llm.components import connected_components

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of the word shingles of a text."""
    from xxhash import xxh64_intdigest
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    line, ends = b" ".join(words), []
    at = -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[size - 1:])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose shingle hashes lie one after the other, ``counts`` of each."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Id and 64-bit ``fingerprint`` (as a signed long) of every row."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data, _ = text_bytes(batch.column(1))
            found = []
            for i, j in blocks(off, 2 << 20):
                counts, flat = np.zeros(j - i, np.int64), []
                for k in range(i, j):
                    hashes = shingle_hashes(bytes(data[off[k]:off[k + 1]]), shingle)
                    counts[k - i] = len(hashes)
                    flat.append(np.array(hashes, np.uint64))
                found.append(majority(np.concatenate(flat), counts))
            prints = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], schema.names)

    return stream_bound(docs, [id_col, text_col]).mapInArrow(run, schema)


def _byte_groups(max_bits: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.arange(8), max_bits + 2)]


def _keys(fp: Column, max_bits: int) -> list[tuple[int, Column]]:
    """The bits of each pair of byte groups, in place: mask and masked fingerprint."""
    out = []
    for a, b in combinations(_byte_groups(max_bits), 2):
        mask = sum(0xFF << 8 * k for k in a + b)
        mask -= (1 << 64) * (mask >> 63)
        out.append((mask, fp.bitwiseAND(F.lit(mask))))
    return out


def fingerprint_links(prints: DataFrame, *, fp: str = "fingerprint", max_bits: int = 2, max_list: int = 64) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints whose components are those of all pairs
    with at most ``max_bits`` differing bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    keys = _keys(F.col("f"), max_bits)
    distinct = prints.select(F.col(fp).alias("f")).distinct()
    postings = distinct.select("f", F.posexplode(F.array(*[k for _, k in keys])).alias("combo", "key"))
    lists = postings.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(postings.join(lists, ["combo", "key"]), "simhash-lists")

    short = members.where(F.col("n") <= max_list)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(8))
    pairs = (short.select("combo", "key", F.col("f").alias("a"))
             .join(short.select("combo", "key", F.col("f").alias("b")), ["combo", "key"])
             .where(F.col("a") < F.col("b"))
             .where(shared >= 8 - max_bits).where(F.bit_count(differ) <= max_bits).select("a", "b"))

    # long lists: an entry and its flips of the bits outside the list's bytes
    flips = [[F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long")
                                       for k in range(64) if not mask >> k & 1]] for mask, _ in keys]
    n_flips = 1 if max_bits == 0 else None
    chosen = F.array(*[F.array(*x[:n_flips]) for x in flips])[F.col("combo")]
    hubs = (members.where(F.col("n") > max_list)
            .select("combo", "f", F.explode(chosen).alias("flip"))
            .select("combo", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("hub")))
    if max_bits == 1:  # a hub that is no entry would link entries two bits apart
        hubs = hubs.join(distinct.select(F.col("f").alias("hub")), "hub", "left_semi")
    least = hubs.groupBy("combo", "hub").agg(F.min("f").alias("a"), F.count("*").alias("m")).where("m > 1")
    if max_bits == 1:
        chained = hubs.select(F.col("hub").alias("a"), F.col("f").alias("b")).where("a <> b")
    else:
        chained = hubs.join(least, ["combo", "hub"]).where("a <> f").select("a", F.col("f").alias("b")).distinct()
    return pairs.unionByName(chained)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, max_list: int = 64) -> DataFrame:
    """Id, ``fingerprint`` (signed long) and ``component_id`` (smallest id of the group) of every row."""
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    classes = materialise(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"), F.count("*").alias("n_rows")),
                          "simhash-classes")
    links = fingerprint_links(classes, max_bits=max_bits, max_list=max_list)
    groups = connected_components(links, "a", "b")
    grouped = classes.join(groups, classes["fingerprint"] == groups["node"])
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = grouped.join(least, "component").select("fingerprint", "component_id")
    of_class = (classes.join(moved, "fingerprint", "left")
                .select("fingerprint", F.coalesce("component_id", "least").alias("component_id"), "n_rows"))
    return join_classes(prints, materialise(of_class, "simhash-groups"), "fingerprint", "n_rows").select(id_col, "fingerprint", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group, the one of the smallest id; of rows with that same id, one.
    Rows without an id can't be told apart and stay."""
    found = near_duplicates(docs, id_col=id_col, **options)
    kept = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n_rows_of_id"))
    kept = materialise(kept, "simhash-kept")
    # by shuffle at every size: the kept ids grow with the documents
    kept = kept.hint("merge")
    once = docs.join(kept.where("n_rows_of_id = 1"), id_col, "left_semi")
    repeated = docs.join(kept.where("n_rows_of_id > 1"), id_col, "left_semi").dropDuplicates([id_col])
    nameless = docs.where(F.col(id_col).isNull())
    return once.unionByName(repeated).unionByName(nameless).select(*[F.col(f"`{c}`") for c in docs.columns])
