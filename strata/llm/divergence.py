"""How far each source's vocabulary lies from its language's and from other sources': stripes folded in the mappers.

A task folds whole documents into a hash of *stripes*, term -> (document frequency, count per
source).  When the hash holds ``FOLD_ENTRIES`` entries it is spilled: its stripes become rows and
it starts anew.  The rows are sorted by language and term, and stripes of one key, which then
follow each other, are merged one by one; a merged stripe with fewer than ``min_df`` documents
ends here.  Totals per source come from the merged stripes, which are written once, and every
stripe then emits divergences directly: of its sources from the language (part ``term``), and of
its sources from each other (part ``pair``, pre-summed in the task).

Hot keys: a source with a third of all rows is an entry of a stripe, whatever its count; a frequent
term has one row per spill; a language is split over ``salts`` groups for emission, and each gets
the language's sources and totals once, as its first row.  What a task holds is ``FOLD_ENTRIES``
entries, or one stripe (as long as its language has sources), or ``BLOCK`` x ``BLOCK`` sums per
block of sources, spilled above ``SUMS`` of them.  The part ``pair`` has sources x sources rows per
language by its definition; nothing larger is made.

Arithmetic is exact: shares are integers, p = 1 + floor(10^9 (count + smooth) / (N + smooth V)), by
long division in 64 bits, for up to 9 * 10^15 words.

Cases: null text, language or source are empty texts; a text without terms still makes its
(language, source) group occur; texts of any length are folded whole, ``FOLD_BYTES`` at a time;
equal rows count as often as they come; ties in value are ranked by the UTF-8 of the item; a
language without kept terms has pairs of value 0 and no terms; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import materialise, stream_bound, text_bytes

FOLD_ENTRIES, FOLD_BYTES = 400_000, 1 << 20
BLOCK, SUMS = 256, 512
#: Stripes that one group of a language emits for.
SALT_STRIPES = 2000
#: ASCII letters in lower case and all bytes of other characters stay, the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_NAMES = ["lang", "term", "df", "sources", "counts"]


def _rows(lang: list, term: list, df: list, sizes: list, sources: pa.Array, counts: list) -> pa.RecordBatch:
    """Stripes as a batch; ``sizes`` has how many of ``sources`` and ``counts`` each one has."""
    off = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(df, pa.int64()),
        pa.ListArray.from_arrays(off, sources), pa.ListArray.from_arrays(off, pa.array(counts, pa.int64()))], _NAMES)


def _terms(text: bytes) -> Counter:
    """Terms of a text and their counts; a long text is read in parts that end between terms."""
    found, at = Counter(), 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + FOLD_BYTES)
        end = cut.end() if cut else len(text)
        found.update(text[at:end].translate(_TERM_BYTES).split())
        at = end
    return found


def fold_stripes(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Stripes of each task's documents: ``lang``, ``term``, ``df``, ``sources``, ``counts``.  The empty
    term has every source that occurs in the language, with count 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[str, dict[bytes, list]] = {}
        codes: dict[str, int] = {}   # of sources
        entries = 0

        def spill() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(codes), pa.string())
            for lang, stripes in folded.items():
                items = list(stripes.items())
                for k in range(0, len(items), 10_000):
                    part = items[k:k + 10_000]
                    found = np.fromiter((c for _, s in part for c in s[1]), np.int32)
                    yield _rows([lang] * len(part), [t for t, _ in part], [s[0] for _, s in part],
                                [len(s[1]) for _, s in part], names.take(pa.array(found)),
                                [n for _, s in part for n in s[1].values()])

        for batch in batches:
            off, data, _ = text_bytes(batch.column(0))
            for k, (lang, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                code = codes.setdefault(source or "", len(codes))
                stripes = folded.setdefault(lang or "", {b"": [0, {}]})
                if code not in stripes[b""][1]:
                    stripes[b""][1][code] = 0
                    entries += 1
                get = stripes.get
                for term, n in _terms(bytes(data[off[k]:off[k + 1]])).items():
                    stripe = get(term)
                    if stripe is None:
                        stripes[term] = [1, {code: n}]
                        entries += 1
                        continue
                    stripe[0] += 1
                    counts = stripe[1]
                    if code in counts:
                        counts[code] += n
                    else:
                        counts[code] = n
                        entries += 1
                if entries >= FOLD_ENTRIES:
                    yield from spill()
                    folded, codes, entries = {}, {}, 0
        yield from spill()

    return stream_bound(docs, [text_col, lang_col, source_col]).mapInArrow(run, _STRIPE)


def merge_stripes(folded: DataFrame, min_df: int) -> DataFrame:
    """One stripe per language and term of ``min_df`` documents or more, and the language's empty term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, df, counts = None, 0, {}   # the last stripe, which may go on

        def add(n: int, sources: list, values: list) -> None:
            nonlocal df
            df += n
            for s, v in zip(sources, values):
                counts[s] = counts.get(s, 0) + v

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, term, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            change = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(change) + 1])
            enough = (np.add.reduceat(n, first) >= min_df) | pc.equal(term, "").to_numpy(zero_copy_only=False)[first]
            enough[[0, -1]] = True   # may go on before or behind this batch
            rows = np.flatnonzero(np.repeat(enough, np.diff(np.append(first, batch.num_rows))))
            out = []
            for *now, m, sources, values in zip(*[c.take(pa.array(rows)).to_pylist() for c in batch.columns]):
                if now != key:
                    if key and (df >= min_df or key[1] == ""):
                        out.append((key, df, counts))
                    key, df, counts = now, 0, {}
                add(m, sources, values)
            yield table(out)
        if key and (df >= min_df or key[1] == ""):
            yield table([(key, df, counts)])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return _rows([k[0] for k, _, _ in out], [k[1] for k, _, _ in out], [d for _, d, _ in out], [len(c) for _, _, c in out],
                     pa.array([s for _, _, c in out for s in c], pa.string()), [v for _, _, c in out for v in c.values()])

    return folded.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, _STRIPE)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 counts / total), exact, for counts <= total < 9.2 * 10^15."""
    out, rest = counts // total, counts % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class _Emitter:
    """Divergences of one language's stripes."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], n_terms: int, smooth: int, top: int):
        self.lang, self.sources, self.smooth, self.top = lang, sources, smooth, top
        self.index = {s: k for k, s in enumerate(sources)}
        self.size = np.array(totals, np.int64) + smooth * n_terms
        self.whole = sum(totals) + smooth * n_terms
        self.sums: dict[tuple[int, int], np.ndarray] = {}
        self.stripes: list[tuple] = []

    def _row(self, part: str, source, item, value) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([self.lang] * len(value), pa.string()), pa.array(source, pa.string()),
            pa.array([part] * len(value), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())],
            ["lang", "source", "part", "item", "value"])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Emit for the stripes at hand: terms now, pairs into the sums."""
        if not self.stripes:
            return
        terms = [s[0] for s in self.stripes]
        at = np.repeat(np.arange(len(terms)), [len(s[1]) for s in self.stripes])
        source = np.fromiter((self.index[x] for s in self.stripes for x in s[1]), np.int64, len(at))
        count = np.fromiter((x for s in self.stripes for x in s[2]), np.int64, len(at))
        all_counts = np.zeros(len(terms), np.int64)
        np.add.at(all_counts, at, count)
        p = shares(count + self.smooth, self.size[source])
        f = p - shares(all_counts + self.smooth, self.whole)[at]
        kept = np.flatnonzero((count > 0) & (f > 0))
        kept = kept[np.lexsort([-f[kept], source[kept]])]
        first = np.flatnonzero(np.diff(source[kept], prepend=-1))
        place = np.arange(len(kept)) - np.repeat(first, np.diff(np.append(first, len(kept))))
        # the value at the last wanted place, ties with it included
        bound = np.zeros(len(self.sources), np.int64)
        last = place == self.top - 1
        bound[source[kept[last]]] = f[kept[last]]
        kept = kept[f[kept] >= bound[source[kept]]]
        yield self._row("term", [self.sources[k] for k in source[kept]], [terms[k] for k in at[kept]], f[kept])
        base = shares(np.full(len(self.size), self.smooth, np.int64), self.size)
        n_blocks = -(-len(self.sources) // BLOCK)

        def dense(block: int) -> np.ndarray:
            lo, hi = block * BLOCK, min((block + 1) * BLOCK, len(self.sources))
            out = np.repeat(base[lo:hi, None], len(terms), axis=1)
            mine = (source >= lo) & (source < hi)
            out[source[mine] - lo, at[mine]] = p[mine]
            return out

        for a in range(n_blocks):
            left = dense(a)
            for b in range(a, n_blocks):
                right = left if a == b else dense(b)
                sums = self.sums.get((a, b))
                if sums is None:
                    if len(self.sums) >= SUMS:
                        yield from self.pairs()
                    sums = self.sums[a, b] = np.zeros((len(left), len(right)), np.int64)
                for k in range(len(left)):
                    sums[k] += np.abs(right - left[k]).sum(axis=1)
        self.stripes = []

    def pairs(self) -> Iterator[pa.RecordBatch]:
        """The sums so far, both ways; they start anew."""
        for (a, b), sums in self.sums.items():
            for k in range(len(sums)):
                i, value = a * BLOCK + k, sums[k]
                others = [j for j in range(len(value)) if b * BLOCK + j != i]
                names = [self.sources[b * BLOCK + j] for j in others]
                yield self._row("pair", [self.sources[i]] * len(names), names, value[others])
                if a != b:
                    yield self._row("pair", names, [self.sources[i]] * len(names), value[others])
        self.sums = {}

    def zeros(self) -> Iterator[pa.RecordBatch]:
        for s in self.sources:
            names = [x for x in self.sources if x != s]
            yield self._row("pair", [s] * len(names), names, [0] * len(names))


def emit_divergences(merged: DataFrame, salts: int, smooth: int, top: int) -> DataFrame:
    """Rows ``lang``, ``source``, ``part``, ``item``, ``value``: of ``pair`` parts of the sums, of
    ``term`` each group's first ``top`` of a batch of stripes."""
    counts = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    groups = counts.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    terms = merged.groupBy("lang").agg(F.sum(F.when(F.col("term") != "", 1).otherwise(0)).alias("df"))
    head = (groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))
            .join(terms, "lang").select(
        "lang", F.lit("").alias("term"), "df", F.col("g.source").alias("sources"), F.col("g.n").alias("counts"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    body = merged.where(F.col("term") != "").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    dealt = (head.unionByName(body).repartition("lang", "salt").sortWithinPartitions("lang", "salt", "term")
             .select("salt", *_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for salt, lang, term, df, sources, values in zip(*[c.to_pylist() for c in batch.columns]):
                if term == "":   # the first row of a group
                    if now:
                        yield from now.flush()
                        yield from now.pairs()
                    now = _Emitter(lang, sources, values, df, smooth, top)
                    if salt == 0:
                        yield from now.zeros()
                else:
                    now.stripes.append((term, sources, values))
                    if len(now.stripes) >= 2000:
                        yield from now.flush()
        if now:
            yield from now.flush()
            yield from now.pairs()

    return dealt.mapInArrow(run, "lang string, source string, part string, item string, value long")


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_df: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` (from 1 per group and part).

    ``pair``: sums of |p - q| over all kept terms, for every other source of the language.
    ``term``: p - q against the language, where positive and the term occurs, to rank ``top``.
    """
    merged = materialise(merge_stripes(fold_stripes(docs, text_col, lang_col, source_col), min_df), "stripes")
    salts = max(1, min(1024, merged.count() // SALT_STRIPES))
    found = materialise(emit_divergences(merged, salts, smooth, top), "divergences")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = (found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
             .withColumn("rank", F.row_number().over(order)))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
