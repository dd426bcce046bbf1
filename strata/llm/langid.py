"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; letters form words, everything else is a boundary; n-grams of 1 to 3
characters are those inside a word with a boundary on either side.  A language's profile is
the ``depth`` most frequent n-grams of all its training texts; a document's is the same of
its own.  The out-of-place distance adds up, over the document's n-grams, how many places
each is away from its place in the language's profile (``depth`` where it has none).  The
language of the least distance is predicted; ties go to the smaller name.  ``score`` is one
minus the distance over its largest possible value.

Counts cover all training texts: a task adds up its n-grams, and one shuffle of those sums
adds up the rest.  Profiles, ``depth`` rows a language, are all that comes to the driver.

Ties of n-grams go to the shorter, then the smaller one.  A text that is null or has no letter, and any text if
nothing could be learnt, gets ``und`` and score 0.  Training rows without a language or
without a letter teach nothing.  Repeated rows count each time.  Other columns are not read
by ``predict_language``, except those it is told to keep.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import blocks, ship, stream_bound, text_bytes

UNDEFINED = "und"
_EDGE = 1  # the boundary, below any letter's number
_ENDS = "\x00"  # between texts
#: Bytes of text whose n-grams are held at a time; each takes some hundred bytes on the way.
_BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _ngrams(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, int]:
    """N-grams of texts by length: their numbers and the texts they belong to; the letters; bits a character.

    An n-gram's number is its characters' numbers, ``bits`` bits each; a letter's number is
    its place among the letters met plus 2, so numbers sort as n-grams do.
    """
    lowered = [t.lower() for t in texts]
    chars = np.frombuffer(_ENDS.join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[:len(chars)]
    letter = _letters()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others, one boundary stays
    keep[:1] = True
    met = np.zeros(0x110000, bool)
    met[chars[letter]] = True
    alphabet = np.flatnonzero(met)
    number = np.full(0x110000, _EDGE)
    number[alphabet] = np.arange(2, len(alphabet) + 2)
    bits = int(len(alphabet) + 2).bit_length()
    c = np.where(letter, number[chars], _EDGE)[keep]
    owner = owner[keep]
    if len(c) and c[0] != _EDGE:
        c, owner = np.concatenate([[_EDGE], c]), np.concatenate([owner[:1], owner])
    if len(c) and c[-1] != _EDGE:
        c, owner = np.concatenate([c, [_EDGE]]), np.concatenate([owner, owner[-1:]])
    is_letter = c != _EDGE
    one, of_one = c[is_letter], owner[is_letter]
    pair = is_letter[:-1] | is_letter[1:]
    two = (c[:-1] << bits | c[1:])[pair]
    of_two = np.where(is_letter[:-1], owner[:-1], owner[1:])[pair]
    mid = is_letter[1:-1]
    three = (c[:-2] << 2 * bits | c[1:-1] << bits | c[2:])[mid]
    return [one, two, three], [of_one, of_two, owner[1:-1][mid]], alphabet, bits


def _spell(numbers: np.ndarray, alphabet: np.ndarray, bits: int) -> list[str]:
    """N-grams of their numbers; the boundary is a space."""
    signs = [" ", " ", *map(chr, alphabet.tolist())]
    out = []
    for n in numbers.tolist():
        found = ""
        while n:
            found = signs[n & ((1 << bits) - 1)] + found
            n >>= bits
        out.append(found)
    return out


def _count(numbers: list[np.ndarray], owners: list[np.ndarray], n_owners: int, bits: int):
    """Distinct (owner, number) in order, and their counts."""
    if n_owners << 3 * bits <= 1 << 24:
        cells = np.zeros(n_owners << 3 * bits, np.int64)
        for n, o in zip(numbers, owners):
            cells += np.bincount(o << 3 * bits | n, minlength=len(cells))
        keys = np.flatnonzero(cells)
        return keys >> 3 * bits, keys & ((1 << 3 * bits) - 1), cells[keys]
    keys = np.concatenate([o << 3 * bits | n for n, o in zip(numbers, owners)])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[:len(keys)]
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> 3 * bits, keys & ((1 << 3 * bits) - 1), counts


def _parts(texts: list[str]) -> Iterator[tuple[int, int, tuple]]:
    """Ranges of texts whose n-grams, with the text's number, fit 63 bits."""
    todo = [(0, len(texts))]
    while todo:
        i, j = todo.pop()
        found = _ngrams(texts[i:j])
        if 3 * found[3] + (j - i).bit_length() > 62 and j - i > 1:
            todo += [((i + j) // 2, j), (i, (i + j) // 2)]
        else:
            yield i, j, found


def learn_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = 300) -> dict[str, list[str]]:
    """Per language, its ``depth`` most frequent n-grams, from all rows with a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: dict[tuple[str, str], int] = {}
        for batch in batches:
            langs = [names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()]
            off, data, _ = text_bytes(batch.column(1))
            for i, j in blocks(off, _BLOCK):
                # one string a language: only the sums by language matter
                by: dict[int, list[str]] = {}
                for k in range(i, j):
                    by.setdefault(langs[k], []).append(bytes(data[off[k]:off[k + 1]]).decode())
                for lang, same in by.items():
                    name = next(x for x, n in names.items() if n == lang)
                    for a, b, (numbers, owners, alphabet, bits) in _parts([_ENDS.join(same)]):
                        _, found, counts = _count(numbers, owners, 1, bits)
                        for gram, n in zip(_spell(found, alphabet, bits), counts.tolist()):
                            held[name, gram] = held.get((name, gram), 0) + n
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                                              pa.array(list(held.values()), pa.int64())], ["lang", "gram", "n"])

    known = docs.where(F.col(lang_col).isNotNull())
    sums = (stream_bound(known, [lang_col, text_col]).mapInArrow(run, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    profiles: dict[str, list[tuple[int, str]]] = {}
    for row in best.select("lang", "gram", "rank").collect():
        profiles.setdefault(row[0], []).append((row[2], row[1]))
    return {lang: [g for _, g in sorted(found)] for lang, found in sorted(profiles.items())}


def _distances(texts: list[str], profiles: dict[str, list[str]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distance to each profile, and its largest possible value (0: no letter)."""
    out, most = np.zeros((len(texts), len(profiles))), np.zeros(len(texts))
    for i, j, (numbers, owners, alphabet, bits) in _parts(texts):
        if not len(numbers[0]):
            continue
        owner, number, count = _count(numbers, owners, j - i, bits)
        # n-grams of each text from the most frequent; ties keep their order: shorter, then smaller
        top = int(count.max()) + 1
        order = np.argsort(owner * top + (top - 1 - count), kind="stable")
        owner, number = owner[order], number[order]
        first = np.searchsorted(owner, np.arange(j - i))
        rank = np.arange(len(owner)) - first[owner]
        near = rank < depth
        owner, number, rank = owner[near], number[near], rank[near]
        # the profiles' n-grams in this part's numbers
        place = {chr(c): k + 2 for k, c in enumerate(alphabet.tolist())} | {" ": _EDGE}
        table: dict[int, np.ndarray] = {}
        for k, grams in enumerate(profiles.values()):
            for r, gram in enumerate(grams):
                at = [place.get(x) for x in gram]
                if None not in at:
                    n = 0
                    for x in at:
                        n = n << bits | x
                    table.setdefault(n, np.full(len(profiles), -1))[k] = r
        known = np.array(sorted(table), np.int64)
        ranks = np.array([table[n] for n in known.tolist()]).reshape(len(known), len(profiles))
        far = np.full((len(number), len(profiles)), float(depth))
        if len(known):
            at = np.minimum(np.searchsorted(known, number), len(known) - 1)
            hit = known[at] == number
            there = ranks[at[hit]]
            far[hit] = np.where(there >= 0, np.abs(there - rank[hit, None]), depth)
        for k in range(len(profiles)):
            out[i:j, k] = np.bincount(owner, weights=far[:, k], minlength=j - i)
        most[i:j] = np.bincount(owner, minlength=j - i) * float(depth)
    return out, most


def predict_language(docs: DataFrame, profiles: dict[str, list[str]], *, text_col: str = "text",
                     keep: list[str] | None = None, depth: int = 300) -> DataFrame:
    """The columns ``keep`` (default: all but those made here), ``lang_pred`` and ``score`` of every row."""
    made = ("lang_pred", "score")
    keep = [c for c in docs.columns if c not in made] if keep is None else keep
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    names = np.array([*sorted(profiles), UNDEFINED], object)
    profiles = {k: profiles[k] for k in sorted(profiles)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data, _ = text_bytes(batch.column(len(keep)))
            best, score = np.full(len(off) - 1, len(names) - 1), np.zeros(len(off) - 1)
            for i, j in blocks(off, _BLOCK) if profiles else ():
                far, most = _distances([bytes(data[off[k]:off[k + 1]]).decode() for k in range(i, j)], profiles, depth)
                some = most > 0
                best[i:j][some] = far[some].argmin(1)
                score[i:j][some] = 1 - far[some].min(1) / most[some]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(names[best], pa.string()),
                                              pa.array(score)], schema.names)

    ship(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame, *, train: Column, text_col: str = "text", lang_col: str = "lang",
             keep: list[str] | None = None, depth: int = 300) -> DataFrame:
    """Learn from the rows where ``train`` holds, predict every row."""
    profiles = learn_profiles(docs.where(train), text_col=text_col, lang_col=lang_col, depth=depth)
    return predict_language(docs, profiles, text_col=text_col, keep=keep, depth=depth)
