"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is that of Lodhi et al.: all subsequences of ``ORDER`` characters, gaps
allowed up to a span of ``SPAN``, each weighted by ``DECAY`` to the power of its span, normalised to 1 for equal words.  So
words with other endings, swapped or inserted characters stay close to the word they hide.

Training, on at most ``max_train`` labelled documents (the first by a hash of their id):

1. words are candidates for insults by the log-likelihood of their counts in toxic against other
   documents (each context, the word with its neighbours, once, so that copies of a document
   don't count again); the strongest, and frequent words of other documents, are the landmarks;
2. every training word maps to its kernel values with the landmarks times the inverse root of the
   landmarks' own kernel matrix (Nyström); a linear support vector machine on that parts words that
   tell toxic sentences from words of other ones;
3. a logistic function of a document's largest margins and of the number and share of its words
   over the margin turns margins into scores.

A support vector machine on Nyström features is a weighted sum of kernels with the landmarks, and
each kernel a product of subsequence weights, so the sum is folded into one weight per
subsequence: a word is scored by one look-up for each of its subsequences.  Each distinct word is
scored once per worker, and a document by all words of its whole text.

Words: lower case, ASCII punctuation inside deleted (so inserted signs vanish), at white space; three
or more single characters in a row are also read as one word (spaced-out insults).  Words of over
``WINDOW`` characters are scored in overlapping windows.

Null and empty texts get the score of a text without any word.  Repeated rows are scored alike.
Extra columns are not read.  If training documents have one label only, all get the score of that
label (0 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import blocks, ship, text_bytes

ORDER, SPAN, DECAY, WINDOW = 4, 8, 0.6, 20
_LETTERS = 40  # numbers of characters: 0 is any other
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_EVIDENCE = 5  # numbers that describe a document
_SPACED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")


def words_of(text: str) -> list[str]:
    """Words of a text, with spaced-out ones."""
    plain = text.lower().encode().translate(None, _MARKS).decode()
    found = plain.split()
    for m in _SPACED.finditer(plain):
        found.append("".join(m[0].split()))
    return found


@lru_cache(maxsize=64)
def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a word, and their weights."""
    places = np.array([p for p in combinations(range(length), ORDER) if p[-1] - p[0] < SPAN], np.int64).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1.0) if len(places) else np.empty(0)


class WordKernel:
    """Subsequence weights of words as sparse vectors over numbered subsequences."""

    def __init__(self, letters: str):
        self.letters = letters
        self.table = {c: k + 1 for k, c in enumerate(letters)}

    def vectors(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By word length: rows of ``words``, numbers and weights of their subsequences (normalised;
        a subsequence that occurs twice in a word is there once, with the sum)."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for length, rows in by.items():
            places, weights = _subsequences(length)
            if not len(places):
                yield np.array(rows), np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0))
                continue
            step = max(1, 2_000_000 // len(places))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                chars = np.array([[self.table.get(c, 0) for c in words[k]] for k in part], np.int64)
                codes = np.zeros((len(part), len(places)), np.int64)
                for j in range(ORDER):
                    codes = codes * _LETTERS + chars[:, places[:, j]]
                order = np.argsort(codes, axis=1, kind="stable")
                codes = np.take_along_axis(codes, order, 1)
                values = weights[order]
                new = np.ones(codes.shape, bool)
                new[:, 1:] = codes[:, 1:] != codes[:, :-1]
                flat = np.flatnonzero(new.ravel())
                sums = np.add.reduceat(values.ravel(), flat)
                out = np.zeros(codes.shape)
                out.ravel()[flat] = sums
                yield np.array(part), codes, out / np.sqrt((out * out).sum(1, keepdims=True))

    def gram(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        """Kernel values of words (rows) with landmarks (columns)."""
        of_landmarks = [(codes, values, rows) for rows, codes, values in self.vectors(landmarks)]
        known = np.unique(np.concatenate([c.ravel() for c, _, _ in of_landmarks]))
        dense = np.zeros((len(known) + 1, len(landmarks)), np.float32)  # the last row: subsequences of no landmark
        for codes, values, rows in of_landmarks:
            for r, c, v in zip(rows, codes, values):
                np.add.at(dense[:, r], np.searchsorted(known, c), v)
        out = np.zeros((len(words), len(landmarks)))
        for rows, codes, values in self.vectors(words):
            at = np.searchsorted(known, codes)
            at[known[np.minimum(at, len(known) - 1)] != codes] = len(known)
            for j in range(codes.shape[1]):
                out[rows] += values[:, j, None] * dense[at[:, j]]
        return out


class ToxicityModel:
    """Folded kernel expansion, and the weights of the logistic function."""

    def __init__(self, letters: str, weights: np.ndarray, bias: float):
        self.key = uuid.uuid4().hex
        self.kernel, self.weights, self.bias = WordKernel(letters), weights, bias
        self.theta = np.zeros(_EVIDENCE + 1)

    def margins(self, words: list[str]) -> np.ndarray:
        pieces, owner = [], []
        for k, w in enumerate(words):
            for at in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,):
                pieces.append(w[at:at + WINDOW])
                owner.append(k)
        found = np.full(len(pieces), self.bias)
        for rows, codes, values in self.kernel.vectors(pieces):
            found[rows] += (self.weights[codes] * values).sum(1)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, np.int64), found)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.theta[:-1] + self.theta[-1], -30, 30)))


class _Memory(dict):
    """Margins of the words that a worker has met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> float:
        self.new.append(word)
        return 0.0


_MEMORY: dict[str, _Memory] = {}


def evidence(texts: list[str], model: ToxicityModel) -> np.ndarray:
    """Per text: its three largest margins (-3 to 3), and the number (logarithm) and share of words over 0."""
    memory = _MEMORY.get(model.key)
    if memory is None or len(memory) > 400_000:
        _MEMORY.clear()
        memory = _MEMORY[model.key] = _Memory()
    split = [words_of(t) for t in texts]
    for words in split:
        for w in words:
            memory[w]
    if memory.new:
        new, memory.new = list(dict.fromkeys(memory.new)), []
        memory.update(zip(new, model.margins(new).tolist()))
    out = np.full((len(texts), _EVIDENCE), -3.0)
    for k, words in enumerate(split):
        margin = np.fromiter(map(memory.__getitem__, words), float, len(words))
        top = np.sort(np.partition(margin, len(margin) - 3)[-3:] if len(margin) > 3 else margin)[::-1]
        out[k, :len(top)] = np.clip(top, -3, 3)
        over = int((margin > 0).sum())
        out[k, 3:] = np.log1p(over), over / max(1, len(words))
    return out


def _strength(toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> dict[str, float]:
    """Log-likelihood of each word's document counts, signed: over 0 for toxic documents."""
    out = {}
    for w in toxic.keys() | other.keys():
        a, b = toxic[w], other[w]
        share = (a + b) / (n_toxic + n_other)
        value = sum(x * np.log(x / (n * share)) for x, n in ((a, n_toxic), (b, n_other)) if x)
        out[w] = 2 * value if a * n_other > b * n_toxic else -2 * value
    return out


def _support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, rounds: int = 300) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        step = np.linalg.solve(ridge + c * (xa * wa[:, None]).T @ xa, c * (xa * wa[:, None]).T @ y[active])
        if np.abs(step - w).max() < 1e-9:
            break
        w = step
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept by Newton steps, halved until the loss falls."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(x.shape[1])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * t @ t)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta)), x.T @ (p - y) + ridge * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return theta


def fit(rows: list[tuple[str, int]], *, landmarks: int = 256, c: float = 10.0) -> ToxicityModel | float:
    """Model from texts and labels; a constant score if there is one label only."""
    labels = {y for _, y in rows}
    if len(labels) < 2:
        return float(next(iter(labels), 0))
    split = [(words_of(t or ""), y) for t, y in rows]
    toxic, other = Counter(), Counter()
    met: set[tuple[str, str, str]] = set()
    for words, y in split:
        new = set(zip(["", *words], words, [*words[1:], ""])) - met
        met |= new
        (toxic if y else other).update(w[:WINDOW] for _, w, _ in new)
    n_toxic = sum(y for _, y in rows)
    strength = _strength(toxic, other, max(1, toxic.total()), max(1, other.total()))
    share = toxic.total() / max(1, other.total())
    ranked = sorted((w for w in strength if len(w) >= ORDER), key=lambda w: (-strength[w], w))
    insults = [w for w in ranked if strength[w] > 12 and toxic[w] > 8 * other[w] * share][:4000]
    if not insults:
        return n_toxic / len(rows)
    common = sorted((w for w in other if len(w) >= ORDER and strength[w] <= 3), key=lambda w: (-other[w], w))
    letters = "".join(ch for ch, _ in sorted(Counter("".join(insults + common[:20000])).items(), key=lambda x: (-x[1], x[0]))[:_LETTERS - 1])
    kernel = WordKernel(letters)
    # landmarks: the strongest insults, each not too close to those before, and frequent other words
    chosen: list[str] = []
    alike = kernel.gram(insults[:1000], insults[:1000])
    picked: list[int] = []
    for k in range(min(1000, len(insults))):
        if len(picked) < landmarks * 3 // 4 and (not picked or alike[k, picked].max() < 0.8):
            picked.append(k)
    chosen += [insults[k] for k in picked]
    chosen += common[:landmarks - len(chosen)]
    # training words: all insults, frequent words of others, and those of their rare words most like an insult
    rare = common[4000:60000]
    near = kernel.gram(rare, chosen).max(1) if rare else np.zeros(0)
    words = insults + common[:4000] + [rare[k] for k in np.argsort(-near, kind="stable")[:6000]]
    y = np.where(np.arange(len(words)) < len(insults), 1.0, -1.0)
    value, vector = np.linalg.eigh(kernel.gram(chosen, chosen) + 1e-6 * np.eye(len(chosen)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    # a word weighs as it is met, the two sides alike in sum
    weight = np.sqrt(np.array([toxic[w] if t > 0 else other[w] for w, t in zip(words, y)], float))
    weight *= len(y) / 2 / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    w = _support_vectors(kernel.gram(words, chosen) @ root, y, weight, c)
    beta = root @ w[:-1]
    folded = np.zeros(_LETTERS ** ORDER)
    for at, codes, values in kernel.vectors(chosen):
        for r, code, v in zip(at, codes, values):
            np.add.at(folded, code, beta[r] * v)
    model = ToxicityModel(letters, folded, float(w[-1]))
    x = np.concatenate([evidence([t or "" for t, _ in rows[i:i + 500]], model) for i in range(0, len(rows), 500)])
    model.theta = _logistic(x, np.array([y for _, y in rows], float))
    return model


def learn(docs: DataFrame, labels: DataFrame, *, train_on: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_train: int = 4000):
    """Fit on at most ``max_train`` labelled rows where ``train_on`` holds."""
    known = labels.where(F.col(label_col).isNotNull() & train_on).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    first = known.orderBy(F.xxhash64("k"), "k", "y").limit(max_train)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(first), "k").select("t", "y").collect()
    return fit(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] or "", r[1])))


def toxicity(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` and ``predicted`` of every row."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    if isinstance(model, float):
        return rows.select(id_col, F.lit(model).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data, _ = text_bytes(batch.column(1))
            scores = [held.value.probability(evidence([bytes(data[off[k]:off[k + 1]]).decode() for k in range(i, j)], held.value))
                      for i, j in blocks(off, 2 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], schema.names)

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
