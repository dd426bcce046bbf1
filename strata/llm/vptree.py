"""Nearest neighbours by cosine: a vantage-point tree per shard.

On unit vectors the largest cosine is the least Euclidean distance, a metric.  Vectors are dealt to shards by a
hash of their id; a shard's task builds a vantage-point tree (each node a vantage vector and
the median distance of the others to it, leaves of ``leaf`` vectors), then searches it for
blocks of queries at a time.  A subtree is passed over when the triangle inequality shows
that it holds nothing nearer than the k-th found so far, with that distance divided by
``factor``: 1 is exact search, more passes over more.

A copy of each query block goes to each shard, since every query is held against all rows; a
task holds one tree and one block.  Each shard answers with k rows per query, the exact
measure computed on the original vectors in double precision, and the best k of those are
taken per query.  Equal vectors are one point of a tree with its smallest ids, so a vector
that a third of all rows hold costs no more than one.

Ties go to the smaller id.  Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, neither as queries nor as candidates; neither do null
ids.  A repeated id is a row of its own; a query does not find rows of its own id.  Extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import ship

_SLACK = 1e-9
#: What rounding may change in the square of a distance of unit vectors.
_TIE = 1e-12
#: Rows whose scores are computed at a time.
_SCORES = 1 << 16


class VPTree:
    """Distinct unit vectors; ``search`` gives the points nearest to each of a block of queries."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple] = []  # leaf: (members,), node: (vantage, radius, inside, outside)
        rng = np.random.default_rng(7)
        todo = [(np.arange(len(points)), None)] if len(points) else []
        while todo:
            members, slot = todo.pop()
            number = len(self.nodes)
            if slot is not None:
                self.nodes[slot[0]][slot[1]] = number
            if len(members) <= leaf:
                self.nodes.append([members])
                continue
            vantage = members[rng.integers(len(members))]
            rest = members[members != vantage]
            far = np.linalg.norm(points[rest] - points[vantage], axis=1)
            radius = float(np.median(far))
            inside, outside = rest[far <= radius], rest[far > radius]
            if not len(outside):  # all equally far: any halves will do
                inside, outside = rest[::2], rest[1::2]
                self.nodes.append([vantage, np.inf, None, None])
            else:
                self.nodes.append([vantage, radius, None, None])
            todo += [(outside, (number, 3)), (inside, (number, 2))]

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Numbers of the ``k`` nearest points found per query (-1: fewer points)."""
        return self.nearest(queries, k, factor)[0]

    def with_ties(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """As ``search``, with every point found that is as far as the ``k``-th, but for rounding."""
        width = k + 3
        found, best = self.nearest(queries, width, factor)
        todo = np.arange(len(queries))
        while width < len(self.points) and len(todo):
            far = np.sort(best, 1)
            todo = todo[far[:, -1] ** 2 <= far[:, k - 1] ** 2 + _TIE]
            if not len(todo):
                break
            width = min(width * 4, len(self.points))
            more, best = self.nearest(queries[todo], width, factor)
            found = np.pad(found, ((0, 0), (0, width - found.shape[1])), constant_values=-1)
            found[todo] = more
        return found

    def nearest(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """``search``, and the distances."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1)

        def offer(of: np.ndarray, members: np.ndarray, far: np.ndarray) -> None:
            all_far = np.concatenate([best[of], far], 1)
            all_found = np.concatenate([found[of], np.broadcast_to(members, far.shape)], 1)
            order = np.argpartition(all_far, k - 1, axis=1)[:, :k]
            best[of] = np.take_along_axis(all_far, order, 1)
            found[of] = np.take_along_axis(all_found, order, 1)

        def distances(of: np.ndarray, members: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 - 2 * queries[of] @ self.points[members].T, 0))

        stack = [(0, np.arange(len(queries)), None)] if self.nodes and len(queries) else []
        while stack:
            number, of, bound = stack.pop()
            if bound is not None:  # what lies there is at least so far away
                of = of[bound <= best[of].max(1) / factor + _SLACK]
            if not len(of):
                continue
            node = self.nodes[number]
            if len(node) == 1:
                offer(of, node[0], distances(of, node[0]))
                continue
            vantage, radius, inside, outside = node
            far = distances(of, np.array([vantage]))
            offer(of, np.array([vantage]), far)
            far = far[:, 0]
            near = far <= radius
            none = np.isinf(radius)
            gap = np.zeros(len(far)) if none else np.abs(far - radius)
            # the side a query lies on comes first, the other with its bound after that
            stack += [(outside, of[near], gap[near]), (inside, of[~near], gap[~near]),
                      (inside, of[near], None), (outside, of[~near], None)]
        return found, best


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows give equal values."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Shard:
    """The rows of a shard: a tree of the distinct vectors, and the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        self.ids, vectors = ids[order], vectors[order]
        first = np.ones(len(ids), bool)
        first[1:] = (vectors[1:] != vectors[:-1]).any(1)
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], len(ids))
        self.points = vectors[self.starts]
        self.tree = VPTree(self.points / np.sqrt((self.points * self.points).sum(1))[:, None], leaf)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
        """Query id, id, score of the k nearest rows to each query."""
        unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        # one more than k: the query's own vector
        found = self.tree.with_ties(unit, k + 1, factor)
        row, col = np.nonzero(found >= 0)
        point = found[row, col]
        score = np.concatenate([_cosines(queries[row[a:a + _SCORES]], self.points[point[a:a + _SCORES]])
                                for a in range(0, max(len(row), 1), _SCORES)])
        out_q, out_id, out_score = [], [], []
        for r, p, s in zip(row.tolist(), point.tolist(), score.tolist()):
            own = self.ids[self.starts[p]:self.ends[p]]  # in order: k others than the query's are enough
            asked = int(query_ids[r])
            same = int(np.searchsorted(own, asked, "right") - np.searchsorted(own, asked, "left"))
            own = own[:k + same]
            for i in own[own != asked][:k].tolist():
                out_q.append(r)
                out_id.append(i)
                out_score.append(s)
        q, i, s = np.array(out_q, np.int64), np.array(out_id, np.int64), np.array(out_score)
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        near = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q[near]]), pa.array(i[near]), pa.array(s[near])],
                                          ["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, *, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            factor: float = 1.0, shard_rows: int = 16384, block: int = 512, leaf: int = 64) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine) of the nearest rows found
    for the rows where ``queries`` holds."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    ship(rows.sparkSession)
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("asks"))
    usable = whole.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                         & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                         & F.exists("v", lambda x: x != 0))
    counts = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    length, total = (counts[0], counts[1]) if counts else (1, 0)
    usable = usable.where(F.size("v") == length)
    n_shards = max(1, -(-total // shard_rows))
    shard = F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")
    tasks = (usable.select(shard.alias("shard"), F.lit(False).alias("asks"), "id", "v").unionByName(
        usable.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v"))
        .repartition(n_shards, "shard").sortWithinPartitions("shard", "asks", "id"))

    def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(3).flatten()).reshape(-1, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, shard = None, None
        for batch in batches:  # of each shard its rows, then the queries
            shards, asks = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            ids, vectors = np.asarray(batch.column(2)), vectors_of(batch)
            for number in np.unique(shards):
                if now != number:
                    held, shard, now = [], None, number
                rows_here = (shards == number) & ~asks
                if rows_here.any():
                    held.append((ids[rows_here], vectors[rows_here]))
                asked = np.flatnonzero((shards == number) & asks)
                if len(asked) and shard is None:
                    shard = Shard(*(np.concatenate(x) for x in zip(*held)), leaf) if held else None
                    held = []
                for at in range(0, len(asked) if shard else 0, block):
                    chosen = asked[at:at + block]
                    yield shard.answer(ids[chosen], vectors[chosen], k, factor)

    found = tasks.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
