"""Exact nearest-neighbour search.

The corpus lies in Voronoi *cells* around pivots, points of the corpus drawn by a hash, at most
``max_cells``.  Of each cell its radius and its smallest distances from the pivot are known, which
bounds what it can hold:

* a query's distance to a pivot plus a member's distance to it is an upper bound for a neighbour;
* the distance to a pivot less the cell's radius, and the distance to the plane between the query's own
  pivot and another one, are lower bounds for all members of the other cell.

A query first visits the cell of its nearest pivot.  The k-th distance found there, or the upper bound from
the pivots where that is smaller, is its limit, and then it visits only the other cells whose lower bound is
within the limit.  So the corpus is shuffled once per visit round, and queries go where a neighbour can
be; the result is exact.  In many dimensions without clusters the bounds rule out little, and all cells
are visited.

Many queries visit *regions*, cells that lie near each other, in blocks of bounded bytes: a query is sent once
to a region with an open cell, not once to each cell, so where all cells are open the rows sent grow as
queries times corpus over the block size, and what a task holds doesn't grow.  In a block each query is compared only
with the cells that are still open to it, its limit falling as it finds neighbours: a matrix product in
single precision with its error bound leaves the few pairs whose exact distance is then taken.  Few
queries visit cells one by one.  Of equal vectors only as many with the smallest ids are kept as a result
can hold, and equal queries are answered once, so no group of copies is compared with itself.

Cells can be written as an index, partitioned by cell: a search then reads the files of the cells it visits.

Distances are squared Euclidean (what a flat L2 index reports), from exact
differences.  Ties are broken by corpus id; all ties with the k-th are compared.
Rows without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.session import cut_lineage

MAX_CELLS = 4096
#: Corpus points per cell, as long as there are not too many cells.
CELL_ROWS = 512
#: A block's points or queries: bytes of their vectors, rows, and blocks that a search has at least (as long as they hold LEAST_ROWS).
BLOCK_BYTES, BLOCK_ROWS, LEAST_BLOCKS, LEAST_ROWS = 32 << 20, 65536, 8, 4096
#: Rows of queries that are sent to single cells; beyond, they are sent to regions.
SENT_ROWS = 1_000_000
CHUNK_VALUES = 2_000_000     # coordinates or distances held at a time
SLACK = 1e-9                 # for rounding in the bounds


@dataclass
class Cells:
    """Pivots of a corpus and what is known of their cells; as large as ``max_cells`` allows."""

    pivots: np.ndarray    # by cell
    radius: np.ndarray
    first: np.ndarray     # smallest distances from the pivot, inf where there are fewer

    def distances(self, v: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Distances of vectors to all pivots (or those of ``which`` cells), from differences."""
        pivots = self.pivots[which]
        out = np.empty((len(v), len(pivots)))
        step = max(1, CHUNK_VALUES // max(1, pivots.size))
        for at in range(0, len(v), step):
            diff = v[at:at + step, None, :] - pivots[None, :, :]
            out[at:at + step] = np.sqrt(np.einsum("qcd,qcd->qc", diff, diff))
        return out

    def slices(self, n: int, each: int = 1) -> Iterator[slice]:
        """Slices of ``n`` vectors for which ``each`` numbers per pivot can be held."""
        step = max(1, CHUNK_VALUES // max(1, len(self.pivots) * each))
        return (slice(at, at + step) for at in range(0, n, step))

    def open_to(self, v: np.ndarray, own: np.ndarray, limit: np.ndarray, between: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distances of vectors of the cells ``own`` to members of the cells ``which``, and those that are within
        ``limit``; a vector's own cell isn't open.  ``between``: distances of all pivots to those of ``which``."""
        d = self.distances(v, which)
        home = v - self.pivots[own]
        nearest = np.sqrt(np.einsum("qd,qd->q", home, home))[:, None]
        apart = between[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (d * d - nearest * nearest) / (2 * apart), 0.0)
        least = np.maximum(d - self.radius[None, which], plane) - SLACK * (1 + d + np.where(np.isfinite(limit), limit, 0)[:, None])
        return least, (least <= limit[:, None]) & (which[None, :] != own[:, None])

    def regions(self, rows: np.ndarray, most: int, least: int) -> np.ndarray:
        """Region of every cell: cells halved by the widest coordinate until a part has at most ``most`` of the
        ``rows`` (a cell's own more apart), but ``least`` regions, or all cells, at least."""
        region, parts = np.zeros(len(self.pivots), np.int32), [np.arange(len(self.pivots))]
        most = min(most, max(1, int(rows.sum()) // max(1, least)))
        done = 0
        while parts:
            part = parts.pop()
            if len(part) > 1 and rows[part].sum() > most:
                x = self.pivots[part]
                part = part[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
                mid = int(np.searchsorted(np.cumsum(rows[part]), rows[part].sum() / 2)) + 1
                mid = min(max(mid, 1), len(part) - 1)
                parts += [part[mid:], part[:mid]]
            else:
                region[part] = done
                done += 1
        return region


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _squares(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs ``a[i]``, ``b[j]``, from differences: the dot-product form cancels far from
    the origin."""
    out = np.empty(len(i))
    step = max(1, CHUNK_VALUES // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        diff = a[i[at:at + step]] - b[j[at:at + step]]
        out[at:at + step] = np.einsum("nd,nd->n", diff, diff)
    return out


class _Nearest:
    """The ``k`` nearest points found so far of every query of a block, by (distance, id)."""

    def __init__(self, vectors: np.ndarray, limit: np.ndarray, k: int):
        self.v, self.k, self.limit2 = vectors, k, limit * limit * (1 + SLACK)
        self.d = np.full((len(vectors), k), np.inf)
        self.id = np.full((len(vectors), k), np.iinfo(np.int64).max)

    def within(self) -> np.ndarray:
        """Squared distance that a new neighbour can have at most."""
        return np.fmin(self.limit2, self.d[:, -1])

    def offer(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray) -> None:
        """Compare queries ``rows`` with all of ``points``, by slices of bounded size."""
        if not len(rows):
            return
        middle = points.mean(axis=0)
        p = points - middle
        p2 = np.einsum("nd,nd->n", p, p)
        span = float(p2.max(initial=0.0))
        with np.errstate(over="ignore", invalid="ignore"):
            right = np.concatenate([p, -p2[:, None] / 2], axis=1).astype(np.float32).T.copy()
        step = max(1, CHUNK_VALUES // len(points))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            q = self.v[some] - middle
            q2 = np.einsum("nd,nd->n", q, q)
            # of the products in single precision, from below: |q||p| and |p|^2/2, each with its rounding errors
            error = (q.shape[1] + 8) * 2.0 ** -23 * (np.sqrt(q2 * span) + span + q2) + np.finfo(np.float32).tiny * q.shape[1]
            if not np.isfinite(error).all() or error.max(initial=0.0) > 1e30:
                near = np.ones((len(some), len(p)), bool)      # beyond single precision
            else:
                left = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(np.float32)
                product = left @ right                           # |q|^2/2 less half the squared distance
                least = (q2 - self.within()[some]) / 2 - error
                near = product >= least.astype(np.float32)[:, None] if np.isfinite(least).all() else None
                if len(p) > self.k and (near is None or np.count_nonzero(near) > 4 * self.k * len(some)):
                    # the k-th product is of a point that is at most so far away
                    kth = np.partition(product, len(p) - self.k, axis=1)[:, len(p) - self.k]
                    least = np.fmax(least, kth - 2 * error)
                    near = None
                if near is None:
                    near = product >= least.astype(np.float32)[:, None]
            i, j = np.nonzero(near)
            self._merge(some[i], _squares(self.v, some[i], points, j), ids[j])

    def _merge(self, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        better = d <= self.within()[row]
        row, d, ids = row[better], d[better], ids[better]
        if not len(row):
            return
        touched, at = np.unique(row, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        d = np.concatenate([self.d[touched].ravel(), d])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, d, row))
        starts = np.searchsorted(row[order], np.arange(len(touched)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.d[touched], self.id[touched] = d[best], ids[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


_FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])


def _search_block(cells: Cells, k: int, at_home: bool):
    """The ``k`` nearest points of each query of a block, in its own cell or in the others that are open."""
    def fn(table: pa.Table) -> pa.Table:
        asked = table["role"].to_numpy() == 0
        queries, points = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        if not len(queries) or not len(points):
            return _FOUND.empty_table()
        Q, C = _matrix(queries["v"]), _matrix(points["v"])
        qid, cid = (x["id"].fill_null(np.iinfo(np.int64).min).to_numpy() for x in (queries, points))
        own, limit = queries["cell"].to_numpy(), queries["bound"].to_numpy()
        of = points["cell"].to_numpy()
        order = np.argsort(of, kind="stable")
        here, starts = np.unique(of[order], return_index=True)
        members = np.split(order, starts[1:])
        best = _Nearest(Q, limit, k)
        between = None if at_home else cells.distances(cells.pivots, here)
        step = len(Q) if at_home else max(1, CHUNK_VALUES // len(here))
        for at in range(0, len(Q), step):
            some = np.arange(at, min(at + step, len(Q)))
            if not at_home:
                least, open_ = cells.open_to(Q[some], own[some], limit[some], between, here)
            for c, rows in enumerate(members):
                if at_home:
                    now = some
                else:
                    reach = np.where(least[:, c] > 0, least[:, c], 0.0)
                    now = some[open_[:, c] & (reach * reach <= best.within()[some] * (1 + SLACK))]
                for lo in range(0, len(rows), CELL_ROWS):
                    part = rows[lo:lo + CELL_ROWS]
                    best.offer(now, C[part], cid[part])
        row, n = np.nonzero(np.isfinite(best.d))
        return pa.Table.from_arrays([pa.array(qid[row]), pa.array(best.id[row, n]), pa.array(best.d[row, n])], schema=_FOUND)
    return fn


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")).where("v IS NOT NULL")


def build_cells(corpus: DataFrame, want: int, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Cells]:
    """``(id, v, cell)`` of the corpus ``(id, v)``, at most ``want`` points of each vector, and the cells."""
    copies = Window.partitionBy("v").orderBy("id")
    points = cut_lineage(_vectors(corpus).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= want).drop("_n"))
    n = min(max_cells, max(1, -(-points.count() // cell_rows)))
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(n).collect()          # at most max_cells vectors
    pivots = np.unique(np.array([r["v"] for r in drawn], np.float64), axis=0) if drawn else np.empty((0, 0))
    cells = Cells(pivots, np.zeros(len(pivots)), np.full((len(pivots), want), np.inf))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v, cell, away = _stack(pdf["v"]), np.empty(len(pdf), np.int32), np.empty(len(pdf))
                for part in cells.slices(len(v)):
                    d = cells.distances(v[part])
                    cell[part], away[part] = d.argmin(axis=1), d.min(axis=1)
                yield pdf.assign(cell=cell, away=away)

    placed = cut_lineage(points.mapInPandas(assign, "id long, v array<double>, cell int, away double"))
    near = placed.withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("away"))).where(F.col("_n") <= want)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r")).collect():     # one row per cell
        cells.radius[r["cell"]] = r["r"]
    for r in near.select("cell", "_n", "away").collect():                         # ``want`` rows per cell
        cells.first[r["cell"], r["_n"] - 1] = r["away"]
    return placed.drop("away"), cells


def _compare(routes: DataFrame, points: DataFrame, cells: Cells, k: int, block_rows: int, at_home: bool) -> DataFrame:
    """The ``k`` nearest points of each (query, region) of ``routes``, by groups of blocks."""
    blocks = (routes.groupBy("region").agg(F.ceil(F.count("*") / block_rows).alias("nq"))
              .join(points.groupBy("region").agg(F.ceil(F.count("*") / block_rows).alias("nc")), "region"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n))                           # noqa: E731
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    row = ["id", "v", "cell", "bound", "region"]
    qs = routes.join(blocks, "region").select(F.lit(0).alias("role"), *row, mine("nq").alias("qb"), every("nc").alias("cb"))
    cs = points.withColumn("bound", F.lit(0.0)).join(blocks, "region").select(F.lit(1).alias("role"), *row, every("nq").alias("qb"), mine("nc").alias("cb"))
    return qs.unionByName(cs).groupBy("region", "qb", "cb").applyInArrow(_search_block(cells, k, at_home), schema="qid long, id long, dist double")


def search_cells(queries: DataFrame, points: DataFrame, cells: Cells, k: int, exclude_self: bool = False,
                 block_rows: int | None = None) -> DataFrame:
    """The exact ``k`` nearest points of every query ``(id, v)``: ``(qid, id, rank, dist)``, rank from 1.
    ``block_rows``: queries or points of a block, if not by their bytes."""
    want = k + exclude_self
    if want > cells.first.shape[1]:
        raise ValueError(f"these cells are made for {cells.first.shape[1]} neighbours, not {want}")
    asked = _vectors(queries)
    once = cut_lineage(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(cells.pivots):
                v, cell, bound = _stack(pdf["v"]), np.empty(len(pdf), np.int32), np.empty(len(pdf))
                for part in cells.slices(len(v), want):
                    d = cells.distances(v[part])
                    ends = (d[:, :, None] + cells.first[None, :, :want]).reshape(len(d), -1)
                    cell[part], bound[part] = d.argmin(axis=1), np.partition(ends, want - 1, axis=1)[:, want - 1]
                yield pdf.assign(cell=cell, bound=bound)

    schema = "id long, v array<double>, cell int, bound double"
    routes = cut_lineage(once.mapInPandas(home, schema))
    most = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, cells.pivots[:1].size))))
    points_here = points.where(F.col("cell").isin(_visited(routes))).withColumn("region", F.col("cell"))
    first = cut_lineage(_best(_compare(routes.withColumn("region", F.col("cell")), points_here, cells, want, most, True), want))
    kth = first.where(F.col("rank") == want).select(F.col("qid").alias("id"), F.sqrt("dist").alias("kth"))
    n_queries, region = routes.count(), np.arange(len(cells.pivots), dtype=np.int32)
    if n_queries * len(region) > SENT_ROWS:
        rows = np.zeros(len(region), np.int64)
        for r in points.groupBy("cell").count().collect():                        # one row per cell
            rows[r["cell"]] = r["count"]
        if not block_rows:
            most = max(min(most, LEAST_ROWS), min(most, int(max(n_queries, rows.sum())) // LEAST_BLOCKS))
        region = cells.regions(rows, most, SENT_ROWS // n_queries)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, every, between = np.argsort(region, kind="stable"), np.arange(len(region)), cells.distances(cells.pivots)
        starts = np.searchsorted(region[order], np.arange(region.max(initial=-1) + 1))
        for pdf in batches:
            if not len(pdf):
                continue
            v, own, limit = _stack(pdf["v"]), pdf["cell"].to_numpy(), pdf["bound"].to_numpy()
            for part in cells.slices(len(v)):
                _, open_ = cells.open_to(v[part], own[part], limit[part], between, every)
                row, to = np.nonzero(np.logical_or.reduceat(open_[:, order], starts, axis=1))
                step = max(1, CHUNK_VALUES // v.shape[1])
                for at in range(0, len(row), step):
                    yield pdf.iloc[part].iloc[row[at:at + step]].assign(region=to[at:at + step].astype(np.int32))

    again = cut_lineage(routes.join(kth, "id", "left").select("id", "v", "cell", F.least("bound", "kth").alias("bound"))
                        .mapInPandas(others, schema + ", region int"))
    visited = set(_visited(again.select(F.col("region").alias("cell"))))
    points_there = points.where(F.col("cell").isin([c for c, r in enumerate(region.tolist()) if r in visited]))
    one_by_one = F.col("cell") if (region == np.arange(len(region))).all() else F.element_at(F.lit(region.tolist()), F.col("cell") + 1)
    points_there = points_there.withColumn("region", one_by_one)
    second = _compare(again, points_there, cells, want, most, False)
    found = _best(first.drop("rank").unionByName(second), want)
    both = asked.join(once.withColumnRenamed("id", "rep"), "v").select("id", "rep")
    out = both.select(F.col("id").alias("_q"), F.col("rep").alias("qid")).join(found.drop("rank"), "qid").select(F.col("_q").alias("qid"), "id", "dist")
    out = _best(out.where("id <> qid") if exclude_self else out, k)
    return out.select("qid", "id", F.col("rank").cast("int").alias("rank"), "dist")


def _visited(routes: DataFrame) -> list[int]:
    """Cells that are visited: at most as many as there are pivots."""
    return [r["cell"] for r in routes.select("cell").distinct().collect()]


def knn_points(queries: DataFrame, corpus: DataFrame, k: int = 5, exclude_self: bool = False,
               block_rows: int | None = None, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact kNN.  ``queries``/``corpus``: ``(id long, v array<double>)``, ids unique.
    Returns ``(qid, id, rank, dist)`` with rank 1..k."""
    points, cells = build_cells(corpus, k + exclude_self, max_cells, cell_rows)
    return search_cells(queries, points, cells, k, exclude_self, block_rows)


def vector_index(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` with double vectors: what is indexed."""
    return df.select(F.col(id_col).cast("long").alias("id"),
                     F.transform(vec_col, lambda x: x.cast("double")).alias("v"))


def write_index(corpus: DataFrame, path: str, most: int = 100, max_cells: int = MAX_CELLS, cell_rows: int = CELL_ROWS) -> None:
    """Write ``(id, v)`` as an index for searches of up to ``most`` neighbours: points by cell, and the cells."""
    spark = corpus.sparkSession
    points, cells = build_cells(corpus, most, max_cells, cell_rows)
    spread = F.pmod(F.xxhash64("id"), F.lit(16))      # a crowded cell is written by several tasks
    points.repartition("cell", spread).write.partitionBy("cell").parquet(f"{path}/points")
    rows = [(k, p.tolist(), float(r), f.tolist()) for k, (p, r, f) in enumerate(zip(cells.pivots, cells.radius, cells.first))]
    spark.createDataFrame(rows, "cell int, pivot array<double>, radius double, first array<double>").write.parquet(f"{path}/cells")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    """Points (partitioned by cell, read when visited) and cells of an index."""
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])     # one row per cell
    most = len(rows[0]["first"]) if rows else 1
    cells = Cells(np.array([r["pivot"] for r in rows], np.float64) if rows else np.empty((0, 0)), np.array([r["radius"] for r in rows]),
                  np.array([r["first"] for r in rows]).reshape(len(rows), most))
    points = spark.read.schema("id long, v array<double>, cell int").parquet(f"{path}/points")
    return points, cells


def label_centroids(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Mean vector per label ``(id=label, v)`` - a query batch derived from the data
    (bounded by the number of labels).  Element-wise mean via ``posexplode``
    and a grouped average (partial aggregation map-side)."""
    long = df.select(label_col, F.posexplode(vec_col).alias("i", "x"))
    means = long.groupBy(label_col, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col(label_col).cast("long").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_s")) \
        .select("id", F.transform("_s", lambda s: s["m"]).alias("v"))


def vector_topk(queries: DataFrame, index: tuple[DataFrame, Cells], k: int = 5, digits: int = 6) -> DataFrame:
    """The ``k`` nearest points of an index (as ``read_index`` or ``build_cells`` gives it)."""
    r = search_cells(queries, *index, k)
    return r.select("qid", "id", "rank", round_half_up("dist", digits).alias("dist"))


def knn_classify(train: DataFrame, test: DataFrame, k: int = 7) -> DataFrame:
    """Majority vote of the k nearest training rows; ties -> smallest label.
    ``train``: (id, v, label); ``test``: (id, v).  Returns (id, prediction)."""
    nn = knn_points(test.select("id", "v"), train.select("id", "v"), k)
    votes = (nn.join(train.select("id", "label"), "id")
             .groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n")))
    return votes.groupBy(F.col("qid").alias("id")).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"))


def rag_context(hits: DataFrame, texts: DataFrame, question: DataFrame | None = None,
                sep: str = "\n") -> DataFrame:
    """Prompt string per query: retrieved texts in rank order joined by
    newline, then the question.  ``hits``: (qid, id, rank); ``texts``: (id, text)."""
    j = hits.join(texts, "id")
    ctx = j.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    ctx = ctx.select("qid", F.array_join(F.transform("_c", lambda s: s["text"]), sep).alias("context"))
    if question is not None:
        ctx = ctx.join(question, "qid", "left")
        return ctx.select("qid", F.format_string("Context:\n%s\n\nQuestion: %s\nAnswer:",
                                                 F.col("context"), F.col("question")).alias("prompt"))
    return ctx
