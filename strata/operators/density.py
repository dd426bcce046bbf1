"""DBSCAN on 2-D points, for one or many settings at once.

Points lie in grid cells with a diagonal just below ``eps``: points of one cell are neighbours, so a
cell with ``min_samples`` points is core without a distance, and core points of one cell are one
cluster.  Everything else is between a cell and the cells around it, and a crowded cell is
a *quadtree* there: boxes with their number of points and true bounds, down to boxes of ``LEAF``
points.

* A point of a thin cell counts its neighbours box by box: a box wholly within ``eps`` counts as a
  whole, one wholly beyond not at all, and only boxes that the circle cuts are opened.
* Two cells are linked if any two of their core points are within ``eps``: pairs of boxes wholly
  within ``eps``, or with two such representatives, link them at once and end the search, pairs
  beyond are dropped, and only undecided pairs are opened.

Thin cells have fewer than ``min_samples`` points, so the work is linear in the points, whatever share
of them one cell holds; points at the same place are one point with a weight.  Clusters are the
connected components of the linked cells, by propagation of least labels with pointer jumping;
border points take the least neighbouring cluster; the rest is noise (-1).  Settings (pairs of ``eps``
and ``min_samples``) are a key of all tables, so many run in the joins of one.  The tables of each step are
written to a ``Scratch`` folder, so no round's plan carries anything of the rounds before.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import Scratch, cut_lineage

#: Points of a box that is not opened any further, and how often a cell can be halved.
LEAF, HALVINGS = 32, 26
_CELL = ["s", "cx", "cy"]
_BOX = [*_CELL, "level", "bx", "by"]
_AROUND = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0)]


def _shift(c: Column, by: int) -> Column:
    return F.shiftright(c, by) if by else c


def grid(df: DataFrame, x: str, y: str, key: str, settings: Sequence[tuple[float, int]]) -> DataFrame:
    """Distinct places with weight ``w`` and least ``id``, once per setting ``s``, with their cell (``cx``, ``cy``) and
    place in the cell (``fx``, ``fy``).  Places that are null or NaN take no part."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    places = (df.select(F.col(key).alias("id"), px.alias("x"), py.alias("y"))
              .where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
              .groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("w")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.lit(float(e)).alias("eps"), F.lit(int(m)).alias("m"),
                                        F.lit(e / math.sqrt(2.0) * (1 - 1e-9)).alias("side"))
                               for k, (e, m) in enumerate(settings)]))
    cut = places.select("*", each.alias("o")).select("o.s", "o.eps", "o.m", "id", "x", "y", "w",
                                                     (F.col("x") / F.col("o.side")).alias("gx"), (F.col("y") / F.col("o.side")).alias("gy"))

    def fine(g: str) -> Column:
        f = F.floor((F.col(g) - F.floor(g)) * (1 << HALVINGS))
        return F.least(f, F.lit((1 << HALVINGS) - 1)).cast("long")

    return cut.select("s", "eps", "m", "id", "x", "y", "w", F.floor("gx").alias("cx"), F.floor("gy").alias("cy"),
                      fine("gx").alias("fx"), fine("gy").alias("fy"))


def quadtree(points: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Boxes of each level, from whole cells down, and the points of the boxes that are leaves.  A box has
    ``n`` (weight), ``leaf``, its bounds, and a representative point."""
    zero = F.lit(0).cast("long")
    alive = points.select(*_CELL, "fx", "fy", "x", "y", "w", F.lit(0).alias("level"), zero.alias("bx"), zero.alias("by"))
    levels, leaves = [], []
    while True:
        boxes = scratch.write(alive.groupBy(*_BOX).agg(
            F.sum("w").alias("n"), (F.count("*") <= (LEAF if len(levels) < HALVINGS else 1 << 62)).alias("leaf"),
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.min(F.struct("x", "y")).alias("rep")))
        levels.append(boxes)
        leaves.append(alive.join(boxes.where("leaf").select(*_BOX), _BOX).select(*_BOX, "x", "y", "w"))
        full = boxes.where("NOT leaf")
        if full.isEmpty():
            break
        down = HALVINGS - len(levels)
        alive = scratch.write(alive.join(full.select(*_BOX), _BOX).withColumns({
            "level": F.lit(len(levels)), "bx": _shift(F.col("fx"), down), "by": _shift(F.col("fy"), down)}))
    return levels, scratch.write(_union(leaves))


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def _reach(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.abs(b1 - a0), F.abs(a1 - b0))


def _quarters(level: DataFrame) -> DataFrame:
    """Boxes with the place (``ox``, ``oy``) of the box that they are a quarter of."""
    return level.withColumn("ox", F.shiftright("bx", 1)).withColumn("oy", F.shiftright("by", 1))


def near_cells(probe: DataFrame, tree: tuple[list[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """For each point of ``probe`` and each *other* cell with tree points within eps: ``s``, ``id``, ``cx``, ``cy`` and the
    weight ``n`` of these points."""
    levels, leaves = tree
    x, y, zero = F.col("px"), F.col("py"), F.lit(0).cast("long")
    at = probe.select("s", "eps", "id", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.array(*[
        F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in _AROUND])).alias("o"))
    at = at.select("s", "eps", "id", "px", "py", "o.cx", "o.cy", F.lit(0).alias("level"), zero.alias("bx"), zero.alias("by"))
    eps2, whole, cut = F.col("eps") * F.col("eps"), [], []
    for k, boxes in enumerate(levels):
        met = at.join(boxes, _BOX)
        gx, gy = _gap(x, x, F.col("x0"), F.col("x1")), _gap(y, y, F.col("y0"), F.col("y1"))
        rx, ry = _reach(x, x, F.col("x0"), F.col("x1")), _reach(y, y, F.col("y0"), F.col("y1"))
        met = scratch.write(met.where(gx * gx + gy * gy <= eps2).select(
            *_BOX, "eps", "id", "px", "py", "n", "leaf", (rx * rx + ry * ry <= eps2).alias("whole")))
        whole.append(met.where("whole").select("s", "id", "cx", "cy", "n"))
        cut.append(met.where("leaf AND NOT whole").select(*_BOX, "eps", "id", "px", "py"))
        if k + 1 < len(levels):
            at = met.where("NOT leaf AND NOT whole").select(*_CELL, F.col("bx").alias("ox"), F.col("by").alias("oy"), "eps", "id", "px", "py")
            at = at.join(_quarters(levels[k + 1]).select(*_BOX, "ox", "oy"), [*_CELL, "ox", "oy"]).drop("ox", "oy")
    d2 = (x - F.col("x")) * (x - F.col("x")) + (y - F.col("y")) * (y - F.col("y"))
    single = _union(cut).join(leaves, _BOX).where(d2 <= eps2).select("s", "id", "cx", "cy", F.col("w").alias("n"))
    return _union([*whole, single]).groupBy("s", "id", "cx", "cy").agg(F.sum("n").alias("n"))


def linked_cells(tree: tuple[list[DataFrame], DataFrame], eps: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of different cells (``s``, ``cx``, ``cy``, ``dx``, ``dy``, the second being ``cx + dx``, ``cy + dy``) that have
    two points within eps.  ``eps``: ``s``, ``eps``."""
    levels, leaves = tree
    side = ["level", "bx", "by", "leaf", "x0", "x1", "y0", "y1", "rep"]

    def named(end: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{end}") for c in side]

    pair, eps2, cells = [*_CELL, "dx", "dy"], F.col("eps") * F.col("eps"), levels[0]
    step = F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"))
                               for dx, dy in _AROUND if (dx, dy) > (0, 0)]))
    second = [(F.col("cx") + F.col("dx")).alias("ex"), (F.col("cy") + F.col("dy")).alias("ey")]
    at = cells.select(*_CELL, *named("a"), step.alias("o")).select("*", "o.*").drop("o").select("*", *second)
    at = at.join(cells.select("s", F.col("cx").alias("ex"), F.col("cy").alias("ey"), *named("b")), ["s", "ex", "ey"])
    at = at.drop("ex", "ey").join(F.broadcast(eps), "s")
    known, open_pairs = None, []
    for k in range(len(levels)):
        gx, gy = (_gap(*[F.col(f"{c}{i}_{e}") for e in "ab" for i in "01"]) for c in "xy")
        rx, ry = (_reach(*[F.col(f"{c}{i}_{e}") for e in "ab" for i in "01"]) for c in "xy")
        ux, uy = F.col("rep_a.x") - F.col("rep_b.x"), F.col("rep_a.y") - F.col("rep_b.y")
        met = scratch.write(at.where(gx * gx + gy * gy <= eps2).withColumn(
            "linked", (rx * rx + ry * ry <= eps2) | (ux * ux + uy * uy <= eps2)))
        now = met.where("linked").select(*pair)
        known = scratch.write((now if known is None else known.unionByName(now)).distinct())
        rest = met.where("NOT linked").drop("linked").join(known, pair, "left_anti")
        open_pairs.append(rest.where("leaf_a AND leaf_b").select(*pair, "eps", "level_a", "bx_a", "by_a", "level_b", "bx_b", "by_b"))
        if k + 1 == len(levels):
            break
        at = rest.where("NOT (leaf_a AND leaf_b)")
        below = _quarters(levels[k + 1])
        for end, x, y in (("a", F.col("cx"), F.col("cy")), ("b", F.col("cx") + F.col("dx"), F.col("cy") + F.col("dy"))):
            quarters = below.select("s", F.col("cx").alias("qx"), F.col("cy").alias("qy"), "ox", "oy", *named(end))
            opened = at.where(f"NOT leaf_{end}").withColumns({"qx": x, "qy": y, "ox": F.col(f"bx_{end}"), "oy": F.col(f"by_{end}")})
            opened = opened.drop(*[f"{c}_{end}" for c in side]).join(quarters, ["s", "qx", "qy", "ox", "oy"])
            at = at.where(f"leaf_{end}").unionByName(opened.drop("qx", "qy", "ox", "oy"))
    ends = leaves.drop("w")
    one = _union(open_pairs).join(known, pair, "left_anti").withColumnsRenamed({"level_a": "level", "bx_a": "bx", "by_a": "by"})
    one = one.join(ends.withColumnsRenamed({"x": "xa", "y": "ya"}), _BOX).select(
        *pair, *second, "eps", "xa", "ya", F.col("level_b").alias("level"), F.col("bx_b").alias("bx"), F.col("by_b").alias("by"))
    two = one.join(ends.withColumnsRenamed({"cx": "ex", "cy": "ey"}), ["s", "ex", "ey", "level", "bx", "by"])
    d2 = (F.col("xa") - F.col("x")) * (F.col("xa") - F.col("x")) + (F.col("ya") - F.col("y")) * (F.col("ya") - F.col("y"))
    return known.unionByName(two.where(d2 <= eps2).select(*pair).distinct())


def least_labels(nodes: DataFrame, edges: DataFrame, scratch: Scratch, max_iter: int | None = None) -> DataFrame:
    """``s``, ``id``, ``label``: the least id that can be reached over ``edges`` (``s``, ``id``, ``nid``, both ways)."""
    labels = scratch.write(nodes.select("s", "id", F.col("id").alias("label")))
    edges = scratch.write(edges.select("s", "id", "nid").distinct())
    for turn in itertools.count(1):
        if max_iter is not None and turn > max_iter:
            raise RuntimeError(f"labels still change after {max_iter} rounds")
        nb = (edges.join(labels.select("s", F.col("id").alias("nid"), F.col("label").alias("nl")), ["s", "nid"])
              .groupBy("s", "id").agg(F.min("nl").alias("nl")))
        hop = labels.join(nb, ["s", "id"], "left").select(
            "s", "id", F.least("label", F.coalesce("nl", "label")).alias("label"), F.col("label").alias("old"))
        parent = hop.select("s", F.col("id").alias("label"), F.col("label").alias("pl"))
        new = scratch.write(hop.join(parent, ["s", "label"], "left").select("s", "id", F.least("label", F.coalesce("pl", "label")).alias("label"), "old"))
        labels = new.select("s", "id", "label")
        if new.where("label <> old").isEmpty():
            return labels


def density_clusters(df: DataFrame, x: str, y: str, key: str, settings: Sequence[tuple[float, int]],
                     max_iter: int | None = None) -> DataFrame:
    """Places (``s``, ``x``, ``y``, ``w``) of every setting with their cluster's ``root``, its least core id (null: noise)."""
    spark = df.sparkSession
    eps = spark.createDataFrame([(k, float(e)) for k, (e, _) in enumerate(settings)], "s int, eps double")
    with Scratch(spark) as scratch:
        points = scratch.write(grid(df, x, y, key, settings))
        crowd = points.groupBy(*_CELL).agg(F.sum("w").alias("cell_n"))
        points = scratch.write(points.join(crowd, _CELL))
        with Scratch(spark) as step:
            thin = points.where(F.col("cell_n") < F.col("m"))
            degree = near_cells(thin, quadtree(points, step), step).groupBy("s", "id").agg(F.sum("n").alias("others"))
            points = scratch.write(points.join(degree, ["s", "id"], "left").withColumn(
                "core", F.col("cell_n") + F.coalesce("others", F.lit(0)) >= F.col("m")).drop("cell_n", "others"))
        core = points.where("core")
        tree = quadtree(core, scratch)
        cells = scratch.write(core.groupBy(*_CELL).agg(F.min("id").alias("id")))     # a cell is known by its least core id
        with Scratch(spark) as step:
            links = linked_cells(tree, eps, step).join(cells, _CELL).select("s", "id", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
            links = step.write(links.join(cells.withColumnRenamed("id", "nid"), _CELL).select("s", "id", "nid"))
            both = links.unionByName(links.select("s", F.col("nid").alias("id"), F.col("id").alias("nid")))
            roots = scratch.write(cells.join(least_labels(cells, both, step, max_iter), ["s", "id"]).select(*_CELL, "label"))
        border = points.where("NOT core")
        beside = near_cells(border, tree, scratch).select("s", "id", "cx", "cy").unionByName(border.select("s", "id", "cx", "cy"))
        beside = beside.join(roots, _CELL).groupBy("s", "id").agg(F.min("label").alias("root"))
        found = core.join(roots, _CELL).select("s", "id", F.col("label").alias("root")).unionByName(beside)
        return cut_lineage(points.select("s", "id", "x", "y", "w").join(found, ["s", "id"], "left"))
