"""Cases in which rows were lost or wrong at scale: each must hold for any size."""
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from strata.functions.numeric import round_half_up
from strata.operators import cluster, evaluate, features, models, orderstats, retrieve, stats
from strata.streaming import core


def test_stream_reads_a_folder_and_a_file(spark, tmp_path):
    rows = spark.range(1000).withColumn("ts", F.timestamp_seconds("id"))
    rows.repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    rows.repartition(1).write.parquet(str(tmp_path / "one"))
    part = next(f for f in os.listdir(tmp_path / "one") if f.startswith("part-"))
    os.link(tmp_path / "one" / part, tmp_path / "single.parquet")
    for name in ("many", "single"):
        assert core.run_to_table(core.read_stream(spark, str(tmp_path), name), f"t-{name}").count() == 1000


def test_knn_ties_and_offsets(spark):
    points = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "id long, v array<double>")
    query = spark.createDataFrame([(100, [0.0, 0.0])], "id long, v array<double>")
    got = retrieve.knn_points(query, points, k=5, block_rows=7).orderBy("rank")
    assert [r["id"] for r in got.collect()] == [0, 3, 6, 9, 12]
    far = spark.createDataFrame([(i, [1e8 + i * 1e-3, 1e8]) for i in range(30)], "id long, v array<double>")
    query = spark.createDataFrame([(100, [1e8, 1e8])], "id long, v array<double>")
    assert [r["id"] for r in retrieve.knn_points(query, far, k=5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("minority", [1, 4])
def test_smote_reaches_parity_with_few_rows(spark, minority):
    rows = [(i, float(i), float(i % 5), int(i < minority)) for i in range(50 + minority)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label int")
    out = features.smote(df, ["x", "y"], "label", "id", k=5)
    assert out.where("label = 1").count() == 50


def test_dbscan_follows_a_long_chain(spark):
    chain = spark.range(600).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    out = cluster.dbscan(chain, "x", "y", "id", eps=1.1, min_samples=2)
    assert out.select("cluster").distinct().count() == 1
    with pytest.raises(RuntimeError):
        cluster.dbscan(chain, "x", "y", "id", eps=1.1, min_samples=2, max_iter=2)


def test_rounding_of_large_and_negative_numbers(spark):
    row = spark.range(1).select(round_half_up(F.lit(5e13), 6).alias("a"), round_half_up(F.lit(-2.5), 0).alias("b"),
                                round_half_up(F.lit(2.5), 0).alias("c"), round_half_up(F.lit(None).cast("double"), 2).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (5e13, -3.0, 3.0, None)


def test_many_ties_do_not_overflow(spark):
    df = spark.range(4_400_000).select(F.when(F.col("id") < 4_399_990, 1.0).otherwise(F.col("id").cast("double")).alias("v"),
                                       F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    assert math.isfinite(stats.mann_whitney_u(df, "v", "g", "a", "b").first()["z"])


def test_auc_of_large_counts(spark):
    df = spark.range(2000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 10).alias("score"))
    assert 0.5 <= evaluate.roc_auc(df).first()["auc"] <= 0.51


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_of_numbers_and_strings(spark, descending):
    rows = [(i % 2, (i * 37) % 101, f"k{(i * 37) % 101:04d}", i) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, n int, s string, x long")
    for col in ("n", "s"):
        got = {(r["g"], r[col]): r["cum_x"] for r in
               orderstats.prefix_sums(df, ["g"], col, ["x"], descending=descending).collect()}
        for g in (0, 1):
            total = 0
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending):
                total += r[3]
                assert got[g, r[1] if col == "n" else r[2]] == total


def test_prefix_sums_plan_has_no_job_and_no_range_exchange(spark):
    df = spark.createDataFrame([(1, 2)], "g int, n int").withColumn("x", F.lit(1))
    plan = orderstats.prefix_sums(df, ["g"], "n", ["x"])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_too_deep_trees_are_refused():
    with pytest.raises(ValueError):
        models.estimator("decision_tree", maxDepth=500)


def test_cluster_without_a_shared_folder_is_refused():
    """A folder of the driver's own machine is no checkpoint folder for executors elsewhere."""
    from types import SimpleNamespace

    import pytest

    from strata.session import checkpoint_dir
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def _hot_points():
    """A crowded cell with repeated points, a second one close by, a ring around, strays and rows without a place."""
    rnd = random.Random(8)
    pts = [(rnd.uniform(0.02, 0.06), rnd.uniform(0.02, 0.06)) for _ in range(400)] + [(0.05, 0.05)] * 50
    pts += [(0.1 + rnd.uniform(0, 0.03), rnd.uniform(0, 0.06)) for _ in range(150)]
    pts += [(0.04 + 0.105 * math.cos(a), 0.04 + 0.105 * math.sin(a)) for a in (rnd.uniform(0, 6.3) for _ in range(60))]
    return pts + [(rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(150)]


@pytest.mark.parametrize("eps,ms", [(0.1, 5), (0.02, 30)])
def test_dbscan_of_crowded_cells_equals_brute_force(spark, monkeypatch, eps, ms):
    from strata.operators import density
    from tests.test_operators import _brute_dbscan
    monkeypatch.setattr(density, "LEAF", 8)
    pts = _hot_points()
    rows = [(i, x, y) for i, (x, y) in enumerate(pts)] + [(10_000, None, 0.0), (10_001, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "x", "y", "id", eps, ms).collect()}
    assert got.pop(10_000) == got.pop(10_001) == -1
    want = _brute_dbscan(pts, eps, ms)
    order = {r: k for k, r in enumerate(sorted({r for r in want.values() if r >= 0}))}
    assert got == {i: order.get(r, -1) for i, r in want.items()}


def test_dbscan_plans_do_not_grow_with_the_levels_of_crowded_cells(spark, monkeypatch):
    """Each round's links hold no more inferred constraints than the first's: these once filled the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from strata.operators import density
    monkeypatch.setattr(density, "LEAF", 2)
    plain, sizes = DataFrame.distinct, []

    def distinct(self):
        if self.columns == ["s", "cx", "cy", "dx", "dy"]:
            sizes.append(self._jdf.queryExecution().optimizedPlan().constraints().size())
        return plain(self)
    monkeypatch.setattr(DataFrame, "distinct", distinct)
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(0, 0.2) + i % 3 * 0.21, rnd.uniform(0, 0.2)) for i in range(60)]
    rows += [(100 + i, 5.0 + rnd.uniform(0, 0.01), 0.0) for i in range(20)] + [(200 + i, 5.307 + rnd.uniform(0, 0.01), 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    cluster.dbscan_sweep(df, "x", "y", "id", [0.3], [2]).collect()
    assert len(sizes) >= 4 and max(sizes) <= sizes[0] + 20, sizes


def _brute_nearest(points, query, k, skip=None):
    return sorted((sum((a - b) ** 2 for a, b in zip(v, query)), i) for i, v in points.items() if i != skip)[:k]


def test_neighbours_by_cells_equal_brute_force_and_visit_few(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    middles = [[rnd.uniform(-50, 50) for _ in range(3)] for _ in range(12)]
    points = {i: [m + rnd.gauss(0, 1) for m in middles[i % 12]] for i in range(1200)}
    points |= {i: [1.0, 1.0, 1.0] for i in range(2000, 2300)}     # copies, a fifth of the rows
    df = spark.createDataFrame(list(points.items()) + [(9999, None)], "id long, v array<double>")
    got = {}
    for r in retrieve.knn_points(df, df, k=4, exclude_self=True, block_rows=100, cell_rows=30).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["dist"]))
    assert set(got) == set(points)
    for i in [*range(0, 1200, 40), 2000, 2003, 2299]:
        want = _brute_nearest(points, points[i], 4, skip=i)
        assert [x[1] for x in sorted(got[i])] == [x[1] for x in want]

    path = str(tmp_path / "index")
    retrieve.write_index(df, path, most=5, cell_rows=30)
    pts, cells = retrieve.read_index(spark, path)
    asked, real = [], retrieve._visited
    monkeypatch.setattr(retrieve, "_visited", lambda routes: asked.append(real(routes)) or asked[-1])
    query = spark.createDataFrame([(1, points[0]), (2, points[12])], "id long, v array<double>")
    found = retrieve.search_cells(query, pts, cells, 3).orderBy("qid", "rank").collect()
    assert [r["id"] for r in found] == [x[1] for q in (0, 12) for x in _brute_nearest(points, points[q], 3)]
    assert len({c for a in asked for c in a}) < len(cells.pivots) / 3
    with pytest.raises(ValueError):
        retrieve.search_cells(query, pts, cells, 6)


def test_neighbours_without_clusters_are_sent_to_regions(spark, monkeypatch):
    rnd = random.Random(11)
    points = {i: [rnd.gauss(0, 1) for _ in range(12)] for i in range(900)}
    points |= {1000 + i: [1e6 + rnd.gauss(0, 1) for _ in range(12)] for i in range(60)}     # far from the origin
    df = spark.createDataFrame(list(points.items()), "id long, v array<double>")
    sent, real = [], retrieve._compare
    monkeypatch.setattr(retrieve, "_compare", lambda routes, *a: sent.append(routes.count()) or real(routes, *a))
    monkeypatch.setattr(retrieve, "SENT_ROWS", 1000, raising=False)
    got = {}
    for r in retrieve.knn_points(df, df, k=4, exclude_self=True, block_rows=150, cell_rows=8).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for i in [*range(0, 900, 30), *range(1000, 1060, 7)]:
        assert [x[1] for x in sorted(got[i])] == [x[1] for x in _brute_nearest(points, points[i], 4, skip=i)]
    assert sent[1] <= 960 * 20        # by regions; by cells a query was sent up to 120 times


def test_a_batch_of_queries_holds_few_numbers(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "CHUNK_VALUES", 500)
    rnd = random.Random(2)
    points = {i: [rnd.gauss(0, 1) for _ in range(5)] for i in range(300)}
    df = spark.createDataFrame(list(points.items()), "id long, v array<double>")
    corpus, cells = retrieve.build_cells(df, 3, cell_rows=6)
    assert all(len(range(300)[s]) * len(cells.pivots) * 3 <= 500 for s in cells.slices(300, 3))
    got = {(r["qid"], r["rank"]): r["id"] for r in retrieve.search_cells(df, corpus, cells, 3).collect()}
    assert all(got[i, n + 1] == x[1] for i in range(0, 300, 9) for n, x in enumerate(_brute_nearest(points, points[i], 3)))


def test_classifier_by_regions_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "SENT_ROWS", 100, raising=False)
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)], i % 3) for i in range(400)]
    train = spark.createDataFrame(rows[:300], "id long, v array<double>, label int")
    test = spark.createDataFrame([r[:2] for r in rows[300:]], "id long, v array<double>")
    sent, real = [], retrieve._compare
    monkeypatch.setattr(retrieve, "_compare", lambda routes, *a: sent.append(routes.count()) or real(routes, *a))
    monkeypatch.setattr(retrieve, "knn_points", lambda q, c, k, f=retrieve.knn_points: f(q, c, k, block_rows=60, cell_rows=8))
    got = {r["id"]: r["prediction"] for r in retrieve.knn_classify(train, test, k=5).collect()}
    for i, v, _ in rows[300:]:
        votes = [n % 3 for _, n in _brute_nearest({x[0]: x[1] for x in rows[:300]}, v, 5)]
        assert got[i] == min(set(votes), key=lambda c: (-votes.count(c), c))
    assert sent[1] <= 100 * 12        # by cells a query was sent up to 37 times
