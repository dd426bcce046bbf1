import hashlib

from pyspark.sql import functions as F

from strata.operators import sampling as S


def _draw(key):
    return hashlib.md5(f"{key}#42".encode()).hexdigest() + str(key)


def test_split_and_folds_by_slices_equal_a_sort_of_each_class(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICES", 7)          # slices of hundreds of rows
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("y"))
    got = {r["id"]: r for r in S.split_and_folds(df, "y", "id", 0.2, 5, 42).collect()}
    for of in (None, 0, 1, 2):
        ids = sorted((i for i in range(3000) if (None if i % 10 == 0 else i % 3) == of), key=_draw)
        n_test = int(len(ids) * 0.2 + 0.5)
        for rank, i in enumerate(ids):
            assert (got[i]["is_test"], got[i]["fold"], got[i]["y"]) == (rank < n_test, rank % 5, of)


def test_rows_are_exchanged_once(spark):
    df = spark.range(20000).select("id", (F.col("id") % 2).alias("y"), F.lit("x").alias("payload"))
    out = S.stratified_split(df, "y", "id")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and out.where("is_test").count() == 4000
