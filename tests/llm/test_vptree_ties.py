"""Ties beyond the k-th place."""
from pyspark.sql import functions as F

from strata.llm import vptree


def test_scaled_copies_tie_by_id(spark):
    rows = [(i, [2.0 ** (40 - i), 2.0 ** (41 - i), 0.0]) for i in range(60)] + [(100, [1.0, 2.0, 0.5]), (200, [0.0, 0.0, 1.0])]
    rows = [(61 - i if i < 60 else i, v) for i, v in rows]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(docs, queries=F.col("vec_id").isin(100, 30), k=5, leaf=8).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [2, 3, 4, 5, 6] * 2
