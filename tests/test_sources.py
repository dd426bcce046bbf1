import os
import tempfile

import pytest

from strata.sources import files as FS


def _csv(text, name="data.csv", d=None):
    d = d or tempfile.mkdtemp(prefix="strata-test-")
    path = os.path.join(d, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_load_csv_counts_and_sql(spark):
    path = _csv("a,b\n1,4\n2,5\n3,6\n")
    assert FS.load_csv(spark, "t_ab", path, "a int, b int") == 3
    assert FS.sql(spark, "SELECT SUM(a) AS s FROM t_ab").first()["s"] == 6
    assert "t_ab" in FS.tables(spark)


def test_load_csv_skips_bad_rows(spark):
    path = _csv("a,b\n1,4\nx,5\n3,6\n")
    assert FS.load_csv(spark, "t_bad", path, "a int, b int") == 2


def test_missing_csv_raises(spark):
    with pytest.raises(FileNotFoundError):
        FS.load_csv(spark, "nope", "/nonexistent/file.csv")


def test_find_file(spark):
    d = tempfile.mkdtemp(prefix="strata-find-")
    with pytest.raises(FileNotFoundError):
        FS.find_file(spark, d)
    for n in ("other.csv", "Data.csv"):
        _csv("a\n1\n", n, d)
    os.makedirs(os.path.join(d, "below"))
    _csv("a\n1\n", "deep.csv", os.path.join(d, "below"))
    assert FS.find_file(spark, d, "data.csv").endswith("Data.csv")
    assert FS.find_file(spark, d, "oth").endswith("other.csv")
    assert FS.find_file(spark, d, "missing.csv").endswith("Data.csv")
    assert FS.find_file(spark, d, "deep").endswith("below/deep.csv")


def test_renames_of_one_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Tenure", " Tenure Months ", "Flag"])
    assert FS.normalize_columns(df).columns == ["Tenure", "tenure", "Flag"]
    assert FS.normalize_columns(df.select("Tenure")).columns == ["tenure"]
    assert FS.normalize_columns(df.select("Flag"), FS.RATIO_RENAMES).columns == ["Bankrupt?"]


def test_normalize_and_label(spark):
    df = spark.createDataFrame([(1, 20.5, "Yes", 1)], ["CustomerID ", "Monthly Charges", "Churn Label", "Churn Value"])
    out = FS.derive_label(FS.normalize_columns(df))
    assert {"customerID", "MonthlyCharges", "Churn"} <= set(out.columns)
    assert out.first()["Churn"] == "Yes"
    df2 = spark.createDataFrame([(0,)], ["Churn Value"])
    assert FS.derive_label(df2).first()["Churn"] == "No"
    assert FS.underscore_columns(spark.createDataFrame([(1,)], ["a b"])).columns == ["a_b"]


def test_encoding_fallback(spark):
    d = tempfile.mkdtemp(prefix="strata-enc-")
    path = os.path.join(d, "latin.csv")
    with open(path, "wb") as f:
        f.write("name,v\ncaf\xe9,1\n".encode("latin-1"))
    df = FS.read_csv_encoding(spark, path, "name string, v int")
    assert df.first()["name"] == "café"


def test_write_csv_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="strata-w-")
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    FS.write_csv(df, os.path.join(d, "out"))
    assert FS.read_csv(spark, os.path.join(d, "out"), "a int, b string").count() == 1


def test_load_two_table(spark):
    d = tempfile.mkdtemp(prefix="strata-two-")
    train = _csv("date,weight,resp,feature_0\n1,0.5,0.1,2.0\n2,0.0,-0.2,1.0\n", "train.csv", d)
    meta = _csv("feature,tag_0\nfeature_0,True\n", "features.csv", d)
    t, m = FS.load_two_table(spark, train, meta, "date int, weight double, resp double, feature_0 double")
    assert t.count() == 2 and m.count() == 1 and t.schema["date"].dataType.simpleString() == "int"
