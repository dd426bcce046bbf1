"""File sources and sinks, table registration, schema normalisation
(SURVEY §2.1).

CSV is read with an explicit schema where one is known (inference costs a
second scan); malformed rows are dropped (``DROPMALFORMED``) or quarantined
(``PERMISSIVE`` + corrupt-record column).  Column pruning inside the CSV
parser is switched off for those reads so a malformed row is dropped whatever
columns a query selects.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REPLACEMENT_CHAR = "�"

# Raw-file column spellings and the canonical churn names.
CHURN_RENAMES = {
    "CustomerID": "customerID",
    "Total Charges": "TotalCharges",
    "Monthly Charges": "MonthlyCharges",
    "Tenure Months": "tenure",
    "Tenure": "tenure",
}
# The label's raw and canonical name in the ratios table.
RATIO_RENAMES = {"Flag": "Bankrupt?"}


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the path's scheme (local,
    HDFS, object stores alike); glob patterns count as existing when they match."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = fs.globStatus(p)
    return matches is not None and len(matches) > 0


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, mode: str = "DROPMALFORMED", encoding: str = "UTF-8",
             corrupt_col: str | None = None) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(f"CSV not found: {path}")
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    r = spark.read.option("header", header).option("mode", mode).option("encoding", encoding)
    if corrupt_col:
        r = r.option("columnNameOfCorruptRecord", corrupt_col)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def load_csv(spark: SparkSession, table: str, path: str, schema: StructType | str | None = None,
             **kw) -> int:
    """Register ``path`` as temp view ``table`` (bad rows skipped); returns the row count."""
    df = read_csv(spark, path, schema, **kw)
    df.createOrReplaceTempView(table)
    if schema is None:
        return df.count()
    return count_wellformed(spark, path, df.schema, header=kw.get("header", True),
                            encoding=kw.get("encoding", "UTF-8"))


def count_wellformed(spark: SparkSession, path: str, schema: StructType, header: bool = True,
                     encoding: str = "UTF-8") -> int:
    """Number of well-formed rows.  ``count()`` on a DROPMALFORMED read does
    not parse the columns and counts bad rows too, so the count is taken on a
    PERMISSIVE read as the rows whose corrupt-record column is NULL (the
    expression references every column, so every field is parsed)."""
    bad = "_corrupt_record"
    full = StructType(list(schema.fields)).add(bad, "string")
    df = (spark.read.option("header", header).option("mode", "PERMISSIVE").option("encoding", encoding)
          .option("columnNameOfCorruptRecord", bad).schema(full).csv(path))
    good = F.when(F.col(bad).isNull(), F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    return df.agg(F.count(good)).first()[0]


def read_csv_encoding(spark: SparkSession, path: str, schema=None, header: bool = True) -> DataFrame:
    """UTF-8 first; if any decoded value holds U+FFFD (Spark does not raise on
    bad UTF-8), read again as latin-1.  The probe is a bounded ``limit(1)``."""
    df = read_csv(spark, path, schema, header=header)
    str_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if str_cols:
        bad = df.where(F.exists(F.array(*[F.col(f"`{c}`") for c in str_cols]),
                                lambda v: F.coalesce(F.instr(v, REPLACEMENT_CHAR) > 0, F.lit(False)))
                       ).limit(1).count()
        if bad:
            return read_csv(spark, path, schema, header=header, encoding="ISO-8859-1")
    return df


def load_dataframe(spark: SparkSession, table: str, df: DataFrame, count: bool = True) -> int | None:
    df.createOrReplaceTempView(table)
    return spark.table(table).count() if count else None


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


def _listed(spark: SparkSession, directory: str, suffix: str) -> list[str]:
    """Paths below a directory of any file system that Spark reads, in order; a folder whose
    name has the suffix is a table of part files and is not looked into."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, waiting = [], [root] if fs.exists(root) else []
    while waiting:
        for entry in fs.listStatus(waiting.pop()):
            path = entry.getPath()
            if path.getName().lower().endswith(suffix):
                found.append(path.toString())
            elif entry.isDirectory():
                waiting.append(path)
    return sorted(found)


def find_file(spark: SparkSession, directory: str, preferred: str | None = None, suffix: str = ".csv") -> str:
    """Preferred file below a directory: exact name, then without regard to case, then by part
    of the name, else the first in path order.  Raises FileNotFoundError where there is none."""
    files = _listed(spark, directory, suffix)
    if not files:
        raise FileNotFoundError(f"no {suffix} file below {directory}")
    names = [f.rsplit("/", 1)[-1] for f in files]
    if preferred:
        low = preferred.lower()
        stem = low.removesuffix(suffix)
        for fits in (lambda n: n in (preferred, preferred + suffix), lambda n: n.lower() in (low, low + suffix),
                     lambda n: stem in n.lower()):
            for name, path in zip(names, files):
                if fits(name):
                    return path
    return files[0]


def normalize_columns(df: DataFrame, renames: Mapping[str, str] = CHURN_RENAMES) -> DataFrame:
    """Strip names, then apply the renames whose source exists and whose
    target does not; of several sources of one target the first named is taken."""
    df = df.toDF(*[c.strip() for c in df.columns])
    present, chosen = set(df.columns), {}
    for source, target in renames.items():
        if source in present and target not in present:
            chosen[source] = target
            present.add(target)
    return df.withColumnsRenamed(chosen)


def derive_label(df: DataFrame, target: str = "Churn", label_col: str = "Churn Label",
                 value_col: str = "Churn Value") -> DataFrame:
    """Build ``target`` from ``Churn Label`` (trimmed) or ``Churn Value`` 1/0 ->
    Yes/No when it is missing."""
    if target in df.columns:
        return df
    if label_col in df.columns:
        return df.withColumn(target, F.trim(F.col(f"`{label_col}`")))
    if value_col in df.columns:
        v = F.col(f"`{value_col}`").cast("int")
        return df.withColumn(target, F.when(v == 1, "Yes").when(v == 0, "No"))
    return df


def underscore_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def load_two_table(spark: SparkSession, train_path: str, meta_path: str,
                   schema=None) -> tuple[DataFrame, DataFrame]:
    """Training table + small feature-metadata table."""
    return read_csv(spark, train_path, schema), read_csv(spark, meta_path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", header).csv(path)
