"""Session helpers: a tuned local session for tests/bench, lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str | None = None, app: str = "strata",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session configured the way the library expects.

    On a cluster the session is normally created by the platform; these
    settings are the ones that matter for correctness and plan shape:
    AQE on (runtime coalescing, skew-join splitting, runtime broadcast
    conversion based on *measured* sizes), UTC session time zone, UI off.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared (distributed) folder there; we only create our
    own folder when the setting is absent, which happens in local tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        # one process has one folder; executors of a cluster would each write to their own
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint dir).

    Used by iterative operators (connected components in DBSCAN) so a lost
    executor recomputes from the checkpoint, not from the first iteration.
    Never ``localCheckpoint``: that data dies with the executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one computation, written as Parquet to a folder of their own in the shared one and read back; the folder
    goes at the end of the ``with`` block.

    Unlike a checkpoint, such a table carries nothing of the plan that made it.  A checkpoint keeps the constraints that
    Spark has inferred for its rows, with a variant for every alias; in loops that rename columns they
    multiply from round to round until the driver's memory is full, whatever the size of the tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")
