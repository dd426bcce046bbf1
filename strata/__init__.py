"""strata: a PySpark-native library of user-level analysis operators.

Every operator is a plain function ``(DataFrame, params) -> DataFrame`` whose
heavy work is a Spark plan built from DataFrame / SQL built-ins.  Sub-packages:

* ``sources``   – readers, writers, table registration, schema normalisation
* ``functions`` – column-expression helpers (dates, rounding, vectors, text)
* ``operators`` – relational, aggregate, window, quality, statistics, features,
                  evaluation, models, clustering, retrieval and geo operators
* ``plans``     – stand-in domain tables derived from the test data and the
                  registry of named queries with their oracle SQL
* ``streaming`` – Structured Streaming versions of the batch operators
"""

from strata.session import get_spark, checkpoint_dir, cut_lineage  # noqa: F401

__version__ = "0.1.0"
