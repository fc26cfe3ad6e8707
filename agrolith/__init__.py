"""agrolith: DataFrame operators for keyed observation tables on Apache Spark.

Integrate place/year/category tables, profile and clean them, impute, scale,
encode, split and sample repeatably, fit epsilon-insensitive regressors through
explicit feature maps, score request tables or streams, and report metrics.
Every operator takes and returns a ``pyspark.sql.DataFrame``.
"""

from agrolith.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
