"""Session settings the reports rely on, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every report assumes: UTC session clock, AQE for runtime
# re-planning (join strategy, partition coalescing, skew splitting).
# Broadcast joins are chosen only from sizes measured at run time (AQE,
# after the shuffle map stage), never from planner estimates; explicit
# broadcast hints are used only on sides with a proven row bound.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "invlens", **conf) -> SparkSession:
    """Get or create a session with the required settings (UI off)."""
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    for k, v in {**REQUIRED_CONF, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Never falls back to a machine-local folder: a job that needs one and
    finds none set fails here.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    return str(d)
