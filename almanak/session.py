"""Session builder and the few settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "almanak", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with a UTC zone, adaptive execution and Arrow exchange.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    submitter's settings then hold.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder the cluster names.

    ``spark.checkpoint.dir`` decides where. Where it is unset a session on one
    machine takes a temporary folder; one on a cluster is refused, for its
    executors could not read each other's files there.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="almanak-checkpoint-"))
    return df.checkpoint(eager=eager)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
