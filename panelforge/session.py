"""Session helpers: where checkpoints go, how wide shuffles are, what may be broadcast."""

from __future__ import annotations

import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only where the session names
    none and runs on this machine alone.  On a cluster without a named folder there is an error, as no folder of one machine
    will do.  Checkpoints are removed with their frames where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there: it is computed once, and lost executors
    cost a read instead of a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint only if ``df`` is seen to hold at most ``max_rows`` rows; otherwise ``df`` as it is,
    which joins by shuffle."""
    seen = df.select(F.lit(1).alias("_")).limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_panelforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-package-')}/{root.name}", "zip", root.parent, root.name))
    sc._panelforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
