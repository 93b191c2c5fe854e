"""Session helpers: shared folder, input parallelism, table access."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "leakscope", cores: str = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEAKSCOPE_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def use_shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the cluster's setting if there is one, a temporary one in a local session.

    A cluster without the setting is refused, since its executors share no temporary folder.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leakscope-"))
    return sc.getCheckpointDir()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Shuffle the rows of a scan evenly, only if it gives fewer partitions than there are cores.

    The plan is looked at, never run. One that already shuffles stays as it is: the adaptive planner sizes its partitions
    by what they hold, and asking for their number would execute it.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Greatest size, by the statistics of its files, of a table whose keys are broadcast.
BROADCAST_BYTES = 32 << 20


def small(keys: DataFrame, source: DataFrame) -> DataFrame:
    """``keys``, a few numbers for each row of ``source``, with a broadcast hint if the statistics call that small.

    They are those of the plan, so nothing runs; a larger source, or one of unknown size, is joined by a shuffle.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def text_or_empty(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that their Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="leakscope-")) / "leakscope.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
