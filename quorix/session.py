"""Session defaults, and the package on executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
#: Rows of text differ in length by orders of magnitude, so a number of rows bounds no batch.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def build_session(name: str = "quorix", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python this package, once a context; Spark serves the file from the driver. Batches for Python
    are bounded by bytes, unless the session says how."""
    context = spark.sparkContext
    for key, value in ARROW.items():
        if not context.getConf().contains(key):
            spark.conf.set(key, value)
    if not getattr(context, "_quorix_shipped", False):
        top = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="quorix-"), "quorix.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        context.addPyFile(target)
        context._quorix_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where one machine does all, an own
    folder where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quorix-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quorix-{what}-{uuid.uuid4().hex}"
