"""Session helpers: builder, package shipping, lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in ({"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers (once a session).

    Jobs that run Python in tasks call it first; where the workers already
    share the driver's PYTHONPATH it is merely a second copy of the same code.
    """
    context = spark.sparkContext
    if not getattr(context, "_glossmill_shipped", False):
        root = Path(__file__).resolve().parent
        if root.is_dir():
            archive = Path(tempfile.mkdtemp(prefix="glossmill-")) / "glossmill.zip"
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                for path in sorted(root.rglob("*.py")):
                    z.write(path, Path("glossmill") / path.relative_to(root))
            context.addPyFile(str(archive))
        context._glossmill_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files, which all workers share: the session's spark.checkpoint.dir.

    Only a local session may have none; it gets a folder of its own. A cluster without
    one is refused, as its executors would write to their own disks.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all workers share")
            folder = tempfile.mkdtemp(prefix="glossmill-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to shared_folder() and go on from the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
