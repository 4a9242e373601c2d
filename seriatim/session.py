"""Session building, code shipping and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build(app: str = "seriatim", master: str | None = None, cores: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is the cluster's own."""
    b = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers wherever they run.

    The sources, some hundred kilobytes, go out once per context through Spark's own file server;
    executors need no path of the driver's machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seriatim_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "seriatim_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in ROOT.rglob("*.py"):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(archive))
    sc._seriatim_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the cluster's shared folder.

    The folder is spark.checkpoint.dir; where the session has none and runs in one process
    (tests), a temporary one is set. A cluster without the setting is an error: its machines
    would not see each other's files.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="seriatim_ckpt_"))
    return df.checkpoint(eager=True)


def partitions(df: DataFrame) -> int:
    """The session's shuffle width, which is the one knob that operators scale with."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
