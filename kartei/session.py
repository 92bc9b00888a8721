"""Session and materialisation helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "kartei", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; on a cluster use the cluster's own and only keep the time zone."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable for the Python workers of a session, wherever they run; once a session.

    The driver serves the package to the executors, as it does for any --py-files.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_kartei_shipped", False):
        package = Path(__file__).resolve().parent
        if package.parent.is_dir():
            out = Path(tempfile.mkdtemp(prefix="kartei-package-"), "kartei.zip")
            with zipfile.ZipFile(out, "w") as z:
                for f in sorted(package.rglob("*.py")):
                    z.write(f, f.relative_to(package.parent))
            sc.addPyFile(str(out))
        sc._kartei_shipped = True
    return spark


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
    a temporary folder is used, and then only with a local master.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="kartei-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
