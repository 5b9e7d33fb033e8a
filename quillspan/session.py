"""Session helpers: a local session for tests and benches, and lineage cuts.

On a cluster the caller owns the session; nothing here overrides its settings.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", memory: str = "12g", app: str = "quillspan") -> SparkSession:
    """A local session with the settings the tests and bench.py use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="quillspan-")) / "quillspan.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` where the cluster names one.

    Only where that setting and the context's own directory are both unset on a master of
    one machine (as in tests) is a temporary folder made; elsewhere that is an error,
    since other hosts could not read it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quillspan-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table to the shared checkpoint folder and read back.

    For wide rows: unlike ``cut`` it is compressed, and later reads take only the columns
    they need. The table is deleted when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _EXIT:
        _EXIT.append(atexit.register(_drop_stored))
    _STORED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a ``stored`` DataFrame that nothing reads any more; others are left alone."""
    path = df.__dict__.get("_stored_path")
    for entry in [e for e in _STORED if e[1] == path]:
        _delete(*entry)
        _STORED.remove(entry)


_STORED: list[tuple[SparkSession, str]] = []
_EXIT: list = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_stored() -> None:
    for entry in _STORED:
        try:
            _delete(*entry)
        except Exception:
            break  # the session has ended; its folder goes with it
    _STORED.clear()
