"""Session helpers: a test session, shared-folder tables that cut lineage, shipping of the package."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 4, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(max(4, cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all executors run on this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    own = Path(tempfile.gettempdir()) / f"skein-{os.getpid()}"
    if not own.exists():
        own.mkdir(parents=True)
        atexit.register(shutil.rmtree, own, True)
    return own.as_uri()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it comes in fewer, as from a single file with one row group.

    A table that is large enough for all cores is left as it is; no large table is shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: Folders of intermediate tables that are still there, by application.
_written: dict[str, set[str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage, so a lost executor costs a read and no recomputation.  ``release`` removes it
    when no later step reads it; ``clean`` removes all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    held = _written.setdefault(spark.sparkContext.applicationId, set())
    if not held:
        atexit.register(_clean_at_exit, spark)
    held.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more, and the shuffle files of finished steps.

    Spark drops shuffle files only after the driver's garbage was collected, which may take longer than the job.
    """
    for df in tables:
        _remove(spark, df._skein_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that weren't read yet are lost."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _remove(spark, path)


def _clean_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't reach the folder
        with contextlib.suppress(Exception):
            clean(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="skein-ship-"))
    atexit.register(shutil.rmtree, folder, True)  # the driver's copy: executors fetch theirs through Spark
    target = folder / "skein.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*")):
            if path.suffix in {".py", ".json", ".txt"}:
                archive.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
