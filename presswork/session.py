"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_stored_at: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def get_session(app_name: str = "presswork", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session. Cluster sizes stay with the deployer."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once per application: functions in them are unpickled by module name,
    and workers need not have the package installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="presswork-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}-package.zip", "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}-package.zip")
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own, removed when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        own = tempfile.mkdtemp(prefix="presswork-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _local_dirs[context.applicationId] = own
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result is needed several times or its row order marks must not be
    computed twice. The written files survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored_at[stored] = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more.

    Spark's cleaner also drops the shuffle files of ended jobs, once the driver's collector has found that nothing refers to them;
    else they stay on the executors' disks as long as the driver has memory left.
    """
    for df in stored:
        path = _stored_at.pop(df, None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
            jvm.System.gc()
