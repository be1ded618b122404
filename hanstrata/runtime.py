"""Session-level helpers: table access, the shared work folder, lineage cuts."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's spark.checkpoint.dir. Only a local session may lack it; then a folder of
    this machine serves, as the driver is the only executor.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        own = tempfile.mkdtemp(prefix="hanstrata-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _local_dirs[app] = "file://" + own
    return _local_dirs[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path, with all that is below."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Puts a folder in the place of another; if there is no folder at `path`, an empty one."""
    fs, source = _file_system(spark, path)
    _, target = _file_system(spark, to)
    fs.delete(target, True)
    fs.mkdirs(target.getParent())
    if not (fs.rename(source, target) if fs.exists(source) else fs.mkdirs(target)):
        raise OSError(f"{path} could not be moved to {to}")


def fingerprint(spark: SparkSession, path: str, *more: str) -> str:
    """A name for the files below a path, by their names, sizes and times, and for whatever else is given."""
    fs, target = _file_system(spark, path)
    found, seen = fs.listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join([*sorted(seen), *more]).encode()).hexdigest()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint in the shared folder; it survives the loss of executors.

    Spark deletes it with the DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; their Python need not have it.

    The driver serves the archive, so its own temporary folder will do.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="hanstrata-code-")) / "hanstrata.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, f"{package.name}/{path.relative_to(package)}")
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def require_columns(df: DataFrame, *names: str) -> None:
    """Raises ValueError, before any job runs, if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def read_json(path: str | Path) -> dict:
    import json

    return json.loads(Path(path).read_text(encoding="utf-8-sig"))
