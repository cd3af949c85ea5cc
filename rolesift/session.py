"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# UTC and ANSI are semantic requirements; the rest lets Spark size the plan itself.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rolesift", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings to a session somebody else built."""
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. ``fallback`` serves sessions that leave
    it unset and run in one process, where a local folder is shared; elsewhere it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if fallback is None or not runs_in_one_process(spark):
        raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
    return fallback


def runs_in_one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def work_folder(spark: SparkSession) -> str:
    """``shared_folder`` with a fresh temporary folder where that is allowed."""
    if spark.conf.get("spark.checkpoint.dir", None) or not runs_in_one_process(spark):
        return shared_folder(spark)
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = tempfile.mkdtemp(prefix="spark-")
    return shared_folder(spark, _FOLDERS[key])


_FOLDERS: dict[str, str] = {}


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return files.exists(at)


def matching_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a glob, in order."""
    files, at = _folder(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(at) or [] if s.isDirectory())


def delete_folder(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)
