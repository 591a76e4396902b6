"""Intermediate tables in the folder the cluster shares between its executors."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Of the files of stages: most steps write one and read it a few times, and bytes written count more than the packing.
COMPRESSION = "zstd"

_local_folders: dict[str, str] = {}
_owner = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, the folder that the cluster names for this.

    A local session without the setting gets a folder of its own, and a warning that says so.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tillroll-")
        warnings.warn(
            f"spark.checkpoint.dir is not set; stages go to {_local_folders[context.applicationId]}", stacklevel=2
        )
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tillroll/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from the written table.

    This cuts the lineage: a lost executor costs a re-read of the table, not a re-run of
    what produced it, and every later pass sees the very same rows. Within ``owned_stages``
    the table belongs to that block.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").option("compression", COMPRESSION).parquet(path)
    for owned in getattr(_owner, "paths", [])[-1:]:
        owned.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    """The file system that Spark uses for a path, and the path as it names it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    system, place = _located(spark, path)
    return system.exists(place)


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder on any file system that Spark can write to; False if it was not there."""
    system, place = _located(spark, path)
    return system.delete(place, True)


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder within one file system; the target must not exist."""
    system, place = _located(spark, path)
    _, goal = _located(spark, target)
    if system.exists(goal):
        raise FileExistsError(target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"{path} could not be moved to {target}")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; none if it is missing."""
    system, place = _located(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(place)) if system.exists(place) else []


def delete_stages(spark: SparkSession, paths: list[str]) -> None:
    """Delete written stages; one that cannot be deleted is named in a warning and hides no result."""
    for path in paths:
        try:
            delete_folder(spark, path)
        except Exception as error:  # of any kind: file systems are Java classes of the cluster's own choice
            warnings.warn(f"stage {path} is left behind: {str(error).splitlines()[0]}", stacklevel=2)


@contextlib.contextmanager
def owned_stages(spark: SparkSession, *, delete: bool = True) -> Iterator[list[str]]:
    """Collects the paths of the stages made in the block and, with ``delete``, deletes them at its end."""
    paths: list[str] = []
    _owner.paths = [*getattr(_owner, "paths", []), paths]
    try:
        yield paths
    finally:
        _owner.paths = _owner.paths[:-1]
        if delete:
            delete_stages(spark, paths)
