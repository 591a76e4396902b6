"""Versioned tables: every load goes to folders of its own, and one row in a log turns readers to it.

``folder/<table>/load=<version>`` holds what one load brought to a table. ``folder/publications`` is the log: one file
per publication, with the loads that make up each table (seq, version, table_name, loads). The file appears in one step
when its writer commits, so readers find all tables of the last publication or all of the one before, never new
parents with old children. A load that fails leaves folders that no publication names.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import LOAD_ORDER, SERVICE_CODES
from tillroll.functions.staging import delete_folder, folder_exists, folder_names
from tillroll.sources import writers

LOG = "publications"
_LOG_SCHEMA = "seq long, version string, table_name string, loads array<string>"


def publications(spark: SparkSession, folder: str) -> DataFrame:
    """The log: (seq, version, table_name, loads)."""
    path = f"{folder.rstrip('/')}/{LOG}"
    if not folder_exists(spark, path):
        return spark.createDataFrame([], _LOG_SCHEMA)
    return spark.read.schema(_LOG_SCHEMA).parquet(path)


def current(spark: SparkSession, folder: str, version: str | None = None) -> tuple[int, str | None, dict[str, list[str]]]:
    """(seq, version, loads by table) of a publication, the last unless named; (0, None, {}) before the first.

    Of two publications of one number (two writers at once) the greater version counts, for every reader.
    """
    log = publications(spark, folder)
    if version is not None:
        log = log.filter(F.col("version") == version)
    last = log.agg(F.max(F.struct("seq", "version")).alias("last")).first()["last"]
    if last is None:
        if version is not None:
            raise LookupError(f"{folder} has no publication {version!r}")
        return 0, None, {}
    rows = log.filter((F.col("seq") == last["seq"]) & (F.col("version") == last["version"])).collect()
    return last["seq"], last["version"], {row["table_name"]: list(row["loads"]) for row in rows}


def new_version(spark: SparkSession, folder: str) -> tuple[int, str]:
    """Number and name of a publication to come; nobody else gets the name."""
    seq = current(spark, folder)[0] + 1
    return seq, f"{seq:06d}-{uuid.uuid4().hex[:12]}"


def load_path(folder: str, table: str, load: str) -> str:
    return f"{folder.rstrip('/')}/{table}/load={load}"


def announce(spark: SparkSession, folder: str, seq: int, version: str, loads: Mapping[str, Sequence[str]]) -> None:
    """Turn all readers to these loads: one file with a row per table."""
    rows = [(seq, version, table, list(names)) for table, names in loads.items()]
    log = spark.createDataFrame(rows, _LOG_SCHEMA).coalesce(1)
    log.write.mode("append").parquet(f"{folder.rstrip('/')}/{LOG}")


def publish_version(entities: Mapping[str, DataFrame], folder: str) -> str:
    """Write the entities as a new version below ``folder``, check every constraint, and publish them together.

    A broken constraint or a failed write publishes nothing: readers keep what they have. Returns the version.
    """
    spark = entities[LOAD_ORDER[0]].sparkSession
    seq, version = new_version(spark, folder)
    paths = {name: load_path(folder, name, version) for name in LOAD_ORDER}
    try:
        writers.load_checked(entities, paths)
    except BaseException:
        for path in paths.values():
            delete_folder(spark, path)
        raise
    announce(spark, folder, seq, version, {name: [version] for name in LOAD_ORDER})
    return version


def published(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a publication, the last unless named. They stay as they are whatever is published later."""
    _, _, loads = current(spark, folder, version)
    if not loads:
        raise LookupError(f"nothing is published in {folder}")
    return {
        name: spark.read.parquet(*[load_path(folder, name, load) for load in held]) for name, held in loads.items()
    }


def remove_loads(spark: SparkSession, folder: str, *, keep: int = 2) -> list[str]:
    """Delete load folders that none of the last ``keep`` publications names; returns their paths.

    Not to be run while a load is on its way: its folders are not published yet.
    """
    log = publications(spark, folder)
    last = log.select("seq", "version").distinct().orderBy(F.desc("seq"), F.desc("version")).limit(keep)
    rows = log.join(F.broadcast(last), ["seq", "version"]).select("table_name", F.explode("loads").alias("load"))
    used = {(row["table_name"], row["load"]) for row in rows.distinct().collect()}
    gone = []
    for table in folder_names(spark, folder):
        for name in folder_names(spark, f"{folder.rstrip('/')}/{table}") if table != LOG else ():
            if name.startswith("load=") and (table, name.removeprefix("load=")) not in used:
                gone.append(f"{folder.rstrip('/')}/{table}/{name}")
                delete_folder(spark, gone[-1])
    return gone


def publish_views(
    spark: SparkSession, folder: str, schema: str, *, codes: Sequence[str] = SERVICE_CODES
) -> list[str]:
    """Name the published tables, and the four views over them, in ``schema`` of the session's catalog.

    Each table is a view that reads the partitions the last publication names, so all of them, and the views that build
    on them, turn to a new publication with the one row of the log. Run once, and ``refresh_views`` after a publication
    from elsewhere; a query in between sees the former state as a whole.
    """
    base, found = folder.rstrip("/"), published(spark, folder)
    spark.sql(f"create schema if not exists {schema}")
    spark.catalog.createTable(f"{schema}.{LOG}", f"{base}/{LOG}", source="parquet")
    for name, frame in found.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
        spark.sql(
            f"create table {schema}.{name}_loads ({columns}, load string) using parquet partitioned by (load)"
            f" location '{base}/{name}'"
        )
        last = f"(select max(struct(seq, version)) from {schema}.{LOG})"
        spark.sql(
            f"create or replace view {schema}.{name} as select {', '.join(frame.columns)} from {schema}.{name}_loads"
            f" where load in (select explode(loads) from {schema}.{LOG}"
            f" where table_name = '{name}' and struct(seq, version) = {last})"
        )
    texts = writers.view_texts(schema, codes)
    for name, text in texts.items():
        spark.sql(f"create or replace view {schema}.{name} as {text}")
    refresh_views(spark, schema)
    return [f"{schema}.{name}" for name in (*found, *texts)]


def refresh_views(spark: SparkSession, schema: str) -> None:
    """Make this session see what has been published since; partitions first, then the log that names them."""
    for name in LOAD_ORDER:
        spark.sql(f"alter table {schema}.{name}_loads recover partitions")
    spark.catalog.refreshTable(f"{schema}.{LOG}")
