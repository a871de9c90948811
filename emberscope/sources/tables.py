"""Named tables: layers, replacement, schema merge, layout and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.spatial import morton
from ..session import remove_dir

STAGING, BACKUP = "__staging", "__backup"
#: Rows that one task of a layout sorts at most, apart from the unevenness of ranges.
ROWS_PER_PARTITION = 1_000_000


def create_layers(spark: SparkSession, location: str | None = None, layers: Sequence[str] = tuple(V.LAYERS)) -> None:
    """One schema per layer, below ``location`` if given."""
    for layer in layers:
        place = f" LOCATION '{location}/{layer}'" if location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{layer}`{place}")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    recover(spark, name)
    adopt(spark, name)
    return spark.read.table(name)


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table and its schema by a query, which may read the table itself.

    The result is written to a staging table before anything is touched. Only
    then are the names swapped; ``recover`` finishes or undoes a swap that was
    cut short.
    """
    spark = df.sparkSession
    recover(spark, name)
    staging, backup = _beside(name, STAGING), _beside(name, BACKUP)
    _clear_staging(spark, staging)
    writer = df.write.format("parquet").mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(staging)
    # files of an earlier session whose catalog is gone, or of a table taken up by ``adopt``: moved, not deleted
    if _holds_files(spark, name) and (not spark.catalog.tableExists(name) or _external(spark, name)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _move(spark, _home(spark, name), _home(spark, backup))
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {backup}")
    _clear_empty(spark, name)
    spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {backup}")
    remove_dir(spark, _home(spark, backup))


def recover(spark: SparkSession, name: str) -> str:
    """Bring a table back to one live version after a crash in ``replace_table``.

    A backup without a live table means the crash fell between the two renames:
    the staged version is complete then, so the swap is finished. A backup next
    to a live table only has to be dropped.
    """
    staging, backup = _beside(name, STAGING), _beside(name, BACKUP)
    exists = spark.catalog.tableExists
    if not exists(backup):
        if exists(name) or _holds_files(spark, name) or not _holds_files(spark, backup):
            return "clean"
        # a swap of files that no catalog knows: the staged version is complete if its job was
        done = _holds_files(spark, staging) and _finished(spark, staging)
        spark.sql(f"DROP TABLE IF EXISTS {staging}") if exists(staging) and not done else None
        _move(spark, _home(spark, staging if done else backup), _home(spark, name))
        spark.sql(f"DROP TABLE IF EXISTS {staging}")
        adopt(spark, name)
        if done:
            remove_dir(spark, _home(spark, backup))
        return "finished swap" if done else "restored backup"
    if exists(name):
        spark.sql(f"DROP TABLE {backup}")
        return "dropped backup"
    if exists(staging):
        spark.sql(f"ALTER TABLE {staging} RENAME TO {name}")
        spark.sql(f"DROP TABLE {backup}")
        return "finished swap"
    spark.sql(f"ALTER TABLE {backup} RENAME TO {name}")
    return "restored backup"


def table_location(spark: SparkSession, name: str) -> str:
    """Where a table's files are."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'")
    return rows.first()["data_type"]


def _home(spark: SparkSession, name: str) -> str:
    """The folder that a table of this name has by default."""
    parts = [p.strip("`") for p in name.split(".")]
    if len(parts) == 1:
        parts.insert(0, spark.catalog.currentDatabase())
    home = spark.sql(f"DESCRIBE SCHEMA `{parts[-2]}`").filter("info_name = 'Location'").first()["info_value"]
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    return f"{home}/{parts[-1] if exact else parts[-1].lower()}"


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _holds_files(spark: SparkSession, name: str) -> bool:
    """Whether the default folder of a table holds any file, at any depth."""
    place, files = _files(spark, _home(spark, name))
    return bool(files.exists(place)) and bool(files.listFiles(place, True).hasNext())


def _finished(spark: SparkSession, name: str) -> bool:
    """Whether the job that wrote a table's default folder was committed."""
    place, files = _files(spark, f"{_home(spark, name)}/_SUCCESS")
    return bool(files.exists(place))


def _external(spark: SparkSession, name: str) -> bool:
    return spark.catalog.getTable(name).tableType == "EXTERNAL"


def _move(spark: SparkSession, source: str, target: str) -> None:
    place, files = _files(spark, source)
    if not files.rename(place, _files(spark, target)[0]):
        raise OSError(f"cannot move {source} to {target}")


def _clear_empty(spark: SparkSession, name: str) -> None:
    """Remove the default folder of a table that is not there, if nothing is in it."""
    if not spark.catalog.tableExists(name) and not _holds_files(spark, name):
        remove_dir(spark, _home(spark, name))


def adopt(spark: SparkSession, name: str) -> bool:
    """Take up a table whose files stand in its default folder, but which the catalog does not know.

    So it is in every new session with a catalog in memory. Its schema is that of all files together. Returns whether there was one.
    """
    if spark.catalog.tableExists(name) or not _holds_files(spark, name):
        return False
    home = _home(spark, name)
    found = spark.read.option("mergeSchema", True).parquet(home).schema
    parts = _partitions(spark, home)
    spark.catalog.createTable(name, path=home, source="parquet", schema=found) if not parts else spark.sql(
        f"CREATE TABLE {name} ({found.toDDL()}) USING parquet PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)}) LOCATION '{home}'"
    )
    if parts:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return True


def _partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition columns of a folder, from outer to inner."""
    names: list[str] = []
    place, files = _files(spark, path)
    while True:
        inner = [s.getPath() for s in files.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName()]
        if not inner:
            return names
        place = inner[0]
        names.append(place.getName().split("=")[0])


def _clear_staging(spark: SparkSession, name: str) -> None:
    """Remove a staging table and files that a crash left without one. Never for the name of a live table."""
    if not name.strip("`").endswith((STAGING, BACKUP)):
        raise ValueError(f"{name} is not the name of a staging table")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_dir(spark, _home(spark, name))


def _beside(name: str, suffix: str) -> str:
    return f"{name[:-1]}{suffix}`" if name.endswith("`") else f"{name}{suffix}"


def append_merging(df: DataFrame, name: str) -> None:
    """Append to a table; columns new to it are added, columns absent from ``df`` become null.

    A table is first written under a staging name, so its folder is never half a first write; files that stand there
    already belong to an earlier session and are kept.
    """
    spark = df.sparkSession
    recover(spark, name)
    if not spark.catalog.tableExists(name) and not adopt(spark, name):
        replace_table(df, name)
        return
    add_columns(spark, name, df.schema.fields)
    target = spark.read.table(name)
    aligned = target.limit(0).unionByName(df, allowMissingColumns=True).select(*target.columns)
    aligned.write.mode("append").insertInto(name)


def add_columns(spark: SparkSession, name: str, fields) -> None:
    known = {c.lower() for c in spark.read.table(name).columns}
    new = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name.lower() not in known]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def layout_morton(df: DataFrame, row: Column, col: Column, partitions: int) -> DataFrame:
    """Same rows, stored along a Z-order curve of two non-negative integer indices.

    The row hash as last range key lets the rows of one hot cell spread over
    several partitions. There are ``partitions`` of them, more where they
    would hold over ``ROWS_PER_PARTITION`` rows, as each is sorted in one task.
    """
    z = morton(row, col)
    return (
        df.withColumn("__z", z)
        .repartitionByRange(_parts(df, partitions), F.col("__z"), F.xxhash64(*df.columns))
        .sortWithinPartitions("__z")
        .drop("__z")
    )


def layout_sorted(df: DataFrame, columns: Sequence[str], partitions: int) -> DataFrame:
    """Same rows, range-partitioned and sorted by the given columns; ``partitions`` as in ``layout_morton``."""
    return df.repartitionByRange(_parts(df, partitions), *columns).sortWithinPartitions(*columns)


def _parts(df: DataFrame, least: int) -> int:
    """Partitions for a sort of all rows, so that what one task sorts does not grow with the table."""
    return max(least, -(-df.count() // ROWS_PER_PARTITION))


def export_by_year(df: DataFrame, ts: str, path: str) -> None:
    """Parquet files partitioned by year.

    The rebalance hint gathers each year into few files and lets adaptive
    execution split a year that is too large for one task.
    """
    yearly = df.withColumn("year", F.year(ts))
    yearly.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)
