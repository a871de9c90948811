"""Planning, checking and auditing the landing area."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..session import materialize


def file_listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files below a folder as (name, path, length); contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), "path", "length")


def date_chunks(bounds: DataFrame, start: str, end: str, days: int = V.DAYS_PER_FIRE_FILE) -> DataFrame:
    """Chunk start dates from ``start`` to ``end`` (both included) in steps of ``days``, with file names."""
    first, last = F.to_date(start), F.to_date(end)
    chunk = bounds.select(F.explode(F.sequence(first, last, F.make_dt_interval(days=F.lit(days)))).alias("chunk_start"))
    return chunk.withColumn("name", F.date_format("chunk_start", V.FIRE_FILE_FORMAT))


def pending(work: DataFrame, landed: DataFrame, on: str = "name") -> DataFrame:
    """Work items without a landed file."""
    return work.join(landed.select(on), on, "left_anti")


def weather_file_name(cell: Column) -> Column:
    return F.concat(F.lit(V.WEATHER_FILE_PREFIX), cell.cast("string"), F.lit(V.WEATHER_FILE_SUFFIX))


def cell_batches(
    cells: DataFrame, cell: str, group: Column, order: list[str], size: int = V.CELLS_PER_WEATHER_BATCH
) -> DataFrame:
    """Cells numbered in order and packed into batches: (batch, cells).

    ``group`` is a leading part of the order (a grid row, a range of ids). The group sizes are summed up within the
    partitions of a range, only one total for each partition passes through a whole-table window, and the
    numbering itself runs within the groups.
    """
    grouped = cells.withColumn("__group", group)
    sizes = grouped.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    # written once, so that a group keeps its partition
    ranged = materialize(sizes.repartitionByRange("__group").withColumn("__part", F.spark_partition_id()), "groups")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(F.sum("__n").alias("__total"))
    parts = parts.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    earlier = Window.partitionBy("__part").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("__inner", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    offsets = inner.join(parts, "__part").select("__group", (F.col("__base") + F.col("__inner")).alias("__offset"))
    within = Window.partitionBy("__group").orderBy(*order)
    number = F.col("__offset") + F.row_number().over(within) - F.lit(1)
    numbered = grouped.join(offsets, "__group").withColumn("__number", number)
    return (
        numbered.groupBy(F.floor(F.col("__number") / F.lit(size)).alias("batch"))
        .agg(F.sort_array(F.collect_list(F.struct("__number", cell))).alias("members"))
        .select("batch", F.col(f"members.{cell}").alias("cells"))
    )


def write_documents(documents: DataFrame, path: str, per_file: int = 1, partitions: int | None = None) -> None:
    """JSON files of ``per_file`` documents each, one per line.

    One document per file is what the multi-line reader expects; more per file
    spare the file system when documents are many (read them by line then). The
    rows are spread first, because creating the files is the work. On a local or mounted folder the tasks create the files of one document
    themselves, as Hadoop's local file system starts a process for the permissions of every file. The path must not exist.
    """
    spread = documents.repartition(partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    context = documents.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if per_file == 1 and files.getUri().getScheme() == "file" and not files.exists(target):
        _write_each(spread, files.makeQualified(target).toUri().getPath())
    else:
        spread.write.option("maxRecordsPerFile", per_file).json(path)


def _write_each(documents: DataFrame, folder: str) -> None:
    """A file for each row. A file gets its name when it is whole, and a task that is run again replaces what it left."""
    job = uuid.uuid4().hex

    def write(parts):
        import os

        import pandas as pd
        from pyspark import TaskContext

        task, k = TaskContext.get(), 0
        os.makedirs(folder, exist_ok=True)
        for part in parts:
            for text in part["value"]:
                name = f"part-{task.partitionId():05d}-{job}-{k:06d}.json"
                hidden = f"{folder}/_{task.taskAttemptId()}-{name}"
                with open(hidden, "wb") as out:
                    out.write(text.encode() + b"\n")
                os.replace(hidden, f"{folder}/{name}")
                k += 1
        yield pd.DataFrame({"files": [k]})

    documents.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(write, "files long").agg(F.sum("files")).collect()


def valid_payload(text: Column, marker: str = V.INVALID_MARKER) -> Column:
    return ~F.contains(text, F.lit(marker))


def split_payloads(payloads: DataFrame, text: str, marker: str = V.INVALID_MARKER) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected payloads; a null text is rejected."""
    ok = F.coalesce(valid_payload(F.col(text), marker), F.lit(False))
    return payloads.filter(ok), payloads.filter(~ok)


def read_payloads(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """Whole files as (value, source_filename)."""
    return listed_payloads(spark, path, suffix).select("value", "source_filename")


def listed_payloads(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Whole files with what ``file_listing`` knows of them, in one listing of the folder: (value, source_filename, name, length)."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    about = {"source_filename": "file_path", "name": "file_name", "length": "file_size"}
    return files.select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in about.items()])


def landing_audit(listing: DataFrame, expected: int | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """File count, first and last name, size of the last file, progress in percent, and ``more`` aggregates of the listing's own columns."""
    audit = listing.agg(
        F.count(F.lit(1)).alias("files"),
        F.min("name").alias("first_name"),
        F.max("name").alias("last_name"),
        F.max_by("length", "name").alias("last_length"),
        *more,
    )
    progress = F.try_divide(F.col("files").cast("double") * 100, F.lit(expected).cast("double"))
    return audit.withColumn("progress_pct", F.round(progress, 1))


def document_variables(documents: DataFrame, text: str = "value", field: str = "hourly") -> DataFrame:
    """Number and names of the series in each JSON document."""
    keys = F.json_object_keys(F.get_json_object(F.col(text), f"$.{field}"))
    return documents.withColumn("variables", keys).withColumn("n_variables", F.coalesce(F.array_size("variables"), F.lit(0)))
