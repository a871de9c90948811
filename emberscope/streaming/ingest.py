"""Incremental ingestion of landing files into tables."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from ..sources.files import RESCUED, by_header, csv_by_name, csv_by_place, file_paths, first_lines, json_documents, literal, new_columns, remembered_schema, save_schema
from ..sources.tables import add_columns, adopt, table_location

log = logging.getLogger(__name__)

METADATA = ("ingestion_timestamp", "source_filename")
FILES_PER_BATCH = 1000
STATUS_SCHEMA = "table string, ok boolean, rows long, rejected long, error string"
REJECTED, REJECTED_SCHEMA = "__rejected", "file string, reason string, batch long, rejected_at timestamp"
EMPTY, INVALID = "empty file", "invalid payload"
#: Batch number of rejected files that no batch has listed.
NO_BATCH = -1


@dataclass(frozen=True)
class FileSource:
    """A folder of landing files and the table it feeds.

    Without a declared ``schema`` one is inferred on the first run and remembered
    at ``schema_path``. ``multi_line`` defaults to one document per file for JSON
    and one row per line for CSV. A file whose first line holds ``marker`` is a message, not data.
    """

    path: str
    table: str
    checkpoint: str
    schema_path: str
    fmt: str
    schema: T.StructType | None = None
    rescue: bool = True
    multi_line: bool | None = None
    options: dict = field(default_factory=dict)
    marker: str | None = V.INVALID_MARKER


def _settings(source: FileSource) -> dict:
    """Options with a bound on the files of a batch; all files are still read, batch by batch."""
    return {"maxFilesPerTrigger": str(FILES_PER_BATCH), **source.options}


def _has_header(source: FileSource) -> bool:
    return source.fmt == "csv" and str(source.options.get("header", "true")).lower() == "true"


def declared_fields(spark: SparkSession, source: FileSource) -> T.StructType:
    """The source's schema, declared or remembered."""
    if source.fmt not in ("csv", "json"):
        raise ValueError(f"format is csv or json, not {source.fmt!r}")
    return source.schema or remembered_schema(spark, source.path, source.schema_path, source.fmt)


def rows_of_files(spark: SparkSession, source: FileSource, schema: T.StructType, lines: dict[str, str]) -> DataFrame:
    """The rows of readable files, given with their first lines: (fields, rescue column, metadata)."""
    multi_line = source.fmt == "json" if source.multi_line is None else source.multi_line
    if source.fmt == "json":
        rows = json_documents(spark, sorted(lines), schema, source.rescue, multi_line, _reading(source))
    elif _has_header(source):
        rows = csv_by_name(spark, by_header(lines), schema, source.rescue, multi_line, _reading(source))
    else:
        rows = csv_by_place(spark, sorted(lines), schema, source.rescue, multi_line, _reading(source))
    return rows.withColumn(METADATA[0], F.current_timestamp())


def _reading(source: FileSource) -> dict:
    """Options for reading a file, without those for finding files."""
    finding = ("maxFilesPerTrigger", "maxBytesPerTrigger", "latestFirst", "maxFileAge", "recursiveFileLookup", "pathGlobFilter")
    return {k: v for k, v in source.options.items() if k not in finding}


def judged_files(spark: SparkSession, source: FileSource, files: Sequence[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Files with their first lines, and rejected files with the reason; only first lines are read."""
    good, bad = {}, {}
    for path, line in first_lines(spark, files, _reading(source).get("encoding", "UTF-8")).items():
        if isinstance(line, Exception):
            bad[path] = f"unreadable: {_reason(line)}"
        elif line is None:
            bad[path] = EMPTY
        elif source.marker and source.marker in line and not line.lstrip().startswith(("{", "[")):
            bad[path] = INVALID
        else:
            good[path] = line
    return good, bad


def _reason(error: Exception) -> str:
    java = getattr(error, "java_exception", None)
    return (java.toString() if java is not None else str(error)).splitlines()[0][:500]


def unreadable_file(error: Exception, files: Sequence[str]) -> str | None:
    """The one of ``files`` that an error of Spark names as not readable; None for any other error."""
    if not isinstance(error, PySparkException) and not hasattr(error, "java_exception"):
        return None
    named = re.search(r"\[FAILED_READ_FILE[^\]]*\] [^\n]*?reading file (.+?)\.  ?(?:SQLSTATE|\n|$)", str(error), re.S)
    if named is None:
        return None
    wanted = _plain(named[1])
    return next((f for f in files if _plain(f) == wanted), None)


def _plain(path: str) -> str:
    """A path without its scheme's empty authority."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def ingest(spark: SparkSession, source: FileSource) -> int:
    """Append all files not seen before to the table, then stop. Returns the rows (or documents) read.

    The checkpoint remembers the files, so running again adds nothing. Fields
    added to the declared schema since the last run are added to the table; without a declared schema, so are columns that
    CSV files bring for the first time, and the remembered schema gets a new version. Values that do not fit a column's type are rescued. A batch that is
    repeated after a crash replaces its own files in the table, so it counts once.

    A file that is empty, holds a message instead of data, or cannot be read (or not in the mode FAILFAST) is left out and
    noted in the table of rejected files, (file, reason, batch, rejected_at), beside the source's table; all others go on.
    Files that a run has rejected are not tried again; a corrected one has to come under a new name.
    """
    return ingest_counted(spark, source)[0]


def ingest_counted(spark: SparkSession, source: FileSource) -> tuple[int, int]:
    """As ``ingest``; rows and rejected files."""
    schema = declared_fields(spark, source)
    paths = file_paths(spark, source.path, source.fmt, _settings(source))
    rescued = [T.StructField(RESCUED, T.StringType())] if source.rescue else []
    stamps = [T.StructField(METADATA[0], T.TimestampType()), T.StructField(METADATA[1], T.StringType())]
    _ensure(spark, source.table, T.StructType([*schema.fields, *rescued, *stamps]))
    rejects = rejected_table(source.table)
    counts: list[tuple[int, int]] = []
    known = [schema]

    def evolve(own: SparkSession, lines: dict[str, str]) -> None:
        """New columns of a source without a declared schema: a new version of the remembered one, and of the table."""
        if source.schema is not None or not _has_header(source):
            return
        more = new_columns(own, by_header(lines), known[0], _reading(source))
        if more:
            known[0] = T.StructType([*known[0].fields, *more])
            add_columns(own, source.table, more)
            save_schema(own, known[0], source.schema_path)

    def append(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        files = sorted(r.path for r in batch.distinct().collect())  # at most the files of one batch
        good, bad = judged_files(own, source, files)
        evolve(own, good)
        rows = 0
        while good:
            try:
                rows = publish_batch(rows_of_files(own, source, known[0], good), source.table, source.checkpoint, number)
                break
            except Exception as error:
                broken = unreadable_file(error, list(good))
                if broken is None:
                    raise  # no fault of a file
                bad[broken] = f"unreadable: {_reason(error)}"
                del good[broken]
        if not good:
            publish_batch(own.createDataFrame([], spark.read.table(source.table).schema), source.table, source.checkpoint, number)
        if bad:
            _ensure(own, rejects, T.StructType.fromDDL(REJECTED_SCHEMA))
            noted = own.createDataFrame([(f, why, number) for f, why in sorted(bad.items())], "file string, reason string, batch long")
            publish_batch(noted.withColumn("rejected_at", F.current_timestamp()), rejects, source.checkpoint, number)
        counts.append((rows, len(bad)))

    query = paths.writeStream.foreachBatch(append).option("checkpointLocation", source.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    counts.append((0, _note_empty(spark, source)))
    for name in (source.table, rejects):
        if spark.catalog.tableExists(name):
            spark.catalog.refreshTable(name)
    return sum(r for r, _ in counts), sum(b for _, b in counts)


def _note_empty(spark: SparkSession, source: FileSource) -> int:
    """Note the files without a byte, which no file source of Spark ever lists. Returns how many are new.

    All of them are noted anew on each run, as one batch that replaces the one before.
    """
    rejects, pattern = rejected_table(source.table), source.options.get("pathGlobFilter", f"*.{source.fmt}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{literal(source.path)}/{pattern}")
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place) or []
    empty = sorted(s.getPath().toString() for s in listed if s.getLen() == 0 and s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    if not empty:
        return 0
    _ensure(spark, rejects, T.StructType.fromDDL(REJECTED_SCHEMA))
    spark.catalog.refreshTable(rejects)
    noted = spark.createDataFrame([(f, EMPTY) for f in empty], "file string, reason string")
    new = noted.join(spark.read.table(rejects), "file", "left_anti").count()
    if new:
        whole = noted.select("file", "reason", F.lit(NO_BATCH).cast("long").alias("batch"), F.current_timestamp().alias("rejected_at"))
        publish_batch(whole, rejects, source.checkpoint, NO_BATCH)
    return new


def rejected_table(table: str) -> str:
    """Name of the table of rejected files beside a table."""
    return f"{table[:-1]}{REJECTED}`" if table.endswith("`") else f"{table}{REJECTED}"


def _ensure(spark: SparkSession, table: str, fields: T.StructType) -> None:
    """A table with at least these fields; one that an earlier session left on disk is taken up again."""
    if spark.catalog.tableExists(table) or adopt(spark, table):
        add_columns(spark, table, fields)
    else:
        spark.createDataFrame([], fields).write.format("parquet").saveAsTable(table)


def _mark(checkpoint: str) -> str:
    return f"batch-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"


def batch_number(file_name: Column, checkpoint: str) -> Column:
    """The number of the batch that wrote a file of a table, from the file's name; null for files of another source."""
    return F.regexp_extract(file_name, rf"^{_mark(checkpoint)}-(\d{{8}})-", 1).try_cast("int")


def publish_batch(batch: DataFrame, table: str, checkpoint: str, number: int) -> int:
    """Add a batch to a Parquet table under file names of its own; the same batch again replaces them. Returns its rows."""
    spark = batch.sparkSession
    place = table_location(spark, table)
    mark = f"{_mark(checkpoint)}-{number:08d}"
    staged = f"{place}/_{mark}"  # readers skip it; a rename stays within one file system
    target = spark.read.table(table).schema
    have = set(batch.columns)
    batch.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in target]).write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(target).parquet(staged).count()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(path(f"{place}/{mark}-*")) or []:  # of an attempt that was cut short
        files.delete(status.getPath(), False)
    for k, status in enumerate(files.globStatus(path(f"{staged}/part-*")) or []):
        if not files.rename(status.getPath(), path(f"{place}/{mark}-{k:05d}.parquet")):
            raise OSError(f"cannot move {status.getPath().toString()} into {table}")
    files.delete(path(staged), True)
    return rows


def ingest_all(spark: SparkSession, sources: Sequence[FileSource]) -> DataFrame:
    """Ingest several sources; one that fails is reported and does not stop the others."""
    lines = []
    for source in sources:
        try:
            lines.append((source.table, True, *ingest_counted(spark, source), None))
        except Exception as error:  # noqa: BLE001 - any failure of one source is its own
            log.error("source of %s failed: %s", source.table, error)
            lines.append((source.table, False, None, None, str(error)))
    return spark.createDataFrame(lines, STATUS_SCHEMA)
