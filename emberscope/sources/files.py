"""Schemas of landing files and rescue of what does not fit them."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESCUED = "_rescued_data"
FORMATS = ("csv", "json")


def remembered_schema(spark: SparkSession, path: str, schema_path: str, fmt: str) -> T.StructType:
    """The schema saved at ``schema_path``; inferred from the files and saved on first use."""
    saved = load_schema(spark, schema_path)
    if saved is not None:
        return saved
    reader = spark.read.option("pathGlobFilter", f"*.{fmt}")
    if fmt == "csv":
        schema = _inferred(spark, path)
    elif fmt == "json":
        schema = reader.option("multiLine", True).json(path).schema
    else:
        raise ValueError(f"format is one of {FORMATS}")
    save_schema(spark, schema, schema_path)
    return schema


def schema_log(spark: SparkSession, schema_path: str) -> DataFrame | None:
    """All versions of a remembered schema, (version, schema as JSON); None before the first."""
    try:
        lines = spark.read.text(schema_path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    version = F.col("version") if "version" in lines.columns else F.lit(0)
    return lines.select(version.cast("int").alias("version"), F.col("value").alias("schema"))


def load_schema(spark: SparkSession, schema_path: str) -> T.StructType | None:
    """The newest version of a remembered schema."""
    log = schema_log(spark, schema_path)
    line = None if log is None else log.orderBy(F.desc("version")).first()
    return T.StructType.fromJson(json.loads(line["schema"])) if line else None


def save_schema(spark: SparkSession, schema: T.StructType, schema_path: str) -> int:
    """Add a version to a remembered schema, if it differs from the newest; returns its number."""
    log = schema_log(spark, schema_path)
    last = None if log is None else log.orderBy(F.desc("version")).first()
    if last is not None and last["schema"] == schema.json():
        return last["version"]
    number = 1 if last is None else last["version"] + 1
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{schema_path}/version={number}")
    return number


def new_columns(spark: SparkSession, headers: dict[str, list[str]], schema: T.StructType, options: dict) -> list[T.StructField]:
    """Columns of some files that a schema does not have, in any case, with the narrowest types for all their values in these files."""
    known, found = {f.name.lower() for f in schema}, {}
    for line, own in headers.items():
        fresh = {n for n in _names(line, options) if n and n.lower() not in known}
        if not fresh:
            continue
        reading = {k: v for k, v in options.items() if k != "pathGlobFilter"}
        for field in spark.read.options(**reading).option("header", True).option("inferSchema", True).csv([literal(f) for f in own]).schema:
            if field.name in fresh:
                found[field.name] = wider(found.get(field.name, field.dataType), field.dataType)
    out: dict[str, T.StructField] = {}
    for name, kind in found.items():
        out.setdefault(name.lower(), T.StructField(name, kind))
    return list(out.values())


def literal(path: str) -> str:
    """A path that a reader takes as it is, though its name holds characters of a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str | None:
    """The first line of a file that is not blank, without a byte-order mark; None if there is none. Nothing behind it is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        source = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, encoding))
        line = reader.readLine()
        while line is not None and not line.lstrip("\ufeff").strip():
            line = reader.readLine()
        return None if line is None else line.lstrip("\ufeff")
    finally:
        stream.close()


def first_lines(spark: SparkSession, files: Iterable[str], encoding: str = "UTF-8") -> dict[str, str | None | Exception]:
    """The first line of each file, or why it cannot be read. Meant for the files of one batch, of which there are so many at most."""

    def look(path: str) -> str | None | Exception:
        try:
            return first_line(spark, path, encoding)
        except Exception as error:  # noqa: BLE001 - whatever keeps this file from being read is its own
            return error

    files = list(files)
    with ThreadPoolExecutor(16) as pool:
        return dict(zip(files, pool.map(look, files), strict=True))


def by_header(lines: dict[str, str | None | Exception]) -> dict[str, list[str]]:
    """The files of each distinct first line, in order; files without one are left out."""
    out: dict[str, list[str]] = {}
    for path, line in sorted(lines.items()):
        if isinstance(line, str):
            out.setdefault(line, []).append(path)
    return dict(sorted(out.items()))


def _batches(items: Iterable[str], size: int) -> Iterable[list[str]]:
    held: list[str] = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _names(line: str, options: dict) -> list[str]:
    delimiter = options.get("sep", options.get("delimiter", ","))
    return [n.strip() for n in next(csv.reader([line], delimiter=delimiter, quotechar=options.get("quote", '"')), [])]


#: Types that hold all values of the ones before them.
_WIDER = ((T.IntegerType(), T.LongType(), T.DoubleType()), (T.DateType(), T.TimestampType()))


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type for values of both: along numbers or times, else text. The order of merging does not matter."""
    for line in _WIDER:
        if a in line and b in line:
            return line[max(line.index(a), line.index(b))]
    return a if a == b else T.StringType()


def _inferred(spark: SparkSession, path: str, glob: str = "*.csv", size: int = 1000) -> T.StructType:
    """Columns by name over all files, a bounded number of files at a time; a column of unlike types is text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    found: dict[str, T.DataType] = {}
    for batch in _batches((r.path for r in files.toLocalIterator()), size):
        for own in by_header(first_lines(spark, batch)).values():
            for field in spark.read.option("header", True).option("inferSchema", True).csv([literal(f) for f in own]).schema:
                found[field.name] = wider(found.get(field.name, field.dataType), field.dataType)
    if not found:
        raise ValueError("there is no CSV file to infer a schema from")
    return T.StructType([T.StructField(name, kind) for name, kind in found.items()])


def _matched(names: Sequence[str], declared: Sequence[str]) -> dict[int, str]:
    """The declared column that each place of a header stands for: the same name first, then in any case, the first of equals."""
    out: dict[int, str] = {}
    for same in (str, str.lower):
        wanted: dict[str, str] = {}
        for name in declared:
            if name not in out.values():
                wanted.setdefault(same(name), name)
        for i, name in enumerate(names):
            if i not in out and same(name) in wanted:
                out[i] = wanted.pop(same(name))
    return out


def csv_by_name(spark: SparkSession, headers: dict[str, list[str]], schema: T.StructType, rescue: bool, multi_line: bool, options: dict) -> DataFrame:
    """CSV files with a header, their columns matched to the schema by name; (fields, rescue column, source_filename).

    ``headers`` holds the files of each first line. Files may differ in the order and choice of columns: absent ones are null. With ``rescue``, a row that does not
    fit keeps its good fields and its raw line, and columns that are not declared are kept as a JSON object of texts.
    Names match exactly, or else in any case; of columns with the same name the first counts. Without files there are no rows.
    """
    declared = {f.name: f for f in schema}
    made = [*schema.fields, *([T.StructField(RESCUED, T.StringType())] if rescue else []), T.StructField("source_filename", T.StringType())]
    out = spark.createDataFrame([], T.StructType(made)) if not headers else None
    for line, own in headers.items():
        read, surplus = [], {}
        names = _names(line, options)
        at = _matched(names, list(declared))
        for i, name in enumerate(names):
            if i in at:
                read.append(T.StructField(f"__field_{i}", declared[at[i]].dataType))
            else:
                surplus[name] = f"__surplus_{i}"
                read.append(T.StructField(surplus[name], T.StringType()))
        reading = {**options, "header": "true", "multiLine": str(multi_line).lower(), "enforceSchema": "true"}
        reading.pop("pathGlobFilter", None)
        if rescue:
            read.append(T.StructField(RESCUED, T.StringType()))
            reading |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED}
        rows = spark.read.schema(T.StructType(read)).options(**reading).csv([literal(f) for f in own])
        place = {name: f"__field_{i}" for i, name in at.items()}
        fields = [F.col(place[n]).alias(n) if n in place else F.lit(None).cast(f.dataType).alias(n) for n, f in declared.items()]
        if rescue:
            left = [F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in surplus.items()]
            kept = F.lit(None).cast("string")
            if left:
                given = F.filter(F.array(*left), lambda x: x["value"].isNotNull())
                kept = F.when(F.size(given) > 0, F.to_json(F.map_from_entries(given)))
            fields.append(F.coalesce(F.col(RESCUED), kept).alias(RESCUED))
        part = rows.select(*fields, F.col("_metadata.file_path").alias("source_filename"))
        out = part if out is None else out.unionByName(part)
    return out


def csv_by_place(spark: SparkSession, files: Sequence[str], schema: T.StructType, rescue: bool, multi_line: bool, options: dict) -> DataFrame:
    """CSV files without a header: columns by position; (fields, rescue column, source_filename).

    A row that does not fit keeps its good fields, and with ``rescue`` its whole
    raw line goes to the rescue column. ``multi_line`` admits line breaks in
    quoted fields, at the price of files that cannot be split.
    """
    reading = {**options, "header": "false", "multiLine": str(multi_line).lower()}
    reading.pop("pathGlobFilter", None)
    if rescue:
        schema = T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
        reading |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED}
    rows = spark.read.schema(schema).options(**reading).csv([literal(f) for f in files])
    return rows.select(*schema.fieldNames(), F.col("_metadata.file_path").alias("source_filename"))


def json_documents(spark: SparkSession, files: Sequence[str], schema: T.StructType, rescue: bool, multi_line: bool, options: dict) -> DataFrame:
    """JSON documents, one per file with ``multi_line``, else one per line; (fields, rescue column, source_filename)."""
    given = {k: v for k, v in options.items() if k != "pathGlobFilter"}
    paths, name = [literal(f) for f in files], F.col("_metadata.file_path").alias("source_filename")
    if not rescue:
        return spark.read.schema(schema).options(**given).json(paths, multiLine=multi_line).select(*schema.fieldNames(), name)
    texts = spark.read.options(**given).text(paths, wholetext=multi_line)
    return texts.select(*parse_json(F.col("value"), schema), name)


def file_paths(spark: SparkSession, path: str, fmt: str, options: dict) -> DataFrame:
    """New files of a folder as a stream of their paths; contents are not read.

    A path may come more than once in a batch where names hold characters of a pattern.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    given = {k: v for k, v in options.items() if k in ("pathGlobFilter", "maxFilesPerTrigger", "maxBytesPerTrigger", "latestFirst", "maxFileAge", "recursiveFileLookup")}
    return spark.readStream.format("binaryFile").schema(schema).options(**{"pathGlobFilter": f"*.{fmt}", **given}).load(path).select("path")


def parse_json(text: Column, schema: T.StructType) -> list[Column]:
    """Declared fields plus the rescue column.

    Undeclared fields, at the top and one level down, are kept as a JSON object
    with dotted names; a document that is not valid for the schema is kept whole.
    """
    wide = T.StructType([*schema.fields, T.StructField(RESCUED, T.StringType())])
    parsed = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RESCUED})
    top = F.from_json(text, "map<string,string>")
    unknown = _undeclared(top, schema.fieldNames(), "")
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            nested = F.from_json(F.try_element_at(top, F.lit(field.name)), "map<string,string>")
            inner = _undeclared(nested, field.dataType.fieldNames(), f"{field.name}.")
            unknown = F.map_concat(unknown, inner)
    surplus = F.when(F.map_keys(unknown) != F.array().cast("array<string>"), F.to_json(unknown))
    rescued = F.coalesce(parsed[RESCUED], surplus).alias(RESCUED)
    return [*[parsed[name].alias(name) for name in schema.fieldNames()], rescued]


def _undeclared(fields: Column, declared: list[str], prefix: str) -> Column:
    others = F.map_filter(fields, lambda k, _: ~k.isin(*declared)) if declared else fields
    named = F.transform_keys(others, lambda k, _: F.concat(F.lit(prefix), k))
    return F.coalesce(named, F.create_map().cast("map<string,string>"))
