"""File streams into tables, rescue, audits, live scoring and the whole build."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope import vocabulary as V
from emberscope.functions.timekeys import HOUR
from emberscope.operators.frames import lagged, over_time, trailing
from emberscope.operators.grid import GridSpec
from emberscope.operators.modeling import fit_forest, score
from emberscope.operators.nested import build_documents
from emberscope.operators.quality import schema_drift as drift_table
from emberscope.plans.features import stateless_features
from emberscope.plans.losses import Losses
from emberscope.plans.medallion import Tables, build
from emberscope.plans.refresh import refresh
from emberscope.session import fresh_dir, materialize
from emberscope.sources.files import schema_log
from emberscope.sources.landing import document_variables, landing_audit as audit_listing, listed_payloads, write_documents
from emberscope.streaming.ingest import FileSource, ingest, ingest_all, rejected_table
from emberscope.streaming.scoring import LiveScores, drain, forecast_stream, score_with_history, scored_stream

from .base import VARIABLES, complete_gold, doubles, plain, query, table, weather, with_sql
from .joins import _CELLS as CELLS_SQL
from .series import _TIME_COLUMNS, CYCLES, INDEX, TRAINING_SQL, six
from .tables import new_schema

EVENT_CSV = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def _source(spark, path, name, fmt, schema=None, **more):
    state = fresh_dir(spark, "state")
    return FileSource(path, f"{new_schema(spark, 'bronze')}.{name}", f"{state}/checkpoint", f"{state}/schema", fmt, schema, **more)


def _write_events_csv(df, path):
    df.select("event_id", "user_id", "event_type", "value").write.mode("append").option("header", True).csv(path)


@query("SELECT event_id, user_id, event_type, value FROM events")
def ingest_stream(spark, sf_dir):
    """Events as CSV files, delivered in two lots and ingested after each, and once more without news."""
    path = fresh_dir(spark, "landing")
    events = table(spark, sf_dir, "events")
    source = _source(spark, path, "events", "csv", EVENT_CSV)
    _write_events_csv(events.filter("event_type = 'error'"), path)
    ingest(spark, source)
    _write_events_csv(events.filter("event_type <> 'error'"), path)
    ingest(spark, source)
    ingest(spark, source)
    return spark.read.table(source.table).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type, value FROM events")
def ingest_inferred(spark, sf_dir):
    """The same without a declared schema: it is inferred once and remembered."""
    path = fresh_dir(spark, "landing")
    _write_events_csv(table(spark, sf_dir, "events"), path)
    source = _source(spark, path, "events", "csv")
    ingest(spark, source)
    types = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double"}
    return spark.read.table(source.table).select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


@query(
    """
SELECT event_id, user_id, CASE WHEN event_id % 3 = 1 THEN value WHEN event_id % 3 = 2 AND event_id % 4 <> 0 THEN value END AS value,
       CASE WHEN event_id % 3 = 2 THEN event_type END AS event_type, event_id % 3 = 2 AND event_id % 4 = 0 AS rescued, 3 AS versions FROM events"""
)
def ingest_evolving(spark, sf_dir):
    """Three drops without a declared schema: a column comes with the second, another with the third, in which some values no longer fit."""
    path = fresh_dir(spark, "landing")
    source = _source(spark, path, "events", "csv")
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value")
    for lot, columns in enumerate((["event_id", "user_id"], ["user_id", "value", "event_id"], ["event_id", text, "event_type", "user_id"])):
        e.filter(F.col("event_id") % 3 == lot).select(*columns).write.mode("append").option("header", True).csv(path)
        ingest(spark, source)
    versions = schema_log(spark, source.schema_path).agg(F.max("version")).scalar()
    out = spark.read.table(source.table)
    return out.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        "value",
        "event_type",
        F.col("_rescued_data").isNotNull().alias("rescued"),
        versions.alias("versions"),
    )


@query(
    """
SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN '{"note":"n' || event_id || '"}' END AS rescued FROM events"""
)
def ingest_by_name(spark, sf_dir):
    """Files whose headers differ in the order of columns, and one kind with a column that is not declared."""
    path = fresh_dir(spark, "landing")
    e = table(spark, sf_dir, "events")
    e.filter("event_id % 2 = 1").select("value", "event_id", "event_type", "user_id").write.option("header", True).csv(path)
    note = F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("note")
    more = e.filter("event_id % 2 = 0").select("user_id", note, "value", "event_type", "event_id")
    more.write.mode("append").option("header", True).csv(path)
    source = _source(spark, path, "events", "csv", EVENT_CSV)
    ingest(spark, source)
    return spark.read.table(source.table).select("event_id", "user_id", "event_type", "value", F.col("_rescued_data").alias("rescued"))


@query(
    """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, event_type, value,
       event_id % 5 = 0 OR event_id % 7 = 0 AS rescued FROM events""",
    name="rescue_stream",
)
def rescue_csv(spark, sf_dir):
    """Rows with a surplus field or an unreadable number keep their good fields and their raw line."""
    path = fresh_dir(spark, "landing")
    e = table(spark, sf_dir, "events")
    user = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
    line = F.concat_ws(",", F.col("event_id").cast("string"), user, "event_type", F.col("value").cast("string"))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(line, F.lit(",surplus"))).otherwise(line)
    # Text files carry no header of their own: the reader is told so.
    e.select(line.alias("value")).write.text(path)
    source = _source(spark, path, "events", "csv", EVENT_CSV, options={"pathGlobFilter": "*.txt", "header": "false"})
    ingest(spark, source)
    rescued = F.col("_rescued_data").isNotNull().alias("rescued")
    return spark.read.table(source.table).select("event_id", "user_id", "event_type", "value", rescued)


@query(
    """
SELECT event_id, user_id, value, CASE WHEN event_id % 5 = 0 THEN '{"extra":"' || event_type || '","nested.more":"1"}' END AS rescued
FROM events"""
)
def rescue_json(spark, sf_dir):
    """Undeclared JSON fields, at the top and one level down, are kept beside the declared ones."""
    path = fresh_dir(spark, "landing")
    odd = F.col("event_id") % 5 == 0
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.struct(F.col("value"), F.when(odd, F.lit(1)).alias("more")).alias("nested"),
        F.when(odd, F.col("event_type")).alias("extra"),
    )
    e.write.json(path)
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, nested struct<value: double>")
    source = _source(spark, path, "events", "json", schema, multi_line=False)
    ingest(spark, source)
    return spark.read.table(source.table).select(
        "event_id", "user_id", F.col("nested.value").alias("value"), F.col("_rescued_data").alias("rescued")
    )


def _write_documents(spark, sf_dir, per_file=1):
    """JSON documents per cell and period: in files of their own, as the weather landing area holds them, or packed."""
    path = fresh_dir(spark, "documents")
    w = weather(spark, sf_dir)
    docs = build_documents(
        w.withColumnRenamed("grid_id", "cell_id"), "cell_id", "timestamp_clima", V.CLIMATE_VARIABLES, ["latitude", "longitude", "elevation"]
    )
    named = docs.select(
        "cell_id",
        F.col("latitude").alias("request_latitude"),
        F.col("longitude").alias("request_longitude"),
        F.col("elevation").alias("elevation_val"),
        "hourly",
    )
    write_documents(named, path, per_file)
    return path


@query("SELECT count(DISTINCT user_id) AS files, CAST(100 AS DOUBLE) * count(DISTINCT user_id) / 160 AS progress, 13 AS series FROM events WHERE event_type <> 'error'")
def landing_audit(spark, sf_dir):
    """Files of the weather landing area, their progress, and the fewest series any of them holds."""
    path = _write_documents(spark, sf_dir)
    landed = document_variables(listed_payloads(spark, path, ".json"))
    audit = audit_listing(landed, 160, [F.min("n_variables").alias("series")])
    return audit.select("files", (F.col("files").cast("double") * 100 / 160).alias("progress"), "series")


def _text_files(spark, path, texts):
    """Files of these names and texts, written as any other program would: through the file system of the path."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    for name, text in texts.items():
        out = files.create(jvm.org.apache.hadoop.fs.Path(folder, name), True)
        out.write(bytearray(text.encode()))
        out.close()


def _rename_parts(spark, path, names):
    """Give the part files of a folder other names; one for each name at most."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    for part, name in zip(parts, names, strict=False):
        files.rename(jvm.org.apache.hadoop.fs.Path(folder, part), jvm.org.apache.hadoop.fs.Path(folder, name))


ODD_NAMES = ["a b.csv", "a%20b.csv", "a[1].csv", "a{1,2}.csv", "a#b.csv", "a?.csv", "ä.csv", "a*.csv"]


@query("SELECT event_id, user_id, event_type, value FROM events")
def ingest_odd_names(spark, sf_dir):
    """Files whose names hold spaces, escapes and characters of patterns, delivered in two lots: each is read once."""
    path = fresh_dir(spark, "landing")
    e = table(spark, sf_dir, "events")
    source = _source(spark, path, "events", "csv", EVENT_CSV)
    for lot, at in (("event_id % 3 = 0", 0), ("event_id % 3 <> 0", 4)):
        _write_events_csv(e.filter(lot).repartition(4, "event_id"), path)
        _rename_parts(spark, path, ODD_NAMES[at : at + 4])
        ingest(spark, source)
    return spark.read.table(source.table).select("event_id", "user_id", "event_type", "value")


@query(
    """
SELECT 'rows' AS what, CAST(count(*) AS VARCHAR) AS said FROM events
UNION ALL SELECT 'sum of ids', CAST(sum(event_id) AS VARCHAR) FROM events
UNION ALL SELECT * FROM (VALUES ('empty.csv', 'empty file'), ('blank.csv', 'empty file'), ('message.csv', 'invalid payload'),
                                ('noise.csv.gz', 'unreadable'), ('status', 'true 4'))"""
)
def ingest_quarantine(spark, sf_dir):
    """Good files among an empty one, a blank one, a message and one that cannot be unpacked: those are set aside with the reason, the rest is all there."""
    path = fresh_dir(spark, "landing")
    e = table(spark, sf_dir, "events")
    _write_events_csv(e.repartition(2, "event_id"), path)
    _text_files(spark, path, {"empty.csv": "", "blank.csv": "\n \n", "message.csv": "Invalid API call.", "noise.csv.gz": "not packed"})
    source = _source(spark, path, "events", "csv", EVENT_CSV, options={"pathGlobFilter": "*.csv*"})
    status = ingest_all(spark, [source]).select(F.lit("status").alias("what"), F.concat_ws(" ", F.col("ok").cast("string"), F.col("rejected").cast("string")).alias("said"))
    read = spark.read.table(source.table)
    rows = read.select(F.lit("rows").alias("what"), F.lit(1).alias("n")).groupBy("what").agg(F.count("n").cast("string").alias("said"))
    ids = read.agg(F.sum("event_id").cast("string").alias("said")).select(F.lit("sum of ids").alias("what"), "said")
    bad = spark.read.table(rejected_table(source.table))
    why = bad.select(F.substring_index("file", "/", -1).alias("what"), F.substring_index("reason", ":", 1).alias("said"))
    return rows.unionByName(ids).unionByName(why).unionByName(status)


@query("SELECT 'good' AS source, true AS ok, count(*) AS \"rows\" FROM events UNION ALL SELECT 'bad', false, NULL")
def ingest_status(spark, sf_dir):
    """A source without files fails and is reported; the other one is ingested all the same."""
    path = fresh_dir(spark, "landing")
    _write_events_csv(table(spark, sf_dir, "events"), path)
    good = _source(spark, path, "good", "csv", EVENT_CSV)
    bad = _source(spark, fresh_dir(spark, "absent"), "bad", "csv", EVENT_CSV)
    status = ingest_all(spark, [bad, good])
    return status.select(F.element_at(F.split("table", r"\."), 2).alias("source"), "ok", "rows")


@query(
    """
SELECT * FROM (VALUES ('event_type', NULL, 'string', 'missing'), ('kind', 'string', NULL, 'unexpected'),
                      ('user_id', 'string', 'bigint', 'type')) AS d(field, actual, declared, drift)
WHERE (SELECT count(*) FROM events) > 0"""
)
def schema_drift(spark, sf_dir):
    """Ingested table against the declared schema after the feed changed a name and a type."""
    path = fresh_dir(spark, "landing")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("event_type").alias("kind"), "value")
    e.write.option("header", True).csv(path)
    changed = T.StructType.fromDDL("event_id bigint, user_id string, kind string, value double")
    source = _source(spark, path, "events", "csv", changed, rescue=False)
    ingest(spark, source)
    actual = spark.read.table(source.table).drop("ingestion_timestamp", "source_filename").schema
    return drift_table(spark, actual, EVENT_CSV)


@query(
    with_sql(
        "weather",
        f"SELECT grid_id, timestamp_clima, {INDEX}, {CYCLES} FROM w",
        w=f"SELECT grid_id, timestamp_clima, {doubles('temperature_2m', 'wind_speed_10m', 'relative_humidity_2m')} FROM weather",
    )
)
def forecast_scoring(spark, sf_dir):
    """Hourly rows as a file stream in two lots, some delivered again, each scored once with stateless features."""
    feed_path, out, state = fresh_dir(spark, "feed"), fresh_dir(spark, "scored"), fresh_dir(spark, "state")
    hours = weather(spark, sf_dir).select(
        "grid_id",
        F.col("timestamp_clima").cast("timestamp").alias("timestamp_clima"),
        *[F.col(c).cast("double").alias(c) for c in ("temperature_2m", "wind_speed_10m", "relative_humidity_2m")],
    )
    # the second lot brings cells the first had none of, at hours that lie before its last
    odd = F.xxhash64("grid_id") % 2 == 0
    for lot in (hours.filter(odd).unionByName(hours.filter(odd)), hours):
        lot.write.mode("append").parquet(feed_path)
        feed = forecast_stream(spark, feed_path, hours.schema)
        drain(scored_stream(feed, ["grid_id"], "timestamp_clima", stateless_features), out, state)
    scored = spark.read.parquet(out)
    names = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
    return plain(scored.select("grid_id", "timestamp_clima", "fire_spread_index", *[F.col(n).cast("decimal(28,6)").alias(n) for n in names]))


_LIVE = ("temperature_2m", "precipitation")
_LIVE_LAGS = [("temperature_2m", h) for h in (6, 12, 24, 48)]
_FEED_HOURS, _HALF = 120, 60


def _live_frames():
    frames = [lagged(f"{c}_lag_{h}h", c, h * HOUR) for c, h in _LIVE_LAGS]
    for h in (24, 48, 96):
        frames += [trailing(f"precipitation_sum_{h}h", "precipitation", "sum", h * HOUR), trailing(f"temperature_2m_mean_{h}h", "temperature_2m", "mean", h * HOUR)]
    return frames


_LAG_SQL = ", ".join(
    f"CAST(max({c}) OVER (w RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL {h} HOUR PRECEDING) AS DOUBLE) AS {c}_lag_{h}h" for c, h in _LIVE_LAGS
)
_LIVE_COMPLETE = " AND ".join(f"{c}_lag_{h}h IS NOT NULL" for c, h in _LIVE_LAGS)


@query(
    with_sql(
        "complete_gold",
        f"""SELECT *, {_LIVE_COMPLETE} AS has_score FROM framed
WHERE timestamp_clima > (SELECT max(timestamp_clima) - INTERVAL {_FEED_HOURS} HOUR FROM filled)""",
        filled="SELECT grid_id, timestamp_clima, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _LIVE) + " FROM complete_gold",
        framed=f"SELECT grid_id, timestamp_clima, {_LAG_SQL}, {_TIME_COLUMNS} FROM filled WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)",
    )
)
def live_scoring(spark, sf_dir):
    """The last five days as a feed in two lots, partly repeated, scored by a saved forest on lags and rolling values.

    The features of the second lot reach into the history and into the first lot.
    """
    hours = complete_gold(spark, sf_dir).select(
        "grid_id", F.col("timestamp_clima").cast("timestamp").alias("timestamp_clima"), "target", *[F.coalesce(F.col(c), F.lit(0).cast("decimal(8,2)")).alias(c) for c in _LIVE]
    )
    hours = materialize(hours, "hours")
    end = hours.agg(F.max("timestamp_clima")).scalar()
    at = F.col("timestamp_clima")
    start, middle = (end - F.make_dt_interval(hours=F.lit(h)) for h in (_FEED_HOURS, _HALF))
    history = hours.filter(at <= start)
    frames = _live_frames()
    features = [f.name for f in frames]
    train = over_time(history, ["grid_id"], "timestamp_clima", frames).select("target", *[F.col(c).cast("double").alias(c) for c in features])
    # a forest goes over its rows several times, and each time the windows would be taken again
    train = materialize(train, "train")
    model_path = fresh_dir(spark, "model")
    fit_forest(train, features, positive_weight=10.0, trees=5, depth=4).write().save(model_path)
    model = PipelineModel.load(model_path)
    feed_path, state = fresh_dir(spark, "feed"), fresh_dir(spark, "state")

    def finish(rows):
        scored = score(model, rows.withColumns({c: F.col(c).cast("double") for c in features}), keep_incomplete=True)
        return scored.withColumn("has_score", F.coalesce(F.col("score").between(0, 1), F.lit(False)))

    live = LiveScores(["grid_id"], "timestamp_clima", list(_LIVE), frames, f"{new_schema(spark, 'live')}.scored", state, finish)
    feed = hours.drop("target")
    odd = F.xxhash64("grid_id") % 2 == 0
    # the second lot repeats the first, and history; half of the cells come with it only
    for lot in (feed.filter((at > start) & (at <= middle) & odd), feed.filter(at > start - F.make_dt_interval(hours=F.lit(24)))):
        lot.write.mode("append").parquet(feed_path)
        score_with_history(forecast_stream(spark, feed_path, feed.schema), history, live)
    return plain(spark.read.table(live.table).select("grid_id", "timestamp_clima", *features, "has_score"))


_FULL = " AND ".join(f"{c} IS NOT NULL" for c in VARIABLES)


_FEATURES_SQL = with_sql(
        "gold",
        f"""SELECT cell AS grid_id, timestamp_clima, latitude, longitude, elevation, {doubles(*VARIABLES)}, target,
{doubles('fire_intensity')}, fire_confidence, {six('precip_acum_7d', 'precip_acum_7d')}, {six('precip_acum_3d', 'precip_acum_3d')},
{doubles('temp_max_3d')}, {INDEX}, {CYCLES}
FROM (SELECT *, CAST(latitude AS VARCHAR) || '_' || CAST(longitude AS VARCHAR) AS cell,
             sum(precipitation) OVER (w ROWS 168 PRECEDING) AS precip_acum_7d, sum(precipitation) OVER (w ROWS 72 PRECEDING) AS precip_acum_3d,
             max(temperature_2m) OVER (w ROWS 72 PRECEDING) AS temp_max_3d
      FROM gold WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)) AS r
WHERE {_FULL}""",
    )


def _cell_of(user):
    return ((F.lit(-325) + user % 20).cast("double") / 10.0).alias("latitude"), ((F.lit(-650) + F.floor(user / 20)).cast("double") / 10.0).alias("longitude")


def _write_detections(spark, errors, path):
    letters = F.array(F.lit("l"), F.lit("n"), F.lit("h"))
    errors.select(
        *_cell_of(F.col("user_id")),
        F.to_date("ts").alias("acq_date"),
        (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"),
        F.get(letters, (F.col("event_id") % 3).cast("int")).alias("confidence"),
        F.col("value").alias("frp"),
    ).write.mode("append").option("header", True).csv(path)


def _layers(spark, sf_dir):
    """Table names in schemas of their own, and a grid that holds every user's cell."""
    layer = {name: new_schema(spark, name) for name in ("landing", "bronze", "silver", "gold")}
    named = {
        "landing_grid": "landing",
        "bronze_fires": "bronze",
        "bronze_weather": "bronze",
        "silver_grid": "silver",
        "silver_fires": "silver",
        "silver_weather": "silver",
        "gold_full": "gold",
        "gold_features": "gold",
    }
    # twenty cells to a column, as many columns as the users fill
    last = table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0]
    return Tables(**{t: f"{layer[where]}.{t}" for t, where in named.items()}), GridSpec(-3250, -3050, -6500, -6500 + 10 * (last // 20 + 1), 10)


def _checked(status):
    if failed := status.filter("NOT ok").collect():
        raise RuntimeError(str(failed))


def _six_digits(features):
    rounded = ["precip_acum_7d", "precip_acum_3d", "hour_sin", "hour_cos", "month_sin", "month_cos"]
    return plain(features.withColumns({c: F.col(c).cast("decimal(28,6)") for c in rounded}))


@query(_FEATURES_SQL)
def medallion_build(spark, sf_dir):
    """From CSV detections and JSON weather documents through every layer to the feature table."""
    weather_path, fires_path = _write_documents(spark, sf_dir, 500), fresh_dir(spark, "fires")
    _write_detections(spark, table(spark, sf_dir, "events").filter("event_type = 'error'"), fires_path)
    tables, grid = _layers(spark, sf_dir)
    _checked(build(spark, fires_path, weather_path, fresh_dir(spark, "state"), grid, tables, layers=(), weather_multi_line=False))
    return _six_digits(spark.read.table(tables.gold_features))


# hours of weather alone make the period, cells are named by their place, and the neighbours are those of the whole grid
_PLACE = "CAST(latitude AS VARCHAR) || '_' || CAST(longitude AS VARCHAR)"
_BUILT_SQL = (
    TRAINING_SQL.replace("complete_gold", "placed_gold")
    .replace("placed_gold AS (", "complete_gold AS (", 1)
    .replace("FROM ev) AS b", "FROM ev WHERE event_type <> 'error') AS b")
    .replace("(SELECT DISTINCT user_id FROM events) AS u", "(SELECT DISTINCT user_id FROM events WHERE event_type <> 'error') AS u")
    .replace("block AS (", f"placed_gold AS (SELECT * REPLACE ({_PLACE} AS grid_id) FROM complete_gold),\nblock AS (", 1)
    .replace(
        CELLS_SQL,
        f"SELECT {_PLACE} AS cell_id, * FROM (SELECT CAST(-325 + i % 20 AS DOUBLE) / 10 AS latitude, CAST(-650 + i // 20 AS DOUBLE) / 10 AS longitude "
        "FROM (SELECT unnest(generate_series(0, (max(user_id) // 20 + 1) * 20 - 1)) AS i FROM ev))",
    )
)
_EXACT = ("hours_in_block", "target", "dry_hours", "target_ahead", "fires_near")
_AS_IT_IS = ", ".join(f"'{c}'" for c in ("grid_id", "block_start", *_EXACT))


@query(
    f"""SELECT COLUMNS(lambda c: c IN ({_AS_IT_IS})), CAST(round(CAST(COLUMNS(lambda c: c NOT IN ({_AS_IT_IS}, 'wind_direction_10m')) AS DECIMAL(28,9)), 5) AS DOUBLE)
FROM ({_BUILT_SQL}) AS t"""
)
def training_build(spark, sf_dir):
    """From landing files through every layer to the training table of six-hour blocks."""
    weather_path, fires_path = _write_documents(spark, sf_dir, 500), fresh_dir(spark, "fires")
    _write_detections(spark, table(spark, sf_dir, "events").filter("event_type = 'error'"), fires_path)
    tables, grid = _layers(spark, sf_dir)
    name = f"{tables.gold_full}_training"
    _checked(build(spark, fires_path, weather_path, fresh_dir(spark, "state"), grid, tables, layers=(), weather_multi_line=False, training=name))
    out = plain(spark.read.table(name).drop("wind_direction_10m"))
    # six digits first where the SQL says so, and then five of everything, as sums of doubles differ in the last ones
    six_first = ("temperature_near", "humidity_near", "hour_sin", "hour_cos", "month_sin", "month_cos")
    out = out.withColumns({c: F.col(c).cast("decimal(28,6)") for c in six_first})
    return out.withColumns({c: F.round(F.col(c).cast("decimal(28,9)"), 5).cast("double") for c in out.columns if c not in ("grid_id", "block_start", *_EXACT)})


@query(_FEATURES_SQL)
def incremental_build(spark, sf_dir):
    """The same in two drops of files, the second with other cells and more detections of the first ones' cells."""
    fires_path, weather_path, state = fresh_dir(spark, "fires"), fresh_dir(spark, "documents"), fresh_dir(spark, "state")
    tables, grid = _layers(spark, sf_dir)
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    documents = spark.read.schema(V.WEATHER_SCHEMA).json(_write_documents(spark, sf_dir, 500))
    early = F.pmod(F.xxhash64("cell_id"), F.lit(2)) == 0
    for lot, some in ((early, "event_id % 3 = 0"), (~early, "event_id % 3 <> 0")):
        documents.filter(lot).write.mode("append").json(weather_path)
        _write_detections(spark, errors.filter(some), fires_path)
        _checked(refresh(spark, fires_path, weather_path, state, grid, tables, layers=(), weather_multi_line=False))
    return _six_digits(spark.read.table(tables.gold_features).drop("year", "part"))


@query(
    with_sql(
        "gold",
        f"""
SELECT 'silver_fires' AS step, 'read' AS what, count(*) AS rows FROM located UNION ALL
SELECT 'silver_fires', 'kept', count(*) FROM placed UNION ALL
SELECT 'silver_fires', 'repeated', (SELECT count(*) FROM located) - (SELECT count(*) FROM placed) UNION ALL
SELECT 'silver_fires', 'without_time', 0 UNION ALL
SELECT 'silver_weather', 'documents', count(DISTINCT grid_id) + (SELECT count(DISTINCT user_id) FROM ev WHERE user_id % 7 = 0) FROM weather UNION ALL
SELECT 'silver_weather', 'unreadable', count(DISTINCT user_id) FROM ev WHERE user_id % 7 = 0 UNION ALL
SELECT 'silver_weather', 'hours', count(*) FROM weather UNION ALL
SELECT 'silver_weather', 'outside_grid', count(*) FROM weather WHERE latitude >= -31.5 UNION ALL
SELECT 'silver_weather', 'without_time', 0 UNION ALL
SELECT 'gold_full', 'detections', count(*) FROM hours UNION ALL
SELECT 'gold_full', 'rows', count(*) FROM weather UNION ALL
SELECT 'gold_full', 'labelled', count(*) FROM gold WHERE target = 1 UNION ALL
SELECT 'gold_full', 'orphans', count(*) FROM hours AS h ANTI JOIN weather AS w USING (fecha_join, hora_join, latitude, longitude) UNION ALL
SELECT 'gold_features', 'read', count(*) FROM gold UNION ALL
SELECT 'gold_features', 'kept', count(*) FROM gold WHERE {_FULL} AND latitude < -31.5 UNION ALL
SELECT 'gold_features', 'incomplete', count(*) FROM gold WHERE NOT ({_FULL}) OR latitude >= -31.5""",
        located="SELECT * FROM ev WHERE event_type = 'error'",
        placed="SELECT DISTINCT CAST(ts AS DATE), hour(ts), minute(ts), latitude, longitude FROM located",
        hours="SELECT DISTINCT fecha_join, hora_join, latitude, longitude FROM fires",
    )
)
def build_losses(spark, sf_dir):
    """What a build loses at every step, counted in the passes of the build; the grid leaves out half of the cells, and some documents are void."""
    weather_path, fires_path = _write_documents(spark, sf_dir, 500), fresh_dir(spark, "fires")
    void = table(spark, sf_dir, "events").filter("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("cell_id")).distinct()
    void.write.mode("append").json(weather_path)
    _write_detections(spark, table(spark, sf_dir, "events").filter("event_type = 'error'"), fires_path)
    tables, grid = _layers(spark, sf_dir)
    south = GridSpec(grid.south, -3150, grid.west, grid.east, grid.step)
    losses = Losses()
    _checked(build(spark, fires_path, weather_path, fresh_dir(spark, "state"), south, tables, layers=(), weather_multi_line=False, losses=losses))
    return losses.table(spark)
