"""Moving, lagged and running computations per key, split along the order axis.

A window partitioned by the key alone puts the whole history of a key into one
task. Here every history is cut into chunks of the order axis:

* bounded frames (rolling, lag, look-ahead) copy each row into the neighbouring
  chunks that can still see it;
* unbounded running values combine a per-chunk summary, a prefix over the few
  summaries of a key, and a running value inside the chunk.

Both kinds can be asked for together and then share one shuffle and one sort of
the rows on (key, chunk). Results equal those of the plain window over the key;
rows without a key form a group of their own, as they do there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timekeys import DAY, HOUR, epoch_seconds

POS, HOME, CHUNK = "__pos", "__home", "__chunk"
EXACT_TYPES = (T.DecimalType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
Running = Mapping[str, tuple[str, Column]]


@dataclass(frozen=True)
class Frame:
    """One output column: ``how`` of ``column`` over positions [pos+start, pos+end]."""

    name: str
    column: str
    how: str
    start: int
    end: int


def trailing(name: str, column: str, how: str, seconds: int) -> Frame:
    """Over (t - seconds, t]."""
    return Frame(name, column, how, -seconds + 1, 0)


def lagged(name: str, column: str, seconds: int) -> Frame:
    """The value exactly ``seconds`` earlier, else null."""
    return Frame(name, column, "max", -seconds, -seconds)


def ahead(name: str, column: str, how: str, seconds: int) -> Frame:
    """Over (t, t + seconds]."""
    return Frame(name, column, how, 1, seconds)


def rows_back(name: str, column: str, how: str, rows: int) -> Frame:
    """Over the ``rows`` preceding rows and the current one; for ``over_rows``."""
    return Frame(name, column, how, -rows, 0)


def _chunk_of(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width))


def _with_group(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Key columns on which null equals null in joins and windows alike.

    A nullable key becomes a filled value and a null flag: plain columns hash
    and sort faster than a struct.
    """
    names, added = [], {}
    for i, key in enumerate(keys):
        field = df.schema[key]
        if not field.nullable:
            names.append(key)
            continue
        filler = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(0)
        if isinstance(field.dataType, (T.StringType, T.NumericType)):
            added[f"__key{i}"] = F.coalesce(F.col(key), filler.cast(field.dataType))
            added[f"__null{i}"] = F.col(key).isNull()
            names += [f"__key{i}", f"__null{i}"]
        else:
            added[f"__key{i}"] = F.struct(key)
            names.append(f"__key{i}")
    return (df.withColumns(added) if added else df), names


def _over_positions(
    df: DataFrame, keys: Sequence[str], frames: Sequence[Frame], width: int, running: Running | None = None
) -> DataFrame:
    """Evaluate frames and running values; ``df`` carries the long column ``POS``.

    For frames, positions are unique per key.
    """
    running = running or {}
    columns = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    staged, group = _with_group(df.withColumn(HOME, _chunk_of(F.col(POS), width)), keys)
    if running:
        staged = staged.withColumns({f"__in_{name}": value for name, (_, value) in running.items()})

    before = max([0, *(-f.start for f in frames)])
    after = max([0, *(f.end for f in frames)])
    if before or after:
        first, last = _chunk_of(F.col(POS) - F.lit(after), width), _chunk_of(F.col(POS) + F.lit(before), width)
        copies = staged.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    else:
        copies = staged.withColumn(CHUNK, F.col(HOME))
    if running:
        # Hashing the few summaries spares the rows the sort a merge join asks for.
        copies = copies.join(_carried(staged, group, running).hint("shuffle_hash"), [*group, CHUNK], "left")

    order = Window.partitionBy(*group, CHUNK).orderBy(POS)
    upto = lambda end: order.rangeBetween(Window.unboundedPreceding, end)

    # Sums of exact types come from differences of running sums: linear in the
    # rows, where a sliding frame is re-added for every row.
    prefixed = [f for f in frames if f.how in ("sum", "mean", "count") and _uses_prefix(f, types)]
    prefix: dict[str, Column] = {}
    for column in {f.column for f in prefixed}:
        prefix[f"__n_{column}"] = F.count(column).over(upto(0))
        if any(f.how != "count" for f in prefixed if f.column == column):
            prefix[f"__s_{column}"] = F.sum(column).over(upto(0))
    if prefix:
        copies = copies.withColumns(prefix)

    outputs: dict[str, Column] = {}
    for f in frames:
        span = order.rangeBetween(f.start, f.end)
        if f in prefixed:
            outputs[f.name] = _from_prefix(f, upto)
        elif f.how == "mean":
            outputs[f.name] = F.avg(f.column).over(span)
        elif f.how in ("sum", "max", "min", "count"):
            outputs[f.name] = getattr(F, f.how)(f.column).over(span)
        else:
            raise ValueError(f"unknown frame function {f.how!r}")
    for name, (how, _) in running.items():
        # Copied rows of other chunks are part of what is carried in.
        own = F.when(F.col(HOME) == F.col(CHUNK), F.col(f"__in_{name}"))
        outputs[name] = _merge(how, getattr(F, how)(own).over(upto(0)), F.col(f"__from_{name}"))
    result = copies.withColumns(outputs)
    if before or after:
        result = result.filter(F.col(CHUNK) == F.col(HOME))
    kept = [c for c in columns if c not in outputs]
    return result.select(*kept, *outputs)


def _carried(staged: DataFrame, group: list[str], running: Running) -> DataFrame:
    """Running values of all earlier chunks, one row per key and chunk."""
    summary = staged.groupBy(*group, F.col(HOME).alias(CHUNK)).agg(
        *[getattr(F, how)(f"__in_{name}").alias(f"__sum_{name}") for name, (how, _) in running.items()]
    )
    earlier = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        *group,
        CHUNK,
        *[getattr(F, how)(f"__sum_{name}").over(earlier).alias(f"__from_{name}") for name, (how, _) in running.items()],
    )


def _merge(how: str, here: Column, before: Column) -> Column:
    if how == "sum":
        return F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0)))
    beaten = before > here if how == "max" else before < here
    return F.when(here.isNull() | beaten, before).otherwise(here)


def _uses_prefix(f: Frame, types: Mapping[str, T.DataType]) -> bool:
    return f.how == "count" or isinstance(types[f.column], EXACT_TYPES)


def _from_prefix(f: Frame, upto) -> Column:
    def difference(prefix: str) -> Column:
        high = F.last(prefix).over(upto(f.end))
        low = F.last(prefix).over(upto(f.start - 1))
        return F.coalesce(high, F.lit(0)) - F.coalesce(low, F.lit(0))

    n = difference(f"__n_{f.column}")
    if f.how == "count":
        return n
    total = difference(f"__s_{f.column}")
    if f.how == "sum":
        return F.when(n > 0, total)
    return F.when(n > 0, total.cast("double") / n.cast("double"))


def over_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    frames: Sequence[Frame],
    chunk_seconds: int | None = None,
    running: Running | None = None,
) -> DataFrame:
    """Frames in seconds around each row; at most one row per key and second.

    ``running`` adds running values (see ``running_values``) in the same pass.
    ``chunk_seconds`` bounds the rows of one task group. By default a chunk is
    eight times the widest frame, so about an eighth of the rows is copied.
    """
    reach = max([0, *(max(abs(f.start), abs(f.end)) for f in frames)])
    width = chunk_seconds or max(8 * reach, 28 * DAY)
    return _over_positions(df.withColumn(POS, epoch_seconds(F.col(ts))), keys, frames, width, running).drop(POS)


def row_index(
    df: DataFrame, keys: Sequence[str], ts: str, name: str = "row_index", chunk_seconds: int = 28 * DAY
) -> DataFrame:
    """Position of each row in its key by time, from 1, without gathering a key in one task."""
    columns = df.columns
    cut, group = _with_group(df.withColumn(CHUNK, _chunk_of(epoch_seconds(F.col(ts)), chunk_seconds)), keys)
    counts = cut.groupBy(*group, CHUNK).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, CHUNK, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*group, CHUNK).orderBy(ts)
    indexed = cut.join(offsets.hint("shuffle_hash"), [*group, CHUNK], "left")
    return indexed.select(*columns, (F.col("__offset") + F.row_number().over(within)).alias(name))


def over_rows(
    df: DataFrame, keys: Sequence[str], ts: str, frames: Sequence[Frame], chunk_rows: int | None = None
) -> DataFrame:
    """Frames counted in rows, exact on series with missing hours too."""
    reach = max(max(abs(f.start), abs(f.end)) for f in frames)
    width = chunk_rows or max(8 * reach, 1024)
    return _over_positions(row_index(df, keys, ts, POS), keys, frames, width).drop(POS)


def running_values(
    df: DataFrame, keys: Sequence[str], ts: str, running: Running, chunk_seconds: int = 28 * DAY
) -> DataFrame:
    """Running ``max``, ``min`` or ``sum`` of expressions over all rows at or before each row's second."""
    return over_time(df, keys, ts, [], chunk_seconds, running)


def last_known(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str, chunk_seconds: int = 28 * DAY
) -> DataFrame:
    """Last non-null ``value`` at or before each row; of several at one second, the greatest."""
    stamped = F.when(F.col(value).isNotNull(), F.struct(epoch_seconds(F.col(ts)).alias("at"), F.col(value).alias("v")))
    held = running_values(df, keys, ts, {"__known": ("max", stamped)}, chunk_seconds)
    return held.withColumn(name, F.col("__known.v")).drop("__known")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    valid_from: str,
    value: str,
    chunk_seconds: int = 28 * DAY,
) -> DataFrame:
    """Add to each left row the latest non-null ``value`` of the right side valid at or before its time.

    Marks become intervals that end at the next mark, and intervals are repeated for every chunk of time they touch. The
    left rows then meet them by (keys, chunk), an ordinary join whose skewed keys Spark can split. Of several marks at one
    second, the greatest value counts. A row with a null key or time has no value.
    """
    keys = list(keys)
    own = [f"__key_{i}" for i in range(len(keys))]
    probes = left.drop(value) if value in left.columns else left
    probes = probes.withColumn("__at", epoch_seconds(F.col(ts))).withColumn("__chunk", F.floor(F.col("__at") / F.lit(chunk_seconds)))
    end = left.agg(F.max(epoch_seconds(F.col(ts)))).first()[0]
    marks = right.filter(F.col(value).isNotNull() & F.col(valid_from).isNotNull())
    marks = marks.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], epoch_seconds(F.col(valid_from)).alias("__from")).agg(F.max(value).alias(value))
    marks = marks.filter(F.col("__from") <= F.lit(end))
    following = F.lead("__from").over(Window.partitionBy(*own).orderBy("__from"))
    held = marks.withColumn("__until", F.coalesce(following, F.lit(end) + F.lit(1)))
    first, last = F.floor(F.col("__from") / F.lit(chunk_seconds)), F.floor((F.col("__until") - F.lit(1)) / F.lit(chunk_seconds))
    held = held.withColumn("__part", F.explode(F.sequence(first, last)))
    match = (F.col("__chunk") == F.col("__part")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__until"))
    for k, o in zip(keys, own):
        match = match & (probes[k] == held[o])
    return probes.join(held, match, "left").select(*[c for c in left.columns if c != value], value)


def dry_marks(ts: str, precipitation: str) -> Running:
    """Running values from which ``dry_hours`` follows: the last break and the first hour."""
    at = epoch_seconds(F.col(ts))
    broken = F.col(precipitation).isNull() | (F.col(precipitation) > 0)
    return {"__break": ("max", F.when(broken, at)), "__start": ("min", at)}


def dry_hours(ts: str) -> Column:
    """Hours since the last wet or unknown hour, or since the hour before the first one."""
    since = epoch_seconds(F.col(ts)) - F.coalesce(F.col("__break"), F.col("__start") - F.lit(HOUR))
    return (since / F.lit(HOUR)).cast("long")


def dry_run(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    precipitation: str,
    name: str = "dry_hours",
    chunk_seconds: int = 28 * DAY,
) -> DataFrame:
    """Consecutive hours without rain up to each hour of a gap-free hourly series.

    A wet or unknown hour ends the run and counts 0 itself.
    """
    marked = running_values(df, keys, ts, dry_marks(ts, precipitation), chunk_seconds)
    return marked.withColumn(name, dry_hours(ts)).drop("__break", "__start")


def horizon_frames(target: str, hours: int, name: str) -> list[Frame]:
    """Frames from which ``horizon_value`` takes the label; they need the position column."""
    span = hours * HOUR
    return [ahead(name, target, "max", span), Frame(f"__at_{name}", POS, "max", span, span)]


def horizon_value(name: str) -> Column:
    """The label, or null where nothing is observed at the far end of the horizon."""
    return F.when(F.col(f"__at_{name}").isNotNull(), F.col(name))


def horizon_label(
    df: DataFrame, keys: Sequence[str], ts: str, target: str, hours: int = 12, name: str = "target_ahead"
) -> DataFrame:
    """Whether ``target`` occurs in the next ``hours`` hours of a gap-free hourly series.

    Null where the horizon reaches past the last hour of the key.
    """
    framed = over_time(df, keys, ts, horizon_frames(target, hours, name))
    return framed.withColumn(name, horizon_value(name)).drop(f"__at_{name}")
