"""Model features on the labelled table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from ..functions.indices import spread_index
from ..functions.timekeys import DAY, HOUR, cyclic
from ..operators.blocks import block_deltas, roll_up
from ..operators.grid import neighbour_mean
from ..operators.frames import (
    dry_hours,
    dry_marks,
    horizon_frames,
    horizon_value,
    lagged,
    over_rows,
    over_time,
    rows_back,
    trailing,
)
from ..session import Scratch

ROLLING = [
    rows_back("precip_acum_7d", "precipitation", "sum", V.ROWS_7_DAYS),
    rows_back("precip_acum_3d", "precipitation", "sum", V.ROWS_3_DAYS),
    rows_back("temp_max_3d", "temperature_2m", "max", V.ROWS_3_DAYS),
]


def stateless_features(df: DataFrame, ts: str = "timestamp_clima") -> DataFrame:
    """Interaction index and cyclic hour and month; also usable on a stream."""
    hour_sin, hour_cos = cyclic(F.hour(ts), 24)
    month_sin, month_cos = cyclic(F.month(ts), 12)
    index = spread_index(F.col("wind_speed_10m"), F.col("temperature_2m"), F.col("relative_humidity_2m"))
    return df.withColumns(
        {
            "fire_spread_index": index,
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
        }
    )


def gold_features(gold: DataFrame, gap_free: bool = False) -> DataFrame:
    """Labelled rows with rolling, interaction and seasonal features, without rows that lack any value.

    Short frames at the start of a series are not null, so its first week stays.
    On a series known to miss no hour (``missing_hours`` is empty), rows and
    hours are the same thing and ``gap_free`` saves the numbering of the rows,
    hence one of two shuffles.
    """
    keys, ts = ["grid_id"], "timestamp_clima"
    # these rows would be dropped at the end; in the windows they would form one group
    gold = gold.filter("grid_id IS NOT NULL")
    if gap_free:
        in_hours = [replace(f, start=f.start * HOUR, end=f.end * HOUR) for f in ROLLING]
        rolled = over_time(gold, keys, ts, in_hours)
    else:
        rolled = over_rows(gold, keys, ts, ROLLING)
    return stateless_features(rolled).na.drop()


LAGGED, LAGS, SPANS = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"], (6, 12, 24, 48), (24, 48, 96)


def memory_features(hourly: DataFrame, key: str = "grid_id", ts: str = "timestamp_clima") -> DataFrame:
    """Lags of 6-48 h, rolling means and sums of 24 h - 4 d, dry hours and the 12 h label.

    Everything is taken in one pass: one shuffle and one sort of the rows on
    (cell, chunk of time), next to a small summary per chunk for the dry hours.
    """
    frames = [lagged(f"{c}_lag_{h}h", c, h * HOUR) for c in LAGGED for h in LAGS]
    for hours in SPANS:
        frames.append(trailing(f"precipitation_sum_{hours}h", "precipitation", "sum", hours * HOUR))
        frames.append(trailing(f"temperature_2m_mean_{hours}h", "temperature_2m", "mean", hours * HOUR))
    frames += horizon_frames("target", 12, "target_ahead")
    framed = over_time(hourly, [key], ts, frames, running=dry_marks(ts, "precipitation"))
    return framed.withColumns({"dry_hours": dry_hours(ts), "target_ahead": horizon_value("target_ahead")}).drop(
        "__break", "__start", "__at_target_ahead"
    )


BLOCK_HOURS = 6
BLOCK = {
    "means": ["temperature_2m", "relative_humidity_2m", "vapour_pressure_deficit", "wind_speed_10m"],
    "sums": ["precipitation", "et0_fao_evapotranspiration"],
    "maxima": ["wind_gusts_10m", "target"],
    "directions": ["wind_direction_10m"],
    "modes": ["weather_code"],
}
CHANGES = {
    "temperature_2m_delta": "temperature_2m",
    "vapour_pressure_deficit_delta": "vapour_pressure_deficit",
    "wind_speed_10m_delta": "wind_speed_10m",
}


def block_features(hourly: DataFrame, key: str = "grid_id", ts: str = "timestamp_clima") -> DataFrame:
    """Six-hour blocks with the change of temperature, vapour pressure deficit and wind."""
    return block_deltas(roll_up(hourly, [key], ts, **BLOCK), [key], "block_start", CHANGES)


def closed_blocks(hourly: DataFrame, scratch: Scratch, key: str = "grid_id", ts: str = "timestamp_clima") -> DataFrame:
    """``block_features`` and, as they stand at the block's last hour, ``memory_features``; ``__closed`` is that hour, or null where it is missing.

    For an hourly series, one row for each hour on the hour or a fixed time past it. Lags, spans and horizon are multiples of the block, so at a block's
    last hour they are made of whole blocks: the hours are read once, and the windows run over a sixth of the rows. The tables it stands on are in ``scratch``.
    """
    last = F.hour(ts) % BLOCK_HOURS == BLOCK_HOURS - 1
    marks = dry_marks(ts, "precipitation")
    (_, broken), (_, first) = marks["__break"], marks["__start"]
    degrees = F.col("temperature_2m")
    derived = {f"__last_{c}": F.when(last, F.col(c)) for c in LAGGED}
    derived |= {"__closed": F.when(last, F.col(ts)), "__broken": broken, "__before_first": -first}
    maxima = [*BLOCK["maxima"], *derived]
    derived |= {"__degrees": degrees, "__measured": degrees.isNotNull().cast("long")}
    rolled = BLOCK | {"sums": [*BLOCK["sums"], "__degrees", "__measured"], "maxima": maxima}
    blocks = scratch.put(roll_up(hourly, [key], ts, hours=BLOCK_HOURS, derived=derived, **rolled), "blocks")
    summed = {"__rain": "precipitation", "__warmth": "__degrees"}
    whole = {name: _unscaled(blocks, c) for name, c in summed.items()}
    frames = [lagged(f"__was_{name}", column, BLOCK_HOURS * HOUR) for name, column in CHANGES.items()]
    frames += [lagged(f"{c}_lag_{h}h", f"__last_{c}", h * HOUR) for c in LAGGED for h in LAGS]
    frames += [trailing(f"{c}_{h}h", c, "sum", h * HOUR) for c in ("__rain", "__warmth", "__measured") for h in SPANS]
    horizon, observed = horizon_frames("target", 12, "target_ahead")
    frames += [horizon, replace(observed, column="__closed")]
    running = {"__break": ("max", F.col("__broken")), "__start": ("min", -F.col("__before_first"))}
    framed = over_time(blocks.withColumns({n: c for n, (c, _) in whole.items()}), [key], "block_start", frames, BLOCK_HOURS * 28 * DAY, running)
    # a table between the windows and what is made of them: as one step its generated code was too long for the JVM to compile
    framed = scratch.put(framed, "closed")
    made = {name: F.col(column) - F.col(f"__was_{name}") for name, column in CHANGES.items()}
    for h in SPANS:
        rain, warmth = (scaled(F.col(f"{name}_{h}h")) for name, (_, scaled) in whole.items())
        n = F.col(f"__measured_{h}h")
        made |= {f"precipitation_sum_{h}h": rain, f"temperature_2m_mean_{h}h": F.when(n > 0, warmth.cast("double") / n.cast("double"))}
    framed = framed.withColumns(made | {"dry_hours": dry_hours("__closed"), "target_ahead": horizon_value("target_ahead")})
    # in the order and the types of the hourly features
    memory = memory_features(hourly, key, ts)
    base = [c for c in blocks.columns if not c.startswith("__")]
    carried = [F.col(c).cast(memory.schema[c].dataType).alias(c) for c in memory.columns if c not in hourly.columns]
    return framed.select(*base, *CHANGES, *carried, "__closed")


def _unscaled(df: DataFrame, column: str) -> tuple[Column, Callable[[Column], Column]]:
    """Decimals of up to 18 digits as whole numbers of their smallest unit, whose sums stay plain longs, and the way back; other types as they are."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > 18:
        return F.col(column), lambda c: c
    unit = F.lit(Decimal(1).scaleb(-kind.scale))
    return (F.col(column) / unit).cast("long"), lambda c: c.cast("decimal(19,0)") * unit


def training_table(hourly: DataFrame, links: DataFrame, key: str = "grid_id", ts: str = "timestamp_clima", link_rows: int | None = None) -> DataFrame:
    """One row per cell and six-hour block of a gap-free hourly series, with everything a model is trained on.

    The block's base values and changes, the lags, rolling values, dry hours and 12 h label as they stand at its last hour,
    the means of the neighbouring cells in the same block, and the season. ``links`` holds (key, neighbour).
    Blocks without their last hour have no label and are left out. The hours are read once; the blocks are read several times and
    therefore stand in a table meanwhile; the result is a table, too.
    """
    scratch = Scratch(hourly.sparkSession)
    blocks = closed_blocks(hourly.filter(F.col(key).isNotNull()), scratch, key, ts)
    near = neighbour_mean(
        blocks,
        links,
        key,
        "block_start",
        means={"temperature_near": "temperature_2m", "humidity_near": "relative_humidity_2m"},
        sums={"fires_near": "target"},
        neighbour_rows=link_rows,
        keep_empty=True,
    )
    hour_sin, hour_cos = cyclic(F.hour("block_start"), 24)
    month_sin, month_cos = cyclic(F.month("block_start"), 12)
    # stated, as the planner takes the neighbours' rows, many as the blocks, for a part of what a broadcast takes of the driver
    joined = blocks.filter("__closed IS NOT NULL").drop("__closed").join(near.hint("merge"), [key, "block_start"], "left")
    joined = joined.withColumns({"hour_sin": hour_sin, "hour_cos": hour_cos, "month_sin": month_sin, "month_cos": month_cos})
    out = scratch.put(joined, "training")
    scratch.clear(out)
    return out
