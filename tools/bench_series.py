"""Label join and feature table over a full-size hourly series: 160 cells x 2191 days x 24 hours.

A measurement only: the rows are computed, not read from the test tables. With
--hot, one more cell as large as half of all others is added, so that it holds a
third of the rows.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberscope import vocabulary as V  # noqa: E402
from emberscope.operators.grid import GridSpec, grid_nodes  # noqa: E402
from emberscope.plans.features import gold_features, memory_features  # noqa: E402
from emberscope.plans.gold import gold_full  # noqa: E402
from emberscope.session import build_session, materialize  # noqa: E402

HOURS = 2191 * 24


def series(spark, hot: bool):
    cells = grid_nodes(spark, GridSpec.of_degrees(V.BOX_160)).withColumn("hours", F.lit(HOURS))
    if hot:
        extra = spark.sql(f"SELECT 'hot' AS cell_id, -20.0D AS latitude, -50.0D AS longitude, {HOURS * 80} AS hours")
        cells = cells.unionByName(extra)
    days = cells.withColumn("day", F.explode(F.sequence(F.lit(0), (F.col("hours") / 24).cast("int") - 1))).repartition(64, "cell_id", "day")
    rows = days.withColumn("n", F.explode(F.sequence(F.col("day") * 24, F.col("day") * 24 + 23)))
    noise = F.pmod(F.xxhash64("cell_id", "n"), F.lit(1000)).cast("double") / 25
    ts = F.timestamp_seconds(F.lit(1577836800) - F.col("hours").cast("long") * 3600 + HOURS * 3600 + F.col("n").cast("long") * 3600)
    return rows.select(
        F.col("cell_id").alias("grid_id"),
        ts.alias("timestamp_clima"),
        F.to_date(ts).alias("fecha_join"),
        F.hour(ts).alias("hora_join"),
        *[(noise + i).alias(v) for i, v in enumerate(V.CLIMATE_VARIABLES)],
        F.lit(500.0).alias("elevation"),
        "latitude",
        "longitude",
    )


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--hot", action="store_true")
    args = parser.parse_args()
    spark = build_session("series", "local[8]", spark__sql__shuffle__partitions="32", spark__ui__enabled="false", spark__driver__memory="20g")
    spark.sparkContext.setLogLevel("OFF")
    weather = materialize(series(spark, args.hot), "series")
    hit = F.pmod(F.xxhash64("grid_id", "timestamp_clima"), F.lit(300)) == 0
    fires = materialize(
        weather.filter(hit).select("latitude", "longitude", "fecha_join", "hora_join", F.lit("n").alias("confidence"), F.col("temperature_2m").alias("frp")),
        "fires",
    )
    seconds = {}

    def timed(name, df):
        started = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 1)

    timed("label_join", gold_full(weather, fires))
    gold = materialize(gold_full(weather, fires), "gold")
    timed("coded_features", gold_features(gold))
    timed("coded_features_gap_free", gold_features(gold, gap_free=True))
    timed("memory_features", memory_features(gold))
    print(json.dumps({"rows": weather.count(), "fires": fires.count(), "hot": args.hot, "seconds": seconds}))


if __name__ == "__main__":
    main()
