"""Reports over the labelled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.operators import analysis as A
from emberscope.operators.evaluation import (
    best_threshold,
    class_ratio,
    confusion,
    pr_curve,
    temporal_split,
    threshold_sweep,
)
from emberscope.functions.indices import climate_segment

from .base import gold, orders_gold, plain, query, table, with_sql
from .joins import GOLD_SELECT


def _pct(part: str, whole: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE) AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def _mean(column: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST(sum({column}) AS DOUBLE) / CAST(count({column}) AS DOUBLE) AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


@query(
    with_sql(
        "gold",
        f"""
SELECT count(*) AS total_registros_hora_celda, CAST(sum(target) AS BIGINT) AS total_eventos_incendio,
       count(DISTINCT grid_id) AS total_puntos_monitoreados, min(timestamp_clima) AS fecha_inicio,
       max(timestamp_clima) AS fecha_fin, {_pct('sum(target)', 'count(*)', 4)} AS tasa_prevalencia_fuego
FROM gold""",
    )
)
def summary(spark, sf_dir):
    return plain(A.summary(gold(spark, sf_dir)))


_LABEL = """CASE fire_confidence WHEN 3 THEN 'Alta (High)' WHEN 2 THEN 'Nominal' WHEN 1 THEN 'Baja (Low)' ELSE 'Desconocido' END"""


def _share_sql(source: str) -> str:
    return with_sql(
        source,
        f"""
SELECT {_LABEL} AS nivel_confianza, count(*) AS cantidad_incendios, {_mean('fire_intensity', 2)} AS intensidad_promedio_frp,
       {_pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS porcentaje_del_total
FROM {source} WHERE target = 1 GROUP BY fire_confidence ORDER BY cantidad_incendios DESC""",
    )


@query(_share_sql("gold"))
def group_share(spark, sf_dir):
    return A.confidence_share(gold(spark, sf_dir))


@query(_share_sql("orders_gold"))
def group_share_orders(spark, sf_dir):
    return A.confidence_share(orders_gold(spark, sf_dir))


@query(
    with_sql(
        "orders_gold",
        f"""
SELECT mes, total_incendios, temp_promedio_mes, CAST(rank() OVER (ORDER BY total_incendios DESC) AS INTEGER) AS ranking_peligrosidad
FROM (SELECT CAST(month(timestamp_clima) AS INTEGER) AS mes, CAST(sum(target) AS BIGINT) AS total_incendios,
             {_mean('temperature_2m', 1)} AS temp_promedio_mes
      FROM orders_gold GROUP BY month(timestamp_clima)) AS m ORDER BY mes""",
    )
)
def month_rank(spark, sf_dir):
    return A.month_ranking(orders_gold(spark, sf_dir))


_SEGMENT = """CASE WHEN temperature_2m > 30 AND wind_speed_10m > 20 THEN 'Extremo (Calor+Viento)'
  WHEN temperature_2m > 30 THEN 'Ola de Calor' WHEN wind_speed_10m > 20 THEN 'Viento Fuerte'
  WHEN relative_humidity_2m < 30 THEN 'Sequía Extrema' ELSE 'Normal / Otro' END"""


def _segment_sql(source: str) -> str:
    return f"""
SELECT {_SEGMENT} AS segmento_climatico, count(*) AS cantidad_incendios,
       {_pct('count(*)', f'(SELECT count(*) FROM {source} WHERE target = 1)', 2)} AS porcentaje_incendios
FROM {source} WHERE target = 1 GROUP BY 1 ORDER BY cantidad_incendios DESC"""


@query(with_sql("gold", _segment_sql("gold")))
def segment_share(spark, sf_dir):
    return A.segment_share(gold(spark, sf_dir))


_LINES = """SELECT l_quantity AS temperature_2m, l_tax * 500 AS wind_speed_10m, l_discount * 1000 AS relative_humidity_2m,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target FROM lineitem"""


@query("WITH g AS (" + _LINES + ")" + _segment_sql("g"))
def segment_share_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("temperature_2m"),
        (F.col("l_tax") * 500).alias("wind_speed_10m"),
        (F.col("l_discount") * 1000).alias("relative_humidity_2m"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target"),
    )
    return A.segment_share(lines)


@query(
    with_sql(
        "orders_gold",
        """
SELECT grid_id, timestamp_clima, CAST(fire_intensity AS DOUBLE) AS "FRP_Potencia", CAST(temperature_2m AS DOUBLE) AS "Temp_C",
       CAST(wind_speed_10m AS DOUBLE) AS "Viento_kmh", CAST(relative_humidity_2m AS DOUBLE) AS "Humedad_pct",
       CAST(ranking_intensidad AS INTEGER) AS ranking_intensidad
FROM (SELECT *, rank() OVER (ORDER BY fire_intensity DESC) AS ranking_intensidad FROM orders_gold WHERE target = 1) AS r
ORDER BY ranking_intensidad, grid_id, timestamp_clima LIMIT 10""",
    )
)
def top_rank_rows(spark, sf_dir):
    events = orders_gold(spark, sf_dir).filter("target = 1")
    top = A.strongest(events, "fire_intensity", ["grid_id", "timestamp_clima"])
    return plain(
        top.select(
            "grid_id",
            "timestamp_clima",
            F.col("fire_intensity").alias("FRP_Potencia"),
            F.col("temperature_2m").alias("Temp_C"),
            F.col("wind_speed_10m").alias("Viento_kmh"),
            F.col("relative_humidity_2m").alias("Humedad_pct"),
            "ranking_intensidad",
        )
    )


@query(
    with_sql(
        "gold",
        f"""
SELECT grid_id, latitude, longitude, CAST(sum(target) AS BIGINT) AS total_incendios,
       CAST(max(fire_intensity) AS DOUBLE) AS intensidad_maxima_registrada, {_mean('temperature_2m', 1)} AS temp_promedio_zona,
       {_pct('sum(target)', 'sum(sum(target)) OVER ()', 2)} AS porcentaje_del_total_global
FROM gold GROUP BY grid_id, latitude, longitude ORDER BY total_incendios DESC, grid_id, latitude, longitude LIMIT 15""",
    )
)
def hotspots_topk(spark, sf_dir):
    return plain(A.hotspots(gold(spark, sf_dir)))


@query(
    with_sql(
        "orders_gold",
        f"""
SELECT anio, incendios_este_anio, intensidad_avg, lag(incendios_este_anio) OVER (ORDER BY anio) AS incendios_anio_anterior,
       incendios_este_anio - lag(incendios_este_anio) OVER (ORDER BY anio) AS diferencia_neta
FROM (SELECT CAST(year(timestamp_clima) AS INTEGER) AS anio, CAST(sum(target) AS BIGINT) AS incendios_este_anio,
             {_mean('fire_intensity', 2)} AS intensidad_avg FROM orders_gold GROUP BY year(timestamp_clima)) AS y ORDER BY anio""",
    )
)
def year_lag(spark, sf_dir):
    return A.yearly_change(orders_gold(spark, sf_dir))


@query(
    with_sql(
        "gold",
        f"""SELECT {GOLD_SELECT} FROM gold
WHERE timestamp_clima = TIMESTAMP '2024-01-02 18:00:00' AND latitude = -31.2 AND longitude = -64.4
   OR timestamp_clima = TIMESTAMP '2024-01-01 00:00:00' AND latitude = -31.4 AND longitude = -65.0""",
    )
)
def point_lookup(spark, sf_dir):
    g = gold(spark, sf_dir)
    at = lambda when, lat, lon: A.lookup(g, "timestamp_clima", when, "latitude", lat, "longitude", lon)
    return plain(at("2024-01-02 18:00:00", -31.2, -64.4).unionByName(at("2024-01-01 00:00:00", -31.4, -65.0)))


@query(
    with_sql(
        "orders_gold",
        """
SELECT count(*) FILTER (WHERE target = 0) AS negatives, count(*) FILTER (WHERE target = 1) AS positives,
       CAST(count(*) FILTER (WHERE target = 0) AS DOUBLE) / nullif(CAST(count(*) FILTER (WHERE target = 1) AS DOUBLE), 0) AS ratio
FROM orders_gold""",
    ),
    name="class_ratio",
)
def class_balance(spark, sf_dir):
    return class_ratio(orders_gold(spark, sf_dir))


RANGES = [("train", "1995-01-01", "1999-01-01"), ("validation", "1998-07-01", "1999-01-01"), ("test", "1999-01-01", "2000-01-01")]


@query(
    with_sql(
        "orders_gold",
        """
SELECT o_orderkey, timestamp_clima, target, CASE
  WHEN timestamp_clima >= TIMESTAMP '1994-12-31 12:00:00' AND timestamp_clima < TIMESTAMP '1995-01-01' THEN NULL
  WHEN timestamp_clima >= TIMESTAMP '1998-06-30 12:00:00' AND timestamp_clima < TIMESTAMP '1998-07-01' THEN NULL
  WHEN timestamp_clima >= TIMESTAMP '1998-12-31 12:00:00' AND timestamp_clima < TIMESTAMP '1999-01-01' THEN NULL
  WHEN timestamp_clima >= TIMESTAMP '1999-12-31 12:00:00' AND timestamp_clima < TIMESTAMP '2000-01-01' THEN NULL
  WHEN timestamp_clima >= TIMESTAMP '1999-01-01' AND timestamp_clima < TIMESTAMP '2000-01-01' THEN 'test'
  WHEN timestamp_clima >= TIMESTAMP '1998-07-01' AND timestamp_clima < TIMESTAMP '1999-01-01' THEN 'validation'
  WHEN timestamp_clima >= TIMESTAMP '1995-01-01' AND timestamp_clima < TIMESTAMP '1999-01-01' THEN 'train' END AS split
FROM (SELECT * REPLACE (timestamp_clima + INTERVAL (o_orderkey % 24) HOUR AS timestamp_clima) FROM orders_gold) AS o""",
    ),
    name="temporal_split",
)
def split_by_time(spark, sf_dir):
    hours = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    o = orders_gold(spark, sf_dir).withColumn("timestamp_clima", F.col("timestamp_clima") + hours)
    return plain(temporal_split(o, "timestamp_clima", RANGES).select("o_orderkey", "timestamp_clima", "target", "split"))


def _scored_documents(spark, sf_dir):
    """Labelled documents with a score that only depends on their length."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.col("n_chars").cast("double") / (F.col("n_chars").cast("double") + F.lit(1000.0))
    return d.select("doc_id", score.alias("score")).join(labels.select("doc_id", "quality"), "doc_id")


_SWEEP = """
  SELECT CAST(bin AS DOUBLE) / 100 AS threshold, tp, fp, positives, negatives, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
         CAST(tp AS DOUBLE) / CAST(nullif(positives, 0) AS DOUBLE) AS recall
  FROM (SELECT bin, CAST(sum(pos) OVER (ORDER BY bin DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY bin DESC) AS BIGINT) AS fp,
               CAST(sum(pos) OVER () AS BIGINT) AS positives, CAST(sum(neg) OVER () AS BIGINT) AS negatives
        FROM (SELECT CAST(least(floor(score * 100), 99) AS INTEGER) AS bin, count(*) FILTER (WHERE quality = 1) AS pos,
                     count(*) FILTER (WHERE quality = 0) AS neg
              FROM (SELECT CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + CAST(1000.0 AS DOUBLE)) AS score, quality
                    FROM documents JOIN labels USING (doc_id)) AS s GROUP BY 1) AS b) AS c"""
_F2 = "CASE WHEN precision = 0 AND recall = 0 THEN 0.0::DOUBLE ELSE CAST(5.0 AS DOUBLE) * precision * recall / (CAST(4.0 AS DOUBLE) * precision + recall) END"


@query(f"WITH s AS ({_SWEEP}) SELECT *, {_F2} AS f2 FROM s", name="threshold_sweep")
def sweep(spark, sf_dir):
    return threshold_sweep(_scored_documents(spark, sf_dir), "score", "quality")


@query(f"WITH s AS ({_SWEEP}) SELECT *, {_F2} AS f2 FROM s ORDER BY f2 DESC, threshold DESC LIMIT 1", name="best_threshold")
def best(spark, sf_dir):
    return best_threshold(sweep(spark, sf_dir))


@query(
    f"""WITH s AS ({_SWEEP}) SELECT threshold, recall, precision, recall AS tpr,
CAST(fp AS DOUBLE) / CAST(nullif(negatives, 0) AS DOUBLE) AS fpr FROM s""",
    name="pr_curve",
)
def curve(spark, sf_dir):
    return pr_curve(sweep(spark, sf_dir))


@query(
    with_sql(
        "orders_gold",
        f"""
SELECT *, CAST(tp AS DOUBLE) / CAST(nullif(tp + fn, 0) AS DOUBLE) AS recall FROM (
  SELECT CAST(month(timestamp_clima) AS INTEGER) AS mes, {_SEGMENT} AS segmento_climatico,
         count(*) FILTER (WHERE predicted = 1 AND target = 1) AS tp, count(*) FILTER (WHERE predicted = 1 AND target = 0) AS fp,
         count(*) FILTER (WHERE predicted = 0 AND target = 1) AS fn, count(*) FILTER (WHERE predicted = 0 AND target = 0) AS tn
  FROM (SELECT *, CASE WHEN fire_intensity > 250000 THEN 1 ELSE 0 END AS predicted FROM orders_gold) AS p GROUP BY 1, 2) AS c""",
    )
)
def error_by_month(spark, sf_dir):
    o = orders_gold(spark, sf_dir).withColumn("predicted", F.when(F.col("fire_intensity") > 250000, 1).otherwise(0))
    segment = climate_segment(F.col("temperature_2m"), F.col("wind_speed_10m"), F.col("relative_humidity_2m"))
    by = [F.month("timestamp_clima").alias("mes"), segment.alias("segmento_climatico")]
    return confusion(o, by, "predicted", "target")
