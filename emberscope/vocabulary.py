"""Names and labels that outputs must carry unchanged."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Table layers, column names, codes, labels, formats and limits
# that results have to equal.
# ---------------------------------------------------------------------------

LAYERS = ["00_landing", "01_bronze", "02_silver", "03_gold"]

TABLE_NAMES = {
    "landing_grid": "`00_landing`.aux_grid_master",
    "bronze_fires": "`01_bronze`.bronze_nasa_firms",
    "bronze_weather": "`01_bronze`.bronze_open_meteo",
    "silver_grid": "`02_silver`.silver_grid_master",
    "silver_fires": "`02_silver`.silver_nasa_firms",
    "silver_weather": "`02_silver`.silver_open_meteo",
    "gold_full": "`03_gold`.gold_dataset_full",
    "gold_features": "`03_gold`.gold_dataset_features",
}

CLIMATE_VARIABLES = [
    "temperature_2m",
    "relative_humidity_2m",
    "vapour_pressure_deficit",
    "precipitation",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "et0_fao_evapotranspiration",
    "soil_moisture_0_to_7cm",
    "soil_moisture_28_to_100cm",
    "weather_code",
    "snow_depth",
]

FIRE_KEY = ["acq_date", "acq_time", "latitude", "longitude"]
SILVER_WEATHER_KEYS = ["grid_id", "timestamp_clima", "fecha_join", "hora_join"]
SILVER_WEATHER_TAIL = ["elevation", "latitude", "longitude", "source_filename"]

CONFIDENCE_CODES = {"l": 1, "n": 2, "h": 3}
CONFIDENCE_LABELS = {3: "Alta (High)", 2: "Nominal", 1: "Baja (Low)"}
CONFIDENCE_OTHER = "Desconocido"

SEGMENT_HOT_WINDY = "Extremo (Calor+Viento)"
SEGMENT_HOT = "Ola de Calor"
SEGMENT_WINDY = "Viento Fuerte"
SEGMENT_DRY = "Sequía Extrema"
SEGMENT_OTHER = "Normal / Otro"
HOT_ABOVE = 30
WINDY_ABOVE = 20
DRY_BELOW = 30

NULLS_NONE = "OPTIMO"
NULLS_SOME = "ATENCION"
NULLS_MANY = "CRITICO (>5%)"
NULLS_MANY_ABOVE_PCT = 5

INVALID_MARKER = "Invalid"
FIRE_FILE_FORMAT = "'nasa_'yyyyMMdd'.csv'"
WEATHER_FILE_PREFIX = "weather_"
WEATHER_FILE_SUFFIX = ".json"
DAYS_PER_FIRE_FILE = 5
CELLS_PER_WEATHER_BATCH = 5

# Frame bounds in rows, current row included: 169 and 73 rows.
ROWS_7_DAYS = 168
ROWS_3_DAYS = 72

# Bounding boxes in degrees (south, north, west, east), upper bounds open.
BOX_160 = (-32.5, -30.5, -65.0, -64.2)
BOX_800 = (-33.5, -29.5, -65.5, -63.5)
STEP_DEGREES = 0.1

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

FIRE_SCHEMA = T.StructType(
    [
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
        T.StructField("acq_date", T.DateType()),
        T.StructField("acq_time", T.IntegerType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("frp", T.DoubleType()),
    ]
)

# Further columns of detection files, carried through when a file has them.
FIRE_SCHEMA_FULL = T.StructType(
    [
        *FIRE_SCHEMA.fields,
        T.StructField("bright_ti4", T.DoubleType()),
        T.StructField("scan", T.DoubleType()),
        T.StructField("track", T.DoubleType()),
        T.StructField("satellite", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("bright_ti5", T.DoubleType()),
        T.StructField("daynight", T.StringType()),
    ]
)

WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("request_latitude", T.DoubleType()),
        T.StructField("request_longitude", T.DoubleType()),
        T.StructField("elevation_val", T.DoubleType()),
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("date", T.ArrayType(T.StringType())),
                    T.StructField("time", T.ArrayType(T.StringType())),
                ]
                + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in CLIMATE_VARIABLES]
            ),
        ),
    ]
)
