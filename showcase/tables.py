"""Table life cycle, layout and export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberscope.session import fresh_dir
from emberscope.sources.tables import (
    append_merging,
    create_layers,
    export_by_year,
    layout_morton,
    layout_sorted,
    read_table,
    replace_table,
)

from .base import query, table


def new_schema(spark, purpose: str) -> str:
    """A schema of its own in the shared folder, for queries that go through named tables."""
    name = f"{purpose}_{uuid.uuid4().hex}"
    create_layers(spark, fresh_dir(spark, purpose), [name])
    return name


@query(
    """
SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE) * 2 AS doubled, NULL::VARCHAR AS note FROM customer WHERE c_acctbal >= 0
UNION ALL
SELECT c_custkey, c_name, c_nationkey, NULL, 'late' FROM customer WHERE c_acctbal < 0"""
)
def table_lifecycle(spark, sf_dir):
    """Create, replace by a query over itself with another schema, then append rows with a new column."""
    name = f"{new_schema(spark, 'lifecycle')}.customer"
    customer = table(spark, sf_dir, "customer")
    replace_table(customer, name)
    kept = read_table(spark, name).filter("c_acctbal >= 0")
    replace_table(kept.select("c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") * 2).alias("doubled")), name)
    late = customer.filter("c_acctbal < 0").select("c_custkey", "c_name", "c_nationkey", F.lit("late").alias("note"))
    append_merging(late, name)
    return read_table(spark, name)


@query("SELECT * FROM lineitem",
    name="layout_morton",
)
def layout_zorder(spark, sf_dir):
    """Line items stored along a Z-order curve of part and supplier, then read back."""
    path = fresh_dir(spark, "zorder")
    lines = table(spark, sf_dir, "lineitem")
    layout_morton(lines, F.col("l_partkey"), F.col("l_suppkey"), 8).write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


@query("SELECT * FROM events")
def layout_by_key(spark, sf_dir):
    """Events stored by user and time, then read back."""
    path = fresh_dir(spark, "sorted")
    events = table(spark, sf_dir, "events")
    layout_sorted(events, ["user_id", "ts"], 8).write.parquet(path)
    return spark.read.schema(events.schema).parquet(path)


@query("SELECT *, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem")
def export_parquet(spark, sf_dir):
    """Line items exported by year of shipment and read back."""
    path = fresh_dir(spark, "export")
    export_by_year(table(spark, sf_dir, "lineitem"), "l_shipdate", path)
    return spark.read.parquet(path)
