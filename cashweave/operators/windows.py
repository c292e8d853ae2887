"""Skew-safe per-key window helpers.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. These helpers split
each key by ranges of a unique, increasing order column (``order div width``), rank rows
inside each range, and add the row count of the key's earlier ranges from a small
one-row-per-range summary. No range holds more than ``width`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1 << 22


def seq_range(col_name: str, width: int) -> Column:
    """``col div width`` as exact integer division (no double rounding for large packed values)."""
    return F.expr(f"`{col_name}` div {int(width)}").cast("long")


def salted_row_number(df: DataFrame, key: str, order_col: str, out_col: str = "row_number",
                      width: int = DEFAULT_WIDTH) -> DataFrame:
    """``row_number() over (partition by key order by order_col)`` without a hot-key task."""
    b = seq_range(order_col, width)
    rows = df.withColumn("_rb", b)
    local = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_rb").orderBy(order_col)))
    counts = rows.groupBy(key, "_rb").agg(F.count(F.lit(1)).alias("_n"))
    prefix = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_rb")
                                                .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(prefix.select(key, "_rb", "_before"), [key, "_rb"], "inner")
    return out.withColumn(out_col, (F.col("_before") + F.col("_rn")).cast("int")).drop("_rb", "_rn", "_before")


def salted_lag(df: DataFrame, key: str, order_col: str, value_col: str, out_col: str,
               width: int = DEFAULT_WIDTH) -> DataFrame:
    """``lag(value_col) over (partition by key order by order_col)`` without a hot-key task."""
    b = seq_range(order_col, width)
    rows = df.withColumn("_rb", b)
    local = rows.withColumn("_lag", F.lag(value_col).over(Window.partitionBy(key, "_rb").orderBy(order_col))) \
        .withColumn("_has_prev", F.lag(order_col).over(Window.partitionBy(key, "_rb").orderBy(order_col)).isNotNull())
    last = rows.groupBy(key, "_rb").agg(F.max_by(value_col, order_col).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_rb")))
    out = local.join(carry.select(key, "_rb", "_carry"), [key, "_rb"], "inner")
    return out.withColumn(out_col, F.when(F.col("_has_prev"), F.col("_lag")).otherwise(F.col("_carry"))) \
        .drop("_rb", "_lag", "_has_prev", "_carry")
