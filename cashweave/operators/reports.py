"""Cash-flow reports over current state.

Amounts are summed as ``DECIMAL(38,10)`` so totals are exact and independent of row order, and
rounded once, to the report's scale, when the sum is complete.
Every report is one partial+final hash aggregation on a small key (month or label);
the month spine is a ``sequence`` of at most a few hundred months per group.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cashweave.functions import scalars

# Type of a single amount and of its sums: 28 digits before the point, 10 after it.
EXACT = "decimal(38,10)"


def money(scale: int = 2) -> str:
    """Type of a reported total."""
    return f"decimal(38,{scale})"


def _total(c, scale: int):
    return F.round(F.coalesce(F.sum(c).cast(EXACT), F.lit(0).cast(EXACT)), scale).cast(money(scale))


def _as_date(today) -> _dt.date:
    if isinstance(today, _dt.date):
        return today
    return _dt.date.fromisoformat(str(today)[:10])


def months_back_filter(df: DataFrame, months_back: int | None, today, date_col: str = "date") -> DataFrame:
    """``date >= first of month (n-1) months before today``; no upper bound; only for n > 0.

    Compares the stored ISO text, as the reference's SQL does; NULL dates fall out.
    """
    if months_back is None or months_back <= 0:
        return df
    start = scalars.month_floor_minus(_as_date(today), months_back - 1)
    return df.filter(F.col(date_col) >= F.date_format(start, "yyyy-MM-dd"))


def report_rows(df: DataFrame) -> DataFrame:
    """Only settled rows (pending = 0, removed = 0)."""
    return df.filter((F.coalesce(F.col("pending"), F.lit(0)) == 0) & (F.coalesce(F.col("removed"), F.lit(0)) == 0))


def monthly_cashflow(active: DataFrame, months_back: int | None = None, today=None,
                     by: tuple[str, ...] = (), scale: int = 2) -> DataFrame:
    """A1: inflow, outflow, net and row count per month, with every month of the range present.

    Totals are exact sums rounded half up to ``scale`` places.

    With ``months_back`` the range is the n months ending at ``today``'s month (later-dated rows
    are not shown); without it, the first to the last month seen (per ``by`` group when given).
    """
    rows = report_rows(active)
    if months_back is not None and months_back > 0:
        rows = months_back_filter(rows, months_back, today)
    rows = rows.withColumn("_d", scalars.parse_date(F.col("date"))).filter(F.col("_d").isNotNull())
    if months_back is not None and months_back > 0:
        first = scalars.month_floor_minus(_as_date(today), months_back - 1)
        rows = rows.filter(F.col("_d") >= first)
    amount, nothing = F.coalesce(F.col("amount"), F.lit(0)).cast(EXACT), F.lit(0).cast(EXACT)
    keys = [F.col(c) for c in by]
    totals = rows.groupBy(*keys, F.trunc("_d", "month").alias("_m")).agg(
        _total(F.when(amount < 0, -amount).otherwise(nothing), scale).alias("inflow"),
        _total(F.when(amount > 0, amount).otherwise(nothing), scale).alias("outflow"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    return fill_months(totals, months_back, today, by, scale)


def fill_months(totals: DataFrame, months_back: int | None = None, today=None, by: tuple[str, ...] = (),
                scale: int = 2) -> DataFrame:
    """Every month of the range, from ``totals`` (``_m``, inflow, outflow, transaction_count) of the months that have rows."""
    keys = [F.col(c) for c in by]
    if months_back is not None and months_back > 0:
        end = F.trunc(F.lit(_as_date(today)), "month")
        start = scalars.month_floor_minus(_as_date(today), months_back - 1)
        if by:
            bounds = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys)
            spine = bounds.select(*keys, F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("_m"))
        else:
            spine = totals.sparkSession.range(1).select(
                F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("_m"))
    else:
        bounds = totals.groupBy(*keys).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
        spine = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("_m"))
    filled = spine.join(totals, [*by, "_m"], "left")
    zero = F.lit(0).cast(money(scale))
    inflow = F.coalesce(F.col("inflow"), zero)
    outflow = F.coalesce(F.col("outflow"), zero)
    return filled.select(
        *keys,
        scalars.month_key(F.col("_m")).alias("month"),
        inflow.alias("inflow"),
        outflow.alias("outflow"),
        (inflow - outflow).cast(money(scale)).alias("net"),
        F.coalesce(F.col("transaction_count"), F.lit(0)).cast("long").alias("transaction_count"),
    )


def summarize_months(months: DataFrame, scale: int = 2) -> DataFrame:
    """A2: totals of the (rounded) months, net, and averages over the month count (at least 1)."""
    agg = months.agg(
        F.coalesce(F.sum("inflow"), F.lit(0)).cast(money(scale)).alias("total_inflow"),
        F.coalesce(F.sum("outflow"), F.lit(0)).cast(money(scale)).alias("total_outflow"),
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_n"),
    )
    net = (F.col("total_inflow") - F.col("total_outflow")).cast(money(scale))

    def avg(c):
        return F.round(c.cast("decimal(38,8)") / F.col("_n"), scale).cast(money(scale))

    return agg.select(
        "total_inflow", "total_outflow", net.alias("net"),
        avg(F.col("total_inflow")).alias("average_monthly_inflow"),
        avg(F.col("total_outflow")).alias("average_monthly_outflow"),
        avg(net).alias("average_monthly_net"),
    )


def top_merchants(active: DataFrame, direction: str = "outflow", limit: int = 10,
                  months_back: int | None = None, today=None, scale: int = 2) -> DataFrame:
    """A3/O3: total |amount| and count per merchant label, largest first, top ``limit``.

    Equal totals keep the order in which labels first appear in the newest-first listing
    (date desc with NULL dates last, then event desc), as the reference's stable sort does.
    Currencies are not separated (as in the reference).
    """
    rows = report_rows(months_back_filter(active, months_back, today))
    amount = F.coalesce(F.col("amount"), F.lit(0))
    d = scalars.direction(amount)
    rows = rows.filter(d != "neutral")
    if direction in ("inflow", "outflow"):
        rows = rows.filter(d == direction)
    label = scalars.merchant_label(F.col("merchant_name"), F.col("name"))
    per = rows.groupBy(label.alias("merchant")).agg(
        _total(F.abs(amount.cast(EXACT)), scale).alias("amount"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.max(F.struct(F.col("date").isNotNull().alias("has_date"), F.col("date"),
                       F.col("state_event_id"))).alias("_first_seen"),
    )
    return rank_merchants(per, limit)


def rank_merchants(per: DataFrame, limit: int = 10) -> DataFrame:
    """O3: the ``limit`` largest of ``per`` (merchant, amount, transaction_count, _first_seen), ranked."""
    w = Window.orderBy(F.col("amount").desc(), F.col("_first_seen").desc())
    # Global order over the per-label totals (one row per label); a top-k keeps it to `limit` rows.
    top = per.orderBy(F.col("amount").desc(), F.col("_first_seen").desc()).limit(max(limit, 0))
    return top.withColumn("rank", F.row_number().over(w).cast("int")).drop("_first_seen")


def with_bar_widths(report: DataFrame, value_col: str, out_col: str = "bar_pct", zero_floor: float = 2.0,
                    floor: float = 8.0) -> DataFrame:
    """Bar widths relative to the report's largest absolute value (report-sized input)."""
    mx = report.agg(F.max(F.abs(F.col(value_col)))).scalar()
    return report.withColumn(out_col, scalars.share_of_max(F.col(value_col), mx, zero_floor, floor))
