"""Reports kept up to date append by append (A1, A3, T9s): the old contribution of a changed id goes, the new one comes.

What is kept is the narrow current state (one row an id), the number of live rows that link to each id, and
exact totals by period and by merchant. An append changes the ids it holds and those whose superseded
flag turns because a link came or went. Totals are decimals, so subtracting gives back what was added. A refresh reads
the appended rows and the kept tables; the ledger is never read again. Its tables are a version of their own, so a
refresh may be repeated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.functions import scalars
from cashweave.operators import reports, state
from cashweave.operators.reports import EXACT
from cashweave.tables import read_table

_KEY = "transaction_id"
STATE = (f"{_KEY} string, state_event_id long, removal_event_id long, account_id string, pending_transaction_id string, date string, "
         "name string, merchant_name string, amount double, pending int, removed int")
LINKS = f"{_KEY} string, linkers long"
MONTHS = f"period date, inflow {EXACT}, outflow {EXACT}, transaction_count long"
_SEEN = "struct<has_date:boolean,date:string,state_event_id:long>"
#: ``period`` is the first day of the month, or the date's own text where it is no date: both compare as dates' texts do.
MERCHANTS = f"period string, merchant string, direction string, amount {EXACT}, transaction_count long, seen {_SEEN}"
_TABLES = {"state": STATE, "links": LINKS, "months": MONTHS, "merchants": MERCHANTS}


class Kept(NamedTuple):
    """The tables a refresh starts from and ends with."""

    state: DataFrame
    links: DataFrame
    months: DataFrame
    merchants: DataFrame


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def empty(spark: SparkSession) -> Kept:
    return Kept(*[spark.createDataFrame([], schema) for schema in _TABLES.values()])


def read(spark: SparkSession, path: str, version: int) -> Kept:
    """The tables as refresh ``version`` left them; empty ones for version -1."""
    if version < 0:
        return empty(spark)
    return Kept(*[read_table(spark, f"{path.rstrip('/')}/version={version}/{name}", schema) for name, schema in _TABLES.items()])


def _stored(table: DataFrame, path: str, version: int, name: str, schema: str) -> DataFrame:
    place = f"{path.rstrip('/')}/version={version}/{name}"
    table.write.mode("overwrite").parquet(place)
    return table.sparkSession.read.schema(schema).parquet(place)


def _live_links(rows: DataFrame, sign: int) -> DataFrame:
    """What rows add to (or take from) the number of links to their targets."""
    return rows.filter(F.col("pending_transaction_id").isNotNull() & (F.col("removed") == 0)).select(
        F.col("pending_transaction_id").alias(_KEY), F.lit(sign).cast("long").alias("linkers"))


def _reported(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows that reports count (active and settled), with period, merchant and direction."""
    linked = rows.join(links.filter("linkers > 0").select(_KEY), _KEY, "left_anti")
    active = reports.report_rows(linked)
    amount = F.coalesce(F.col("amount"), F.lit(0))
    day = scalars.parse_date(F.col("date"))
    return active.select(
        _KEY, "state_event_id", "date", amount.cast(EXACT).alias("amount"), F.trunc(day, "month").alias("month"),
        F.coalesce(F.date_format(F.trunc(day, "month"), "yyyy-MM-dd"), F.col("date")).alias("period"),
        scalars.merchant_label(F.col("merchant_name"), F.col("name")).alias("merchant"), scalars.direction(amount).alias("direction"))


def _signed(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


def refresh(spark: SparkSession, path: str, version: int, batch: DataFrame) -> Kept:
    """Tables ``version`` below ``path``: those of the version before it and ``batch``, ledger rows newer than all earlier ones.

    The changed rows, old and new, are stored first; all else is made from them. Repeating a version replaces it.
    """
    kept, columns = read(spark, path, version - 1), _names(STATE)
    sign = F.col("sign")

    fresh = state.latest_state(state_rows(batch), columns=tuple(columns))
    old = kept.state.join(fresh.select(_KEY), _KEY, "left_semi")
    new = state.refresh_latest_state(old, state_rows(batch), columns=tuple(columns)).select(*columns)
    changed = _stored(_signed(old, new), path, version, "changed", STATE + ", sign int")
    gone, come = changed.filter(sign < 0).drop("sign"), changed.filter(sign > 0).drop("sign")
    now = _stored(kept.state.join(come.select(_KEY), _KEY, "left_anti").unionByName(come), path, version, "state", STATE)

    turns = _live_links(gone, -1).unionByName(_live_links(come, 1)).groupBy(_KEY).agg(F.sum("linkers").alias("d")).filter("d <> 0")
    before, after = F.coalesce("linkers", F.lit(0)).alias("was"), (F.coalesce("linkers", F.lit(0)) + F.col("d")).alias("linkers")
    moved = _stored(turns.join(kept.links, _KEY, "left").select(_KEY, before, after), path, version, "moved", LINKS + ", was long")
    links = _stored(kept.links.join(moved, _KEY, "left_anti").unionByName(moved.select(_KEY, "linkers").filter("linkers > 0")),
                    path, version, "links", LINKS)

    # Rows that stay as they are while their flag turns leave with the old links and come back with the new ones.
    turned = moved.filter("(was > 0) <> (linkers > 0)").select(_KEY)
    untouched = kept.state.join(turned.join(come.select(_KEY), _KEY, "left_anti"), _KEY, "left_semi")
    both = _signed(_reported(gone.unionByName(untouched), kept.links), _reported(come.unionByName(untouched), links))
    both = _stored(both, path, version, "reported", f"{_KEY} string, state_event_id long, date string, amount {EXACT}, month date, "
                   "period string, merchant string, direction string, sign int")

    nothing = F.lit(0).cast(EXACT)
    change = both.filter("month IS NOT NULL").select(
        F.col("month").alias("period"), (sign * F.when(F.col("amount") < 0, -F.col("amount")).otherwise(nothing)).cast(EXACT).alias("inflow"),
        (sign * F.when(F.col("amount") > 0, F.col("amount")).otherwise(nothing)).cast(EXACT).alias("outflow"), sign.cast("long").alias("transaction_count"))
    months = kept.months.unionByName(change).groupBy("period").agg(*[F.sum(c).cast(t).alias(c) for c, t in (
        ("inflow", EXACT), ("outflow", EXACT), ("transaction_count", "long"))]).filter("transaction_count > 0")

    keys = ["period", "merchant", "direction"]
    change = both.filter("direction <> 'neutral'").select(
        *keys, (sign * F.abs("amount")).cast(EXACT).alias("amount"), sign.cast("long").alias("transaction_count"))
    sums = kept.merchants.select(*change.columns).unionByName(change).groupBy(*keys).agg(
        F.sum("amount").cast(EXACT).alias("amount"), F.sum("transaction_count").alias("transaction_count")).filter("transaction_count > 0")
    # The newest row of a key cannot be subtracted: it is looked up again, for the keys that changed alone.
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = change.select(*keys).distinct().toDF(*[f"_{c}" for c in keys])
    seen = _reported(now, links).join(marked, same, "left_semi").groupBy(*keys).agg(F.max(F.struct(
        F.col("date").isNotNull().alias("has_date"), "date", "state_event_id")).alias("seen"))
    ends = kept.merchants.join(marked, same, "left_anti").select(*keys, "seen").unionByName(seen).toDF(*[f"_{c}" for c in keys], "seen")
    return Kept(now, links, _stored(months, path, version, "months", MONTHS),
                _stored(sums.join(ends, same).select(*_names(MERCHANTS)), path, version, "merchants", MERCHANTS))


def state_rows(ledger: DataFrame) -> DataFrame:
    """The ledger columns that the kept state is made of."""
    wanted = set(_names(STATE)) | {"_pending_raw"}
    return ledger.select(_KEY, "arrival_seq", "event_class", *[src for src, dst in state.STATE_COLUMNS if dst in wanted])


def monthly_cashflow(kept: Kept, months_back: int | None = None, today=None, scale: int = 2) -> DataFrame:
    """A1 from the kept totals; equals ``reports.monthly_cashflow`` over the whole active state."""
    rows = kept.months
    if months_back is not None and months_back > 0:
        rows = rows.filter(F.col("period") >= scalars.month_floor_minus(reports._as_date(today), months_back - 1))
    totals = rows.select(F.col("period").alias("_m"), *[F.round(c, scale).cast(reports.money(scale)).alias(c) for c in ("inflow", "outflow")],
                         "transaction_count")
    return reports.fill_months(totals, months_back, today, (), scale)


def top_merchants(kept: Kept, direction: str = "outflow", limit: int = 10, months_back: int | None = None, today=None,
                  scale: int = 2) -> DataFrame:
    """A3 from the kept totals; equals ``reports.top_merchants`` over the whole active state."""
    rows = reports.months_back_filter(kept.merchants, months_back, today, "period")
    if direction in ("inflow", "outflow"):
        rows = rows.filter(F.col("direction") == direction)
    per = rows.groupBy("merchant").agg(reports._total(F.col("amount"), scale).alias("amount"),
                                       F.sum("transaction_count").alias("transaction_count"), F.max("seen").alias("_first_seen"))
    return reports.rank_merchants(per, limit)
