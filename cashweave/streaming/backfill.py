"""Backfill as a job: history of the items that have none yet, with status rows (T7s, M5, S6).

Runs before a sync, once per item; it never touches a cursor. A failed run is logged and returns, so the
sync goes on, and the items stay due. With ``window_days`` the range is imported in date windows, each with its
own rows beside the status log, so the next run goes on behind the last window that was completed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.functions import privacy
from cashweave.operators import dimensions
from cashweave.operators import ledger as ledger_ops
from cashweave.sources.pages import read_history_range
from cashweave.tables import read_table

STATUS = ("item_id string, seq long, status string, start_date string, end_date string, inserted_event_count long, "
          "at string, error_class string, error_message string")
WINDOWS = ("item_id string, start_date string, end_date string, first_position long, state string, "
           "inserted_event_count long, at string")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    found = read_table(spark, path)
    return spark.createDataFrame([], STATUS) if found is None else found


def read_windows(spark: SparkSession, status_path: str) -> DataFrame:
    """Window rows: ``open`` before a window's append, with the position its rows start at, and ``done`` after it."""
    found = read_table(spark, f"{status_path}_windows")
    return spark.createDataFrame([], WINDOWS) if found is None else found


def date_windows(start: str, end: str, days: int | None) -> list[tuple[str, str]]:
    """The range as (first, last) days, oldest first; edges lie on a fixed grid, so that runs of other days agree."""
    low, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if days is None:
        return [(start, end)]
    out = []
    while low <= last:
        high = min(last, dt.date.fromordinal((low.toordinal() // days + 1) * days - 1))
        out.append((low.isoformat(), high.isoformat()))
        low = high + dt.timedelta(days=1)
    return out


def run_backfill(spark: SparkSession, items: DataFrame, history: DataFrame, ledger_path: str, status_path: str, now: str,
                 today, days: int = 730, window_days: int | None = None) -> None:
    """Append the ``history`` (change rows with their own ``arrival_seq`` order) of items without a complete backfill.

    Rows are shifted behind the stored positions, limited to the requested days, and kept by the ledger's own
    rules. Status rows: ``running`` at the start, then ``complete`` with range and count, or ``error``. With
    ``window_days`` (history then holds one row an id, as versions of an id in several windows would be ordered by
    date) a window whose append died is repeated at its own positions first, so nothing is imported twice, and windows done
    in earlier runs are not read again.
    """
    status = read_status(spark, status_path)
    due = dimensions.plan_backfills(items, dimensions.backfill_state(status), today, days)
    due = due.withColumn("seq", F.lit((status.agg(F.max("seq")).first()[0] or 0) + 1))
    _status(due, "running", now).write.mode("append").parquet(status_path)
    mine = read_status(spark, status_path).filter(
        (F.col("status") == "running") & (F.col("at") == now)).select("item_id", "seq", "start_date", "end_date")
    bounds = mine.agg(F.min("start_date"), F.max("end_date"), F.max("seq")).first()
    if bounds[2] is None:
        return  # nothing is due
    job = _Windows(spark, history, ledger_path, f"{status_path}_windows", now)
    try:
        job.repeat_open()
        for low, high in date_windows(bounds[0], bounds[1], window_days):
            job.run(mine.select("item_id"), low, high)
        counts = job.rows("done").groupBy("item_id").agg(F.sum("inserted_event_count").alias("n"))
        done = mine.join(counts, "item_id", "left").withColumn("inserted_event_count", F.coalesce("n", F.lit(0)))
        closing = _rows(done.withColumns({"seq": F.col("seq") + 1, "status": F.lit("complete"), "at": F.lit(now)}), STATUS)
    except Exception as error:  # logged below; the sync that follows must still run
        message, none = F.lit(str(error)), F.lit(None).cast("string")
        closing = _status(mine.withColumn("seq", F.col("seq") + 1).withColumns({
            "error_class": privacy.classify_error(message, none, F.lit(type(error).__name__)),
            "error_message": privacy.safe_error_message(message, none)}), "error", now)
    closing.write.mode("append").parquet(status_path)


class _Windows:
    """Date windows of one backfill job, each an append that is told apart by its first position."""

    def __init__(self, spark: SparkSession, history: DataFrame, ledger_path: str, path: str, now: str):
        self.spark, self.history, self.ledger_path, self.path, self.now = spark, history, ledger_path, path, now
        low, high = ledger_ops.arrival_bounds(history)
        self.first, self.span = low or 0, (high or 0) - (low or 0)

    def rows(self, state: str) -> DataFrame:
        found = read_table(self.spark, self.path)
        return (self.spark.createDataFrame([], WINDOWS) if found is None else found).filter(F.col("state") == state)

    def write(self, rows: DataFrame, state: str) -> None:
        out = rows.withColumns({"state": F.lit(state), "at": F.lit(self.now)})
        _rows(out, WINDOWS).write.mode("append").parquet(self.path)

    def repeat_open(self) -> None:
        """Finish the windows that an earlier run opened and did not complete (a run stops at its first)."""
        key = ["item_id", "start_date", "end_date", "first_position"]
        left = self.rows("open").select(*key).distinct().join(self.rows("done").select(*key), key, "left_anti")
        for w in left.select(*key[1:]).distinct().orderBy("first_position").collect():
            self.append(left.filter(F.col("first_position") == w["first_position"]).select("item_id"), *w)

    def run(self, items: DataFrame, low: str, high: str) -> None:
        """Import one window for those of ``items`` that no completed window covers there."""
        covered = self.rows("done").filter((F.col("start_date") <= low) & (F.col("end_date") >= high)).select("item_id")
        todo = items.join(covered, "item_id", "left_anti")
        if todo.isEmpty():
            return
        stored = read_table(self.spark, self.ledger_path)
        newest = None if stored is None else stored.agg(F.max("arrival_seq")).first()[0]
        position = 0 if newest is None else newest + 1
        window = {"start_date": F.lit(low), "end_date": F.lit(high), "first_position": F.lit(position)}
        self.write(todo.withColumns(window), "open")
        opened = self.rows("open").filter((F.col("first_position") == position) & (F.col("start_date") == low) &
                                          (F.col("end_date") == high)).select("item_id").distinct()
        self.append(opened, low, high, position)

    def append(self, items: DataFrame, low: str, high: str, position: int) -> None:
        rows = read_history_range(self.history, low, high).join(items, "item_id", "left_semi")
        rows = rows.withColumn("arrival_seq", F.col("arrival_seq") + F.lit(position - self.first))
        ledger_ops.write_events(rows.withColumn("event_type", F.lit("historical_import")), now=self.now,
                                path=self.ledger_path, ledger=read_table(self.spark, self.ledger_path))
        added = read_table(self.spark, self.ledger_path)
        out = items.withColumn("n", F.lit(0)) if added is None else items.join(added.filter(
            F.col("arrival_seq").between(position, position + self.span) & (F.col("event_type") == "historical_import")
        ).groupBy("item_id").agg(F.count(F.lit(1)).alias("n")), "item_id", "left")
        self.write(out.withColumns({"start_date": F.lit(low), "end_date": F.lit(high), "first_position": F.lit(position),
                                    "inserted_event_count": F.coalesce("n", F.lit(0))}), "done")


def _status(rows: DataFrame, status: str, now: str) -> DataFrame:
    return _rows(rows.withColumns({"status": F.lit(status), "at": F.lit(now)}), STATUS)


def _rows(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` in the columns of ``schema``, NULL where they have none."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n)
                         for n, t in (c.split() for c in schema.split(", "))])
