"""Small mutable dimensions: items, sync runs, backfill status.

The reference updates these tables in place. Here every change is a DataFrame
transformation producing the new version (SCD-1), or an append to a status log read
through a newest-row view, so replays and lost executors never leave a half-applied update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashweave import schemas
from cashweave.functions import scalars

_ITEM_COLS = [f.name for f in schemas.ITEMS.fields]


def upsert_items(items: DataFrame, saves: DataFrame, now: str) -> DataFrame:
    """M1: insert or update items from ``saves`` (item_id, token_prefix, env, institution_id, institution_name).

    Updates take the new token and environment; NULL institution fields keep the old value;
    the item is reactivated, ``disconnected_at`` cleared; cursor and ``created_at`` are kept.
    """
    old = items.alias("o")
    new = saves.alias("n")
    j = old.join(new, F.col("o.item_id") == F.col("n.item_id"), "full_outer")
    is_new = F.col("n.item_id").isNotNull()

    def pick(col: str, rule):
        return F.when(is_new, rule).otherwise(F.col(f"o.{col}")).alias(col)

    return j.select(
        F.coalesce(F.col("n.item_id"), F.col("o.item_id")).alias("item_id"),
        pick("token_prefix", F.col("n.token_prefix")),
        pick("has_access_token", F.coalesce(F.col("n.token_prefix"), F.lit("")) != ""),
        pick("env", F.col("n.env")),
        pick("institution_id", F.coalesce(F.col("n.institution_id"), F.col("o.institution_id"))),
        pick("institution_name", F.coalesce(F.col("n.institution_name"), F.col("o.institution_name"))),
        F.col("o.cursor").alias("cursor"),
        F.coalesce(F.col("o.created_at"), F.when(is_new, F.lit(now))).alias("created_at"),
        pick("updated_at", F.lit(now)),
        pick("active", F.lit(1)),
        pick("disconnected_at", F.lit(None).cast("string")),
    )


def deactivate_items(items: DataFrame, item_ids: DataFrame, now: str, clear_token: bool = True) -> DataFrame:
    """M4/M7: active = 0 for the given ids, timestamps set, token optionally forgotten; history untouched."""
    hit = item_ids.select("item_id").distinct().withColumn("_hit", F.lit(True))
    j = items.join(hit, "item_id", "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    out = j.withColumn("active", F.when(h, F.lit(0)).otherwise(F.col("active"))) \
        .withColumn("disconnected_at", F.when(h, F.lit(now)).otherwise(F.col("disconnected_at"))) \
        .withColumn("updated_at", F.when(h, F.lit(now)).otherwise(F.col("updated_at")))
    if clear_token:
        out = out.withColumn("token_prefix", F.when(h, F.lit("")).otherwise(F.col("token_prefix"))) \
            .withColumn("has_access_token", F.when(h, F.lit(False)).otherwise(F.col("has_access_token")))
    return out.select(*_ITEM_COLS)


def disconnect_all(items: DataFrame, now: str) -> DataFrame:
    """M7: deactivate every active item."""
    return deactivate_items(items, items.filter(F.col("active") == 1).select("item_id"), now)


def advance_cursor(items: DataFrame, cursors: DataFrame, now: str) -> DataFrame:
    """M3: newest non-empty cursor per item from ``cursors`` (item_id, seq, mode, next_cursor), sync mode only."""
    ok = cursors.filter((F.col("mode") == "sync") & (F.coalesce(F.col("next_cursor"), F.lit("")) != ""))
    newest = ok.groupBy("item_id").agg(F.max_by("next_cursor", "seq").alias("_cursor"))
    j = items.join(newest, "item_id", "left")
    return j.withColumn("updated_at", F.when(F.col("_cursor").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))) \
        .withColumn("cursor", F.coalesce(F.col("_cursor"), F.col("cursor"))).select(*_ITEM_COLS)


def reconcile_environments(items: DataFrame, now: str) -> DataFrame:
    """fill a blank environment from the token prefix."""
    inferred = scalars.infer_environment(F.col("env"), F.col("token_prefix"))
    changed = F.coalesce(inferred, F.lit("")) != F.coalesce(F.col("env"), F.lit(""))
    return items.withColumn("updated_at", F.when(changed, F.lit(now)).otherwise(F.col("updated_at"))) \
        .withColumn("env", inferred).select(*_ITEM_COLS)


def active_items(items: DataFrame) -> DataFrame:
    """Active items ordered by creation, with ``has_access_token``; the token itself never leaves."""
    return items.filter(F.col("active") == 1).drop("token_prefix").orderBy("created_at", "item_id")


def connected_item_count(items: DataFrame, env: str | None = None) -> DataFrame:
    """A7."""
    f = F.col("active") == 1
    if env is not None:
        f = f & (F.col("env") == env)
    return items.agg(F.count_if(f).alias("connected_items"))


def connection_environment(items: DataFrame, configured_env: str | None = None) -> DataFrame:
    """The environment of active items: one value, ``mixed``, or NULL; and whether it needs a reset."""
    act = items.filter(F.col("active") == 1)
    envs = F.array_sort(F.collect_set(F.coalesce(F.nullif(F.col("env"), F.lit("")), F.lit("unknown"))))
    agg = act.agg(envs.alias("_envs"))
    env = F.when(F.size("_envs") == 1, F.col("_envs")[0]).when(F.size("_envs") > 1, F.lit("mixed"))
    out = agg.select(env.alias("connection_environment"))
    if configured_env is not None:
        out = out.withColumn("connection_requires_reset",
                             F.col("connection_environment").isNotNull() &
                             (F.col("connection_environment") != F.lit(configured_env)))
    return out


def sync_runs_view(run_events: DataFrame) -> DataFrame:
    """M6: newest row per run; a closing row without a mode keeps the opening one."""
    cols = [c for c in run_events.columns if c not in ("sync_id", "event_seq")]
    agg = run_events.groupBy("sync_id").agg(
        F.max_by(F.struct(*cols), F.col("event_seq")).alias("r"),
        F.max_by(F.col("mode"), F.when(F.col("mode").isNotNull(), F.col("event_seq"))).alias("_mode"))
    return agg.select("sync_id", *[F.col("r").getField(c).alias(c) for c in cols if c != "mode"],
                      F.col("_mode").alias("mode"))


def last_sync_at(runs: DataFrame, legacy_log: DataFrame | None = None) -> DataFrame:
    """Newest finish time of an ok run; when there is none, of the legacy log."""
    a = runs.agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("_runs"))
    if legacy_log is None:
        return a.select(F.col("_runs").alias("last_sync_at"))
    b = legacy_log.agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("_legacy"))
    both = a.unionByName(b, allowMissingColumns=True).agg(F.max("_runs").alias("r"), F.max("_legacy").alias("l"))
    return both.select(F.coalesce("r", "l").alias("last_sync_at"))


def last_sync_summary(runs: DataFrame) -> DataFrame:
    """The newest run (by sync id) without its item id."""
    cols = [c for c in runs.columns if c not in ("item_id",)]
    return runs.agg(F.max_by(F.struct(*cols), F.col("sync_id")).alias("r")).select("r.*") \
        .filter(F.col("sync_id").isNotNull())


def backfill_state(status_log: DataFrame) -> DataFrame:
    """M5: newest status row per item; ``attempts`` counts the starts."""
    cols = [c for c in status_log.columns if c not in ("item_id", "seq")]
    agg = status_log.groupBy("item_id").agg(
        F.max_by(F.struct(*cols), F.col("seq")).alias("r"),
        F.count_if(F.col("status") == "running").alias("attempts"))
    return agg.select("item_id", "r.*", "attempts")


def backfill_complete(items: DataFrame, backfill: DataFrame) -> DataFrame:
    """False without active items, else every active item has a completed backfill."""
    act = items.filter(F.col("active") == 1).select("item_id")
    done = backfill.filter(F.col("status") == "complete").select("item_id").join(act, "item_id", "inner")
    a = act.agg(F.count(F.lit(1)).alias("items"))
    d = done.agg(F.count(F.lit(1)).alias("done"))
    both = a.unionByName(d, allowMissingColumns=True).agg(F.max("items").alias("items"), F.max("done").alias("done"))
    return both.select("items", "done", ((F.col("items") > 0) & (F.col("done") >= F.col("items"))).alias("backfill_complete"))


def plan_backfills(items: DataFrame, backfill: DataFrame, today, days: int = 730) -> DataFrame:
    """T7s: active items without a completed backfill, with the history range to request.

    Runs before the sync of those items, once per item; it never touches the cursor.
    """
    from cashweave.sources.pages import history_start

    done = backfill.filter(F.col("status") == "complete").select("item_id")
    todo = items.filter(F.col("active") == 1).select("item_id").join(done, "item_id", "left_anti")
    start = history_start(days, today)
    return todo.select("item_id", F.lit(start.isoformat()).alias("start_date"),
                       F.lit(str(today)[:10]).alias("end_date"))


def health_summary(items: DataFrame, ledger: DataFrame, active: DataFrame, runs: DataFrame,
                   configured_env: str) -> DataFrame:
    """One row of counts and state flags; the active count is forced to 0 when
    the stored connection belongs to another environment."""
    from cashweave.operators.audit import combine_one_row

    env = connection_environment(items, configured_env)
    frames = [
        env,
        connected_item_count(items, configured_env),
        active.agg(F.count(F.lit(1)).alias("_active")),
        ledger.agg(F.count(F.lit(1)).alias("transaction_event_count")),
        last_sync_at(runs),
    ]
    out = combine_one_row(*frames)
    reset = F.coalesce(F.col("connection_requires_reset"), F.lit(False))
    return out.select(
        F.lit(configured_env).alias("env"), "connected_items",
        F.when(reset, F.lit(0).cast("long")).otherwise(F.col("_active")).alias("transaction_count"),
        "transaction_event_count", "last_sync_at", "connection_environment",
        reset.alias("connection_requires_reset"))
