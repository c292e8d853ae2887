"""Audit jobs: hash-chain verification, diagnostics, integrity checks, append-only check.

Each counter set is one aggregation pass per input table; one-row results are combined by
``unionByName`` + ``max`` (no join and no driver round trip to combine them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashweave import schemas
from cashweave.functions import hashing
from cashweave.operators import merkle, roots
from cashweave.operators.ledger import DEFAULT_SEGMENT_WIDTH
from cashweave.operators.windows import seq_range

# Names of checks, tables and columns: most must equal the reference's, two inputs are named by us.
REQUIRED_INPUTS = ("items", "accounts", "transactions", "sync_log", "transaction_events",
                   "account_observations", "sync_runs", "backfill_state")
REQUIRED_VIEWS = ("transaction_latest_state", "transaction_current_state", "transaction_active_state",
                  "account_latest_state")
REQUIRED_LEDGER_COLUMNS = ("transaction_id", "item_id", "account_id", "txn_date", "pending_transaction_id",
                           "event_class", "arrival_seq")


def combine_one_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols.extend(f.columns)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def newest_from(entries: DataFrame, limit: int) -> int | None:
    """A position from which a ledger's ``entries`` hold at least ``limit`` rows; None where they hold fewer.

    One row a segment of an append is read, never ledger rows.
    """
    newer = Window.orderBy(F.col("last_seq").desc(), F.col("first_seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return entries.select("first_seq", F.sum("rows").over(newer).alias("n")).filter(F.col("n") >= limit).agg(F.max("first_seq")).first()[0]


def verify_hash_chain(ledger: DataFrame, limit: int | None = None, segment_width: int = DEFAULT_SEGMENT_WIDTH,
                      entries: DataFrame | None = None) -> DataFrame:
    """Q14: recompute every link; a row breaks when its hash differs from F6 of its fields or its
    stored ``prev_ledger_hash`` is not the hash of the row before it in its chain segment.

    Rows without a hash are not checked and leave "previous" empty for the next row. In a full
    check a row with no predecessor in its segment must start the chain (empty previous hash), so
    deleting a segment's first row is caught too. ``limit`` checks only the newest ``limit``
    events (the reference's bounded mode, where the first checked row has no link test); ``None``
    checks all, in parallel by segment. With the ledger's ``entries`` a limited check reads the newest segments alone
    and not the whole ledger to find its newest rows.
    """
    rows = ledger.select("arrival_seq", "event_identity", "payload_hash", "inserted_at", "prev_ledger_hash",
                         "ledger_hash")
    if limit:
        start = newest_from(entries, limit) if entries is not None else None
        if start is not None:
            rows = rows.filter(F.col("arrival_seq") >= start)  # pruned by Parquet statistics
        rows = rows.orderBy(F.col("arrival_seq").desc()).limit(limit)
    seg = seq_range("arrival_seq", segment_width)
    w = Window.partitionBy("_segment").orderBy("arrival_seq")
    rows = rows.withColumn("_segment", seg) \
        .withColumn("_previous", F.lag("ledger_hash").over(w)) \
        .withColumn("_has_pred", F.lag("arrival_seq").over(w).isNotNull())
    expected = hashing.ledger_hash(F.col("prev_ledger_hash"), F.col("event_identity"), F.col("payload_hash"),
                                   F.col("inserted_at"))
    checked = F.col("ledger_hash").isNotNull()
    link_ok = F.when(F.col("_has_pred"), F.col("prev_ledger_hash").eqNullSafe(F.col("_previous")))
    if not limit:
        link_ok = link_ok.otherwise(F.col("prev_ledger_hash").isNull())
    else:
        # Only the first checked row may follow one that is not read; other segments' heads start their chain.
        first = F.min("arrival_seq").over(Window.partitionBy())  # at most ``limit`` rows
        rows = rows.withColumn("_first", F.col("arrival_seq") == first)
        link_ok = link_ok.otherwise(F.col("_first") | F.col("prev_ledger_hash").isNull())
    broken = checked & ((expected != F.col("ledger_hash")) | ~link_ok)
    figures = [F.count_if(checked).alias("events_checked"), F.count_if(broken).alias("break_count"),
               F.min(F.when(broken, F.col("arrival_seq"))).alias("first_break_seq")]
    count = F.count(F.lit(1)).alias("total_events")
    # A full check has all rows in hand: the ledger, which may be a chain of jobs, is not computed again to count it.
    both = combine_one_row(rows.agg(*figures), ledger.agg(count)) if limit else rows.agg(*figures, count)
    return both.select(
        (F.col("break_count") == 0).alias("ok"), "events_checked", "break_count", "total_events",
        (F.lit(bool(limit)) & (F.col("total_events") > F.lit(limit or 0))).alias("partial"),
        "first_break_seq")


def content_hash_check(ledger: DataFrame) -> DataFrame:
    """Q15: stored canonical JSON still hashes to the stored payload hash."""
    bad = ledger.agg(F.count_if(F.sha2(F.col("raw_json"), 256) != F.col("payload_hash")).alias("n"))
    return bad.select(F.lit("content_hash_matches").alias("check"), (F.col("n") == 0).alias("ok"),
                      F.concat(F.col("n").cast("string"), F.lit(" mismatched")).alias("detail"))


def diagnostics(ledger: DataFrame, current: DataFrame, observations: DataFrame, account_latest: DataFrame,
                legacy_transactions: DataFrame | None = None, legacy_accounts: DataFrame | None = None) -> DataFrame:
    """A5: aggregate-only counters (no names, amounts, ids or raw JSON), one row."""
    et = F.col("event_type")
    ev = ledger.agg(
        F.count(F.lit(1)).alias("total_transaction_events"),
        F.count_if(et == "modified").alias("modified_event_count"),
        F.count_if(et == "removed").alias("removed_event_count"),
        F.count_if(et == "legacy_import").alias("legacy_import_event_count"),
        F.count_if(et == "historical_import").alias("historical_import_event_count"),
        F.count_if(F.col("raw_json").isNotNull() & (F.col("raw_json") != "")).alias("events_with_raw_json"),
        F.max("schema_version").alias("schema_version"),
    )
    active = (F.col("removed") == 0) & (F.col("superseded") == 0)
    st = current.agg(
        F.count(F.lit(1)).alias("distinct_transaction_ids"),
        F.count_if(active).alias("active_transactions"),
        F.count_if(active & (F.col("pending") == 1)).alias("pending_transactions"),
        F.count_if(F.col("removed") == 1).alias("removed_transactions"),
        F.count_if(F.col("superseded") == 1).alias("superseded_pending_transactions"),
        F.min(F.when(active, F.col("date"))).alias("earliest_transaction_date"),
        F.max(F.when(active, F.col("date"))).alias("latest_transaction_date"),
    )
    ob = observations.agg(F.count(F.lit(1)).alias("account_observation_count"))
    ac = account_latest.agg(F.count(F.lit(1)).alias("linked_accounts"),
                            F.count_if(F.col("name").isNotNull()).alias("accounts_with_metadata"))
    frames = [ev, st, ob, ac]
    if legacy_transactions is not None:
        frames.append(legacy_transactions.agg(F.count(F.lit(1)).alias("legacy_transaction_rows")))
    if legacy_accounts is not None:
        frames.append(legacy_accounts.agg(F.count(F.lit(1)).alias("legacy_account_rows")))
    out = combine_one_row(*frames)
    for c in ("legacy_transaction_rows", "legacy_account_rows"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0).cast("long"))
    return out.withColumn("expected_schema_version", F.lit(schemas.SCHEMA_VERSION)) \
        .withColumn("app_version", F.lit(schemas.APP_VERSION))


# The counter keys in the reference's display order.
DIAGNOSTIC_KEYS = (
    "total_transaction_events", "distinct_transaction_ids", "active_transactions", "pending_transactions",
    "removed_transactions", "superseded_pending_transactions", "modified_event_count", "removed_event_count",
    "legacy_import_event_count", "historical_import_event_count", "linked_accounts", "accounts_with_metadata",
    "account_observation_count", "events_with_raw_json", "earliest_transaction_date", "latest_transaction_date",
    "schema_version", "app_version",
)


def diagnostics_long(diag: DataFrame) -> DataFrame:
    """F32: counters as (position, metric, value) rows, in display order."""
    cols = [c for c in DIAGNOSTIC_KEYS if c in diag.columns]
    wide = diag.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = wide.unpivot([], cols, "metric", "value")
    pos = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("metric")).cast("int")
    return long.select(pos.alias("position"), "metric", "value")


def distinct_count(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the exact number of distinct values of a long text column that hardly repeats.

    Hashes of 8 bytes are grouped; the texts themselves meet only where their hash occurs more than once.
    """
    texts = rows.select(F.col(column).alias("_t"), F.xxhash64(column).alias("_h")).filter(F.col("_t").isNotNull())
    hashes = texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    again = texts.join(hashes.filter("_n > 1").select("_h"), "_h", "left_semi").select("_t").distinct()
    single = hashes.agg(F.count_if(F.col("_n") == 1).alias("_a"))
    several = again.agg(F.count(F.lit(1)).alias("_b"))
    return combine_one_row(single, several).select((F.col("_a") + F.col("_b")).alias(name))


def _check(name: str, ok, detail) -> list:
    return [F.lit(name).alias("check"), ok.alias("ok"), detail.alias("detail")]


def integrity_report(inputs: dict[str, DataFrame], views: dict[str, DataFrame], ledger: DataFrame,
                     account_latest: DataFrame, items: DataFrame, runs: DataFrame,
                     schema_version: int = schemas.SCHEMA_VERSION) -> DataFrame:
    """Q2-Q11: read-only integrity checks as rows (check, ok, detail)."""
    spark = ledger.sparkSession
    missing_inputs = [n for n in REQUIRED_INPUTS if n not in inputs]
    missing_views = [n for n in REQUIRED_VIEWS if n not in views]
    missing_cols = [c for c in REQUIRED_LEDGER_COLUMNS if c not in ledger.columns]
    one = spark.range(1)
    checks = [
        one.select(*_check("required_tables_exist", F.lit(not missing_inputs), F.lit(", ".join(missing_inputs)))),
        one.select(*_check("required_views_exist", F.lit(not missing_views), F.lit(", ".join(missing_views)))),
        one.select(*_check("required_columns_exist", F.lit(not missing_cols), F.lit(", ".join(missing_cols)))),
    ]
    # One pass over the ledger for plain figures, and narrow ones for what is distinct: one row of figures
    # that is unfolded to the ledger-level checks.
    plain = ledger.agg(
        F.count(F.lit(1)).alias("t"),
        F.count_if(F.col("account_id").isNull() &
                   F.get_json_object(F.col("raw_json"), "$.account_id").isNotNull()).alias("n"),
        F.max("schema_version").alias("v"))
    led = combine_one_row(plain, distinct_count(ledger, "event_identity", "d"),
                          ledger.select("transaction_id").na.drop().distinct().agg(F.count(F.lit(1)).alias("s")))
    text = {c: F.col(c).cast("string") for c in ("t", "d", "s", "n")}
    rows = [
        _check("no_duplicate_event_identities", F.col("t") == F.col("d"),
               F.concat(text["t"], F.lit(" events, "), text["d"], F.lit(" identities"))),
        _check("event_count_covers_state", F.col("t") >= F.col("s"),
               F.concat(text["t"], F.lit(" events, "), text["s"], F.lit(" transactions"))),
        _check("events_keep_account_id", F.col("n") == 0, F.concat(text["n"], F.lit(" missing"))),
        _check("migration_version_current", F.coalesce(F.col("v"), F.lit(0)) == F.lit(schema_version),
               F.concat(F.lit("v"), F.coalesce(F.col("v"), F.lit(0)).cast("string"))),
    ]
    checks.append(led.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("c")).select("c.*"))
    untraceable = account_latest.filter(F.col("item_id").isNotNull()) \
        .join(items.select("item_id"), "item_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    checks.append(untraceable.select(*_check("accounts_trace_to_item", F.col("n") == 0,
                                             F.concat(F.col("n").cast("string"), F.lit(" untraceable")))))
    ok_runs = runs.filter(F.col("status") == "ok").select("item_id")
    cursorless = items.filter((F.col("active") == 1) & (F.coalesce(F.col("cursor"), F.lit("")) == "")) \
        .join(ok_runs, "item_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    checks.append(cursorless.select(*_check("synced_items_have_cursor", F.col("n") == 0,
                                            F.concat(F.col("n").cast("string"), F.lit(" without cursor")))))
    last = runs.agg(F.max_by("status", "sync_id").alias("s"), F.count(F.lit(1)).alias("n"))
    checks.append(last.select(*_check("last_sync_succeeded", (F.col("n") == 0) | (F.col("s") == "ok"),
                                      F.when(F.col("n") == 0, F.lit("no syncs yet")).otherwise(F.col("s")))))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def append_only_audit(before: DataFrame, after: DataFrame, key: str = "arrival_seq") -> DataFrame:
    """Every row of ``before`` is still in ``after`` unchanged.

    Rows meet by ``key`` (unique in a ledger) with a 128-bit hash of all their columns: wide values, raw JSON
    among them, are hashed where they lie and never shuffled.
    """
    def narrow(df, name):
        columns = [F.col(c) for c in before.columns]
        hashed = F.struct(F.xxhash64(*columns), F.xxhash64(F.lit("again"), *reversed(columns)))
        return df.select(F.col(key).alias(f"_{name}"), hashed.alias(f"_{name}_hash"))

    both = narrow(before, "a").join(narrow(after, "b"), F.col("_a") == F.col("_b"), "left")
    lost = both.filter(~F.col("_a_hash").eqNullSafe(F.col("_b_hash"))).select(F.col("_a").alias(key))
    return lost.agg(F.count(F.lit(1)).alias("rows_changed_or_lost"),
                    F.min(key).alias("first_changed_key")) \
        .withColumn("append_only", F.col("rows_changed_or_lost") == 0)


def compare_versions(spark: SparkSession, before: str, after: str) -> DataFrame:
    """U6 by trees, one row: what the ledger at ``after`` does to the one at ``before``, each as its appends recorded it.

    Roots are compared first: an append whose tree is the same in both is not looked into. Below the others only
    segments that differ are read (see ``merkle.difference``); rows are never read. That the trees still bear out
    the rows is what ``merkle.damage`` checks.
    """
    def tops(path):
        return roots.read_roots(spark, path).select("root_seq", "first_seq", "tree")

    a, b = tops(before), tops(after)
    same = a.join(b, ["root_seq", "first_seq", "tree"], "left_semi").select("root_seq")
    found = merkle.difference(*[merkle.read_nodes(spark, p).join(same, "root_seq", "left_anti") for p in (before, after)])
    counts = found.agg(*[F.count_if(F.col("finding") == f).alias(f"rows_{f}") for f in merkle.FINDINGS])
    out = combine_one_row(counts, same.agg(F.count(F.lit(1)).alias("appends_equal")))
    return out.withColumn("append_only", reduce(lambda x, y: x & y, [F.col(f"rows_{f}") == 0 for f in merkle.FINDINGS if f != "added"]))


def events_by_item(ledger: DataFrame) -> DataFrame:
    """A15."""
    return ledger.groupBy("item_id").agg(F.count(F.lit(1)).alias("event_count"))
