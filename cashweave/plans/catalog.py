"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's test tables through a fixture mapping and then runs the
library's own jobs on the whole result. Column names equal those of ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashweave.operators import audit, details, dimensions, merkle, observations, privacy_jobs, refresh, reports, roots, state
from cashweave.operators import ledger as ledger_ops
from cashweave.plans import oracle
from cashweave.session import checkpoint_dir, tune
from cashweave.sources import fixtures, legacy
from cashweave.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

MONEY = "decimal(38,2)"


def l1_ledger(spark: SparkSession, sf_dir: str, chain: bool = False) -> DataFrame:
    """The L1 change feed appended as one batch to an empty ledger."""
    return ledger_ops.append_events(fixtures.l1_changes(spark, sf_dir), now=fixtures.FIXTURE_NOW, chain=chain)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Queries that read the ledger more than once (state views join it with its own links)
    read it from a stored table, as a production report job reads the ingested ledger,
    instead of rebuilding it per branch. Column pruning and filter pushdown apply to the read.
    """
    path = _table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def l1_stored_ledger(spark: SparkSession, sf_dir: str, chain: bool = False) -> DataFrame:
    return stored(l1_ledger(spark, sf_dir, chain), "l1-ledger")


def l1_current(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    return state.current_state_from_ledger(l1_stored_ledger(spark, sf_dir), columns=columns)


def l1_active(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] | None = state.REPORT_COLUMNS) -> DataFrame:
    return state.active_state(l1_current(spark, sf_dir, columns))


def r1_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = stored(ledger_ops.append_events(fixtures.r1_changes(spark, sf_dir), now=fixtures.FIXTURE_NOW,
                                             chain=False), "r1-ledger")
    return state.active_state(state.current_state_from_ledger(ledger, columns=state.REPORT_COLUMNS))


def _state_cols(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select("transaction_id", "state_event_id", "removal_event_id", "event_type", "account_id",
                     "pending_transaction_id", "date", "name", "merchant_name",
                     F.col("amount").cast(MONEY).alias("amount"), "pending", "removed", *extra)


def q_collapse_repeats(spark, sf_dir):
    return l1_ledger(spark, sf_dir).select("arrival_seq", "transaction_id", "event_type", "event_class",
                                           "payload_hash")


def q_supersedes_link(spark, sf_dir):
    return l1_ledger(spark, sf_dir).select("arrival_seq", "transaction_id", "supersedes_seq")


def q_event_identity(spark, sf_dir):
    return l1_ledger(spark, sf_dir).select("arrival_seq", "event_identity")


def q_latest_state(spark, sf_dir):
    return _state_cols(state.latest_state(l1_ledger(spark, sf_dir)))  # one read of the ledger: no table


def q_current_state(spark, sf_dir):
    return _state_cols(l1_current(spark, sf_dir), ("superseded",))


def q_active_state(spark, sf_dir):
    return _state_cols(l1_active(spark, sf_dir, None), ("superseded",))


def q_monthly_cashflow(spark, sf_dir):
    return reports.monthly_cashflow(l1_active(spark, sf_dir), months_back=oracle.MONTHS_BACK, today=oracle.TODAY)


def q_monthly_cashflow_all(spark, sf_dir):
    return reports.monthly_cashflow(l1_active(spark, sf_dir))


def q_monthly_cashflow_by_account(spark, sf_dir):
    return reports.monthly_cashflow(r1_active(spark, sf_dir), by=("account_id",))


def q_summarize_months(spark, sf_dir):
    months = reports.monthly_cashflow(l1_active(spark, sf_dir), months_back=oracle.MONTHS_BACK, today=oracle.TODAY)
    return reports.summarize_months(months)


def q_top_merchants_outflow(spark, sf_dir):
    return reports.top_merchants(l1_active(spark, sf_dir), "outflow", 10, oracle.MONTHS_BACK, oracle.TODAY)


def q_top_merchants_inflow(spark, sf_dir):
    return reports.top_merchants(l1_active(spark, sf_dir), "inflow", 10, oracle.MONTHS_BACK, oracle.TODAY)


def ob1_observations(spark, sf_dir):
    return observations.append_account_observations(fixtures.ob1_readings(spark, sf_dir), now=fixtures.FIXTURE_NOW)


def ob1_accounts(spark, sf_dir):
    return state.account_latest_state(ob1_observations(spark, sf_dir))


def q_observation_append(spark, sf_dir):
    return ob1_observations(spark, sf_dir).select("observation_seq", "account_id", "item_id", "current_balance",
                                                  "payload_hash", "observation_identity")


def q_account_latest_state(spark, sf_dir):
    return ob1_accounts(spark, sf_dir).select("account_id", "observation_seq", "name", "current_balance")


def q_transaction_details(spark, sf_dir):
    rows = details.list_transaction_details(l1_current(spark, sf_dir), ob1_accounts(spark, sf_dir), limit=500)
    return rows.select("transaction_id", "date", F.col("amount").cast(MONEY).alias("amount"), "status",
                       "direction", "account_label", "state_event_id")


def q_search_transactions(spark, sf_dir):
    rows = details.list_transaction_details(l1_current(spark, sf_dir), None, limit=None, search="n5",
                                            include_removed=True)
    return rows.select("transaction_id", "name", "merchant_name", "status", "state_event_id")


def q_transaction_versions(spark, sf_dir):
    v = details.transaction_versions(l1_ledger(spark, sf_dir))
    return v.select("transaction_id", "event_id", "version_number", "event_type", "supersedes_event_id",
                    F.col("amount").cast(MONEY).alias("amount"), "direction",
                    F.variant_get(F.col("raw"), "$.transaction_id", "string").alias("raw_transaction_id"))


def q_status_labels(spark, sf_dir):
    cur = details.expand_json(l1_current(spark, sf_dir))
    out = details.with_labels(cur)
    return out.select("transaction_id", "status", "category_label", "direction")


def q_diagnostics(spark, sf_dir):
    led = l1_stored_ledger(spark, sf_dir)
    cur = state.current_state(state.latest_state(led))
    obs = ob1_observations(spark, sf_dir)
    return audit.diagnostics(led, cur, obs, state.account_latest_state(obs),
                             fixtures.lg1_legacy_transactions(spark, sf_dir),
                             fixtures.lg1_legacy_accounts(spark, sf_dir))


def q_diagnostics_long(spark, sf_dir):
    return audit.diagnostics_long(q_diagnostics(spark, sf_dir))


def q_integrity_report(spark, sf_dir):
    led = l1_stored_ledger(spark, sf_dir)
    obs = ob1_observations(spark, sf_dir)
    accts = state.account_latest_state(obs)
    items = fixtures.it1_items(spark, sf_dir)
    runs = fixtures.sr1_runs(spark, sf_dir)
    inputs = {"items": items, "accounts": fixtures.lg1_legacy_accounts(spark, sf_dir),
              "transactions": fixtures.lg1_legacy_transactions(spark, sf_dir), "transaction_events": led,
              "account_observations": obs, "sync_runs": runs,
              "backfill_state": fixtures.bf1_backfill_log(spark, sf_dir)}
    views = {"transaction_latest_state": None, "transaction_current_state": None,
             "transaction_active_state": None, "account_latest_state": accts}
    return audit.integrity_report(inputs, views, led, accts, items, runs)


def q_verify_hash_chain(spark, sf_dir):
    return audit.verify_hash_chain(l1_ledger(spark, sf_dir, chain=True))


def q_verify_hash_chain_limited(spark, sf_dir):
    """The bounded check of the newest 2,000 events, found by the appends' entries."""
    path, led, _ = _written_ledger(spark, sf_dir, ledger_ops.DEFAULT_SEGMENT_WIDTH)
    return audit.verify_hash_chain(led, limit=2000, entries=roots.read_entries(spark, path))


def q_content_hash_check(spark, sf_dir):
    return audit.content_hash_check(l1_ledger(spark, sf_dir))


def q_events_by_item(spark, sf_dir):
    return audit.events_by_item(l1_ledger(spark, sf_dir))


def q_report_refresh(spark, sf_dir):
    """L1 in four appends; after each the kept totals take in the appended rows; then both reports from them."""
    path, base = _table_path(spark, "refresh-ledger"), _table_path(spark, "refresh-kept")
    changes = fixtures.l1_changes(spark, sf_dir)
    top = changes.agg(F.max("arrival_seq")).first()[0]
    for n in range(4):
        part = changes.filter(F.floor(F.col("arrival_seq") * 4 / (top + 1)) == n)
        known = read_table(spark, path)
        ledger_ops.write_events(part, now=fixtures.FIXTURE_NOW, path=f"{path}", ledger=known, chain=False,
                                partition=("append", n), mode="overwrite")
        new = spark.read.parquet(path).filter(F.col("append") == n)
        kept = refresh.refresh(spark, base, n, new)
    none = F.lit(None)
    months = refresh.monthly_cashflow(kept).select(
        F.lit("months").alias("report"), F.col("month").alias("item"), "inflow", "outflow", "transaction_count", none.cast("int").alias("rank"))
    merchants = refresh.top_merchants(kept, "outflow", 10, oracle.MONTHS_BACK, oracle.TODAY).select(
        F.lit("merchants").alias("report"), F.col("merchant").alias("item"), none.cast("decimal(38,2)").alias("inflow"),
        F.col("amount").alias("outflow"), "transaction_count", "rank")
    return months.unionByName(merchants)


def q_append_only_audit(spark, sf_dir):
    """Two versions of a ledger by their trees, and the two appends against one append of everything."""
    changes = fixtures.l1_changes(spark, sf_dir)
    cut = changes.agg(F.max("arrival_seq")).first()[0] // 2
    first, now = changes.filter(F.col("arrival_seq") < cut), fixtures.FIXTURE_NOW
    before, after, single = (_table_path(spark, f"audit-{n}") for n in ("before", "after", "single"))
    for path in (before, after):
        ledger_ops.write_events(first, now=now, path=path)
    ledger_ops.write_events(changes.filter(F.col("arrival_seq") >= cut), now=now, path=after, ledger=spark.read.parquet(after))
    ledger_ops.write_events(changes, now=now, path=single)
    versions = audit.compare_versions(spark, before, after)
    report = versions.select((F.col("rows_changed") + F.col("rows_deleted") + F.col("rows_moved") + F.col("rows_duplicated")).alias(
        "rows_changed_or_lost"), "append_only", "appends_equal", F.col("rows_added").alias("added_rows"))
    diff = merkle.difference(*[merkle.tree_of(spark.read.parquet(p)) for p in (single, after)]).agg(
        F.count(F.lit(1)).alias("differs_from_single_batch"))
    return audit.combine_one_row(report, diff)


def q_append_retry(spark, sf_dir):
    """L1 in two appends: each dies once behind its rows, is repeated later, and is then sent a third time.

    The rows are those of one undisturbed run, with the first attempt's time of insertion; ``verified`` tells
    that roots, trees and rows agree.
    """
    path, width = _table_path(spark, "l1-retry"), ledger_ops.DEFAULT_SEGMENT_WIDTH
    changes = fixtures.l1_changes(spark, sf_dir)
    cut = changes.agg(F.max("arrival_seq")).first()[0] // 2
    for part in (changes.filter(F.col("arrival_seq") <= cut), changes.filter(F.col("arrival_seq") > cut)):
        rows = ledger_ops.append_events(part, now=fixtures.FIXTURE_NOW, ledger=read_table(spark, path))
        rows.write.mode("append").option("compression", "zstd").parquet(path)  # the attempt that dies before its entries and root
        for later in ("2024-03-01T00:00:00Z", "2024-04-01T00:00:00Z"):
            ledger_ops.write_events(part, now=later, path=path, ledger=spark.read.parquet(path))
    led, entries = spark.read.parquet(path), roots.read_entries(spark, path)
    sound = roots.verify_roots(led, entries, roots.read_roots(spark, path), width).first()["ok"] and merkle.damage(
        led, merkle.read_nodes(spark, path), entries, width).isEmpty()
    return led.select("arrival_seq", "transaction_id", "event_type", "supersedes_seq", "inserted_at", "event_identity",
                      "ledger_hash", F.lit(sound).alias("verified"))


def q_ledger_tree(spark, sf_dir):
    """Every node of the trees of L1's two appends."""
    path, _, _ = _written_ledger(spark, sf_dir, ledger_ops.DEFAULT_SEGMENT_WIDTH)
    return merkle.read_nodes(spark, path).select("root_seq", "level", F.col("index").alias("node"), "rows", "hash")


def q_event_proof(spark, sf_dir):
    """The newest event of every transaction proved against its append's tree, with the hashes read for it."""
    width = ledger_ops.DEFAULT_SEGMENT_WIDTH
    path, led, _ = _written_ledger(spark, sf_dir, width)
    newest = led.groupBy("transaction_id").agg(F.max("arrival_seq").alias("arrival_seq"))
    return merkle.event_proofs(led, newest, merkle.read_nodes(spark, path), roots.read_entries(spark, path),
                               roots.read_roots(spark, path), width)


def q_ledger_diff(spark, sf_dir):
    """L1 damaged after the fact, and what its trees say of each position: removals deleted, modified rows changed,
    pending ones doubled, large amounts moved."""
    width = ledger_ops.DEFAULT_SEGMENT_WIDTH
    path, led, _ = _written_ledger(spark, sf_dir, width)
    kind = F.when(F.col("event_type") == "removed", "gone").when(F.col("event_type") == "modified", "edited").when(
        F.col("pending") == 1, "twice").when(F.col("amount") > oracle.LARGE_AMOUNT, "shifted").otherwise("kept")
    marked = led.withColumn("_kind", kind)
    bad = marked.filter("_kind <> 'gone'").withColumn("payload_hash", F.when(F.col("_kind") == "edited", F.lit("0" * 64)).otherwise(
        F.col("payload_hash"))).withColumn("arrival_seq", F.when(F.col("_kind") == "shifted", F.col("arrival_seq") + oracle.SHIFT).otherwise(
            F.col("arrival_seq")))
    bad = bad.unionByName(marked.filter("_kind = 'twice'")).drop("_kind")
    return merkle.damage(bad, merkle.read_nodes(spark, path), roots.read_entries(spark, path), width)


def q_backfill_complete(spark, sf_dir):
    bf = dimensions.backfill_state(fixtures.bf1_backfill_log(spark, sf_dir))
    return dimensions.backfill_complete(fixtures.it1_items(spark, sf_dir), bf)


def q_backfill_state(spark, sf_dir):
    return dimensions.backfill_state(fixtures.bf1_backfill_log(spark, sf_dir)).select("item_id", "status", "attempts")


def q_connection_environment(spark, sf_dir):
    items = fixtures.it1_items(spark, sf_dir)
    env = dimensions.connection_environment(items, configured_env="production")
    cnt = dimensions.connected_item_count(items, "production")
    return audit.combine_one_row(env, cnt)


def q_upsert_items(spark, sf_dir):
    items = dimensions.upsert_items(fixtures.it1_items(spark, sf_dir), fixtures.it1_saves(spark, sf_dir), now="N")
    return items.select("item_id", "env", "institution_id", "institution_name", "cursor", "active",
                        "disconnected_at", "updated_at")


def q_reconcile_environments(spark, sf_dir):
    items = dimensions.reconcile_environments(fixtures.it1_items(spark, sf_dir), now="N")
    return items.select("item_id", "env")


def q_last_sync(spark, sf_dir):
    runs = fixtures.sr1_runs(spark, sf_dir)
    last = dimensions.last_sync_summary(runs).select("sync_id", "status", "finished_at")
    at = dimensions.last_sync_at(runs)
    return audit.combine_one_row(last, at)


def q_redact_documents(spark, sf_dir):
    return privacy_jobs.redact_documents(fixtures.table(spark, sf_dir, "documents"))


def q_secret_scan(spark, sf_dir):
    return privacy_jobs.secret_scan(fixtures.table(spark, sf_dir, "documents"))


def q_fingerprint(spark, sf_dir):
    items = fixtures.it1_items(spark, sf_dir).select("item_id", "cursor")
    return privacy_jobs.fingerprint_column(items, "cursor")


def q_classify_errors(spark, sf_dir):
    return privacy_jobs.classify_errors(fixtures.er1_errors(spark, sf_dir))


def q_legacy_import(spark, sf_dir):
    ev = legacy.import_legacy_transactions(fixtures.lg1_legacy_transactions(spark, sf_dir), now=fixtures.FIXTURE_NOW)
    return ev.select("arrival_seq", "transaction_id", "event_type", "supersedes_seq", "payload_hash",
                     "event_identity", "pending", "txn_date", F.col("amount").cast(MONEY).alias("amount"))


def q_legacy_accounts(spark, sf_dir):
    obs = legacy.import_legacy_accounts(fixtures.lg1_legacy_accounts(spark, sf_dir), now=fixtures.FIXTURE_NOW)
    return obs.select("observation_seq", "account_id", "payload_hash", "observation_identity", "observed_at")


_STREAMED = ("arrival_seq", "transaction_id", "event_type", "event_class", "payload_hash", "supersedes_seq",
             "event_identity", "location_json")


#: Pages of a landed file.
PAGES_A_FILE = 1000


def _streamed(spark, sf_dir, name, start):
    """Open pages landed in two groups; after each, ``start(base)`` drains what is new and stops."""
    import uuid

    base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    pages = stored(fixtures.open_pages(spark, sf_dir), f"{name}-pages")
    low, top = pages.agg(F.min("page_seq"), F.max("page_seq")).first()
    for g in range(2):
        group = F.floor((F.col("page_seq") - low) * 2 / (top - low + 1)) == g
        # As feeds land pages: packed, in files of bounded length (a packed file is read by one task).
        pages.filter(group).select("value").write.mode("append").option("compression", "gzip").option(
            "maxRecordsPerFile", PAGES_A_FILE).text(f"{base}/pages")
        start(base).awaitTermination()
    return base


def q_stream_ingest(spark, sf_dir):
    """Landed pages through the stream in two runs; the last micro-batch is replayed and replaces itself."""
    from cashweave import schemas
    from cashweave.streaming import ingest

    base = _streamed(spark, sf_dir, "stream-ingest", lambda b: ingest.start_ingest(
        spark, f"{b}/pages", f"{b}/ledger", f"{b}/chk", f"{b}/runs", now=fixtures.FIXTURE_NOW))
    pages = spark.read.schema(schemas.CHANGE_PAGE).json(f"{base}/pages")
    low, top = pages.agg(F.min("page_seq"), F.max("page_seq")).first()
    last = pages.filter(F.floor((F.col("page_seq") - low) * 2 / (top - low + 1)) == 1)
    ingest.LedgerWriter(f"{base}/ledger", f"{base}/runs", fixtures.FIXTURE_NOW)(last, 1)
    return spark.read.parquet(f"{base}/ledger").select(*_STREAMED)


def q_sync_totals(spark, sf_dir):
    """A12 over the run log that the stream wrote."""
    from cashweave.streaming import ingest

    base = _streamed(spark, sf_dir, "stream-totals", lambda b: ingest.start_ingest(
        spark, f"{b}/pages", f"{b}/ledger", f"{b}/chk", f"{b}/runs", now=fixtures.FIXTURE_NOW))
    return ingest.sync_totals(spark.read.parquet(f"{base}/runs"))


def q_ingest_runs(spark, sf_dir):
    """The run log as the ingest wrote it, with a failed run at its end, through the run view (M6, T6s, O6)."""
    from cashweave import schemas
    from cashweave.streaming import ingest

    base = _streamed(spark, sf_dir, "stream-runs", lambda b: ingest.start_ingest(
        spark, f"{b}/pages", f"{b}/ledger", f"{b}/chk", f"{b}/runs", now=fixtures.FIXTURE_NOW))
    bad = spark.read.schema(schemas.CHANGE_PAGE).json(f"{base}/pages").withColumn(
        "next_cursor", F.when(F.col("page_seq") >= 0, F.raise_error(F.lit("connection lost")).cast("string")))
    try:
        ingest.LedgerWriter(f"{base}/ledger", f"{base}/runs", fixtures.FIXTURE_NOW)(bad, 2)
    except Exception as error:
        if "connection lost" not in str(error):
            raise
    runs = dimensions.sync_runs_view(spark.read.parquet(f"{base}/runs").drop("ingest_batch", "phase"))
    return runs.select("batch_id", "item_id", "status", "mode", "error_class", "page_count", "inserted_event_count",
                       F.col("starting_cursor_fingerprint").isNotNull().alias("continues"))


def q_backfill_job(spark, sf_dir):
    """R1's orders as history of the active items, run twice: what each run imported and completed."""
    import uuid

    from cashweave.streaming import backfill

    base = f"{checkpoint_dir(spark).rstrip('/')}/backfill-{uuid.uuid4().hex}"
    items, history = fixtures.it1_items(spark, sf_dir), fixtures.r1_changes(spark, sf_dir)
    for n in (1, 2):
        backfill.run_backfill(spark, items, history, f"{base}/ledger", f"{base}/status", f"run {n}", "2001-08-01")
    log = backfill.read_status(spark, f"{base}/status")
    return log.groupBy(F.col("at").alias("run"), "status").agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("inserted_event_count"), F.lit(0)).alias("events"))


def q_backfill_windows(spark, sf_dir):
    """R1's orders as history in windows of 200 days: the first run loses its connection behind the second window, the
    second run starts at the third."""
    import uuid

    from cashweave.streaming import backfill

    base = f"{checkpoint_dir(spark).rstrip('/')}/backfill-{uuid.uuid4().hex}"
    items, history = fixtures.it1_items(spark, sf_dir), fixtures.r1_changes(spark, sf_dir)
    lost = history.withColumn("item_id", F.when(
        F.col("payload.date") >= oracle.LOST_FROM, F.raise_error(F.lit("connection lost")).cast("string")).otherwise(F.col("item_id")))
    for name, rows in (("run 1", lost), ("run 2", history)):
        backfill.run_backfill(spark, items, rows, f"{base}/ledger", f"{base}/status", name, "2001-08-01", window_days=200)
    return backfill.read_windows(spark, f"{base}/status").filter("state = 'done'").groupBy(
        F.col("at").alias("run"), "start_date", "end_date").agg(
        F.count(F.lit(1)).alias("items"), F.sum("inserted_event_count").alias("events"))


def q_stream_ingest_stateful(spark, sf_dir):
    """The same landed pages through the state-store ingest (keyed dedup state per id)."""
    from cashweave.streaming import stateful

    base = _streamed(spark, sf_dir, "stream-stateful", lambda b: stateful.start_stateful_ingest(
        spark, f"{b}/pages", f"{b}/ledger", f"{b}/chk", now=fixtures.FIXTURE_NOW))
    return spark.read.parquet(f"{base}/ledger").select(*_STREAMED)


def _open_ledger(spark, sf_dir):
    """Open pages appended as one batch."""
    from cashweave import schemas
    from cashweave.sources import pages as page_src

    lines = stored(fixtures.open_pages(spark, sf_dir), "open-pages").select(F.from_json("value", schemas.CHANGE_PAGE).alias("p")).select("p.*")
    path = _table_path(spark, "open-ledger")
    ledger_ops.write_events(page_src.explode_pages(lines), now=fixtures.FIXTURE_NOW, path=path, chain=False)
    return spark.read.parquet(path)


def q_open_payload(spark, sf_dir):
    """Payloads kept whole: unlisted fields in raw_json and its hash, credentials stripped, empty ids left out."""
    return _open_ledger(spark, sf_dir).select("arrival_seq", "transaction_id", "event_type", "raw_json", "payload_hash",
                                              "txn_datetime", "supersedes_seq")


def q_detail_labels(spark, sf_dir):
    """Labels of the newest versions (P18, P22-P26) from nested fields that are really there."""
    current = state.current_state_from_ledger(_open_ledger(spark, sf_dir))
    rows = details.with_labels(details.list_transaction_details(current, None, include_removed=True))
    return rows.select("transaction_id", "category_label", "location_label", "counterparty_names")


def q_point_scan(spark, sf_dir):
    """All versions of the id with the most events, numbered from the oldest."""
    led = l1_stored_ledger(spark, sf_dir)
    top = led.groupBy("transaction_id").count().orderBy(F.desc("count"), "transaction_id").first()["transaction_id"]
    return details.transaction_versions(led, top).select("event_id", "version_number", "event_type")


def q_account_transactions(spark, sf_dir):
    """The listing of one account."""
    rows = details.list_transaction_details(l1_current(spark, sf_dir), None, account_id="a1", include_removed=True)
    return rows.select("transaction_id", "date", F.col("amount").cast(MONEY).alias("amount"))


def q_active_items(spark, sf_dir):
    """P27."""
    return dimensions.active_items(fixtures.it1_items(spark, sf_dir)).select("item_id", "env", "has_access_token")


def q_explode_pages(spark, sf_dir):
    from cashweave.sources import pages as page_src

    ch = page_src.explode_pages(fixtures.pg1_pages(spark, sf_dir))
    return ch.select("arrival_seq", "item_id", "event_type", F.col("payload.transaction_id").alias("transaction_id"))


def q_history_range(spark, sf_dir):
    from cashweave.sources import pages as page_src

    start = page_src.history_start(730, "2001-08-01")
    snap = page_src.read_history_range(fixtures.r1_changes(spark, sf_dir), start, "2001-08-01")
    led = ledger_ops.append_history(snap, now=fixtures.FIXTURE_NOW, chain=False)
    return led.select("transaction_id", "event_type", "txn_date", F.col("amount").cast(MONEY).alias("amount"))


def q_report_delivery(spark, sf_dir):
    """The monthly report written and read back."""
    import uuid

    from cashweave.sources import pages as page_src

    path = f"{checkpoint_dir(spark).rstrip('/')}/reports/monthly-{uuid.uuid4().hex}"
    page_src.write_report(q_monthly_cashflow(spark, sf_dir), path)
    return spark.read.parquet(path)


def q_health_summary(spark, sf_dir):
    led = l1_stored_ledger(spark, sf_dir)
    act = state.active_state(state.current_state_from_ledger(led, columns=state.REPORT_COLUMNS))
    return dimensions.health_summary(fixtures.it1_items(spark, sf_dir), led, act, fixtures.sr1_runs(spark, sf_dir),
                                     configured_env="production")


def q_backfill_plan(spark, sf_dir):
    bf = dimensions.backfill_state(fixtures.bf1_backfill_log(spark, sf_dir))
    return dimensions.plan_backfills(fixtures.it1_items(spark, sf_dir), bf, today=oracle.TODAY)


def _table_path(spark, name):
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def _written_ledger(spark, sf_dir, segment_width):
    """L1 appended by the ingest job in two batches; returns (path, ledger, last position of the first)."""
    path = _table_path(spark, "l1-written")
    changes = fixtures.l1_changes(spark, sf_dir)
    cut = changes.agg(F.max("arrival_seq")).first()[0] // 2
    first = changes.filter(F.col("arrival_seq") <= cut)
    ledger_ops.write_events(first, now=fixtures.FIXTURE_NOW, path=path, segment_width=segment_width)
    ledger_ops.write_events(changes.filter(F.col("arrival_seq") > cut), now=fixtures.FIXTURE_NOW, path=path,
                            ledger=spark.read.parquet(path), segment_width=segment_width)
    return path, spark.read.parquet(path), cut


def q_verify_chain_manifest(spark, sf_dir):
    """L1 written by the ingest job in two appends, then the check of entries and roots."""
    path, led, _ = _written_ledger(spark, sf_dir, ledger_ops.DEFAULT_SEGMENT_WIDTH)
    return roots.verify_roots(led, roots.read_entries(spark, path), roots.read_roots(spark, path),
                              ledger_ops.DEFAULT_SEGMENT_WIDTH)


def q_chain_deletions(spark, sf_dir):
    """Rows deleted between appends and after them: head and tail of the first append, one segment, one page."""
    width = oracle.CHAIN_WIDTH
    path, led, cut = _written_ledger(spark, sf_dir, width)
    entries, known = roots.read_entries(spark, path), roots.read_roots(spark, path)
    seq = F.col("arrival_seq")
    ends = led.filter(seq <= cut).agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    cases = {"nothing": F.lit(False), "head": seq == ends.lo, "tail": seq == ends.hi,
             "segment": F.expr(f"arrival_seq div {width}") == 1, "page": seq.between(100, 299)}
    out = None
    for name, gone in cases.items():
        got = roots.verify_roots(led.filter(~gone), entries, known, width).select(
            F.lit(name).alias("deleted"), "ok", "segments_mismatched", "rows_uncovered", "roots_broken")
        out = got if out is None else out.unionByName(got)
    return out


def q_ledger_chain(spark, sf_dir):
    """Every ledger row's chain link and hash (segments of 65,536 arrival positions)."""
    return l1_ledger(spark, sf_dir, chain=True).select("arrival_seq", "prev_ledger_hash", "ledger_hash")


def q_verify_hash_chain_tampered(spark, sf_dir):
    """Two edits after the fact: the newest row's payload hash, and the oldest row's stored link
    hash (which also breaks the next row's link)."""
    led = l1_stored_ledger(spark, sf_dir, chain=True)
    bounds = led.agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi")).first()
    bad = led.withColumn("payload_hash", F.when(F.col("arrival_seq") == bounds.hi, F.lit("0" * 64))
                         .otherwise(F.col("payload_hash"))) \
        .withColumn("ledger_hash", F.when(F.col("arrival_seq") == bounds.lo, F.lit("f" * 64))
                    .otherwise(F.col("ledger_hash")))
    return audit.verify_hash_chain(bad)


def q_transaction_history(spark, sf_dir):
    h = details.transaction_history(l1_ledger(spark, sf_dir))
    return h.select("event_id", "event_type", "event_class", "supersedes_event_id", "transaction_id", "txn_date",
                    F.col("amount").cast(MONEY).alias("amount"), "pending", "payload_hash")


def q_sync_runs_view(spark, sf_dir):
    runs = fixtures.sr1_run_events(spark, sf_dir)
    return dimensions.sync_runs_view(runs).select("sync_id", "item_id", "status", "mode", "started_at", "finished_at")


def q_disconnect_all(spark, sf_dir):
    items = dimensions.disconnect_all(fixtures.it1_items(spark, sf_dir), now="N")
    return items.select("item_id", "active", "has_access_token", "token_prefix", "disconnected_at", "updated_at")


def q_scrubbed_errors(spark, sf_dir):
    from cashweave.functions import privacy

    e = fixtures.er1_errors(spark, sf_dir)
    frame = e.select("event_id", F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("transaction_id"),
                     "message", "type_name")
    return privacy.scrub_frame(frame)


def q_list_accounts(spark, sf_dir):
    return details.list_accounts(ob1_accounts(spark, sf_dir))


def q_list_transactions(spark, sf_dir):
    rows = details.list_transactions(l1_active(spark, sf_dir, None), months_back=oracle.MONTHS_BACK,
                                     today=oracle.TODAY)
    return rows.select("transaction_id", "date", F.col("amount").cast(MONEY).alias("amount"), "direction",
                       "pending", "account_id", F.size("category").alias("category_count"))


def q_page_counters(spark, sf_dir):
    from cashweave.sources import pages as page_src

    return page_src.page_counters(fixtures.pg1_pages(spark, sf_dir))


def q_advance_cursor(spark, sf_dir):
    pages = fixtures.pg1_pages(spark, sf_dir).select("item_id", F.col("page_seq").alias("seq"), "mode", "next_cursor")
    items = dimensions.advance_cursor(fixtures.it1_items(spark, sf_dir), pages, now="N")
    return items.select("item_id", "cursor", "updated_at")


def q_credential_key_audit(spark, sf_dir):
    return privacy_jobs.credential_key_summary(l1_ledger(spark, sf_dir))


def q_monthly_bars(spark, sf_dir):
    months = reports.monthly_cashflow(l1_active(spark, sf_dir), months_back=oracle.MONTHS_BACK, today=oracle.TODAY)
    bars = reports.with_bar_widths(months, "net", "bar_pct")
    return bars.select("month", "net", F.round("bar_pct", 4).alias("bar_pct"))


def q_latest_state_refresh(spark, sf_dir):
    """Latest state kept up to date batch by batch equals the latest state of the whole ledger."""
    changes = fixtures.l1_changes(spark, sf_dir)
    cut = changes.agg(F.max("arrival_seq")).first()[0] // 2
    first = stored(ledger_ops.append_events(changes.filter(F.col("arrival_seq") < cut), now=fixtures.FIXTURE_NOW,
                                            chain=False), "refresh-b1")
    previous = stored(state.latest_state(first), "refresh-latest1")
    batch = stored(ledger_ops.append_events(changes.filter(F.col("arrival_seq") >= cut), now=fixtures.FIXTURE_NOW,
                                            ledger=first, chain=False), "refresh-b2")
    refreshed = state.refresh_latest_state(previous, batch)
    return _state_cols(refreshed)


def _tuned(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    return {k: _tuned(v) for k, v in _registry().items()}


def _registry() -> dict[str, Query]:
    return {
        "collapse_repeats": q_collapse_repeats,
        "supersedes_link": q_supersedes_link,
        "event_identity": q_event_identity,
        "latest_state": q_latest_state,
        "current_state": q_current_state,
        "active_state": q_active_state,
        "monthly_cashflow": q_monthly_cashflow,
        "monthly_cashflow_all": q_monthly_cashflow_all,
        "monthly_cashflow_by_account": q_monthly_cashflow_by_account,
        "summarize_months": q_summarize_months,
        "top_merchants_outflow": q_top_merchants_outflow,
        "top_merchants_inflow": q_top_merchants_inflow,
        "observation_append": q_observation_append,
        "account_latest_state": q_account_latest_state,
        "transaction_details": q_transaction_details,
        "search_transactions": q_search_transactions,
        "transaction_versions": q_transaction_versions,
        "status_labels": q_status_labels,
        "diagnostics": q_diagnostics,
        "diagnostics_long": q_diagnostics_long,
        "integrity_report": q_integrity_report,
        "verify_hash_chain": q_verify_hash_chain,
        "verify_hash_chain_limited": q_verify_hash_chain_limited,
        "content_hash_check": q_content_hash_check,
        "events_by_item": q_events_by_item,
        "append_only_audit": q_append_only_audit,
        "append_retry": q_append_retry,
        "report_refresh": q_report_refresh,
        "ledger_tree": q_ledger_tree,
        "event_proof": q_event_proof,
        "ledger_diff": q_ledger_diff,
        "backfill_complete": q_backfill_complete,
        "backfill_state": q_backfill_state,
        "connection_environment": q_connection_environment,
        "upsert_items": q_upsert_items,
        "reconcile_environments": q_reconcile_environments,
        "last_sync": q_last_sync,
        "redact_documents": q_redact_documents,
        "secret_scan": q_secret_scan,
        "fingerprint": q_fingerprint,
        "classify_errors": q_classify_errors,
        "legacy_import": q_legacy_import,
        "legacy_accounts": q_legacy_accounts,
        "stream_ingest": q_stream_ingest,
        "explode_pages": q_explode_pages,
        "open_payload": q_open_payload,
        "detail_labels": q_detail_labels,
        "point_scan": q_point_scan,
        "account_transactions": q_account_transactions,
        "active_items": q_active_items,
        "sync_totals": q_sync_totals,
        "ingest_runs": q_ingest_runs,
        "backfill_job": q_backfill_job,
        "backfill_windows": q_backfill_windows,
        "stream_ingest_stateful": q_stream_ingest_stateful,
        "history_range": q_history_range,
        "report_delivery": q_report_delivery,
        "health_summary": q_health_summary,
        "backfill_plan": q_backfill_plan,
        "credential_key_audit": q_credential_key_audit,
        "verify_hash_chain_tampered": q_verify_hash_chain_tampered,
        "ledger_chain": q_ledger_chain,
        "verify_chain_manifest": q_verify_chain_manifest,
        "chain_deletions": q_chain_deletions,
        "transaction_history": q_transaction_history,
        "sync_runs_view": q_sync_runs_view,
        "disconnect_all": q_disconnect_all,
        "scrubbed_errors": q_scrubbed_errors,
        "list_accounts": q_list_accounts,
        "list_transactions": q_list_transactions,
        "page_counters": q_page_counters,
        "advance_cursor": q_advance_cursor,
        "monthly_bars": q_monthly_bars,
        "latest_state_refresh": q_latest_state_refresh,
    }
