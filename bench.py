"""Benchmark: one timed ingest, then the headline reports over the stored ledger.

Mirrors production: the ingest job appends the change feed to the ledger table, report and
audit jobs read that table. Prints one JSON line. Environment: BENCH_SF_DIR (default
/root/testdata/sf0.1), BENCH_CPUS (default 8). Reports are forced with a ``noop`` write.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from cashweave.operators import audit, details, observations, privacy_jobs, reports, state  # noqa: E402
from cashweave.operators import ledger as ledger_ops  # noqa: E402
from cashweave.plans import catalog  # noqa: E402
from cashweave.session import build_session, checkpoint_dir  # noqa: E402
from cashweave.sources import fixtures, legacy  # noqa: E402

TODAY = "2024-06-15"


def run_all(spark, sf_dir: str, times: dict | None) -> None:
    def timed(name, fn):
        t0 = time.time()
        fn()
        if times is not None:
            times[name] = round(time.time() - t0, 3)

    def force(df):
        df.write.format("noop").mode("overwrite").save()

    path = f"{checkpoint_dir(spark).rstrip('/')}/bench/ledger-{uuid.uuid4().hex}"
    # collapse_repeats: the whole ingest job (project, hash, collapse, link, identity, chain, write).
    timed("collapse_repeats", lambda: ledger_ops.write_events(
        fixtures.l1_changes(spark, sf_dir), now=fixtures.FIXTURE_NOW, path=path, chain=True))
    led = spark.read.parquet(path)
    cur = state.current_state_from_ledger(led)
    act = state.active_state(state.current_state_from_ledger(led, columns=state.REPORT_COLUMNS))
    timed("latest_state", lambda: force(state.latest_state(led)))
    timed("current_state", lambda: force(cur))
    timed("active_state", lambda: force(act))
    timed("two_counts", lambda: (act.agg(F.count(F.lit(1))).collect(), led.agg(F.count(F.lit(1))).collect()))
    timed("monthly_cashflow", lambda: force(reports.monthly_cashflow(act, 12, TODAY)))
    timed("summarize_months", lambda: force(reports.summarize_months(reports.monthly_cashflow(act, 12, TODAY))))
    timed("top_merchants", lambda: force(reports.top_merchants(act, "outflow", 10, 12, TODAY)))
    timed("transaction_details", lambda: force(details.list_transaction_details(cur, None, limit=500)))
    timed("search_transactions", lambda: force(details.list_transaction_details(cur, None, limit=None,
                                                                                  search="n5", include_removed=True)))
    timed("transaction_versions", lambda: force(details.transaction_versions(led)))
    obs = observations.append_account_observations(fixtures.ob1_readings(spark, sf_dir), now=fixtures.FIXTURE_NOW)
    cut = fixtures.l1_changes(spark, sf_dir).agg(F.max("arrival_seq")).first()[0] // 2
    half = f"{checkpoint_dir(spark).rstrip('/')}/bench/half-{uuid.uuid4().hex}"
    changes = fixtures.l1_changes(spark, sf_dir)
    ledger_ops.write_events(changes.filter(F.col("arrival_seq") <= cut), now=fixtures.FIXTURE_NOW, path=half, chain=True)
    timed("append_to_existing", lambda: ledger_ops.write_events(
        changes.filter(F.col("arrival_seq") > cut), now=fixtures.FIXTURE_NOW, path=half, chain=True,
        ledger=spark.read.parquet(half)))
    hot = changes.withColumn("payload", F.col("payload").withField("transaction_id", F.when(
        F.col("arrival_seq") % 3 == 0, F.lit("hot")).otherwise(F.col("payload.transaction_id"))))
    timed("hot_id", lambda: force(ledger_ops.append_events(hot, now=fixtures.FIXTURE_NOW, chain=False)))
    for name in ("integrity_report", "append_only_audit", "stream_ingest", "stream_ingest_stateful"):
        timed(name, lambda: force(catalog.queries()[name](spark, sf_dir)))  # noqa: B023
    timed("observation_append", lambda: force(obs))
    timed("diagnostics", lambda: force(audit.diagnostics(led, cur, obs, state.account_latest_state(obs))))
    timed("verify_hash_chain", lambda: force(audit.verify_hash_chain(led)))
    timed("legacy_import", lambda: force(legacy.import_legacy_transactions(
        fixtures.lg1_legacy_transactions(spark, sf_dir), now=fixtures.FIXTURE_NOW)))
    docs = fixtures.table(spark, sf_dir, "documents")
    timed("redact_documents", lambda: force(privacy_jobs.redact_documents(docs)))
    timed("secret_scan", lambda: force(privacy_jobs.secret_scan(docs)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    run_all(spark, "/root/testdata/sf0.001", None)  # warm-up: class loading and code generation
    times: dict[str, float] = {}
    run_all(spark, sf_dir, times)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "ingest_plus_reports_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
